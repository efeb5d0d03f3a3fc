"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Steps, all over whole tables:

1. *Targets.*  Sources share the corpus' total size by weight.  A target stops at
   ``max_epochs`` times its source's size; the excess is shared again by weight
   until no target is above.  With sources ordered by cap / weight this has a
   closed form: the sources before some place are at their cap, all others get
   ``weight * level``.
2. *Schedule.*  Slot ``i`` is the point ``frac(i * golden ratio)``; it falls into one
   interval of the cumulative targets and so names a source.  Any prefix of the
   schedule has each source within a few slots of its share.  A slot's rank among
   the slots of its source is the number of the block it takes.
3. *Blocks.*  Each source's documents are shuffled by a hash and laid end to end;
   that stream, repeated up to the source's target in whole words, is cut into as many equal
   blocks as the source has slots, and joined to the slots by rank.  Block ``r`` of ``n`` in ``words``
   is the words from ``r * words / n`` on, so a source gives one run of its stream, each
   document whole epochs and at most one part, and a document's first word has a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._shared import free_name, materialize, with_row_keys
from seqloom.llm._text import word_blocks

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Slots of the schedule, and blocks in a mix.  It sets how finely sources alternate, not what they give.
SLOTS = 1 << 16
#: Digits of the hash that name a run of the shuffled order: sums are kept for each of 16^3 runs.
RUN_DIGITS = 3


def with_sizes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``row_doc, row_source, row_key, size, place``: words of each text and its place in the shuffled order.

    Words are runs of characters other than space and U+0009 to U+000D; a null text
    has none.  ``place`` is the MD5 of doc_id, source and text: it orders the documents of a source.
    ``row_key`` is the column ``key``, or null.
    """
    kept = ["row_doc", "row_source", "row_key", "place"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [w.counts for w in word_blocks(batch.column("text"), lower=False)]
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes, pa.int64())], names=[*kept, "size"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("row_doc"),
        F.col("source").cast("string").alias("row_source"),
        (F.lit(None) if key is None else F.col(key)).cast("long").alias("row_key"),
        F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "source", "text").cast("binary")).alias("place"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(count, "row_doc long, row_source string, row_key long, place string, size long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``row_source, source_size, weight, target``: a row for each source.

    Sources are ordered by code point with null last; their weights repeat.  A source
    without words has target 0.  All windows here run over one row per source.
    """
    per_source = sizes.groupBy("row_source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("row_source").asc_nulls_last())
    ranked = per_source.withColumn("nth", (F.row_number().over(order) - 1) % len(weights))
    weight: Column = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") + 1).cast("int"))
    caps = ranked.select("row_source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * float(max_epochs))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    rising = Window.orderBy("ratio", F.col("row_source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = caps.select("*", F.row_number().over(rising).alias("place"), (left / weight_left).alias("level"))
    # The first source in this order whose cap is not below its share sets the level.
    is_open = F.col("ratio") >= F.col("level")
    final = levels.withColumn("final", F.min(F.when(is_open, F.struct("place", "level"))).over(whole))
    share = F.col("weight") * F.col("final.level")
    target = F.when(F.col("final").isNull() | (F.col("cap") < share), F.col("cap")).otherwise(share)
    return final.select("row_source", "source_size", "weight", target.alias("target"))


def golden_schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot, row_source, rank``: the source of each slot and its rank in that source.

    The cumulative intervals (a row per source) are joined to the slots by the
    thousandth of the unit interval, not by a cross join.  A source whose interval is so narrow that
    no point falls into it has one block, at the slot where the interval begins.
    """
    spark = targets.sparkSession
    whole = Window.partitionBy()
    upto = Window.orderBy(F.col("row_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    bounds = targets.where(F.col("target") > 0).select(
        "row_source",
        ((F.sum("target").over(upto) - F.col("target")) / F.sum("target").over(whole)).alias("low"),
        (F.sum("target").over(upto) / F.sum("target").over(whole)).alias("high"),
        F.row_number().over(Window.orderBy(F.col("row_source").desc_nulls_first())).alias("from_last"),
    )
    bounds = bounds.withColumn("high", F.when(F.col("from_last") == 1, 2.0).otherwise(F.col("high")))
    cells = bounds.select("row_source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * 1000).cast("int"), F.least(F.floor(F.col("high") * 1000), F.lit(1000)).cast("int"))).alias("cell"))
    point = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * 1000).cast("int"))
    hit = points.join(cells, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("slot", "row_source")
    first = F.least(F.floor(F.col("low") * slots), F.lit(slots - 1)).cast("long")
    met = hit.groupBy(F.col("row_source").alias("met_source")).count()
    narrow = bounds.join(met, F.col("row_source").eqNullSafe(F.col("met_source")), "left_anti").select(first.alias("slot"), "row_source")
    rank = F.row_number().over(Window.partitionBy("row_source").orderBy("slot")) - 1
    return hit.unionByName(narrow).select("slot", "row_source", rank.cast("long").alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, slots: int = SLOTS, key: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_slot, source`` for each row.

    ``taken`` counts the words the mix takes of this row, repeats included; it never
    exceeds ``max_epochs`` times the row's size.  A source gives its target in whole words (the
    largest remainders are rounded up), however small it is.  ``first_slot`` is the slot of the
    block with the row's first word, null where none is taken: rows in its order alternate as the schedule
    does.  Rows of one doc_id are rows of their own (``key``, a column that tells rows apart, comes
    too if given).  A row without words takes none, a text of any length is one row; a null source
    is a source like others; with no words at all, all targets are 0, and an empty table has no rows.
    Reruns agree: every order comes from hashes.
    """
    sizes = materialize(with_sizes(docs, key), "sizes")
    targets = materialize(source_targets(sizes, weights, max_epochs), "targets")
    schedule = materialize(golden_schedule(targets, slots), "schedule")
    blocks = schedule.groupBy("row_source").agg(F.count("*").alias("blocks"))
    on = lambda a, b: F.col(f"{a}.row_source").eqNullSafe(F.col(f"{b}.row_source"))
    plan = targets.alias("t").join(blocks.alias("b"), on("t", "b"), "left").select("t.row_source", "t.source_size", "t.target", F.coalesce("b.blocks", F.lit(0)).alias("blocks"))
    below, whole = F.floor("target"), Window.partitionBy()
    spare = F.round(F.sum("target").over(whole)).cast("long") - F.sum(below).over(whole)
    nth = F.row_number().over(Window.orderBy((F.col("target") - below).desc(), F.col("row_source").asc_nulls_last()))
    plan = materialize(plan.withColumn("words", F.least(below + F.when(nth <= spare, 1).otherwise(0), F.col("source_size") * max_epochs)), "plan")

    # Places in a source's stream: sums over runs of the shuffled order, then within a run.
    placed = sizes.withColumn("run", F.substring("place", 1, RUN_DIGITS))
    sums = placed.groupBy("row_source", "run").agg(F.sum("size").alias("run_size"))
    before = Window.partitionBy("row_source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("row_source", "run", F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("run_start"))
    starts = starts.alias("s").join(plan.alias("p"), on("s", "p")).select("s.row_source", "s.run", "s.run_start", "p.source_size", "p.target", "p.words", "p.blocks")
    within = Window.partitionBy("row_source", "run").orderBy("place", "row_doc", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = local.alias("d").join(starts.alias("s"), on("d", "s") & (F.col("d.run") == F.col("s.run"))).select("d.row_doc", "d.row_key", "d.size", "d.row_source", (F.col("s.run_start") + F.col("d.local")).alias("at"), "s.source_size", "s.target", "s.words", "s.blocks")
    epochs = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    rest = F.when(F.col("source_size") > 0, F.expr("words % source_size")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    taken = joined.withColumn("taken", (F.col("size") * epochs + part).cast("long")).withColumn("rank", F.when(F.col("taken") > 0, F.expr("at * blocks div words")))
    slotted = taken.alias("x").join(schedule.alias("y"), on("x", "y") & (F.col("x.rank") == F.col("y.rank")), "left")
    out = [F.col("x.row_doc").alias("doc_id"), "x.size", "x.source_size", "x.target", "x.taken", F.col("y.slot").alias("first_slot"), F.col("x.row_source").alias("source")]
    return slotted.select(*out, *([] if key is None else [F.col("x.row_key").alias(key)]))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, slots: int = SLOTS) -> DataFrame:
    """The documents of the mix with the columns of ``docs``; a document taken twice has two rows.

    Each source gives its exact target, however small it is beside the corpus.  Documents stay
    whole: ``taken / size`` is rounded, which concerns the last document of each source's
    stream only.  Rows are decided one by one, also if they share a doc_id or have none; rows that the mix
    doesn't take, those without words among them, are left out; an empty table stays empty;
    columns of any name are kept as they are.
    """
    keyed, key = with_row_keys(docs)
    name, copies, nth = (free_name(keyed, x) for x in ("taken_key", "copies", "nth_copy"))
    plan = mix(keyed, weights, max_epochs, slots, key).where("taken > 0")
    plan = plan.select(F.col(key).alias(name), F.round(F.col("taken") / F.col("size")).cast("int").alias(copies)).where(F.col(copies) > 0)
    rows = keyed.join(plan, F.col(key) == F.col(name))
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, name, copies, nth)


#: In DuckDB SQL, for the weights and limits above: targets in whole words, one run of each source's stream, and the slot of its block.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(concat_ws('|', doc_id::VARCHAR, source, text)) AS place FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), c AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
    ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c
), f AS (SELECT arg_min(level, nth) AS level FROM l WHERE cap / weight >= level
), t AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap < weight * level THEN cap ELSE weight * level END AS target FROM c, f
), w AS (
  SELECT *, least(floor(target)::BIGINT + (row_number() OVER (ORDER BY target - floor(target) DESC, source NULLS LAST)
    <= round(sum(target) OVER ())::BIGINT - sum(floor(target)::BIGINT) OVER ())::BIGINT, source_size * {MAX_EPOCHS})::BIGINT AS words FROM t
), i AS (
  SELECT source, (sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) - target) / sum(target) OVER () AS low,
    sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high,
    row_number() OVER (ORDER BY source DESC NULLS FIRST) AS from_last FROM t WHERE target > 0
), h AS (
  SELECT k AS slot, source FROM (SELECT k, k * {GOLDEN}::DOUBLE - floor(k * {GOLDEN}::DOUBLE) AS u FROM range({SLOTS}) r(k))
  JOIN i ON u >= low AND u < CASE WHEN from_last = 1 THEN 2.0 ELSE high END
), z AS (
  SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS nth, count(*) OVER (PARTITION BY source) AS blocks FROM (
    FROM h UNION ALL SELECT least(floor(low * {SLOTS}), {SLOTS - 1})::BIGINT, source FROM i WHERE NOT EXISTS (FROM h WHERE h.source IS NOT DISTINCT FROM i.source))
), a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS place_at FROM d
), x AS (
  SELECT doc_id, size, source_size, target, words, place_at, a.source,
    (CASE WHEN source_size = 0 THEN 0 ELSE size * (words // source_size) + greatest(0, least(size, words % source_size - place_at)) END)::BIGINT AS taken
  FROM a JOIN w ON a.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, taken, slot AS first_slot, x.source
FROM x LEFT JOIN z ON x.source IS NOT DISTINCT FROM z.source AND taken > 0 AND nth = place_at * blocks // words
"""
