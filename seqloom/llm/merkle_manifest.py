"""Merkle manifest of a table: a tree for each source and one over the sources, collapsed in SQL array functions.

Leaves of a source are numbered in order and gathered in blocks of ``FANOUT ** 2``: fixed-size ordered arrays, whatever
a source's size.  A block collapses two levels by itself (``sequence`` over runs, ``transform`` of each, ``slice`` of
its nodes, ``aggregate`` into one text that is hashed); then the block roots are the nodes of the next blocks, until
a source has one.  On the way back every block hands its nodes the way to the root: for each level the digests to the
left and to the right.  A group of any size is many blocks, and no row holds more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._shared import kept_for, made, materialize, partitions

#: Nodes under one parent; nodes of a block, which is two levels.
FANOUT = 16
BLOCK = FANOUT**2
#: Rows whose crc32 of the doc_id this divides are tampered with by the registered query.
TAMPER = 5
#: Columns that make a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_WAY = "array<struct<left:string,right:string>>"


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _joined(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(""), lambda text, node: F.concat(text, node))


def leaf_of(fields: list[Column]) -> Column:
    """Digest of values: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return _hash(F.concat(*parts))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, 0-based in the order within their group, and ``nodes``, the size of the group.

    Rows are dealt out by ranges of group and order, so a large group lies in many tasks; a table with a row for each task and group
    tells where a task's run of a group begins.  Nulls come first.
    """
    spread = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    kept = materialize(spread.withColumn("line", F.monotonically_increasing_id()).withColumn("task", F.spark_partition_id()), name, "zstd")
    runs = kept.groupBy(F.col(group).alias("run_group"), F.col("task").alias("run_task")).agg(F.min("line").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("run_group").orderBy("run_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"), F.sum("size").over(Window.partitionBy("run_group")).alias("nodes"))
    met = kept.join(runs, (F.col("task") == F.col("run_task")) & F.col(group).eqNullSafe(F.col("run_group")))
    return met.select(*rows.columns, (F.col("at") + F.col("line") - F.col("first")).alias("place"), "nodes")


def _level(nodes: Column) -> Column:
    """Parents of an ordered array of nodes: one for every run of FANOUT, the last of which may be shorter."""
    runs = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.transform(runs, lambda first: _hash(_joined(F.slice(nodes, first, F.lit(FANOUT)))))


def _blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """``grp, block, nodes, items, upper, block_root`` from ``nodes(grp, place, digest, nodes, *extra)``.

    ``items`` has the digests and extra columns of a block in order; ``upper`` its level between (empty where a group has one level or none).
    """
    item = F.struct("place", "digest", *extra)
    found = nodes.groupBy("grp", F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "nodes").agg(F.array_sort(F.collect_list(item)).alias("items"))
    digests = F.col("items.digest")
    found = found.withColumn("upper", F.when(F.col("nodes") > 1, _level(digests)).otherwise(F.array().cast("array<string>")))
    top = F.when(F.col("nodes") <= 1, digests[0]).when(F.col("nodes") <= FANOUT, F.col("upper")[0]).otherwise(_level(F.col("upper"))[0])
    return found.withColumn("block_root", top)


def _beside(nodes: Column, at: Column) -> Column:
    """What lies left and right of the node ``at`` (0-based) in its run."""
    first = at - at % FANOUT
    return F.struct(_joined(F.slice(nodes, first + 1, at - first)).alias("left"), _joined(F.slice(nodes, at + 2, FANOUT - 1 - (at - first))).alias("right"))


def _ways(blocks: DataFrame, above: DataFrame | None, keep: list[str], extra: list[str]) -> DataFrame:
    """A row for each node of the blocks: ``grp, place, *extra, way, *keep``; ``above`` has the way and ``keep`` of each block root."""
    if above is not None:
        higher = above.select(F.col("grp").alias("up_grp"), F.col("place").alias("up_place"), F.col("way").alias("up_way"), *keep)
        blocks = blocks.join(higher, (F.col("grp") == F.col("up_grp")) & (F.col("block") == F.col("up_place")))
    each = blocks.select("grp", "nodes", "upper", "up_way", *keep, F.col("items.digest").alias("digests"), F.posexplode("items").alias("at", "item"))
    run = F.floor(F.col("at") / FANOUT).cast("int")
    own = F.when(F.col("nodes") <= 1, F.array().cast(_WAY))
    own = own.when(F.col("nodes") <= FANOUT, F.array(_beside(F.col("digests"), F.col("at")))).otherwise(F.array(_beside(F.col("digests"), F.col("at")), _beside(F.col("upper"), run)))
    return each.select("grp", F.col("item.place").alias("place"), F.col("item.digest").alias("digest"), *[F.col(f"item.{c}").alias(c) for c in extra], F.concat(own, F.col("up_way")).alias("way"), *keep)


def forest(nodes: DataFrame, extra: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all heights, from the leaves on, and ``grp, digest``, the root of each group.

    From ``nodes(grp, place, nodes, digest, *extra)``.
    """
    heights, roots = [], None
    while True:
        blocks = materialize(_blocks(nodes, extra if not heights else []), name, "zstd")
        heights.append(blocks)
        done = blocks.where(F.col("nodes") <= BLOCK).select("grp", F.col("block_root").alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = blocks.where(F.col("nodes") > BLOCK).select("grp", F.col("block").alias("place"), F.ceil(F.col("nodes") / BLOCK).cast("long").alias("nodes"), F.col("block_root").alias("digest"))
        if nodes.isEmpty():
            return heights, roots


def ways(heights: list[DataFrame], tops: DataFrame, keep: list[str], extra: list[str], name: str) -> DataFrame:
    """The leaves with their ``way`` up, which goes on with that of their group: ``tops(grp, way, *keep)``."""
    above = None
    for k in range(len(heights) - 1, -1, -1):
        # A group's highest blocks take the way of the group, the others that of the block above.
        group = tops.select(F.col("grp").alias("up_grp"), F.col("way").alias("up_way"), *keep)
        first = heights[k].where(F.col("nodes") <= BLOCK).join(group, F.col("grp") == F.col("up_grp"))
        found = _ways(first, None, keep, extra if k == 0 else [])
        if above is not None:
            found = found.unionByName(_ways(heights[k].where(F.col("nodes") > BLOCK), above, keep, extra if k == 0 else []))
        above = found if k == 0 else materialize(found, name, "zstd")
    return above


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its way make."""
    return F.aggregate(way, leaf, lambda node, beside: _hash(F.concat(beside["left"], node, beside["right"])))


def proof(way: Column) -> Column:
    """Digest of all siblings on the way, left to right, level by level."""
    return _hash(F.aggregate(way, F.lit(""), lambda text, beside: F.concat(text, beside["left"], beside["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, altered_leaf, subroot, root, way``: each row's place in the tree over the whole table.

    Leaves of a source ascend by doc_id (null first; equal ids by their digests, and equal rows are equal leaves beside each other);
    every ``FANOUT`` consecutive nodes have a parent, the last run being shorter, until one is left.  The sources' roots,
    ordered by source (null, which is a source like others, first; then by UTF-8 bytes), are collapsed likewise.
    ``altered_leaf`` is what the leaf is with A-Z of the text in lower case, where ``TAMPER`` divides the crc32 of
    the doc_id, else null (a null doc_id isn't tampered with).  ``way`` has, for each level, the digests to the left
    and to the right.  Nulls in any column are told from empty values; a text of any length is hashed whole, once; a
    table of one row is its own root, and an empty one has no rows.  Other columns are ignored, whatever their names.
    """
    before = made()
    text = F.col("text")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in FIELDS]
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, leaf_of([*fields[:-1], lower]))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), leaf_of(fields).alias("digest"), altered.alias("altered"), F.monotonically_increasing_id().alias("nth"))
    leaves = materialize(leaves, "leaves", "zstd")
    placed = numbered(leaves, "source", ["doc_id", "digest", "nth"], "placed")

    # The sources are numbered as they follow each other, which is their place in the tree above.
    sources = placed.where(F.col("place") == 0).select(F.lit(0).alias("one"), F.col("source").alias("name"))
    sources = materialize(numbered(sources, "one", ["name"], "sources"), "sources")
    keyed = placed.join(sources.select("name", F.col("place").alias("grp")), F.col("source").eqNullSafe(F.col("name")))
    heights, roots = forest(keyed.select("grp", "place", "nodes", "digest", "doc_id", "altered"), ["doc_id", "altered"], "blocks")
    over = roots.join(sources.select(F.col("place").alias("grp"), "nodes"), "grp").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), "nodes", "digest")
    tops, root = forest(over, [], "tops")
    start = root.select("grp", F.array().cast(_WAY).alias("way"), F.col("digest").alias("root"))
    found = ways(tops, start, ["root"], [], "ways").select(F.col("place").alias("grp"), F.col("digest").alias("subroot"), "root", "way")
    found = materialize(found, "subroots", "zstd")
    out = ways(heights, found, ["subroot", "root"], ["doc_id", "altered"], "ways")
    return kept_for(out.select("doc_id", F.col("digest").alias("leaf"), F.col("altered").alias("altered_leaf"), "subroot", "root", "way"), before)


def proofs(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row, as ``manifest`` says.

    ``folded_root`` comes from the altered leaf where there is one, else the leaf, and the original siblings.
    """
    rows = manifest(docs)
    fold = folded(F.coalesce("altered_leaf", "leaf"), F.col("way"))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("way")).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str, group: str, levels: int) -> str:
    """CTEs ``<name>0`` to ``<name><levels>``: nodes of each level with what is beside them, in DuckDB SQL."""
    beside = f"(PARTITION BY {group}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
    sides = f"""CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER {beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lefts,
    CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER {beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS rights"""
    out = f"{name}0 AS (SELECT {group}, pos, n, digest, {sides} FROM {leaves})"
    for k in range(1, levels + 1):
        up = f"SELECT {group}, pos // {FANOUT} AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{k - 1} GROUP BY {group}, pos // {FANOUT}, n"
        out += f", {name}{k} AS (SELECT {group}, pos, n, digest, {sides} FROM ({up}))"
    return out


def _sql(levels: int = 6, tops: int = 3) -> str:
    """Row-wise DuckDB SQL, level by level, for up to 16 ** levels leaves of a source and 16 ** tops sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join([*(field(c) for c in FIELDS[:-1]), field(text)]) + ")"
    crc = "(SELECT list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    way = [*(f"l{k}" for k in range(levels)), *(f"u{k}" for k in range(tops))]
    joins = "".join(f" JOIN l{k} ON l{k}.sno = w.sno AND l{k}.pos = w.pos // {FANOUT**k}" for k in range(levels)) + f" JOIN l{levels} ON l{levels}.sno = w.sno"
    joins += "".join(f" JOIN u{k} ON u{k}.pos = w.sno // {FANOUT**k}" for k in range(tops)) + f" JOIN u{tops} ON true"
    steps = ", ".join(f"{x}.lefts AS left_{x}, {x}.rights AS right_{x}, {x}.n AS n_{x}" for x in way)
    fold = "start"
    folds = ""
    for k, x in enumerate(way):
        folds += f", f{k} AS (SELECT *, CASE WHEN n_{x} > 1 THEN sha256(left_{x} || {fold} || right_{x}) ELSE {fold} END AS fold{k} FROM {'met' if not k else f'f{k - 1}'})"
        fold = f"fold{k}"
    return f"""
WITH d AS (
  SELECT doc_id, source, {leaf('text')} AS digest, CASE WHEN xor({crc}, 4294967295::UBIGINT) % {TAMPER} = 0 THEN {leaf(lower)} END AS altered FROM documents
), w AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sno, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d
), {_tree_sql('l', 'w', 'sno', levels)}, t AS (
  SELECT 0 AS one, sno AS pos, count(*) OVER () AS n, digest FROM l{levels}
), {_tree_sql('u', 't', 'one', tops)}, met AS (
  SELECT w.doc_id, w.digest AS leaf, coalesce(w.altered, w.digest) AS start, l{levels}.digest AS subroot, u{tops}.digest AS root, {steps} FROM w{joins}
){folds}
SELECT doc_id, leaf, subroot, root, sha256({' || '.join(f'left_{x} || right_{x}' for x in way)}) AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM f{len(way) - 1}
"""


PROOFS_SQL = _sql()
