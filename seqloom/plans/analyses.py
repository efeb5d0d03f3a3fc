"""Whole analyses over files: each takes paths and parameters and returns named DataFrames.

``save`` puts the text forms of a result into a folder.  Nothing is cut or sampled; ``limit``-like
parameters (``top_k``) are what the analysis asks for.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import dna as D
from seqloom.functions import similarity as S
from seqloom.functions import text as N
from seqloom.operators import cluster as C
from seqloom.operators import enrich as E
from seqloom.operators import intervals as I
from seqloom.operators import promoters as P
from seqloom.operators import search as Q
from seqloom.sources import genomes as G
from seqloom.sources import pages as H
from seqloom.sources import sinks as K
from seqloom.sources import text as X
from seqloom.sources.scratch import new_path, once

#: Probes of one pass over the genomes: they are sent to every task.
MOST_PROBES = 1_000_000


def save(frames: dict[str, tuple[DataFrame, str, list[str]]], folder: str, input_path: str) -> dict[str, str]:
    """Writes ``kind: (rows, line column, order columns)`` as text; returns the paths."""
    out = {}
    for kind, (rows, line, order) in frames.items():
        out[kind] = f"{folder}/{K.result_name(input_path, kind)}"
        K.write_lines(rows, out[kind], line, [F.col(c) for c in order])
    return out


def save_table(rows: DataFrame, folder: str, input_path: str, kind: str, order: list[str]) -> str:
    """Writes a tab-separated result without its order columns that begin with ``_``; returns the path."""
    path = f"{folder}/{K.result_name(input_path, kind)}"
    K.write_table(rows.orderBy(*order).select(*[c for c in rows.columns if not c.startswith("_")]), path)
    return path


def cluster_texts(out: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, str, list[str]]]:
    return {
        "cluster": (K.cluster_lines(out["cluster"]), "line", ["first", "block"]),
        "sample": (K.alignment_blocks(out["sample"]), "block", ["idx"]),
        "all": (K.fasta_blocks(out["all"]), "block", ["idx"]),
        "only": (K.fasta_blocks(out["only"]), "block", ["idx"]),
    }


def clusters_of(hits: DataFrame) -> dict[str, DataFrame]:
    """Clusters of alignment hits of equal sequence: ``cluster`` (in blocks), ``sample, all, only, odd_letters``."""
    key = F.upper(F.col("data")[1]["seq"])
    members = hits.withColumn("member", F.col("gene_no"))
    last = hits.select("idx", F.col("data")[2]["name"].alias("name"), F.col("data")[2]["start"].alias("start"), F.col("data")[2]["end"].alias("end"), F.col("data")[2]["seq"].alias("seq"))
    return {
        "cluster": C.cluster_blocks(members, key),
        "sample": C.representatives(hits, key),
        "all": last,
        "only": last.where(D.is_strict("seq")),
        "odd_letters": last.select(F.explode(D.odd_letters("seq")).alias("letter")).distinct(),
    }


def cluster_match(spark: SparkSession, rna_tag: str, input_path: str, output_directory: str | None = None) -> dict[str, DataFrame]:
    """``clusters_of`` the hits of a file, and their four text files."""
    out = clusters_of(G.read_alignments(spark, input_path, rna_tag))
    if output_directory:
        save(cluster_texts(out), output_directory, input_path)
    return out


def gene_similarity_match(
    spark: SparkSession,
    gene_path: str,
    data_path: str,
    output_directory: str | None = None,
    top_k: int = 20,
    candidate_distance: int = 5,
    patience: int = 0,
    weighted: dict[str, float] | None = None,
    conditions: dict | None = None,
    continuous_mismatch_limit: int | None = None,
    ascending: bool = False,
    min_similarity: float | None = None,
    gene_name_filter: list[str] | None = None,
    compat: bool = False,
) -> DataFrame:
    """Best windows of the probes of a table (``name``, ``gene``) in annotated genomes, with their alignments.

    Probes are a user's list, read to the driver by blocks of MOST_PROBES, as every task of a pass has all of its block; each
    block is a pass over the genomes.
    """
    if not weighted:
        raise ValueError("weighted names the similarities and their weights")
    place = lambda kind: tuple((c["offset"], c["length"]) for c in (conditions or {}).get(kind, ()))
    options = S.Options(patience=patience, mismatch_limit=continuous_mismatch_limit, must=place("must"), optional=place("optional"))
    listed = X.numbered_table(spark, gene_path).select("name", "gene", "pos")
    if gene_name_filter:
        listed = listed.where(F.col("name").isin(gene_name_filter))
    probes = ((r["name"], r["gene"]) for r in listed.orderBy("pos").toLocalIterator())
    genomes, passes = G.read_genomes(spark, data_path), []
    while (some := list(islice(probes, MOST_PROBES))) or not passes:
        one = Q.search(some, genomes, weighted, options, top_k, candidate_distance, ascending, min_similarity, render=True, compat=compat)
        passes.append(one.withColumn("nth", (F.col("nth") + len(passes) * MOST_PROBES).cast("int")))
        if len(some) < MOST_PROBES:
            break
    found = reduce(DataFrame.unionByName, passes)
    if output_directory:
        save({"match": (K.match_blocks(found), "block", ["nth", "rank"])}, output_directory, gene_path)
    return found


# Locations of matches ----------------------------------------------------------------------------


def locate(hits: DataFrame, records: DataFrame, compat: bool = False) -> DataFrame:
    """Hits ``id, start, end`` with the records they touch.

    ``id, gene, location, label, drawing`` and the record: ``name, r_start, r_end, r_left, r_right, direction,
    is_gene, product``.  ``records``: as ``interval_records`` gives them.  A hit that touches none is inter-genic, named by its
    neighbours.  Where both sides have an ``accession``, only records of the hit's own count.  ``compat`` looks only at
    the records within two ranks of the hit's start.
    """
    by = ("accession",) if "accession" in hits.columns and "accession" in records.columns else ()
    q = hits.select("id", *by, "start", F.least("start", "end").alias("left"), F.greatest("start", "end").alias("right"), F.when(F.col("start") < F.col("end"), ">").otherwise("<").alias("hit_direction"))
    near = I.rank_neighbourhood(q, records, 2, by, "start") if compat else I.overlap_join(q, records, by)
    seen = near.withColumn("location", I.location_label(I.classify("seg_left", "seg_right", "left", "right"), "direction"))
    drawing = I.coverage_drawing(F.col("left"), F.col("right"), F.col("seg_left"), F.col("seg_right"), F.col("direction"))
    label = E.sense_label(F.col("location"), F.col("direction"), F.col("hit_direction"))
    record = ["seg_start", "seg_end", "seg_left", "seg_right"]
    hit = seen.where("location <> 'inter-genic'").select("id", "gene", "location", label.alias("label"), drawing.alias("drawing"), F.col("gene").alias("name"), *[F.col(c).alias(c.replace("seg_", "r_")) for c in record], "direction", "is_gene", "product")
    rest = q.join(hit.select("id").distinct(), "id", "left_anti")
    around = I.nearest(rest, records.select(*by, "seg_id", "seg_left", "seg_right", "gene"), by)
    name = F.concat_ws(",", F.coalesce("up.gene", F.lit("None")), F.coalesce("down.gene", F.lit("None")))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("r_start", "long"), ("r_end", "long"), ("r_left", "long"), ("r_right", "long"), ("direction", "string"), ("is_gene", "boolean"), ("product", "string"))]
    between = around.select("id", name.alias("gene"), F.lit("inter-genic").alias("location"), F.lit("inter genic").alias("label"), F.lit(None).cast("string").alias("drawing"), name.alias("name"), *none)
    return hit.unionByName(between)


def interval_records(table: DataFrame, promoters: bool = False) -> DataFrame:
    """Records for ``locate`` from a gene annotation table: every row counts, also of a repeated gene; ``seg_id`` is their order by start."""
    r = E.inter_records(table, promoters)
    placed = I.ranked(r.withColumn("seg_id", F.monotonically_increasing_id()), (), "start")
    return placed.select(F.col("seg_rank").alias("seg_id"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.col("left").alias("seg_left"), F.col("right").alias("seg_right"), F.col("name").alias("gene"), "direction", "is_gene", "product")


def located_matches(matches: DataFrame, records: DataFrame, compat: bool = False) -> DataFrame:
    """``matches(rec, sub, start, end, ..)`` with ``locations``, the texts of what they touch, in order of the records, and ``forward``.

    ``compat`` compares positions as texts for ``forward``, the direction that a block draws.
    """
    keyed = matches.withColumn("id", F.struct("rec", F.coalesce("sub", F.lit(0)).alias("sub")))
    found = locate(keyed.select("id", "start", "end"), records, compat)
    texts = found.select("id", F.struct(F.coalesce("r_start", F.lit(0)).alias("at"), F.coalesce("r_end", F.lit(0)).alias("to"), K.location_text(found).alias("text")).alias("t"))
    listed = texts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["text"]).alias("locations"))
    kind = "string" if compat else "long"
    return keyed.join(listed, "id").drop("id").withColumn("forward", F.col("start").cast(kind) < F.col("end").cast(kind))


def sub_matches(matches: DataFrame) -> DataFrame:
    """Stretches of each match that reach its consistency: rows as ``matches`` with ``sub`` from 1, ``sub_left, sub_right``."""
    marks = F.col("values")["consistency_match_format  :"]
    score = F.floor(F.col("values")["consistency_similarity"].try_cast("double"))
    known = matches.where(marks.isNotNull() & score.isNotNull())
    found = Q.best_submatches(known.select(F.col("rec").alias("id"), "start", "end", marks.alias("marks"), score.alias("score")))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("right"))
    subs = found.select(F.col("id").alias("rec"), nth.alias("nth"), F.col("left").alias("own_left"), F.col("right").alias("own_right"), "sub_start", "sub_end")
    cut = F.transform_values("values", lambda k, v: F.when(k.contains(":") & k.contains("consistency"), F.substring(F.trim(v), F.col("own_left").cast("int"), (F.col("own_right") - F.col("own_left") + 1).cast("int"))).otherwise(v))
    joined = known.drop("sub", "sub_left", "sub_right").join(subs, "rec").withColumn("values", cut)
    return joined.select("rec", F.col("nth").alias("sub"), F.col("own_left").alias("sub_left"), F.col("own_right").alias("sub_right"), "accession", F.col("sub_start").alias("start"), F.col("sub_end").alias("end"), "values", "lines")


def match_rows(lines: DataFrame) -> DataFrame:
    """Rows of ``located_matches`` from the lines of a search result."""
    none = F.lit(None)
    found = X.match_records(lines)
    return found.select("rec", none.cast("int").alias("sub"), none.cast("long").alias("sub_left"), none.cast("long").alias("sub_right"), "accession", "start", "end", "values", "lines")


def gene_locations(matches: DataFrame, table: DataFrame, process_sub_data: bool = True, filter_sub_span: tuple[int, int] | None = None, output_promoter: bool = False, wanted: DataFrame | None = None, compat: bool = False) -> dict[str, DataFrame]:
    """``location`` and ``sub_location``: matches, and their best stretches, with what they touch in a gene table.

    ``filter_sub_span``: stretches at a 5' end must lie from so many bases before to so many after the gene's start.
    ``wanted(name)``: only matches that touch one of these genes.
    """
    records = once(interval_records(table, output_promoter), "records")
    if wanted is not None:
        keyed = matches.withColumn("id", F.col("rec"))
        low = wanted.select(F.lower("name").alias("gene")).distinct()
        touched = locate(keyed.select("id", "start", "end"), records, compat).select(F.col("id").alias("rec"), F.lower("gene").alias("gene"))
        matches = matches.join(touched.join(low, "gene", "left_semi").select("rec").distinct(), "rec", "left_semi")
    out = {"location": located_matches(matches, records, compat)}
    if process_sub_data:
        subs = once(sub_matches(matches), "stretches")
        if filter_sub_span:
            keyed = subs.withColumn("id", F.struct("rec", "sub"))
            near = locate(keyed.select("id", "start", "end"), records, compat)
            first = near.groupBy("id").agg(F.min_by(F.struct("location", "r_start", "direction"), F.struct(F.coalesce("r_start", F.lit(0)), F.coalesce("r_end", F.lit(0)))).alias("f"))
            passed = keyed.select("id", "start", "end").join(first, "id").where(E.sub_location_passes(F.col("f.location"), F.col("start"), F.col("end"), F.col("f.r_start"), F.col("f.direction"), *filter_sub_span))
            subs = keyed.join(passed.select("id"), "id", "left_semi").drop("id")
        out["sub_location"] = located_matches(subs, records, compat)
    return out


def gene_location_analysis(
    spark: SparkSession,
    input_file_path: str,
    ecocyc_file_path: str,
    output_directory: str | None = None,
    process_sub_data: bool = True,
    filter_sub_span: tuple[int, int] | None = None,
    output_promoter: bool = False,
    filter_gene_path: str | None = None,
    compat: bool = False,
) -> dict[str, DataFrame]:
    """``gene_locations`` of the matches of a search result's file, and their text files."""
    wanted = X.names(spark, filter_gene_path) if filter_gene_path else None
    out = gene_locations(match_rows(X.lines(spark, input_file_path)), X.table(spark, ecocyc_file_path), process_sub_data, filter_sub_span, output_promoter, wanted, compat)
    if output_directory:
        save({kind: (K.location_blocks(rows), "block", ["rec", "sub"]) for kind, rows in out.items()}, output_directory, input_file_path)
    return out


def location_tsv(matches: DataFrame, table: DataFrame, most_intervals: int = 4, output_promoter: bool = False, compat: bool = False) -> DataFrame:
    """Locations flattened: a row for each record that a match touches, with the columns LOCATION_COLUMNS and pairs of
    interval columns for the stretches that reach the match's consistency.

    Type, sizes and product are those of the gene's last row in the table, by ``row_order`` if it has that column; a promoter has none.
    """
    records = once(interval_records(table, output_promoter), "records")
    found = locate(matches.select(F.col("rec").alias("id"), "start", "end"), records, compat).withColumnRenamed("id", "rec")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in table.columns else F.lit("")
    numbered = table if "row_order" in table.columns else table.withColumn("row_order", F.monotonically_increasing_id())
    last = C.last_of_each(numbered, "gene", "row_order").select(F.trim("gene").alias("last_gene"), *[blank(c).alias(f"last_{c}") for c in ("type", "exonic_gene_sizes", "product")])
    spans = sub_matches(matches).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct(F.col("sub_left").alias("start"), F.col("sub_right").alias("end")))).alias("spans"))
    m = matches.select("rec", "start", "end", "values").join(spans, "rec", "left")
    rows = found.select("rec", "gene", "label", "r_start", "r_end").join(m, "rec").join(last, F.trim("gene") == F.col("last_gene"), "left")
    value = lambda k: F.coalesce(F.col("values")[k], F.lit(""))
    target = F.coalesce(*[F.col("values")[f"{k}_target_format :"] for k in S.SIMILARITY_ALIASES], F.lit(""))
    names = {
        "index": F.col("rec").cast("string"), "name": value("name"), **{c: value(c) for c in K.LOCATION_COLUMNS[2:6]}, "location": F.col("label"), "gene_name": F.col("gene"),
        **{c: F.coalesce(f"last_{c}", F.lit("")) for c in ("type", "exonic_gene_sizes", "product")}, "site": F.format_string("%d-%d", "start", "end"), "target_sequence": target,
    }
    flat = rows.select(*[names[c].alias(c) for c in K.LOCATION_COLUMNS], F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.col("rec").alias("_rec"), F.col("r_start").alias("_at"))
    return K.location_table(flat, "spans", most_intervals)


def location_reorder(spark: SparkSession, location_path: str, index_path: str, output_directory: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks in the order of an index list, keys of the list without a block)."""
    blocks = X.numbered_blocks(X.lines(spark, location_path)).select("idx", "lines")
    wanted = X.lines(spark, index_path).where("trim(line) <> ''").select(F.col("ln").alias("pos"), F.trim("line").alias("idx"))
    found, lost = reordered(blocks, wanted)
    if output_directory:
        save({"reorder": (reorder_blocks(found), "block", ["pos"])}, output_directory, location_path)
    return found, lost


def reordered(blocks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = C.reorder(blocks, wanted)
    key = F.regexp_replace("idx", r"^\(|\)$", "")
    return found, C.missing(wanted.select(key.alias("key"), "pos"), found.select(key.alias("key")), "key")


def reorder_blocks(found: DataFrame) -> DataFrame:
    """``pos, block``: blocks without the blank lines at their end, each followed by one."""
    return found.select("pos", F.concat_ws("\n", "idx", F.regexp_replace(F.array_join("lines", "\n"), r"\s+$", ""), F.lit("")).alias("block"))


# Neighbours ------------------------------------------------------------------------------------


def neighbor_analysis(hits: DataFrame, segments: DataFrame, genomes: DataFrame, keep_prefix_num: int = 1) -> dict[str, DataFrame]:
    """Neighbours of hits ``accession, start, end``: ``neighbors, next, source_counts, gene_counts, errors``.

    ``segments``: ``accession, seg_id, seg_left, seg_right, gene``; ``genomes``: ``accession, source, dna``.  Hits may have
    an ``id`` of their own and ``extra``, further keys as ``k=v,..``.  Hits whose genome isn't there are errors.
    """
    rows = hits if "id" in hits.columns else hits.withColumn("id", F.monotonically_increasing_id())
    extra = ["extra"] if "extra" in hits.columns else []
    q = rows.select("id", "accession", "start", "end", *extra).withColumn("left", F.least("start", "end")).withColumn("right", F.greatest("start", "end")).withColumn("strand", D.strand_of("start", "end"))
    q = once(q, "ranges")  # ids stay those of this table in all outputs
    around = once(neighbours_of(q, segments), "around")
    s = [F.col(f"s.{c}").alias(c) for c in segments.columns if c != "accession"]
    full = around.select("id", *s).join(q.select("id", "left", "right", "strand"), "id")
    following = I.next_on_strand(full.select("id", "left", "right", F.col("strand"), "seg_left", "seg_right", "gene", "seg_id"), "id")
    sources = genomes.select("accession", "source")
    detail = once(I.with_sequence(q, genomes, "left", "right", F.col("strand") == "-").join(sources, "accession"), "detail")
    prefix = C.first_words("source", keep_prefix_num) if keep_prefix_num > 0 else F.col("source")
    known = detail.select("id", "accession", "start", "end", prefix.alias("prefix")).join(following, "id", "left")
    return {
        "neighbors": detail.select("id", "accession", "start", "end", *extra, "strand", "source", "sequence").join(around.groupBy("id").agg(F.sort_array(F.collect_set("s")).alias("genes")), "id", "left"),
        "next": known,
        "source_counts": C.distribution(known.withColumn("v", F.when(F.col("next_gene").isNotNull(), F.col("prefix"))), F.col("v"), "id"),
        "gene_counts": C.distribution(known, F.col("next_gene"), "id"),
        "errors": q.join(sources.select("accession"), "accession", "left_anti").select("id", F.format_string(">%s/%d-%d", "accession", "start", "end").alias("line")),
    }


def neighbours_of(q: DataFrame, segments: DataFrame) -> DataFrame:
    """``id, s``: for ranges ``id, accession, left, right`` the nearest segments on both sides (edges may touch) and all that hold an end."""
    packed = lambda at: F.struct(*[F.col(f"{at}{c}").alias(c) for c in segments.columns if c != "accession"]).alias("s")
    near = I.nearest(q.select("id", "accession", "left", "right"), segments, ("accession",), strict=False)
    sides = near.select("id", F.explode(F.array("up", "down")).alias("n")).where("n is not null").select("id", packed("n."))
    ends = q.select("id", "accession", F.explode(F.array("left", "right")).alias("left")).withColumn("right", F.col("left"))
    inside = I.overlap_join(ends, segments, ("accession",), points=True).select("id", packed(""))
    return sides.unionByName(inside).distinct()


def neighbor_texts(out: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, str, list[str]]]:
    # The most frequent first.
    share = lambda kind: K.share_lines(out[kind]).withColumn("n", -F.col("n"))
    return {
        "neighbor": (K.neighbour_blocks(out["neighbors"]), "block", ["id"]),
        "next_neighbor": (K.next_blocks(out["next"]), "block", ["id"]),
        "source_count": (share("source_counts"), "line", ["n", "first"]),
        "gene_count": (share("gene_counts"), "line", ["n", "first"]),
        "error": (out["errors"], "line", ["id"]),
    }


# Extraction ------------------------------------------------------------------------------------


def gene_extract(segments: DataFrame, genomes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``No, gene, from, end, product, sequence`` of the named genes on the forward strand, names without a gene).

    ``wanted``: ``pos, gene``, or ``gene`` alone.
    """
    w = wanted if "pos" in wanted.columns else once(wanted.withColumn("pos", F.monotonically_increasing_id()), "wanted")
    found = w.select("pos", "gene").join(segments, "gene")
    out = I.with_sequence(found.select("pos", "gene", "accession", "seg_left", "seg_right", "product"), genomes, "seg_left", "seg_right")
    out = out.select(F.format_string("d%d", F.col("pos") + 1).alias("No"), "gene", F.col("seg_left").alias("from"), F.col("seg_right").alias("end"), "product", "sequence", "accession", F.col("pos").alias("_pos"))
    return out, C.missing(w, segments.select("gene"), "gene")


def range_extract(table: DataFrame, genome: DataFrame, left_idx: int = -2, right_idx: int = -1) -> DataFrame:
    """A table with ``sequence`` filled, where it is blank, from two position columns of one genome ``genome(dna)``.

    a < b: bases a to b - 1; else the reverse complement of b + 1 to a; equal: empty; positions that aren't numbers: blank.
    """
    a, b = (F.col(f"`{table.columns[i]}`").try_cast("bigint") for i in (left_idx, right_idx))
    held = E.filled(F.col("sequence")) if "sequence" in table.columns else F.lit(None).cast("string")
    rows = table.withColumn("accession", F.lit("genome")).withColumn("held", held).withColumn("forward", a < b)
    low, high = F.when(F.col("forward"), a).otherwise(b + 1), F.when(F.col("forward"), b - 1).otherwise(a)
    placed = rows.withColumn("low", low).withColumn("high", F.when(F.col("held").isNull(), high))
    made = I.with_sequence(placed, genome.select(F.lit("genome").alias("accession"), "dna"), "low", "high", ~F.col("forward"), "made")
    filled = F.when(F.col("held").isNotNull(), F.col("held")).when(F.col("high").isNotNull(), F.col("made"))
    return made.withColumn("sequence", filled).select(*[F.col(f"`{c}`") for c in table.columns], *([] if "sequence" in table.columns else ["sequence"]))


def gene_flanks(segments: DataFrame, genomes: DataFrame, wanted: DataFrame, limit: int = 200) -> DataFrame:
    """``idx, nth, gene, minus, seg_left, seg_right, product, gene_id, stream, upstream, downstream``.

    ``wanted``: ``gene, map_start_pos, map_end_pos`` and maybe ``idx``; start above end is the minus strand.  Of a gene's
    places those count whose edges are the two positions.  Sides are named as on the gene's strand.
    """
    name, shown = E.split_alias("gene")
    rows = wanted if "idx" in wanted.columns else wanted.withColumn("idx", F.monotonically_increasing_id() + 1)
    w = rows.select("idx", name.alias("gene"), shown.alias("shown"), F.col("map_start_pos").cast("long").alias("a"), F.col("map_end_pos").cast("long").alias("b"))
    extra = [c if c in segments.columns else F.lit(None).cast("string").alias(c) for c in ("product", "gene_id")]
    seg = segments.select("gene", "accession", "seg_id", "seg_left", "seg_right", *extra)
    at = w.join(seg, "gene").where((F.least("a", "b") == F.col("seg_left")) & (F.greatest("a", "b") == F.col("seg_right"))).withColumn("minus", F.col("a") > F.col("b"))
    at = at.withColumn("nth", F.row_number().over(Window.partitionBy("idx").orderBy("accession", "seg_id"))).withColumnRenamed("shown", "label")
    out = I.with_sequence(at, genomes, "seg_left", "seg_right", F.col("minus"), "stream")
    out = I.with_sequence(out, genomes, F.col("seg_left") - limit, F.col("seg_left") - 1, F.col("minus"), "before")
    out = I.with_sequence(out, genomes, F.col("seg_right") + 1, F.col("seg_right") + limit, F.col("minus"), "after")
    side = lambda plus, minus: F.when(F.col("minus"), F.col(minus)).otherwise(F.col(plus))
    return out.select("idx", "nth", F.col("label").alias("gene"), "minus", "seg_left", "seg_right", "product", "gene_id", "stream", side("before", "after").alias("upstream"), side("after", "before").alias("downstream"))


def genes_between(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """``idx, left, right, up, down``: the genes before and after ranges ``idx, left, right`` of one genome."""
    return I.nearest(ranges, segments.select("seg_id", "seg_left", "seg_right", "gene", "product"))


def gene_range_extract(segments: DataFrame, genomes: DataFrame, compat: bool = False) -> DataFrame:
    """Genes and the regions between them, with the genes' locus tags where the segments have them."""
    regions = I.gaps(segments, genomes.select("accession", "length"), compat=compat)
    if "locus_tag" not in segments.columns:
        return regions
    tags = segments.select("accession", F.col("seg_left").alias("left"), F.col("seg_right").alias("right"), F.lit("gene").alias("kind"), F.col("gene").alias("tag_gene"), "locus_tag").distinct()
    on = [regions[c].eqNullSafe(tags[c]) for c in ("accession", "kind", "left", "right")] + [regions["gene"].eqNullSafe(tags["tag_gene"])]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return regions.join(tags, condition, "left").select(*[regions[c] for c in regions.columns], "locus_tag")


def near_gene_report(queries: DataFrame, segments: DataFrame, genomes: DataFrame, compat: bool = False) -> DataFrame:
    """Genes near rows ``name, start, end, locus``: a row for each gene, with both lengths and the sequence.

    The sequence is turned round where start is above end; ``compat`` takes the complement without reversing it.
    """
    q = queries.select("name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), I.parse_locus("locus").alias("p")).where("p is not null")
    q = q.select("name", F.col("p.chrom").alias("accession"), F.least("start", "end").alias("left"), F.greatest("start", "end").alias("right"), (F.col("start") > F.col("end")).alias("minus"), (F.col("p.right") - F.col("p.left") + 1).alias("length"))
    found = I.nearby_genes(q, segments.select("accession", "seg_id", "seg_left", "seg_right", "gene"), ("accession",), compat).drop("query_row")
    g = I.with_sequence(found, genomes, "seg_left", "seg_right")
    seq = F.when(F.col("minus"), D.complement("sequence") if compat else D.reverse_complement("sequence")).otherwise(F.col("sequence"))
    return g.select("name", "gene", "type", "seg_left", "seg_right", "length", (F.col("right") - F.col("left") + 1).alias("compare_length"), seq.alias("sequence"))


def gentamycin(table: DataFrame, segments: DataFrame, genomes: DataFrame) -> DataFrame:
    """Rows ``Gene, Locus`` with ``sequence`` and, for genes that start with DR, the genes ``hit`` and ``related``.

    Equal rows are rows of their own; a locus that isn't one has blanks.
    """
    q = table.select("Gene", "Locus", I.parse_locus(F.trim("Locus")).alias("p")).withColumn("accession", F.col("p.chrom")).withColumn("left", F.col("p.left")).withColumn("right", F.col("p.right")).withColumn("minus", F.col("p.strand") == "-").drop("p")
    rows = I.with_sequence(q, genomes, "left", "right", F.col("minus"), known_only=False)
    dr = rows.where(F.col("Gene").startswith("DR") & F.col("left").isNotNull()).select("accession", "left", "right").distinct()
    near = I.nearby_genes(dr, segments.select("accession", "seg_id", "seg_left", "seg_right", "gene"), ("accession",))
    named = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("gene")))), ",")
    kinds = near.groupBy("accession", "left", "right").agg(named(F.col("type") == "hit").alias("hit"), named(F.col("type") != "hit").alias("related"))
    joined = rows.join(kinds, ["accession", "left", "right"], "left")
    text = lambda c: F.when(F.col("Gene").startswith("DR"), F.coalesce(c, F.lit(""))).otherwise("").alias(c)
    return joined.select("Gene", "Locus", F.when(F.col("left").isNotNull(), F.col("sequence")).alias("sequence"), text("hit"), text("related"))


def consistency_table(genes: DataFrame) -> DataFrame:
    """``name, gene`` from ``name`` and a JSON map of tags to sequences, as ``name-tag``."""
    return genes.select("name", F.explode(F.from_json("sequences", "map<string,string>")).alias("tag", "gene")).select(F.concat_ws("-", "name", "tag").alias("name"), "gene")


def sequence_maps(genes: DataFrame) -> DataFrame:
    """``name, sequences``: sequences ``name, tag, sequence, minus`` as a JSON map for ``consistency_table``; blank ones are left
    out, those of the minus strand turned round."""
    pairs = genes.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", F.struct("sequence", "minus").alias("s"))))).alias("m"))
    plus = N.drop_empty(F.transform_values("m", lambda k, v: F.when(~v["minus"], v["sequence"])))
    minus = N.drop_empty(F.transform_values("m", lambda k, v: F.when(v["minus"], v["sequence"])))
    return pairs.select("name", F.to_json(F.map_concat(plus, N.reverse_all(minus))).alias("sequences"))


def with_locus_genes(rows: DataFrame, segments: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``rows`` with ``gene`` and ``gene_id`` of their ``locus_tag``; ``wanted`` keeps some tags only."""
    kept = rows.where(F.col("locus_tag").isin(wanted)) if wanted else rows
    return kept.join(segments.where("locus_tag is not null").select("locus_tag", "gene", "gene_id").dropDuplicates(["locus_tag"]), "locus_tag", "left")


# Gene lists and pages ----------------------------------------------------------------------------


def layout_items(pages: DataFrame, gene: str | None = None) -> DataFrame:
    """Items of layouts ``diagram, body`` (JSON with ``links``), the target being the gene's last item.

    The gene is one name, or for each page that in its column ``target``.
    """
    body = F.from_json("body", "links array<array<string>>")
    wanted = F.col("target") if gene is None and "target" in pages.columns else F.lit(gene).cast("string")
    rows = pages.select("diagram", wanted.alias("wanted"), F.posexplode(body["links"]).alias("place", "l")).where(F.size("l") == 7)
    at = lambda i: F.get("l", F.lit(i))
    items = rows.select("diagram", "wanted", "place", at(0).cast("long").alias("idx"), at(1).alias("link"), *[at(i).cast("long").alias(n) for i, n in ((2, "left"), (3, "top"), (4, "right"), (5, "bottom"))], P.attributes(at(6)).alias("attr"))
    out = items.withColumn("is_gene", P.is_gene("attr")).withColumn("is_promoter", P.is_promoter("attr", True)).withColumn("direction", P.gene_direction("attr")).withColumn("pos", F.when(F.col("is_gene"), P.gene_start("attr"))).withColumn("name", F.col("attr")["Promoter"]).withColumn("start_site", P.start_site("attr"))
    own = F.col("is_gene") & F.coalesce(F.array_contains(F.split(F.col("attr")["Gene"], r"\s+"), F.col("wanted")), F.lit(False))
    last = F.max(F.when(own, F.col("place"))).over(Window.partitionBy("diagram"))
    return out.withColumn("is_target", own & (F.col("place") == last)).drop("wanted", "place")


def promoters_of(items: DataFrame, best: bool = True) -> DataFrame:
    """``diagram, status, gene_start_pos, promoter_name, promoter_pos`` of layouts.

    ``best``: the promoter of the target's unit and the start of the unit's first gene; else a row for each
    promoter with a start site.  A layout without one is Not Found.
    """
    if not best:
        own = ~F.col("is_gene") & F.col("is_promoter") & F.col("diagram").isNotNull()
        listed = items.groupBy("diagram").agg(F.collect_list(F.when(own, F.struct(F.lit(None).cast("long").alias("at"), "name", "start_site"))).alias("own"))
        all_ = listed.select("diagram", F.explode_outer("own").alias("p")).select("diagram", "p.*")
    else:
        found = P.target_units(items).withColumn("unit", F.when(F.col("unit.promoter").isNotNull(), F.col("unit")))
        all_ = found.select("diagram", F.col("unit.near_gene_pos").alias("at"), F.col("unit.promoter").alias("name"), F.col("unit.promoter_site").alias("start_site"))
    return all_.select("diagram", *E.status_columns(F.col("at"), F.col("name"), F.col("start_site")))


#: Columns of a gene list that a promoter fills where they are blank.
PROMOTER_COLUMNS = ("status", "gene_start_pos", "promoter_name", "promoter_pos")


def _page(pages: DataFrame, kind: str) -> DataFrame:
    return pages.where(F.col("kind") == kind)


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Pages are small in bytes and dear in time, so the number of tasks that parse them doesn't come from their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def ecocyc_analysis(genes: DataFrame, pages: DataFrame, get_summary: bool = False, get_go: bool = False, analysis_promoter: bool = False) -> tuple[DataFrame, DataFrame]:
    """(enriched genes, genes without an id) from a list with ``gene`` and cached ``pages(kind, key, body)``.

    Page kinds: ``gene`` by name, ``tu``, ``summary``, ``go`` and ``promoter`` by id.  Further columns of the list stay and are
    filled where the pages know them (see ``filled_columns``).
    """
    name, shown = E.split_alias("gene")
    g = genes.withColumnRenamed("gene", "listed").select("*", E.split_alias("listed")[0].alias("gene"), E.split_alias("listed")[1].alias("shown"))
    found = g.join(_page(pages, "gene").select(F.col("key").alias("gene"), F.col("body").alias("page")), "gene", "left")
    # Ids are asked for by the results, the layouts and the errors: pages are read once.
    found = once(_dealt(found).withColumn("id", H.gene_id_udf("page", "gene")).drop("page"), "ids")
    ok = found.where("id is not null").join(_dealt(_page(pages, "tu"), "key").select(F.col("key").alias("id"), H.cells_udf("body").alias("attr")), "id", "left")
    ok = ok.withColumn("position", H.position_udf(F.coalesce(F.col("attr")["map position"], F.lit(""))))
    if get_summary:
        ok = ok.join(_dealt(_page(pages, "summary"), "key").select(F.col("key").alias("id"), H.summary_udf("body").alias("summary_text")), "id", "left")
    if get_go:
        terms = F.array_join(F.transform(H.go_udf("body"), lambda t: F.concat_ws("=", t["category"], t["terms"])), ";")
        ok = ok.join(_dealt(_page(pages, "go"), "key").select(F.col("key").alias("id"), terms.alias("go_text")), "id", "left")
    if analysis_promoter:
        targets = found.where("id is not null").select("id", F.col("shown").alias("target")).distinct()
        layouts = _page(pages, "promoter").select(F.col("key").alias("id"), "body").join(targets, "id").select(F.struct("id", "target").alias("diagram"), "target", "body")
        chosen = promoters_of(layout_items(layouts)).select(F.col("diagram.id").alias("id"), F.col("diagram.target").alias("shown"), *[F.col(c).alias(f"unit_{c}") for c in PROMOTER_COLUMNS])
        ok = ok.join(chosen, ["id", "shown"], "left")
    product_kind, product = E.product(F.col("attr"))
    text = lambda c: F.regexp_replace(F.col("attr")[c], "^[_#]+|[_#]+$", "")
    made = {"id": F.col("id"), "gene": F.col("listed"), "product_type": product_kind, "product": product, "location": text("location"), "reaction": text("reaction"), "map_start_pos": F.col("position.start").cast("string"), "map_end_pos": F.col("position.end").cast("string"), "ecocyc_id": F.col("id")}
    if get_summary:
        made["summary"] = F.col("summary_text")
    if get_go:
        made["go"] = F.col("go_text")
    return filled_columns(ok, [c for c in genes.columns if c != "gene"], made, analysis_promoter), found.where("id is null").select(F.col("listed").alias("gene"))


def filled_columns(rows: DataFrame, listed: list[str], made: dict[str, Column], promoter: bool) -> DataFrame:
    """Columns of a list after what pages gave: a page's value counts if there is one; promoter columns are filled
    where the list has a blank or ``Not Found``."""
    out = {}
    for c in [*made, *[c for c in listed if c not in made]]:
        own = F.col(f"`{c}`") if c in listed else F.lit(None).cast("string")
        out[c] = F.coalesce(made[c], own) if c in made else own
    if promoter:
        for c in PROMOTER_COLUMNS:
            own = F.col(f"`{c}`") if c in listed else F.lit(None).cast("string")
            found = F.col("unit_status") == "Found"
            filled = F.when(found, F.col(f"unit_{c}")).otherwise(F.lit("Not Found") if c == "status" else own)
            out[c] = F.when(F.coalesce(own, F.lit("")).isin("", "Not Found"), filled).otherwise(own)
    return rows.select(*[v.alias(c) for c, v in out.items()])


def gene_list_lines(ok: DataFrame, lost: DataFrame, header: list[str]) -> DataFrame:
    """``gene, line``: the list's columns of enriched genes, blank for null; genes that weren't found have ``Not Found``."""
    text = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in header])
    return ok.select("gene", text.alias("line")).unionByName(lost.select("gene", F.concat("gene", F.lit("\tNot Found")).alias("line")))


def url_list_analysis(page: DataFrame, pages: DataFrame, best: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``gene, cluster, product_type, product, location, promoters``, links without a result) from a page ``body`` of links.

    ``pages``: kind ``url`` by link name, ``promoter`` by id.  Products go by the order for link lists; a gene's promoters are the
    best one, with the start of its unit's first gene, or all with a start site.
    """
    listed = H.link_rows(_dealt(page.select("body")), "body", "l").select("l.href", F.col("l.object").alias("key"), "l.title").where("key is not null")
    read = listed.join(_dealt(_page(pages, "url"), "key").select("key", H.cells_udf("body").alias("attr")), "key", "left").withColumn("id", F.col("attr")["ecocyc_id"])
    # Results, layouts and errors are made of what the pages say: it is read once.
    read = once(read, "read")
    layouts = _page(pages, "promoter").select(F.col("key").alias("id"), F.col("body").alias("layout"))
    targets = read.where("id is not null").select("id", F.col("attr")["gene"].alias("target")).distinct().join(layouts, "id")
    items = layout_items(targets.select(F.struct("id", "target").alias("diagram"), "target", F.col("layout").alias("body")))
    chosen = promoters_of(items, best).where("status = 'Found'").select(F.col("diagram.id").alias("id"), F.struct("gene_start_pos", "promoter_name", "promoter_pos").alias("p"))
    listed_units = chosen.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("promoters"))
    kind, product = E.product(F.col("attr"), E.URL_PRODUCT_ORDER)
    blank = lambda c: F.coalesce(c, F.lit(""))
    ok = read.where("attr is not null and size(attr) > 0").join(listed_units, "id", "left")
    out = ok.select("key", blank(F.col("attr")["gene"]).alias("gene"), blank(F.col("attr")["cluster"]).alias("cluster"), blank(kind).alias("product_type"), blank(product).alias("product"), blank(F.col("attr")["location"]).alias("location"), "promoters")
    return out, read.where("attr is null or size(attr) = 0").select("href", "key", "title")


def kegg_analysis(ids: DataFrame, pages: DataFrame, is_gene: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``id, kegg_id, name, pathways``, ids without a page) from ``id`` and cached ``pages(kind, key, body)``.

    ``is_gene``: ids are genes, whose ``gene`` pages list ortholog ids; else they are ortholog ids.  A page without
    names is Not Found, one without pathways No Pathway.
    """
    if is_gene:
        listed = ids.join(_dealt(_page(pages, "gene"), "key").select(F.col("key").alias("id"), H.orthologs_udf("body").alias("m")), "id", "left")
        want = listed.select("id", F.explode_outer(F.map_keys("m")).alias("kegg_id"))
    else:
        want = ids.select("id", F.col("id").alias("kegg_id"))
    got = once(want.join(_dealt(_page(pages, "pathway"), "key").select(F.col("key").alias("kegg_id"), H.pathways_udf("body").alias("p")), "kegg_id", "left"), "pathways")
    some = lambda c, other: F.when(F.size(c) > 0, F.array_join(c, "; ")).otherwise(other)
    named = F.when(F.size("p.names") > 0, F.col("p.names")).otherwise(F.array(F.lit("Not Found")))
    ok = got.where("p is not null").select("id", "kegg_id", F.explode(named).alias("name"), some(F.col("p.pathways"), "No Pathway").alias("pathways"))
    return ok, got.where("p is null").select("id").distinct()


def tallies(ok: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """``total, solved, failed, percent`` of a run, by distinct keys of its results and of its errors."""
    both = ok.select(F.col(key).alias("k"), F.lit(1).alias("good")).unionByName(lost.select(F.col(key).alias("k"), F.lit(0).alias("good"))).groupBy("k").agg(F.max("good").alias("good"))
    n, good = F.count("*"), F.coalesce(F.sum("good"), F.lit(0))
    return both.agg(n.alias("total"), good.alias("solved"), (n - good).alias("failed"), F.when(n > 0, good * 100.0 / n).alias("percent"))


def saved_with_tallies(ok: DataFrame, lost: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, float | None]]:
    """(``ok``, ``lost``, ``total, solved, failed, percent``) of a run that gives a row for each item, in one of the two.

    Both are written as one Parquet table and read back.  The counts are observed in the job that writes, in the tasks that write, so
    they take no further job, and what is computed again for a lost executor counts once.  Repeated items count each time; with
    no items ``percent`` is None.  Columns of the two may have any names.
    """
    spark, path = ok.sparkSession, path or new_path(ok.sparkSession, "run")
    row = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = ok.select(F.lit(True).alias("good"), row(ok).alias("ok")).unionByName(lost.select(F.lit(False).alias("good"), row(lost).alias("lost")), allowMissingColumns=True)
    seen = Observation()
    rows.observe(seen, F.count_if("good").alias("solved"), F.count_if(~F.col("good")).alias("failed")).write.mode("overwrite").parquet(path)
    solved, failed = (seen.get.get(k) or 0 for k in ("solved", "failed"))
    total = solved + failed
    stored = spark.read.schema(rows.schema).parquet(path)
    tally = {"total": total, "solved": solved, "failed": failed, "percent": solved * 100.0 / total if total else None}
    return stored.where("good").select("ok.*"), stored.where("not good").select("lost.*"), tally


def search_counts(names: DataFrame, keywords: list[str], pages: DataFrame) -> DataFrame:
    """``name`` and the number of results for each keyword, from cached ``pages(name, keyword, body)``."""
    hits = pages.select("name", "keyword", H.count_udf("body").alias("n")).withColumn("hits", F.regexp_replace("n", ",", "").try_cast("bigint"))
    return E.name_keyword_matrix(names, keywords, hits)
