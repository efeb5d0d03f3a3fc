"""Readers of line-oriented text: records, hit lists, tables, name lists.

Lines get their place in the file from one read of the whole file per row; a record is the
running count of its header lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.sources.scratch import once


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, ln, line`` of text files, lines in order from 0, without line ends."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines_of(whole, "file", "value")


def lines_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    body = F.regexp_replace(F.col(text), "\r\n", "\n")
    return rows.select(key, F.posexplode(F.split(body, "\n")).alias("ln", "line"))


def records(rows: DataFrame, key: str, is_header: Column) -> DataFrame:
    """Adds ``rec``, the 1-based number of the record a line is in; lines before the first header have 0."""
    upto = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rec", F.sum(is_header.cast("int")).over(upto))


def _ordered(value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("ln", value.alias("v")))), lambda x: x["v"])


def key_values(text: Column, pair: str = ",", equals: str = "=") -> Column:
    """``k=v,k=v`` as a map; pairs without a sign have a null value, of a repeated key the last counts."""
    items = F.filter(F.split(text, pair), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(F.substring_index(x, equals, 1).alias("k"), x.contains(equals).alias("has"), x.alias("raw")))
    entry = lambda p: F.struct(p["k"].alias("key"), F.when(p["has"], F.regexp_replace(p["raw"], "^[^" + equals + "]*" + equals, "")).alias("value"))
    empty = F.expr("cast(map() as map<string,string>)")
    return F.aggregate(F.transform(pairs, entry), empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


_HIT = r"^>([^/\t]+)/(\d+)-(\d+)(?:\t(.*))?$"


def parse_hit(line: Column) -> Column:
    """``>key/a-b[\\textra]`` as a struct; null for other lines."""
    part = lambda i: F.regexp_extract(line, _HIT, i)
    return F.when(line.rlike(_HIT), F.struct(part(1).alias("accession"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"), part(4).alias("extra")))


def hit_list(rows: DataFrame) -> DataFrame:
    """``file, ln, accession, start, end, extra`` of the hit lines; others are passed over."""
    key = rows.columns[0]
    return rows.select(key, "ln", parse_hit(F.trim("line")).alias("h")).where("h is not null").select(key, "ln", "h.*")


def match_records(rows: DataFrame) -> DataFrame:
    """Records of a search result: ``rec, accession, start, end, values`` (map) and ``lines`` after the header.

    Any ``>`` header opens a record; ``(n)`` and blank lines are passed over.
    """
    key = rows.columns[0]
    kept = rows.where((F.trim("line") != "") & ~F.trim("line").rlike(r"^\(\d+(-\d+)?\)$"))
    cut = records(kept, key, F.col("line").startswith(">")).where("rec > 0")
    hit = parse_hit(F.trim("line"))
    header = F.max(F.when(F.col("line").startswith(">"), hit))
    rest = _ordered(F.when(~F.col("line").startswith(">"), F.col("line")))
    out = cut.groupBy(key, "rec").agg(header.alias("h"), F.filter(rest, lambda x: x.isNotNull()).alias("lines"))
    return out.select(key, "rec", "h.accession", "h.start", "h.end", key_values(F.regexp_replace("h.extra", r"direction=[+-],", "")).alias("values"), "lines")


def numbered_blocks(rows: DataFrame) -> DataFrame:
    """``idx, lines`` of blocks that open with ``(n)`` or ``(n-m)``; of equal numbers the last block counts."""
    key = rows.columns[0]
    cut = records(rows, key, F.trim("line").rlike(r"^\(\d+(-\d+)?\)$")).where("rec > 0")
    blocks = cut.groupBy(key, "rec").agg(F.min_by(F.trim("line"), "ln").alias("idx"), _ordered(F.col("line")).alias("all"))
    blocks = blocks.withColumn("lines", F.slice(F.col("all"), 2, F.greatest(F.size("all") - 1, F.lit(0))))
    return blocks.groupBy(key, "idx").agg(F.max_by("lines", "rec").alias("lines"))


def neighbour_records(rows: DataFrame) -> DataFrame:
    """``rec, accession, start, end, direction, source, genes`` of a neighbour result.

    Headers are ``>acc/a-b(+)``; the source is the SOURCE line's or ``source`` key's, wherever it stands; lines
    ``left-right<tab>product`` are genes.
    """
    key = rows.columns[0]
    head, gene = r"^>([^/]+)/(\d+)-(\d+)\(([+-])\)", r"^(\d+)-(\d+)\t(.*)$"
    line = F.col("line")
    cut = records(rows, key, line.startswith(">")).where("rec > 0")
    h, g = (lambda i: F.regexp_extract(line, head, i)), (lambda i: F.regexp_extract(line, gene, i))
    header = F.when(line.rlike(head), F.struct(h(1).alias("accession"), h(2).cast("long").alias("start"), h(3).cast("long").alias("end"), h(4).alias("direction")))
    source = F.when(line.rlike(r"(?i)^source\s"), F.trim(F.regexp_replace(line, r"(?i)^source\s+", "")))
    entry = F.when(line.rlike(gene), F.struct("ln", g(1).cast("long").alias("left"), g(2).cast("long").alias("right"), g(3).alias("gene")))
    out = cut.groupBy(key, "rec").agg(F.max(header).alias("h"), F.min(source).alias("source"), F.sort_array(F.collect_list(entry)).alias("g"))
    return out.select(key, "rec", "h.*", "source", F.transform("g", lambda x: F.struct(x["left"].alias("left"), x["right"].alias("right"), x["gene"].alias("gene"))).alias("genes"))


def table(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A table with a header; all columns are strings."""
    return spark.read.csv(path, sep=separator, header=True, inferSchema=False)


def numbered_table(spark: SparkSession, path: str, name: str = "pos", separator: str = "\t") -> DataFrame:
    """``table`` with ``name``, the places of its rows from 0 on: files in order of their paths, rows as they stand there.

    Large files are read in byte ranges by many tasks.  A row's place is its place in its range and the number of rows in the ranges
    before; ids that rise along a read are no places where there is more than one range.  The rows are stored once with
    their ranges, so all uses see the same places.
    """
    rows = table(spark, path, separator)
    cols = rows.columns
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    held = once(rows.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *at, F.monotonically_increasing_id().alias("id")), "table")
    ranges = held.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each byte range
    starts = ranges.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = held.join(starts, ["file", "block"])
    return placed.select("row.*", (F.col("start") + F.col("id") - F.col("first")).alias(name))


def names(spark: SparkSession, path: str) -> DataFrame:
    """``name``: one trimmed name a line, blanks left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """``left, right`` from lines ``left,right``; blanks left out."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    part = lambda i: F.trim(F.get(F.split("value", ","), F.lit(i))).try_cast("bigint")
    return rows.select(part(0).alias("left"), part(1).alias("right"))


def numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").try_cast("double").alias("x")).where("x is not null")
