"""Relations over the driver's tables that play genomes, segments, ranges, layouts and lists.

Each has the same definition as a Spark DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.dna import clean_dna


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``accession, dna``: the letters acgt of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("accession"), clean_dna("text").alias("dna"))


GENOMES = "genomes AS (SELECT doc_id::VARCHAR AS accession, regexp_replace(lower(text), '[^acgt]', '', 'g') AS dna FROM documents)"


def segments(spark: SparkSession, sf_dir: str, nested: bool = False) -> DataFrame:
    """Genes laid end to end in each source; ``nested``: every gene reaches into the next."""
    w = Window.partitionBy("source").orderBy("doc_id")
    cum = F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.expr("cum + n_chars div 4") if nested else F.expr("cum - n_chars div 4")
    rows = table(spark, sf_dir, "documents").withColumn("cum", cum).withColumn("seg_id", (F.row_number().over(w) - 1).cast("long"))
    return rows.select(F.col("source").alias("accession"), "seg_id", (F.col("cum") - F.col("n_chars") + 1).alias("seg_left"), right.alias("seg_right"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("gene"))


def _segments_sql(name: str, right: str) -> str:
    return f"""{name} AS (SELECT source AS accession, seg_id, cum - n_chars + 1 AS seg_left, {right} AS seg_right,
  CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || doc_id AS gene
  FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS seg_id,
    (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM documents))"""


SEGMENTS = _segments_sql("segments", "cum - n_chars // 4")
NESTED = _segments_sql("segments", "cum + n_chars // 4")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, accession, left, right, strand``: a range in some source for each event."""
    total = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("accession")).agg(F.sum("n_chars").alias("total"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("accession"), "user_id")
    left = 1 + (F.col("qid") * 7919) % F.col("total")
    return e.join(total, "accession").select("qid", "accession", left.alias("left"), (left + 25 + F.col("user_id") % 500).alias("right"), F.when(F.col("qid") % 2 == 0, "+").otherwise("-").alias("strand"))


RANGES = """totals AS (SELECT source AS accession, sum(n_chars)::BIGINT AS total FROM documents GROUP BY source),
ranges AS (SELECT event_id AS qid, accession, 1 + (event_id * 7919) % total AS q_left, 1 + (event_id * 7919) % total + 25 + user_id % 500 AS q_right,
  CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM events JOIN totals ON accession = 'src' || (event_id % 20))"""


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of transcription-unit layouts: the lines of an order; R is a promoter, the last gene is the target."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(w).cast("long"))
    gene = F.col("l_returnflag") != "R"
    rows = rows.withColumn("is_gene", gene).withColumn("target_at", F.max(F.when(gene, F.col("idx"))).over(Window.partitionBy("l_orderkey")))
    return rows.select(
        F.col("l_orderkey").alias("diagram"),
        "idx",
        (F.col("idx") * 10).alias("left"),
        (F.col("idx") * 10 + 5).alias("right"),
        (F.col("l_partkey") % 2).alias("top"),
        "is_gene",
        (~gene).alias("is_promoter"),
        F.when(F.col("l_linestatus") == "O", "Right").otherwise("Left").alias("direction"),
        F.col("l_partkey").alias("pos"),
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("name"),
        (gene & (F.col("idx") == F.col("target_at"))).alias("is_target"),
    )


LAYOUTS = """items AS (SELECT l_orderkey AS diagram, idx, l_returnflag <> 'R' AS is_gene,
  CASE WHEN l_linestatus = 'O' THEN 'Right' ELSE 'Left' END AS direction, l_partkey AS pos, l_partkey % 2 AS top, 'p' || l_suppkey AS name,
  max(CASE WHEN l_returnflag <> 'R' THEN idx END) OVER (PARTITION BY l_orderkey) AS target_at
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx FROM lineitem))"""


def source_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``accession, source, dna, length``: a genome for each source, 500 bases longer than its documents."""
    total = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("accession")).agg((F.sum("n_chars") + 500).alias("length"))
    dna = F.substring(F.repeat(F.lit("acgttagcca"), F.floor(F.col("length") / 10).cast("int") + 1), F.lit(1), F.col("length").cast("int"))
    return total.select("accession", F.concat(F.lit("Bug "), "accession").alias("source"), dna.alias("dna"), "length")


SOURCE_GENOMES = """source_genomes AS (SELECT accession, 'Bug ' || accession AS source, substr(repeat('acgttagcca', (length // 10 + 1)::BIGINT), 1, length) AS dna, length
  FROM (SELECT source AS accession, sum(n_chars)::BIGINT + 500 AS length FROM documents GROUP BY source))"""
