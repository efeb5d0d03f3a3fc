"""Analyses from file to file: inputs by path, results as the text files that each analysis leaves.

Cached pages and fetched records are tables (see ``sources.fetch``); everything else is read here.  Every function
returns the paths of its results by kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans import analyses as A
from seqloom.sources import genomes as G
from seqloom.sources import sinks as K
from seqloom.sources import text as X


def _lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``pos, <column>`` of the lines of a list that aren't blank."""
    return X.lines(spark, path).where("trim(line) <> ''").select(F.col("ln").cast("long").alias("pos"), F.trim("line").alias(column))


def neighbours(spark: SparkSession, input_path: str, data_path: str, output_directory: str, keep_prefix_num: int = 1) -> dict[str, str]:
    """Hits of a list in annotated genomes: neighbours, next neighbours, both counts, and hits without a genome."""
    hits = X.hit_list(X.lines(spark, input_path)).select(F.col("ln").cast("long").alias("id"), "accession", "start", "end", "extra")
    segments = G.read_segments(spark, data_path).select("accession", F.col("seg_id").cast("long").alias("seg_id"), "seg_left", "seg_right", "gene")
    out = A.neighbor_analysis(hits, segments, G.read_genomes(spark, data_path), keep_prefix_num)
    return A.save(A.neighbor_texts(out), output_directory, input_path)


def extracts(spark: SparkSession, data_path: str, rna_path: str, output_directory: str, gene_extract_based: str = "gene", left_idx: int = -2, right_idx: int = -1) -> dict[str, str]:
    """Sequences of named genes, or of the ranges of a table, in order of the list."""
    genomes = G.read_genomes(spark, data_path)
    if gene_extract_based == "range":
        numbered = X.numbered_table(spark, rna_path, "_pos")
        shift = lambda i: i - 1 if i < 0 else i  # noqa: E731  (the place of a column, with one more at the end)
        rows = A.range_extract(numbered, genomes.orderBy("accession").limit(1), shift(left_idx), shift(right_idx))
        return {"extract": A.save_table(rows, output_directory, rna_path, "extract", ["_pos"])}
    if gene_extract_based != "gene":
        raise ValueError("gene_extract_based is 'gene' or 'range'")
    found, lost = A.gene_extract(G.read_segments(spark, data_path), genomes, _lines(spark, rna_path, "gene"))
    missing = A.save({"missing": (lost.select("pos", F.col("gene").alias("line")), "line", ["pos"])}, output_directory, rna_path)
    return {"extract": A.save_table(found.drop("accession"), output_directory, rna_path, "extract", ["_pos", "from"])} | missing


def streams(spark: SparkSession, data_path: str, input_path: str, output_directory: str, mode: str = "rna", limit: int = 200) -> dict[str, str]:
    """Flanks of the genes of a table (``rna``), or the genes around the ranges of a list (``inter``)."""
    segments = G.read_segments(spark, data_path)
    if mode == "rna":
        wanted = X.numbered_table(spark, input_path, "idx").withColumn("idx", F.col("idx") + 1)
        blocks = K.flank_blocks(A.gene_flanks(segments, G.read_genomes(spark, data_path), wanted, limit))
        return A.save({f"stream_{limit}": (blocks, "block", ["idx", "nth"])}, output_directory, input_path)
    part = lambda i: F.trim(F.get(F.split("line", ","), F.lit(i))).try_cast("bigint")
    ranges = _lines(spark, input_path, "line").select(F.col("pos").alias("idx"), part(0).alias("left"), part(1).alias("right"))
    return A.save({"gene": (K.between_blocks(A.genes_between(ranges, segments)), "block", ["idx"])}, output_directory, input_path)


def regions(spark: SparkSession, data_path: str, output_directory: str, compat: bool = False) -> dict[str, str]:
    """Genes and the regions between them, under a header."""
    segments = G.read_segments(spark, data_path)
    rows = K.region_lines(A.gene_range_extract(segments, G.read_genomes(spark, data_path), compat))
    head = spark.createDataFrame([("", -1, "name\trange\tlocus_tag")], "accession string, left long, line string")
    return A.save({"range": (head.unionByName(rows.select("accession", "left", "line")), "line", ["accession", "left"])}, output_directory, data_path)


def near_genes(spark: SparkSession, table_path: str, data_path: str, output_directory: str, compat: bool = False) -> dict[str, str]:
    """Genes near the rows ``name, start, end, locus`` of a table."""
    rows = A.near_gene_report(X.table(spark, table_path), G.read_segments(spark, data_path), G.read_genomes(spark, data_path), compat)
    return {"near_gene": A.save_table(rows, output_directory, table_path, "near_gene", ["name", "seg_left", "seg_right"])}


def loci(spark: SparkSession, table_path: str, data_path: str, output_directory: str) -> dict[str, str]:
    """Sequences and genes of the rows ``Gene, Locus`` of a table, and a probe table of the sequences."""
    rows = A.gentamycin(X.table(spark, table_path), G.read_segments(spark, data_path), G.read_genomes(spark, data_path))
    probes = rows.where("sequence <> ''").select(F.col("Gene").alias("name"), F.col("sequence").alias("gene"))
    return {"gentamycin": A.save_table(rows, output_directory, table_path, "gentamycin", ["Gene", "Locus"]), "gentamycin_consistency": A.save_table(probes, output_directory, table_path, "gentamycin_consistency", ["name", "gene"])}


def pathways(spark: SparkSession, input_path: str, pages: DataFrame, output_directory: str, is_gene: bool = True) -> dict[str, str]:
    """Names and pathways of the ids of a list, and ids without a page, in order of the list."""
    listed = _lines(spark, input_path, "id")
    ok, lost = A.kegg_analysis(listed.select("id").distinct(), pages, is_gene)
    result = listed.join(K.table_lines(ok, ["id", "kegg_id", "name"], ["id", "kegg_id", "name", "pathways"]), "id")
    errors = listed.join(lost, "id", "left_semi").select("pos", F.col("id").alias("line"))
    return A.save({"kegg": (result, "line", ["pos", "kegg_id", "name"]), "kegg_error": (errors, "line", ["pos"])}, output_directory, input_path)


def gene_lists(spark: SparkSession, input_path: str, pages: DataFrame, output_directory: str, analysis_promoter: bool = False, if_get_summary: bool = False, if_get_go_table: bool = False) -> dict[str, str]:
    """A gene list with its columns filled from pages, and genes that weren't found, in order of the list."""
    numbered = X.numbered_table(spark, input_path, "_pos")
    table = numbered.drop("_pos")
    ok, lost = A.ecocyc_analysis(table, pages, if_get_summary, if_get_go_table, analysis_promoter)
    order = numbered.groupBy("gene").agg(F.min("_pos").alias("pos"))
    header = spark.createDataFrame([(-1, "\t".join(table.columns))], "pos long, line string")
    rows = header.unionByName(A.gene_list_lines(ok, lost, table.columns).join(order, "gene").select("pos", "line"))
    errors = lost.join(order, "gene").select("pos", F.col("gene").alias("line"))
    return A.save({"ecocyc": (rows, "line", ["pos"]), "ecocyc_error": (errors, "line", ["pos"])}, output_directory, input_path)


def search_matrix(spark: SparkSession, input_path: str, keywords: list[str], pages: DataFrame, output_directory: str) -> dict[str, str]:
    """Result counts of the names of a list (without its header) by keyword."""
    names = _lines(spark, input_path, "name").where("pos > 0")
    counts = A.search_counts(names.select("name").distinct(), keywords, pages)
    rows = names.join(counts, "name").select(F.col("pos").alias("_pos"), F.col("name").alias("gene"), *[F.col(f"`{k}`") for k in keywords])
    return {"count": A.save_table(rows, output_directory, input_path, "count", ["_pos"])}
