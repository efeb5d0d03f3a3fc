"""Writers of the text results, and the names of result files.

Parquet is the canonical form of every result; these writers make the text forms that other
tools read.  Each form is first a column of text blocks or lines with what orders them.  Ordered text
is range-partitioned: its files follow each other by name, so a large result isn't one task's work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def result_name(input_path: str, kind: str) -> str:
    """File name of a result: the input's stem and ``_<kind>_result.txt``."""
    name = input_path.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
    return f"{file_stem(name)}_{kind}_result.txt"


def file_stem(name: str) -> str:
    name = re.sub(r"[^a-zA-Z0-9_.]", "", re.sub(r"\s+", "_", name))
    return re.sub(r"(result|_|all)+$", "", re.sub(r"\.txt|\..tsv|\..csv", "", name))


def write_lines(rows: DataFrame, path: str, line: str, order: list[Column]) -> None:
    """Text files of a column's values, in order over the files' names; a value may hold several lines."""
    rows.orderBy(*order).select(line).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, order: list[Column] = (), header: bool = True) -> None:
    """Tab-separated files; nulls are empty."""
    rows = rows.orderBy(*order) if order else rows
    rows.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", emptyValue="", nullValue="")


def table_lines(rows: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """``line`` and the columns of ``order``: values of the columns joined by tabs, null as empty."""
    columns = columns or [c for c in rows.columns if c not in order]
    text = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    return rows.select(*order, text.alias("line"))


def match_blocks(found: DataFrame) -> DataFrame:
    """``name, rank, block`` (and ``nth``, if it is there) of a search result: number, header with scores, and the drawn alignments if there are any.

    The header is ``>accession/start-end``, a tab, and ``key=value`` pairs: name, direction, scores with two
    decimals, and for drawn results the probe and the three rows of each similarity.
    """
    direction = F.when(F.col("start") < F.col("end"), "+").otherwise("-")
    scores = F.transform(F.map_entries("scores"), lambda e: F.format_string("%s_similarity=%.2f", e["key"], e["value"]))
    parts = [F.array(F.concat(F.lit("name="), "name"), F.concat(F.lit("direction="), direction), F.format_string("weighted_similarity=%.2f", "weighted")), scores]
    if "renderings" in found.columns:
        row = lambda r: F.array(F.concat(r["kind"], F.lit("_gene_format   :="), F.coalesce(r["probe"], F.lit(""))), F.concat(r["kind"], F.lit("_target_format :="), F.coalesce(r["window"], F.lit(""))), F.concat(r["kind"], F.lit("_match_format  :="), F.coalesce(r["marks"], F.lit(""))))
        parts += [F.array(F.concat(F.lit("original      :="), "probe")), F.flatten(F.transform("renderings", row))]
    head = F.concat(F.format_string(">%s/%d-%d\t", "accession", "start", "end"), F.array_join(F.concat(*parts), ","))
    order = ["nth"] if "nth" in found.columns else []
    return found.select(*order, "name", "rank", F.concat_ws("\n", F.format_string("(%d)", "rank"), head, F.lit("")).alias("block"))


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """``first, block, line``: size and members of each cluster; one of several blocks has a line for each, with its whole size."""
    return clusters.select("first", "block", F.format_string("%d\t%s", "size", "members").alias("line"))


def fasta_blocks(hits: DataFrame) -> DataFrame:
    """``idx, block`` of ``>name/start-end`` and the upper-case sequence."""
    return hits.select("idx", F.concat_ws("\n", F.format_string(">%s/%d-%d", "name", "start", "end"), F.upper("seq"), F.lit("")).alias("block"))


def alignment_blocks(hits: DataFrame) -> DataFrame:
    """``idx, block``: a hit's head lines and its three rows in columns."""
    row = lambda r: F.format_string("%19s %8s %131s %8s", F.coalesce(r["name"], F.lit("")), F.coalesce(r["start"].cast("string"), F.lit("")), r["seq"], F.coalesce(r["end"].cast("string"), F.lit("")))
    return hits.select("idx", F.concat_ws("\n", F.array_join("others", "\n"), F.lit(""), F.array_join(F.transform("data", row), "\n"), F.lit("")).alias("block"))


def share_lines(counts: DataFrame) -> DataFrame:
    """``n, first, line``: value, count and percent; in order by falling count, then by first place."""
    return counts.select("n", "first", F.format_string("%s\t%d\t%.4f%%", "value", "n", "percent").alias("line"))


def neighbour_blocks(neighbors: DataFrame) -> DataFrame:
    """``id, block``: a hit with its further keys, SOURCE, its genes and sequence."""
    gene = lambda g: F.concat(g["seg_left"].cast("string"), F.lit("-"), g["seg_right"].cast("string"), F.lit("\t"), F.coalesce(g["gene"], F.lit("UNKNOWN")))
    head = F.format_string(">%s/%d-%d(%s)", "accession", "start", "end", F.when(F.col("start") < F.col("end"), "+").otherwise("-"))
    keys = F.when(F.coalesce("extra", F.lit("")) != "", F.replace(F.replace("extra", F.lit(","), F.lit("\n")), F.lit("="), F.lit("\t"))) if "extra" in neighbors.columns else F.lit(None).cast("string")
    source = F.concat(F.lit("SOURCE\t"), F.coalesce("source", F.lit("UNKNOWN")))
    genes = F.when(F.size("genes") > 0, F.array_join(F.transform("genes", gene), "\n"))
    return neighbors.select("id", F.concat_ws("\n", head, keys, source, genes, F.concat(F.lit("sequence\t"), F.coalesce("sequence", F.lit(""))), F.lit("")).alias("block"))


def next_blocks(following: DataFrame) -> DataFrame:
    """``id, block`` of hits with a next gene: the hit, SOURCE, the gene."""
    head = F.format_string(">%s/%d-%d(%s)", "accession", "start", "end", F.when(F.col("start") < F.col("end"), "+").otherwise("-"))
    gene = F.format_string("%d-%d\t%s", "next_left", "next_right", "next_gene")
    return following.where("next_gene is not null").select("id", F.concat_ws("\n", head, F.concat(F.lit("SOURCE\t"), F.coalesce("prefix", F.lit("UNKNOWN"))), gene, F.lit("")).alias("block"))


def location_blocks(located: DataFrame) -> DataFrame:
    """``rec, sub, block``: number, header, match information, direction, further lines and locations of a (sub-)match."""
    number = F.when(F.col("sub").isNull(), F.format_string("(%d)", "rec")).otherwise(F.format_string("(%d-%d)", "rec", "sub"))
    info = F.array_join(F.transform(F.map_entries("values"), lambda e: F.when(e["key"].contains(":"), F.concat(e["key"], e["value"])).otherwise(F.concat(e["key"], F.lit("\t"), e["value"]))), "\n")
    origin = F.when(F.col("sub").isNotNull(), F.format_string("Original Position\t%d\t%d", "sub_left", "sub_right"))
    arrows = F.repeat(F.when(F.col("forward"), ">").otherwise("<"), F.lit(10))
    more = F.when(F.size("lines") > 0, F.array_join("lines", "\n"))
    return located.select("rec", "sub", F.concat_ws("\n", number, F.format_string(">%s/%d-%d", "accession", "start", "end"), origin, info, arrows, more, F.array_join("locations", "\n"), F.lit("")).alias("block"))


def location_text(hit: DataFrame) -> Column:
    """One location: what it is of, the record's drawing before and after, and the record."""
    size = F.least(F.lit(10), F.col("r_right") - F.col("r_left") + 1).cast("int")
    own = F.when(F.col("is_gene"), F.concat(F.lit("gene="), "name", F.lit("\tproduct="), F.coalesce("product", F.lit("")))).otherwise(F.concat(F.lit("promoter="), "name"))
    drawn = F.concat_ws("\n", F.concat("location", F.lit(" of "), "name"), F.concat(F.lit("original direction  : "), F.repeat("direction", size)), F.concat(F.lit("intersect direction : "), "drawing"), F.concat(F.col("r_start").cast("string"), F.lit("-"), F.col("r_end").cast("string"), F.lit("\t"), own))
    return F.when(F.col("location") == "inter-genic", F.concat(F.lit("inter-genic of "), F.replace("name", F.lit(","), F.lit(", ")))).otherwise(drawn)


def flank_blocks(flanks: DataFrame) -> DataFrame:
    """``idx, seg_id, block`` of a gene's places: position, product, GeneID, stream and flanks; empty flanks are left out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    part = lambda kind: F.when(F.length(kind) > 0, F.concat(F.lit(f"{kind}\t"), kind))
    arrow = F.when(F.col("minus"), "<-").otherwise("->")
    first = F.when(F.col("nth") == 1, F.format_string("%d. %s", "idx", "gene"))
    return flanks.select("idx", "nth", F.concat_ws("\n", first, F.format_string("%d)", "nth"), F.format_string("position\t%d %s %d", "seg_left", arrow, "seg_right"), F.concat(F.lit("product\t"), text("product")), F.concat(F.lit("GeneID\t"), text("gene_id")), F.concat(F.lit("stream\t"), "stream"), part("upstream"), part("downstream"), F.lit("")).alias("block"))


def between_blocks(near: DataFrame) -> DataFrame:
    """``idx, block`` of ranges with the genes before and after them; a side without a gene is left out."""

    def side(kind: str) -> Column:
        g = F.col(kind)
        return F.when(g.isNotNull(), F.concat_ws("\n", F.concat(F.lit(f"{kind}-gene\t"), F.coalesce(g["gene"], F.lit("None"))), F.concat(F.lit(f"{kind}-position\t"), g["seg_left"].cast("string"), F.lit("-"), g["seg_right"].cast("string")), F.concat(F.lit(f"{kind}-product\t"), F.coalesce(g["product"], F.lit("None")))))

    return near.select("idx", F.concat_ws("\n", F.format_string("%d,%d:", "left", "right"), side("up"), side("down"), F.lit("")).alias("block"))


def region_lines(regions: DataFrame, by: str = "accession") -> DataFrame:
    """``accession, left, line`` of genes and gaps: numbered names, ranges, and the locus tags of genes."""
    order = Window.partitionBy(by, "kind").orderBy("left", "right")
    nth = F.row_number().over(order)
    name = F.concat(F.when(F.col("kind") == "gene", "gene_").otherwise("region_"), nth.cast("string"))
    tag = F.when(F.col("kind") == "gene", F.coalesce(F.col("locus_tag"), F.lit(""))) if "locus_tag" in regions.columns else F.when(F.col("kind") == "gene", F.coalesce(F.col("gene"), F.lit("")))
    return regions.select(by, "left", "right", F.concat_ws("\t", name, F.concat(F.col("left").cast("string"), F.lit("-"), F.col("right").cast("string")), tag).alias("line"))


#: Columns of the flattened locations, before pairs of interval columns.
LOCATION_COLUMNS = ("index", "name", "weighted_similarity", "textedit_similarity", "direct_similarity", "consistency_similarity", "location", "gene_name", "type", "exonic_gene_sizes", "product", "site", "target_sequence")


def location_table(rows: DataFrame, spans: str, most: int) -> DataFrame:
    """Columns of ``rows`` and ``location start i, location end i`` from an array of (start, end)."""
    pairs = []
    for i in range(most):
        item = F.get(F.col(spans), F.lit(i))
        pairs += [item["start"].alias(f"location start {i + 1}"), item["end"].alias(f"location end {i + 1}")]
    return rows.select(*[c for c in rows.columns if c != spans], *pairs)
