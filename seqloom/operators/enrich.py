"""Columns that enrich gene lists: products by priority, fallbacks, names, record expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of products; the last that is filled counts.
PRODUCT_ORDER = ("enzyme", "rna", "protein", "polypeptide", "function when intact", "transporter")
URL_PRODUCT_ORDER = ("rna", "protein", "polypeptide", "enzyme", "function when intact", "transporter")


def filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def product(attr: Column, order: tuple[str, ...] = PRODUCT_ORDER) -> tuple[Column, Column]:
    """(kind, text) of a product in a map of attributes."""
    pairs = [F.when(filled(attr[k]).isNotNull(), F.struct(F.lit(k).alias("kind"), attr[k].alias("text"))) for k in reversed(order)]
    best = F.coalesce(*pairs)
    return best["kind"], best["text"]


def status_columns(position: Column, promoter: Column, promoter_position: Column) -> list[Column]:
    """status, gene_start_pos, promoter_name, promoter_pos: Found only with a promoter."""
    found = promoter.isNotNull()
    text = lambda c: F.coalesce(c.cast("string"), F.lit("Not Found"))
    return [F.when(found, "Found").otherwise("Not Found").alias("status"), text(position).alias("gene_start_pos"), text(promoter).alias("promoter_name"), text(promoter_position).alias("promoter_pos")]


def split_alias(gene: Column | str) -> tuple[Column, Column]:
    """``a->b`` as (name to look up, name to show); without an arrow both are the name."""
    c = F.col(gene) if isinstance(gene, str) else gene
    parts = F.split(c, "->")
    return F.trim(parts[0]), F.trim(F.coalesce(F.get(parts, F.lit(1)), parts[0]))


def inter_records(records: DataFrame, promoters: bool = False) -> DataFrame:
    """``name, product, start, end, left, right, direction, is_gene``: a gene's interval and, if asked, its promoter's.

    The promoter's goes from its position to the gene's start; blank names have none.  A missing position is -1.
    """
    pos = lambda c: F.coalesce(F.col(c).cast("string").try_cast("bigint"), F.lit(-1))
    entry = lambda name, prod, a, b, gene: F.struct(name.alias("name"), prod.alias("product"), a.alias("start"), b.alias("end"), F.lit(gene).alias("is_gene"))
    gene = entry(F.col("gene"), F.col("product"), pos("map_start_pos"), pos("map_end_pos"), True)
    rows = F.array(gene)
    if promoters:
        own = entry(F.col("promoter_name"), F.lit(""), pos("promoter_pos"), pos("gene_start_pos"), False)
        rows = F.array_compact(F.array(gene, F.when(filled(F.col("promoter_name")).isNotNull(), own)))
    r = records.select(F.explode(rows).alias("r")).select("r.*")
    return r.select("name", "product", "start", "end", F.least("start", "end").alias("left"), F.greatest("start", "end").alias("right"), F.when(F.col("start") < F.col("end"), ">").otherwise("<").alias("direction"), "is_gene")


def pivot_spans(rows: DataFrame, key: str, spans: str, most: int) -> DataFrame:
    """``key`` and ``start_1, end_1, ..`` from an array of (start, end); spans beyond ``most`` are an error of the caller."""
    parts = []
    for i in range(most):
        item = F.get(F.col(spans), F.lit(i))
        parts += [item["start"].alias(f"start_{i + 1}"), item["end"].alias(f"end_{i + 1}")]
    return rows.select(key, *parts)


def sense_label(location: Column, gene_direction: Column, match_direction: Column) -> Column:
    """``antisense`` where the directions are equal, else ``sense``; with utr after 5' and 3'."""
    side = F.when(gene_direction == match_direction, "antisense").otherwise("sense")
    part = F.when(location.isin("5'", "3'"), F.concat(location, F.lit("utr"))).otherwise(location)
    return F.when(location == "inter-genic", "inter genic").otherwise(F.concat_ws(" ", side, part))


def sub_location_passes(location: Column, start: Column, end: Column, gene_start: Column, gene_direction: Column, upstream: int = 45, downstream: int = 25) -> Column:
    """A sub-match at a 5' end must lie from ``upstream`` before to ``downstream`` after the gene's start; others pass."""
    low, high = F.least(start, end), F.greatest(start, end)
    plus = gene_direction == ">"
    a = F.when(plus, gene_start - upstream).otherwise(gene_start - downstream)
    b = F.when(plus, gene_start + downstream).otherwise(gene_start + upstream)
    return F.when(location.startswith("5'"), (low >= a) & (high <= b)).otherwise(True)


def file_stem(name: Column | str) -> Column:
    """Result name of an input: white space to ``_``, other odd characters and suffixes gone, trailing words stripped."""
    c = F.col(name) if isinstance(name, str) else name
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", "_"), r"[^a-zA-Z0-9_.]", "")
    return F.regexp_replace(F.regexp_replace(c, r"\.txt|\..tsv|\..csv", ""), "(result|_|all)+$", "")


def mean_preserving_triples(values: DataFrame, column: str, seed: int = 7, spread: float = 0.025) -> DataFrame:
    """``x, a, b, c``: two draws from [1 - spread, 1 + spread) times x, and the third that makes the sum 3x."""
    x = F.col(column)
    draw = lambda s: x * (F.lit(1 - spread) + F.rand(s) * (2 * spread))
    two = values.select("*", draw(seed).alias("a"), draw(seed + 1).alias("b"))
    return two.withColumn("c", x * 3 - F.col("a") - F.col("b"))


def name_keyword_matrix(names: DataFrame, keywords: list[str], counts: DataFrame) -> DataFrame:
    """``name`` and a column for each keyword: hits from ``counts(name, keyword, hits)``, 0 where there are none."""
    cells = counts.groupBy("name").pivot("keyword", keywords).agg(F.sum("hits"))
    out = names.join(cells, "name", "left")
    return out.select("name", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k) for k in keywords])
