"""Exact clusters, counts with shares, name joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Places of the input in a cell, and members from which on a cluster has a further block.
BLOCK = 1 << 16


def exact_clusters(rows: DataFrame, key: Column, index: str = "idx", member: str = "member", separator: str = ",") -> DataFrame:
    """``first, size, members``: rows of equal key; members joined in input order, clusters ordered by ``first``.

    A cluster is one row, so this is for clusters whose members fit in one; ``cluster_blocks`` is for any.
    """
    sorted_members = F.transform(F.sort_array(F.collect_list(F.struct(index, F.col(member).cast("string").alias("m")))), lambda x: x["m"])
    return rows.groupBy(key.alias("cluster_key")).agg(F.min(index).alias("first"), F.count("*").alias("size"), F.array_join(sorted_members, separator).alias("members"))


def cluster_blocks(rows: DataFrame, key: Column, index: str = "idx", member: str = "member", separator: str = ",", block: int = BLOCK) -> DataFrame:
    """``cluster_key, first, size, block, n, members``: clusters of any size, their members joined in blocks.

    Blocks count from 0 and hold members in input order.  A cluster's members are gathered by cells of ``block`` places of
    ``index`` (a whole number that tells rows apart), and cells that follow each other go into one block until it has ``block``
    members, so no row has ``2 * block`` or more, also if half of all rows are one cluster.  What is ranked is a row
    for each cluster and cell.  A null key is a key, a null member is left out of ``members`` but counts.
    """
    cell = F.expr(f"`{index}` div {block}")
    placed = rows.select(key.alias("cluster_key"), cell.alias("cell"), F.col(index).alias("at"), F.col(member).cast("string").alias("m"))
    by = ["cluster_key", "cell"]
    counted = placed.groupBy(*by).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    inside = Window.partitionBy("cluster_key")
    before = F.coalesce(F.sum("n").over(inside.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = counted.select("cluster_key", "cell", F.min("first").over(whole).alias("first"), F.sum("n").over(whole).alias("size"), F.floor(before / block).alias("block"))
    listed = placed.groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at", "m"))).alias("part"))
    same = F.col("c.cluster_key").eqNullSafe(F.col("p.cluster_key")) & F.col("c.cell").eqNullSafe(F.col("p.cell"))
    parts = listed.alias("p").join(cells.alias("c"), same).select("c.cluster_key", "first", "size", "block", "p.cell", "p.n", "part")
    joined = F.array_join(F.transform(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("cell", "part"))), lambda x: x["part"])), lambda x: x["m"]), separator)
    return parts.groupBy("cluster_key", "block").agg(F.min("first").alias("first"), F.min("size").alias("size"), F.sum("n").alias("n"), joined.alias("members")).select("cluster_key", "first", "size", "block", "n", "members")


def representatives(rows: DataFrame, key: Column, index: str = "idx") -> DataFrame:
    """The first row of each cluster."""
    cols = rows.columns
    return rows.groupBy(key.alias("cluster_key")).agg(F.min_by(F.struct(*cols), index).alias("row")).select("row.*")


def first_words(text: Column | str, n: int = 1) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def distribution(rows: DataFrame, value: Column, index: str = "idx") -> DataFrame:
    """``value, n, percent, first``: counts of non-null values; percents are of all rows, those without a value too."""
    counted = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    total = rows.agg(F.count("*").alias("total")).scalar()
    return counted.where("value is not null").select("value", "n", (F.col("n") * 100.0 / total).alias("percent"), "first")


def missing(names: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return names.join(known, on, "left_anti")


def only(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    return rows.join(wanted.select(on).distinct(), on, "left_semi")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a later entry of a name replaces an earlier one."""
    cols = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("row")).select("row.*")


def reorder(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``pos, idx, lines`` of ``blocks(idx, lines)`` in the order of ``wanted(pos, idx)``; keys are ``n`` or ``(n)``.

    Wanted keys without a block are left out; ``missing`` on ``key`` reports them.
    """
    bare = lambda c: F.regexp_replace(F.trim(c), r"^\(|\)$", "")
    left = wanted.select("pos", bare(F.col("idx")).alias("key"))
    return left.join(blocks.select(bare(F.col("idx")).alias("key"), "lines"), "key").select("pos", F.concat(F.lit("("), F.col("key"), F.lit(")")).alias("idx"), "lines")
