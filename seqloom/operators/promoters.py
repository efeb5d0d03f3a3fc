"""Transcription-unit layouts: item attributes and the promoter of a target gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attributes(body: Column | str) -> Column:
    """``<b>k</b>: v<BR>..`` as a map; without any pair, ``{Body: the text}``; of a repeated key the last counts."""
    text = _c(body)
    lines = F.split(F.regexp_replace(text, "</?b>", ""), "<BR>|<br>")
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))

    def as_map(p: Column) -> Column:
        keys = F.transform(p, lambda x: x["key"])
        # Later pairs replace earlier ones of the same key; most texts repeat none.
        last = F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["key"] == x["key"]))
        return F.when(F.size(p) > 0, F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(p), p).otherwise(last))).otherwise(F.create_map(F.lit("Body"), text))

    # transform(array(x), ...)[0] names x once, where what uses it would compute it each time.
    return F.transform(F.array(pairs), as_map)[0]


def number(text: Column | str) -> Column:
    """``1,234`` as a number; null where it isn't one."""
    return F.regexp_replace(_c(text), ",", "").try_cast("bigint")


def is_gene(attr: Column | str, name: str | None = None) -> Column:
    a = _c(attr)
    if name is None:
        return F.map_contains_key(a, "Gene")
    return F.coalesce(F.array_contains(F.split(a["Gene"], r"\s+"), name), F.lit(False))


def is_promoter(attr: Column | str, with_start: bool = False) -> Column:
    a = _c(attr)
    found = F.map_contains_key(a, "Promoter")
    return found & F.map_contains_key(a, "Tr.Start site") if with_start else found


def start_site(attr: Column | str) -> Column:
    return number(_c(attr)["Tr.Start site"])


def gene_direction(attr: Column | str) -> Column:
    """Left for ``a <- b``, Right for ``a -> b``; null for other locations."""
    where = _c(attr)["Location"]
    return F.when(F.instr(where, "<-") > 1, "Left").when(F.instr(where, "->") > 1, "Right")


def gene_start(attr: Column | str) -> Column:
    parts = F.split(_c(attr)["Location"], r"\s+")
    return number(F.when(F.get(parts, F.lit(1)) == "<-", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0))))


def best_promoter(items: DataFrame, by: str = "diagram") -> DataFrame:
    """``by, promoter, near_gene_pos`` for the target gene of each diagram.

    ``items``: ``by, idx, left, right, top, is_gene, is_promoter`` (with start site), ``direction`` (of genes), ``pos``
    (gene start), ``name``, ``is_target``, and maybe ``start_site`` (of promoters; it comes as ``promoter_site``).  In the direction of transcription, a promoter that is the first or
    that directly follows a gene starts a unit; the target's unit gives its promoter and the start of its
    first gene.  Genes of the other direction, and promoters drawn below the target, don't count.  A target
    before all promoters has a null promoter; diagrams without a target have no row.
    """
    unit = target_units(items, by)
    site = ["promoter_site"] if "start_site" in items.columns else []
    return unit.where("unit is not null").select(by, *[F.col(f"unit.{c}") for c in ("promoter", "near_gene_pos", *site)])


def target_units(items: DataFrame, by: str = "diagram") -> DataFrame:
    """``by, unit`` for every diagram: promoter and near_gene_pos as in ``best_promoter``, or null.

    Items are dealt out by diagram once; all that follows is sweeps within a diagram.  Of several targets the last counts.
    """
    given = F.max(F.when(F.col("is_target"), F.struct("idx", "direction", "top"))).over(Window.partitionBy(by))
    near = items.withColumn("target", given).select("*", F.col("target.direction").alias("toward"), F.col("target.top").alias("target_top"), F.col("target.idx").alias("target_idx"))
    wanted = (F.col("is_gene") & (F.col("direction") == F.col("toward"))) | (~F.col("is_gene") & F.col("is_promoter") & (F.col("top") <= F.col("target_top")))
    counted = near.withColumn("counted", F.coalesce(wanted & F.col(by).isNotNull() & F.col("target").isNotNull(), F.lit(False)))
    rightward = F.col("toward") == "Right"
    edge = F.when(rightward, F.col("left")).otherwise(-F.col("right"))
    late = F.when(F.col("is_gene") == rightward, 1).otherwise(0)
    # The order is columns, so that all sweeps share one sort.
    counted = counted.select("*", edge.alias("edge_"), late.alias("late_"), F.when(rightward, F.col("idx")).otherwise(-F.col("idx")).alias("turn_"))
    scan = Window.partitionBy(by, "counted").orderBy("edge_", "late_", "turn_")
    kind = F.when(F.col("is_gene"), "gene").otherwise("promoter")
    rows = counted.withColumn("kind", kind).withColumn("n", F.row_number().over(scan)).withColumn("before", F.lag("kind").over(scan))
    upto = scan.rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("kind") == "promoter", F.col("n"))).over(upto)
    opens = (F.col("kind") == "promoter") & ((F.col("before") == "gene") | (F.col("n") == first))
    units = rows.withColumn("opens", opens.cast("int")).withColumn("unit", F.sum("opens").over(upto))
    is_target = F.col("idx") == F.col("target_idx")
    site = ["start_site"] if "start_site" in items.columns else []
    per_unit = units.groupBy(by, "counted", "unit").agg(
        F.max(is_target & F.col("is_gene")).alias("has_target"),
        F.min(F.when(F.col("opens") == 1, F.struct("n", "name", *site))).alias("opener"),
        F.min(F.when(F.col("kind") == "gene", F.struct("n", "pos")))["pos"].alias("near_gene_pos"),
    )
    unit = F.struct(F.col("opener.name").alias("promoter"), "near_gene_pos", *[F.col("opener.start_site").alias("promoter_site") for _ in site])
    return per_unit.groupBy(by).agg(F.max(F.when(F.col("counted") & F.col("has_target"), unit)).alias("unit"))


def better_promoter(a: Column, b: Column, direction: Column | str) -> Column:
    """Of two start sites, the larger for Left, the smaller for Right."""
    return F.when(_c(direction) == "Left", F.greatest(a, b)).otherwise(F.least(a, b))


def valid_range(items: DataFrame, by: str = "diagram") -> DataFrame:
    """``by, direction, above, below``: free room before the target up to the nearest gene of its direction."""
    target = items.where("is_target").select(by, F.col("direction").alias("toward"), F.col("left").alias("t_left"), F.col("right").alias("t_right"))
    genes = items.where("is_gene").join(target, by).where("direction = toward")
    out = genes.groupBy(by, "toward", "t_left", "t_right").agg(F.min(F.when(F.col("left") > F.col("t_right"), F.col("left"))).alias("next_left"), F.max(F.when(F.col("right") < F.col("t_left"), F.col("right"))).alias("next_right"))
    leftward = F.col("toward") == "Left"
    return out.select(by, F.col("toward").alias("direction"), F.when(leftward, F.col("t_right")).otherwise(F.col("next_right")).alias("above"), F.when(leftward, F.col("next_left")).otherwise(F.col("t_left")).alias("below"))
