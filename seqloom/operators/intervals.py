"""Closed, 1-based intervals: classes of overlap, joins, neighbours, gaps, extraction.

Joins of ranges go through bins of several widths: each interval is put into two bins at most of a level and
matched by equality, so no join compares all pairs.  Lookups by rank and of neighbours are sweeps within cells of
SWEEP positions; what a cell hands on to the next ones is summed up over a row for each cell, so
an accession, however long, is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import dna as D

#: Bases of a bin; levels of bins, and how many times as wide the bins of the next level are.
BIN, LEVELS, WIDER = 10_000, 8, 8
#: Positions, or ranks in file order, of one sweep.
SWEEP = 1 << 20
#: Bases in a part of a genome that ranges are cut from.
PART = 1 << 16

#: The classes in the order in which they are tried.
CLASSES = ("TotallyLeft", "IntersectLeft", "CoverLeft", "Inner", "CoverRight", "IntersectRight", "TotallyRight")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify(record_left: Column | str, record_right: Column | str, left: Column | str, right: Column | str) -> Column:
    """How a range lies to a record; the first class that applies."""
    a, b, x, y = map(_c, (record_left, record_right, left, right))
    return (
        F.when(y < a, "TotallyLeft")
        .when((x < a) & (y < b), "IntersectLeft")
        .when((x < a) & (y >= b), "CoverLeft")
        .when((x >= a) & (y <= b), "Inner")
        .when((x <= a) & (y > b), "CoverRight")
        .when((x <= b) & (y > b), "IntersectRight")
        .otherwise("TotallyRight")
    )


def location_label(klass: Column | str, direction: Column | str) -> Column:
    """5', 3', cds or inter-genic, from a class and the record's direction (``>`` or ``<``).

    A range that reaches over an edge is at that end of the record, also if it covers it wholly: beyond both
    edges the left one decides.
    """
    k, plus = _c(klass), _c(direction) == ">"
    return (
        F.when(k.isin("IntersectLeft", "CoverLeft"), F.when(plus, "5'").otherwise("3'"))
        .when(k.isin("IntersectRight", "CoverRight"), F.when(plus, "3'").otherwise("5'"))
        .when(k == "Inner", "cds")
        .otherwise("inter-genic")
    )


def coverage(left1: Column | str, right1: Column | str, left2: Column | str, right2: Column | str) -> Column:
    a, b, x, y = map(_c, (left1, right1, left2, right2))
    return F.greatest(F.lit(0), F.least(b, y) - F.greatest(a, x) + 1).cast("long")


def coverage_drawing(left: Column, right: Column, record_left: Column, record_right: Column, direction: Column) -> Column:
    """The record in ten parts (one a base if it is shorter; the last takes the rest): ``*`` where over half is covered."""
    size = record_right - record_left + 1
    step = F.greatest(F.lit(1), F.floor(size / 10)).cast("long")
    parts = F.least(F.lit(10), size).cast("int")

    def draw(i: Column) -> Column:
        a = record_left + i * step
        b = F.when(i == parts - 1, record_right).otherwise(a + step - 1)
        return F.when(coverage(a, b, left, right) * 2 > step, "*").otherwise(direction)

    return F.array_join(F.transform(F.sequence(F.lit(0), parts - 1), draw), "")


def _width(level: Column, size: int) -> Column:
    return F.element_at(F.array(*[F.lit(size * WIDER**k) for k in range(LEVELS)]), level + 1)


def _level(left: Column, right: Column, size: int) -> Column:
    """The least level whose bins are no shorter than a range, which then touches two of them at most."""
    length, level = right - left + 1, F.lit(0)
    for k in range(LEVELS - 1):
        level = level + (length > size * WIDER**k).cast("int")
    return level


def binned(rows: DataFrame, other: DataFrame, edges: tuple[str, str], other_edges: tuple[str, str], size: int = BIN, points: bool = False) -> DataFrame:
    """``rows`` with ``own_level``, once for each ``level`` and ``bin`` where it may meet a row of ``other``.

    These are the bins of a row's own level, and those of each higher level that ``other`` has: two a level at most
    (above the last level, a range touches more).  The levels of ``other``, LEVELS numbers at most, are a subquery;
    of a stream all count, and of ``points`` (if ``other`` has only ranges of one base) the first.
    """
    left, right = map(F.col, edges)
    there = F.array(*map(F.lit, range(LEVELS)))
    if points:
        there = F.array(F.lit(0))
    elif not other.isStreaming:
        there = F.coalesce(other.agg(F.collect_set(_level(*map(F.col, other_edges), size))).scalar(), F.array().cast("array<int>"))
    leveled = rows.withColumn("own_level", _level(left, right, size))
    leveled = leveled.withColumn("level", F.explode(F.array_union(F.array("own_level"), F.array_intersect(F.sequence("own_level", F.lit(LEVELS - 1)), there))))
    width = _width(F.col("level"), size)
    return leveled.withColumn("bin", F.explode(F.sequence(F.floor(left / width).cast("long"), F.floor(right / width).cast("long"))))


def overlap_join(queries: DataFrame, segments: DataFrame, on: tuple[str, ...] = (), bin_size: int = BIN, points: bool = False) -> DataFrame:
    """Pairs of ``queries(left, right, ..)`` and ``segments(seg_left, seg_right, ..)`` that overlap.

    ``on`` names columns that must be equal too; with ``points`` all queries have one base.  Bins have levels, each WIDER times as wide as the one before; a pair
    meets at the level of its longer range, so a range as long as its chromosome is in two bins, not in all.  A pair
    comes from the first bin that both touch there, so it comes once and no distinct is needed.
    """
    edges, seg_edges = ("left", "right"), ("seg_left", "seg_right")
    q, s = binned(queries, segments, edges, seg_edges, bin_size), binned(segments, queries, seg_edges, edges, bin_size, points)
    same = (F.col("q.level") == F.col("s.level")) & (F.col("q.bin") == F.col("s.bin")) & (F.col("q.left") <= F.col("s.seg_right")) & (F.col("s.seg_left") <= F.col("q.right"))
    same &= F.col("q.level") == F.greatest("q.own_level", "s.own_level")
    same &= F.col("q.bin") == F.floor(F.greatest("q.left", "s.seg_left") / _width(F.col("q.level"), bin_size))
    for c in on:
        same &= F.col(f"q.{c}") == F.col(f"s.{c}")
    keep = [F.col(f"q.{c}") for c in queries.columns] + [F.col(f"s.{c}") for c in segments.columns if c not in on]
    return q.alias("q").join(s.alias("s"), same).select(*keep)


def _carried(rows: DataFrame, by: tuple[str, ...], total: Column, combine: Callable[[Column], Column], falling: bool = False) -> DataFrame:
    """``rows`` with ``carry``: ``combine`` of the totals of all cells (column ``cell``) before a row's own, in its group."""
    cells = rows.groupBy(*by, "cell").agg(total.alias("total"))
    before = Window.partitionBy(*by).orderBy(F.col("cell").desc() if falling else F.col("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "cell", combine(F.col("total")).over(before).alias("carry"))
    on = F.col("r.cell") == F.col("c.cell")
    for c in by:
        on &= F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    return rows.alias("r").join(cells.alias("c"), on).select("r.*", "c.carry")


def _cell(at: Column | str) -> Column:
    return F.floor(_c(at) / SWEEP).cast("long")


def lower_bound(positions: DataFrame, starts: DataFrame, by: tuple[str, ...] = (), position: str = "pos", start: str = "start") -> DataFrame:
    """``positions`` with ``rank``: how many starts are below, that is the 0-based rank of the first at or after."""
    cols = positions.columns
    marks = positions.select(*by, F.col(position).alias("at"), F.lit(0).alias("kind"), F.struct(*cols).alias("row"))
    marks = marks.unionByName(starts.select(*by, F.col(start).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["row"].dataType).alias("row")))
    # At one place the positions (0) come before the starts (1), so equal starts aren't below.
    marks = marks.withColumn("cell", _cell("at"))
    before = Window.partitionBy(*by, "cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranked_ = _carried(marks.withColumn("within", F.sum("kind").over(before)), by, F.sum("kind"), F.sum)
    return ranked_.where("kind = 0").select("row.*", (F.col("within") + F.coalesce("carry", F.lit(0))).cast("long").alias("rank"))


def ranked(segments: DataFrame, by: tuple[str, ...] = (), start: str = "seg_left") -> DataFrame:
    """``segments`` with ``seg_rank``, their 0-based place by ``start``, of equal ones by ``seg_id``."""
    rows = segments.withColumn("cell", _cell(start))
    within = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(start, "seg_id"))
    placed = _carried(rows.withColumn("within", within), by, F.count("*"), F.sum)
    return placed.select(*segments.columns, (F.col("within") - 1 + F.coalesce("carry", F.lit(0))).cast("long").alias("seg_rank"))


def range_type(left: Column | str, right: Column | str, seg_left: Column | str, seg_right: Column | str, compat: bool = False) -> Column:
    """hit, include, homology or related.

    ``compat`` takes an overlap that counts from the far edge of the containing side, with which
    include can't be reached.
    """
    x, y, a, b = map(_c, (left, right, seg_left, seg_right))
    size = y - x + 1
    hit, inside = (x == a) & (y == b), (a <= x) & (y <= b)
    if compat:
        over = F.when((y < a) | (x > b), 0).when(y < b, y - a + 1).otherwise(b - x + 1)
        return F.when(hit, "hit").when(over * 100.0 / size >= 90.0, "homology").when(inside, "include").otherwise("related")
    return F.when(hit, "hit").when(inside, "include").when(coverage(x, y, a, b) * 100.0 / size >= 90.0, "homology").otherwise("related")


def nearby_genes(queries: DataFrame, segments: DataFrame, by: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """Segments a range belongs to, by rank of their left edges.

    With a the first rank at or after the range's left and b the last before its right: the one
    segment if a = b; else, of the ranks between (b and a where the range lies between two), the
    first that covers the whole range, or all of them.  Ranks out of range are left out.  Equal rows
    of ``queries`` are rows of their own.
    """
    starts = segments.select(*by, F.col("seg_left").alias("start"))
    cols = queries.columns
    q = lower_bound(queries.withColumn("query_row", F.monotonically_increasing_id()), starts, by, "left").withColumnRenamed("rank", "a")
    q = lower_bound(q, starts, by, "right").withColumn("b", F.col("rank") - 1).drop("rank")
    wanted = F.explode(F.sequence(F.least("a", "b"), F.greatest("a", "b")))
    q = q.select("*", wanted.alias("seg_rank"))
    found = q.join(ranked(segments, by), [*by, "seg_rank"])
    covers = (F.col("seg_left") <= F.col("left")) & (F.col("seg_right") >= F.col("right")) & (F.col("a") != F.col("b"))
    first = F.min(F.when(covers, F.col("seg_rank"))).over(Window.partitionBy("query_row"))
    kept = found.withColumn("cover", first).where(F.col("cover").isNull() | (F.col("seg_rank") == F.col("cover")))
    own = [c for c in segments.columns if c not in by]
    return kept.select(*cols, *own, "seg_rank", range_type("left", "right", "seg_left", "seg_right", compat).alias("type"), "query_row")


def rank_neighbourhood(queries: DataFrame, segments: DataFrame, reach: int = 2, by: tuple[str, ...] = (), position: str = "start") -> DataFrame:
    """Each query with the segments of ranks idx - reach to idx + reach, idx being the clamped lower bound of its start.

    Segments are ranked by ``seg_start``.
    """
    last = segments.groupBy(*by).agg((F.count("*") - 1).alias("last"))
    q = lower_bound(queries, segments.select(*by, F.col("seg_start").alias("start")), by, position)
    q = q.join(last, list(by)) if by else q.withColumn("last", last.scalar())
    q = q.withColumn("idx", F.least("rank", "last")).drop("rank", "last")
    wide = q.select("*", F.explode(F.sequence(F.col("idx") - reach, F.col("idx") + reach)).alias("seg_rank"))
    return wide.join(ranked(segments, by, "seg_start"), [*by, "seg_rank"]).drop("idx")


def nearest(queries: DataFrame, segments: DataFrame, by: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Queries with ``up`` (greatest right edge before the range) and ``down`` (least left edge after), as structs.

    ``strict``: edges that touch the range don't count.  Segments may nest; of equal edges the least
    seg_id is taken.  One sweep for each side carries the best edge so far, from cell to cell.
    """
    cols = queries.columns
    seg = F.struct(*[F.col(c) for c in segments.columns])
    none = F.lit(None).cast(segments.select(seg.alias("s")).schema["s"].dataType)
    first, second = (0, 1) if strict else (1, 0)

    def sweep(rows: DataFrame, at: str, edge: str, out: str, ascending: bool) -> DataFrame:
        names = rows.columns
        marks = rows.select(*by, F.col(at).alias("at"), F.lit(first).alias("kind"), F.struct(*names).alias("row"), none.alias("seg"), F.lit(0).cast("long").alias("seg_order"))
        marks = marks.unionByName(segments.select(*by, F.col(edge).alias("at"), F.lit(second).alias("kind"), F.lit(None).cast(marks.schema["row"].dataType).alias("row"), seg.alias("seg"), (-F.col("seg_id")).cast("long").alias("seg_order")))
        marks = marks.withColumn("cell", _cell("at"))
        order = F.col("at").asc() if ascending else F.col("at").desc()
        before = Window.partitionBy(*by, "cell").orderBy(order, "kind", "seg_order").rowsBetween(Window.unboundedPreceding, 0)
        marks = marks.withColumn("within", F.last("seg", ignorenulls=True).over(before))
        last = F.max_by("seg", F.when(F.col("seg").isNotNull(), F.struct(F.col("at") if ascending else -F.col("at"), "seg_order")))
        carried = _carried(marks, by, last, lambda c: F.last(c, ignorenulls=True), not ascending)
        return carried.where("row is not null").select("row.*", F.coalesce("within", "carry").alias(out))

    found = sweep(queries, "left", "seg_right", "up", True)
    found = sweep(found, "right", "seg_left", "down", False)
    return found.select(*cols, "up", "down")


def next_on_strand(queries: DataFrame, key: str) -> DataFrame:
    """``key, next_gene, next_left, next_right`` from rows ``key, left, right, strand, seg_left, seg_right, gene, seg_id`` of a range's segments.

    ``+``: the segment that starts first beyond the range; ``-``: the one that ends last before it.
    """
    high, low = F.greatest("left", "right"), F.least("left", "right")
    segment = F.struct("gene", "seg_left", "seg_right").alias("segment")
    after = F.when((F.col("strand") == "+") & (F.col("seg_left") > high), F.struct(F.col("seg_left").alias("at"), F.col("seg_id").alias("nth"), segment))
    before = F.when((F.col("strand") == "-") & (F.col("seg_right") < low), F.struct(F.col("seg_right").alias("at"), (-F.col("seg_id")).alias("nth"), segment))
    out = queries.groupBy(key).agg(F.coalesce(F.min(after)["segment"], F.max(before)["segment"]).alias("next"))
    return out.select(key, F.col("next.gene").alias("next_gene"), F.col("next.seg_left").alias("next_left"), F.col("next.seg_right").alias("next_right"))


def gaps(segments: DataFrame, lengths: DataFrame, by: str = "accession", compat: bool = False) -> DataFrame:
    """Segments and the regions between them, with a tail up to the genome's length.

    Rows ``accession, kind, left, right, gene`` with ``gene`` null for gaps.  A gap lies after the furthest right edge
    so far; ``compat``: after the right edge of the segment just before, in file order (``seg_id``).
    """
    rows = segments.withColumn("cell", _cell("seg_id"))
    order = Window.partitionBy(by, "cell").orderBy("seg_id")
    within = F.lag("seg_right").over(order) if compat else F.max("seg_right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    total, combine = (F.max_by("seg_right", "seg_id"), lambda c: F.last(c)) if compat else (F.max("seg_right"), F.max)
    carried = _carried(rows.withColumn("within", within), (by,), total, combine)
    reached = F.coalesce("within", "carry") if compat else F.greatest("within", "carry")
    with_gap = carried.withColumn("from", F.coalesce(reached, F.lit(0)) + 1)
    inner = with_gap.where(F.col("from") <= F.col("seg_left") - 1).select(by, F.lit("gap").alias("kind"), F.col("from").alias("left"), (F.col("seg_left") - 1).alias("right"), F.lit(None).cast("string").alias("gene"))
    last = segments.groupBy(by).agg(F.max_by("seg_right", "seg_id").alias("last") if compat else F.max("seg_right").alias("last"))
    tail = lengths.join(last, by, "left").withColumn("left", F.coalesce("last", F.lit(0)) + 1).where("left <= length").select(by, F.lit("gap").alias("kind"), "left", F.col("length").alias("right"), F.lit(None).cast("string").alias("gene"))
    genes = segments.select(by, F.lit("gene").alias("kind"), F.col("seg_left").alias("left"), F.col("seg_right").alias("right"), "gene")
    return genes.unionByName(inner).unionByName(tail)


def _parts(genomes: DataFrame) -> DataFrame:
    """``part_of, part, bases``: ``genomes(accession, dna)`` in parts of PART letters, cut one by one.

    Letters of one byte are cut as bytes, where a slice doesn't count letters from the start; of a genome with others all parts are held at once.
    """
    whole = F.regexp_extract_all("dna", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    held = genomes.select(F.col("accession").alias("part_of"), F.col("dna").cast("binary").alias("data"), F.when(F.octet_length("dna") != F.length("dna"), whole).alias("cut"))
    last = F.when(F.col("cut").isNotNull(), F.size("cut") - 1).otherwise(F.ceil(F.octet_length("data") / PART) - 1).cast("long")
    each = held.select("part_of", "data", "cut", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))).alias("part"))
    piece = F.substring("data", (F.col("part") * PART + 1).cast("int"), F.lit(PART)).cast("string")
    return each.select("part_of", "part", F.coalesce(F.get("cut", F.col("part").cast("int")), piece).alias("bases"))


def with_sequence(rows: DataFrame, genomes: DataFrame, left: Column | str, right: Column | str, minus: Column | None = None, out: str = "sequence", known_only: bool = True) -> DataFrame:
    """``rows`` (with ``accession``) and the bases ``left`` to ``right`` of their genome ``genomes(accession, dna)``.

    Genomes are cut into parts of PART bases and rows go to the parts they touch, so a chromosome doesn't meet
    each row, nor the driver.  Ranges are clipped to the genome; where ``minus`` holds, the reverse complement is given.  Rows
    whose genome isn't there are left out, or have an empty sequence.
    """
    base = rows.join(genomes.select("accession").distinct(), "accession", "left_semi") if known_only else rows
    cols, a, b = rows.columns, F.greatest(_c(left), F.lit(1)).cast("long"), _c(right).cast("long")
    turned = F.coalesce(minus, F.lit(False)) if minus is not None else F.lit(False)
    r = base.select(F.monotonically_increasing_id().alias("row_number"), F.struct(*[F.col(f"`{c}`") for c in cols], turned.alias("turned")).alias("row"), F.col("accession").alias("part_of"), a.alias("a"), b.alias("b"))
    r = r.select("*", F.explode_outer(F.when(F.col("b") >= F.col("a"), F.sequence(F.floor((F.col("a") - 1) / PART), F.floor((F.col("b") - 1) / PART)))).alias("part"))
    # A few rows may become whole genomes, and a plan that goes by those rows would send all parts by way of the driver: both sides are dealt out.
    parts = _parts(genomes).hint("merge")
    start = F.greatest(F.col("a") - F.col("part") * PART, F.lit(1))
    stop = F.least(F.col("b") - F.col("part") * PART, F.lit(PART))
    piece = F.substring("bases", start.cast("int"), (stop - start + 1).cast("int"))
    joined = r.join(parts, ["part_of", "part"], "left").select("row_number", "row", F.when(F.col("bases").isNotNull(), F.struct("part", piece.alias("bases"))).alias("piece"))
    whole = joined.groupBy("row_number").agg(F.first("row").alias("row"), F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["bases"]), "").alias("bases"))
    bases = F.when(F.col("row.turned"), D.reverse_complement("bases")).otherwise(F.col("bases"))
    return whole.select(*[F.col(f"row.`{c}`") for c in cols if c != out], bases.alias(out))


def extract_range(dna: Column | str, a: Column | str, b: Column | str) -> Column:
    """Bases between a promoter at ``a`` and a gene start at ``b``, the gene start left out.

    a < b: bases a to b - 1; else the reverse complement of b + 1 to a; equal: empty.
    """
    x, y = _c(a), _c(b)
    return F.when(x < y, D.subsequence(dna, x, y - 1)).otherwise(D.reverse_complement(D.subsequence(dna, y + 1, x)))


def flanks(dna: Column | str, left: Column | str, right: Column | str, strand: Column | str, limit: int = 200) -> tuple[Column, Column]:
    """(upstream, downstream) of ``limit`` bases, clipped at the genome's ends; on ``-`` turned round and swapped."""
    a, b, minus = _c(left), _c(right), _c(strand) == "-"
    before, after = D.subsequence(dna, a - limit, a - 1), D.subsequence(dna, b + 1, b + limit)
    return F.when(minus, D.reverse_complement(after)).otherwise(before), F.when(minus, D.reverse_complement(before)).otherwise(after)


def utr_between(dna: Column | str, left_end: Column | str, right_start: Column | str) -> Column:
    """Bases strictly between two segments."""
    return D.subsequence(dna, _c(left_end) + 1, _c(right_start) - 1)


def parse_locus(locus: Column | str) -> Column:
    """``chr:left-right(strand)`` as a struct; null where it isn't one."""
    c, p = _c(locus), r"^([^:]+):(\d+)-(\d+)\(([+-])\)$"
    part = lambda i: F.regexp_extract(c, p, i)
    return F.when(c.rlike(p), F.struct(part(1).alias("chrom"), part(2).cast("long").alias("left"), part(3).cast("long").alias("right"), part(4).alias("strand")))
