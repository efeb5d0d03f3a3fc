"""Registered queries of the sequence and interval operators, each with DuckDB SQL.

Every query runs over whole tables.  ``QUERIES`` and ``ORACLES`` share their keys but for
those that SQL can't express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import dna as D
from seqloom.functions import kernels as K
from seqloom.functions import similarity as S
from seqloom.functions import text as N
from seqloom.operators import cluster as C
from seqloom.operators import enrich as E
from seqloom.operators import intervals as I
from seqloom.operators import promoters as P
from seqloom.operators import search as Q
from seqloom.operators import seeds as G
from seqloom.plans import standins as T
from seqloom.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from seqloom.sources import text as X
from seqloom.sources.pages import link_rows
from seqloom.sources.scratch import new_path

PROBE = "gatacatt"  # with c
PLAIN = "gattagat"  # without c


# SQL of windows and scores -------------------------------------------------------------------


def _match_sql(base: str, window: str, i: int) -> str:
    letter = f"substr({window}, {i}, 1)"
    return f"{letter} IN ('c', 't')" if base == "c" else f"{letter} = '{base}'"


def _direct_sql(probe: str, window: str = "win") -> str:
    return "(" + " + ".join(f"({_match_sql(b, window, i)})::INT" for i, b in enumerate(probe, 1)) + ")::DOUBLE"


def _windows_sql(width: int, source: str = "genomes") -> str:
    return f"SELECT accession, o AS o, substr(dna, o + 1, {width}) AS win, length(dna) AS len FROM (SELECT accession, dna, unnest(range(0, greatest(length(dna) - {width - 1}, 0))) AS o FROM {source})"


def _consistency_sql(probe: str, patience: int, window: str = "win") -> str:
    m = len(probe)
    misses = "list_filter([" + ", ".join(f"CASE WHEN {_match_sql(b, window, i)} THEN 0 ELSE {i} END" for i, b in enumerate(probe, 1)) + "], lambda x: x > 0)"
    bounds = f"list_concat(list_concat([0], {misses}), [{m + 1}])"
    return f"(CASE WHEN len({misses}) <= {patience} THEN {m} - len({misses}) ELSE list_max(list_transform(range(1, len({misses}) - {patience} + 2), lambda k: ({bounds})[k + {patience + 1}] - ({bounds})[k] - {1 + patience})) END)::DOUBLE"


def _edit_sql(probe: str, inner: str) -> str:
    """Adds ``score`` to a query of ``win``: one level for each cell of the table."""
    m = len(probe)
    far = 1_000_000
    q = inner
    cell = lambda i, j: f"d{i}_{j}" if i and j else ("0" if i == j else str(far))
    for i in range(1, m + 1):
        for j in range(1, m + 1):
            miss = f"(CASE WHEN {_match_sql(probe[i - 1], 'win', j)} THEN 0 ELSE 1 END)"
            q = f"SELECT *, least({cell(i - 1, j)} + 1, {cell(i, j - 1)} + 1, {cell(i - 1, j - 1)} + {miss}) AS d{i}_{j} FROM ({q})"
    return f"SELECT win, ({m} - d{m}_{m})::DOUBLE AS score FROM ({q})"


def _histogram(spark: SparkSession, sf_dir: str, width: int, score: Callable[[Column], Column]) -> DataFrame:
    plus = T.genomes(spark, sf_dir).withColumn("strand", F.lit("+"))
    rows = Q.windows(plus, width).select("accession", score(F.col("window")).alias("score"))
    return rows.groupBy("accession", "score").agg(F.count("*").alias("n"))


def _histogram_sql(width: int, score: str) -> str:
    return f"WITH {T.GENOMES}, w AS ({_windows_sql(width)}) SELECT accession, {score} AS score, count(*) AS n FROM w GROUP BY ALL"


# Sequences -------------------------------------------------------------------------------------


@query(f"WITH {T.GENOMES} SELECT accession, reverse(translate(dna, 'acgt', 'tgca')) AS revcomp FROM genomes")
def revcomp(spark, sf_dir):
    return T.genomes(spark, sf_dir).select("accession", D.reverse_complement("dna").alias("revcomp"))


@query(f"WITH {T.GENOMES} SELECT accession, substr(dna, 11, 30) AS part FROM genomes")
def subseq_1based(spark, sf_dir):
    return T.genomes(spark, sf_dir).select("accession", D.subsequence("dna", F.lit(11), F.lit(40)).alias("part"))


@query(f"WITH {T.GENOMES}, l AS (SELECT unnest(string_split(dna, '')) AS letter FROM genomes) SELECT letter, count(*) AS n FROM l WHERE letter <> '' GROUP BY letter")
def letter_histogram(spark, sf_dir):
    g = T.genomes(spark, sf_dir).agg(*[F.sum(D.letter_count("dna", x)).alias(x) for x in D.LETTERS])
    return g.select(F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.col(x).alias("n")) for x in D.LETTERS])).alias("r")).select("r.*").where("n > 0")


_counts = " + ".join(f"least({PROBE.count(x)}, length(win) - length(replace(win, '{x}', '')))" for x in "acgt")


@query(f"WITH {T.GENOMES}, w AS ({_windows_sql(8)}) SELECT accession, count(*) FILTER (WHERE {_counts} < 6 OR NOT regexp_matches(win, '^(?:.*a.*tt)')) AS skipped, count(*) AS n FROM w GROUP BY accession")
def composition_prefilter(spark, sf_dir):
    w = Q.windows(T.genomes(spark, sf_dir).withColumn("strand", F.lit("+")), 8)
    skip = D.can_skip(F.lit(PROBE), F.col("window"), 6, ".*a.*tt")
    return w.groupBy("accession").agg(F.count_if(skip).alias("skipped"), F.count("*").alias("n"))


@query("""SELECT p_partkey, regexp_matches(upper(trim(p_name)), '^[AUCG]*$') AS strict,
  coalesce(list_aggregate(list_sort(list_distinct(list_filter(string_split(regexp_replace(upper(trim(p_name)), '[AUCG]', '', 'g'), ''), lambda x: x <> ''))), 'string_agg', ''), '') AS odd FROM part""")
def strict_alphabet(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return p.select("p_partkey", D.is_strict("p_name").alias("strict"), F.array_join(D.odd_letters("p_name"), "").alias("odd"))


# Scores ----------------------------------------------------------------------------------------


@query(_histogram_sql(8, _direct_sql(PROBE)))
def direct_scan(spark, sf_dir):
    return _histogram(spark, sf_dir, 8, lambda w: S.direct(PROBE, w))


@query(_histogram_sql(8, _consistency_sql(PROBE, 0)))
def consistency_p0(spark, sf_dir):
    return _histogram(spark, sf_dir, 8, lambda w: S.consistency(PROBE, w, 0))


@query(_histogram_sql(8, _consistency_sql(PROBE, 2)))
def consistency_p2(spark, sf_dir):
    return _histogram(spark, sf_dir, 8, lambda w: S.consistency(PROBE, w, 2))


@query(_histogram_sql(8, f"(8 - (substr(win, 1, 1) <> '{PLAIN[0]}')::INT - levenshtein(substr(win, 2), '{PLAIN[1:]}'))::DOUBLE"))
def textedit_symmetric(spark, sf_dir):
    return _histogram(spark, sf_dir, 8, lambda w: S.text_edit(PLAIN, w))


@query(f"WITH {T.GENOMES}, w AS ({_windows_sql(6)}), s AS ({_edit_sql('gacatc', 'SELECT DISTINCT win FROM w')}) SELECT accession, score, count(*) AS n FROM w JOIN s USING (win) GROUP BY ALL")
def textedit_ct(spark, sf_dir):
    return _histogram(spark, sf_dir, 6, lambda w: S.text_edit("gacatc", w))


_LONG = "gattagatagtagattagag"


def _levenshtein_sql(probe: str) -> str:
    """Edit score of a probe without c, by the built-in distance: the first letters are aligned."""
    return f"({len(probe)} - (substr(win, 1, 1) <> '{probe[0]}')::INT - levenshtein(substr(win, 2), '{probe[1:]}'))::DOUBLE"


@query(_histogram_sql(20, _levenshtein_sql(_LONG)))
def textedit_bits(spark, sf_dir):
    return _histogram(spark, sf_dir, 20, lambda w: K.text_edit_udf(_LONG)(w))


_pattern = S.compile_pattern(PROBE, [(0, 3)], [(6, 2)])
_full = lambda e: f"regexp_matches(win, '^(?:{e})')"


@query(_histogram_sql(8, f"(CASE WHEN {_full(_pattern.must)} THEN {_pattern.must_score} + {' + '.join(f'(CASE WHEN {_full(e)} THEN {s} ELSE 0 END)' for e, s in _pattern.optional)} ELSE 0 END)::DOUBLE"))
def pattern_score(spark, sf_dir):
    return _histogram(spark, sf_dir, 8, lambda w: S.pattern(_pattern, w))


@query(f"WITH {T.GENOMES}, w AS ({_windows_sql(8)}), s AS (SELECT accession, ({_direct_sql(PROBE)} * 0.75 + {_consistency_sql(PROBE, 1)} * 0.25) / 1.0 AS score FROM w) SELECT accession, max(score) AS best, count(*) AS n FROM s GROUP BY accession")
def weighted_combo(spark, sf_dir):
    weights = S.positive_weights({"direct": 0.75, "consistent": 0.25, "pat": 0})
    options = S.Options(patience=1)
    w = Q.windows(T.genomes(spark, sf_dir).withColumn("strand", F.lit("+")), 8)
    score = S.weighted({k: S.similarity(k, PROBE, F.col("window"), options) for k in weights}, weights)
    return w.groupBy("accession").agg(F.max(score).alias("best"), F.count("*").alias("n"))


_BOTH = f"""{T.GENOMES}, strands AS (SELECT accession, '+' AS strand, dna FROM genomes UNION ALL SELECT accession, '-', reverse(translate(dna, 'acgt', 'tgca')) FROM genomes)"""


def _peaks_sql(probe: str, score: str, distance: int) -> str:
    m = len(probe)
    return f"""w AS (SELECT accession, strand, o, substr(dna, o + 1, {m}) AS win, length(dna) AS len FROM (SELECT accession, strand, dna, unnest(range(0, greatest(length(dna) - {m - 1}, 0))) AS o FROM strands)),
s AS (SELECT *, {score} AS score FROM w),
p AS (SELECT *, max(score) OVER (PARTITION BY accession, strand ORDER BY o ROWS BETWEEN {distance - 1} PRECEDING AND {distance - 1} FOLLOWING) AS peak FROM s)"""


@query(f"""WITH {_BOTH}, w AS (SELECT *, unnest(range(0, greatest(length(dna) - 7, 0))) AS o FROM strands),
s AS (SELECT accession, strand, o, {_direct_sql(PROBE, "substr(dna, o + 1, 8)")} AS score, o // (CASE WHEN length(dna) < 32 THEN length(dna) ELSE length(dna) // 32 END) AS part FROM w),
p AS (SELECT *, max(score) OVER (PARTITION BY accession, strand, part ORDER BY o ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS peak FROM s)
SELECT accession, strand, o AS "offset", score FROM p WHERE score > 0 AND score = peak""")
def direct_suppress_compat(spark, sf_dir):
    found = Q.search([("p", PROBE)], T.genomes(spark, sf_dir), {"direct": 1.0}, top_k=None, compat=True)
    return found.select("accession", "strand", "offset", F.col("weighted").alias("score"))


def _top_sql(name: str, probe: str, score: str, k: int, distance: int, per: str = "") -> str:
    m = len(probe)
    return f"""WITH {_BOTH}, {_peaks_sql(probe, score, distance)},
r AS (SELECT '{name}' AS name, accession, strand, CASE WHEN strand = '+' THEN o + 1 ELSE len - o END AS "start", CASE WHEN strand = '+' THEN o + {m} ELSE len - (o + {m - 1}) END AS "end",
  o AS "offset", score AS weighted, win AS "window" FROM p WHERE score > 0 AND score = peak)
SELECT * FROM (SELECT *, row_number() OVER ({per}ORDER BY weighted DESC, accession, strand, "offset")::INT AS rank FROM r) WHERE rank <= {k}"""


@query(f"WITH {_BOTH}, {_peaks_sql(PROBE, _direct_sql(PROBE), 5)} SELECT accession, strand, o AS \"offset\", score FROM p WHERE score > 0 AND score = peak")
def direct_suppress(spark, sf_dir):
    found = Q.search([("p", PROBE)], T.genomes(spark, sf_dir), {"direct": 1.0}, top_k=None)
    return found.select("accession", "strand", "offset", F.col("weighted").alias("score"))


@query(_top_sql("p", PROBE, _direct_sql(PROBE), 20, 5))
def direct_topk_strands(spark, sf_dir):
    return Q.search([("p", PROBE)], T.genomes(spark, sf_dir), {"direct": 1.0}, top_k=20).drop("scores")


def _least_sql(probe: str, score: str, least: float) -> str:
    return f"WITH {_BOTH}, {_peaks_sql(probe, score, 5)} SELECT accession, strand, o AS \"offset\", win AS \"window\", score FROM p WHERE score >= {least} AND score = peak"


def _seeded(spark: SparkSession, sf_dir: str, probe: str, weights: dict[str, float], least: float) -> DataFrame:
    q = G.gram_size([("p", probe)], list(weights), least)
    path = G.write_index(T.genomes(spark, sf_dir), new_path(spark, "index"), q, len(probe))
    found = G.seed_search(spark, path, [("p", probe)], weights, least, q, top_k=None)
    return found.select("accession", "strand", "offset", "window", F.col("weighted").alias("score"))


_SEEDED, _SEEDED_PLAIN = "gatacattgaca", "gattagatagat"


@query(_least_sql(_SEEDED, _direct_sql(_SEEDED), 9.5))
def seed_candidates(spark, sf_dir):
    return _seeded(spark, sf_dir, _SEEDED, {"direct": 1.0}, 9.5)


@query(_least_sql(_SEEDED_PLAIN, _levenshtein_sql(_SEEDED_PLAIN), 9))
def seed_edits(spark, sf_dir):
    return _seeded(spark, sf_dir, _SEEDED_PLAIN, {"textedit": 1.0}, 9)


_flag = f"(({_direct_sql(PROBE)} * 1.0 + {_consistency_sql(PROBE, 2)} * 1.0) / 2.0)"
_flag2 = f"(({_direct_sql(PLAIN)} * 1.0 + {_consistency_sql(PLAIN, 2)} * 1.0) / 2.0)"


@query(f"SELECT * FROM ({_top_sql('a', PROBE, _flag, 20, 5)}) UNION ALL SELECT * FROM ({_top_sql('b', PLAIN, _flag2, 20, 5)})")
def similarity_flagship(spark, sf_dir):
    weights, options = {"direct": 1.0, "consistency": 1.0}, S.Options(patience=2)
    return Q.search([("a", PROBE), ("b", PLAIN)], T.genomes(spark, sf_dir), weights, options, top_k=20).drop("scores")


_first_best = f"SELECT accession, min(o) AS o, arg_min(win, o) AS win FROM (SELECT *, max(score) OVER (PARTITION BY accession) AS peak FROM (SELECT *, {_direct_sql(PROBE)} AS score FROM w)) WHERE score = peak GROUP BY accession"
_marks = "(" + " || ".join(f"CASE WHEN {_match_sql(b, 'win', i)} THEN '*' ELSE '.' END" for i, b in enumerate(PROBE, 1)) + ")"


def _best_windows(spark, sf_dir):
    """The first of the best windows of each genome; what is shuffled of a window is a number, its score before its offset."""
    g = T.genomes(spark, sf_dir)
    w = Q.windows(g.withColumn("strand", F.lit("+")), 8)
    rank = F.shiftleft(S.direct(PROBE, F.col("window")).cast("long"), 32) - F.col("offset")
    top = w.groupBy("accession").agg(F.max(rank).alias("rank"))
    offset = F.pmod(-F.col("rank"), F.lit(1 << 32))
    found = g.join(top, "accession").select("accession", "rank", offset.cast("int").alias("offset"), F.substring("dna", (offset + 1).cast("int"), F.lit(8)).alias("window"))
    # Of rows that share an accession, those count that have the window there.
    there = S.direct(PROBE, F.col("window")).cast("long") == F.shiftright(F.col("rank") + F.col("offset"), 32)
    return found.where((F.length("window") == 8) & there).groupBy("accession", "offset").agg(F.min("window").alias("window"))


@query(f"WITH {T.GENOMES}, w AS ({_windows_sql(8)}) SELECT accession, '{PROBE}' AS probe, win AS \"window\", {_marks} AS marks FROM ({_first_best})")
def align_direct(spark, sf_dir):
    return _best_windows(spark, sf_dir).select("accession", S.render_direct(PROBE, F.col("window")).alias("r")).select("accession", "r.*")


@query(f"""WITH {T.GENOMES}, w AS ({_windows_sql(8)}), b AS (SELECT accession AS id, o + 1 AS a, {_marks} AS marks, {_consistency_sql(PROBE, 0)} AS score FROM ({_first_best})),
p AS (SELECT id, a, score, i, substr(marks, i, 1) AS mark FROM (SELECT *, unnest(range(1, 9)) AS i FROM b)),
r AS (SELECT *, sum((mark = '.')::INT) OVER (PARTITION BY id ORDER BY i) AS run FROM p),
c AS (SELECT *, sum((mark = '*')::INT) OVER (PARTITION BY id, run ORDER BY i) AS hits, min(CASE WHEN mark = '*' THEN i END) OVER (PARTITION BY id, run ORDER BY i) AS first FROM r)
SELECT id, first AS "left", i AS "right", a + first - 1 AS sub_start, a + i - 1 AS sub_end FROM c WHERE hits = score AND hits > 0 AND mark <> '.'""")
def best_submatch(spark, sf_dir):
    b = _best_windows(spark, sf_dir)
    marks = b.select(F.col("accession").alias("id"), (F.col("offset") + 1).alias("start"), (F.col("offset") + 8).alias("end"), S.render_direct(PROBE, F.col("window"))["marks"].alias("marks"), S.consistency(PROBE, F.col("window"), 0).alias("score"))
    return Q.best_submatches(marks)


# Intervals -------------------------------------------------------------------------------------

_CLASSIFY = """CASE WHEN {y} < {a} THEN 'TotallyLeft' WHEN {x} < {a} AND {y} < {b} THEN 'IntersectLeft' WHEN {x} < {a} AND {y} >= {b} THEN 'CoverLeft'
  WHEN {x} >= {a} AND {y} <= {b} THEN 'Inner' WHEN {x} <= {a} AND {y} > {b} THEN 'CoverRight' WHEN {x} <= {b} AND {y} > {b} THEN 'IntersectRight' ELSE 'TotallyRight' END"""
_class = _CLASSIFY.format(a="seg_left", b="seg_right", x="q_left", y="q_right")
_label = """CASE WHEN klass IN ('IntersectLeft', 'CoverLeft') THEN CASE WHEN strand_s = '+' THEN '5''' ELSE '3''' END WHEN klass IN ('IntersectRight', 'CoverRight') THEN CASE WHEN strand_s = '+' THEN '3''' ELSE '5''' END
  WHEN klass = 'Inner' THEN 'cds' ELSE 'inter-genic' END"""
_overlap = "ranges r JOIN (SELECT accession, seg_id, seg_left, seg_right, strand AS strand_s, gene FROM segments) s ON r.accession = s.accession AND q_left <= seg_right AND seg_left <= q_right"


def _overlaps(spark, sf_dir):
    s = T.segments(spark, sf_dir).withColumnRenamed("strand", "strand_s")
    return I.overlap_join(T.ranges(spark, sf_dir), s, ("accession",), 2000)


_ord = "(o_orderkey * 31) % 400"
_orec = "o_custkey % 300"


@query(f"SELECT o_orderkey, {_CLASSIFY.format(a=_orec, b=f'{_orec} + 60', x=_ord, y=f'{_ord} + o_orderkey % 90')} AS klass FROM orders")
def interval_classify(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    a, x = F.col("o_custkey") % 300, (F.col("o_orderkey") * 31) % 400
    return o.select("o_orderkey", I.classify(a, a + 60, x, x + F.col("o_orderkey") % 90).alias("klass"))


@query(f"WITH {T.SEGMENTS}, {T.RANGES} SELECT qid, gene FROM {_overlap}")
def overlap_join(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("qid", "gene")


@query(f"""WITH {T.SEGMENTS}, {T.RANGES}, j AS (SELECT qid, gene, strand_s, {_class} AS klass FROM {_overlap}),
far AS (SELECT qid, (SELECT max(seg_right) FROM segments s WHERE s.accession = r.accession AND seg_right < q_left) AS a, (SELECT min(seg_left) FROM segments s WHERE s.accession = r.accession AND seg_left > q_right) AS b, accession FROM ranges r WHERE qid NOT IN (SELECT qid FROM j))
SELECT qid, gene, {_label} AS location FROM j
UNION ALL SELECT f.qid, coalesce(u.gene, 'None') || ',' || coalesce(d.gene, 'None'), 'inter-genic' FROM far f LEFT JOIN segments u ON u.accession = f.accession AND u.seg_right = f.a LEFT JOIN segments d ON d.accession = f.accession AND d.seg_left = f.b""")
def location_label(spark, sf_dir):
    j = _overlaps(spark, sf_dir)
    klass = I.classify("seg_left", "seg_right", "left", "right")
    hit = j.select("qid", "gene", I.location_label(klass, F.when(F.col("strand_s") == "+", ">").otherwise("<")).alias("location"))
    near = I.nearest(T.ranges(spark, sf_dir), T.segments(spark, sf_dir), ("accession",))
    between = near.join(hit.select("qid").distinct(), "qid", "left_anti")
    none = F.lit("None")
    return hit.unionByName(between.select("qid", F.concat_ws(",", F.coalesce("up.gene", none), F.coalesce("down.gene", none)).alias("gene"), F.lit("inter-genic").alias("location")))


@query(f"WITH {T.SEGMENTS}, {T.RANGES} SELECT qid, gene, greatest(0, least(q_right, seg_right) - greatest(q_left, seg_left) + 1)::BIGINT AS covered FROM {_overlap}")
def coverage_len(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("qid", "gene", I.coverage("left", "right", "seg_left", "seg_right").alias("covered"))


@query(f"""WITH {T.SEGMENTS}, {T.RANGES}, j AS (SELECT *, seg_right - seg_left + 1 AS size FROM {_overlap}),
d AS (SELECT qid, gene, q_left, q_right, seg_left, seg_right, strand_s, greatest(1, size // 10) AS step, least(10, size) AS parts, unnest(range(0, least(10, size))) AS i FROM j),
e AS (SELECT *, seg_left + i * step AS a, CASE WHEN i = parts - 1 THEN seg_right ELSE seg_left + (i + 1) * step - 1 END AS b FROM d)
SELECT qid, gene, string_agg(CASE WHEN greatest(0, least(b, q_right) - greatest(a, q_left) + 1) * 2 > step THEN '*' WHEN strand_s = '+' THEN '>' ELSE '<' END, '' ORDER BY i) AS drawing FROM e GROUP BY qid, gene""")
def coverage_buckets(spark, sf_dir):
    j = _overlaps(spark, sf_dir)
    mark = F.when(F.col("strand_s") == "+", ">").otherwise("<")
    return j.select("qid", "gene", I.coverage_drawing(F.col("left"), F.col("right"), F.col("seg_left"), F.col("seg_right"), mark).alias("drawing"))


_rank = "(SELECT count(*) FROM segments s WHERE s.accession = r.accession AND seg_left < {at})"


@query(f"WITH {T.SEGMENTS}, {T.RANGES} SELECT qid, {_rank.format(at='q_left')} AS rank FROM ranges r")
def lower_bound_rank(spark, sf_dir):
    return I.lower_bound(T.ranges(spark, sf_dir), T.segments(spark, sf_dir), ("accession",), "left", "seg_left").select("qid", "rank")


_starts = "(SELECT *, CASE WHEN strand = '+' THEN seg_left ELSE seg_right END AS seg_start FROM segments)"


@query(f"""WITH {T.SEGMENTS}, {T.RANGES}, g AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY seg_start) - 1 AS seg_rank FROM {_starts}),
n AS (SELECT accession, count(*) - 1 AS last FROM segments GROUP BY accession),
q AS (SELECT r.*, least(last, (SELECT count(*) FROM g WHERE g.accession = r.accession AND seg_start < q_left)) AS idx FROM ranges r JOIN n USING (accession))
SELECT qid, gene, {_class} AS klass FROM q JOIN g ON q.accession = g.accession AND seg_rank BETWEEN idx - 2 AND idx + 2""")
def rank_window_lookup(spark, sf_dir):
    s = T.segments(spark, sf_dir).withColumn("seg_start", F.when(F.col("strand") == "+", F.col("seg_left")).otherwise(F.col("seg_right"))).drop("strand")
    near = I.rank_neighbourhood(T.ranges(spark, sf_dir), s, 2, ("accession",), "left")
    return near.select("qid", "gene", I.classify("seg_left", "seg_right", "left", "right").alias("klass"))


def _nearby_sql(kind: str) -> str:
    return f"""WITH {T.SEGMENTS}, {T.RANGES}, q AS (SELECT *, {_rank.format(at="q_left")} AS a, {_rank.format(at="q_right")} - 1 AS b FROM ranges r),
f AS (SELECT qid, q_left, q_right, a, b, seg_id, seg_left, seg_right, gene, min(CASE WHEN a <> b AND seg_left <= q_left AND seg_right >= q_right THEN seg_id END) OVER (PARTITION BY qid) AS cover
  FROM q JOIN segments s ON q.accession = s.accession AND seg_id BETWEEN least(a, b) AND greatest(a, b))
SELECT qid, gene, {kind} AS type FROM f WHERE cover IS NULL OR cover = seg_id"""


_size = "(q_right - q_left + 1)"
_cov = "greatest(0, least(q_right, seg_right) - greatest(q_left, seg_left) + 1)"
_inside = "seg_left <= q_left AND q_right <= seg_right"
_far_overlap = "(CASE WHEN q_right < seg_left OR q_left > seg_right THEN 0 WHEN q_right < seg_right THEN q_right - seg_left + 1 ELSE seg_right - q_left + 1 END)"


@query(_nearby_sql(f"CASE WHEN q_left = seg_left AND q_right = seg_right THEN 'hit' WHEN {_inside} THEN 'include' WHEN {_cov} * 100.0 / {_size} >= 90 THEN 'homology' ELSE 'related' END"))
def nearby_gene_type(spark, sf_dir):
    q = T.ranges(spark, sf_dir).drop("strand")
    return I.nearby_genes(q, T.segments(spark, sf_dir), ("accession",)).select("qid", "gene", "type")


@query(_nearby_sql(f"CASE WHEN q_left = seg_left AND q_right = seg_right THEN 'hit' WHEN {_far_overlap} * 100.0 / {_size} >= 90 THEN 'homology' WHEN {_inside} THEN 'include' ELSE 'related' END"))
def nearby_gene_type_compat(spark, sf_dir):
    q = T.ranges(spark, sf_dir).drop("strand")
    return I.nearby_genes(q, T.segments(spark, sf_dir), ("accession",), compat=True).select("qid", "gene", "type")


def _nearest_sql(segments: str) -> str:
    return f"""WITH {segments}, {T.RANGES}
SELECT qid, (SELECT arg_max(gene, struct_pack(r := seg_right, i := -seg_id)) FROM segments s WHERE s.accession = r.accession AND seg_right < q_left) AS up,
  (SELECT arg_min(gene, struct_pack(l := seg_left, i := seg_id)) FROM segments s WHERE s.accession = r.accession AND seg_left > q_right) AS down FROM ranges r"""


@query(_nearest_sql(T.SEGMENTS))
def nearest_updown(spark, sf_dir):
    return I.nearest(T.ranges(spark, sf_dir), T.segments(spark, sf_dir), ("accession",)).select("qid", F.col("up.gene").alias("up"), F.col("down.gene").alias("down"))


@query(_nearest_sql(T.NESTED))
def nearest_updown_nested(spark, sf_dir):
    return I.nearest(T.ranges(spark, sf_dir), T.segments(spark, sf_dir, nested=True), ("accession",)).select("qid", F.col("up.gene").alias("up"), F.col("down.gene").alias("down"))


@query(f"""WITH {T.SEGMENTS}, {T.RANGES} SELECT qid, CASE WHEN strand = '+' THEN (SELECT arg_min(gene, seg_left) FROM segments s WHERE s.accession = r.accession AND seg_left > q_right)
  ELSE (SELECT arg_max(gene, seg_right) FROM segments s WHERE s.accession = r.accession AND seg_right < q_left) END AS next_gene FROM ranges r""")
def next_neighbor_strand(spark, sf_dir):
    near = I.nearest(T.ranges(spark, sf_dir), T.segments(spark, sf_dir), ("accession",))
    rows = near.select("qid", "left", "right", "strand", F.explode(F.array("up", "down")).alias("s")).select("qid", "left", "right", "strand", "s.seg_left", "s.seg_right", "s.gene", "s.seg_id")
    return I.next_on_strand(rows, "qid").select("qid", "next_gene")


def _gaps_sql(segments: str, reached: str, last: str) -> str:
    return f"""WITH {segments}, lengths AS (SELECT source AS accession, sum(n_chars)::BIGINT + 500 AS length FROM documents GROUP BY source),
g AS (SELECT *, coalesce({reached}, 0) + 1 AS f FROM segments), t AS (SELECT accession, {last} AS last FROM segments GROUP BY accession)
SELECT accession, 'gene' AS kind, seg_left AS "left", seg_right AS "right", gene FROM segments
UNION ALL SELECT accession, 'gap', f, seg_left - 1, NULL FROM g WHERE f <= seg_left - 1
UNION ALL SELECT accession, 'gap', coalesce(last, 0) + 1, length, NULL FROM lengths LEFT JOIN t USING (accession) WHERE coalesce(last, 0) + 1 <= length"""


def _lengths(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("accession")).agg((F.sum("n_chars") + 500).alias("length"))


@query(_gaps_sql(T.SEGMENTS, "max(seg_right) OVER (PARTITION BY accession ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "max(seg_right)"))
def gap_regions(spark, sf_dir):
    return I.gaps(T.segments(spark, sf_dir), _lengths(spark, sf_dir))


@query(_gaps_sql(T.NESTED, "lag(seg_right) OVER (PARTITION BY accession ORDER BY seg_id)", "arg_max(seg_right, seg_id)"))
def gap_regions_compat(spark, sf_dir):
    return I.gaps(T.segments(spark, sf_dir, nested=True), _lengths(spark, sf_dir), compat=True)


_rc = "reverse(translate({x}, 'acgt', 'tgca'))"
_ab = "(accession::BIGINT * 7) % greatest(length(dna), 1) + 1 AS a, (accession::BIGINT * 13) % greatest(length(dna), 1) + 1 AS b"


def _placed(spark, sf_dir):
    g = T.genomes(spark, sf_dir)
    n, k = F.greatest(F.length("dna"), F.lit(1)), F.col("accession").cast("long")
    return g.withColumn("a", (k * 7) % n + 1).withColumn("b", (k * 13) % n + 1)


@query(f"WITH {T.GENOMES}, p AS (SELECT *, {_ab} FROM genomes) SELECT accession, CASE WHEN a < b THEN substr(dna, a, b - a) ELSE {_rc.format(x='substr(dna, b + 1, a - b)')} END AS part FROM p")
def range_extract(spark, sf_dir):
    return _placed(spark, sf_dir).select("accession", I.extract_range("dna", "a", "b").alias("part"))


@query(f"""WITH {T.GENOMES}, p AS (SELECT accession, dna, least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a <= b THEN '+' ELSE '-' END AS strand FROM (SELECT *, {_ab} FROM genomes)),
f AS (SELECT accession, strand, substr(dna, greatest(a - 20, 1), a - greatest(a - 20, 1)) AS u, substr(dna, b + 1, 20) AS d FROM p)
SELECT accession, CASE WHEN strand = '+' THEN u ELSE {_rc.format(x='d')} END AS upstream, CASE WHEN strand = '+' THEN d ELSE {_rc.format(x='u')} END AS downstream FROM f""")
def flanks(spark, sf_dir):
    p = _placed(spark, sf_dir)
    up, down = I.flanks("dna", F.least("a", "b"), F.greatest("a", "b"), F.when(F.col("a") <= F.col("b"), "+").otherwise("-"), 20)
    return p.select("accession", up.alias("upstream"), down.alias("downstream"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def whitelist_semi(spark, sf_dir):
    w = T.table(spark, sf_dir, "labels").where("toxic = 1")
    return C.only(T.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), w, "doc_id")


@query("SELECT o_orderkey AS pos, '(' || c_custkey || ')' AS idx, c_name AS lines FROM orders JOIN customer ON o_custkey = c_custkey")
def reorder_by_list(spark, sf_dir):
    key = F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(")"))
    blocks = T.table(spark, sf_dir, "customer").select(key.alias("idx"), F.col("c_name").alias("lines"))
    return C.reorder(blocks, T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("idx")))


# Clusters and lists ----------------------------------------------------------------------------


@query("SELECT min(p_partkey) AS first, count(*) AS size, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part GROUP BY upper(p_type)")
def exact_cluster(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("member"), "p_type")
    return C.exact_clusters(p, F.upper("p_type")).drop("cluster_key")


@query("""WITH c AS (SELECT event_type, event_id // 64 AS cell, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT event_type, cell, ((sum(n) OVER (PARTITION BY event_type ORDER BY cell))::BIGINT - n) // 64 AS block FROM c),
t AS (SELECT event_type, min(event_id) AS first, count(*) AS size FROM events GROUP BY event_type)
SELECT event_type AS cluster_key, first, size, block, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS members
FROM events JOIN b USING (event_type) JOIN t USING (event_type) WHERE cell = event_id // 64 GROUP BY ALL""")
def cluster_blocks(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("event_id").alias("member"), "event_type")
    return C.cluster_blocks(e, F.col("event_type"), block=64)


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY upper(p_type))")
def cluster_samples(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return C.representatives(p, F.upper("p_type"), "p_partkey")


@query("""WITH v AS (SELECT event_id, CASE WHEN event_type <> 'click' THEN string_split(event_type, ' ')[1] END AS value FROM events)
SELECT value, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v) AS percent, min(event_id) AS first FROM v WHERE value IS NOT NULL GROUP BY value""")
def source_distribution(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    return C.distribution(e, F.when(F.col("event_type") != "click", C.first_words("event_type", 1)), "event_id")


@query(f"""WITH {T.LAYOUTS}, t AS (SELECT diagram, direction AS toward, top AS target_top, idx AS target_idx FROM items WHERE is_gene AND idx = target_at),
c AS (SELECT i.*, toward, target_idx, CASE WHEN toward = 'Right' THEN idx ELSE -idx END AS n FROM items i JOIN t USING (diagram) WHERE (is_gene AND direction = toward) OR (NOT is_gene AND top <= target_top)),
b AS (SELECT *, lag(is_gene) OVER (PARTITION BY diagram ORDER BY n) AS before, min(CASE WHEN NOT is_gene THEN n END) OVER (PARTITION BY diagram ORDER BY n) AS first FROM c),
o AS (SELECT *, (NOT is_gene AND (coalesce(before, false) OR n = first)) AS opens FROM b),
u AS (SELECT *, sum(opens::INT) OVER (PARTITION BY diagram ORDER BY n) AS unit FROM o)
SELECT diagram, arg_min(name, n) FILTER (WHERE opens) AS promoter, arg_min(pos, n) FILTER (WHERE is_gene) AS near_gene_pos FROM u GROUP BY diagram, unit HAVING bool_or(is_gene AND idx = target_idx)""")
def best_promoter(spark, sf_dir):
    return P.best_promoter(T.layouts(spark, sf_dir))


_attr = "'<b>Gene</b>: ' || p_name || '<BR><b>Location</b>: ' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ' -> ' ELSE ' <- ' END || (p_partkey + p_size) || '<BR>' || CASE WHEN p_size > 25 THEN 'Promoter: ' || p_brand || '<br>Tr.Start site: 1,' || lpad((p_size * 10)::VARCHAR, 3, '0') ELSE '' END"


@query(f"""SELECT p_partkey, p_name AS gene, CASE WHEN p_size % 2 = 0 THEN 'Right' ELSE 'Left' END AS direction, CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_partkey + p_size END AS gene_start,
  p_size > 25 AS promoter, CASE WHEN p_size > 25 THEN (1000 + p_size * 10)::BIGINT END AS start_site, length({_attr}) AS size FROM part""")
def attr_map(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    tail = F.when(F.col("p_size") > 25, F.concat(F.lit("Promoter: "), "p_brand", F.lit("<br>Tr.Start site: 1,"), F.lpad((F.col("p_size") * 10).cast("string"), 3, "0"))).otherwise("")
    arrow = F.when(F.col("p_size") % 2 == 0, " -> ").otherwise(" <- ")
    body = F.concat(F.lit("<b>Gene</b>: "), "p_name", F.lit("<BR><b>Location</b>: "), F.col("p_partkey").cast("string"), arrow, (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit("<BR>"), tail)
    a = p.withColumn("body", body).withColumn("attr", P.attributes("body"))
    return a.select("p_partkey", F.col("attr")["Gene"].alias("gene"), P.gene_direction("attr").alias("direction"), P.gene_start("attr").alias("gene_start"), P.is_promoter("attr", True).alias("promoter"), P.start_site("attr").alias("start_site"), F.length("body").cast("long").alias("size"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'e' || l_suppkey ELSE '' END AS enzyme, CASE WHEN l_linestatus = 'O' THEN 'r' || l_partkey END AS rna, CASE WHEN l_linenumber > 3 THEN 'p' || l_linenumber ELSE ' ' END AS protein FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN trim(protein) <> '' THEN 'protein' WHEN trim(rna) <> '' THEN 'rna' WHEN trim(enzyme) <> '' THEN 'enzyme' END AS kind,
  CASE WHEN trim(protein) <> '' THEN protein WHEN trim(rna) <> '' THEN rna WHEN trim(enzyme) <> '' THEN enzyme END AS product FROM a""")
def last_nonempty_product(spark, sf_dir):
    r = T.table(spark, sf_dir, "lineitem")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    pairs = [
        F.lit("enzyme"), F.when(F.col("l_returnflag") == "R", text("e", "l_suppkey")).otherwise(""),
        F.lit("rna"), F.when(F.col("l_linestatus") == "O", text("r", "l_partkey")),
        F.lit("protein"), F.when(F.col("l_linenumber") > 3, text("p", "l_linenumber")).otherwise(" "),
    ]
    kind, product = E.product(F.create_map(*pairs))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"), product.alias("product"))


@query("""WITH n AS (SELECT l_orderkey, l_partkey AS a, l_partkey + l_suppkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)
SELECT l_orderkey, """ + ", ".join(f"max(CASE WHEN i = {i} THEN a END) AS start_{i}, max(CASE WHEN i = {i} THEN b END) AS end_{i}" for i in (1, 2, 3)) + " FROM n GROUP BY l_orderkey")
def tsv_pivot_intervals(spark, sf_dir):
    r = T.table(spark, sf_dir, "lineitem")
    span = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey")).alias("end"))
    return E.pivot_spans(r.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(span)).alias("spans")), "l_orderkey", "spans", 3)


@query("""SELECT o_orderkey AS file, rec::BIGINT AS rec, 'c' || o_custkey AS accession, CASE rec WHEN 1 THEN o_custkey ELSE o_orderkey END AS "start", CASE rec WHEN 1 THEN o_orderkey ELSE o_custkey END AS "end",
  CASE rec WHEN 1 THEN o_orderstatus ELSE o_orderpriority END AS kind, (rec - 1)::BIGINT AS extra FROM (SELECT *, unnest([1, 2]) AS rec FROM orders)""")
def record_blocks(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("(1)\n>c"), c, F.lit("/"), c, F.lit("-"), k, F.lit("\tdirection=+,kind="), "o_orderstatus", F.lit(",x=1\n\n(2)\n>c"), c, F.lit("/"), k, F.lit("-"), c, F.lit("\tkind="), "o_orderpriority", F.lit("\nmore\n"))
    found = X.match_records(X.lines_of(o.select(F.col("o_orderkey").alias("file"), text.alias("text")), "file", "text"))
    return found.select("file", F.col("rec").cast("long"), "accession", "start", "end", F.col("values")["kind"].alias("kind"), F.size("lines").cast("long").alias("extra"))


# Pages and text --------------------------------------------------------------------------------


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href || '#tab=TU' AS href, count(*) AS n FROM m GROUP BY ALL""")
def page_links(spark, sf_dir):
    p = link_rows(T.table(spark, sf_dir, "pages").select("page_id", "html"), "html", "l")
    return p.groupBy("page_id", F.col("l.href").alias("href")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'chr' || o_custkey AS chrom, o_custkey AS \"left\", o_custkey + o_orderkey % 100 AS \"right\", CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS strand FROM orders WHERE o_orderkey % 5 <> 0")
def locus_parse(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    c = F.col("o_custkey").cast("string")
    strand = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderstatus") == "F", "(+)").otherwise("(-)")
    locus = F.concat(F.lit("chr"), c, F.lit(":"), c, F.lit("-"), (F.col("o_custkey") + F.col("o_orderkey") % 100).cast("string"), strand)
    return o.select("o_orderkey", I.parse_locus(locus).alias("p")).where("p is not null").select("o_orderkey", "p.*")


_stem = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', '_', 'g'), '[^a-zA-Z0-9_.]', '', 'g'), '\\.txt|\\..tsv|\\..csv', '', 'g'), '(result|_|all)+$', '')"


_name = "p_name || ' ' || p_type || CASE WHEN p_size % 3 = 0 THEN '_result.txt' WHEN p_size % 3 = 1 THEN '.tsv' ELSE ' all result' END"


@query(f"SELECT p_partkey, {_stem.format(x=f'({_name})')} AS stem FROM part")
def file_name_norm(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    tail = F.when(F.col("p_size") % 3 == 0, "_result.txt").when(F.col("p_size") % 3 == 1, ".tsv").otherwise(" all result")
    return p.select("p_partkey", E.file_stem(F.concat("p_name", F.lit(" "), "p_type", tail)).alias("stem"))


@query("SELECT p_partkey, round(p_retailprice * 3, 2) AS total, true AS in_bounds FROM part")
def mean_preserving_triple(spark, sf_dir):
    t = E.mean_preserving_triples(T.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    x = F.col("p_retailprice")
    near = lambda c: (F.col(c) >= x * 0.975) & (F.col(c) < x * 1.025)
    return t.select("p_partkey", F.round(F.col("a") + F.col("b") + F.col("c"), 2).alias("total"), (near("a") & near("b")).alias("in_bounds"))


_words = ("blue", "green", "red", "small", "large")


@query("WITH n AS (SELECT DISTINCT p_brand AS name FROM part), c AS (SELECT p_brand AS name, p_type AS t FROM part) SELECT name, " + ", ".join(f"(SELECT count(*) FROM c WHERE c.name = n.name AND contains(lower(t), '{w}')) AS {w}" for w in _words) + " FROM n")
def gene_keyword_matrix(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    hits = p.select(F.col("p_brand").alias("name"), F.explode(F.array(*[F.when(F.lower("p_type").contains(w), w) for w in _words])).alias("keyword")).where("keyword is not null").groupBy("name", "keyword").agg(F.count("*").alias("hits"))
    return E.name_keyword_matrix(p.select(F.col("p_brand").alias("name")).distinct(), list(_words), hits)


_SENSE = "CASE location WHEN 'inter-genic' THEN 'inter genic' ELSE (CASE WHEN strand_s = strand THEN 'antisense ' ELSE 'sense ' END) || CASE WHEN location IN ('5''', '3''') THEN location || 'utr' ELSE location END END"


@query(f"""WITH {T.SEGMENTS}, {T.RANGES}, j AS (SELECT qid, gene, strand, strand_s, {_class} AS klass FROM {_overlap}), l AS (SELECT *, {_label} AS location FROM j)
SELECT qid, gene, {_SENSE} AS label FROM l""")
def sense_labels(spark, sf_dir):
    j = _overlaps(spark, sf_dir)
    arrow = lambda c: F.when(F.col(c) == "+", ">").otherwise("<")
    location = I.location_label(I.classify("seg_left", "seg_right", "left", "right"), arrow("strand_s"))
    return j.withColumn("location", location).select("qid", "gene", E.sense_label(F.col("location"), arrow("strand_s"), arrow("strand")).alias("label"))


@query(f"""WITH {T.SEGMENTS}, {T.RANGES}, j AS (SELECT qid, gene, q_left, q_right, seg_left, seg_right, strand_s, {_class} AS klass FROM {_overlap}), l AS (SELECT *, {_label} AS location, CASE WHEN strand_s = '+' THEN seg_left ELSE seg_right END AS g FROM j)
SELECT qid, gene FROM l WHERE NOT starts_with(location, '5''') OR (q_left >= g - CASE WHEN strand_s = '+' THEN 45 ELSE 25 END AND q_right <= g + CASE WHEN strand_s = '+' THEN 25 ELSE 45 END)""")
def sub_location_filter(spark, sf_dir):
    arrow = F.when(F.col("strand_s") == "+", ">").otherwise("<")
    j = _overlaps(spark, sf_dir).withColumn("location", I.location_label(I.classify("seg_left", "seg_right", "left", "right"), arrow))
    start = F.when(F.col("strand_s") == "+", F.col("seg_left")).otherwise(F.col("seg_right"))
    return j.where(E.sub_location_passes(F.col("location"), F.col("left"), F.col("right"), start, arrow)).select("qid", "gene")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def last_wins(spark, sf_dir):
    return C.last_of_each(T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


@query("""SELECT c_custkey::VARCHAR AS name, c_mktsegment AS product, c_custkey AS "start", c_custkey + (c_nationkey - 12) * 10 AS "end", least(c_custkey, c_custkey + (c_nationkey - 12) * 10) AS "left", greatest(c_custkey, c_custkey + (c_nationkey - 12) * 10) AS "right",
  CASE WHEN c_nationkey > 12 THEN '>' ELSE '<' END AS direction, true AS is_gene FROM customer
UNION ALL SELECT 'pr' || c_custkey, '', c_custkey - 50, c_custkey, c_custkey - 50, c_custkey, '>', false FROM customer WHERE c_acctbal > 0""")
def inter_records(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    text = lambda x: x.cast("string")
    key = F.col("c_custkey")
    records = c.select(text(key).alias("gene"), F.col("c_mktsegment").alias("product"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("pr"), text(key))).otherwise("").alias("promoter_name"), text(key - 50).alias("promoter_pos"), text(key).alias("gene_start_pos"), text(key).alias("map_start_pos"), text(key + (F.col("c_nationkey") - 12) * 10).alias("map_end_pos"))
    return E.inter_records(records, promoters=True)


@query(r"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(ch, '^[0-9]$')) AS digits, count(*) FILTER (WHERE regexp_matches(ch, '^[A-Za-z]$')) AS letters, count(*) FILTER (WHERE regexp_matches(ch, '^[\x{4e00}-\x{9fa5}]$')) AS chinese FROM c GROUP BY doc_id""")
def char_classes(spark, sf_dir):
    c = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return c.groupBy("doc_id").agg(F.count_if(N.is_number("ch")).alias("digits"), F.count_if(N.is_alphabet("ch")).alias("letters"), F.count_if(N.is_chinese("ch")).alias("chinese"))


@query(f"""WITH {T.LAYOUTS}, t AS (SELECT diagram, direction AS toward, idx * 10 AS t_left, idx * 10 + 5 AS t_right FROM items WHERE is_gene AND idx = target_at),
g AS (SELECT diagram, toward, t_left, t_right, min(CASE WHEN idx * 10 > t_right THEN idx * 10 END) AS nl, max(CASE WHEN idx * 10 + 5 < t_left THEN idx * 10 + 5 END) AS nr FROM items JOIN t USING (diagram) WHERE is_gene AND direction = toward GROUP BY ALL)
SELECT diagram, toward AS direction, CASE WHEN toward = 'Left' THEN t_right ELSE nr END AS above, CASE WHEN toward = 'Left' THEN nl ELSE t_left END AS below FROM g""")
def promoter_valid_range(spark, sf_dir):
    return P.valid_range(T.layouts(spark, sf_dir))


@query(f"WITH {T.GENOMES}, p AS (SELECT *, {_ab} FROM genomes) SELECT accession, substr(dna, least(a, b) + 1, greatest(greatest(a, b) - least(a, b) - 1, 0)) AS utr FROM p")
def utr_between(spark, sf_dir):
    p = _placed(spark, sf_dir)
    return p.select("accession", I.utr_between("dna", F.least("a", "b"), F.greatest("a", "b")).alias("utr"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Found' ELSE 'Not Found' END AS status, coalesce(o_custkey::VARCHAR, 'Not Found') AS gene_start_pos,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'Not Found' END AS promoter_name, CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR ELSE 'Not Found' END AS promoter_pos FROM orders""")
def promoter_status(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    found = F.col("o_orderstatus") == "F"
    return o.select("o_orderkey", *E.status_columns(F.col("o_custkey"), F.when(found, F.col("o_orderpriority")), F.when(found, F.col("o_orderkey"))))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS shown FROM part")
def split_alias(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    gene = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("->"), "p_brand")).otherwise(F.col("p_type"))
    name, shown = E.split_alias(gene)
    return p.select("p_partkey", name.alias("name"), shown.alias("shown"))


@query("SELECT o_orderkey, greatest(o_custkey, o_orderkey) AS leftward, least(o_custkey, o_orderkey) AS rightward FROM orders")
def better_promoter(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    return o.select("o_orderkey", P.better_promoter(a, b, F.lit("Left")).alias("leftward"), P.better_promoter(a, b, F.lit("Right")).alias("rightward"))


@query("SELECT p_partkey, p_partkey || '-' || (p_partkey + p_size) || chr(9) || CASE WHEN p_size % 4 = 0 THEN 'UNKNOWN' ELSE p_name END AS line FROM part")
def segment_text(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return p.select("p_partkey", N.segment_text(F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), F.when(F.col("p_size") % 4 != 0, F.col("p_name"))).alias("line"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn, role, text) AS roles, max(turn) AS last FROM conversations GROUP BY conv_id")
def ordered_members(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", F.struct("turn", "role", "text").alias("k"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda x: x["role"]), ">").alias("roles"), F.max("k.turn").alias("last"))


from seqloom.plans import report_queries  # noqa: E402,F401  (registers its own)
