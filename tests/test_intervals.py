import random
import re

from pyspark.sql import functions as F

from seqloom.functions import dna as D
from seqloom.operators import intervals as I


def seg_frame(spark, segs):
    return spark.createDataFrame([("c", i, a, b, f"g{i}") for i, (a, b) in enumerate(segs)], "accession string, seg_id long, seg_left long, seg_right long, gene string")


def q_frame(spark, qs):
    return spark.createDataFrame([("c", i, a, b) for i, (a, b) in enumerate(qs)], "accession string, qid long, left long, right long")


def test_classes(spark):
    cases = {(1, 2): "TotallyLeft", (1, 12): "IntersectLeft", (1, 20): "CoverLeft", (1, 30): "CoverLeft", (10, 20): "Inner", (12, 15): "Inner", (10, 25): "CoverRight", (12, 25): "IntersectRight", (20, 25): "IntersectRight", (21, 25): "TotallyRight"}
    df = spark.createDataFrame([(a, b) for a, b in cases], "l int, r int")
    got = {(x.l, x.r): x.k for x in df.select("l", "r", I.classify(F.lit(10), F.lit(20), "l", "r").alias("k")).collect()}
    assert got == cases


def test_overlap_join_equals_nested_loop(spark):
    r = random.Random(1)
    segs = [(a, a + r.randrange(60)) for a in sorted(r.randrange(1, 500) for _ in range(40))]
    qs = [(a, a + r.randrange(90)) for a in (r.randrange(1, 520) for _ in range(50))]
    for size in (7, 64, 10_000):
        got = sorted((x.qid, x.seg_id) for x in I.overlap_join(q_frame(spark, qs), seg_frame(spark, segs), ("accession",), size).collect())
        assert got == sorted((i, j) for i, (a, b) in enumerate(qs) for j, (x, y) in enumerate(segs) if a <= y and x <= b)


def test_ranges_of_all_sizes_take_few_bins(spark):
    r = random.Random(6)
    length = lambda: r.choice((1, 9, 200, 5_000, 90_000, 900_000))
    segs = [(a, a + r.randrange(length())) for a in (r.randrange(1, 900_000) for _ in range(60))] + [(1, 2_000_000), (10, 80), (80, 640)]
    qs = [(a, a + r.randrange(length())) for a in (r.randrange(1, 900_000) for _ in range(60))] + [(1, 1_900_000), (80, 80), (640, 640)]
    q, s = q_frame(spark, qs), seg_frame(spark, segs)
    for size in (10, 64, 10_000):
        got = sorted((x.qid, x.seg_id) for x in I.overlap_join(q, s, ("accession",), size).collect())
        assert got == sorted((i, j) for i, (a, b) in enumerate(qs) for j, (x, y) in enumerate(segs) if a <= y and x <= b)
        per = I.binned(q, s, ("left", "right"), ("seg_left", "seg_right"), size).groupBy("qid", "level").count().collect()
        assert max(x["count"] for x in per) <= 2 and max(x["level"] for x in per) < I.LEVELS
    # All of one size: nothing goes to a second level.
    short = q_frame(spark, [(a, a + 5) for a in range(1, 3000, 7)])
    assert I.binned(short, short, ("left", "right"), ("left", "right"), 10).count() <= 2 * short.count()
    none = s.where("seg_id < 0")
    assert I.overlap_join(q, none, ("accession",)).count() == 0 and I.overlap_join(q.where("qid < 0"), s, ("accession",)).count() == 0


def test_lower_bound_with_ties(spark):
    starts = spark.createDataFrame([("c", s) for s in (5, 5, 9, 20)], "accession string, start long")
    pos = spark.createDataFrame([("c", p) for p in (1, 5, 6, 9, 20, 21)], "accession string, pos long")
    got = {x.pos: x.rank for x in I.lower_bound(pos, starts, ("accession",)).collect()}
    assert got == {1: 0, 5: 0, 6: 2, 9: 2, 20: 3, 21: 4}


def test_nearest_with_nested_segments(spark):
    r = random.Random(3)
    segs = [(a, a + r.randrange(40)) for a in sorted(r.sample(range(1, 400), 30))]
    qs = [(a, a + r.randrange(30)) for a in (r.randrange(1, 420) for _ in range(60))]
    for strict in (True, False):
        got = {x.qid: (x.up and x.up.seg_right, x.down and x.down.seg_left) for x in I.nearest(q_frame(spark, qs), seg_frame(spark, segs), ("accession",), strict).collect()}
        for i, (a, b) in enumerate(qs):
            up = max((y for _, y in segs if (y < a if strict else y <= a)), default=None)
            down = min((x for x, _ in segs if (x > b if strict else x >= b)), default=None)
            assert got[i] == (up, down)


def test_range_types(spark):
    f = lambda *v, c=False: spark.range(1).select(I.range_type(*map(F.lit, v), c)).first()[0]
    assert f(10, 20, 10, 20) == "hit"
    assert f(12, 15, 10, 20) == "include" and f(12, 15, 10, 20, c=True) == "homology"
    assert f(10, 29, 10, 28) == "homology"
    assert f(1, 30, 10, 20) == "related"


def test_gaps_native_and_compat(spark):
    s = seg_frame(spark, [(10, 100), (20, 30), (50, 60), (120, 130)])
    lengths = spark.createDataFrame([("c", 140), ("d", 5)], "accession string, length long")
    gap = lambda compat: sorted((x.accession, x.left, x.right) for x in I.gaps(s, lengths, compat=compat).where("kind = 'gap'").collect())
    assert gap(False) == [("c", 1, 9), ("c", 101, 119), ("c", 131, 140), ("d", 1, 5)]
    assert gap(True) == [("c", 1, 9), ("c", 31, 49), ("c", 61, 119), ("c", 131, 140), ("d", 1, 5)]


def test_extraction_and_flanks(spark):
    g = spark.createDataFrame([("aacgttcc",)], "dna string")
    f = lambda a, b: g.select(I.extract_range("dna", F.lit(a), F.lit(b))).first()[0]
    assert (f(2, 5), f(5, 2), f(3, 3)) == ("acg", "acg", "")  # bases 2..4; reverse complement of 3..5
    up, down = I.flanks("dna", F.lit(3), F.lit(5), F.lit("-"), 4)
    assert tuple(g.select(up, down).first()) == ("gga", "tt")
    up, down = I.flanks("dna", F.lit(1), F.lit(8), F.lit("+"), 4)
    assert tuple(g.select(up, down).first()) == ("", "")


def test_complement_drops_other_letters(spark):
    assert spark.range(1).select(D.reverse_complement(F.lit("acgnt"))).first()[0] == "acgt"


def test_coverage_drawing(spark):
    f = lambda a, b, x, y: spark.range(1).select(I.coverage_drawing(*map(F.lit, (a, b, x, y)), F.lit(">"))).first()[0]
    assert f(1, 30, 1, 100) == "***>>>>>>>"
    assert f(3, 4, 1, 5) == ">>**>"
    assert f(200, 300, 1, 100) == ">" * 10


def test_locus(spark):
    f = lambda s: spark.range(1).select(I.parse_locus(F.lit(s)).alias("p")).first().p
    assert tuple(f("chr1:5-9(-)")) == ("chr1", 5, 9, "-")
    assert f("chr1:5-9") is None


def test_locate_native_and_by_ranks(spark):
    from seqloom.plans.analyses import locate

    recs = spark.createDataFrame([(i, a, b, a, b, f"g{i}", d, True, "p") for i, (a, b, d) in enumerate([(10, 50, ">"), (60, 90, "<"), (120, 150, ">")])], "seg_id long, seg_start long, seg_end long, seg_left long, seg_right long, gene string, direction string, is_gene boolean, product string")
    hits = spark.createDataFrame([(1, 5, 20), (2, 95, 85), (3, 100, 110), (4, 1, 3)], "id long, start long, end long")
    for compat in (False, True):
        got = {x.id: (x.gene, x.location, x.label) for x in locate(hits, recs, compat).collect()}
        assert got == {1: ("g0", "5'", "antisense 5'utr"), 2: ("g1", "5'", "antisense 5'utr"), 3: ("g1,g2", "inter-genic", "inter genic"), 4: ("None,g0", "inter-genic", "inter genic")}


def test_stored_parts(spark, tmp_path):
    """Equal to what the texts say: all letters, edges of parts, ranges beyond the ends, genomes that aren't there; and only wanted folders are read."""
    from seqloom.sources import parts as R

    r = random.Random(3)
    genomes = {f"g{i}": "".join(r.choice("acgtacgtacgtnnnnN-") for _ in range(r.randrange(60))) for i in range(40)} | {"empty": "", "wide": "acgétéa" * 4}
    df = spark.createDataFrame([*genomes.items(), (None, "acgt")], "accession string, dna string")
    path = R.write_parts(df, str(tmp_path / "parts"), shards=8, part=7, files=5)
    rows = [(n, g, a, b, m) for n, (g, a, b, m) in enumerate([(r.choice([*genomes, "none"]), r.randrange(-5, 60), r.randrange(-5, 70), r.random() < 0.5) for _ in range(300)] + [("g1", None, 3, True), (None, 1, 3, False), ("g1", 1, None, None)])]
    wanted = spark.createDataFrame(rows, "n long, accession string, left long, right long, minus boolean").withColumn("sequence", F.lit("old"))
    back = str.maketrans("acgt", "tgca")
    want = {}
    for n, g, a, b, m in rows:
        a = max(a if a is not None else 1, 1)
        text = genomes[g][a - 1 : b] if g in genomes and b is not None and b >= a else ""
        want[n] = "".join(x for x in text.lower().translate(back)[::-1] if x in "acgt") if m else text  # complements have the four letters only
    both = {k: {x.n: x.sequence for x in R.stored_sequences(wanted, path, "left", "right", F.col("minus"), known_only=k, shards=8, part=7).collect()} for k in (True, False)}
    assert both[False] == want and both[True] == {n: s for n, s in want.items() if rows[n][1] in genomes}
    plain = {x.n: x.sequence for x in I.with_sequence(wanted.where("accession is not null"), df.where("accession is not null"), "left", "right", F.col("minus")).collect()}
    assert {n: s or "" for n, s in plain.items()} == both[True]
    one = R.stored_sequences(wanted.where("accession = 'g1'"), path, "left", "right", shards=8, part=7)
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard#\d+ = \d|PartitionFilters: \[[^\]]*shard#\d+ IN", plan)  # one folder of eight
    assert R.stored_sequences(wanted.where("false"), path, "left", "right", shards=8, part=7).count() == 0


def test_genomes_of_few_rows_are_not_sent_by_way_of_the_driver(spark):
    # 20 rows before they become genomes: a plan that goes by these rows would send all parts to all tasks.
    few = spark.range(2000).groupBy((F.col("id") % 20).cast("string").alias("accession")).agg((F.count("*") * 2000).alias("n"))
    genomes = few.select("accession", F.repeat(F.lit("acgtt"), (F.col("n") / 5).cast("int")).alias("dna"))
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 20).cast("string").alias("accession"), (F.col("id") * 300 + 1).alias("a"), (F.col("id") * 300 + 70_000).alias("b"))
    found = I.with_sequence(rows, genomes, "a", "b")
    got = {r["id"]: r["sequence"] for r in found.collect()}
    dna = "acgtt" * 40_000
    assert got == {i: dna[i * 300 : i * 300 + 70_000] for i in range(400)}
    assert not re.search("BroadcastHashJoin .*LeftOuter", found._jdf.queryExecution().executedPlan().toString())


def test_parts_of_genomes_count_letters(spark, monkeypatch):
    monkeypatch.setattr(I, "PART", 4)
    genomes = spark.createDataFrame([("a", "acgtacgtac"), ("b", ""), ("c", None), ("d", "acgé\nacgtü")], "accession string, dna string")
    got = sorted((r["part_of"], r["part"], r["bases"]) for r in I._parts(genomes).collect())
    assert got == [("a", 0, "acgt"), ("a", 1, "acgt"), ("a", 2, "ac"), ("d", 0, "acgé"), ("d", 1, "\nacg"), ("d", 2, "tü")]


def test_parts_are_packed_many_at_once():
    """Parts of a batch are packed by a few operations on all letters, as each by itself."""
    import pyarrow as pa

    from seqloom.sources import parts as R

    runs, r = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("letter", pa.int32())])), random.Random(2)
    for k in range(60):
        texts = ["".join(r.choice("acgtnnN-" + "aé"[k % 3 == 0 and i % 4 == 0]) for _ in range(r.randrange(30))) for i in range(r.randrange(12))]
        each = [list(x) for x in zip(*map(R.packed, texts))] or [[], [], []]
        assert [x.to_pylist() for x in R.packed_parts(texts, runs)] == [[len(t) for t in texts], *each]
