import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna as D
from seqloom.functions import kernels as K
from seqloom.functions import similarity as S
from seqloom.operators import search as Q
from seqloom.operators import seeds as E


def ok(a, b):
    return a == b or (a == "c" and b == "t")


def model_direct(p, w):
    return sum(ok(a, b) for a, b in zip(p, w))


def model_consistency(p, w, k):
    g = [ok(a, b) for a, b in zip(p, w)]
    return max((sum(g[i:j]) for i in range(len(g)) for j in range(i + 1, len(g) + 1) if (j - i) - sum(g[i:j]) <= k), default=0)


def model_edit(p, w):
    far = 10**6
    n = len(p)
    t = [[far] * (n + 1) for _ in range(n + 1)]
    t[0][0] = 0
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (not ok(p[i - 1], w[j - 1])))
    return n - t[n][n]


def words(r, n, k):
    return ["".join(r.choice("acgt") for _ in range(k)) for _ in range(n)]


@pytest.mark.parametrize("m", [1, 5, 9, 14])
def test_scores_equal_models(spark, m):
    r = random.Random(m)
    probe = words(r, 1, m)[0]
    rows = [(w,) for w in words(r, 120, m)]
    df = spark.createDataFrame(rows, "w string")
    w = F.col("w")
    got = df.select("w", S.direct(probe, w).alias("d"), S.consistency(probe, w, 0).alias("c0"), S.consistency(probe, w, 2).alias("c2"), S.text_edit(probe, w).alias("e")).collect()
    for x in got:
        assert x.d == model_direct(probe, x.w)
        assert x.c0 == model_consistency(probe, x.w, 0)
        assert x.c2 == model_consistency(probe, x.w, 2)
        assert x.e == model_edit(probe, x.w) == K.text_edit_scores(probe, K.letters_of([x.w]))[0]


def test_asymmetric_match():
    assert K.matching("ct", K.letters_of(["tc"]))[0].tolist() == [[True, True], [True, False]]


def model_limited(p, w, limit):
    """Walks back over the whole table, step by step."""
    far, n = 10**6, len(p)
    t = [[far] * (n + 1) for _ in range(n + 1)]
    t[0][0] = 0
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (not ok(p[i - 1], w[j - 1])))
    i = j = n
    run, score, rows = 0, n - t[n][n], []
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (not ok(p[i - 1], w[j - 1])):
            rows.append((p[i - 1], w[j - 1], ok(p[i - 1], w[j - 1])))
            i, j = i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + 1:
            rows.append((p[i - 1], ".", False))
            i -= 1
        else:
            rows.append((".", w[j - 1], False))
            j -= 1
        run = 0 if rows[-1][2] else run + 1
        if run >= limit:
            score = 0
    rows.reverse()
    return score, tuple("".join(r[k] for r in rows) for k in (0, 1)) + ("".join("*" if r[2] else "." for r in rows),)


def test_edit_limit_and_rendering():
    r = random.Random(4)
    for m in (1, 4, 9):
        for limit in (1, 2, 3):
            probe, ws = words(r, 1, m)[0], words(r, 60, m)
            got = K.text_edit_scores(probe, K.letters_of(ws), limit)
            for w, g in zip(ws, got):
                score, rows = model_limited(probe, w, limit)
                assert g == score and K.edit_rows(probe, w) == rows
    assert K.edit_rows("acgg", "aacg")[0][0] == "a"  # first letters are aligned


def test_consistency_marks():
    assert K.consistency_marks("aaaa", "aaaa", 0) == "****"
    assert K.consistency_marks("aagaa", "aataa", 1) == "**-**"
    assert K.consistency_marks("aagaa", "aataa", 0) == "**.**"
    assert K.consistency_marks("gaagag", "taatat", 1) == ".**-*."


def model_blat(p, g, o, middle=10, end=2, skip=3):
    """Whether two anchors match from offset o on, letter by letter."""

    def follow(letters, at, may_end):
        passed, side = 0, False
        for k, x in enumerate(letters):
            if at >= len(g):
                return (at if may_end and k and side else None) if k else None
            here = at
            while at < len(g) and not ok(x, g[at]):
                at += 1
            passed += at - here
            if at >= len(g) or passed > end:
                return None
            side |= at == here
            at += 1
        return at if side else None

    if len(p) < 8 or not ok(p[0], g[o]):
        return None
    head = follow(p[1:4], o + 1, False)
    for at in range(head + skip, min(len(g), head + middle + 1)) if head is not None else ():
        if ok(p[4], g[at]) and (tail := follow(p[5:8], at + 1, True)) is not None:
            return tail
    return None


def test_two_anchors_equal_the_model():
    import re

    r = random.Random(6)
    for probe in ("acgtacgt", "aacctcca", "gatacatt"):
        e, found = re.compile(S.two_anchors(probe)), 0
        for _ in range(3000):
            g = "".join(r.choice("acgt" if r.random() < 0.5 else probe) for _ in range(r.randint(1, 24)))
            m, want = e.match(g[: S.anchor_reach()]), model_blat(probe, g, 0)
            assert (m is None) == (want is None) and (m is None or m.end() == want)
            found += m is not None
        assert found > 5
    assert S.two_anchors("acgt") is None
    assert K.anchor_rows("acgtacgt", "acgtgggacgtaaa") == ("acgt---acgt", "acgtgggacgt", "****...****")
    assert K.anchor_rows("acgtacgt", "acgtacgtaa") is None  # three bases are always passed over


@pytest.mark.parametrize("engine", ["arrow", "columns"])
def test_search_by_two_anchors(spark, engine):
    r = random.Random(9)
    genomes = [(str(i), "".join(r.choice("acgt") for _ in range(n))) for i, n in enumerate((5, 30, 400, 900))]
    genomes.append(("x", "acgt" + "ggg" + "acg"))
    df = spark.createDataFrame(genomes, "accession string, dna string")
    comp = str.maketrans("acgt", "tgca")
    want = set()
    for acc, dna in genomes:
        for strand, g in (("+", dna), ("-", dna.translate(comp)[::-1])):
            want |= {(acc, strand, o) for o in range(len(g) - 7) if model_blat("acgtacgt", g, o) is not None}
    got = Q.search([("p", "acgtacgt")], df, {"blat": 1.0}, top_k=10_000, distance=1, engine=engine, chunk=64, render=True).collect()
    assert {(x.accession, x.strand, x.offset) for x in got} == want and len(want) > 3
    assert all(x.renderings[0].kind == "blat" and x.renderings[0].window is not None for x in got)


def test_one_pass_over_many_probes(spark, monkeypatch):
    monkeypatch.setattr(Q, "PROBES", 2)
    r = random.Random(3)
    genomes = [("g", "".join(r.choice("acgt") for _ in range(700))), ("h", "acg")]
    df = spark.createDataFrame(genomes, "accession string, dna string")
    probes = [(f"p{i}", w) for i, w in enumerate(words(r, 3, 5) + words(r, 3, 8) + ["a"])]
    for options, weights in ((S.Options(mismatch_limit=2), {"textedit": 1.0}), (S.Options(must=((0, 2),), optional=((3, 1),)), {"pattern": 1.0, "direct": 2.0})):
        rows = {}
        for engine in ("arrow", "columns"):
            got = Q.search(probes, df, weights, options, top_k=6, distance=3, engine=engine, chunk=50, render=True).collect()
            rows[engine] = sorted((x.name, x["rank"], x.accession, x.strand, x.offset, x.weighted, x.window, str(x.renderings)) for x in got)
        assert rows["arrow"] == rows["columns"] and len({x[0] for x in rows["arrow"]}) == len(probes)
    twice = Q.search([("p", "a"), ("p", "gg")], df, {"direct": 1.0}, top_k=3, render=True).collect()
    assert sorted((x.nth, x["rank"]) for x in twice) == [(n, k) for n in (0, 1) for k in (1, 2, 3)] and {x.probe for x in twice} == {"a", "gg"}
    every = Q.search([("p", "a")], df, {"direct": 1.0}, top_k=None, distance=1)
    assert "rank" not in every.columns and every.count() == sum(g.count("a") + g.count("t") for _, g in genomes)


@pytest.mark.parametrize("engine", ["arrow", "columns"])
def test_suppression_by_parts(spark, engine):
    r = random.Random(7)
    dna = "".join(r.choice("acgt") for _ in range(200))
    df = spark.createDataFrame([("g", dna), ("s", dna[:20])], "accession string, dna string")
    got = Q.search([("p", "gat")], df, {"direct": 1.0}, top_k=10_000, distance=3, engine=engine, chunk=16, compat=True).collect()
    comp, want = str.maketrans("acgt", "tgca"), set()
    for acc, g in (("g", dna), ("s", dna[:20])):
        part = len(g) // 32 or len(g)
        for strand, s in (("+", g), ("-", g.translate(comp)[::-1])):
            score = [model_direct("gat", s[o : o + 3]) for o in range(len(s) - 2)]
            for o, v in enumerate(score):
                near = [score[i] for i in range(max(0, o - 2), min(len(score), o + 3)) if i // part == o // part]
                if v > 0 and v == max(near):
                    want.add((acc, strand, o))
    assert {(x.accession, x.strand, x.offset) for x in got} == want


def test_chunks_are_linear_and_whole(spark):
    dna = "acgt" * 600_000
    df = spark.createDataFrame([("g", dna)], "accession string, dna string").withColumn("strand", F.lit("+"))
    cut = Q.chunks(df, 8, 4, 4096)
    assert cut.agg(F.sum("cores")).first()[0] == len(dna) - 7
    bad = cut.where(F.col("piece") != F.expr("substring(repeat('acgt', 3000), int(at % 4) + 1, length(piece))"))
    assert bad.count() == 0 and cut.agg(F.max(F.length("piece"))).first()[0] <= 4096 + 4 + 11


def test_pattern_compiler():
    p = S.compile_pattern("gatacatt", [(0, 3), (-2, 2)], [(4, 1)])
    assert p.must == "^gat.+tt$" and p.must_score == 5
    assert p.optional == (("^gat.+(c|t).+tt$", 1),)
    assert S.compile_pattern("gatacatt", [(3, 2), (5, 1)]).must == ".+a(c|t)a.+"


def test_composition_prefilter(spark):
    row = spark.range(1).select(
        D.can_skip(F.lit("AAAATTTAA"), F.lit("AAATTTTGG"), 3).alias("a"), D.can_skip(F.lit("AAAATTTAA"), F.lit("AAATTTTGG"), 8).alias("b")
    ).first()
    assert (row.a, row.b) == (False, True)


def test_registry_and_weights():
    assert S.similarity_name("text_distance") == "textedit"
    with pytest.raises(ValueError):
        S.similarity_name("char_match")
    with pytest.raises(ValueError):
        S.positive_weights({"direct": 0})
    assert list(S.positive_weights({"direct": 2, "text": 1, "pat": 0})) == ["textedit", "direct"]


def brute_search(genomes, probe, score, k, d):
    out = []
    comp = str.maketrans("acgt", "tgca")
    for acc, dna in genomes:
        for strand, s in (("+", dna), ("-", dna.translate(comp)[::-1])):
            sc = [score(probe, s[o : o + len(probe)]) for o in range(len(s) - len(probe) + 1)]
            for o, v in enumerate(sc):
                if v > 0 and v == max(sc[max(0, o - d + 1) : o + d]):
                    a, b = (o + 1, o + len(probe)) if strand == "+" else (len(s) - o, len(s) - o - len(probe) + 1)
                    out.append((-v, acc, strand, o, a, b))
    return sorted(out)[:k]


@pytest.mark.parametrize("engine", ["arrow", "columns"])
@pytest.mark.parametrize("chunk", [7, 4096])
def test_search_is_independent_of_chunks(spark, engine, chunk):
    r = random.Random(5)
    genomes = [(str(i), "".join(r.choice("acgt") for _ in range(n))) for i, n in enumerate((0, 3, 20, 61, 150))]
    df = spark.createDataFrame(genomes, "accession string, dna string")
    got = Q.search([("p", "GAtaca")], df, {"direct": 1.0}, top_k=15, distance=4, engine=engine, chunk=chunk).orderBy("rank").collect()
    want = brute_search(genomes, "gataca", model_direct, 15, 4)
    assert [(-x.weighted, x.accession, x.strand, x.offset, x.start, x.end) for x in got] == want


@pytest.mark.parametrize("name,score", [("textedit", model_edit), ("consistency", lambda p, w: model_consistency(p, w, 1))])
def test_engines_agree(spark, name, score):
    r = random.Random(8)
    genomes = [("g", "".join(r.choice("acgt") for _ in range(90)))]
    df = spark.createDataFrame(genomes, "accession string, dna string")
    o = S.Options(patience=1)
    for engine in ("arrow", "columns"):
        got = Q.search([("p", "gatcca")], df, {name: 1.0}, o, top_k=8, distance=3, engine=engine).orderBy("rank").collect()
        assert [(-x.weighted, x.accession, x.strand, x.offset, x.start, x.end) for x in got] == brute_search(genomes, "gatcca", score, 8, 3)


def test_best_submatches_repeat_after_the_best(spark):
    df = spark.createDataFrame([("x", 10, 17, "**-*.*--", 3.0), ("y", 20, 13, ".***....", 3.0)], "id string, start int, end int, marks string, score double")
    got = sorted(map(tuple, Q.best_submatches(df).collect()))
    assert got == [("x", 1, 4, 10, 13), ("y", 2, 4, 19, 17)]


def test_prefilter_table(spark):
    f = lambda w, n, p=None: spark.range(1).select(D.can_skip(F.lit("AAAATTTAA"), F.lit(w), n, p)).first()[0]
    assert not f("AAATTTTGG", 3)
    assert not f("AAATTTTGG", 3, ".*AA.*GG.*")
    assert f("AAATTTTGG", 3, ".*AA.*AA")


# The scan, kernels and seeds ---------------------------------------------------------------------


@pytest.mark.parametrize("m", [1, 2, 9, 31, 64, 65, 66, 130])
def test_bits_equal_edit_tables(m):
    r = random.Random(m)
    probe = words(r, 1, m)[0]
    near = ["".join(r.choice("acgt") if r.random() < 0.1 else x for x in probe) for _ in range(20)]
    rows = words(r, 20, m) + near + [x[1:] + r.choice("acgt") for x in near]
    letters = K.letters_of(rows)
    table = K.edit_tables(K.matching(probe, letters))[:, m, m]
    assert K.text_edit_scores(probe, letters).tolist() == (m - table).tolist()
    assert K.text_edit_scores(probe, letters[:3]).tolist() == [model_edit(probe, w) for w in rows[:3]]


@pytest.fixture(scope="module")
def mixed_genomes(spark):
    r = random.Random(5)
    sizes = [0, 3, 7, 8, 9, 12, 33, 64, 100, 300, 700, 5000]
    rows = [(f"g{i:02d}", "".join(r.choice("acgt") for _ in range(n))) for i, n in enumerate(sizes)]
    rows += [("poly", "acgtacgt" * 300), ("same", "t" * 900)]
    return spark.createDataFrame(rows, "accession string, dna string")


def listed(found):
    return sorted((r.name, r.accession, r.strand, r.offset, r.weighted, r.window, r["rank"] if "rank" in found.columns else 0, tuple(sorted(r.scores.items()))) for r in found.collect())


@pytest.mark.parametrize("k,ascending,per_genome", [(3, False, False), (3, True, False), (40, False, False), (2, False, True), (None, False, False)])
def test_best_of_tasks_are_the_best_of_all(spark, mixed_genomes, monkeypatch, k, ascending, per_genome):
    monkeypatch.setattr(Q, "LETTERS", 2000)
    probes, weights = [("a", "gatacatt"), ("b", "tttttttt"), ("a", "acgtacgtacgt")], {"direct": 1.0, "textedit": 1.0, "consistency": 2.0}
    rows = mixed_genomes.repartition(5)
    got = [listed(Q.search(probes, rows, weights, S.Options(patience=1), top_k=k, ascending=ascending, per_genome=per_genome, chunk=c, engine=e)) for c, e in ((64, "arrow"), (4096, "arrow"), (4096, "columns"))]
    assert got[0] == got[1] == got[2] and got[0]


def test_a_task_gives_its_best_only(spark, mixed_genomes):
    both = Q.strands(mixed_genomes)
    given, k = [("a", "tttttttt"), ("b", "gatacatt")], 4
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = Q._search_arrow(given, both, {"direct": 1.0}, S.Options(), 5, 64, 0, False, k)
    assert rows.rdd.getNumPartitions() == tasks and rows.count() <= tasks * len(given) * k < Q._search_arrow(given, both, {"direct": 1.0}, S.Options(), 5, 64, 0, False).count()


def test_registered_similarities_in_both_engines(spark, mixed_genomes):
    def pairs(probe, letters, o):  # places where a letter and the next one match
        good = K.matching(probe, letters).diagonal(axis1=1, axis2=2)
        return (good[:, 1:] & good[:, :-1]).sum(axis=1)

    S.register_similarity("pairs_by_kernel", kernel=pairs)
    S.register_similarity("ends_by_column", lambda p, w, o: F.when(F.substring(w, 1, 1) == p[0], 1.0).otherwise(0.0))
    try:
        for weights in ({"pairs_by_kernel": 1.0}, {"ends_by_column": 1.0}, {"pairs_by_kernel": 1.0, "direct": 2.0, "ends_by_column": 0.5}):
            got = [listed(Q.search([("p", "gatacatt")], mixed_genomes, weights, top_k=30, engine=e)) for e in ("arrow", "columns")]
            assert got[0] == got[1] and len(got[0]) == 30
        with pytest.raises(ValueError, match="a builder or a kernel"):
            S.register_similarity("nothing")
    finally:
        for name in ("pairs_by_kernel", "ends_by_column"):
            S._registry.pop(name), S._kernels.pop(name, None), S.SIMILARITY_ALIASES.pop(name)


@pytest.mark.parametrize("weights,least,patience", [({"direct": 1.0}, 10, 0), ({"consistency": 1.0}, 8, 2), ({"consistency": 1.0}, 9, 0), ({"textedit": 1.0}, 10, 0), ({"direct": 1.0, "textedit": 3.0, "consistency": 1.0}, 9.5, 1)])
def test_seeds_find_what_a_scan_of_all_windows_finds(spark, mixed_genomes, tmp_path, weights, least, patience):
    r = random.Random(8)
    probes = [("a", "gatacattgaca"), ("b", "tttttttttttt"), ("c", "acgtacgtacgtacg")]
    planted = [("plant", "".join("".join(r.choice("acgt") if r.random() < 0.12 else x for x in r.choice(probes)[1]) + "".join(r.choices("acgt", k=9)) for _ in range(400)))]
    genomes = mixed_genomes.unionByName(spark.createDataFrame(planted, "accession string, dna string"))
    o = S.Options(patience=patience)
    q = E.gram_size(probes, list(S.positive_weights(weights)), least, o)
    path = E.write_index(genomes, str(tmp_path / "index"), q, 15)
    for k in (None, 25):
        want = Q.search(probes, genomes, weights, o, top_k=k, min_similarity=least)
        assert listed(E.seed_search(spark, path, probes, weights, least, q, o, top_k=k)) == listed(want) != []
    with pytest.raises(ValueError, match="whole run"):
        E.seed_search(spark, path, probes, weights, 1, q, o)
    with pytest.raises(ValueError, match="no seeds"):
        E.seed_search(spark, path, probes, {"blat": 1}, 1, q, o)


def test_seeds_score_few_windows(spark, tmp_path):
    r = random.Random(9)
    genomes = spark.createDataFrame([("g", "".join(r.choices("acgt", k=60_000)))], "accession string, dna string")
    for weights, m, least in (({"direct": 1.0}, 20, 17), ({"textedit": 1.0}, 20, 18), ({"consistency": 1.0}, 16, 10)):
        probes = [(str(i), "".join(r.choices("acgt", k=m))) for i in range(5)]
        q = E.gram_size(probes, list(weights), least)
        path = E.write_index(genomes, str(tmp_path / f"index{m}{least}"), q, m)
        found = E.candidates(spark, path, probes, list(weights), least, q)
        assert found.count() < 0.1 * len(probes) * 2 * (60_000 - m + 1)


def test_a_gap_between_blocks_hides_no_better_window(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 4)
    rows = [(0, "g", "+", i, w) for i, w in enumerate([1, 2, 3, 2, 2, 2, 5, 1, 1, 1, 1, 1, 4, 4])]
    frame = spark.createDataFrame(rows, "nth int, accession string, strand string, offset int, weighted int")
    want = [i for i in range(len(rows)) if rows[i][4] == max(x[4] for x in rows[max(0, i - 2) : i + 3])]
    assert sorted(r.offset for r in E.peaks(frame, 3).collect()) == want


def test_postings_of_one_gram_are_many_tasks_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "PARTS", 2, raising=False)
    genomes = spark.createDataFrame([(str(i), "a" * 5000) for i in range(20)], "accession string, dna string")
    path = E.write_index(genomes, f"{tmp_path}/index", 4, 8)
    files = spark.read.parquet(f"{path}/grams").where("gram = 0").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 10 and max(r["count"] for r in files) <= 8
    found = E.candidates(spark, path, [("p", "aaaaaaaa")], ["direct"], 8, 4)
    assert found.count() == 20 * 4997 and "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_short_edit_scores_are_looked_up(spark):
    """Scores of a short probe with c are looked up in generated code, and are those of the kernel, also for other letters."""
    ws = ["".join(w) for w in itertools.product("acgtn", repeat=4)]
    df = spark.createDataFrame([(w,) for w in [*ws, None]], "w string").repartition(2)
    for probe in ("gcac", "cccc", "tgca"):
        scored = df.select("w", S.text_edit(probe, F.col("w")).alias("e"))
        assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
        assert {x.w: x.e for x in scored.collect()} == dict(zip(ws, K.text_edit_scores(probe, K.letters_of(ws)).tolist())) | {None: None}
