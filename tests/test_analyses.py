import pytest
from pyspark.sql import functions as F

from seqloom.plans import analyses as A


@pytest.fixture(scope="module")
def world(spark):
    dna = "aaccggtt" * 10
    genomes = spark.createDataFrame([("c1", "Some bug strain", dna, len(dna))], "accession string, source string, dna string, length long")
    segs = [("c1", 0, 5, 20, "one", "p1"), ("c1", 1, 30, 40, "two", None), ("c1", 2, 50, 60, "six", "p6")]
    segments = spark.createDataFrame(segs, "accession string, seg_id long, seg_left long, seg_right long, gene string, product string")
    return dna, genomes, segments


def rc(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def test_neighbours(spark, world):
    dna, genomes, segments = world
    hits = spark.createDataFrame([("c1", 22, 28), ("c1", 45, 35), ("zz", 1, 2)], "accession string, start long, end long")
    out = A.neighbor_analysis(hits, segments.drop("product"), genomes)
    rows = {x.start: x for x in out["neighbors"].collect()}
    assert [g.gene for g in rows[22].genes] == ["one", "two"] and rows[22].sequence == dna[21:28]
    assert [g.gene for g in rows[45].genes] == ["one", "two", "six"] and rows[45].sequence == rc(dna[34:45])
    assert sorted(str(x.next_gene) for x in out["next"].collect()) == ["one", "two"]
    assert [(x.value, x.n, round(x.percent, 2)) for x in out["source_counts"].collect()] == [("Some", 2, 100.0)]
    assert [x.line for x in out["errors"].collect()] == [">zz/1-2"]
    assert sum(x.n for x in out["gene_counts"].collect()) == 2


def test_extraction(spark, world):
    dna, genomes, segments = world
    wanted = spark.createDataFrame([("two",), ("none",)], "gene string")
    found, lost = A.gene_extract(segments, genomes, wanted)
    assert [x.sequence for x in found.collect()] == [dna[29:40]] and [x.gene for x in lost.collect()] == ["none"]
    table = spark.createDataFrame([("a", "given", "3", "6"), ("b", "", "6", "3"), ("c", None, "4", "4")], "n string, sequence string, p string, g string")
    got = {x.n: x.sequence for x in A.range_extract(table, spark.createDataFrame([(dna,)], "dna string")).collect()}
    assert got == {"a": "given", "b": rc(dna[3:6]), "c": ""}
    f = A.gene_flanks(segments, genomes, spark.createDataFrame([("two->shown", 40, 30), ("one", 1, 2)], "gene string, map_start_pos long, map_end_pos long"), 6).collect()
    assert [(x.gene, x.upstream, x.downstream, x.stream) for x in f] == [("shown", rc(dna[40:46]), rc(dna[23:29]), rc(dna[29:40]))]
    regions = A.gene_range_extract(segments, genomes).where("kind = 'gap'").orderBy("left").collect()
    assert [(x.left, x.right) for x in regions] == [(1, 4), (21, 29), (41, 49), (61, 80)]


def test_ranges_near_genes(spark, world):
    dna, genomes, segments = world
    q = spark.createDataFrame([("r", 39, 31, "c1:31-39(-)")], "name string, start long, end long, locus string")
    (x,) = A.near_gene_report(q, segments, genomes).where("type = 'include'").collect()
    assert (x.gene, x.length, x.compare_length, x.sequence) == ("two", 9, 9, rc(dna[29:40]))
    t = spark.createDataFrame([("DR1", "c1:30-40(+)"), ("x", "c1:1-4(-)"), ("DR2", "bad")], "Gene string, Locus string")
    got = {x.Gene: (x.sequence, x.hit) for x in A.gentamycin(t, segments, genomes).collect()}
    assert got["DR1"] == (dna[29:40], "two") and got["x"] == (rc(dna[:4]), "") and got["DR2"] == (None, "")
    tags = spark.createDataFrame([("n", '{"a": "acg", "b": "t"}')], "name string, sequences string")
    assert sorted(map(tuple, A.consistency_table(tags).collect())) == [("n-a", "acg"), ("n-b", "t")]


def test_enrichment(spark):
    genes = spark.createDataFrame([("thrA->A",), ("zzz",)], "gene string")
    pg = spark.createDataFrame(
        [
            ("gene", "thrA", "<a href='/gene?orgid=ECOLI&id=EG7'>thrA</a>"),
            ("tu", "EG7", "<table><tr><td>Enzyme</td><td>kinase</td></tr><tr><td>Protein</td><td>prot</td></tr></table>"),
            ("summary", "EG7", "<h3>Summary</h3>text<p class='ecoparagraph'>"),
            ("go", "EG7", "<table class='g'><tr><td>Process:</td><td><table><tr><td>x</td><td><a>t1</a></td></tr></table></td></tr></table>"),
        ],
        "kind string, key string, body string",
    )
    ok, bad = A.ecocyc_analysis(genes, pg, get_summary=True, get_go=True)
    (x,) = ok.collect()
    assert (x.id, x.gene, x.product_type, x.summary, x.go) == ("EG7", "thrA->A", "protein", "text", "Process=t1")
    assert [y.gene for y in bad.collect()] == ["zzz"]
    counts = A.search_counts(genes.select(F.lit("g").alias("name")).distinct(), ["a", "b"], spark.createDataFrame([("g", "a", '<div class="results-amount">\n1,204\n')], "name string, keyword string, body string"))
    assert [tuple(r) for r in counts.collect()] == [("g", 1204, 0)]


def test_layout(spark):
    body = '{"links": [["1","l","0","0","5","9","<b>Promoter</b>: P1<BR>Tr.Start site: 1,000"],["2","l","10","0","20","9","Gene: abc<BR>Location: 1,100 -> 1,900"],["3","l"]]}'
    items = A.layout_items(spark.createDataFrame([("d", body)], "diagram string, body string"), "abc")
    from seqloom.operators.promoters import best_promoter

    assert [tuple(r) for r in best_promoter(items).collect()] == [("d", "P1", 1100, 1000)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_layouts_are_read_once(spark):
    """Attributes of an item are made of its text once, and promoters of one reading of the layouts; diagrams without a target stay."""
    from seqloom.operators import promoters as P

    texts = ["<b>Gene</b>: a b<BR><b>Location</b>: 5 -> 9", "Gene: x<br> Gene : y:z<BR>none", "no pair", "", ":", None]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(P.attributes("t").alias("m"))
    assert [x.m for x in made.collect()] == [{"Gene": "a b", "Location": "5 -> 9"}, {"Gene": "y:z"}, {"Body": "no pair"}, {"Body": ""}, {"": ""}, {"Body": None}]
    assert plan(made).count("</?b>") == 1
    item = lambda i, text: f'["{i}","l","{i * 10}","0","{i * 10 + 5}","9","{text}"]'
    gene, start = "Gene: g%d<BR>Location: %d -> 900", "Promoter: P%d<BR>Tr.Start site: %d"
    bodies = [("one", item(1, start % (1, 7)) + "," + item(2, gene % (2, 20)) + "," + item(3, gene % (3, 30))), ("none", item(1, gene % (3, 5))), ("other", item(1, start % (4, 40)) + "," + item(2, gene % (9, 50)))]
    items = A.layout_items(spark.createDataFrame([(d, '{"links": [' + b + "]}") for d, b in bodies], "diagram string, body string"), "g3")
    best, every = A.promoters_of(items), A.promoters_of(items, False)
    assert plan(best).count("posexplode") == plan(every).count("posexplode") == 1 and "Join" not in plan(best) + plan(every)
    lost = ("Not Found",) * 4
    assert {x.diagram: tuple(x)[1:] for x in best.collect()} == {"one": ("Found", "20", "P1", "7"), "none": lost, "other": lost}
    assert {x.diagram: tuple(x)[1:] for x in every.collect()} == {"one": ("Found", "Not Found", "P1", "7"), "none": lost, "other": ("Found", "Not Found", "P4", "40")}


def test_pages_are_parsed_once(spark):
    """Results and errors come from one reading of the pages that name what is wanted."""
    pages = spark.createDataFrame([("gene", "a", "<a href='/gene?orgid=ECOLI&id=E1'>a</a><b>KEGG ORTHOLOGY</b><a href='/e'>K1</a>"), ("pathway", "K1", "<nobr>Name</nobr><td>n</td>"), ("url", "E1", "<table><tr><td>Gene</td><td>g</td></tr></table>")], "kind string, key string, body string")
    ok, lost = A.kegg_analysis(spark.createDataFrame([("a",), ("z",)], "id string"), pages)
    assert "UDF" not in plan(ok) + plan(lost) and [tuple(x) for x in ok.collect()] == [("a", "K1", "n", "No Pathway")] and [x.id for x in lost.collect()] == ["z"]
    ok, lost = A.ecocyc_analysis(spark.createDataFrame([("a",), ("z",)], "gene string"), pages)
    assert "gene_id" not in plan(lost) and "UDF" not in plan(lost) and [x.gene for x in lost.collect()] == ["z"] and [x.id for x in ok.collect()] == ["E1"]
    ok, lost = A.url_list_analysis(spark.createDataFrame([("<a href='/g?id=E1'>x</a><a href='/g?id=E2'>y</a>",)], "body string"), pages)
    assert "UDF" not in plan(ok) + plan(lost) and [x.gene for x in ok.collect()] == ["g"] and [x.key for x in lost.collect()] == ["E2"]
    assert A._dealt(pages.coalesce(1)).rdd.getNumPartitions() == 4


def brute_label(a, b, x, y, plus):
    """As the records' ends are reached over, from the left first."""
    if y < a or x > b:
        return "inter-genic"
    if x < a:
        return "5'" if plus else "3'"
    if y > b:
        return "3'" if plus else "5'"
    return "cds"


def test_labels_of_all_overlaps(spark):
    from seqloom.operators import intervals as I

    rows = [(a, b, x, y, d) for a in range(1, 5) for b in range(a, 5) for x in range(0, 6) for y in range(x, 6) for d in "><"]
    df = spark.createDataFrame(rows, "a long, b long, x long, y long, d string")
    for r in df.withColumn("l", I.location_label(I.classify("a", "b", "x", "y"), "d")).collect():
        assert r.l == brute_label(r.a, r.b, r.x, r.y, r.d == ">")


def test_location_files(spark, tmp_path):
    """From a search result's file to both location files and the flat table."""
    (tmp_path / "r.txt").write_text(
        "(1)\n>NC1/10-17\tname=p,direction=+,weighted_similarity=3.00,consistency_similarity=3.00,original      :=gattacat,consistency_match_format  :=***.-**.\nmore\n\n(2)\n>NC1/200-193\tname=q,direction=-,weighted_similarity=1.00\n\n"
    )
    (tmp_path / "g.tsv").write_text("gene\tproduct\tmap_start_pos\tmap_end_pos\tpromoter_name\tpromoter_pos\tgene_start_pos\ttype\nabc\tprod\t12\t40\tP1\t2\t12\tt1\nabc\tlater\t90\t60\t\t\t\tt2\n")
    out = A.gene_location_analysis(spark, str(tmp_path / "r.txt"), str(tmp_path / "g.tsv"), str(tmp_path / "o"), output_promoter=True)
    rows = {x.rec: x for x in out["location"].collect()}
    assert [t.split("\n")[0] for t in rows[1].locations] == ["3' of P1", "5' of abc"] and rows[2].locations == ["inter-genic of abc, None"]
    assert rows[1].locations[1].split("\n")[1:] == ["original direction  : >>>>>>>>>>", "intersect direction : ***>>>>>>>", "12-40\tgene=abc\tproduct=prod"]
    (sub,) = out["sub_location"].collect()
    assert (sub.sub_left, sub.sub_right, sub.start, sub.end, sub.values["consistency_match_format  :"]) == (1, 3, 10, 12, "***")
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "o" / "r_sub_location_result.txt").glob("part-*")))
    assert text.startswith("(1-1)\n>NC1/10-12\nOriginal Position\t1\t3\nname\tp\n") and "\n>>>>>>>>>>\nmore\n" in text
    matches, table = A.match_rows(A.X.lines(spark, str(tmp_path / "r.txt"))), A.X.table(spark, str(tmp_path / "g.tsv"))
    flat = {(x["index"], x.gene_name): x for x in A.location_tsv(matches, table, 1).collect()}
    assert flat["1", "abc"].location == "antisense 5'utr" and flat["1", "abc"].type == "t2" and flat["1", "abc"]["location end 1"] == 3 and flat["2", "abc,None"].location == "inter genic"
    wanted = spark.createDataFrame([("ABC",)], "name string")
    assert [x.rec for x in A.gene_locations(matches, table, wanted=wanted, process_sub_data=False)["location"].collect()] == [1]
    assert A.gene_locations(matches, table, filter_sub_span=(0, 0))["sub_location"].count() == 0


def test_sweeps_over_cells(spark, monkeypatch):
    """Ranks, neighbours and gaps with cells of a few positions equal those of one sweep."""
    import random

    from seqloom.operators import intervals as I

    r = random.Random(21)
    segs = [("a" if i % 3 else "b", i, x := r.randrange(400), x + r.randrange(30), f"g{i}") for i in range(80)]
    segs = [(acc, k, *x[2:]) for k, (acc, x) in enumerate(sorted(((s[0], s) for s in segs), key=lambda t: (t[0], t[1][2])))]
    s = spark.createDataFrame(segs, "accession string, seg_id long, seg_left long, seg_right long, gene string")
    q = spark.createDataFrame([(i, r.choice("abc"), x := r.randrange(-5, 450), x + r.randrange(60)) for i in range(120)], "qid long, accession string, left long, right long")
    lengths = spark.createDataFrame([("a", 500), ("b", 500), ("c", 9)], "accession string, length long")

    def every():
        return [
            sorted(map(str, f.collect()))
            for f in (
                I.lower_bound(q, s.select("accession", F.col("seg_left").alias("start")), ("accession",), "left"), I.ranked(s, ("accession",)), I.nearest(q, s, ("accession",)), I.nearest(q, s, ("accession",), strict=False), I.nearest(q, s), I.ranked(s),
                I.gaps(s, lengths), I.gaps(s, lengths, compat=True), I.nearby_genes(q, s, ("accession",)).drop("query_row"), I.with_sequence(q, lengths.select("accession", F.repeat(F.lit("acgtt"), F.lit(90)).alias("dna")), "left", "right", F.col("qid") % 2 == 0),
            )
        ]

    whole = every()
    monkeypatch.setattr(I, "SWEEP", 16)
    monkeypatch.setattr(I, "PART", 7)
    assert every() == whole
    dna = "acgtt" * 90
    by = {(x.accession, x.left, x.right, x.qid): x.sequence for x in I.with_sequence(q, spark.createDataFrame([("a", dna), ("b", dna)], "accession string, dna string"), "left", "right").collect()}
    assert len(by) == sum(x.accession != "c" for x in q.collect()) and all(v == dna[max(a, 1) - 1 : max(b, 0)] for (_, a, b, _), v in by.items())


def test_streams(spark, tmp_path, world):
    from seqloom.streaming.hits import locate_stream

    _, _, segments = world
    spark.createDataFrame([("c1", 1, 6), ("c1", 70, 75)], "accession string, left long, right long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("accession string, left long, right long").parquet(str(tmp_path / "in"))
    q = locate_stream(stream, segments).writeStream.format("memory").queryName("located").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert [(x.gene, x.klass) for x in spark.sql("select gene, klass from located").collect()] == [("one", "IntersectLeft")]
    finally:
        q.stop()


FLAT = """SOURCE      Some bug
FEATURES             Location/Qualifiers
     gene            5..10
                     /gene="abc"
                     /locus_tag="t1"
     CDS             5..10
                     /product="one"
                     /db_xref="GeneID:42"
     gene            complement(20..25)
                     /gene="def"
                     /locus_tag="t2"
ORIGIN
        1 acgttacgga ccatgacgtt aaccggttac
//
"""


def read_text(path):
    from pathlib import Path

    return "".join(f.read_text() for f in sorted(Path(path).glob("part-*")))


def test_files(spark, tmp_path):
    """Each analysis from its input files to the text it leaves."""
    from seqloom.plans import files as T

    data, out = tmp_path / "g", str(tmp_path / "o")
    data.mkdir()
    (data / "c1.gb").write_text(FLAT)
    dna = "acgttacggaccatgacgttaaccggttac"

    def given(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    got = T.neighbours(spark, given("hits.txt", ">c1/12-15\tk=v\n>zz/1-2\nnot a hit\n"), str(data), out)
    assert read_text(got["neighbor"]) == ">c1/12-15(+)\nk\tv\nSOURCE\tSome bug\n5-10\tabc\n20-25\tdef\nsequence\tcatg\n\n"
    assert read_text(got["next_neighbor"]) == ">c1/12-15(+)\nSOURCE\tSome\n20-25\tdef\n\n" and read_text(got["error"]) == ">zz/1-2\n"
    assert read_text(got["gene_count"]) == "def\t1\t100.0000%\n" and read_text(got["source_count"]) == "Some\t1\t100.0000%\n"
    got = T.extracts(spark, str(data), given("names.txt", "def\nnone\n abc\n"), out)
    assert read_text(got["extract"]).split("\n")[:3] == ["No\tgene\tfrom\tend\tproduct\tsequence", f"d1\tdef\t20\t25\t\t{dna[19:25]}", f"d3\tabc\t5\t10\tone\t{dna[4:10]}"] and read_text(got["missing"]) == "none\n"
    got = T.extracts(spark, str(data), given("ranges.tsv", "id\tsequence\tpromoter_pos\tgene_start_pos\na\t\t3\t6\nb\tx\t1\t2\nc\t\t6\t3\n"), out, "range")
    assert [x.split("\t") for x in read_text(got["extract"]).strip().split("\n")[1:]] == [["a", dna[2:5], "3", "6"], ["b", "x", "1", "2"], ["c", rc(dna[3:6]), "6", "3"]]
    got = T.streams(spark, str(data), given("flank.tsv", "gene\tmap_start_pos\tmap_end_pos\ndef->D\t25\t20\n"), out, limit=3)
    assert read_text(got["stream_3"]) == f"1. D\n1)\nposition\t20 <- 25\nproduct\t\nGeneID\t\nstream\t{rc(dna[19:25])}\nupstream\t{rc(dna[25:28])}\ndownstream\t{rc(dna[16:19])}\n\n"
    got = T.streams(spark, str(data), given("inter.txt", "12,15\n\n1,2\n"), out, mode="inter")
    assert read_text(got["gene"]) == "12,15:\nup-gene\tabc\nup-position\t5-10\nup-product\tone\ndown-gene\tdef\ndown-position\t20-25\ndown-product\tNone\n\n1,2:\ndown-gene\tabc\ndown-position\t5-10\ndown-product\tone\n\n"
    got = T.regions(spark, str(data), out)
    assert read_text(got["range"]) == "name\trange\tlocus_tag\nregion_1\t1-4\ngene_1\t5-10\tt1\nregion_2\t11-19\ngene_2\t20-25\tt2\nregion_3\t26-30\n"
    got = T.near_genes(spark, given("near.tsv", "name\tstart\tend\tlocus\nq\t9\t6\tc1:6-9(-)\n"), str(data), out)
    assert read_text(got["near_gene"]).split("\n")[1] == f"q\tabc\tinclude\t5\t10\t4\t4\t{rc(dna[4:10])}"
    got = T.loci(spark, given("loci.tsv", "Gene\tLocus\nDR1\tc1:5-10(+)\nx\tc1:1-4(-)\n"), str(data), out)
    assert read_text(got["gentamycin"]).split("\n")[1:3] == [f"DR1\tc1:5-10(+)\t{dna[4:10]}\tabc\t", f"x\tc1:1-4(-)\t{rc(dna[:4])}\t\t"] and read_text(got["gentamycin_consistency"]).startswith(f"name\tgene\nDR1\t{dna[4:10]}\n")
    pages = spark.createDataFrame([("pathway", "K1", "<nobr>Name</nobr><td>n1</td>"), ("gene", "abc", "<a href='/gene?orgid=ECOLI&id=EG7'>abc</a>"), ("tu", "EG7", "<table><tr><td>Protein</td><td>prot</td></tr></table>")], "kind string, key string, body string")
    got = T.pathways(spark, given("ids.txt", "K2\nK1\n"), pages, out, is_gene=False)
    assert read_text(got["kegg"]) == "K1\tK1\tn1\tNo Pathway\n" and read_text(got["kegg_error"]) == "K2\n"
    got = T.gene_lists(spark, given("list.tsv", "gene\tproduct_type\tproduct\tnote\nzzz\t\t\tn\nabc\t\t\tkept\n"), pages, out)
    assert read_text(got["ecocyc"]) == "gene\tproduct_type\tproduct\tnote\nzzz\tNot Found\nabc\tprotein\tprot\tkept\n" and read_text(got["ecocyc_error"]) == "zzz\n"
    found = spark.createDataFrame([("abc", "drug", '<div class="results-amount">\n1,204\n')], "name string, keyword string, body string")
    got = T.search_matrix(spark, given("genes.txt", "gene\nzzz\nabc\n"), ["drug", "a+b"], found, out)
    assert read_text(got["count"]) == "gene\tdrug\ta+b\nzzz\t0\t0\nabc\t1204\t0\n"
