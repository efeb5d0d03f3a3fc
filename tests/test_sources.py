import pytest
from pyspark.sql import functions as F

from seqloom.operators import promoters as P
from seqloom.plans import analyses as A
from seqloom.sources import fetch, pages, sinks
from seqloom.sources import genomes as G
from seqloom.sources import text as X

GENBANK = """LOCUS       X1
SOURCE      Invented bug
FEATURES             Location/Qualifiers
     gene            2..7
                     /gene="abc"
     CDS             2..7
                     /product="long
                     name"
                     /db_xref="GeneID:42"
                     /product="last one
     repeat_region   complement(9..12)
     gene            join(1..2,5..6)
                     /gene="no"
     gene            complement(<15..>18)
                     /gene="zed"
ORIGIN
        1 aacgttccaa cgttggcc
       19 ttaa
//
LOCUS second
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "x1.gb").write_text(GENBANK)
    (tmp_path / "x2.gb").write_text("SOURCE nothing\n//\n")
    segs = G.read_segments(spark, str(tmp_path)).orderBy("seg_id").collect()
    assert [(s.seg_left, s.seg_right, s.gene, s["product"], s.gene_id) for s in segs] == [(2, 7, "abc", "last one", 42), (9, 12, None, None, None), (15, 18, "zed", None, None)]
    assert segs[0].xref == {"GeneID": "42"}
    g = G.read_genomes(spark, str(tmp_path)).collect()
    assert [(x.accession, x.source, x.dna, x.length) for x in g] == [("x1", "Invented bug", "aacgttccaacgttggccttaa", 22)]
    assert G.read_segments(spark, str(tmp_path), repeat_regions=False).count() == 2


@pytest.mark.parametrize("size", [29, 64, 331])
def test_genbank_in_byte_ranges(spark, tmp_path, size):
    more = GENBANK.replace("//\n", "").replace("LOCUS second\n", "") + "SOURCE late\nORIGIN\n 61 acgt\r\n" * 2
    files = {"x1.gb": GENBANK, "x2.gb": "SOURCE nothing\n//\n", "x3.gb": more, "x4.txt": "", "x5.gb": GENBANK.replace("SOURCE ", "OTHER ").replace("\n", "\r\n"), "x6.gb": "\n\n" + GENBANK * 3, "x7.gb": "LOCUS\n     gene            5..9\n                     /gene=\"end"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    texts = spark.createDataFrame([(name.split(".")[0], text) for name, text in files.items()], "accession string, text string")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, str(size))
        rows = lambda df: sorted(map(repr, df.collect()))
        assert G.placed_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 1000 // size
        placed = G.placed_lines(spark, str(tmp_path)).where("accession = 'x1'").orderBy("ln").collect()
        assert [x.line for x in placed] == GENBANK.splitlines() and len({x.ln for x in placed}) == len(placed)
        for repeats in (True, False):
            assert rows(G.read_segments(spark, str(tmp_path), repeats)) == rows(G.segments_of(texts, repeats))
        assert rows(G.read_genomes(spark, str(tmp_path))) == rows(G.genomes_of(texts))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_attribute_quotes():
    assert G.parse_attribute('/product="asd') == ("product", "asd")
    assert G.parse_attribute('/product="asdasd"') == ("product", "asdasd")


def test_gene_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">lcl|2 [gene=b] [locus_tag=T2] [location=complement(9..12)] [gbkey=CDS]\nACG\nTT\n>lcl|1 [locus_tag=T1] [location=1..4]\nAC\n")
    got = [(x.seg_id, x.gene, x.seg_left, x.seg_right, x.strand, x.sequence) for x in G.read_gene_fasta(spark, str(tmp_path)).orderBy("seg_id").collect()]
    assert got == [(0, "Unknown:T1", 1, 4, "+", "ac"), (1, "b", 9, 12, "-", "acgtt")]


HITS = """head
>> hit one
  h1
  h2
  (1) ! more
 tag 1 AACC 4
 x 10 AACG
 GG 15
 y 20 aacu 23

>> hit two
  h1
  h2
  (2) ? more
 tag 1 A 1
 x 1 aacgGG 6
 y 30 aac-u 34
>> rejected
  h1
  h2
  (3) x more
"""


def test_alignments_and_clusters(spark, tmp_path):
    (tmp_path / "h.fna").write_text(HITS.replace("x 10 AACG\n GG 15", "x 10 AACGGG 15"))
    out = A.cluster_match(spark, "tag", str(tmp_path / "h.fna"), str(tmp_path / "out"))
    assert [(c.size, c.members) for c in out["cluster"].collect()] == [(2, "1,2")]
    assert [x.seq for x in out["only"].collect()] == ["aacu"]
    assert [x.letter for x in out["odd_letters"].collect()] == ["-"]
    assert (tmp_path / "out" / "h.fna_cluster_result.txt").exists()


def test_alignment_continuation():
    with pytest.raises(ValueError):
        G.parse_alignment([">> a", "b", "c", " (7) ! z", " tag 1 AC 2", " x 10 AACG", " GG 15", " y 1 u 1"], "tag")
    hit = G.parse_alignment([">> a", "b", "c", " (7) ! z", " tag 1 AC 2", " x AACG", " y 1 u 1"], "tag")
    assert hit["data"][1]["seq"] == "x AACG" and hit["data"][2]["end"] == 1
    joined = G.parse_alignment([">> a", "b", "c", " (7) ! z", " tag 1 AC 2", " x 10 AA 11", " y 1 uu 2", " tag 3 G 3", " x 12 CC 13", " y 3 u 3"], "tag")
    assert joined["data"][1] == {"name": "x", "start": 10, "end": 13, "seq": "AACC"}
    assert joined["gene_no"] == "7"


def test_record_blocks(spark, tmp_path):
    (tmp_path / "r.txt").write_text("(1)\n>NC1/5-9\tdirection=+,weighted=1.5,direct=3\nname\tp\n\n(2)\n>XX/9-5\tk=a=b\n")
    got = X.match_records(X.lines(spark, str(tmp_path / "r.txt"))).orderBy("rec").collect()
    assert [(g.accession, g.start, g.end, g["values"]) for g in got] == [("NC1", 5, 9, {"weighted": "1.5", "direct": "3"}), ("XX", 9, 5, {"k": "a=b"})]
    assert got[0].lines == ["name\tp"]


def test_reorder(spark, tmp_path):
    (tmp_path / "l.txt").write_text("(1)\na\n(2-3)\nb\n(1)\nc\n")
    (tmp_path / "i.txt").write_text("2-3\n(9)\n(1)\n")
    found, lost = A.location_reorder(spark, str(tmp_path / "l.txt"), str(tmp_path / "i.txt"))
    rows = [(x.idx, [y for y in x.lines if y]) for x in found.orderBy("pos").collect()]
    assert rows == [("(2-3)", ["b"]), ("(1)", ["c"])]
    assert [x.key for x in lost.collect()] == ["9"]


def test_neighbour_records(spark, tmp_path):
    (tmp_path / "n.txt").write_text(">A1/5-9(+)\nk\tv\nSOURCE      Some bug\n1-4\tfirst\n20-30\tsecond\n")
    x = X.neighbour_records(X.lines(spark, str(tmp_path / "n.txt"))).first()
    assert (x.accession, x.direction, x.source, [(g.left, g.gene) for g in x.genes]) == ("A1", "+", "Some bug", [(1, "first"), (20, "second")])


def test_lists(spark, tmp_path):
    (tmp_path / "r").write_text("1,5\n\n7,9\n")
    assert sorted(map(tuple, X.ranges(spark, str(tmp_path / "r")).collect())) == [(1, 5), (7, 9)]
    (tmp_path / "n").write_text("a\n b \n\n")
    assert sorted(x.name for x in X.names(spark, str(tmp_path / "n")).collect()) == ["a", "b"]


def test_pages():
    page = "<a href='/gene?orgid=ECOLI&amp;id=EG1'><i>aa</i></a> tail <a href='/x?object=O2'>two</a>"
    assert list(pages.links(page)) == [("/gene?orgid=ECOLI&id=EG1#tab=TU", "EG1", "aatail"), ("/x?object=O2#tab=TU", "O2", "two")]
    assert pages.gene_id("<a href='/gene?orgid=ECOLI&id=EG7'>thrA</a>", "thrA") == "EG7"
    assert pages.gene_id("<a href='/gene?orgid=ECOLI&id=EG7'>thrB</a>", "thrA") is None
    assert pages.gene_id("<script>window.location.replace('/gene?orgid=ECOLI&id=EG9')</script>", "x") == "EG9"
    assert pages.map_position("Map [1,234 <- 5,678] x") == (5678, 1234)
    assert pages.summary("<h3>Summary</h3> one <b>two</b><p class='ecoparagraph'>no</p>") == "onetwo"
    assert pages.go_terms("<table class='t'><tr><td>Process:</td><td><table><tr><td>x</td><td><a>t1</a> <a>t2</a></td></tr></table></td></tr></table>") == [("Process", "t1,t2")]
    assert pages.go_terms("<table><tr><td>Process:</td></tr></table>") == []
    assert pages.orthologs("<td>K0</td><td>KEGG ORTHOLOGY</td><a href='/e/K1'>K1</a><b>K2</b>") == {"K1": "/e/K1"}
    assert pages.pathways("<nobr>Name</nobr><td>a, b</td><nobr>Pathway</nobr><td><table><tr><td>p1</td><td>x</td></tr></table><table><tr><td>p2</td></tr></table></td>") == (["a", "b"], ["p1 x", "p2"])
    assert pages.result_count("No results were found") == "0" and pages.result_count("<p>") == "1"
    assert pages.result_count('<div class="results-amount">\n <span class="v">1,204</span> results\n') == "1,204 results"
    cells = pages.cells("<table><tr><td>Locations</td><td>cytosol</td></tr><tr><td>Gene</td><td>thrA</td></tr></table>")
    assert cells["gene"] == "thrA" and cells["location"].startswith("cytosol")


def test_file_names():
    assert sinks.file_stem("18 rna utr") == "18_rna_utr" == sinks.file_stem("18_rna_utr.txt")
    assert sinks.result_name("/a/b/x_match_result.txt", "location") == "x_match_location_result.txt"


def test_attributes(spark):
    f = lambda s: spark.range(1).select(P.attributes(F.lit(s)).alias("m")).first().m
    assert f("<b>Gene</b>: a b<BR>Location: 1,2 -> 5<br>Gene: c:d") == {"Gene": "c:d", "Location": "1,2 -> 5"}
    assert f("plain") == {"Body": "plain"}


def scan_model(items):
    target = next((i for i in items if i["is_target"]), None)
    if target is None:
        return None
    right = target["direction"] == "Right"
    ls = [i for i in items if (i["is_gene"] and i["direction"] == target["direction"]) or (not i["is_gene"] and i["is_promoter"] and i["top"] <= target["top"])]
    ls.sort(key=lambda i: (i["left"] if right else i["right"]) * 10 + i["is_gene"])
    promoter, seen, near = None, False, None
    for i in ls if right else ls[::-1]:
        if i["is_gene"]:
            if not seen:
                seen, near = True, i["pos"]
            if i is target:
                return promoter, near
        elif seen or promoter is None:
            promoter, seen = i["name"], False
    return None


def test_best_promoter_equals_scan(spark):
    import random

    r = random.Random(2)
    rows, want = [], {}
    for d in range(150):
        places = r.sample(range(1, 60), r.randint(1, 9))
        items = [{"diagram": d, "idx": k, "left": p * 10, "right": p * 10 + 5, "top": r.randint(0, 2), "is_gene": r.random() < 0.6, "direction": r.choice(["Left", "Right"]), "pos": p, "name": f"p{p}", "is_target": False} for k, p in enumerate(places)]
        for i in items:
            i["is_promoter"] = not i["is_gene"] and r.random() < 0.9
        genes = [i for i in items if i["is_gene"]]
        if genes:
            r.choice(genes)["is_target"] = True
        rows += items
        if (m := scan_model(items)) is not None:
            want[d] = m
    df = spark.createDataFrame(rows, "diagram long, idx long, left long, right long, top long, is_gene boolean, direction string, pos long, name string, is_target boolean, is_promoter boolean")
    got = {x.diagram: (x.promoter, x.near_gene_pos) for x in P.best_promoter(df).collect()}
    assert got == want


def test_fetch_retries_and_cache(spark):
    wanted = spark.createDataFrame([("a", "u:a"), ("b", "u:b"), ("c", "u:c")], "key string, url string")
    cache = spark.createDataFrame([("c", "kept")], "key string, body string")

    def transport(url, seconds, size):
        if url == "u:b" or size < 200:
            raise OSError("no")
        return f"{url}\nline"

    pages_, errors = fetch.fetch_missing(wanted, cache, transport, size=100, more_size=100)
    assert {x.key: x.body for x in pages_.collect()} == {"a": "u:a\nline", "c": "kept"}
    assert [x.key for x in errors.collect()] == ["b"]


def test_kegg(spark):
    ids = spark.createDataFrame([("K1",), ("K2",)], "id string")
    pg = spark.createDataFrame([("pathway", "K1", "<nobr>Name</nobr><td>n1, n2</td>")], "kind string, key string, body string")
    ok, bad = A.kegg_analysis(ids, pg, is_gene=False)
    assert sorted((x.name, x.pathways) for x in ok.collect()) == [("n1", "No Pathway"), ("n2", "No Pathway")]
    assert [x.id for x in bad.collect()] == ["K2"]


def test_search_end_to_end(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x1.gb").write_text(GENBANK)
    (tmp_path / "p.tsv").write_text("name\tgene\nq\tCGTT\n")
    got = A.gene_similarity_match(spark, str(tmp_path / "p.tsv"), str(tmp_path / "g"), str(tmp_path / "o"), top_k=3, weighted={"direct": 1, "consistency": 1}).orderBy("rank").collect()
    assert [(x.strand, x.start, x.end, x.weighted) for x in got][:2] == [("+", 3, 6, 4.0), ("+", 11, 14, 4.0)]
    assert len(got) == 3
    written = str(next(p for p in (tmp_path / "o").iterdir()))
    back = X.match_records(X.lines(spark, written)).orderBy("rec").collect()
    assert [(x.start, x.end) for x in back] == [(x.start, x.end) for x in got]


def test_numbered_table_in_byte_ranges(spark, tmp_path):
    """Rows have their places, also if many tasks read a file."""
    (tmp_path / "t").mkdir()
    rows = [f"g{i}\t{'x' * (i * 7 % 90)}" for i in range(400)]
    (tmp_path / "t" / "a.tsv").write_text("gene\tpos\n" + "\n".join(rows[:150]) + "\n")
    (tmp_path / "t" / "b.tsv").write_text("gene\tpos\n" + "\n".join(rows[150:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert X.table(spark, str(tmp_path / "t")).rdd.getNumPartitions() > 10
        got = X.numbered_table(spark, str(tmp_path / "t"), "nth").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((x.nth, x.gene) for x in got) == [(i, f"g{i}") for i in range(400)] and got[0].asDict().keys() == {"gene", "pos", "nth"}


def test_probes_in_several_passes(spark, tmp_path, monkeypatch):
    (tmp_path / "g.tsv").write_text("name\tgene\n" + "".join(f"p{i}\t{g}\n" for i, g in enumerate(["acg", "tta", "gg", "cat", "acg"])))
    (tmp_path / "x.gbk").write_text("LOCUS       x\nORIGIN\n        1 acgttacatg gattaccacg\n//\n")
    run = lambda: sorted((x.nth, x.name, x["rank"], x.offset, x.strand, x.weighted) for x in A.gene_similarity_match(spark, str(tmp_path / "g.tsv"), str(tmp_path / "x.gbk"), weighted={"direct": 1.0}, top_k=3).collect())
    want = run()
    monkeypatch.setattr(A, "MOST_PROBES", 2)
    assert run() == want and {x[0] for x in want} == set(range(5))


def test_run_with_observed_tallies(spark, tmp_path):
    ok = spark.range(100).select("id", F.lit("x").alias("good"))
    lost = spark.range(7).select(F.col("id").alias("ok"))
    sc = spark.sparkContext
    jobs = lambda: set(sc.statusTracker().getJobIdsForGroup("tally"))
    sc.setJobGroup("tally", "")
    ok.unionByName(lost, allowMissingColumns=True).write.parquet(str(tmp_path / "plain"))
    plain = len(jobs())
    got, missed, tally = A.saved_with_tallies(ok, lost, str(tmp_path / "run"))
    assert len(jobs()) == 2 * plain  # no job but the one that writes
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert tally == {"total": 107, "solved": 100, "failed": 7, "percent": 100 * 100 / 107}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ok.collect())) and sorted(x.ok for x in missed.collect()) == list(range(7))
    none = A.saved_with_tallies(ok.where("id < 0"), lost.where("false"))[2]
    assert none == {"total": 0, "solved": 0, "failed": 0, "percent": None}


def test_cluster_blocks(spark):
    """Half of all rows in one cluster, a key of each row, a null key, null members, gaps in the numbers."""
    from seqloom.operators import cluster as C

    rows = [(3 * i + (i > 500) * 1000, "hot" if i % 2 else (None if i % 10 == 0 else ("few" if i % 100 == 2 else f"k{i}")), None if i % 77 == 0 else f"m{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "idx long, k string, member string").repartition(7)
    got = C.cluster_blocks(df, F.col("k"), block=16).collect()
    assert max(x.n for x in got) < 32 and sum(x.n for x in got) == len(rows)
    whole, place = {}, {}
    for x in sorted(got, key=lambda x: x.block):
        assert x.block == place.get(x.cluster_key, -1) + 1 or x.block > place.get(x.cluster_key, -1)
        place[x.cluster_key] = x.block
        whole.setdefault(x.cluster_key, [x.first, x.size, []])[2].append(x.members)
    want = {}
    for i, k, m in sorted(rows):
        want.setdefault(k, [i, 0, []])
        want[k][1] += 1
        want[k][2] += [m] if m is not None else []
    assert {k: (a, b, ",".join(t for t in c if t)) for k, (a, b, c) in whole.items()} == {k: (a, b, ",".join(c)) for k, (a, b, c) in want.items()}
    assert sum(x.cluster_key == "hot" for x in got) > 10 and [x.block for x in got if x.cluster_key == "few"] == [0]
    assert C.cluster_blocks(df.where("false"), F.col("k")).count() == 0


def test_link_rows_in_batches(spark, monkeypatch):
    """A page of many links is read in pieces and leaves in batches; events don't depend on where pieces end."""
    from seqloom.sources import pages as P

    big = "<html><script>if (a < b) { x('<a href=no>') }</script>" + "".join(f"<a class='c' href='/g?id=K{i}&amp;x=1'> t {i} <b>bold &lt; {i}</b></a> and 3 < 4 &amp" for i in range(3000)) + "<!-- <a href='z'> --></html>"
    whole = P.events(big)
    for size in (1, 50, 1000):
        monkeypatch.setattr(P, "PIECE", size)
        assert P.events(big) == whole
    monkeypatch.undo()
    df = spark.createDataFrame([(1, "<a href='u'>one</a>", "x"), (2, None, "y"), (3, "", "z"), (4, big, None)], "k long, body string, other string")
    got = P.link_rows(df, "body").collect()
    assert [(x.k, x.other, x.link.title) for x in got if x.k < 4] == [(1, "x", "one")]
    assert sorted(x.link.object for x in got if x.k == 4) == sorted(f"K{i}" for i in range(3000)) and len(got) == 3001
    assert P.link_rows(df.where("false"), "body").count() == 0


def test_tree_reads_the_named_references_only():
    page = "<title>a &amp;&lt; b &amp</title><h1 id='x &quot; &amp;'>&quot;c &amp;lt; &eacute; 1 &#38; 2 &gt</h1><script>if (a && b &amp;) {}</script>"
    title, heading, script = pages.tree(page, ("lt", "gt", "amp")).children
    assert (title.text(), heading.text(), heading.attrs["id"]) == ("a &< b &amp", "&quot;c &lt; &eacute; 1 &#38; 2 &gt", "x &quot; &")
    assert script.text() == "if (a && b &amp;) {}"
    assert pages.tree(page).children[0].text() == "a &< b &"


def test_page_tree_of_deep_null_and_malformed_pages(spark, tmp_path):
    """Elements that are never closed nest as deep as a page is long; a page that can't be read as it should be doesn't end the job."""
    import duckdb

    from seqloom.plans.queries import ORACLES, QUERIES

    page = lambda body: f"<!DOCTYPE html><title>a &amp; b</title><body><h1>c &lt; d</h1>{body}<a href='/x'>x</a></body>"
    bodies = ["<p><b>x.<br>" * 170, "<p><b>x.<br>" * 20000, "<p>" * 5000 + "</i>" * 5000 + "</p>" * 5000, "<![x y[ z ]]><a href='/y'>y</a>", "<![ é>", "<![CDATA[ & ]]>", "<![if !x]>z<![endif]>"]
    rows = [*enumerate(map(page, bodies)), (100, None), (101, ""), (102, "no tag"), (103, "<![x")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["page_tree"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLES["page_tree"]).fetchall())
    assert got[1] == (1, "a & b", "c < d", 1) and (100, None, None, None) in got


def test_go_terms_of_a_deep_page():
    table = "<table class='t'><tr><td>Process:</td><td><table><tr><td>x</td><td><a>t</a>, <i><a>u</a></i></td></tr></table></td></tr></table>"
    assert pages.go_terms("<p><b>x<br>" * 3000 + table) == [("Process", "t,u")]
    deep = pages.tree("<p>" * 50000 + table + "y")
    assert [len(deep.tables()), len(deep.inside("tr")), deep.text()] == [1, 0, "Process:xt, uy"]


def test_plain_pages_are_read_as_by_the_parser():
    """Plain pages are read by one expression, with the events of ``HTMLParser``; others are left to it."""
    import random

    from seqloom.sources import pages as P

    def parsed(page):
        p = P._Events()
        p.feed(page)
        p.close()
        return p.found

    parts = "<a>,</a>,<td>,</TD>,<A HREF='x y'>,<a b=\"/g?x=1\" c='t' d>,<p,<b >,</b >,</b x>,<script>,</script>,<script >var a;,<title>,</title>,x,K1 , ,&amp;,&lt;,&am,&,&#65;,<,>,</,<!--,-->,<!x>,<br/>,<td n=1>,<a b='&amp;c'>,<a b='&c'>,<a b=''>,<a b = 'c'>,<p\x0bq='1'>,\r".split(",")
    r, plain = random.Random(4), 0
    for _ in range(20000):
        page = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        got = P._plain_events(page)
        plain += got is not None
        assert got is None or got == parsed(page), page
    assert plain > 2000
    assert P._plain_events("<table><tr><td>Gene</td><td><a href='/g?a=1&amp;id=2'>x</a> &lt;y</td></tr></table><script>{gene:'E1'}</script>") is not None
