import hashlib
import math
import os
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_ops import exact_components, fill

from seqloom.llm import _shared, _text, odd_minhash, quality, queries, source_mix, template_leaks


def test_stages_one_by_one(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    stage = [f for _, f in corpus_pipeline.STAGES]
    assert len(stage) == 5

    good = stage[0](spark, docs, folder)
    assert ids(good) == ids(quality.score(docs, labels).where("predicted = 1"))
    near = stage[1](spark, good, folder)
    assert ids(near) == ids(odd_minhash.near_duplicates(good, 5, 80).where("kept"))
    clean = stage[2](spark, near, folder)
    assert set(ids(clean)) == set(ids(near)) - {x.doc_id for x in template_leaks.leaks(near, bench).collect()}
    mixed = stage[3](spark, clean, folder)
    assert all(x.columns == docs.columns for x in (good, near, clean, mixed))
    assert ids(mixed) == ids(source_mix.mixed_documents(clean))
    out = stage[4](spark, mixed, folder).orderBy("start").collect()
    assert [x.doc_id for x in out] == ids(mixed)
    assert out[-1].start + out[-1].n_tokens == sum(x.n_tokens for x in out)


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert corpus_pipeline.ORACLE_SQL is None


def slow_features(text, words, shapes):
    """Numbers of a text for the classifier, token by token."""
    data = text.encode()
    runs = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x00-\x20\x7f]+", data)
    found = [t for t in runs if t[0] > 32 and t[0] != 127]
    # Tokens are next to each other also where white space lies between.
    vectors, forms = [], []
    for t in found:
        h = _text.span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]
        vectors.append(words[int(h % np.uint64(quality.BUCKETS))])
        upper = len(re.findall(rb"[A-Z]", t))
        first = 3 if t[:1].isdigit() else 4 if not (t[:1].isalpha() or t[0] >= 128) else 0
        form = first or (0 if upper == 0 else 2 if upper == len(t) and len(t) > 1 else 1)
        forms.append(shapes[form * 12 + min(len(t), 12) - 1])
    n, d = len(found), quality.DIMS
    out = np.zeros(quality.FEATURES)
    if n:
        products = [a * b for a, b in zip(vectors, vectors[1:])]
        together = sum(products, np.zeros(d)) / n
        out[:d], out[d : 2 * d], out[2 * d : 3 * d] = np.mean(vectors, axis=0), together, np.mean(forms, axis=0)
        out[-3:] = np.linalg.norm(out[:d]), together.sum(), math.log1p(n) / 10
    return out


def slow_score(model, text):
    net = model.network
    x = (slow_features(text or "", model.words, model.shapes) - net.mean) / net.scale
    hidden = [max(0.0, float(x @ net.w1[:, j]) + float(net.b1[j])) for j in range(net.w1.shape[1])]
    logit = (sum(h * float(w) for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
    return 1 / (1 + math.exp(-min(max(logit, -40), 40)))


def test_quality_scores_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "Ab CD9!! \x7f é x")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    model = quality.train(rows, labels)
    got = {x.doc_id: x.score for x in quality.score(rows, labels).collect()}
    for x in rows.collect():
        assert abs(got[x.doc_id] - slow_score(model, x.text)) < 1e-3


def test_word_vectors_equal_brute_force(spark):
    texts = ["the cat sat. The cat ran 12", "a cat, a dog", None, "", "12 12 cat"]
    words, shapes = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    place, sign = quality._index_vectors()
    table = np.zeros((quality.BUCKETS + quality.SHAPES, quality.DIMS))
    for t in texts:
        data = (t or "").encode()
        if not data:
            continue
        k = quality.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        for i in range(len(k.bucket) - 1):
            for a, b in ((i, i + 1), (i + 1, i)):
                for j in range(quality.NONZERO):
                    for row in (k.bucket[a], quality.BUCKETS + k.shape[a]):
                        table[row, place[k.bucket[b], j]] += sign[k.bucket[b], j]
    table = np.sign(table) * np.log1p(abs(table))
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    assert np.allclose(words, table[: quality.BUCKETS], atol=1e-6) and np.allclose(shapes, table[quality.BUCKETS :], atol=1e-6)


def brute_pipeline(docs, model, items):
    """The whole pipeline on a list of (doc_id, text, source), document by document."""
    import public_tokenizers
    from tokenizers import Tokenizer

    good = [r for r in docs if slow_score(model, r[1]) >= quality.THRESHOLD]
    component = exact_components([r[:2] for r in good], 5, 80)
    near = [r for r, (i, n, c) in zip(good, component) if n == 0 or i == c]
    flat = lambda x: " ".join((x or "").lower().split())
    clean = [r for r in near if not any(flat(item) in flat(r[1]) for item in items)]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sizes = Counter()
    for r in clean:
        sizes[r[2]] += size(r)
    targets = fill(sizes, source_mix.WEIGHTS, source_mix.MAX_EPOCHS)
    names = sorted(targets, key=lambda n: (-(targets[n] % 1), n))
    spare = round(sum(targets.values())) - sum(int(t) for t in targets.values())
    words = {n: int(targets[n]) + (k < spare) for k, n in enumerate(names)}
    mixed = []
    for n in sorted(sizes):
        own = sorted((r for r in clean if r[2] == n), key=lambda r: hashlib.md5(f"{r[0]}|{r[2]}|{r[1]}".encode()).hexdigest())
        at = 0
        for r in own:
            taken = size(r) * (words[n] // sizes[n]) + max(0, min(size(r), words[n] % sizes[n] - at))
            at += size(r)
            mixed += [r] * (math.floor(taken / size(r) + 0.5) if size(r) else 0)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = [], 0
    for r in sorted(mixed, key=lambda r: r[0]):
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [0]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_run_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    before = _shared.made()
    got = corpus_pipeline.run(spark, folder)
    (left,) = [p for p in _shared.made() if p not in before]  # what stages wrote on the way is gone
    docs, labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = sorted((x.doc_id, x.text, x.source) for x in docs.collect())
    want = brute_pipeline(rows, quality.train(docs, labels), [x.text for x in bench.collect()])
    assert sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in got.collect()) == want and len(want) > 400
    folder = _shared.shared_dir(spark).removeprefix("file:")
    assert os.path.basename(left) in os.listdir(folder)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty table: each stage keeps what its docstring says."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, None), (None, text + " more", "b"), (3, None, "a"), (4, "", "b"), (5, " \n ", None), (6, "one two three", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row_key", F.lit(7))
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = [
        Counter(rows),
        Counter([(1, text, "a")] + rows[4:]),
        Counter([r for r in rows if r[0] != 6]),
    ]
    stages = [f for _, f in corpus_pipeline.STAGES]
    for stage, left in zip(stages[:3], want):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and Counter(tuple(x)[:3] for x in out.collect()) == left
    mixed = stages[3](spark, df, str(tmp_path))
    assert mixed.columns == df.columns and not {3, 4, 5} & {x.doc_id for x in mixed.collect()}
    tokens = stages[4](spark, df, str(tmp_path)).orderBy("start").collect()
    assert len(tokens) == len(rows) and tokens[0].doc_id is None and [x.n_tokens for x in tokens if x.doc_id in (3, 4)] == [1, 1]
    for stage in stages:
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0
