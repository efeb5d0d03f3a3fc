"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

1. *Word vectors.*  Tokens are runs of letters, digits or punctuation.  Each has a fixed
   sparse ternary index vector from its hash; a bucket's context vector is the sum of the
   index vectors of its tokens' neighbours over the whole corpus.  Buckets and dimensions
   are fixed, so the table has a size of its own however large the corpus.
2. *Pooling.*  A document is the mean of its tokens' vectors, of its tokens' shapes'
   vectors, of the products of adjacent tokens' vectors, and the norm of its mean.
3. *Network.*  A two-layer numpy network learns from at most ``MAX_LABELLED`` labelled
   rows, chosen by a hash; a temperature fitted on a part it has not seen calibrates it.

The text is read for the vectors of words, for the labelled sample, and for the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._shared import materialize
from seqloom.llm._text import byte_blocks, mix64, span_hashes

BUCKETS, DIMS = 1 << 14, 48
#: Non-zero entries of an index vector.
NONZERO = 2
#: Labelled rows that the network learns from, at most; the least by a hash of doc_id.
MAX_LABELLED = 40_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
THRESHOLD = 0.3
_BLOCK_ROWS = 256

#: Classes of bytes: 0 white space or control, 1 lower case or beyond ASCII, 2 upper case, 3 digit, 4 punctuation.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 4
_CLASS[0x80:] = 1
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
#: Shapes of tokens: lower, capitalised, upper, digits, punctuation, each by length up to 12.
SHAPES = 5 * 12


@dataclass
class Tokens:
    bucket: np.ndarray
    shape: np.ndarray
    bounds: np.ndarray  # of texts
    adjacent: np.ndarray  # i and i + 1 are in the same text


def tokens(buf: np.ndarray, offsets: np.ndarray) -> Tokens:
    kind = _CLASS[buf]
    letter = (kind == 1) | (kind == 2)
    run = np.where(letter, 1, kind)
    begins = np.ones(len(buf), bool)
    begins[1:] = run[1:] != run[:-1]
    full = offsets[:-1][np.diff(offsets) > 0]
    begins[full] = True
    start = np.flatnonzero(begins)
    stop = np.append(start[1:], len(buf))
    solid = kind[start] > 0
    start, stop = start[solid], stop[solid]
    h = span_hashes(buf, start, stop)
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    size = stop - start
    capitals = upper[stop] - upper[start]
    first = kind[start]
    form = np.where(first >= 3, first, np.where(capitals == 0, 0, np.where((capitals == size) & (size > 1), 2, 1)))
    shape = form * 12 + np.minimum(size, 12) - 1
    bounds = np.searchsorted(start, offsets)
    adjacent = np.ones(max(len(start) - 1, 0), bool)
    inner = bounds[1:-1]
    adjacent[inner[(inner > 0) & (inner < len(start))] - 1] = False
    return Tokens((h % np.uint64(BUCKETS)).astype(np.int64), shape, bounds, adjacent)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of the NONZERO entries of each bucket's index vector."""
    h = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(BUCKETS x DIMS, SHAPES x DIMS) unit context vectors from all of ``docs(text)``.

    Each task adds up its own table and emits the blocks that it touched; blocks are
    summed by key.  The driver gets the one table of fixed size.
    """
    place, sign = _index_vectors()
    rows = BUCKETS + SHAPES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((rows, DIMS), np.int64)
        flat = table.ravel()
        cells, signs, held = [], [], 0

        def add_up() -> None:
            nonlocal held
            if held:
                flat[:] += np.bincount(np.concatenate(cells), np.concatenate(signs), minlength=len(flat)).astype(np.int64)
            cells.clear()
            signs.clear()
            held = 0

        for batch in batches:
            for _, _, buf, offsets in byte_blocks(batch.column("text")):
                if not len(buf):
                    continue
                t = tokens(buf, offsets)
                pairs = np.flatnonzero(t.adjacent)
                for a, b in ((pairs, pairs + 1), (pairs + 1, pairs)):
                    for k in range(NONZERO):
                        to, by = place[t.bucket[b], k], sign[t.bucket[b], k]
                        cells += [t.bucket[a] * DIMS + to, (BUCKETS + t.shape[a]) * DIMS + to]
                        signs += [by, by]
                held += 8 * len(pairs)
                if held >= 1 << 21:
                    add_up()
        add_up()
        blocks = [k for k in range(0, rows, _BLOCK_ROWS) if table[k : k + _BLOCK_ROWS].any()]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([table[k : k + _BLOCK_ROWS].tobytes() for k in blocks], pa.binary())], names=["block", "cells"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for cells in batch.column("cells"):
                total = total + np.frombuffer(cells.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "cells"])

    text = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = text.mapInArrow(count, "block int, cells binary").groupBy("block").applyInArrow(add, "block int, cells binary")
    table = np.zeros((rows, DIMS), np.float64)
    for row in parts.toArrow().to_pylist():
        cells = np.frombuffer(row["cells"], np.int64).reshape(-1, DIMS)
        table[row["block"] : row["block"] + len(cells)] = cells
    table = np.sign(table) * np.log1p(np.abs(table))
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = (table / np.maximum(norm, 1e-9)).astype(np.float32)
    return table[:BUCKETS], table[BUCKETS:]


#: Numbers of a document's vector.
FEATURES = 3 * DIMS + 3


#: Tokens whose vectors are gathered at once: a text of any length takes no more memory.
_STEP = 1 << 14


def pool(column: pa.Array, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each whole text; zeros without tokens."""
    parts = [np.zeros((0, FEATURES), np.float32)]
    for _, n, buf, offsets in byte_blocks(column):
        out = np.zeros((n, FEATURES), np.float32)
        parts.append(out)
        if not len(buf):
            continue
        t = tokens(buf, offsets)
        counts = np.diff(t.bounds)
        full = np.flatnonzero(counts > 0)
        if not len(full):
            continue
        count = counts[full].astype(np.float32)[:, None]
        at = t.bounds[:-1][full]
        sums, dots = np.zeros((len(full), 2 * DIMS), np.float32), np.zeros(len(full), np.float32)
        for i in range(0, len(t.bucket), _STEP):
            v = words[t.bucket[i : i + _STEP + 1]]
            m = min(_STEP, len(t.bucket) - i)
            near = t.adjacent[i : i + m]
            products = np.zeros((m, DIMS), np.float32)
            np.multiply(v[: len(near)], v[1 : len(near) + 1], out=products[: len(near)])
            products[: len(near)][~near] = 0
            lo, hi = np.searchsorted(at, i, "right") - 1, np.searchsorted(at, i + m, "left")
            cut = np.maximum(at[lo:hi] - i, 0)
            sums[lo:hi, :DIMS] += np.add.reduceat(v[:m], cut, axis=0)
            together = np.add.reduceat(products, cut, axis=0)
            sums[lo:hi, DIMS:] += together
            dots[lo:hi] += together.sum(axis=1)
        cells = np.repeat(np.arange(len(full)) * SHAPES, counts[full]) + t.shape
        hist = np.bincount(cells, minlength=len(full) * SHAPES).reshape(-1, SHAPES).astype(np.float32)
        pooled = sums / count
        out[full, : 2 * DIMS] = pooled
        out[full, 2 * DIMS : 3 * DIMS] = hist / count @ shapes
        out[full, -3] = np.linalg.norm(pooled[:, :DIMS], axis=1)
        out[full, -2] = dots / count[:, 0]
        out[full, -1] = np.log1p(count[:, 0]) / 10
    return np.concatenate(parts)


@dataclass
class Network:
    """Standardised input, one hidden layer of rectified units, a logit over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, (x - self.mean) / self.scale @ self.w1 + self.b1)
        return (hidden @ self.w2 + self.b2).astype(np.float64)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, seed: int = 7) -> Network:
    """Adam on the rows outside ``calibration`` (a mask); the temperature on those inside.

    With one class only, or no rows, the network gives the smoothed share of label 1.
    """
    x, y = x.astype(np.float32), y.astype(np.float32)
    rng = np.random.default_rng(seed)
    d = x.shape[1] if x.ndim == 2 and x.shape[1] else FEATURES
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    fit = np.flatnonzero(~calibration)
    flat = Network(np.zeros(d, np.float32), np.ones(d, np.float32), np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), prior)
    if len(fit) < 10 or len(np.unique(y[fit])) < 2:
        return flat
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    net = Network(mean, scale, (rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d)).astype(np.float32), np.zeros(HIDDEN, np.float32), (rng.standard_normal(HIDDEN) * np.sqrt(2 / HIDDEN)).astype(np.float32), prior)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2], np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(fit)
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(order), BATCH):
            k = order[i : i + BATCH]
            pre = z[k] @ params[0] + params[1]
            hidden = np.maximum(0, pre)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30)))
            g = (p - y[k]) / len(k)
            back = np.outer(g, params[2]) * (pre > 0)
            grads = [z[k].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ g + DECAY * params[2], np.array([g.sum()], np.float32)]
            t += 1
            for j, grad in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad * grad
                params[j] = (params[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if calibration.any():
        logit, target = net.logits(x[calibration]), y[calibration]
        loss = lambda t: float(np.mean(np.logaddexp(0, logit / t) - target * logit / t))
        net.temperature = float(min(np.geomspace(0.25, 8, 121), key=loss))
    return net


def crc_mod(column: str, mod: int):
    """crc32 of the decimal text of a column, modulo ``mod``; null as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


@dataclass
class Model:
    """All that scoring a text takes; its size doesn't depend on the corpus."""

    words: np.ndarray
    shapes: np.ndarray
    network: Network

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.network.probability(pool(column, self.words, self.shapes))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Word vectors from all of ``docs``; the network from labelled rows.

    The labelled rows are those whose label is 0 or 1 and whose crc32(doc_id) mod 5 is not 0; where
    they are more than ``max_labelled``, those least by a hash.  That sample has a size of its
    own, so it is sent to the tasks that read the texts, and its vectors come to the driver.
    A sixth of it (by a hash) calibrates and doesn't train.  Of rows that share a doc_id, one counts.
    """
    words, shapes = word_vectors(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("row_doc"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and row_doc is not null").where(crc_mod("row_doc", 5) != 0)
    known = known.groupBy("row_doc").agg(F.min("label").alias("label")).withColumn("place", F.pmod(F.xxhash64("row_doc"), F.lit(1 << 40)))
    n = known.count()
    if n > max_labelled:  # by the hash first, so the sort of the limit sees about as many rows as it keeps
        known = known.where(F.col("place") < int((1 << 40) * min(1.0, 1.1 * max_labelled / n)))
    known = known.orderBy("place", "row_doc").limit(max_labelled).drop("place")
    texts = docs.select(F.col("doc_id").cast("long").alias("row_doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((words, shapes))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pool(batch.column("text"), *sent.value).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("row_doc"), batch.column("label"), lists], names=["row_doc", "label", "vector"])

    chosen = texts.join(F.broadcast(materialize(known, "labelled")), "row_doc").select("row_doc", "label", "text")
    made = chosen.mapInArrow(vectors, "row_doc long, label int, vector array<float>").groupBy("row_doc", "label").agg(F.min("vector").alias("vector"))
    sample = made.toArrow().sort_by("row_doc").combine_chunks()
    n = sample.num_rows
    if not n:
        return Model(words, shapes, fit_network(np.zeros((0, FEATURES), np.float32), np.zeros(0), np.zeros(0, bool)))
    x = sample["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, FEATURES)
    held = mix64(sample["row_doc"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(6) == 0
    return Model(words, shapes, fit_network(x, sample["label"].to_numpy(), held))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    ``score`` is the calibrated probability of label 1 and comes from the text alone; a null
    or empty text has the vector 0.  Rows of one doc_id are rows of their own.  Without
    usable labels every score is 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row_doc"), pa.array(sent.value.scores(batch.column("text")))], names=["row_doc", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("row_doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "row_doc long, score double")
    return scored.select(F.col("row_doc").alias("doc_id"), (crc_mod("row_doc", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs`` without the rows whose score is below THRESHOLD, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(batch.column("text")) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
