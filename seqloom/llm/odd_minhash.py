"""Near duplicates by MinHash bands, odd sketches and exact confirmation.

1. A document's set is its distinct word shingles.  Equal sets are one *node* from the
   start, so copies never meet as pairs.
2. MinHash samples give band keys; the same samples, folded into a parity bitmap (an *odd
   sketch*), give a precise estimate of a high similarity: the XOR of two sketches has
   few bits when the sets differ little.
3. In each bucket of a band every member is paired with the bucket's most connected member
   only.  Pairs that their sketches allow are confirmed on the full sets, and components
   formed.  A large group of near copies costs a pair for each member, not for each two.
4. Buckets that still hold several components are looked at again, across components: sets whose
   shingles no other candidate has are ruled out first; of the others those meet that have about the same size
   and share about as much with the bucket's center (as similar sets must); their pairs are ruled out by a bound on
   what they can share, then by sketches, and the rest confirmed on full sets.

A pair at the threshold shares no band with probability 2e-10 for 30 bands of 4 at 0.85 and
2e-7 at 0.8; the sketch's margin is six standard deviations.  Everything is keyed by node, and
no group of members is ever gathered in one task or on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._shared import bit_set, free_name, in_bit_set, materialize, with_row_keys
from seqloom.llm._text import mix64, shingles, word_blocks
from seqloom.llm.components import connected_components

BANDS, ROWS = 30, 4
SKETCH_WORDS = 4  # of 64 bits
COUNT_AT_ONCE = 1 << 18
#: Members of a center that meet its set in one task.
MEMBERS = 512

_SAMPLES = BANDS * ROWS
_A = (mix64(np.arange(1, _SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A35)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(501, 501 + _SAMPLES, dtype=np.uint64) * np.uint64(0xC13FA9A902A6328F)) >> np.uint64(32)).astype(np.uint32)


def minhash(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples of each non-empty run of shingle hashes: rows of _SAMPLES 32-bit minima."""
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, _SAMPLES), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(_SAMPLES):
            out[:, i] = np.minimum.reduceat((low ^ _B[i]) * _A[i] + high, bounds[:-1])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which also depends on the band's number."""
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(9001)), (len(samples), BANDS)).copy()
        parts = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
        for i in range(ROWS):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return acc.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (number, value) pairs of the samples: SKETCH_WORDS words a row."""
    numbers = np.arange(_SAMPLES, dtype=np.uint64) << np.uint64(32)
    place = (mix64(samples.astype(np.uint64) | numbers) >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_WORDS)
    bits = np.zeros((len(samples), 64 * SKETCH_WORDS), np.uint8)
    np.add.at(bits, (np.arange(len(samples))[:, None], place), 1)
    return np.packbits(bits & 1, axis=1, bitorder="little").view(np.int64).reshape(-1, SKETCH_WORDS)


def sketch_limit(similarity: float) -> int:
    """Bits in the XOR of two sketches beyond which the similarity is below, by six deviations."""
    low = similarity - 6 * math.sqrt(similarity * (1 - similarity) / _SAMPLES)
    n = 64 * SKETCH_WORDS
    expected = n / 2 * (1 - (1 - 2 / n) ** (2 * _SAMPLES * (1 - max(low, 0.0))))
    return min(n, math.ceil(expected + 6))


def _set_parts(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, n, set hashes, bounds, digest, second digest) of blocks: sets are sorted and distinct."""
    for w in word_blocks(batch.column("text")):
        h, bounds = shingles(w, k)
        sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat + np.uint64(0x51ED2701)))])
            mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat ^ np.uint64(0xA5A5F00DD15EA5E5)))])
        d1, d2 = sums[bounds[1:]] - sums[bounds[:-1]], mixed[bounds[1:]] - mixed[bounds[:-1]]
        yield w.first, w.n, flat, bounds, d1.view(np.int64), d2.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_SIGNATURE = "doc_id long, n long, d1 long, d2 long, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, d1, d2, bands, s0..``: set size, digest of the set, band keys and sketch of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, flat, bounds, d1, d2 in _set_parts(batch, k):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes > 0)
                keys, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, SKETCH_WORDS), np.int64)
                if len(full):
                    samples = minhash(flat, np.append(bounds[full], len(flat)))
                    keys[full], sketch[full] = band_keys(samples), odd_sketch(samples)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(sizes), pa.array(d1), pa.array(d2), lists] + [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS)],
                    names=["doc_id", "n", "d1", "d2", "bands", *_SKETCH],
                )

    return _rows(docs).mapInArrow(sign, _SIGNATURE)


def _place(d1: Column, doc_id: Column) -> Column:
    """A 64-bit key of a digest and a doc_id; ``full_sets`` computes the same in numpy."""
    doc_id = F.coalesce(doc_id, F.lit(0)).cast("long")
    return d1.bitwiseXOR(doc_id).bitwiseXOR(F.shiftleft(doc_id, 40))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted(node, rep, d1, d2, ..)`` with ``shingles`` (sorted) in place of rep and digests, from whole texts.

    A bit set of bounded size tells tasks which texts may be wanted, so texts are not shuffled;
    the join on the digest then settles it.
    """
    bits = bit_set(wanted.select(_place(F.col("d1"), F.col("rep")).alias("key")), wanted.count())
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            for first, n, flat, bounds, d1, d2 in _set_parts(batch, k):
                i = ids[first : first + n]
                hit = in_bit_set(sent.value, d1 ^ i ^ (i << 40))
                at = np.flatnonzero(hit & (np.diff(bounds) > 0))
                if len(at):
                    whole = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(d1[at]), pa.array(d2[at]), whole.take(pa.array(at))], names=["doc", "d1", "d2", "shingles"])

    made = _rows(docs).mapInArrow(sets, "doc long, d1 long, d2 long, shingles array<long>")
    # Rows of one doc_id and text are one set; aggregated as they are joined, so sets move once.
    made = made.groupBy("doc", "d1", "d2").agg(F.first("shingles").alias("shingles"))
    keys = wanted.withColumn("doc", F.coalesce("rep", F.lit(0))).drop("rep")
    return made.join(keys, ["doc", "d1", "d2"]).drop("doc", "d1", "d2")


def _sketch_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH), F.lit(0))


def _fans(pairs: DataFrame) -> DataFrame:
    """``center, fan`` of ``pairs(node, center)``: in how many tasks a center's set meets those of its members."""
    return pairs.groupBy("center").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("fan"))


def _part() -> Column:
    return F.pmod(F.xxhash64("node"), F.col("fan")).cast("int").alias("part")


def _meet(members: DataFrame, center_sets: DataFrame, fans: DataFrame) -> DataFrame:
    """``node, center`` with ``shared``, the size of the intersection, and ``total``, the sum of both sizes.

    ``members(node, shingles, center, part)``: a member's set goes to each of its centers.  A center with very many
    members has a copy of its own set for every MEMBERS of them, so they meet in as many tasks.
    """
    right = center_sets.select(F.col("node").alias("center"), F.col("shingles").alias("right_set")).join(fans, "center")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    both = members.withColumnRenamed("shingles", "left_set").join(right, ["center", "part"])
    return both.select("node", "center", F.size(F.array_intersect("left_set", "right_set")).cast("long").alias("shared"), (F.size("left_set") + F.size("right_set")).cast("long").alias("total"))


def _to_centers(pairs: DataFrame, sets: DataFrame, center_sets: DataFrame) -> DataFrame:
    """The same for ``pairs(node, center)``."""
    fans = _fans(pairs)
    members = pairs.join(fans, "center").select("node", "center", _part()).join(sets.select("node", "shingles"), "node")
    return _meet(members, center_sets, fans)


def _similar(percent: int) -> Column:
    return F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)``, those with 100 * intersection >= percent * union on the full sets."""
    named = pairs.select(F.col("a").alias("node"), F.col("b").alias("center"))
    return _to_centers(named, sets, sets).where(_similar(percent)).select(F.col("node").alias("a"), F.col("center").alias("b"))


def _unshared(sets: DataFrame) -> DataFrame:
    """``node, alone``: shingles of a set that no other set of ``sets`` has.

    Tasks count within runs of sets first, so a shingle that many sets share is a row for each
    run; what a task holds is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            offsets, nodes = lists.offsets.to_numpy(), batch.column("node").to_numpy()
            flat = lists.values.to_numpy()
            i = 0
            while i < len(nodes):  # whole sets, about COUNT_AT_ONCE shingles
                j = min(len(nodes), max(i + 1, int(np.searchsorted(offsets, offsets[i] + COUNT_AT_ONCE, "right")) - 1))
                owner = np.repeat(nodes[i:j], np.diff(offsets[i : j + 1]))
                values, first, counts = np.unique(flat[offsets[i] : offsets[j]], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64)), pa.array(owner[first])], names=["shingle", "sets", "owner"])
                i = j

    rows = sets.select("node", "shingles").mapInArrow(count, "shingle long, sets long, owner long")
    once = rows.groupBy("shingle").agg(F.sum("sets").alias("sets"), F.min("owner").alias("owner")).where("sets = 1")
    return once.groupBy(F.col("owner").alias("node")).agg(F.count("*").alias("alone"))


def _cells(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of ``rows(n, inside, ..)`` with keys ``level`` and ``cell``, that similar sets share once.

    Similar sets have sizes within ``100 / percent`` of each other, and what they share with a third set differs by
    ``(100 - percent) / percent`` of the lesser size at most: so levels of sizes, and cells of ``inside`` as wide as
    that, differ by one at most.
    """
    ratio = max(100 / percent, 1.01) * 1.0001
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(ratio) + 1e-9)
    cell = lambda at: F.floor(F.col("inside") / (F.pow(F.lit(ratio), at + 1) * ((100 - percent) / percent) + 1))
    one = rows.select("*", F.explode(F.sequence(level - 1, level + 1)).alias("level"))
    other = rows.withColumn("level", level)
    return one.withColumn("cell", cell(F.col("level"))), other.select("*", F.explode(F.sequence(cell(F.col("level")) - 1, cell(F.col("level")) + 1)).alias("cell"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Sets are distinct k-word shingles of the text with A-Z lower-cased (words: runs other than
    space and U+0009 to U+000D); with 1 to k - 1 words, the whole sequence is one shingle.
    Documents are linked where ``100 * intersection >= percent * union``; ``component_id`` is the
    least doc_id that links reach.  Texts without words, empty or null are linked with nothing.
    Rows of one doc_id stay rows; their ``component_id`` is that of their own text.  A null doc_id
    is above all others: it has the component of its copies, or null.
    """
    sig = materialize(signatures(docs, k), "signatures")
    first = [F.any_value(c).alias(c) for c in ("n", "bands", *_SKETCH)]
    classes = sig.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), *first)
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # Buckets with two members at least, and the most connected member of each.
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(keyed.join(sizes, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    known = materialize(nodes.join(degree, "node").drop("bands"), "known", light=True)
    centers = materialize(members.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct(F.col("degree"), -F.col("node"))).alias("center")), "centers", light=True)

    # Each member with its buckets' centers, at most one for each band; what sketches rule out goes.
    ends = known.select("node", "n", *_SKETCH)
    limit = sketch_limit(percent / 100)
    possible = (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (_sketch_bits("x", "y") <= limit)
    stars = members.join(centers, "key").where("node <> center").select("node", "center").distinct()
    checked = stars.join(ends.alias("x"), F.col("x.node") == stars["node"]).join(ends.alias("y"), F.col("center") == F.col("y.node")).where(possible).select(stars["node"], "center")
    checked = materialize(checked, "stars", light=True)
    fans = _fans(checked)
    listed = checked.join(fans, "center").groupBy("node").agg(F.collect_list(F.struct("center", _part())).alias("stars"))
    flags = centers.select(F.col("center").alias("node")).distinct().withColumn("is_center", F.lit(True))
    wanted = known.select("node", "rep", "d1", "d2").join(listed, "node", "left").join(flags, "node", "left")
    sets = materialize(full_sets(docs, wanted, k), "sets")
    center_sets = sets.where("is_center").select("node", "shingles")
    near = sets.where("stars is not null").select("node", "shingles", F.explode("stars").alias("s")).select("node", "shingles", "s.center", "s.part")
    shared = materialize(_meet(near, center_sets, fans), "shared", light=True)
    linked = shared.where(_similar(percent)).select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    labels = materialize(connected_components(linked), "labels", light=True)

    # Buckets across components: what the stars have not tried.
    named = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rest = materialize(named.join(mixed, "key").join(centers, "key"), "rest", light=True)
    rest_sets = materialize(sets.select("node", "shingles").join(rest.select("node").distinct(), "node", "left_semi"), "rest-sets", light=True)
    bounds = ends.join(_unshared(rest_sets), "node", "left").select("node", "n", *_SKETCH, F.coalesce("alone", F.lit(0)).alias("alone"))
    able = materialize(bounds.where((F.col("n") - F.col("alone")) * 100 >= F.col("n") * percent), "able", light=True)
    able_sets = materialize(rest_sets.join(able.select("node"), "node", "left_semi"), "able-sets", light=True)
    # With the bucket's center, a set falls into what it shares with that, what no other set has, and
    # the rest: two sets share at most the lesser of their first parts and of their last parts.
    to_center = rest.where("node <> center").join(able.select("node"), "node", "left_semi").select("node", "center").distinct()
    known_pairs = shared.select("node", "center", F.col("shared").alias("inside"))
    new_pairs = to_center.join(known_pairs, ["node", "center"], "left_anti")
    inside = known_pairs.unionByName(_to_centers(new_pairs, able_sets, center_sets).select("node", "center", F.col("shared").alias("inside")))
    middle = labels.select(F.col("node").alias("center"), F.col("label").alias("center_label"))
    parts = rest.where("node <> center").join(able, "node").join(inside, ["node", "center"]).join(middle, "center", "left").join(nodes.select("node", "bands"), "node")
    aside = F.col("label") != F.coalesce("center_label", "center")
    open_rest = materialize(parts.select("key", "node", "label", "n", "alone", "inside", (F.col("n") - F.col("inside") - F.col("alone")).alias("free"), "bands", *_SKETCH, aside.alias("aside")), "open", light=True)
    most = F.least(F.col("x.n") - F.col("x.alone"), F.col("y.n") - F.col("y.alone"), F.least("x.inside", "y.inside") + F.least("x.free", "y.free"))
    bound = most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent
    # A pair of several buckets comes from the first band that both share.
    common = F.zip_with("x.bands", "y.bands", lambda i, j: F.when(i == j, i))
    here = F.get(F.array_compact(common), F.lit(0)) == F.col("x.key")
    one, other = _cells(open_rest, percent)
    same_cell = (F.col("x.key") == F.col("y.key")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.cell") == F.col("y.cell"))
    pairs = one.where("aside").alias("x").join(other.alias("y"), same_cell & (F.col("x.label") != F.col("y.label")) & bound & possible & here)
    more = _confirmed(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), able_sets, percent)
    more = materialize(more, "links", light=True)
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    joints = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    merged = connected_components(joints).select(F.col("node").alias("label"), F.col("label").alias("final"))

    named_nodes = nodes.select("node", "d1", "d2", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(merged, "label", "left").withColumn("final", F.coalesce("final", "label"))
    least = named_nodes.groupBy("final").agg(F.min("rep").alias("component_id"))
    out = materialize(named_nodes.join(least, "final").select("d1", "d2", "component_id"), "components", light=True)
    done = sig.select("doc_id", "n", "d1", "d2").join(out, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, one of its least doc_id (null last).

    Rows are decided one by one: those that share a doc_id, have none, or are equal in all columns
    are rows of their own, and a row goes only if another of its component stays.  Texts without
    words (null, empty, white space) resemble nothing and stay.  Texts of any length are compared
    as wholes; an empty table stays empty; columns of any name are kept as they are.
    """
    keyed, key = with_row_keys(docs)
    ids = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("id"))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), k, percent).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id")
    found = materialize(found.join(ids, "key"), "near", light=True)
    least = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("kept_key"))
    name = free_name(keyed, "dropped_key")
    # By row, not by component: one component may hold a third of all rows.
    dropped = found.join(least, F.col("key") == F.col("kept_key"), "left_anti")
    dropped = materialize(dropped.select(F.col("key").alias(name)), "dropped", light=True)
    return keyed.join(dropped, F.col(key) == F.col(name), "left_anti").drop(key)


#: Exact components in DuckDB SQL for three words and 85 percent: all pairs that share a shingle, then a closure.
EXACT_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)
), r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id
), c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
