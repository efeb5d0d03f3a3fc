"""Search by seeds: an index of q-grams names the few windows that can reach a least score, and only those are scored.

If a window reaches the score, some run of letters of the probe is whole in it (mismatches or edits are too few to
break all of them), so it holds a q-gram of the probe, near where the probe has it.  In grams ``c`` and ``t`` are one letter,
as a probe's ``c`` matches both; what meets only by that is scored like all candidates and falls.

The index of a set of genomes is written once, and serves any number of lists of probes: posting lists (gram, part of
a strand, places), sorted by gram, and the letters of the parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import similarity as S
from seqloom.operators import search as Q

#: Bases of a part; offsets that are looked at together when windows near better ones are left out.
PART, BLOCK = 4096, 1 << 16
#: Parts whose postings a task writes, on average.
PARTS = 2048
#: Longest gram.
LONGEST = 12
#: Similarities that tell how long a run must be whole.
SEEDED = ("direct", "consistency", "textedit")

_CODE = np.zeros(256, np.int64)
_CODE[[ord(x) for x in "acgt"]] = [0, 1, 2, 1]


def packed(letters: np.ndarray, q: int) -> np.ndarray:
    """The q-grams of letters, two bits a letter."""
    codes, out = _CODE[letters], np.zeros(max(0, len(letters) - q + 1), np.int64)
    for i in range(q):
        out = out << 2 | codes[i : i + len(out)]
    return out


@dataclass(frozen=True)
class Seed:
    """A gram of a probe that a window must hold, unless it holds another: at ``at``, or up to ``shift`` places beside."""

    at: int
    shift: int


def whole_run(kind: str, m: int, least: float, o: S.Options) -> int:
    """Letters of a probe of ``m`` that follow each other and are whole in any window of score ``least`` or more (0: none need be)."""
    score = math.ceil(least)
    if score <= 0 or score > m:
        return 0 if score <= 0 else m
    broken = m - score  # mismatches or edits at most
    if kind == "consistency":
        return -(-score // (min(o.patience, broken) + 1))
    return m // (broken + 1)


def seeds_of(kind: str, m: int, least: float, o: S.Options, q: int) -> list[Seed]:
    """Places of the grams of which one at least is whole."""
    run = whole_run(kind, m, least, o)
    if run < q:
        raise ValueError(f"a score of {least} needs no whole run of {q} letters: take shorter grams or a search of all windows")
    broken = m - math.ceil(least)
    if kind == "consistency":  # the run may be anywhere
        return [Seed(at, 0) for at in sorted({*range(0, m - q + 1, run - q + 1), m - q})]
    # Blocks side by side: one mismatch or edit breaks one of them.  Windows have the probe's length,
    # so as many letters go as come, and no block moves by more than half of the edits.
    return [Seed(k * run, broken // 2 if kind == "textedit" else 0) for k in range(broken + 1)]


def gram_size(probes: list[tuple[str, str]], kinds: list[str], least: float, o: S.Options = S.Options()) -> int:
    """The longest grams that find all windows of a list of probes."""
    return min(LONGEST, *(whole_run(k, len(p), least, o) for k in kinds for _, p in probes))


def postings(parts: DataFrame, q: int) -> DataFrame:
    """``gram, accession, strand, part, offsets``: where each gram begins in ``parts(accession, strand, part, at, piece)``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (at, piece) in enumerate(zip(batch.column("at").to_pylist(), batch.column("piece").to_pylist())):
                grams = packed(np.frombuffer(piece.encode(), np.uint8), q)[:PART]
                order = np.argsort(grams, kind="stable")
                found, first = np.unique(grams[order], return_index=True)
                own = lambda c: batch.column(c).take(pa.array(np.full(len(found), i)))  # noqa: B023, E731
                offsets = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)).astype(np.int32)), pa.array((order + at).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(found), own("accession"), own("strand"), own("part"), offsets], names=["gram", "accession", "strand", "part", "offsets"])

    return parts.mapInArrow(index, "gram long, accession string, strand string, part int, offsets array<int>")


def write_index(genomes: DataFrame, path: str, q: int, longest: int) -> str:
    """Index of both strands of ``genomes(accession, dna)`` for grams of ``q`` letters and probes of ``longest`` letters at most.

    Two tables: ``parts`` with letters, ahead as far as the windows of the part's last places need, and ``grams``.
    """
    spark = genomes.sparkSession
    both = Q.strands(genomes.select(F.col("accession").cast("string").alias("accession"), "dna"))
    cut = Q.chunks(both, q, 0, PART, longest - q)
    cut.select("accession", "strand", "length", F.col("chunk").alias("part"), "at", "piece").write.parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    # Short grams are few, and each has postings in all parts: a gram is many tasks' work, and tasks grow in number with the parts.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // PARTS))
    dealt = parts.select("accession", "strand", "part", "at", "piece").repartition(tasks, "accession", "strand", "part")
    order = ("gram", "accession", "strand", "part")
    postings(dealt, q).repartitionByRange(tasks, *order).sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    return path


def candidates(spark: SparkSession, path: str, probes: list[tuple[str, str]], kinds: list[str], least: float, q: int, o: S.Options = S.Options()) -> DataFrame:
    """``nth, accession, strand, offset``: each window that may score ``least`` with a probe, once."""
    rows = set()
    for nth, (_, probe) in enumerate(probes):
        grams = packed(np.frombuffer(probe.encode(), np.uint8), q).tolist()
        rows |= {(grams[s.at], nth, s.at, s.shift, len(probe)) for k in kinds for s in seeds_of(k, len(probe), least, o, q)}
    wanted = spark.createDataFrame(sorted(rows), "gram long, nth int, at int, shift int, width int")
    # The probes' grams go to the postings: dealt out by gram, all postings of one would be one task's.
    met = spark.read.parquet(f"{path}/grams").join(F.broadcast(wanted), "gram")
    places = met.select("nth", "accession", "strand", "at", "shift", "width", F.explode("offsets").alias("place"))
    moved = places.select("nth", "accession", "strand", "width", F.explode(F.transform(F.sequence(-F.col("shift"), F.col("shift")), lambda d: F.col("place") - F.col("at") + d)).alias("offset"))
    return moved.where("offset >= 0").select("nth", "accession", "strand", "width", "offset").distinct()


def scored(spark: SparkSession, path: str, found: DataFrame, probes: list[tuple[str, str]], weights: dict[str, float], least: float, o: S.Options) -> DataFrame:
    """Candidates with their letters and scores, those of ``least`` or more."""
    kinds = list(weights)
    kernels = {k: S.kernel(k) for k in kinds}
    parts = spark.read.parquet(f"{path}/parts")
    near = found.withColumn("part", F.floor(F.col("offset") / PART).cast("int")).join(parts, ["accession", "strand", "part"])
    near = near.where(F.col("offset") + F.col("width") <= F.col("length"))
    windows = near.select("nth", "accession", "strand", "length", "offset", F.substring("piece", F.col("offset") - F.col("at") + 1, F.col("width")).alias("window"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nth = batch.column("nth").to_numpy()
            order = np.argsort(nth, kind="stable")
            batch, nth = batch.take(pa.array(order)), nth[order]
            for n in np.unique(nth).tolist():
                rows = batch.slice(*(lambda a, b: (a, b - a))(*np.searchsorted(nth, [n, n + 1]).tolist()))
                name, probe = probes[n]
                text = rows.column("window")
                letters = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8).reshape(len(rows), -1)
                each = {k: np.asarray(kernels[k](probe, letters, o), float) for k in kinds}
                total = sum(each[k] * w for k, w in weights.items()) / sum(weights.values())
                keep = np.flatnonzero((total >= least) & (total > 0))
                same = lambda v: pa.array([v] * len(keep), pa.string())  # noqa: B023, E731
                own = [rows.column(c).take(pa.array(keep)) for c in ("nth", "accession", "strand", "length", "offset", "window")]
                yield pa.RecordBatch.from_arrays([own[0], same(probe), same(name), *own[1:5], pa.array(total[keep]), own[5], same(None), *(pa.array(each[k][keep]) for k in kinds)], names=["nth", "probe", "name", "accession", "strand", "length", "offset", "weighted", "window", "ahead", *(f"score_{k}" for k in kinds)])

    schema = "nth int, probe string, name string, accession string, strand string, length int, offset int, weighted double, window string, ahead string, " + ", ".join(f"score_{k} double" for k in kinds)
    return windows.mapInArrow(score, schema)


def peaks(rows: DataFrame, distance: int) -> DataFrame:
    """Windows that no better one lies near; a strand is looked at in blocks, to which the rows beside their edges are added."""
    reach = distance - 1
    blocks = F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda d: F.floor((F.col("offset") + d) / BLOCK).cast("int")))
    near = Window.partitionBy("nth", "accession", "strand", "block").orderBy("offset").rangeBetween(-reach, reach)
    each = rows.withColumn("block", F.explode(blocks)).withColumn("peak", F.max("weighted").over(near))
    return each.where((F.col("weighted") == F.col("peak")) & (F.col("block") == F.floor(F.col("offset") / BLOCK))).drop("block", "peak")


def seed_search(
    spark: SparkSession,
    path: str,
    probes: list[tuple[str, str]],
    weights: dict[str, float],
    least: float,
    q: int,
    options: S.Options = S.Options(),
    top_k: int | None = 20,
    distance: int = 5,
    ascending: bool = False,
    per_genome: bool = False,
    render: bool = False,
) -> DataFrame:
    """``search`` over the genomes of an index, of windows that score ``least`` or more: the same rows.

    ``weights`` names similarities of SEEDED.  A weighted mean of ``least`` needs one similarity to reach it, so the seeds of
    all are looked up.  A window that exceeds a candidate reaches the score too, so local maxima are found among candidates.
    ``least`` must leave runs of ``q`` letters whole (``gram_size``); else it is an error, as all windows would be candidates.
    """
    weights = S.positive_weights(weights)
    if other := set(weights) - set(SEEDED):
        raise ValueError(f"no seeds are known for {sorted(other)}")
    given = [(name, probe.lower()) for name, probe in probes]
    for _, probe in given:
        S.similarity("direct", probe, F.lit(""))  # letters
    found = candidates(spark, path, given, list(weights), least, q, options)
    kept = peaks(scored(spark, path, found, given, weights, least, options), distance)
    return Q.ranked(kept, list(weights), options, top_k, ascending, least, per_genome, render)
