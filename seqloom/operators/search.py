"""Search of probes in genomes on both strands: windows, scores, local maxima, best k.

Genomes are cut into chunks first, in one pass over each strand, and the chunks are dealt out to all
tasks, so a chromosome is not one task's work.  A chunk carries what its windows and the suppression
at its edges need (a halo), so results don't depend on the chunk size.

Two engines give the same rows.  ``arrow`` scores all windows of many chunks at once in numpy, probe by probe, and
emits the best local maxima of each task only, without a shuffle before the ranking.  ``columns`` keeps to Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import dna as D
from seqloom.functions import similarity as S
from seqloom.functions import kernels as K

#: Similarities that match expressions against the letters from a window's start on.
BY_EXPRESSION = {"pattern", "blat"}
CHUNK = 4096
#: Windows of a chunk where each becomes a row: a slice costs its distance from the chunk's start.
WINDOW_CHUNK = 256
#: Probes that one task scores on a chunk; more are dealt out too.
PROBES = 64


def strands(genomes: DataFrame) -> DataFrame:
    """``accession, strand, dna`` for both strands of ``genomes(accession, dna)``."""
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("dna").alias("dna")), F.struct(F.lit("-").alias("strand"), D.reverse_complement("dna").alias("dna")))
    return genomes.select("accession", F.explode(both).alias("s")).select("accession", "s.strand", "s.dna")


def chunks(sequences: DataFrame, width: int, halo: int = 0, size: int = CHUNK, ahead: int = 0) -> DataFrame:
    """Adds ``length, chunk, core, cores, at, piece``: windows ``core`` to ``core + cores`` (0-based) are the
    chunk's own, and ``piece`` starts at window ``at``, ``halo`` windows before where there are any.  A piece ends
    ``halo`` windows after its core, and ``ahead`` bases after those windows.

    A sequence is split once into parts of equal size; a piece is a part with the ends of its neighbours, so
    the work is linear in the sequence's length.
    """
    size = max(size, halo + 1)
    after = width - 1 + halo + ahead
    more = -(-after // size)
    parts = F.regexp_extract_all("dna", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def pieces(all_parts: Column) -> Column:
        def piece(part: Column, k: Column) -> Column:
            before = F.when(k > 0, F.right(F.get(all_parts, k - 1), F.lit(halo))).otherwise("")
            behind = F.left(F.concat_ws("", *[F.coalesce(F.get(all_parts, k + i), F.lit("")) for i in range(1, more + 1)]), F.lit(after)) if after else F.lit("")
            return F.struct(k.cast("int").alias("chunk"), F.concat(before, part, behind).alias("piece"))

        return F.transform(all_parts, piece)

    # transform(array(x), ...)[0] names x once, where a lambda would compute it for each element.
    cut = sequences.withColumn("length", F.length("dna")).where(F.col("length") >= width).select("*", F.explode(F.transform(F.array(parts), pieces)[0]).alias("c"))
    core = F.col("c.chunk") * size
    cut = cut.select(*[c for c in cut.columns if c not in ("dna", "c")], "c.chunk", core.alias("core"), F.least(F.lit(size), F.col("length") - width + 1 - core).alias("cores"), F.greatest(F.lit(0), core - halo).alias("at"), "c.piece")
    return cut.where("cores > 0")


def windows(sequences: DataFrame, width: int, size: int = WINDOW_CHUNK, halo: int = 0, ahead: int = 0) -> DataFrame:
    """One row per window: ``accession, strand, length, chunk, offset, is_core, window``; with ``ahead`` also the ``ahead``
    bases from the window's first on, fewer at the end of the sequence."""
    cut = chunks(sequences, width, halo, size, max(0, ahead - width))
    last = F.least(F.col("length") - width, F.col("core") + F.col("cores") - 1 + halo) - F.col("at")
    rows = cut.select("accession", "strand", "length", "chunk", "core", "cores", "at", "piece", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("i"))
    offset = F.col("at") + F.col("i")
    extra = [F.substring("piece", F.col("i") + 1, F.lit(ahead)).alias("ahead")] if ahead else []
    return rows.select("accession", "strand", "length", "chunk", offset.alias("offset"), ((offset >= F.col("core")) & (offset < F.col("core") + F.col("cores"))).alias("is_core"), F.substring("piece", F.col("i") + 1, F.lit(width)).alias("window"), *extra)


def hit_position(strand: Column, offset: Column, width: Column | int, length: Column) -> tuple[Column, Column]:
    """1-based (start, end) of a window; start is above end on the minus strand."""
    start = F.when(strand == "+", offset + 1).otherwise(length - offset)
    end = F.when(strand == "+", offset + width).otherwise(length - (offset + width - 1))
    return start.cast("long"), end.cast("long")


def local_maxima(scored: DataFrame, distance: int, by: list[str], score: str = "score", order: str = "offset") -> DataFrame:
    """Rows with a score above 0 that no row within ``distance - 1`` places exceeds; ties all stay."""
    near = Window.partitionBy(*by).orderBy(order).rowsBetween(-(distance - 1), distance - 1)
    return scored.withColumn("peak", F.max(score).over(near)).where((F.col(score) > 0) & (F.col(score) == F.col("peak"))).drop("peak")


def best(found: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``; ranks are limited before the shuffle."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


#: Letters that are scored at once, but for a longer piece; what stands between pieces matches nothing.
LETTERS, GAP = 1 << 18, b"\n"


@dataclass
class Pieces:
    """Pieces of genomes one after the other, with gaps between: the windows of all of them at once."""

    data: np.ndarray  # letters
    start: np.ndarray  # of pieces, in data
    size: np.ndarray

    @staticmethod
    def of(pieces: list[str], gap: int) -> Pieces:
        size = np.array([len(x) for x in pieces], np.int64)
        start = np.cumsum(size + gap) - size - gap
        return Pieces(np.frombuffer((GAP * gap).join(x.encode() for x in pieces) + GAP * gap, np.uint8), start, size)

    def room(self) -> np.ndarray:
        """Letters from each place to its piece's end."""
        edge = np.repeat(self.start + self.size, np.diff(self.start, append=len(self.data)))
        return np.maximum(edge - np.arange(len(self.data)), 0)

    def marked(self, first: np.ndarray, stop: np.ndarray, places: int) -> np.ndarray:
        """Which places lie in ``first <= place < stop`` of some piece, places within it."""
        stop = np.maximum(stop, first)
        edges = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edges, np.minimum(self.start + first, len(self.data)), 1)
        np.add.at(edges, np.minimum(self.start + stop, len(self.data)), -1)
        return np.cumsum(edges)[:places] > 0


def window_scores(name: str, kernel: S.Kernel | None, probe: str, letters: np.ndarray, pieces: Pieces, o: S.Options) -> np.ndarray:
    """Scores of all windows of ``pieces.data`` (``letters``: windows x places), by the kernel if the similarity has one."""
    m = len(probe)

    def matched(expression: str, width: int) -> np.ndarray:
        """Which windows, taken with ``width`` letters as far as their piece goes, match from their start."""
        start = np.arange(len(letters))
        size = np.minimum(width, pieces.room()[: len(letters)])
        bounds = np.concatenate([[0], np.cumsum(size)])
        flat = pieces.data[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
        column = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
        return pc.match_substring_regex(column, expression).to_numpy(zero_copy_only=False)

    if name == "pattern":
        if not o.must:
            return np.zeros(len(letters))
        compiled = S.compile_pattern(probe, list(o.must), list(o.optional))
        extra = sum((np.where(matched(f"^(?:{e})", m), s, 0) for e, s in compiled.optional), np.zeros(len(letters)))
        return np.where(matched(f"^(?:{compiled.must})", m), compiled.must_score + extra, 0).astype(float)
    if name == "blat":
        expression = S.two_anchors(probe, o.middle_limit, o.end_limit)
        return np.zeros(len(letters)) if expression is None else matched(expression, S.anchor_reach(o.middle_limit, o.end_limit)).astype(float)
    return np.asarray(kernel(probe, letters, o), float)


def _peaks(score: np.ndarray, distance: int) -> np.ndarray:
    top = score.copy()
    for k in range(1, distance):
        top[k:] = np.maximum(top[k:], score[:-k])
        top[:-k] = np.maximum(top[:-k], score[k:])
    return (score > 0) & (score == top)


def search(
    probes: list[tuple[str, str]],
    genomes: DataFrame,
    weights: dict[str, float],
    options: S.Options = S.Options(),
    top_k: int | None = 20,
    distance: int = 5,
    ascending: bool = False,
    min_similarity: float | None = None,
    engine: str = "arrow",
    per_genome: bool = False,
    chunk: int = CHUNK,
    render: bool = False,
    compat: bool = False,
) -> DataFrame:
    """Best windows of each probe in ``genomes(accession, dna)``, both strands.

    Returns ``name, accession, strand, start, end, offset, weighted, scores, window, rank``.  ``weights`` names
    the similarities; a window scores their weighted mean, and only scores above 0 count.  Within a
    strand, windows that a better one within ``distance - 1`` offsets exceeds are left out.  Ranks are
    by score (``ascending``: the least first), accession, ``+`` before ``-``, and offset, over all
    genomes or in each.  Probes are lower-cased; genomes shorter than a probe have no window.

    A similarity of ``register_similarity`` that has a kernel is scored by it; with one that has Columns only, all are scored by Columns.

    Probes may share a name, and are ranked one by one.  Without ``top_k`` all such windows are given, without ranks.

    ``render`` adds ``nth`` and ``probe``, the probe's place in the list and its letters, and ``renderings``: the rows of each
    similarity's alignment, drawn for the best only.
    ``compat`` suppresses within the 32nd parts of a strand (one part if it is shorter than 32 bases), not across their edges.
    """
    weights = S.positive_weights(weights)
    kinds = list(weights)
    given = [(name, probe.lower()) for name, probe in probes]
    for _, probe in given:
        S.similarity("direct", probe, F.lit(""))  # letters
    ahead = S.anchor_reach(options.middle_limit, options.end_limit) if S.AHEAD & set(kinds) else 0
    if engine == "columns" or any(S.kernel(k) is None for k in kinds if k not in BY_EXPRESSION):
        kept = _search_columns(given, strands(genomes), weights, options, distance, chunk, ahead, compat)
    else:
        kept = _search_arrow(given, strands(genomes), weights, options, distance, chunk, ahead, compat, None if per_genome else top_k, ascending, min_similarity)
    return ranked(kept, kinds, options, top_k, ascending, min_similarity, per_genome, render)


def ranked(kept: DataFrame, kinds: list[str], options: S.Options, top_k: int | None, ascending: bool, min_similarity: float | None, per_genome: bool, render: bool) -> DataFrame:
    """Positions, ranks and drawings of windows found."""
    scores = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*[F.col(f"score_{k}") for k in kinds]))
    start, end = hit_position(F.col("strand"), F.col("offset"), F.length("window"), F.col("length"))
    found = kept.select("nth", "probe", "name", "accession", "strand", start.alias("start"), end.alias("end"), F.col("offset").cast("long").alias("offset"), "weighted", scores.alias("scores"), "window", "ahead")
    if min_similarity is not None:
        found = found.where(F.col("weighted") >= min_similarity)
    if top_k is not None:
        score = F.col("weighted").asc() if ascending else F.col("weighted").desc()
        by = ["nth", "accession"] if per_genome else ["nth"]
        found = best(found, top_k, by, [score, F.col("accession").asc(), F.col("strand").asc(), F.col("offset").asc()])
    if not render:
        return found.drop("ahead", "nth", "probe")
    return found.withColumn("renderings", K.renderings(kinds, options)("probe", "window", F.coalesce("ahead", "window"))).drop("ahead")


def _part(length: Column, compat: bool) -> Column | None:
    """Offsets in a part of a strand, where suppression stops at the parts' edges."""
    return F.greatest(F.floor(length / 32), F.when(length < 32, length).otherwise(1)).cast("int") if compat else None


def _search_columns(given: list[tuple[str, str]], both: DataFrame, weights: dict[str, float], o: S.Options, distance: int, chunk: int, ahead: int, compat: bool) -> DataFrame:
    """A plan for each probe: for tests and small lists."""
    found = None
    for nth, (name, probe) in enumerate(given):
        rows = windows(both.withColumn("accession", F.col("accession").cast("string")), len(probe), min(chunk, WINDOW_CHUNK), distance - 1, ahead)
        text = lambda k: F.col("ahead" if k in S.AHEAD else "window")
        scored = rows.select("*", *[S.similarity(k, probe, text(k), o).alias(f"score_{k}") for k in weights])
        scored = scored.withColumn("weighted", S.weighted({k: F.col(f"score_{k}") for k in weights}, weights))
        part = F.floor(F.col("offset") / _part(F.col("length"), True)).cast("int") if compat else F.lit(0)
        kept = local_maxima(scored.withColumn("part", part), distance, ["accession", "strand", "chunk", "part"], "weighted").where("is_core")
        own = kept.select(F.lit(nth).alias("nth"), F.lit(probe).alias("probe"), F.lit(name).alias("name"), "accession", "strand", "length", "offset", "weighted", "window", *([] if ahead else [F.lit(None).cast("string").alias("ahead")]), *(["ahead"] if ahead else []), *[f"score_{k}" for k in weights])
        found = own if found is None else found.unionByName(own)
    return found


class _Best:
    """What a task has found: of each probe the first ``k`` by rank only, if ``k`` is given."""

    def __init__(self, k: int | None, ascending: bool, names: list[str]):
        self.k, self.sign, self.names = k, 1.0 if ascending else -1.0, names
        self.found: dict[int, list[pa.RecordBatch]] = {}
        self.edge: dict[int, float] = {}  # signed score of the k-th so far

    def passing(self, nth: int, score: np.ndarray) -> np.ndarray:
        """Which scores may still be among the first k; those equal to the k-th may, by their place."""
        return self.sign * score <= self.edge[nth] if nth in self.edge else np.ones(len(score), bool)

    def add(self, nth: int, rows: pa.RecordBatch) -> None:
        self.found.setdefault(nth, []).append(rows)
        if self.k is not None and sum(len(r) for r in self.found[nth]) > 2 * self.k + 1024:
            self._cut(nth)

    def _cut(self, nth: int) -> None:
        rows = pa.Table.from_batches(self.found[nth]).combine_chunks()
        rows = rows.append_column("signed", pc.multiply(rows["weighted"], self.sign))
        order = pc.sort_indices(rows, [("signed", "ascending"), ("accession", "ascending"), ("strand", "ascending"), ("offset", "ascending")])
        rows = rows.take(order[: self.k]).combine_chunks()
        if len(rows) == self.k:
            self.edge[nth] = rows["signed"][-1].as_py()
        self.found[nth] = rows.select(self.names).to_batches()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for nth in list(self.found):
            if self.k is not None:
                self._cut(nth)
            yield from self.found.pop(nth)


def _search_arrow(given: list[tuple[str, str]], both: DataFrame, weights: dict[str, float], o: S.Options, distance: int, chunk: int, ahead: int, compat: bool, k: int | None = None, ascending: bool = False, least: float | None = None) -> DataFrame:
    """All probes in one pass over the chunks, which are dealt out with blocks of probes.

    With ``k`` a task gives each probe's first k only, so what leaves the scan is bounded by tasks and probes.
    """
    kinds, sizes = list(weights), [len(probe) for _, probe in given]
    shortest, longest = min(sizes), max(sizes)
    halo, blocks = distance - 1, -(-len(given) // PROBES)
    kernels = {name: S.kernel(name) for name in kinds}  # go to the tasks, which don't know what was registered here
    names = ["nth", "probe", "name", "accession", "strand", "length", "offset", "weighted", "window", "ahead", *(f"score_{k}" for k in kinds)]
    schema = "nth int, probe string, name string, accession string, strand string, length int, offset int, weighted double, window string, ahead string, " + ", ".join(f"score_{k} double" for k in kinds)

    def scored(rows: pa.RecordBatch, block: int, best: _Best) -> None:
        texts = rows.column("piece").to_pylist()
        length, core, at = (rows.column(c).to_numpy().astype(np.int64) for c in ("length", "core", "at"))
        pieces = Pieces.of(texts, distance + longest)
        for nth in range(block * PROBES, min(len(given), (block + 1) * PROBES)):
            name, probe = given[nth]
            m = len(probe)
            n = np.minimum(length - m + 1, core + step + halo) - at
            letters = np.lib.stride_tricks.sliding_window_view(pieces.data, m)
            inside = pieces.marked(np.zeros(len(n), np.int64), n, len(letters))
            each = {k: window_scores(k, kernels[k], probe, letters, pieces, o) for k in kinds}
            total = np.where(inside, sum(each[k] * w for k, w in weights.items()) / sum(weights.values()), -1.0)
            if compat:
                peak = np.zeros(len(total), bool)
                for start, a0, count, size in zip(pieces.start.tolist(), at.tolist(), n.tolist(), np.where(length >= 32, length // 32, np.maximum(length, 1)).tolist()):
                    for a, b in _runs(a0, count, size) if count > 0 else []:
                        peak[start + a : start + b] = _peaks(total[start + a : start + b], distance)
            else:
                peak = _peaks(total, distance)
            keep = np.flatnonzero(peak & pieces.marked(core - at, np.minimum(n, core + step - at), len(letters)))
            if least is not None:
                keep = keep[total[keep] >= least]
            keep = keep[best.passing(nth, total[keep])]
            if len(keep):
                own = np.searchsorted(pieces.start, keep, "right") - 1
                place = keep - pieces.start[own]
                pairs = list(zip(own.tolist(), place.tolist()))
                same = lambda v: pa.array([v] * len(keep), pa.string())  # noqa: B023, E731
                columns = [pa.array(np.full(len(keep), nth, np.int32)), same(probe), same(name), rows.column("accession").take(pa.array(own)), rows.column("strand").take(pa.array(own)), pa.array(length[own].astype(np.int32)), pa.array((place + at[own]).astype(np.int32)), pa.array(total[keep])]
                columns += [pa.array([texts[i][p : p + m] for i, p in pairs], pa.string()), pa.array([texts[i][p : p + ahead] if ahead else None for i, p in pairs], pa.string())]
                best.add(nth, pa.RecordBatch.from_arrays([*columns, *(pa.array(each[k][keep]) for k in kinds)], names=names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, ascending, names)
        for batch in batches:
            block = batch.column("probes").to_numpy()
            order = np.argsort(block, kind="stable")
            batch, block = batch.take(pa.array(order)), block[order]
            size = pc.binary_length(batch.column("piece")).to_numpy().astype(np.int64) + distance + longest
            filled = np.cumsum(size) // LETTERS
            edges = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(filled, prepend=-1) != 0)).tolist()
            for a, b in zip(edges, [*edges[1:], len(batch)]):
                scored(batch.slice(a, b - a), int(block[a]), best)
                if k is None:
                    yield from best.flush()
        yield from best.flush()

    step = max(chunk, halo + 1)
    cut = chunks(both.withColumn("accession", F.col("accession").cast("string")), shortest, halo, chunk, longest - shortest + max(0, ahead - shortest))
    dealt = cut.select("accession", "strand", "length", "chunk", "core", "at", "piece", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("probes"))
    # Genomes are small in bytes and dear in time, so the number of tasks doesn't come from their size.
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")) * min(blocks, 16)
    dealt = dealt.repartition(tasks, "accession", "strand", "chunk", "probes")
    return dealt.select("accession", "strand", "length", "core", "at", "piece", "probes").mapInArrow(scan, schema)


def _runs(at: int, n: int, size: int | None) -> list[tuple[int, int]]:
    """Runs of the windows ``at`` to ``at + n`` that lie in one part of ``size`` offsets, from 0 on."""
    if size is None:
        return [(0, n)]
    edges = [0, *range(size - at % size, n, size), n]
    return list(zip(edges, edges[1:]))


def best_submatches(marks: DataFrame) -> DataFrame:
    """Stretches of a consistency alignment that reach its score.

    From ``id, start, end, marks, score`` (marks of ``*``, ``-`` and ``.``): ``.`` starts anew, ``*`` counts; each
    place where the count is the score gives ``id, left, right`` (1-based in the marks) and the genome
    positions ``sub_start, sub_end``, descending on the minus strand.  Places that follow with ``-`` repeat.
    """
    places = marks.select("id", "start", "end", "score", F.posexplode(F.split("marks", "")).alias("i", "mark")).where("mark <> ''")
    upto = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    runs = places.withColumn("run", F.sum((F.col("mark") == ".").cast("int")).over(upto))
    inside = Window.partitionBy("id", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    star = F.col("mark") == "*"
    counted = runs.withColumn("hits", F.sum(star.cast("int")).over(inside)).withColumn("first", F.min(F.when(star, F.col("i"))).over(inside))
    step = F.when(F.col("start") < F.col("end"), 1).otherwise(-1)
    full = counted.where((F.col("hits") == F.col("score")) & (F.col("hits") > 0) & (F.col("mark") != "."))
    return full.select("id", (F.col("first") + 1).cast("long").alias("left"), (F.col("i") + 1).cast("long").alias("right"), (F.col("start") + step * F.col("first")).cast("long").alias("sub_start"), (F.col("start") + step * F.col("i")).cast("long").alias("sub_end"))
