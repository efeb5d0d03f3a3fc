"""Packing of token sequences by bin completion, and the packed sequences as a Parquet store.

Pieces are at most one sequence long, so how many there are of each length is a table of ``capacity`` counts, whatever the
corpus' size.  The search works on those counts: it takes the longest length left, enumerates the undominated
fillings around it in order of their waste, and uses one as often as the counts allow; a branch is left when its waste says that
it can't beat the incumbent, which is best fit at first.  Its result is a list of patterns.

Pieces find their places without meeting each other: the n-th piece of a length (a task's own count, and how many of
that length the tasks before have) belongs to the n-th place that patterns have for the length.  Then the ids
move once to their sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm._shared import materialize, new_path, partitions
from seqloom.llm._text import byte_blocks
from seqloom.llm.token_store import BLOCK, encoder

CAPACITY, END_ID = 1024, 2
#: Nodes that the search visits at most, fillings that it tries around one longest piece, and how many of one waste it looks at.
NODES, BRANCHES, LOOKS = 4_000, 3, 16
#: Nodes between two tries to finish a branch by best fit where it ends.
FINISH = 32

#: A pattern: how many sequences have it, and its (length, how many) from the longest on.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


# Search on counts ---------------------------------------------------------------------------------


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit decreasing, by runs: sequences with equal room take pieces of one length alike."""
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            space = next((r for r in range(length, capacity) if room.get(r)), None)
            if space is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        room.setdefault(capacity - k * length, []).append((n, ((length, k),)))
                break
            n, held = room[space].pop()
            used = min(n, left)
            if used < n:
                room[space].append((n - used, held))
            room.setdefault(space - length, []).append((used, _with(held, length)))
            left -= used
    return [p for some in room.values() for p in some]


def _with(held: tuple[tuple[int, int], ...], length: int) -> tuple[tuple[int, int], ...]:
    if held and held[-1][0] == length:
        return (*held[:-1], (length, held[-1][1] + 1))
    return (*held, (length, 1))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs.

    For each ``t``: pieces longer than ``capacity - t`` are alone, those over half have one each, and what of the others from
    ``t`` on doesn't fit beside the latter needs more.
    """
    sizes = np.arange(capacity + 1)
    n, total = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]]), np.concatenate([np.cumsum((counts * sizes)[::-1])[::-1], [0]])
    half = capacity // 2
    best = -(-int(total[0]) // capacity)
    for t in range(1, half + 1):
        alone, big = int(n[capacity - t + 1]), int(n[half + 1] - n[capacity - t + 1])
        free = big * capacity - int(total[half + 1] - total[capacity - t + 1])
        best = max(best, alone + big + max(0, -(-(int(total[t] - total[half + 1]) - free) // capacity)))
    return best


class _Fillings:
    """Undominated fillings of the room beside one piece of the longest length left, least waste first.

    Sums are bit sets: bit ``s`` of a number says that some choice sums to ``s``.
    """

    def __init__(self, counts: list[int], longest: int, capacity: int):
        self.counts, self.longest, self.room = counts, longest, capacity - longest
        self.mask = (1 << (self.room + 1)) - 1
        self.sizes = [s for s in range(min(longest, self.room), 0, -1) if counts[s] - (s == longest) > 0]
        self.there = sum(1 << s for s in self.sizes)
        reach = [1]
        for s in reversed(self.sizes):
            sums, n, step = reach[-1], min(counts[s] - (s == longest), self.room // s), 1
            while n > 0:  # doubling: 1, 2, 4, ... copies and the rest
                k = min(step, n)
                sums |= sums << (k * s) & self.mask
                n, step = n - k, 2 * step
            reach.append(sums)
        self.reach = reach[::-1]  # reach[i]: sums of sizes from the i-th on

    def __iter__(self) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        """(waste, fillings with the longest piece first); after LOOKS dominated ones of a waste comes the next waste."""
        for waste in range(self.room + 1):
            if not self.reach[0] >> (self.room - waste) & 1:
                continue
            for found in islice(self._choices(0, self.room - waste), LOOKS):
                if not self._dominated(found, waste):
                    yield waste, ((self.longest, 1 + dict(found).get(self.longest, 0)), *((s, k) for s, k in found if s != self.longest))

    def _choices(self, i: int, target: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """Choices of sizes from the i-th on that sum to the target exactly, the longest pieces first."""
        stack = [(i, target, ())]
        while stack:
            i, target, held = stack.pop()
            if target == 0:
                yield held
                continue
            while i < len(self.sizes) and self.sizes[i] > target:
                i += 1
            if i == len(self.sizes) or not self.reach[i] >> target & 1:
                continue
            s = self.sizes[i]
            most = min(self.counts[s] - (s == self.longest), target // s)
            for k in range(0, most + 1):
                if self.reach[i + 1] >> (target - k * s) & 1:
                    stack.append((i + 1, target - k * s, (*held, (s, k)) if k else held))

    def _dominated(self, found: tuple[tuple[int, int], ...], slack: int) -> bool:
        """Whether a piece that is left out could take the place of some that are in, of no greater sum, within the waste."""
        free = self.there
        for s, k in found:
            if self.counts[s] - (s == self.longest) <= k:
                free &= ~(1 << s)
        single, more, one = 0, 1, 1  # sums of one piece; of none, two or more; of all
        for s, k in found:
            for _ in range(k):
                more |= (one & ~1) << s
                one |= one << s
            single |= 1 << s
        reach, equal = more | single, more & ~1
        covered, width = reach << 1 if slack else 0, 1
        while width < slack:  # reach, shifted by 1, 2, ... slack
            step = min(width, slack - width)
            covered, width = covered | covered << step, width + step
        return bool(free & (covered | equal))


def complete(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, branches: int = BRANCHES) -> list[Pattern]:
    """Patterns that take all pieces of ``counts`` (by length, 0 to capacity): bin completion with branch and bound.

    ``nodes`` and ``branches`` bound the search, not what it packs: beyond them the best solution so far stays.
    """
    best = best_fit(counts, capacity)
    fewest, least, total = sum(n for n, _ in best), lower_bound(counts, capacity), int((counts * np.arange(capacity + 1)).sum())
    left = counts.tolist()

    @dataclass
    class Node:
        options: Iterator
        tried: int = 0
        chosen: Pattern | None = None
        waste: int = 0

    def longest() -> int:
        return next((s for s in range(capacity, 0, -1) if left[s]), 0)

    path, wasted, visited, finish = [Node(iter(_Fillings(left, longest(), capacity)))] if total else [], 0, 0, 0
    while path and fewest > least and visited < nodes:
        node = path[-1]
        if node.chosen:  # back from below: undo
            n, parts = node.chosen
            for s, k in parts:
                left[s] += n * k
            wasted -= n * node.waste
            node.chosen = None
        visited += 1
        spare = (fewest - 1) * capacity - total - wasted  # waste that a better solution may still have
        option = next(node.options, None) if node.tried < branches else None
        if option is None or option[0] > spare:
            if visited >= finish and not node.tried:  # what is left, by best fit, may do
                finish = visited + FINISH
                rest = best_fit(np.array(left), capacity)
                if (n := sum(x.chosen[0] for x in path[:-1]) + sum(n for n, _ in rest)) < fewest:
                    best, fewest = [*(x.chosen for x in path[:-1]), *rest], n
                    continue
            path.pop()
            continue
        waste, parts = option
        n = min(left[s] // k for s, k in parts)
        if waste:
            n = min(n, spare // waste)
        node.tried, node.chosen, node.waste = node.tried + 1, (n, parts), waste
        for s, k in parts:
            left[s] -= n * k
        wasted += n * waste
        if not (top := longest()):
            best, fewest = [x.chosen for x in path], sum(x.chosen[0] for x in path)
            continue
        path.append(Node(iter(_Fillings(left, top, capacity))))
    return best


@dataclass
class Places:
    """Where the n-th piece of a length lies: sequence and offset, by runs of n."""

    first: list[np.ndarray]  # by length: n of the first piece of each run
    sequence: list[np.ndarray]
    copies: list[np.ndarray]  # pieces of the length in each sequence of the run
    offset: list[np.ndarray]

    @staticmethod
    def of(patterns: list[Pattern], capacity: int) -> Places:
        runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        seen, sequence = [0] * (capacity + 1), 0
        for n, parts in patterns:
            at = 0
            for s, k in parts:
                runs[s].append((seen[s], sequence, k, at))
                seen[s] += n * k
                at += s * k
            sequence += n
        columns = [np.array(r, np.int64).reshape(-1, 4) for r in runs]
        return Places(*[[c[:, i] for c in columns] for i in range(4)])

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for s in np.unique(length):
            own = np.flatnonzero(length == s)
            run = np.searchsorted(self.first[s], nth[own], "right") - 1
            q, r = np.divmod(nth[own] - self.first[s][run], self.copies[s][run])
            sequence[own], offset[own] = self.sequence[s][run] + q, self.offset[s][run] + r * s
        return sequence, offset


# Pieces and sequences -----------------------------------------------------------------------------

_PIECES = "doc_id long, piece int, start long, length int, task int, nth long, ids binary"
SEQUENCES = "sequence_id long, n_tokens int, pieces array<struct<doc_id:long,piece:int,start:long,length:int,offset:int>>, ids array<int>"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Token ids of all documents in pieces of ``capacity`` or less: ``ids`` are little-endian, of 2 bytes if the tokenizer's all fit, else 4.

    A longer document's first piece takes what is over.  ``nth`` counts a task's pieces of a length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        kind = np.dtype("<u2" if max(own.n_ids, end_id + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            for i, k, buf, offsets in byte_blocks(batch.column("text"), BLOCK):
                ids, bounds = own.encode(buf, offsets, end_id)
                size = np.diff(bounds)
                parts = -(-size // capacity)
                doc = np.repeat(np.arange(k), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                lead = size - (parts - 1) * capacity  # of the first piece
                start = np.where(piece > 0, lead[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, lead[doc])
                order = np.argsort(length, kind="stable")
                sizes, at, n = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(at, n) + np.repeat(seen[sizes], n)
                seen[sizes] += n
                edges = kind.itemsize * np.concatenate([[0], np.cumsum(length)])
                data = pa.py_buffer(ids.astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, k).take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start),
                        pa.array(length, pa.int32()),
                        pa.array(np.full(len(doc), task, np.int32)),
                        pa.array(nth),
                        pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int32)), data]),
                    ],
                    names=["doc_id", "piece", "start", "length", "task", "nth", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, _PIECES)


def bucketed(parts: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``parts`` written once, in buckets by task, and the table's name: a task writes one bucket, so nothing is shuffled.

    What is joined to it by task goes to the buckets, and the ids stay where they are.
    """
    spark = parts.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    parts.write.bucketBy(partitions(spark), "task").option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table), table


def placed(parts: DataFrame, capacity: int, nodes: int, branches: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; a row for each task says how many of each length came before."""
    runs = materialize(parts.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in runs.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[row["length"]] = row["n"]
    places = Places.of(complete(counts, capacity, nodes, branches), capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One row for each task: at most capacity entries.
    runs = runs.groupBy(F.col("task").alias("run_task")).agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))
    runs = runs.select("run_task", F.transform(F.sequence(F.lit(0), F.lit(capacity)), lambda i: F.coalesce(F.col("before")[i], F.lit(0))).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset, pa.int32())], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    met = parts.join(runs.hint("shuffle_hash"), F.col("task") == F.col("run_task"))
    met = met.select("doc_id", "piece", "start", "length", "ids", (F.col("nth") + F.get("before", F.col("length"))).alias("nth"))
    return met.mapInArrow(place, "doc_id long, piece int, start long, length int, ids binary, sequence_id long, offset int")


def write_sequences(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, capacity: int = CAPACITY, nodes: int = NODES, branches: int = BRANCHES) -> str:
    """Packs ``docs(doc_id, text)`` and writes ``sequence_id, n_tokens, pieces, ids``, a row for each sequence.

    ``pieces`` lists doc_id, piece, start (ids of the document before it), length and offset in order of offsets.  Each document is its ids
    and ``end_id``; only a longer one is cut, into pieces of ``capacity``, of which the first may be shorter.  A null text is as
    an empty one: the end id alone.  Rows of one doc_id, or without one, and equal rows are documents of their
    own; a text of any length is encoded whole; an empty table gives an empty store; other columns are ignored.
    How many sequences there are depends on lengths only, not on how the table is cut into tasks.
    """
    parts, table = bucketed(pieces(docs, tokenizer, end_id, capacity), "pieces")
    rows = placed(parts, capacity, nodes, branches)
    item = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    whole = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            edges, flat = items.offsets.to_numpy(), items.flatten()
            columns = {c: flat.field(c) for c in ("doc_id", "piece", "start", "length", "offset", "ids")}
            data = columns.pop("ids")
            at = data.buffers()[1]
            bounds = np.frombuffer(at, np.int32, len(data) + 1, 4 * data.offset)
            width = int(bounds[-1] - bounds[0]) // max(1, int(columns["length"].to_numpy().sum()))  # bytes of an id
            ids = np.frombuffer(data.buffers()[2], f"<u{width}", (bounds[-1] - bounds[0]) // width, bounds[0]).astype(np.int32) if len(data) else np.zeros(0, np.int32)
            tokens = (bounds[edges - edges[0]] - bounds[0]) // max(1, width)
            shape = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int32())])
            inner = pa.StructArray.from_arrays(list(columns.values()), fields=list(shape))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(np.diff(tokens), pa.int32()), pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), inner), pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(ids))],
                names=["sequence_id", "n_tokens", "pieces", "ids"],
            )

    whole.mapInArrow(lay, SEQUENCES).write.option("compression", "zstd").parquet(path)
    docs.sparkSession.sql(f"DROP TABLE {table}")
    return path


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of a store: what its sequences hold, piece by piece.

    The checksum is that of the piece's ids in the sequence as unsigned 32-bit little-endian.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner, ids = batch.column("pieces"), batch.column("ids")
            n, flat = np.diff(inner.offsets.to_numpy()), inner.flatten()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            at = np.repeat(ids.offsets.to_numpy()[:-1], n) + flat.field("offset").to_numpy()
            crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), flat.field("length").to_pylist(), strict=True)]
            sequence = batch.column("sequence_id").take(pa.array(np.repeat(np.arange(len(batch)), n)))
            yield pa.RecordBatch.from_arrays(
                [flat.field("doc_id"), flat.field("piece"), flat.field("start"), flat.field("length").cast(pa.int64()), pa.array(crc, pa.int64()), sequence, flat.field("offset").cast(pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    store = spark.read.schema(SEQUENCES).parquet(path)
    return store.select("sequence_id", "pieces", "ids").mapInArrow(check, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Writes the packed sequences of ``docs`` in the shared folder, reads them back and returns what they hold."""
    path = write_sequences(docs, new_path(docs.sparkSession, "sequences"), tokenizer, end_id, capacity)
    return read_pieces(docs.sparkSession, path)
