"""Language-model scores by online logistic context mixing.

A text is its words (A-Z lower-cased) and an end.  Each word has a *symbol*: the ``HEAD`` most
frequent words have one each, all others share that of their *class*, which is read off their letters.
A symbol is a path of binary decisions through a tree (classes, then Huffman), and the texts are
one stream of such decisions.  Every decision is predicted by

* its node alone, and hashed contexts of node and (1) the word before, (2) the two words before,
  (3) the last function word of the text and the class of the word before;

the logits of their counts are combined by weights that a gate selects (how often the longer contexts
have been seen), and the result is refined by an adaptive map of (node, probability).  Counts, weights and map are
learned online in one pass over each shard of training texts: a decision is predicted, and then learned.

What the symbol of a class leaves open, *which* of its words, is the word's share of the class'
counts, over the whole vocabulary; the Good-Turing share of words seen once is kept for words never
seen in training, which are *spelled*: bytes and a terminator are decisions again, under contexts of the
word's own bytes, learned from all distinct words.  The classes come from a metadata column of training
texts (by hash; any number of values) through letter statistics; what is scored is the text alone.  Probabilities
of a position sum to 1 at most, and so do those of texts.

A text is also a row of *pieces*, which end at words that their hash chooses (and at its end).  A piece is
one that occurred in another training text, by its share of all pieces of training texts, or is written word by
word: the two are mixed by the share of pieces that occur again.  So copies and shared passages score apart at any
size of the corpus; a training text's own pieces don't count for it.

Plan: 1. count distinct words (and letters by class); 2. the speller, over distinct words; 3. every
distinct word's count, symbol and spelling; 4. the online pass over training texts, shard by shard; counts and
maps of shards are summed, weights averaged; 5. scores of all texts, piece by piece.  Words beyond the most frequent ``TABLE``,
and pieces, get their counts by joins on two hashes.  What moves grows with the corpus; what is broadcast has a fixed size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._shared import materialize, partitions
from seqloom.llm._text import Words, mix64, span_hashes, word_blocks

#: Words with a symbol of their own, words whose last one is a context, and words in the table that tasks hold.
HEAD, FUNCTION, TABLE = 1 << 9, 64, 1 << 18
#: Classes of words, at most; values of the class column are hashed into so many.
CLASSES = 64
#: Cells of the letter statistics of a class.
LETTERS = 1 << 12
#: Hashed contexts of decisions, and the slots of each (2 to that power).
CONTEXTS, SLOT_BITS = 3, 20
#: Gate: how often the two words before, and the word before, have been seen at a node: 6 x 4.
GATES, INPUTS = 24, CONTEXTS + 2
#: Cells of the adaptive map: by node and by logit.
NODES, MAP_CELLS = 2048, 33
#: Tokens of a shard of training texts, words of one of the speller's, and shards of a task where there are many.
SHARD, SPELL_SHARD, TASK_SHARDS = 1 << 22, 1 << 19, 4
#: A text is cut after words whose hash ends in so many zero bits: pieces of 32 words on average.
PIECE_BITS = 5
#: Weights before learning, and tokens of a learning step at first and at most.
START, STEPS = (0.2, 0.2, 0.2, 0.5, 0.0), (1 << 9, 1 << 14)
_SLOT_BLOCK = 1 << 15
_GRID = 1 << 20  # weights of shards are rounded to it, so that sums don't depend on their order
_BIAS = np.float32(0.3)

#: Slots of the speller's hashed counts by context: the last 1, 2, 3, 4 bytes, the word so far.
SPELL_SLOTS = (1 << 16, 1 << 18, 1 << 19, 1 << 19, 1 << 19)
SPELL_GATES, SPELL_INPUTS = 24, len(SPELL_SLOTS) + 1
SPELL_CONTEXTS = 1024
STEP = 1 << 14
TERMINATOR = 256
_CHUNK = 20_000  # distinct words worked on at once

_BASE = np.concatenate([[0], np.cumsum(SPELL_SLOTS)]).astype(np.int64)
_SALT = mix64(np.arange(8, dtype=np.uint64) + np.uint64(31))
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Code:
    """Binary tree over symbols: decisions of symbol s are ``first[s]`` to ``first[s] + length[s]``."""

    length: np.ndarray
    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def of(cls, paths: list[list[tuple[int, int]]]) -> Code:
        length = np.array([len(p) for p in paths], np.int64)
        flat = [x for p in paths for x in p]
        return cls(length, np.cumsum(length) - length, np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.uint8))


def _paths(counts: np.ndarray, first_node: int = 0) -> list[list[tuple[int, int]]]:
    """(node, bit) from the root of a Huffman tree to each symbol; every symbol has a path, unseen ones too."""
    heap = [(int(c) * 4096 + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    inner = len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (inner, 0), (inner, 1)
        heapq.heappush(heap, (a + b, inner, inner))
        inner += 1
    paths = []
    for s in range(len(counts)):
        path, at = [], s
        while at in parent:
            at, bit = parent[at]
            path.append((at - len(counts) + first_node, bit))
        paths.append(path[::-1])
    return paths


def huffman(counts: np.ndarray) -> Code:
    return Code.of(_paths(counts))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, symbols with a TERMINATOR after each word, ends of words among those) of a binary column."""
    offs = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]] if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    ends = np.cumsum(np.diff(offs) + 1)
    symbol = np.full(int(ends[-1]) if len(words) else 0, TERMINATOR, np.int64)
    inner = np.ones(len(symbol), bool)
    inner[ends - 1] = False
    symbol[inner] = data
    return data, offs, symbol, ends


def _back(symbol: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """The symbol k places back within a word, plus 1; 0 before its start."""
    b = np.zeros(len(symbol), np.uint64)
    b[k:] = symbol[:-k] + 1
    b[pos < k] = 0
    return b


def _rate(seen: int) -> float:
    """Step size of the weights after so many decisions or tokens."""
    return max(0.06, 0.6 / (1 + 20 * seen / (1 << 20)))


# What spells a word -----------------------------------------------------------------------------


@dataclass
class Decisions:
    """Binary decisions of a run of words: slots (decisions x contexts), bits and map contexts."""

    word: np.ndarray
    bit: np.ndarray
    slot: list[np.ndarray]
    place: np.ndarray


def decisions(words: pa.Array, group: np.ndarray, code: Code) -> Decisions:
    """Decisions that spell each of ``words`` (a binary column) of these classes, and its terminator."""
    data, offs, symbol, ends = _letters(words)
    size = np.diff(offs) + 1
    owner = np.repeat(np.arange(len(words)), size)
    pos = np.arange(len(symbol)) - np.repeat(ends - size, size)
    keys, acc = [], (group[owner].astype(np.uint64) << np.uint64(40))
    for k in range(4):
        acc = acc | (_back(symbol, pos, k + 1) << np.uint64(9 * k))
        keys.append(mix64(acc + _SALT[k]))
    acc = group[owner].astype(np.uint64) << np.uint64(40)
    # The word so far: a chain over its bytes, from their places in the word on.
    before = np.zeros(len(symbol), np.uint64)
    last, left = symbol[:-1], pos[1:] > 0
    with np.errstate(over="ignore"):
        term = np.where(left, mix64(last.astype(np.uint64) + (pos[1:].astype(np.uint64) << np.uint64(9)) + _SALT[5]), np.uint64(0))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
        before = total - np.repeat(total[ends - size], size)
    keys.append(mix64(before + acc + _SALT[4]))
    length = code.length[symbol]
    at = np.repeat(np.arange(len(symbol)), length)
    step = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    cell = code.first[symbol][at] + step
    node, bit = code.node[cell], code.bit[cell]
    mixed = mix64(node.astype(np.uint64) + np.uint64(0x5DEECE66D))
    slot = [((keys[k][at] ^ mixed) & np.uint64(SPELL_SLOTS[k] - 1)).astype(np.int64) + _BASE[k] for k in range(len(SPELL_SLOTS))]
    place = (np.minimum(pos[at], 3) * 256 + np.minimum(node, 255)).astype(np.int64)
    return Decisions(owner[at], bit, slot, place)


@dataclass
class Speller:
    """What spelling a word takes; its size doesn't depend on the corpus."""

    code: Code
    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((SPELL_GATES, SPELL_INPUTS), 0.3, np.float32) * np.array([1] * len(SPELL_SLOTS) + [0], np.float32))
    map_seen: np.ndarray = field(default_factory=lambda: np.zeros((SPELL_CONTEXTS, MAP_CELLS)))
    map_ones: np.ndarray = field(default_factory=lambda: np.zeros((SPELL_CONTEXTS, MAP_CELLS)))
    learned: int = 0

    def inputs(self, d: Decisions, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all contexts and the gate of each decision; ``leave_out``: without this word's own counts."""
        x = np.empty((len(d.bit), SPELL_INPUTS), np.float32)
        own1 = d.bit.astype(np.float32) if leave_out else np.float32(0)
        own0 = 1 - own1 if leave_out else np.float32(0)
        seen = []
        for k, slot in enumerate(d.slot):
            n0 = np.maximum(self.zeros[slot].astype(np.float32) - own0, 0)
            n1 = np.maximum(self.ones[slot].astype(np.float32) - own1, 0)
            x[:, k] = np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))
            if k >= 3:
                seen.append(n0 + n1)
        x[:, -1] = 0.3
        gate = np.digitize(seen[1], (1, 2, 4, 16, 128)) * 4 + np.digitize(seen[0], (1, 4, 64))
        return x, gate

    @staticmethod
    def cells(logit: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(logit * 2) + MAP_CELLS // 2, 0, MAP_CELLS - 1).astype(np.int64)

    def log2(self, words: pa.Array, group: np.ndarray, leave_out: bool = False) -> np.ndarray:
        """Bits (negative) that spell each word."""
        out = np.zeros(len(words))
        for i in range(0, len(words), _CHUNK):
            d = decisions(words.slice(i, _CHUNK), group[i : i + _CHUNK], self.code)
            x, gate = self.inputs(d, leave_out)
            logit = np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -16, 16)
            p = 1 / (1 + np.exp(-logit.astype(np.float64)))
            cell = self.cells(logit)
            refined = (self.map_ones[d.place, cell] + 8 * p) / (self.map_seen[d.place, cell] + 8)
            p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
            out[i : i + _CHUNK] = np.bincount(d.word, np.log2(np.where(d.bit == 1, p, 1 - p)), minlength=min(_CHUNK, len(words) - i))
        return out

    def learn(self, words: pa.Array, group: np.ndarray) -> int:
        """One online pass over words that the counts include, each as if it had not been counted: weights first, then the map."""
        n = 0
        for i in range(0, len(words), _CHUNK):
            d = decisions(words.slice(i, _CHUNK), group[i : i + _CHUNK], self.code)
            x, gate = self.inputs(d, True)
            y = d.bit.astype(np.float32)
            a = 0
            while a < len(y):
                z = int(np.clip(self.learned // 8, 1 << 11, STEP))
                xs, g, ys = x[a : a + z], gate[a : a + z], y[a : a + z]
                logit = np.clip(np.einsum("ij,ij->i", xs, self.weights[g]), -16, 16)
                error = ys - 1 / (1 + np.exp(-logit))
                scale = _rate(self.learned) / (np.bincount(g, minlength=SPELL_GATES) + 64.0)
                for j in range(SPELL_INPUTS):
                    self.weights[:, j] += (scale * np.bincount(g, error * xs[:, j], minlength=SPELL_GATES)).astype(np.float32)
                flat = d.place[a : a + z] * MAP_CELLS + self.cells(logit)
                self.map_seen.ravel()[:] += np.bincount(flat, minlength=self.map_seen.size)
                self.map_ones.ravel()[:] += np.bincount(flat, ys, minlength=self.map_seen.size)
                a, self.learned = a + z, self.learned + len(ys)
            n += len(d.bit)
        return n


def _symbol_counts(words: DataFrame) -> np.ndarray:
    """Counts of bytes and terminators over distinct words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257, np.int64)
        for batch in batches:
            column = batch.column("word")
            offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            if len(column) and column.buffers()[2] is not None:
                total[:256] += np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]], minlength=256)
            total[TERMINATOR] += len(column)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257, dtype=np.int32)), pa.array(total)], names=["symbol", "n"])

    out = np.zeros(257, np.int64)
    got = words.select("word").mapInArrow(count, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    out[got["symbol"].to_numpy()] = got["n"].to_numpy()
    return out


def _add_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums tables of tasks block by block: counts (which stop at their type's end), or numbers in blocks below 0."""
    block, out = key[0].as_py(), None
    for batch in batches:
        for cells in batch.column("cells"):
            part = np.frombuffer(pa.decompress(cells.as_buffer(), _raw_size(block), "zstd"), np.uint32 if block >= 0 else np.float64)
            if out is None:
                out = part.copy()
            else:
                out += np.minimum(part, np.uint32(0xFFFFFFFF) - out) if block >= 0 else part
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pa.compress(out.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["block", "cells"])


def _raw_size(block: int) -> int:
    return 8 * _SLOT_BLOCK if block >= 0 else 8 * (GATES * INPUTS + 2 * NODES * MAP_CELLS + 1)


def _blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a flat table of (zeros, ones) pairs that hold anything, compressed."""
    parts = table.reshape(-1, 2 * _SLOT_BLOCK)
    for k in range(len(parts)):
        if parts[k].any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(parts[k].tobytes(), "zstd", asbytes=True)], pa.binary())], names=["block", "cells"])


def _whole(summed: pa.Table, slots: int) -> np.ndarray:
    """The flat table of pairs from summed blocks."""
    out = np.zeros(2 * slots, np.uint32)
    for k, cells in zip(summed["block"].to_pylist(), summed["cells"], strict=True):
        if k >= 0:
            out[2 * _SLOT_BLOCK * k : 2 * _SLOT_BLOCK * (k + 1)] = np.frombuffer(pa.decompress(cells.as_buffer(), _raw_size(k), "zstd"), np.uint32)
    return out


def bit_counts(words: DataFrame, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of all the speller's slots over distinct words; tables of tasks are summed block by block."""
    total = -(-int(_BASE[-1]) // _SLOT_BLOCK) * _SLOT_BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * total, np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, 2 * _CHUNK):
                d = decisions(batch.column("word").slice(i, 2 * _CHUNK), batch.column("symbol").to_numpy()[i : i + 2 * _CHUNK], code)
                for slot in d.slot:
                    np.add.at(table, 2 * slot + d.bit, np.uint32(1))
        yield from _blocks(table)

    summed = words.select("word", "symbol").mapInArrow(count, "block int, cells binary").groupBy("block").applyInArrow(_add_blocks, "block int, cells binary").toArrow()
    whole = _whole(summed, total)
    return np.ascontiguousarray(whole[::2]), np.ascontiguousarray(whole[1::2])


def _learned(words: DataFrame, model: Speller) -> Speller:
    """Each shard of distinct words is learned online, in order of hashes; weights are averaged, maps summed."""
    sent = words.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0.0
        own = Speller(sent.value.code, sent.value.zeros, sent.value.ones)

        def values() -> np.ndarray:
            weights = np.rint(own.weights.ravel().astype(np.float64) * _GRID) / _GRID * own.learned
            return np.concatenate([weights, own.map_seen.ravel(), own.map_ones.ravel(), [own.learned]])

        for shard, part in _runs(batches, lambda b: np.ones(b.num_rows), _CHUNK):
            if now is not None and shard != now:
                total = total + values()
                own = Speller(sent.value.code, sent.value.zeros, sent.value.ones)
            now = shard
            own.learn(part.column("word"), part.column("symbol").to_numpy())
        if now is not None:
            total = total + values()
            keep = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(total[keep])], names=["i", "v"])

    keyed = words.select(F.col("h").alias("key"), "word", "symbol")
    got = _shards(keyed, max(1, -(-keyed.count() // SPELL_SHARD))).select("shard", "word", "symbol").mapInArrow(learn, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    cells = SPELL_CONTEXTS * MAP_CELLS
    values = np.zeros(SPELL_GATES * SPELL_INPUTS + 2 * cells + 1)
    values[got["i"].to_numpy()] = got["v"].to_numpy()
    if values[-1]:
        model.weights = (values[: SPELL_GATES * SPELL_INPUTS] / values[-1]).astype(np.float32).reshape(SPELL_GATES, SPELL_INPUTS)
        model.map_seen = values[SPELL_GATES * SPELL_INPUTS : SPELL_GATES * SPELL_INPUTS + cells].reshape(SPELL_CONTEXTS, MAP_CELLS)
        model.map_ones = values[SPELL_GATES * SPELL_INPUTS + cells : -1].reshape(SPELL_CONTEXTS, MAP_CELLS)
    return model


def train_speller(words: DataFrame) -> Speller:
    """Counts from all distinct words of ``words(word, c, symbol)`` without one of their own; weights and map from those seen once, which are what new words are like."""
    code = huffman(_symbol_counts(words))
    return _learned(words.where("c = 1"), Speller(code, *bit_counts(words, code)))


def _is_train(column: str, mod: int, held: int):
    crc = F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return crc % mod != held


def _word_bytes(w: Words, first: np.ndarray) -> pa.Array:
    """The bytes of some words as a binary column."""
    start, size = w.start[first], w.end[first] - w.start[first]
    bounds = np.concatenate([[0], np.cumsum(size)])
    data = w.buf[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


# Words and their symbols ------------------------------------------------------------------------

_MARK = 0xFF  # a byte that no UTF-8 text holds: rows of letter statistics among those of words


def _letter_cells(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each letter with the two before it, ends of words among those)."""
    _, offs, symbol, ends = _letters(words)
    size = np.diff(offs) + 1
    pos = np.arange(len(symbol)) - np.repeat(ends - size, size)
    key = symbol.astype(np.uint64) | (_back(symbol, pos, 1) << np.uint64(9)) | (_back(symbol, pos, 2) << np.uint64(18))
    return (mix64(key + _SALT[6]) >> np.uint64(64 - 12)).astype(np.int64), ends


def _rows(docs: DataFrame, mod: int, held: int, column: str) -> DataFrame:
    """``row_doc, train, cls, text``: the class is read in training texts only, by the hash of its value."""
    train = _is_train("doc_id", mod, held)
    value = F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(CLASSES)) if column in docs.columns else F.lit(0)
    return docs.select(F.col("doc_id").cast("long").alias("row_doc"), train.alias("train"), F.when(train, value).otherwise(0).cast("int").alias("cls"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """``word, c``: all distinct words of all texts and their counts in training texts.

    The end is the word ''.  Blocks count within themselves first.  Rows that begin with _MARK, a class and a
    cell count letters of the class' training words, each once for every text that holds it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, ends = np.zeros(CLASSES * LETTERS, np.int64), 0
        for batch in batches:
            train, cls = batch.column("train").to_numpy(zero_copy_only=False), batch.column("cls").to_numpy()
            ends += int(train.sum())
            for w in word_blocks(batch.column("text"), block=1 << 21):
                part, own = train[w.first : w.first + w.n], cls[w.first : w.first + w.n].astype(np.int64)
                # A word of another class is another row here; in texts that don't train it only has to be known.
                group = np.where(part, own + 1, 0)
                key = mix64(w.hashes() + group.astype(np.uint64)[w.doc] * np.uint64(0x9E3779B97F4A7C15))
                _, first, place, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                of = group[w.doc[first]]
                words = _word_bytes(w, first)
                learned = np.flatnonzero(of > 0)
                cells, stops = _letter_cells(words.take(pa.array(learned)))
                # Texts that hold a word, so that it doesn't matter which texts are a block.
                pairs = np.sort(place + w.doc * len(first))
                texts = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % max(len(first), 1), minlength=len(first))
                times = np.repeat(texts[learned], np.diff(stops, prepend=0))
                letters += np.bincount(np.repeat(of[learned] - 1, np.diff(stops, prepend=0)) * LETTERS + cells, times, minlength=len(letters)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words, pa.array(np.where(of > 0, counts, 0))], names=["word", "c"])
        at = np.flatnonzero(letters)
        marks = np.zeros((len(at) + 1, 5), np.uint8)
        marks[1:, 0], marks[1:, 1] = _MARK, at // LETTERS
        marks[1:, 2], marks[1:, 3] = at % LETTERS >> 8, at % LETTERS & 255
        bounds = np.concatenate([[0, 0], 4 + 4 * np.arange(len(at))]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at) + 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(marks[1:, :4]).tobytes())])
        yield pa.RecordBatch.from_arrays([words, pa.array(np.concatenate([[ends], letters[at]]))], names=["word", "c"])

    return rows.select("train", "cls", "text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Symbols of words; all of it has a size of its own.

    Symbols are the ``head`` words by falling count, then one for each class, then the end.
    """

    hashes: np.ndarray  # of head words, ascending
    symbols: np.ndarray  # of those
    letters: np.ndarray  # LETTERS x classes: log-probabilities
    prior: np.ndarray
    group: np.ndarray  # class of each symbol, from 1 on
    n_head: int

    @property
    def end(self) -> int:
        return self.n_head + len(self.prior)

    def classes(self, words: pa.Array) -> np.ndarray:
        """The class of each word (a binary column), from its letters."""
        out = np.zeros(len(words), np.int64)
        for i in range(0, len(words), _CHUNK) if len(self.prior) > 1 else ():
            cells, ends = _letter_cells(words.slice(i, _CHUNK))
            out[i : i + _CHUNK] = (np.add.reduceat(self.letters[cells], np.concatenate([[0], ends[:-1]]), axis=0) + self.prior).argmax(axis=1)
        return out

    def of(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word."""
        if not len(self.hashes):
            return self.n_head + self.classes(words)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[near] == hashes
        out = self.symbols[near].copy()
        rare = np.flatnonzero(~known)
        out[rare] = self.n_head + self.classes(words.take(pa.array(rare)))
        return out


def _lexicon(words: DataFrame) -> Lexicon:
    """From the letter statistics (CLASSES x LETTERS rows at most) and the most frequent words."""
    marks = words.where(F.substring("word", 1, 1) == F.lit(bytes([_MARK]))).toArrow()
    table = np.zeros((CLASSES, LETTERS))
    for mark, n in zip(marks["word"].to_pylist(), marks["c"].to_pylist(), strict=True):
        table[mark[1], mark[2] << 8 | mark[3]] = n
    used = np.flatnonzero(table.sum(axis=1))
    table = table[used] if len(used) else table[:1]
    letters = np.log((table + 0.05) / (table + 0.05).sum(axis=1, keepdims=True)).astype(np.float32).T.copy()
    prior = np.log((table.sum(axis=1) + 1) / (table.sum() + len(table))).astype(np.float32)
    head = _frequent(_real(words).where("c > 0"), HEAD).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    column = head["word"].combine_chunks() if head.num_rows else pa.array([], pa.binary())
    data, offs, _, _ = _letters(column)
    h = span_hashes(data, offs[:-1], offs[1:])
    order = np.argsort(h, kind="stable")
    found = Lexicon(h[order], order.astype(np.int64), letters, prior, np.zeros(0, np.int64), len(h))
    found.group = np.concatenate([found.classes(column) + 1, np.arange(len(prior)) + 1, [len(prior) + 1]])
    return found


def _real(words: DataFrame) -> DataFrame:
    """Words without the end and the rows of letters."""
    return words.where((F.length("word") > 0) & (F.substring("word", 1, 1) != F.lit(bytes([_MARK]))))


def _tree(weight: np.ndarray, group: np.ndarray) -> tuple[Code, np.ndarray]:
    """Decisions of symbols (the group first, then the symbol in it), and each node's own logit of 1."""
    groups = np.unique(group)
    top = _paths(np.array([weight[group == g].sum() for g in groups]))
    paths, nodes = [[] for _ in weight], len(groups) - 1
    for g, start in zip(groups, top, strict=True):
        members = np.flatnonzero(group == g)
        for s, path in zip(members, _paths(weight[members], nodes), strict=True):
            paths[s] = start + path
        nodes += len(members) - 1
    code = Code.of(paths)
    w = np.repeat(weight.astype(np.float64), code.length)
    zeros, ones = (np.bincount(code.node[code.bit == b], w[code.bit == b], minlength=max(nodes, 1)) for b in (0, 1))
    return code, np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


# The stream of decisions ------------------------------------------------------------------------


@dataclass
class Stream:
    """Tokens of texts, ends among them: text, symbol and keys of contexts of each."""

    doc: np.ndarray
    end: np.ndarray
    symbol: np.ndarray
    keys: list[np.ndarray]
    word: np.ndarray  # hashes; 0 for ends


def stream(w: Words, h: np.ndarray, symbol: np.ndarray, lexicon: Lexicon) -> Stream:
    n, stops = len(h) + w.n, w.bounds[1:] + np.arange(w.n)
    end = np.zeros(n, bool)
    end[stops] = True
    words = ~end
    sym, word, doc = np.full(n, lexicon.end, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    sym[words], word[words], doc[words], doc[stops] = symbol, h, w.doc, np.arange(w.n)
    first = np.ones(n, bool)
    first[1:] = end[:-1]
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:], two[2:] = word[:-1], word[:-2]
    one[first] = two[first] = 0
    two[1:][first[:-1]] = 0
    # The last function word before a token, in the same text, and the class of the token before.
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    last = np.maximum.accumulate(np.where(sym < min(FUNCTION, lexicon.n_head), np.arange(n), -1))
    held = np.where(last >= begin, sym[np.maximum(last, 0)] + 1, 0)
    function, group = np.zeros(n, np.int64), np.zeros(n, np.int64)
    function[1:], group[1:] = held[:-1], lexicon.group[sym[:-1]]
    function[first] = group[first] = 0
    with np.errstate(over="ignore"):
        keys = [mix64(one + _SALT[0]) * _ODD, mix64(one * _ODD + two + _SALT[1]) * _ODD, mix64((function * 128 + group).astype(np.uint64) + _SALT[2]) * _ODD]
    return Stream(doc, end, sym, keys, word)


with np.errstate(over="ignore"):
    _NODE_HASH = mix64(np.arange(NODES, dtype=np.uint64) + np.uint64(0x5DEECE66D)) * _ODD


def _decide(s: Stream, a: int, b: int, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(token, node, bit, slot in each context) of the decisions of the tokens a to b."""
    symbol = s.symbol[a:b]
    length = code.length[symbol]
    token = np.repeat(np.arange(b - a, dtype=np.int32), length)
    cell = np.arange(len(token)) + np.repeat(code.first[symbol] - np.cumsum(length) + length, length)
    node = code.node[cell]
    mixed = _NODE_HASH[node]
    slots = []
    for key in s.keys:
        h = key[a:b][token]
        h += mixed  # both have been multiplied
        h >>= np.uint64(64 - SLOT_BITS)
        slots.append(h.view(np.int64))
    return token, node, code.bit[cell], slots


_SEEN2 = np.digitize(np.arange(256), (1, 2, 4, 16, 128)).astype(np.int64) * 4
_SEEN1 = np.digitize(np.arange(256), (1, 8, 128)).astype(np.int64)


@dataclass
class Mixer:
    """Counts of contexts, weights and map; its size doesn't depend on the corpus."""

    code: Code
    static: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros((CONTEXTS << SLOT_BITS, 2), np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array(START, np.float32), (GATES, 1)))
    map_seen: np.ndarray = field(default_factory=lambda: np.zeros(NODES * MAP_CELLS))
    map_ones: np.ndarray = field(default_factory=lambda: np.zeros(NODES * MAP_CELLS))
    tokens: int = 0

    def _logit(self, node: np.ndarray, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T)
        logit = self.static[node] * weights[0][gate] + _BIAS * weights[-1][gate]
        for k, part in enumerate(x, 1):
            logit += part * weights[k][gate]
        return np.clip(logit, -16, 16)

    def learn(self, s: Stream) -> None:
        """One online pass over the tokens, in steps that grow: each is predicted from what was before."""
        flat, done, n = self.counts.reshape(CONTEXTS, -1), 0, len(s.symbol)
        pairs = flat.view("<u8")  # zeros in the lower half, ones in the upper
        while done < n:
            upto = min(n, done + int(np.clip(self.tokens // 8, *STEPS)))
            _, node, bit, slots = _decide(s, done, upto, self.code)
            self.tokens, done = self.tokens + upto - done, upto
            x, seen = [], []
            for k, slot in enumerate(slots):
                both = pairs[k].take(slot).view("<u4")
                n0, n1 = both[::2].astype(np.float32), both[1::2].astype(np.float32)
                x.append(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))))
                if k < 2:
                    seen.append(np.minimum(n0 + n1, np.float32(255)).astype(np.uint8))
            gate = _SEEN2[seen[1]] + _SEEN1[seen[0]]
            logit = self._logit(node, x, gate)
            error = bit - 1 / (1 + np.exp(-logit))
            scale = _rate(self.tokens) / (np.bincount(gate, minlength=GATES) + 64.0)
            for k, part in enumerate([self.static[node], *x, _BIAS]):
                self.weights[:, k] += (scale * np.bincount(gate, error * part, minlength=GATES)).astype(np.float32)
            cell = self._cells(node, logit)
            self.map_seen += np.bincount(cell, minlength=NODES * MAP_CELLS)
            self.map_ones += np.bincount(cell, bit, minlength=NODES * MAP_CELLS)
            for k, slot in enumerate(slots):
                slot *= 2
                slot += bit
                np.add.at(flat[k], slot, np.uint32(1))

    @staticmethod
    def _cells(node: np.ndarray, logit: np.ndarray) -> np.ndarray:
        return np.minimum(node, NODES - 1) * MAP_CELLS + np.clip(np.rint(logit * 2) + MAP_CELLS // 2, 0, MAP_CELLS - 1).astype(np.int64)

    def freeze(self) -> Scorer:
        n = self.counts.astype(np.float32).reshape(CONTEXTS, -1, 2)
        seen = np.minimum(n.sum(axis=2), 255).astype(np.uint8)
        gates = [_SEEN1[seen[0]].astype(np.uint8), _SEEN2[seen[1]].astype(np.uint8)]
        share, trust = self.map_ones / np.maximum(self.map_seen, 1), self.map_seen / (self.map_seen + 8)
        return Scorer(self.code, self.static, np.log((n[:, :, 1] + 0.4) / (n[:, :, 0] + 0.4)).astype(np.float32), gates, self.weights, share.astype(np.float32), trust.astype(np.float32) / 2)


@dataclass
class Scorer:
    """A mixer that no longer learns: logits of slots, what they add to the gate, weights, and the map's share and weight."""

    code: Code
    static: np.ndarray
    logits: np.ndarray
    gates: list[np.ndarray]
    weights: np.ndarray
    share: np.ndarray
    trust: np.ndarray

    def log10(self, s: Stream, step: int = STEPS[1]) -> np.ndarray:
        """log10 probability of each token's symbol."""
        out = np.zeros(len(s.symbol))
        weights = np.ascontiguousarray(self.weights.T)
        for i in range(0, len(out), step):
            n = min(step, len(out) - i)
            token, node, bit, slots = _decide(s, i, i + n, self.code)
            gate = (self.gates[0].take(slots[0]) + self.gates[1].take(slots[1])).astype(np.intp)
            logit = self.static[node] * weights[0][gate] + _BIAS * weights[-1][gate]
            for k, slot in enumerate(slots):
                logit += self.logits[k].take(slot) * weights[k + 1][gate]
            p = 1 / (1 + np.exp(-np.clip(logit, -16, 16)))
            cell = Mixer._cells(node, logit)
            p += (self.share[cell] - p) * self.trust[cell]
            p = np.clip(np.where(bit == 1, p, 1 - p), 1e-6, 1 - 1e-6)
            out[i : i + n] = np.bincount(token, np.log10(p), minlength=n)
        return out


@dataclass
class Table:
    """The most frequent words by hash: their places are found by the upper bits of it."""

    hashes: np.ndarray
    start: np.ndarray
    deepest: int
    columns: dict[str, np.ndarray]

    @classmethod
    def of(cls, rows: pa.Table) -> Table:
        h = rows["h"].to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        start = np.searchsorted(h, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46)) if len(h) else np.zeros((1 << 18) + 1, np.int64)
        start[-1] = len(h)
        return cls(h, start.astype(np.int32), int(np.diff(start).max(initial=0)), {c: rows[c].to_numpy()[order] for c in rows.column_names if c != "h"})

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        cell = (h >> np.uint64(46)).astype(np.int64)
        at, stop = self.start[cell], self.start[cell + 1]
        out = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < stop)
        for _ in range(self.deepest):
            if not len(left):
                break
            here = at[left]
            hit = self.hashes[here] == h[left]
            out[left[hit]] = here[hit]
            left = left[~hit & (here + 1 < stop[left])]
            at[left] += 1
        return out


def _symbols(w: Words, h: np.ndarray, place: np.ndarray, table: Table, lexicon: Lexicon) -> np.ndarray:
    """The symbol of each word: from the table, or from its letters."""
    out = table.columns["symbol"][place].astype(np.int64) if len(table.hashes) else np.zeros(len(h), np.int64)
    rare = np.flatnonzero(place < 0)
    if len(rare):
        _, first, inverse = np.unique(h[rare], return_index=True, return_inverse=True)
        out[rare] = lexicon.of(_word_bytes(w, rare[first]), h[rare[first]])[inverse]
    return out


def _pieces(s: Stream, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece of each token, and of each piece: text, two hashes): pieces end after chosen words and at ends of texts."""
    word = s.word
    last = s.end | ((word & np.uint64((1 << bits) - 1)) == 0)
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    size = np.diff(np.append(start, len(word)))
    piece = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(word)) - np.repeat(start, size)
    places = np.arange(int(size.max(initial=0)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        whole = [mix64(np.add.reduceat(mix64(word * odd + mix64(places + _SALT[k])[place]), start) + size.astype(np.uint64)) for k, odd in ((3, _ODD), (4, np.uint64(0xD6E8FEB86659FD93)))]
    return piece, s.doc[start], whole[0].view(np.int64), whole[1].view(np.int64)


def _shards(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (with ``key``, a hash of them) in ``n`` shards by ``key``, each in one task and in order of keys."""
    tasks = min(n, max(partitions(rows.sparkSession), -(-n // TASK_SHARDS)))
    own = rows.withColumn("shard", F.pmod("key", F.lit(n)).cast("int"))
    return own.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "key")


def _runs(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray], block: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, rows) of runs of about ``block`` units (``size`` of a batch gives those of its rows): the same runs whatever the batches are."""
    held, now, done = [], None, 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        shard, units = batch.column("shard").to_numpy(), size(batch).astype(np.int64)
        before = np.cumsum(units) - units
        first = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))  # of each shard in the batch
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(shard))))
        base = -before[first]
        if now is not None and shard[0] == now[0]:
            base[0] += done
        at = before + base[of]
        cut = at // block
        starts = np.flatnonzero((np.diff(cut, prepend=-1) != 0) | (np.diff(shard, prepend=shard[0] - 1) != 0))
        for i, j in zip(starts, np.append(starts[1:], len(shard)), strict=True):
            run = (int(shard[i]), int(cut[i]))
            if held and run != now:
                yield now[0], whole()
                held = []
            held.append(batch.slice(i, j - i))
            now = run
        done = int(at[-1] + units[-1])
    if held:
        yield now[0], whole()


def _online(rows: DataFrame, mixer: Mixer, lexicon: Lexicon, table, tokens: int) -> Mixer:
    """Each shard of training texts is learned online from nothing; counts and maps are summed, weights averaged by tokens.

    Which shard a row is in, and its place there, come from its doc_id and text, and the number of shards from that of the
    tokens: how the table is cut into files and tasks doesn't matter.  Copies of a row are in one shard.
    """
    sent = rows.sparkSession.sparkContext.broadcast((mixer.code, mixer.static, lexicon))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, static, lexicon = sent.value
        own, now, counts, numbers = Mixer(code, static), None, None, 0.0

        def add() -> None:
            nonlocal own, counts, numbers
            weights = np.rint(own.weights.ravel().astype(np.float64) * _GRID) / _GRID * own.tokens
            numbers = numbers + np.concatenate([weights, own.map_seen, own.map_ones, [own.tokens]])
            if counts is None:
                counts = own.counts
            else:
                counts += np.minimum(own.counts, np.uint32(0xFFFFFFFF) - counts)
            own = Mixer(code, static)

        for shard, part in _runs(batches, lambda b: pc.binary_length(b.column("text")).to_numpy(), 1 << 20):
            if now is not None and shard != now:
                add()
            now = shard
            for w in word_blocks(part.column("text"), block=1 << 20):
                h = w.hashes()
                own.learn(stream(w, h, _symbols(w, h, table.value.find(h), table.value, lexicon), lexicon))
        if now is not None:
            add()
            yield from _blocks(counts.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pa.compress(numbers.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["block", "cells"])

    keyed = rows.where("train").select(F.xxhash64("row_doc", "text").alias("key"), "text")
    got = _shards(keyed, max(1, -(-tokens // SHARD))).select("shard", "text").mapInArrow(learn, "block int, cells binary").groupBy("block").applyInArrow(_add_blocks, "block int, cells binary").toArrow()
    mixer.counts = _whole(got, CONTEXTS << SLOT_BITS).reshape(-1, 2)
    for k, cells in zip(got["block"].to_pylist(), got["cells"], strict=True):
        if k < 0:
            numbers = np.frombuffer(pa.decompress(cells.as_buffer(), _raw_size(k), "zstd"), np.float64)
            mixer.weights = (numbers[: GATES * INPUTS] / numbers[-1]).astype(np.float32).reshape(GATES, INPUTS)
            mixer.map_seen, mixer.map_ones = (x.copy() for x in np.split(numbers[GATES * INPUTS : -1], 2))
    return mixer


def _frequent(rated: DataFrame, most: int) -> DataFrame:
    """The words of highest counts, ``most`` at most: whole classes of about equal counts, without a sort.

    There are a few thousand classes at any size, so their counts can go to the driver.
    """
    level = F.floor(F.log2(F.col("c") + 1.0) * 32).cast("int")
    sizes = rated.groupBy(level.alias("level")).count().collect()
    least, held = None, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return rated.where(F.lit(False) if least is None else level >= least)


def score(docs: DataFrame, mod: int = 7, held: int = 2, class_column: str = "lang", piece_bits: int = PIECE_BITS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for each row.

    Texts whose crc32(doc_id) mod ``mod`` is not ``held`` train; all are scored.  ``base_score`` is the
    add-one unigram's, ``score`` the model's log10 probability; ``bits_per_byte`` is the latter in bits
    over the UTF-8 bytes and one for the end.  The class column (optional) is read for training
    texts only.  Scores don't depend on how the table is cut into files and tasks, nor on the order of its rows.  Scores of training texts don't count their own pieces (see above).  A null text is as an empty one, of which only the end is scored; a null doc_id has
    the text ''.  Rows of one doc_id are rows of their own.  Texts of any length are learned and scored as wholes, in steps.
    Without training texts only spellings count; an empty table has no rows.
    """
    spark = docs.sparkSession
    rows = _rows(docs, mod, held, class_column)
    words = materialize(vocabulary(rows), "words")
    real = _real(words)
    totals = real.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = int(words.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0)
    n, v = int(totals["n"] or 0) + ends, int(totals["v"] or 0) + (ends > 0)
    lexicon = _lexicon(words)
    held_lexicon = spark.sparkContext.broadcast(lexicon)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            data, offs, _, _ = _letters(column)
            h, h2 = (span_hashes(data, offs[:-1], offs[1:], second=k) for k in (False, True))
            symbol = held_lexicon.value.of(column, h)
            yield pa.RecordBatch.from_arrays([column, pa.array(h.view(np.int64)), pa.array(h2.view(np.int64) >> 32), batch.column("c"), pa.array(symbol.astype(np.int32))], names=["word", "h", "h2", "c", "symbol"])

    known_words = materialize(real.mapInArrow(classify, "word binary, h long, h2 long, c long, symbol int"), "symbols")
    speller = spark.sparkContext.broadcast(train_speller(known_words.where((F.col("c") > 0) & (F.col("symbol") >= lexicon.n_head))))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled, new = np.zeros(batch.num_rows, np.float32), np.flatnonzero(batch.column("c").to_numpy() == 0)
            spelled[new] = speller.value.log2(batch.column("word").take(pa.array(new)), batch.column("symbol").to_numpy()[new]) * math.log10(2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "h2", "c", "symbol")), pa.array(spelled)], names=["h", "h2", "c", "symbol", "spelled"])

    rated = materialize(known_words.mapInArrow(rate, "h long, h2 long, c long, symbol int, spelled float"), "rated")
    weight, once = np.zeros(lexicon.end + 1, np.int64), np.zeros(lexicon.end + 1, np.int64)
    for x in rated.groupBy("symbol").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect():
        weight[x["symbol"]], once[x["symbol"]] = x["c"], x["once"]
    weight[-1] = ends
    # Of a class' counts, what is kept for words never seen; a head word has all of its own.
    first = lexicon.n_head
    novel = np.where(weight > 0, np.clip(np.maximum(once, 1) / np.maximum(weight, 1), 0, 0.5), 1.0)
    with np.errstate(divide="ignore"):
        of_known = np.where(weight > 0, np.log10(1 - novel) - np.log10(np.maximum(weight, 1)), 0.0)
    of_novel = np.log10(novel)

    code, static = _tree(weight, lexicon.group)
    top = Table.of(_frequent(rated.where("c > 0"), TABLE).drop("spelled").toArrow())
    c, symbol = top.columns["c"], top.columns["symbol"]
    floor = math.log10(n + v + 1)
    top.columns["rest"] = np.where(symbol < first, 0.0, np.log10(np.maximum(c, 1)) + of_known[symbol])
    top.columns["base"] = np.log10(c + 1.0) - floor
    table = spark.sparkContext.broadcast(top)
    scorer = spark.sparkContext.broadcast((_online(rows, Mixer(code, static), lexicon, table, n).freeze(), lexicon))
    end_base = math.log10(ends + 1) - floor

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, (model, lexicon) = table.value, scorer.value
        columns = table_.columns
        first_row, seen = TaskContext.get().partitionId() << 40, 0

        def block(rid: np.ndarray, piece: np.ndarray, kind: int, **given) -> pa.RecordBatch:
            """Rows of a kind: 0 texts, 1 pieces, 2 rare words."""
            columns = {"rid": pa.array(rid), "piece": pa.array(piece.astype(np.int32)), "kind": pa.array(np.full(len(rid), kind, np.int32))}
            return pa.RecordBatch.from_arrays([columns.get(c, given.get(c, pa.nulls(len(rid), t))) for c, t in kinds.items()], names=list(kinds))

        for batch in batches:
            for w in word_blocks(batch.column("text"), block=1 << 20):
                h, h2, doc = w.hashes(), span_hashes(w.buf, w.start, w.end, second=True).view(np.int64) >> 32, w.doc
                place = table_.find(h)
                if len(table_.hashes):
                    place[columns["h2"][place] != h2] = -1
                hit = place >= 0
                s = stream(w, h, _symbols(w, h, place, table_, lexicon), lexicon)
                token = model.log10(s)
                at, by = place[hit], doc[hit]
                words = np.flatnonzero(~s.end)
                token[words[hit]] += columns["rest"][at]
                piece, of, one, two = _pieces(s, piece_bits)
                rid = first_row + seen + w.first + np.arange(w.n)
                bounds = np.searchsorted(of, np.arange(w.n))
                sums = np.zeros((w.n, 6))
                sums[:, 0], sums[:, 1] = w.counts + 1, float(ends > 0) + np.bincount(by, minlength=w.n)
                sums[:, 2], sums[:, 3] = np.diff(w.offsets), end_base + np.bincount(by, columns["base"][at], minlength=w.n)
                sums[:, 4], sums[:, 5] = np.bincount(s.doc, token, minlength=w.n), np.bincount(of, minlength=w.n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)), pa.array(sums.ravel()))
                yield block(rid, np.full(w.n, -1), 0, row_doc=batch.column("row_doc").slice(w.first, w.n), train=batch.column("train").slice(w.first, w.n), sums=lists)
                # A text counts a piece once.
                train = batch.column("train").slice(w.first, w.n).to_numpy(zero_copy_only=False)[of]
                own = np.zeros(len(of), bool)
                own[np.unique(mix64(one.view(np.uint64) + mix64(of.astype(np.uint64))), return_index=True)[1]] = True
                yield block(rid[of], np.arange(len(of)) - bounds[of], 1, h=pa.array(one), h2=pa.array(two), train=pa.array(train), own=pa.array(own & train), value=pa.array(np.bincount(piece, token, minlength=len(of))))
                rare = np.flatnonzero(~hit)
                if len(rare):
                    yield block(rid[doc[rare]], (piece[words[rare]] - bounds[doc[rare]]), 2, h=pa.array(h[rare].view(np.int64)), h2=pa.array(h2[rare]))
            seen += batch.num_rows

    kinds = {"rid": pa.int64(), "piece": pa.int32(), "kind": pa.int32(), "h": pa.int64(), "h2": pa.int64(), "row_doc": pa.int64(), "train": pa.bool_(), "own": pa.bool_(), "value": pa.float64(), "sums": pa.list_(pa.float64())}
    gathered = rows.select("row_doc", "train", "text").mapInArrow(gather, "rid long, piece int, kind int, h long, h2 long, row_doc long, train boolean, own boolean, value double, sums array<double>")
    gathered = materialize(gathered, "gathered")
    # Pieces that occur in other training texts: `times` of all `pieces`.
    pieces = gathered.where("kind = 1").select("rid", "piece", "h", "h2", "train", "value", "own")
    held = materialize(pieces.where("own").groupBy("h", "h2").agg(F.count("*").alias("d")), "pieces")
    known_pieces = held.agg(F.sum("d").alias("n"), F.sum(F.when(F.col("d") > 1, F.col("d"))).alias("again")).first()
    n_pieces, again = int(known_pieces["n"] or 0), int(known_pieces["again"] or 0)
    copied = min(0.5, (again + 1) / (n_pieces + 2)) if n_pieces else 0.0
    written = math.log10(1 - copied)
    times = F.col("d") - F.col("train").cast("long")
    found = pieces.join(held, ["h", "h2"]).select("rid", "piece", times.alias("times"), "value").where("times > 0")

    rare = gathered.where("kind = 2").select("rid", "piece", "h", "h2").join(rated, ["h", "h2"], "left")
    known, unknown = (F.element_at(F.array(*[F.lit(float(x)) for x in values[first:]]), F.col("symbol") - first + 1) for values in (of_known, of_novel))
    rest = F.when(F.col("symbol") < first, 0.0).when(F.col("c") > 0, F.log10(F.col("c").cast("double")) + known).otherwise(unknown + F.col("spelled"))
    none = {"known": "double", "base": "double", "rest": "double", "times": "long", "value": "double", "row_doc": "long", "train": "boolean", "sums": "array<double>"}
    fill = lambda df, *have: df.select("rid", "piece", *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in none.items()])
    rare = rare.withColumn("known", (F.col("c") > 0).cast("double")).withColumn("base", F.log10(F.col("c") + 1.0) - floor).withColumn("rest", rest)
    parts = fill(rare, "known", "base", "rest").unionByName(fill(found, "times", "value")).unionByName(fill(gathered.where("kind = 0"), "row_doc", "train", "sums"))
    # Both sums go by text, so one shuffle serves them.
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    by_piece = parts.repartition("rid").groupBy("rid", "piece").agg(total("known"), total("base"), total("rest"), *[F.max(c).alias(c) for c in ("times", "value", "row_doc", "train")], F.first("sums", True).alias("sums"))
    as_written = F.col("value") + F.col("rest") + written
    as_copied = F.log10(F.col("times") * (copied / max(n_pieces, 1)))
    high = F.greatest(as_written, as_copied)
    gain = high + F.log10(F.pow(F.lit(10.0), as_written - high) + F.pow(F.lit(10.0), as_copied - high)) - as_written
    sums = by_piece.withColumn("gain", F.when(F.col("times").isNotNull(), gain).otherwise(0.0)).groupBy("rid").agg(
        F.max("row_doc").alias("doc_id"), F.max("train").alias("train"), F.first("sums", True).alias("sums"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum(F.col("rest") + F.col("gain")).alias("rest")
    )
    at = lambda j: F.col("sums")[j]
    sums = sums.select("doc_id", "train", at(0).alias("sum0"), (at(1) + F.col("known")).alias("sum1"), at(2).alias("sum2"), (at(3) + F.col("base")).alias("sum3"), (at(4) + at(5) * written + F.col("rest")).alias("sum4"))
    return sums.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        F.col("sum0").cast("long").alias("n_tokens"),
        F.col("sum1").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("sum3").alias("base_score"),
        F.col("sum4").alias("score"),
        (F.col("sum4") * -math.log2(10) / (F.col("sum2") + 1)).alias("bits_per_byte"),
    )
