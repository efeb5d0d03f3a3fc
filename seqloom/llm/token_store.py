"""Token-id output: ordered Parquet files of token lists, and selective reads of them.

Layout of a store (a folder of Parquet files):

* ``part`` INT, ``doc_id`` LONG, ``n_tokens`` LONG, ``local_start`` LONG: metadata, delta encoded;
* ``ids`` LIST<INT>: the tokens of one document with the end id, dictionary encoded.

Rows of a file ascend by ``doc_id`` and files ascend by ``part``.  Row groups are
bounded in bytes and page indexes are written, so a reader of the metadata
columns or of a doc_id range skips the token pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm._shared import new_path, partitions
from seqloom.llm._text import byte_blocks, span_hashes

STORE_SCHEMA = "part int, doc_id long, n_tokens long, local_start long, ids array<int>"

#: Parquet writer: dictionary for token ids, delta encodings (format v2) for the
#: metadata, 16 MB row groups with page indexes.
WRITE_OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}

#: Classes of bytes: space, other ASCII white space, letter, punctuation, anything else.
_SPACE, _WHITE, _LETTER, _PUNCT, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x20] = _SPACE
_CLASS[9:14] = _WHITE
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = _PUNCT
_CLASS[[c for c in range(0x41, 0x7B) if chr(c).isalpha()]] = _LETTER
#: White space of two or three UTF-8 bytes, as byte pairs and third bytes.
_WIDE_SPACE = {(0xC2, 0x85): None, (0xC2, 0xA0): None, (0xE1, 0x9A): {0x80}, (0xE2, 0x80): {*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF}, (0xE2, 0x81): {0x9F}, (0xE3, 0x80): {0x80}}

BLOCK = 1 << 19


def _edges(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell spans of one hash and size apart: the first and the last eight bytes, or a second hash of more than 16."""
    eights = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))
    size = np.minimum(stop - start, 8)
    mask = np.where(size < 8, (np.uint64(1) << (8 * size % 64).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
    head, tail = eights[start] & mask, eights[stop - size] & mask
    long = np.flatnonzero(stop - start > 16)
    tail[long] = span_hashes(buf, start[long], stop[long], second=True)
    return head, tail


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    Byte-level BPE never merges across its pre-tokens, so a text may be cut wherever
    a pre-token must begin and its pieces encoded apart.  Safe cuts are: a space or a
    newline between two characters that are not white space (before it, and after
    that newline), and punctuation after an ASCII letter.  A text with white space
    beyond ASCII, or with the literal of an added token such as ``<|endoftext|>``, is one piece: the
    library finds those literals first.  Pieces are known by a 64-bit hash, their length and all their
    bytes, or a second hash of more than 16; pieces that share a hash are told apart.  At most ``remember`` short ones are kept; then those
    that were not met again go.  With ``plain_literals`` special tokens in a text are text like other.
    """

    def __init__(self, tokenizer: str, remember: int = 450_000, plain_literals: bool = True):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain_literals
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._literals = [x.content.encode() for x in added if x.content and not (plain_literals and x.special)]
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a character of a token stands for one byte
            self._bytes[i] = len(token)
        self._remember = remember
        self._forget()

    def _forget(self) -> None:
        self._hash, self._head, self._tail = (np.zeros(0, np.uint64) for _ in range(3))
        self._at, self._len, self._uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._pool, self._used = np.zeros(1 << 16, np.uint16 if len(self._bytes) <= 1 << 16 else np.uint32), 0

    @property
    def n_ids(self) -> int:
        """One more than the largest id."""
        return len(self._bytes)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int64) for e in found]

    def _encode(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, counts): the ids of pieces in that order, one after the other.

        Pieces led by a space go to the library in long runs, which are cut by the tokens' lengths.
        """
        last = _CLASS[buf[start + size - 1]]
        second = _CLASS[buf[np.minimum(start + 1, len(buf) - 1)]]
        alike = not any(b" " in x for x in self._literals)  # pieces in a run must not make a literal together
        led = alike & (buf[start] == 0x20) & (size > 1) & (second > _WHITE) & ((last == _LETTER) | (last == _PUNCT))
        run, alone = np.flatnonzero(led), np.flatnonzero(~led)
        flat, counts = [], []
        for k in range(0, len(run), 5000):
            at, n = start[run[k : k + 5000]], size[run[k : k + 5000]]
            want = np.cumsum(n)
            text = buf[np.repeat(at - want + n, n) + np.arange(want[-1])].tobytes().decode("utf-8", "replace")
            (ids,) = self._ids([text])
            ends = np.cumsum(self._bytes[ids])
            cut = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and np.array_equal(ends[cut], want):
                flat.append(ids)
                counts.append(np.diff(cut, prepend=-1))
            else:  # the lengths of its tokens don't cut the run: one by one
                single = self._ids([buf[a : a + k].tobytes().decode("utf-8", "replace") for a, k in zip(at.tolist(), n.tolist(), strict=True)])
                flat += single
                counts.append(np.array([len(x) for x in single], np.int64))
        texts = [buf[a : a + n].tobytes().decode("utf-8", "replace") for a, n in zip(start[alone].tolist(), size[alone].tolist(), strict=True)]
        single = self._ids(texts)
        flat += single
        counts.append(np.array([len(x) for x in single], np.int64))
        return np.concatenate([run, alone]), np.concatenate([np.zeros(0, np.int64), *flat]), np.concatenate(counts)

    def _shrink(self) -> None:
        """Keeps the pieces that have been met again since they came, up to half of the memory."""
        keep = np.flatnonzero(self._uses > 0)
        if len(keep) > self._remember // 2:
            keep = np.flatnonzero(self._uses > 1)
        if len(keep) > self._remember // 2:
            keep = keep[:0]
        length = self._len[keep]
        before = np.cumsum(length) - length
        held = self._pool[np.repeat(self._at[keep] - before, length) + np.arange(length.sum())]
        for name in ("_hash", "_head", "_tail"):
            setattr(self, name, getattr(self, name)[keep])
        self._at, self._len, self._uses = before, length, np.zeros(len(keep), np.int32)
        self._pool, self._used = np.concatenate([held, np.zeros(1 << 16, held.dtype)]), len(held)

    def _cuts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places in ``buf`` where pieces begin."""
        kind = _CLASS[buf]
        begins = np.zeros(len(buf) + 1, bool)
        solid = kind > _WHITE
        between = solid[:-2] & solid[2:]
        space, line = buf[1:-1] == 0x20, buf[1:-1] == 0x0A
        begins[1:-2] = between & (space | line)
        begins[2:-1] |= between & line
        begins[1:-1] |= (kind[:-1] == _LETTER) & (kind[1:] == _PUNCT)
        # A cut looks at the bytes beside it, so none is made next to the edge of a text.
        full = np.flatnonzero(np.diff(offsets) > 0)
        first, last = offsets[full], offsets[full + 1] - 1
        at_last = begins[last] & ((buf[last] == 0x20) | (buf[last] == 0x0A))
        begins[last[at_last]] = False
        one = first + 1 <= last
        lead = first[one][(buf[first[one]] == 0x0A) | (buf[first[one]] == 0x20)]
        begins[lead + 1] &= kind[lead + 1] == _SPACE
        begins[offsets[:-1]] = False
        odd = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
        odd = odd[odd < len(buf) - 1]
        for (a, b), third in _WIDE_SPACE.items():
            hit = odd[(buf[odd] == a) & (buf[odd + 1] == b)]
            if third is not None:
                hit = hit[hit < len(buf) - 2]
                hit = hit[np.isin(buf[hit + 2], list(third))]
            for d in np.unique(np.searchsorted(offsets, hit, "right") - 1):
                begins[offsets[d] : offsets[d + 1]] = False
        data = buf.tobytes() if self._literals else b""
        for literal in self._literals:
            at = data.find(literal)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(literal) <= offsets[d + 1]:
                    begins[offsets[d] : offsets[d + 1]] = False
                    at = data.find(literal, int(offsets[d + 1]))
                else:  # across two texts
                    at = data.find(literal, at + 1)
        begins[first] = True
        return np.flatnonzero(begins[: len(buf)])

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``buf``, each with ``end_id`` last, and their bounds."""
        n = len(offsets) - 1
        if not len(buf):
            return np.full(n, end_id, np.int32), np.arange(n + 1)
        if len(self._hash) > self._remember:
            self._shrink()
        start = self._cuts(buf, offsets)
        stop = np.append(start[1:], len(buf))
        # Texts without bytes lie between pieces and don't matter here.
        h, size = span_hashes(buf, start, stop), stop - start
        unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        head, tail = _edges(buf, start, stop)
        if not all(np.array_equal(x[where][inverse], x) for x in (head, tail, size)):  # pieces that share a hash
            order = np.lexsort((size, tail, head, h))
            first = np.ones(len(order), bool)
            first[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (h, head, tail, size)], axis=0)
            where, inverse = order[first], np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(first) - 1
            unique = h[where]
        head, tail = head[where], tail[where]
        at = np.searchsorted(self._hash, unique)
        near = np.minimum(at, max(len(self._hash) - 1, 0))
        known = np.zeros(len(unique), bool)
        if len(self._hash):
            known = (self._hash[near] == unique) & (self._head[near] == head) & (self._tail[near] == tail)
        begin, length = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        begin[known], length[known] = self._at[near[known]], self._len[near[known]]
        self._uses[near[known]] += 1
        new = np.flatnonzero(~known)
        if len(new):
            order, flat, counts = self._encode(buf, start[where[new]], size[where[new]])
            new = new[order]
            need = self._used + len(flat)
            if need > len(self._pool):
                grown = np.zeros(max(need, 2 * len(self._pool)), self._pool.dtype)
                grown[: self._used] = self._pool[: self._used]
                self._pool = grown
            self._pool[self._used : need] = flat
            begin[new], length[new] = self._used + np.cumsum(counts) - counts, counts
            self._used = need
            keep = np.sort(new[size[where[new]] <= 64])
            keep = keep[np.diff(unique[keep], prepend=~unique[keep[:1]]) != 0]
            if len(self._hash):  # a piece whose hash another one holds isn't kept
                keep = keep[(at[keep] == len(self._hash)) | (self._hash[near[keep]] != unique[keep])]
            uses = np.zeros(len(unique), np.int32)
            for name, values in (("_hash", unique), ("_head", head), ("_tail", tail), ("_at", begin), ("_len", length), ("_uses", uses)):
                setattr(self, name, np.insert(getattr(self, name), at[keep], values[keep]))
        begin, length = begin[inverse], length[inverse]
        before = np.concatenate([[0], np.cumsum(length)])
        tokens = self._pool[np.repeat(begin - before[:-1], length) + np.arange(before[-1])]
        pieces = np.searchsorted(start, offsets)
        counts = np.diff(before[pieces])
        out = np.full(len(tokens) + n, end_id, np.int32)
        out[np.arange(len(tokens)) + np.repeat(np.arange(n), counts)] = tokens
        return out, np.concatenate([[0], np.cumsum(counts + 1)])


_encoders: dict[str, PieceEncoder] = {}


def encoder(tokenizer: str) -> PieceEncoder:
    """One encoder for each Python worker, kept from task to task."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = PieceEncoder(tokenizer, plain_literals=False)
    return _encoders[tokenizer]


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, files: int | None = None) -> str:
    """Encodes ``docs(doc_id, text)`` and writes a store in ascending doc_id order.

    Ids are those of the library's ``encode(text, add_special_tokens=False)``: the literal of an
    added token in a text is that token.

    Other columns are ignored, whatever their names.  A null text is as an empty
    one: the end id alone.  A null doc_id comes first.  Rows of one doc_id stay
    rows of their own, ordered by a hash of their text, so one frequent doc_id
    can spread over files.  An empty table gives an empty store.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = files or partitions(spark)
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, k, buf, offsets in byte_blocks(batch.column("text"), BLOCK):
                ids, bounds = own.encode(buf, offsets, end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(k, part, np.int32)),
                        batch.column("doc_id").slice(i, k),
                        pa.array(np.diff(bounds)),
                        pa.array(at + bounds[:-1]),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["part", "doc_id", "n_tokens", "local_start", "ids"],
                )
                at += int(bounds[-1])

    ordered.mapInArrow(encode, STORE_SCHEMA).write.options(**WRITE_OPTIONS).parquet(path)
    return path


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, local_start, start, n_tokens`` of a store; token pages are not read.

    ``start`` counts the ids of all documents before.  Only one sum for each file is
    gathered; the number of files bounds that broadcast.
    """
    meta = spark.read.schema(STORE_SCHEMA).parquet(path).select("part", "doc_id", "local_start", "n_tokens")
    return meta.join(F.broadcast(_part_starts(meta)), "part").select("doc_id", "part", "local_start", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens")


def _part_starts(meta: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    sums = meta.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a store; filters on doc_id reach the scan."""
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    starts = _part_starts(store.select("part", "n_tokens"))
    return store.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the checksum of ids as unsigned 32-bit little-endian."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes a store in the shared folder, reads it back and returns what it holds."""
    path = write_tokens(docs, new_path(docs.sparkSession, "tokens"), tokenizer, end_id)
    return with_crc32(read_tokens(docs.sparkSession, path))
