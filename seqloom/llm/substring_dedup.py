"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts each text where its upper bits are
zero, so cuts depend on content alone and an insertion shifts only the chunks it
touches.  Chunks are identified by a 128-bit digest; a chunk that occurs in two or
more documents is *repeated*, and runs of adjacent repeated chunks are spans.

Plan: (1) chunk all texts and aggregate digests to ``first_doc`` and ``last_doc``, with
a partial step before the shuffle; (2) put the repeated digests into a bit set of bounded
size; (3) chunk again, keep the chunks that the bit set may hold, and join those to the
repeated digests; (4) merge adjacent chunks of a document into spans.  A digest held by
a third of all documents is one row on one side of that join and never a group in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._shared import bit_set, free_name, in_bit_set, materialize, with_row_keys
from seqloom.llm._text import byte_blocks, mix64, span_hashes

WINDOW = 16
#: A cut where so many upper bits of the gear hash are zero: a chunk in 16 bytes on average, beside MIN.
CUT_BITS = 4
MIN_CHUNK, MAX_CHUNK = 8, 128
#: Bytes of a reported span.  A passage of over 50 words holds more; a shared line or notice holds less.
MIN_SPAN = 120

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes up to each place: ``sum(gear[byte k back] << k)``, by doubling."""
    h = _GEAR[buf]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h, width = longer, 2 * width
    return h


def chunk_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of the texts in ``buf``; an empty text has none."""
    cut = np.flatnonzero(gear_hashes(buf) >> np.uint16(16 - CUT_BITS) == 0) + 1
    doc = np.searchsorted(offsets, cut, "left") - 1
    cut = cut[cut - offsets[doc] >= WINDOW]  # the window lies within the text
    full = np.flatnonzero(np.diff(offsets) > 0)
    edges = np.union1d(offsets[full], offsets[full + 1])
    cut = np.union1d(cut, edges)
    is_edge = np.zeros(len(buf) + 1, bool)
    is_edge[edges] = True
    if (np.diff(cut) < MIN_CHUNK).any():  # a cut too close to the one kept before is passed over
        kept, last = [], -MIN_CHUNK
        for at, edge in zip(cut.tolist(), is_edge[cut].tolist(), strict=True):
            if edge or at - last >= MIN_CHUNK:
                kept.append(at)
                last = at
        cut = np.array(kept, np.int64)
    start, stop = cut[:-1], cut[1:]
    pieces = np.maximum(1, -(-(stop - start) // MAX_CHUNK))
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + nth * MAX_CHUNK
        stop = np.minimum(start + MAX_CHUNK, np.repeat(stop, pieces))
    return start, stop


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each chunk, start, stop, digest, second digest) of blocks of a batch."""
    for first, _, buf, offsets in byte_blocks(batch.column("text")):
        if not len(buf):
            continue
        start, stop = chunk_bounds(buf, offsets)
        row = np.searchsorted(offsets, start, "right") - 1
        d1, d2 = (span_hashes(buf, start, stop, second=k).view(np.int64) for k in (False, True))
        yield first, row, start - offsets[row], stop - offsets[row], d1, d2


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def repeated_digests(docs: DataFrame) -> DataFrame:
    """``d1, d2, first_doc, last_doc`` of the chunks that two or more doc_ids hold."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, row, _, _, d1, d2 in _chunks(batch):
                ids = batch.column("doc_id").take(pa.array(row + first))
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), ids], names=["d1", "d2", "doc_id"])

    found = _rows(docs).mapInArrow(digests, "d1 long, d2 long, doc_id long")
    return found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")


def repeated_chunks(docs: DataFrame, row_key: str | None = None) -> DataFrame:
    """``doc_id, row, start, stop, first_doc``: every occurrence of a repeated chunk (byte offsets).

    ``row`` is the column ``row_key`` if there is one, or else the row's place in the scan.
    """
    spark = docs.sparkSession
    repeated = materialize(repeated_digests(docs), "digests")
    bits = spark.sparkContext.broadcast(bit_set(repeated.select(F.col("d1").alias("key")), repeated.count()))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for first, row, start, stop, d1, d2 in _chunks(batch):
                at = np.flatnonzero(in_bit_set(bits.value, d1))
                if len(at):
                    ids = batch.column("doc_id").take(pa.array(row[at] + first))
                    rows = pa.array(base + seen + first + row[at]) if row_key is None else batch.column("row").take(pa.array(row[at] + first))
                    yield pa.RecordBatch.from_arrays([pa.array(d1[at]), pa.array(d2[at]), ids, rows, pa.array(start[at]), pa.array(stop[at])], names=["d1", "d2", "doc_id", "row", "start", "stop"])
            seen += batch.num_rows

    source = _rows(docs) if row_key is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row_key).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = source.mapInArrow(occurrences, "d1 long, d2 long, doc_id long, row long, start long, stop long")
    return found.join(repeated.select("d1", "d2", "first_doc"), ["d1", "d2"]).select("doc_id", "row", "start", "stop", "first_doc")


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN, row_key: str | None = None) -> DataFrame:
    """``doc_id, start, stop, n_chunks, n_first, first_doc``: repeated passages of ``min_span`` bytes or more.

    ``start`` and ``stop`` are byte offsets in the UTF-8 text.  ``n_first`` counts chunks whose
    first document this is: a deduplicated corpus keeps those and drops the others.
    ``first_doc`` is the least doc_id that holds a chunk of the span.  Empty and null texts
    have no chunk.  Rows of one doc_id are rows of their own, but only another doc_id makes a
    passage repeated; a row whose doc_id is null reports spans and counts for none.  With ``row_key`` (a
    long column that is a key of ``docs``) that column comes too.
    """
    chunks = repeated_chunks(docs, row_key)
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("start") - F.coalesce(F.sum(F.col("stop") - F.col("start")).over(before), F.lit(0))
    spans = chunks.withColumn("run", run).groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("doc_id") == F.col("first_doc")).alias("n_first"),
        F.min("first_doc").alias("first_doc"),
    )
    spans = spans.where(F.col("stop") - F.col("start") >= min_span).drop("run")
    return spans.drop("row") if row_key is None else spans.withColumnRenamed("row", row_key)


def without_repeats(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """``docs`` with repeated passages cut out of all documents but those that hold them first.

    A span is cut where none of its chunks has its first document there.  Cuts are moved
    inwards to whole characters.  Rows that share a doc_id, or have none, keep cuts of their own.
    Null and empty texts stay as they are, and so do all other columns, whatever their names.
    """
    keyed, key = with_row_keys(docs)
    name, cuts = free_name(keyed, "cut_key"), free_name(keyed, "cuts")
    spans = repeated_spans(keyed.select("doc_id", "text", F.col(key).alias("row_key")), min_span, "row_key").where("n_first = 0")
    spans = spans.groupBy(F.col("row_key").alias(name)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts))
    joined = keyed.join(spans, F.col(key) == F.col(name), "left")

    @F.pandas_udf("string")
    def cut(texts, cuts):
        import pandas as pd

        def one(text, spans):
            if text is None or spans is None:
                return text
            data, at, out = text.encode(), 0, []
            for s in spans:
                a, b = s["start"], s["stop"]
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                out.append(data[at:a])
                at = b
            return b"".join([*out, data[at:]]).decode()

        return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)])

    whole = joined.withColumn("text", F.when(F.col(f"`{cuts}`").isNull(), F.col("text")).otherwise(cut("text", F.col(f"`{cuts}`"))))
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns])
