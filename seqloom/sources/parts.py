"""Genomes as a stored table of parts, packed at two bits a base, for lookups that come again and again.

``write_parts`` splits genomes once; ``stored_sequences`` gives what ``intervals.with_sequence`` gives, but reads only the shards
that the wanted accessions are in, and of a part only the bytes of a range leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import dna as D
from seqloom.operators.intervals import PART
from seqloom.sources.scratch import once

#: Folders of a store; an accession is in one of them, by its hash.
SHARDS = 64
#: Letters that are packed at once, but for a longer part.
LETTERS = 1 << 20
_SCHEMA = "shard int, accession string, part long, size int, packed binary, odd array<struct<at:int,size:int,letter:int>>, plain string"
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"acgt", np.uint8)] = np.arange(4)
_LETTERS = np.frombuffer(b"acgt", np.uint8)[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]  # of each byte


def packed(text: str) -> tuple[bytes | None, list[dict[str, int]] | None, str | None]:
    """(bytes of four bases, runs of other letters, the text itself if it has letters beyond ASCII)."""
    if not text.isascii():
        return None, None, text
    data = np.frombuffer(text.encode(), np.uint8)
    code = _CODE[data]
    place = np.flatnonzero(code == 4)
    letter = data[place]
    first = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(letter.astype(int), prepend=-1) != 0))
    odd = [{"at": int(place[i]), "size": int(n), "letter": int(letter[i])} for i, n in zip(first, np.diff(first, append=len(place)))]
    four = np.zeros(-(-len(data) // 4) * 4, np.uint8)
    four[: len(data)] = code & 3
    four = four.reshape(-1, 4)
    return (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes(), odd, None


def packed_parts(texts: list[str], runs: pa.DataType) -> list[pa.Array]:
    """``size, packed, odd, plain`` of many parts: what ``packed`` gives for each, made by a few operations on all letters at once."""
    plain = [None if t.isascii() else t for t in texts]
    size = np.array([len(t) if p is None else 0 for t, p in zip(texts, plain)], np.int64)
    data = np.frombuffer("".join(t for t, p in zip(texts, plain) if p is None).encode(), np.uint8)
    begin, whole = np.cumsum(size) - size, -(-size // 4)
    code = _CODE[data]
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(data)) - begin[owner]
    # Each part begins at a byte of its own.
    first_byte = np.cumsum(whole) - whole
    four = np.zeros(int(whole.sum()) * 4, np.uint8)
    four[first_byte[owner] * 4 + at] = code & 3
    four = four.reshape(-1, 4)
    place = np.flatnonzero(code == 4)
    # A run is of one letter, in one part, without a gap.
    new = (np.diff(place, prepend=-2) != 1) | (np.diff(data[place].astype(int), prepend=-1) != 0) | (np.diff(owner[place], prepend=-1) != 0)
    first = np.flatnonzero(new)
    fields = [at[place[first]], np.diff(first, append=len(place)), data[place[first]]]
    none = pa.array([p is not None for p in plain], pa.bool_())
    # A null entry is marked by its offset.
    offsets = lambda ends, kind: pa.array(np.concatenate([[0], ends]), kind)
    bits = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(whole)]).astype(np.int32)), pa.py_buffer((four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes())])
    odd = pa.ListArray.from_arrays(offsets(np.searchsorted(owner[place[first]], np.arange(len(texts)), "right"), pa.int32()), pa.StructArray.from_arrays([pa.array(f.astype(np.int32)) for f in fields], fields=list(runs.value_type)))
    return [pa.array([len(t) for t in texts], pa.int32()), pc.if_else(none, pa.scalar(None, pa.binary()), bits), odd.cast(runs) if not any(plain) else pa.array([None if p else o for o, p in zip(odd.to_pylist(), plain)], runs), pa.array(plain, pa.string())]


def unpacked(data: bytes, skip: int, size: int, odd: list[dict[str, int]], start: int) -> str:
    """``size`` letters of packed bytes after the first ``skip``; runs of other letters count from ``start`` on."""
    out = _LETTERS[np.frombuffer(data, np.uint8)].ravel()[skip : skip + size].copy()
    for run in odd:
        out[max(run["at"] - start, 0) : max(run["at"] + run["size"] - start, 0)] = run["letter"]
    return out.tobytes().decode()


def _shard(accession: Column, shards: int) -> Column:
    return F.pmod(F.crc32(accession.cast("binary")), F.lit(shards)).cast("int")


def write_parts(genomes: DataFrame, path: str, shards: int = SHARDS, part: int = PART, files: int | None = None) -> str:
    """Writes ``genomes(accession, dna)`` as parts of ``part`` bases, by shard, accession and part; a long genome has many files.

    A genome without bases has one empty part; one without an accession is left out, as nothing can ask for it.
    """
    # Parts are packed after they are placed: placing reads its rows twice, and runs of other letters take more room than these.
    cut = F.regexp_extract_all("dna", F.lit(f"(?s).{{1,{part}}}"), F.lit(0))
    rows = genomes.where("accession is not null").select(F.col("accession").cast("string").alias("accession"), F.posexplode_outer(cut).alias("part", "bases"))
    rows = rows.select(_shard(F.col("accession"), shards).alias("shard"), "accession", F.coalesce("part", F.lit(0)).cast("long").alias("part"), F.coalesce("bases", F.lit("")).alias("bases"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("letter", pa.int32())]))
        for whole in batches:
            filled = np.cumsum(pc.binary_length(whole.column("bases")).to_numpy().astype(np.int64)) // LETTERS
            edges = np.flatnonzero(np.diff(filled, prepend=-1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(whole)]):
                batch = whole.slice(a, b - a)
                made = packed_parts(batch.column("bases").to_pylist(), runs)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "accession", "part")), *made], names=["shard", "accession", "part", "size", "packed", "odd", "plain"])

    tasks = files or int(genomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, "shard", "accession", "part").sortWithinPartitions("shard", "accession", "part").mapInArrow(pack, _SCHEMA)
    placed.write.partitionBy("shard").parquet(path)
    return path


def stored_sequences(rows: DataFrame, path: str, left: Column | str, right: Column | str, minus: Column | None = None, out: str = "sequence", known_only: bool = True, shards: int = SHARDS, part: int = PART) -> DataFrame:
    """``rows`` (with ``accession``) and the bases ``left`` to ``right`` of their genome, from a store of ``write_parts``.

    The rows are stored first; their shards, ``shards`` at most, choose the folders that are read.  Ranges are clipped to the genome; where
    ``minus`` holds, the reverse complement is given; rows whose genome isn't in the store are left out, or have an empty
    sequence.  ``shards`` and ``part`` are those of the store.
    """
    spark, col = rows.sparkSession, lambda c: F.col(c) if isinstance(c, str) else c
    cols = [c for c in rows.columns if c != out]
    turned = F.coalesce(minus, F.lit(False)) if minus is not None else F.lit(False)
    name = F.col("accession").cast("string")
    wanted = rows.select(F.monotonically_increasing_id().alias("row_number"), F.struct(*[F.col(f"`{c}`") for c in cols], turned.alias("turned_")).alias("row"), name.alias("part_of"), _shard(name, shards).alias("in_shard"), F.greatest(col(left), F.lit(1)).cast("long").alias("a"), col(right).cast("long").alias("b"))
    wanted = once(wanted, "wanted")
    found = [r[0] for r in wanted.where("in_shard is not null").select("in_shard").distinct().collect()]
    store = spark.read.schema(_SCHEMA).parquet(path).where(F.col("shard").isin(found))
    if known_only:
        known = store.where("part = 0").select(F.col("shard").alias("in_shard"), F.col("accession").alias("part_of"))
        wanted = wanted.join(known, ["in_shard", "part_of"], "left_semi")
    size = F.lit(part)
    r = wanted.select("row_number", "in_shard", "part_of", "a", "b", F.explode_outer(F.when(F.col("b") >= F.col("a"), F.sequence(F.expr(f"(a - 1) div {part}"), F.expr(f"(b - 1) div {part}")))).alias("nth"))
    same = (F.col("in_shard") == F.col("shard")) & (F.col("part_of") == F.col("accession")) & (F.col("nth") == F.col("part"))
    start = F.greatest(F.col("a") - 1 - F.col("part") * size, F.lit(0)).cast("int")
    stop = F.least(F.col("b") - F.col("part") * size, F.col("size")).cast("int")
    met = r.join(store, same).select("row_number", "part", "packed", "odd", "plain", start.alias("start"), stop.alias("stop")).where("stop > start")
    low = F.expr("start div 4").cast("int")
    touched = F.filter("odd", lambda x: (x["at"] < F.col("stop")) & (x["at"] + x["size"] > F.col("start")))
    cut = met.select("row_number", "part", F.substring("packed", low + 1, F.expr("(stop + 3) div 4").cast("int") - low).alias("packed"), touched.alias("odd"), F.substring("plain", F.col("start") + 1, F.col("stop") - F.col("start")).alias("plain"), "start", "stop")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = (batch.column(c).to_pylist() for c in ("packed", "odd", "plain", "start", "stop"))
            texts = [p if d is None else unpacked(d, a % 4, b - a, o, a) for d, o, p, a, b in zip(*fields)]
            yield pa.RecordBatch.from_arrays([batch.column("row_number"), batch.column("part"), pa.array(texts, pa.string())], names=["row_number", "part", "bases"])

    pieces = cut.mapInArrow(unpack, "row_number long, part long, bases string")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "bases"))), lambda x: x["bases"]), "")
    whole = wanted.join(pieces.groupBy("row_number").agg(text.alias("bases")), "row_number", "left")
    bases = F.coalesce("bases", F.lit(""))
    return whole.select(*[F.col(f"row.`{c}`") for c in cols], F.when(F.col("row.turned_"), D.reverse_complement(bases)).otherwise(bases).alias(out))
