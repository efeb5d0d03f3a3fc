"""Media columns: audio features of samples stored as 8-bit PCM.

A payload is stored as a WAV file (RIFF header and 8-bit samples, one channel), read
back from those bytes, resampled by a polyphase filter, cut into overlapped frames
and turned into log-mel energies; a hysteresis gate over the frames' energy gives
active segments.  All tables are whole numbers of fixed steps, so every sum of products is a sum of integers below 2^53: exact,
in whatever order the processor adds, with any number of threads.  Energies are on a grid of 0.001 dB.  Features of a row are two Arrow tensors of fixed shape: the log-mel
energies pooled into ``FRAMES`` time spans by ``MELS`` bands, and those spans in seconds.

Spark has no tensor type, so features are stored as Arrow IPC streams of a few hundred rows in a
binary column: there the columns have the canonical fixed-shape tensor type, and any Arrow reader
finds shape and values.  ``read_features`` gives rows of plain arrays from them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._text import text_buffers

RATE = 8000
#: The resampler's ratio and the taps of each of its UP phases.
UP, DOWN, TAPS = 2, 3, 12
FRAME, HOP, MELS = 256, 128, 20
#: Shape of a row's tensor: time spans by mel bands.
FRAMES = 8
#: Decibels over a row's quietest frame that open and close a segment, as shares of its range.
OPEN, CLOSE = 0.6, 0.4
#: Samples taken at once: longer payloads stream through in blocks.
BLOCK = 1 << 19
UNIT = 64
#: Steps to 1 of filter taps, window, Fourier terms, powers and mel weights: with 8-bit samples no sum reaches 2^53.
TAP_STEPS, WINDOW_STEPS, WAVE_STEPS, POWER_STEPS, MEL_STEPS = 1 << 12, 1 << 10, 1 << 12, 1 << 20, 1 << 8
#: Steps to 1 dB.
GRID = 1000


def _phases() -> np.ndarray:
    """Windowed-sinc low-pass filter split into UP phases of TAPS taps."""
    n = UP * TAPS
    t = (np.arange(n) - (n - 1) / 2) / max(UP, DOWN)
    h = np.sinc(t) * np.hamming(n)
    phases = h.reshape(TAPS, UP).T[:, ::-1]
    return np.rint(TAP_STEPS * phases / phases.sum(axis=1, keepdims=True))


def _mel_bank() -> np.ndarray:
    """Triangular filters, FRAME // 2 + 1 bins by MELS bands."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.rint(MEL_STEPS * np.maximum(0, np.minimum(rise, fall)))


def _waves() -> np.ndarray:
    """Fourier terms, FRAME by cosines and then sines of FRAME // 2 + 1 bins."""
    turn = 2 * np.pi * np.outer(np.arange(FRAME), np.arange(FRAME // 2 + 1)) / FRAME
    return np.rint(WAVE_STEPS * np.concatenate([np.cos(turn), np.sin(turn)], axis=1))


_PHASES, _BANK, _WAVES, _WINDOW = _phases(), _mel_bank(), _waves(), np.rint(WINDOW_STEPS * np.hanning(FRAME))
#: What a sample of full swing is in steps, and the size of the Fourier terms of a frame against their true size.
_FULL = 128 * TAP_STEPS * WINDOW_STEPS * WAVE_STEPS


def wav(payload: bytes) -> bytes:
    """A RIFF WAV file of 8-bit unsigned samples, one channel."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples(media: bytes) -> np.ndarray:
    """The samples of a WAV file, found by walking its chunks."""
    at = 12
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return np.frombuffer(media, np.uint8, n, at + 8)
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def resample(x: np.ndarray) -> np.ndarray:
    """``len(x) * UP // DOWN`` samples in steps; each output takes the dot product with one phase."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS // 2), x, np.zeros(TAPS)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for phase in range(UP):
        k = np.arange(phase, n, UP)
        if len(k):
            first, step = phase * DOWN // UP, DOWN
            out[phase::UP] = rows[first :: step][: len(k)] @ _PHASES[phase * DOWN % UP]
    return out


def _mel_frames(y: np.ndarray) -> np.ndarray:
    """Log-mel energies (whole steps of 1 / GRID dB) of the frames of y, which silence fills up to whole hops."""
    short = FRAME - len(y) if len(y) < FRAME else -(len(y) - FRAME) % HOP
    y = np.concatenate([y, np.zeros(short)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out, bins = np.empty((len(frames), MELS), np.int64), FRAME // 2 + 1
    for i in range(0, len(frames), 1024):
        terms = (frames[i : i + 1024] * _WINDOW) @ _WAVES / _FULL
        power = np.rint(POWER_STEPS * (terms[:, :bins] ** 2 + terms[:, bins:] ** 2))
        out[i : i + 1024] = np.rint(GRID * 10 * np.log10(power @ _BANK / (POWER_STEPS * MEL_STEPS) + 1e-6))
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log-mel energies of a whole payload; long ones stream in blocks that overlap by whole hops."""
    if len(x) <= BLOCK:
        return _mel_frames(resample(x.astype(float) - 128))
    parts, step = [], BLOCK // (DOWN * HOP) * (DOWN * HOP)
    reach = (FRAME + HOP) * DOWN // UP + TAPS * DOWN
    for i in range(0, len(x), step):
        lead = min(i, TAPS * DOWN)  # what the filter sees before the block
        y = resample(x[i - lead : i + step + reach].astype(float) - 128)[lead * UP // DOWN :]
        whole = step * UP // DOWN // HOP
        if i + step + reach >= len(x):
            parts.append(_mel_frames(y))
            break
        parts.append(_mel_frames(y)[:whole])
    return np.concatenate(parts)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """From the energies of frames, whole numbers: frames ``[first, last)`` where the gate is open: from a frame at OPEN until one below CLOSE."""
    low, high = float(energy.min()), float(energy.max())
    if high == low:
        return []
    share = (energy - low) / (high - low)
    # The last frame that decides (opens or closes) rules those between.
    mark = np.where(share >= OPEN, 1, np.where(share < CLOSE, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(media: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """Tensor FRAMES x MELS, its time spans FRAMES x 2 (seconds) and the active segments (seconds)."""
    x = samples(media)
    mel = log_mel(x)
    cuts = np.linspace(0, len(mel), FRAMES + 1)
    tensor, spans = np.zeros((FRAMES, MELS), np.float32), np.zeros((FRAMES, 2), np.float32)
    second = HOP * DOWN / UP / RATE
    for i in range(FRAMES):
        a = min(int(cuts[i]), len(mel) - 1)
        b = max(a + 1, int(np.ceil(cuts[i + 1])))
        tensor[i] = mel[a:b].sum(axis=0) / ((b - a) * GRID)
        spans[i] = a * second, b * second
    found = segments(mel.sum(axis=1))
    return tensor, spans, [(a * second, b * second) for a, b in found]


def payload(data: bytes) -> bytes:
    """Bytes and zeros up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def tensors(tensor: np.ndarray, spans: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Rows of features as Arrow columns of the canonical fixed-shape tensor type."""
    return (
        pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensor.reshape(-1, FRAMES, MELS))),
        pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(spans.reshape(-1, FRAMES, 2))),
    )


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text (null: empty) as a WAV file of its padded bytes.

    A row each, whatever its doc_id; a very long text is one long file; an empty table has no rows;
    other columns are ignored.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffers(batch.column("text"))
            sizes = np.diff(offsets)
            files = [wav(payload(buf[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(put, MEDIA_SCHEMA)


_SEGMENTS = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))
_KINDS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "segments": _SEGMENTS}
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "segments array<struct<start:double,stop:double>>, tensor array<float>, spans array<float>"
)
#: Rows of one Arrow stream at most.
STORE_ROWS = 512


def _stream(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row with the Arrow stream of features of some files: ``doc_id, n_bytes, media``."""
    out: dict[str, list] = {k: [] for k in _KINDS if k not in ("doc_id", "n_bytes")}
    mels, spans = np.zeros((batch.num_rows, FRAMES, MELS), np.float32), np.zeros((batch.num_rows, FRAMES, 2), np.float32)
    for i, value in enumerate(batch.column("media")):
        file = value.as_buffer()
        x = samples(file)
        mels[i], spans[i], found = features(file)
        out["payload_bytes"].append(len(x))
        out["payload_sha256"].append(hashlib.sha256(x).hexdigest())
        out["tail_crc32"].append(zlib.crc32(x[-UNIT:]))
        out["media_bytes"].append(file.size)
        out["media_sha256"].append(hashlib.sha256(file).hexdigest())
        out["segments"].append([{"start": a, "stop": b} for a, b in found])
        active = sum(b - a for a, b in found)
        out["feature"].append(f"{len(found)}:{active:.3f}:" + ",".join(f"{v:.1f}" for v in mels[i].mean(axis=0, dtype=np.float64)))
    columns = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(out[k], kind) for k, kind in _KINDS.items() if k in out), *tensors(mels, spans)]
    table = pa.RecordBatch.from_arrays(columns, names=[*_KINDS, "tensor", "spans"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["n", "stream"])


def media_features(media: DataFrame) -> DataFrame:
    """``n, stream``: features of stored files, ``n`` rows in each Arrow stream.

    Files are read back from ``media(doc_id, n_bytes, media)``; equal files have equal features, in any task and on any machine
    (sums are exact; only a logarithm's last bit could differ, far below the grid).  A stream has the columns of FEATURE_SCHEMA, ``tensor`` and ``spans`` (seconds) as fixed-shape tensors.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STORE_ROWS):
                yield _stream(batch.slice(i, STORE_ROWS))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "n long, stream binary")


def read_features(stored: DataFrame) -> DataFrame:
    """Rows of FEATURE_SCHEMA from stored streams; ``tensor`` and ``spans`` row by row as plain arrays."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("stream"):
                for table in pa.ipc.open_stream(value.as_buffer()):
                    lists = []
                    for name in ("tensor", "spans"):
                        column = table.column(name)
                        k = column.storage.type.list_size
                        lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (len(column) + 1) * k, k, dtype=np.int32)), column.storage.flatten()))
                    yield pa.RecordBatch.from_arrays([*(table.column(k) for k in _KINDS), *lists], names=[*_KINDS, "tensor", "spans"])

    return stored.select("stream").mapInArrow(rows, FEATURE_SCHEMA)
