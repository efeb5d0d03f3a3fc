"""Scores and renderings over many windows at once: numpy tables, and UDFs around them.

Windows of one length are a matrix of letters, a row each.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from seqloom.functions import similarity as S

_FAR = 10_000
#: Cells of edit tables held at once.
_CELLS = 1 << 24


def letters_of(windows: list[str]) -> np.ndarray:
    """Matrix of the bytes of windows of equal length."""
    return np.frombuffer("".join(windows).encode(), np.uint8).reshape(len(windows), -1)


def matching(probe: str, letters: np.ndarray) -> np.ndarray:
    """Whether each letter of the probe matches each letter of each window: windows x probe x places."""
    base = np.frombuffer(probe.encode(), np.uint8)[None, :, None]
    there = letters[:, None, :]
    return (base == there) | ((base == ord("c")) & (there == ord("t")))


def edit_tables(same: np.ndarray) -> np.ndarray:
    """Edit tables (windows x (n + 1) x (n + 1)); their borders can't be entered, so first letters are aligned."""
    count, n, _ = same.shape
    table = np.full((count, n + 1, n + 1), _FAR, np.int32)
    table[:, 0, 0] = 0
    steps = np.arange(n, dtype=np.int32)
    for i in range(1, n + 1):
        best = np.minimum(table[:, i - 1, :-1] + ~same[:, i - 1], table[:, i - 1, 1:] + 1)
        # A cell may also be reached from its left: least of best[k] + (j - k) for k <= j.
        table[:, i, 1:] = np.minimum.accumulate(best - steps, axis=1) + steps
    return np.minimum(table, _FAR)


def edit_steps(table: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ways back from the end of each table: (kinds, good), windows x steps.

    A step takes both letters (0), the probe's (1) or the window's (2), tried in this order; 3 fills up.
    """
    count, n, _ = same.shape
    rows, i, j = np.arange(count), np.full(count, n), np.full(count, n)
    kinds, good = np.full((count, 2 * n), 3, np.int8), np.zeros((count, 2 * n), bool)
    for step in range(2 * n):
        open_ = (i > 0) | (j > 0)
        if not open_.any():
            break
        here, hit = table[rows, i, j], same[rows, i - 1, j - 1] & (i > 0) & (j > 0)
        both = open_ & (i > 0) & (j > 0) & (here == table[rows, i - 1, j - 1] + ~hit)
        probe = open_ & ~both & (i > 0) & (here == table[rows, i - 1, j] + 1)
        window = open_ & ~both & ~probe
        kinds[both, step], kinds[probe, step], kinds[window, step] = 0, 1, 2
        good[:, step] = both & hit
        i, j = i - (both | probe), j - (both | window)
    return kinds, good


#: Bits of a word of ``edit_distances``.
_WORD = 64


def edit_distances(probe: str, letters: np.ndarray) -> np.ndarray:
    """Edit distances of a probe to windows (a row of letters each), a column of each table at a time.

    A column is the bits of its vertical steps, up or down, in words of 64 places of the probe; a word of all
    windows is one array, so a letter of the windows costs a few operations on whole arrays for each 64 places of the probe.
    """
    m, ones = len(probe), np.uint64(0xFFFFFFFFFFFFFFFF)
    if not m:
        return np.full(len(letters), letters.shape[1], np.int64)
    words = -(-m // _WORD)
    base = np.frombuffer(probe.encode(), np.uint8)
    masks = np.zeros((words, 256), np.uint64)
    for i, b in enumerate(base.tolist()):
        for letter in (b, ord("t")) if b == ord("c") else (b,):
            masks[i // _WORD, letter] |= np.uint64(1 << i % _WORD)
    up = [np.full(len(letters), ones) for _ in range(words)]
    down = [np.zeros(len(letters), np.uint64) for _ in range(words)]
    distance = np.full(len(letters), m, np.int64)
    last, one = np.uint64((m - 1) % _WORD), np.uint64(1)
    for column in letters.T:
        # What comes into the first word: each column is one further from the empty probe.
        carry_up, carry_down = np.ones(len(letters), np.uint64), np.zeros(len(letters), np.uint64)
        for w in range(words):
            same = masks[w, column]
            either = same | down[w]
            same = same | carry_down
            diagonal = ((up[w] + (same & up[w])) ^ up[w]) | same | down[w]
            rise, fall = down[w] | ~(up[w] | diagonal), up[w] & diagonal
            if w == words - 1:
                distance += ((rise >> last) & one).astype(np.int64) - ((fall >> last) & one).astype(np.int64)
            next_up, next_down = rise >> np.uint64(63), fall >> np.uint64(63)
            rise, fall = (rise << one) | carry_up, (fall << one) | carry_down
            up[w], down[w] = fall | ~(either | rise), rise & either
            carry_up, carry_down = next_up, next_down
    return distance


def text_edit_scores(probe: str, letters: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Length less the distance; 0 where ``limit`` steps in a row of the way back don't match."""
    m = len(probe)
    if limit is None:  # no way back is needed
        first = matching(probe[:1], letters[:, :1])[:, 0, 0]
        return (m - ~first - edit_distances(probe[1:], letters[:, 1:])).astype(float) if m else np.zeros(len(letters))
    out = np.empty(len(letters))
    at_once = max(1, _CELLS // (m + 1) ** 2)
    for a in range(0, len(letters), at_once):
        same = matching(probe, letters[a : a + at_once])
        table = edit_tables(same)
        score = (m - table[:, m, m]).astype(float)
        kinds, good = edit_steps(table, same)
        bad = (kinds < 3) & ~good
        run = np.zeros(len(same), np.int64)
        for k in range(bad.shape[1]):
            run = np.where(bad[:, k], run + 1, 0)
            score[run >= limit] = 0.0
        out[a : a + at_once] = score
    return out


def kernel_udf(kernel: S.Kernel, probe: str, options: S.Options):
    """UDF of windows: 0 for those that don't have the probe's length."""

    @F.pandas_udf(DoubleType())
    def score(windows: pd.Series) -> pd.Series:
        out = np.zeros(len(windows))
        fits = (windows.str.len() == len(probe)).to_numpy(dtype=bool, na_value=False)
        if fits.any():
            out[fits] = kernel(probe, letters_of(windows[fits].tolist()), options)
        return pd.Series(out)

    return score


def text_edit_udf(probe: str, limit: int | None = None):
    return kernel_udf(lambda probe, letters, o: text_edit_scores(probe, letters, limit), probe, S.Options())


def direct_scores(probe: str, letters: np.ndarray, o: S.Options) -> np.ndarray:
    """Matching places of each window."""
    return sum((_good(b, letters[:, i]).astype(np.int32) for i, b in enumerate(probe)), np.zeros(len(letters), np.int32)).astype(float)


def consistency_scores(probe: str, letters: np.ndarray, o: S.Options) -> np.ndarray:
    """Most matches in a stretch with at most ``patience`` mismatches.

    ``runs[k]``: matches of the longest stretch that ends here with k mismatches at most.
    """
    runs = np.zeros((o.patience + 1, len(letters)), np.int32)
    best = np.zeros(len(letters), np.int32)
    for i, b in enumerate(probe):
        good = _good(b, letters[:, i])
        runs[1:] = np.where(good, runs[1:] + 1, runs[:-1])
        runs[0] = np.where(good, runs[0] + 1, 0)
        best = np.maximum(best, runs[-1])
    return best.astype(float)


def _good(base: str, column: np.ndarray) -> np.ndarray:
    return (column == ord("c")) | (column == ord("t")) if base == "c" else column == ord(base)


S.register_kernel("direct", direct_scores)
S.register_kernel("consistency", consistency_scores)
S.register_kernel("textedit", lambda probe, letters, o: text_edit_scores(probe, letters, o.mismatch_limit))


# Renderings: three rows of a probe, a window and marks -------------------------------------------


def edit_rows(probe: str, window: str) -> tuple[str, str, str]:
    """Alignment with ``.`` for gaps, and in the marks for all that doesn't match."""
    same = matching(probe, letters_of([window]))
    kinds, good = edit_steps(edit_tables(same), same)
    steps = kinds[0][kinds[0] < 3][::-1]
    own, there = iter(probe), iter(window)
    return (
        "".join("." if k == 2 else next(own) for k in steps),
        "".join("." if k == 1 else next(there) for k in steps),
        "".join("*" if g else "." for g in good[0][: len(steps)][::-1]),
    )


def consistency_marks(probe: str, window: str, patience: int) -> str:
    """``*`` for matches, ``-`` for mismatches inside the best stretch, ``.`` for others.

    Runs of matches lie between mismatches and may be empty.  The best stretch is the first, and of
    those from one run the narrowest, of ``patience + 1`` runs at most whose matches exceed all single runs.
    """
    good = np.diagonal(matching(probe, letters_of([window]))[0])
    walls = np.flatnonzero(~good)
    runs = np.diff(np.concatenate([[-1], walls, [len(good)] if len(good) and good[-1] else []])) - 1
    inside: set[int] = set()
    if len(runs):
        upto = np.concatenate([[0], np.cumsum(runs)])
        first, width = np.meshgrid(np.arange(len(runs)), np.arange(1, patience + 2), indexing="ij")
        total = upto[np.minimum(first + width, len(runs))] - upto[first]
        if total.max() > runs.max():  # more than one run
            k, n = np.unravel_index(np.argmax(np.where(first + width <= len(runs), total, -1)), total.shape)
            inside = set(walls[k : k + n].tolist())
    return "".join("*" if g else "-" if i in inside else "." for i, g in enumerate(good.tolist()))


def direct_marks(probe: str, window: str) -> str:
    return "".join("*" if g else "." for g in np.diagonal(matching(probe, letters_of([window]))[0]))


def anchor_rows(probe: str, ahead: str, middle_limit: int = 10, end_limit: int = 2) -> tuple[str, str, str] | None:
    """Probe with ``-`` for bases passed over, the genome's bases, and marks; None without a match of two anchors.

    The first four letters are placed from the left, the last four from the end of the match back.
    """
    expression = S.two_anchors(probe, middle_limit, end_limit)
    found = re.match(expression, ahead) if expression else None
    if not found:
        return None
    text = found[0]
    hit = matching(probe[:8], letters_of([text]))[0]
    placed, at = {}, 0
    for k in range(4):
        at = at + int(np.argmax(hit[k, at:]))
        placed[at], at = probe[k], at + 1
    end = len(text)
    for k in (7, 6, 5, 4):
        before = np.flatnonzero(hit[k, at:end])
        if len(before):
            end = at + int(before[-1])
            placed[end] = probe[k]
    return "".join(placed.get(i, "-") for i in range(len(text))), text, "".join("*" if i in placed else "." for i in range(len(text)))


_ROWS = StructType().add("kind", StringType()).add("probe", StringType()).add("window", StringType()).add("marks", StringType())


def renderings(kinds: list[str], options: S.Options):
    """UDF (probe, window, ahead): the rows of each similarity, in the order of ``kinds``; null rows where one can't be drawn."""

    def rows(kind: str, probe: str, window: str, ahead: str) -> tuple[str | None, str | None, str | None]:
        if kind == "textedit":
            return edit_rows(probe, window)
        if kind == "blat":
            return anchor_rows(probe, ahead, options.middle_limit, options.end_limit) or (None, None, None)
        return probe, window, consistency_marks(probe, window, options.patience) if kind == "consistency" else direct_marks(probe, window)

    @F.pandas_udf(ArrayType(_ROWS))
    def render(probes: pd.Series, windows: pd.Series, aheads: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "probe", "window", "marks"), (k, *rows(k, p, w, a)))) for k in kinds] for p, w, a in zip(probes, windows, aheads, strict=True)])

    return render
