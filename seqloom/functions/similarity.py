"""Similarity of a probe and a window of a genome, as Columns.

``probe`` is a string known when the plan is built; then position ``i`` is a comparison with
a constant and the score stays in generated code.  Windows have the probe's length.
Scores that need a backtrace or a search are in ``kernels``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np

#: Names of the similarities, in the order of their numbers, with what else names them.
SIMILARITY_ALIASES = {
    "textedit": ("text", "textedit", "textdistance", "text_edit", "text_distance"),
    "direct": ("direct",),
    "consistency": ("consistency", "consistent"),
    "pattern": ("pattern", "pat"),
    "blat": ("blat",),
}


def similarity_name(alias: str) -> str:
    for name, others in SIMILARITY_ALIASES.items():
        if alias.lower() in others:
            return name
    raise ValueError(f"no similarity is named {alias!r}")


def _match(base: str, window: Column, i: int) -> Column:
    letter = F.substring(window, i, 1)
    return letter.isin("c", "t") if base == "c" else letter == base


def mismatch_positions(probe: str, window: Column) -> Column:
    """1-based places where the window doesn't match, ascending."""
    marks = [F.when(~_match(b, window, i), i) for i, b in enumerate(probe, 1)]
    return F.array_compact(F.array(*marks))


def direct(probe: str, window: Column) -> Column:
    """Number of matching places."""
    hits = [_match(b, window, i).cast("int") for i, b in enumerate(probe, 1)]
    return sum(hits[1:], hits[0]).cast("double")


#: Longest probe whose consistency is looked up by the mask of its mismatches.
MASKED = 12


@lru_cache(maxsize=64)
def _stretch_table(m: int, patience: int) -> tuple[float, ...]:
    """Most matches in a stretch with at most ``patience`` mismatches, for each mask of mismatches."""
    out = []
    for mask in range(1 << m):
        walls = [-1] + [i for i in range(m) if mask >> i & 1] + [m]
        reach = patience + 1
        n = len(walls) - 2
        out.append(float(m - n if n <= patience else max(walls[k + reach] - walls[k] - 1 - patience for k in range(n - patience + 1))))
    return tuple(out)


def consistency(probe: str, window: Column, patience: int = 0) -> Column:
    """Most matches in a stretch with at most ``patience`` mismatches.

    For a short probe the mismatches make a number that indexes a constant array, all in generated
    code; a longer one takes distances of mismatch positions.
    """
    m = len(probe)
    if m <= MASKED:
        bits = [F.when(_match(b, window, i), 0).otherwise(1 << i - 1) for i, b in enumerate(probe, 1)]
        table = F.array(*[F.lit(x) for x in _stretch_table(m, patience)])
        return F.get(table, sum(bits[1:], bits[0]))
    inner = mismatch_positions(probe, window)
    bounds = F.concat(F.array(F.lit(0)), inner, F.array(F.lit(m + 1)))
    spans = F.transform(F.sequence(F.lit(1), F.size(inner) - patience + 1), lambda k: F.element_at(bounds, k + patience + 1) - F.element_at(bounds, k) - 1 - patience)
    return F.when(F.size(inner) <= patience, F.lit(m) - F.size(inner)).otherwise(F.array_max(spans)).cast("double")


#: Longest probe whose edit scores are looked up by the window's letters.
LOOKED_UP = 6


@lru_cache(maxsize=64)
def _edit_scores(probe: str) -> str:
    """Edit scores of all windows of acgt and one letter that is none of them, as text."""
    from seqloom.functions.kernels import letters_of, text_edit_scores

    scores = text_edit_scores(probe, letters_of(["".join(w) for w in product("nacgt", repeat=len(probe))]))
    return ",".join(str(int(x)) for x in scores)


def text_edit(probe: str, window: Column) -> Column:
    """Length less the edit distance whose first letters are always aligned.

    Without ``c`` in the probe (after its first letter) the built-in distance does. Of a short probe of acgt, the window's letters make a
    number that indexes a constant array, all in generated code; else numpy tables over batches.
    """
    m = len(probe)
    first = (~_match(probe[0], window, 1)).cast("int")
    if m == 1:
        return (F.lit(1) - first).cast("double")
    if "c" not in probe[1:]:
        rest = F.levenshtein(F.lit(probe[1:]), F.substring(window, 2, m - 1))
        return (F.lit(m) - first - rest).cast("double")
    if m <= LOOKED_UP and set(probe) <= set("acgt"):
        places = [F.instr(F.lit("acgt"), F.substring(window, i, 1)) * 5 ** (m - i) for i in range(1, m + 1)]
        return F.get(F.split(F.lit(_edit_scores(probe)), ",").cast("array<double>"), sum(places[1:], places[0]))
    from seqloom.functions.kernels import text_edit_udf

    return text_edit_udf(probe)(window)


@dataclass(frozen=True)
class Pattern:
    """A must expression with its score, and optional ones with what each adds."""

    must: str
    must_score: int
    optional: tuple[tuple[str, int], ...] = field(default=())


def _expression(probe: str, parts: list[tuple[int, int]]) -> tuple[str, int]:
    """Expression over a window that fixes parts (offset, length) of the probe, and their total length.

    Offsets below 0 count from the end.  Places that no part fixes are gaps; a run of them is one
    or more letters, whatever its length.
    """
    fixed = {place for offset, length in parts for place in range(offset % len(probe), min(offset % len(probe) + length, len(probe)))}
    letters = "".join(base if place in fixed else "-" for place, base in enumerate(probe))
    body = re.sub("-+", ".+", letters).replace("c", "(c|t)")
    ends = ("^" if 0 in fixed else "", "$" if len(probe) - 1 in fixed else "")
    return body.join(ends), sum(length for _, length in parts)


def compile_pattern(probe: str, must: list[tuple[int, int]], optional: list[tuple[int, int]] = ()) -> Pattern:
    expression, score = _expression(probe, list(must))
    extra = []
    for part in optional:
        both, total = _expression(probe, [part, *must])
        extra.append((both, total - score))
    return Pattern(expression, score, tuple(extra))


def pattern(compiled: Pattern, window: Column) -> Column:
    """0 unless the must expression matches from the window's start; else scores of all that match."""
    at_start = lambda e: window.rlike(f"^(?:{e})")
    added = [F.when(at_start(e), s).otherwise(0) for e, s in compiled.optional]
    return F.when(at_start(compiled.must), sum(added, F.lit(compiled.must_score))).otherwise(0).cast("double")


def _spaced(letters: str, most: int, partial: bool) -> str:
    """Expression for letters that follow each other with ``most`` others between them in all, and one pair side by side.

    Each is the first of its kind after the one before.  With ``partial`` the text may end after any of them,
    where one pair so far is side by side.
    """
    one = lambda x: "[ct]" if x == "c" else x
    other = lambda x: "[^ct]" if x == "c" else f"[^{x}]"
    found = []
    for n in range(1 if partial else len(letters), len(letters) + 1):
        for gaps in product(range(most + 1), repeat=n):
            if sum(gaps) <= most and 0 in gaps:
                found.append("".join((f"{other(x)}{{{k}}}" if k else "") + one(x) for x, k in zip(letters, gaps)) + ("$" if n < len(letters) else ""))
    return "(?:" + "|".join(found) + ")"


def two_anchors(probe: str, middle_limit: int = 10, end_limit: int = 2, skip: int = 3) -> str | None:
    """Expression that tells, from a window's first base on, whether two anchors of four bases match; None for short probes.

    The bases of an anchor follow each other with ``end_limit`` others between them at most and one pair side by
    side.  The second anchor starts after ``skip`` bases, within ``middle_limit`` of the first, at any
    place; the genome may end inside it.
    """
    if len(probe) < 8:
        return None
    one = lambda x: "[ct]" if x == "c" else x
    return f"^{one(probe[0])}{_spaced(probe[1:4], end_limit, False)}.{{{skip},{middle_limit}}}?{one(probe[4])}{_spaced(probe[5:8], end_limit, True)}"


def anchor_reach(middle_limit: int = 10, end_limit: int = 2) -> int:
    """Bases that a match of two anchors may take."""
    return 8 + middle_limit + 2 * end_limit


@dataclass(frozen=True)
class Options:
    """What the similarities take beside probe and window."""

    patience: int = 0
    mismatch_limit: int | None = None
    must: tuple[tuple[int, int], ...] = ()
    optional: tuple[tuple[int, int], ...] = ()
    middle_limit: int = 10
    end_limit: int = 2


Builder = Callable[[str, Column, Options], Column]
Kernel = Callable[[str, "np.ndarray", Options], "np.ndarray"]
_registry: dict[str, Builder] = {}
_kernels: dict[str, Kernel] = {}
#: Similarities that look at the genome beyond the window: they get what follows from the window's first base on.
AHEAD = {"blat"}


def register_similarity(name: str, builder: Builder | None = None, kernel: Kernel | None = None) -> None:
    """Makes a similarity available to searches under a name: by Columns, by a kernel, or both if they score alike.

    ``builder(probe, window, options)`` gives a Column.  ``kernel(probe, letters, options)`` gives the scores of many
    windows, rows of a matrix of bytes; it runs in tasks, so it must be found there or be pickled.  Of one
    without a builder the Column is made, which runs the kernel over Arrow batches.
    """
    if builder is None and kernel is None:
        raise ValueError("a similarity needs a builder or a kernel")
    _registry[name] = builder or _by_kernel(kernel)
    if kernel is None:
        _kernels.pop(name, None)
    else:
        register_kernel(name, kernel)
    SIMILARITY_ALIASES.setdefault(name, (name,))


def register_kernel(name: str, kernel: Kernel) -> None:
    """The kernel of a similarity that has a builder."""
    _kernels[name] = kernel


def kernel(name: str) -> Kernel | None:
    from seqloom.functions import kernels  # noqa: F401  (those of the built-in similarities)

    return _kernels.get(name)


def _by_kernel(scores: Kernel) -> Builder:
    def build(probe: str, window: Column, o: Options) -> Column:
        from seqloom.functions.kernels import kernel_udf

        return kernel_udf(scores, probe, o)(window)

    return build


def _text_edit(probe: str, window: Column, o: Options) -> Column:
    if o.mismatch_limit is None:
        return text_edit(probe, window)
    from seqloom.functions.kernels import text_edit_udf

    return text_edit_udf(probe, o.mismatch_limit)(window)


def _blat(probe: str, ahead: Column, o: Options) -> Column:
    expression = two_anchors(probe, o.middle_limit, o.end_limit)
    return F.lit(0.0) if expression is None else F.when(ahead.rlike(expression), 1.0).otherwise(0.0)


register_similarity("textedit", _text_edit)
register_similarity("direct", lambda p, w, o: direct(p, w))
register_similarity("consistency", lambda p, w, o: consistency(p, w, o.patience))
register_similarity("pattern", lambda p, w, o: pattern(compile_pattern(p, list(o.must), list(o.optional)), w) if o.must else F.lit(0.0))
register_similarity("blat", _blat)


def similarity(name: str, probe: str, window: Column, options: Options = Options()) -> Column:
    """A similarity by any of its names; for those in AHEAD, ``window`` is the genome from the window's first base on."""
    if re.search(r"[^acgt]", probe):
        raise ValueError("a probe has the letters acgt only")
    return _registry[similarity_name(name)](probe, window, options)


def positive_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights above 0 by proper name, in the order of the similarities' numbers."""
    kept = {similarity_name(k): float(w) for k, w in weights.items() if w > 0}
    if not kept:
        raise ValueError("at least one similarity must have a weight above 0")
    order = list(SIMILARITY_ALIASES)
    return dict(sorted(kept.items(), key=lambda item: order.index(item[0])))


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of scores."""
    parts = [scores[k] * F.lit(w) for k, w in weights.items()]
    return sum(parts[1:], parts[0]) / F.lit(sum(weights.values()))


def render_direct(probe: str, window: Column) -> Column:
    """``struct(probe, window, marks)``: ``*`` where letters match, ``.`` elsewhere."""
    marks = F.concat(*[F.when(_match(b, window, i), "*").otherwise(".") for i, b in enumerate(probe, 1)])
    return F.struct(F.lit(probe).alias("probe"), window.alias("window"), marks.alias("marks"))
