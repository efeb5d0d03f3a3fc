"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items are brought to a canonical form: lower case
without outer punctuation, and numbers, units after numbers and names become typed
placeholders, one for a run of name words or of numbers.  Windows of ``WINDOW`` canonical words are hashed on both sides and
joined, so a question asked again with other numbers or names still matches; matching
windows of a document and an item at nearby distances (words put in or left out shift
them) are taken together and count if their slots agree: over all matching
windows, one value of the item stands for one value in the document, and back.

Only windows that hold enough literal words are used.  An item without such a window has
longer ones, or is one window as a whole, so every item with a word can match.  Whether a capitalised word that begins a
sentence is a name can't be seen, so both sides also have a form in which all such words are; documents are
looked through once for each length in use.  The benchmark's windows come in blocks of at most ``BLOCK_WINDOWS``; each block is sent to the tasks, which scan all
documents.  A small benchmark is one block, a large one takes more scans and no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._shared import free_name, materialize, with_row_keys
from seqloom.llm._text import _LOWER, Words, find_words, byte_blocks, mix64, span_hashes

WINDOW = 8
#: Literal words that a window must hold at least.
LITERALS = 5
#: Lengths of windows; an item has those of the first length that gives it a window with LITERALS literal words.
LENGTHS = (WINDOW, 12, 16, 24, 32, 48, 64)
#: An item without such windows is one window as a whole: its canonical form if that holds so many literal words, or else its own values.
WHOLE_LITERALS = 2
#: Literal words of an item that is one window as a whole in the form with opening names.
OPEN_LITERALS = 3
#: Share of an item's windows that a document must hold, with consistent slots, to be reported.
COVERAGE = 0.25
#: Matches of one item belong together while the next distance between document and item is at most so many words off.
DRIFT = WINDOW
BLOCK_WINDOWS = 1 << 20

#: Units of measure that become a placeholder after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "c f k degree degrees percent % $ € £ usd eur dollar dollars euro euros cent cents kb mb gb tb hz khz mhz ghz w kw v a j kj n pa kpa mph kph"
).split()
#: Words that go on with a number after one.
MAGNITUDES = "dozen hundred thousand million millions billion billions trillion trillions".split()

_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x6E756D626572, 0x756E6974, 0x6E616D65))
_CORE = np.zeros(256, bool)  # bytes of a word's core: letters, digits, all beyond ASCII, % and currency
_CORE[0x80:] = True
for _c in range(128):
    _CORE[_c] = chr(_c).isalnum() or chr(_c) in "%$"
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;"]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = "".join(words).encode()
    sizes = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(sizes)
    return span_hashes(np.frombuffer(data, np.uint8), ends - sizes, ends)


def canonical(w: Words, openings: bool = False) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical words of original-case ``w``, and (template hash, value hash, is placeholder, first word in ``w``, is an opening name) of each.

    A word with a digit is a number, and a magnitude after one; a unit is a unit after a number; a
    capitalised word is a name unless it begins a text, a line or a sentence, or is wholly in capitals.  With
    ``openings`` it is a name there too: whether such a word is one can't be seen, so texts have both forms.
    Names, or numbers, without punctuation between them are one canonical word.
    """
    if not len(w.start):
        return w, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, bool)
    core = _CORE[w.buf]
    places = np.arange(len(w.buf))
    ahead = np.minimum.accumulate(np.where(core, places, len(w.buf))[::-1])[::-1]
    back = np.maximum.accumulate(np.where(core, places, -1))
    start, stop = ahead[w.start], back[w.end - 1] + 1
    bare = start >= stop  # punctuation only: as it is
    bare |= (start >= w.end) | (stop <= w.start)
    start, stop = np.where(bare, w.start, start), np.where(bare, w.end, stop)
    low = _LOWER[w.buf]
    value = span_hashes(low, start, stop)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[w.buf])])
    number = digits[stop] > digits[start]
    begins = w.bounds[:-1][np.diff(w.bounds) > 0]
    follows = np.ones(len(start), bool)  # nothing but white space lies between the word before and this one
    follows[1:] = (stop[:-1] == w.end[:-1]) & (start[1:] == w.start[1:])
    follows[begins] = False
    magnitude = follows & ~number & np.isin(value, _hash_words(MAGNITUDES))
    for _ in range(2):  # as in "5 hundred million"
        number = number | (magnitude & np.concatenate([[False], number[:-1]]))
    after_number = np.concatenate([[False], number[:-1]])
    unit = after_number & ~number & np.isin(value, _hash_words(UNITS))
    upper = np.concatenate([[0], np.cumsum(_UPPER[w.buf])])
    first = np.ones(len(start), bool)
    if len(start):
        first[1:] = _ENDS[w.buf[w.end[:-1] - 1]]
        lines = np.concatenate([[0], np.cumsum(w.buf == 0x0A)])
        first[1:] |= lines[w.start[1:]] > lines[w.end[:-1]]
        first[begins] = True
        unit[begins] = False
    capital = ~number & _UPPER[w.buf[start]] & (upper[stop] - upper[start] == 1)
    name, opening = capital & ~first, capital & first
    if openings:
        name = capital
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    kind = np.where(number, 1, np.where(name, 2, 0))
    joined = follows & (kind > 0) & (kind == np.concatenate([[0], kind[:-1]]))
    head = np.flatnonzero(~joined)
    if len(head) < len(start):
        run = np.diff(np.append(head, len(start)))
        nth = np.arange(len(start)) - np.repeat(head, run)
        with np.errstate(over="ignore"):  # a run of one word keeps its value
            value = np.add.reduceat(value * np.where(nth > 0, mix64(nth.astype(np.uint64)) | np.uint64(1), np.uint64(1)), head)
    run_end = np.append(head[1:], len(start)) - 1
    c = Words(w.first, w.n, w.buf, w.offsets, w.start[head], w.end[run_end], np.searchsorted(head, w.bounds))
    opened = np.concatenate([[0], np.cumsum(opening & openings)])
    return c, template[head], value, (number | unit | name)[head], head, opened[run_end + 1] > opened[head]


def windows(w: Words, form: np.ndarray, slot: np.ndarray, length: int = WINDOW, literals: int = LITERALS, by_value: bool = False, holding: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows of ``length`` words of ``form`` within a text that hold ``literals`` literal words.

    The hash tells lengths apart, and windows of values (``by_value``) from those of templates.  With ``holding`` only
    windows that hold such a word are given.
    """
    n = len(form) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = w.doc
    inside = doc[:n] == doc[length - 1 :]
    if literals > 0:
        slots = np.concatenate([[0], np.cumsum(slot)])
        inside &= slots[length:] - slots[:n] <= length - literals
    if holding is not None:
        held = np.concatenate([[0], np.cumsum(holding)])
        inside &= held[length:] > held[:n]
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        # Hashes of 1, 2, 4, .. words from each place; a window is a few of them one after the other.
        h, width, place, out = form, 1, at, np.full(len(at), 2 * length + by_value, np.uint64)
        while True:
            if length & width:
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[place])
                place = place + width
            if 2 * width > length:
                return at, out
            h = mix64(h[:-width] * np.uint64(0xD1B54A32D192ED03) + h[width:])
            width *= 2


def _blocks(column: pa.Array) -> Iterator[Words]:
    for first, n, buf, offsets in byte_blocks(column):
        yield find_words(first, n, buf, offsets)


_ITEM = "item_id long, form int, hash long, length int, by_value boolean, literals int, place int, n_windows int, n_words int, slots array<long>"
_HIT = "row long, doc_id long, hash long, at long, word long, slots array<long>"


def _slot_lists(value: np.ndarray, slot: np.ndarray, at: np.ndarray, length: int, by_value: bool) -> pa.ListArray:
    """Values in the slots of each window; 0 where a word is literal."""
    cells = at[:, None] + np.arange(length)
    values = np.where(slot[cells] & (not by_value), value[cells], np.uint64(0)).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, length, dtype=np.int32)), pa.array(values.ravel()))


def _item_parts(w: Words, template: np.ndarray, value: np.ndarray, slot: np.ndarray, opening: np.ndarray | None = None) -> Iterator[tuple[int, bool, int, np.ndarray, np.ndarray]]:
    """(length, by value, literal words at least, first words, hashes) of the windows of items: each item with a word is in one part.

    With ``opening`` only items with such words are, as what their values are the other form says; those that are one window hold OPEN_LITERALS.
    """
    doc, counts = w.doc, w.counts
    left = counts > 0 if opening is None else np.bincount(doc[opening], minlength=w.n) > 0
    for length in LENGTHS:
        at, h = windows(w, template, slot, length)
        mine = left[doc[at]]
        at, h = at[mine], h[mine]
        if len(at):
            left[doc[at]] = False
            yield length, False, LITERALS, at, h
    literal = counts - np.bincount(doc[slot], minlength=w.n)
    if opening is not None:
        left &= literal >= OPEN_LITERALS
    for length in np.unique(counts[left]).tolist():
        for by_value in (False, True) if opening is None else (False,):
            at, h = windows(w, value if by_value else template, slot, length, 0, by_value)
            whole = left[doc[at]] & (counts[doc[at]] == length) & ((literal[doc[at]] < WHOLE_LITERALS) == by_value)
            if whole.any():
                yield length, by_value, 0, at[whole], h[whole]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """A row for each window of the benchmark's items; ``n_windows`` and ``n_words`` are those of its item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _blocks(batch.column("text")):
                for form, (w, template, value, slot, _, opening) in enumerate((canonical(words), canonical(words, True))):
                    for length, by_value, literals, at, h in _item_parts(w, template, value, slot, opening if form else None):
                        doc, n = w.doc[at], len(at)
                        ids = batch.column("item_id").take(pa.array(doc + w.first))
                        columns = [ids, np.full(n, form, np.int32), h.view(np.int64), np.full(n, length, np.int32), np.full(n, by_value), np.full(n, literals, np.int32), (at - w.bounds[doc]).astype(np.int32)]
                        columns += [np.bincount(doc, minlength=w.n)[doc].astype(np.int32), w.counts[doc].astype(np.int32), _slot_lists(value, slot, at, length, by_value)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["item_id", "form", "hash", "length", "by_value", "literals", "place", "n_windows", "n_words", "slots"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.where("item_id is not null").mapInArrow(make, _ITEM)


def _hits(docs: DataFrame, hashes: np.ndarray, kinds: list[tuple[int, bool, int]]) -> DataFrame:
    """Windows of documents whose hash is among ``hashes`` (sorted); ``kinds`` has (length, by value, literal words at least) of those."""
    from pyspark import TaskContext

    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, seen = sent.value, TaskContext.get().partitionId() << 40, 0
        # A small table over 16 bits of the hash spares most windows the search.
        gate = np.zeros(1 << 20, bool)
        gate[(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for words in _blocks(batch.column("text")):
                forms = [canonical(words), canonical(words, True)]
                plain, heads = forms[0][0], forms[0][4]
                for form, (w, template, value, slot, head, opening) in enumerate(forms):
                    for length, by_value, literals in kinds:
                        if form and (by_value or not opening.any()):
                            continue
                        at, h = windows(w, value if by_value else template, slot, length, literals, by_value, opening if form else None)
                        maybe = np.flatnonzero(gate[(h >> np.uint64(44)).astype(np.int64)])
                        at, h = at[maybe], h[maybe]
                        near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        hit = known[near] == h
                        at, h = at[hit], h[hit]
                        if len(at):
                            doc = w.doc[at]
                            ids = batch.column("doc_id").take(pa.array(doc + w.first))
                            place = np.searchsorted(heads, head[at], "right") - 1 - plain.bounds[doc]  # in words of the plain form
                            yield pa.RecordBatch.from_arrays([pa.array(base + seen + w.first + doc), ids, pa.array(h.view(np.int64)), pa.array(place), pa.array(head[at] - words.bounds[doc]), _slot_lists(value, slot, at, length, by_value)], names=["row", "doc_id", "hash", "at", "word", "slots"])
            seen += batch.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(find, _HIT)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, start_word, exact``: documents that hold benchmark items.

    A pair is reported if at least ``coverage`` of the item's windows (and at least one) are in the
    document, at one distance or at nearby ones (see DRIFT), with consistent slots; ``exact`` says that all
    slots have the item's own values.  Each of the item's windows counts once.  A slot at an item's first or last
    word may run on in the document and need not be consistent.  Among the places of one document where an item matches, the one
    with most windows is reported, the first of equals.  Texts with a capitalised word that begins a text, a line or a
    sentence have two forms, with that word as it is and as a name, and a pair is reported if either matches (what the first says
    goes before).  A very long text costs a pass over its words for each form and each length of windows in use: those of LENGTHS, and of
    the items that are one window, which are as short as an item without LITERALS literal words is.  An item with too few words or literal words for a window
    is one window as a whole (see WHOLE_LITERALS).  Null and empty texts match nothing; rows of one doc_id are rows of their own; rows without item_id are left out.
    """
    items = materialize(item_windows(benchmark), "items")
    found: DataFrame | None = None
    distinct = items.select("hash", "length", "by_value", "literals").distinct()
    n = distinct.count()
    for k in range(max(1, -(-n // BLOCK_WINDOWS))):
        blocks = max(1, -(-n // BLOCK_WINDOWS))
        block = distinct.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k)
        sent = block.toArrow()
        hashes = np.unique(sent["hash"].to_numpy().view(np.uint64))
        if not len(hashes):
            hashes = np.zeros(1, np.uint64)
        least = sent.group_by(["length", "by_value"]).aggregate([("literals", "min")]).select(["length", "by_value", "literals_min"])
        kinds = sorted(zip(*(x.to_pylist() for x in least.columns), strict=True))
        hits = materialize(_hits(docs, hashes, kinds), "hits")
        found = hits if found is None else found.unionByName(hits)
    slots = F.transform(F.arrays_zip(F.col("i.slots").alias("item"), F.col("h.slots").alias("doc")), lambda c, i: F.struct(c["item"].alias("item"), c["doc"].alias("doc"), (F.col("place") + i).isin(F.lit(0), F.col("n_words") - 1).alias("edge")))
    pairs = found.alias("h").join(items.alias("i"), "hash").select("row", "doc_id", "item_id", "form", "n_windows", "place", "word", (F.col("at") - F.col("place")).alias("shift"), F.filter(slots, lambda c: c["item"] != 0).alias("filled"))
    pairs = materialize(pairs, "pairs")
    # Runs of nearby shifts; a window of the item that matches at several of a run is taken where most do.
    near = Window.partitionBy("row", "item_id", "form").orderBy("shift")
    runs = pairs.withColumn("held", F.count("*").over(Window.partitionBy("row", "item_id", "form", "shift"))).withColumn("far", (F.col("shift") - F.lag("shift").over(near) > DRIFT).cast("int"))
    runs = runs.withColumn("run", F.sum(F.coalesce("far", F.lit(0))).over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    once = F.row_number().over(Window.partitionBy("row", "item_id", "form", "run", "place").orderBy(F.desc("held"), "shift", "word"))
    runs = runs.withColumn("nth", once).where("nth = 1")
    parts = [x.groupBy("row", "doc_id", "item_id", "form", "n_windows", by).agg(F.count("*").alias("n_matched"), F.min("word").alias("start_word"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("cells")).drop(by) for x, by in ((pairs, "shift"), (runs, "run"))]
    enough = parts[0].unionByName(parts[1]).where(F.col("n_matched") >= F.greatest(F.lit(1.0), F.col("n_windows") * coverage))
    ok = enough.withColumn("inner", F.array_distinct(F.transform(F.filter("cells", lambda c: ~c["edge"]), lambda c: F.struct(c["item"], c["doc"]))))
    one_way = F.size(F.array_distinct(F.transform("inner", lambda c: c["item"]))) == F.size("inner")
    other_way = F.size(F.array_distinct(F.transform("inner", lambda c: c["doc"]))) == F.size("inner")
    ok = ok.where(one_way & other_way).withColumn("exact", F.forall("cells", lambda c: c["item"] == c["doc"]))
    best = ok.groupBy("row", "doc_id", "item_id").agg(F.max_by(F.struct("n_windows", "n_matched", "start_word", "exact"), F.struct(-F.col("form"), "n_matched", -F.col("start_word"), "exact")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.n_matched", "best.start_word", "best.exact")


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that ``leaks`` reports.

    Rows are decided one by one, also if they share a doc_id or have none.  Null and empty texts
    stay; of a very long text any passage may be the leak; an empty table or benchmark changes
    nothing; columns of any name are kept as they are.
    """
    keyed, key = with_row_keys(docs)
    name = free_name(keyed, "leaked_key")
    bad = leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, coverage).select(F.col("doc_id").alias(name)).distinct()
    bad = materialize(bad, "leaked", light=True)  # of known size: texts move only where it is too large to be sent to all tasks
    return keyed.join(bad, F.col(key) == F.col(name), "left_anti").drop(key)
