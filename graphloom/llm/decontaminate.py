"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of symbols.  One typed placeholder stands for a
numeral with its thousands and decimals (``1,250.5``), for a unit after a
number, attached or not (``5 km``, ``5km``), and for a run of capitalised words
with single blanks (``New York``); other words count by their lower-case form.
Whether a word is a name rests on the word alone (``COMMON`` never are), not on
its place, so a copy has the same symbols wherever it stands.  Windows of
symbols of documents and benchmark items are joined on their hash.  The values
behind matching placeholders form a mapping from item to document, one value to
one value, else a window is no re-parameterised copy.

Windows of plain words, numbers and names included, are joined as well, so a
copy in other capitals or of nothing but numbers is found too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as v
from ._rows import ID, KEY, TEXT, keyed

WINDOW = 8
#: Fewest symbols of a template window that are plain words; of a shorter item, half of them.
PLAIN = 4
#: An item of fewer words than a window is one window of its own length; below this length it matches nothing.
SHORTEST = 4
#: Least share of an item's windows that a document must hold.
SHARE = 0.5
#: Benchmark windows that every task may hold in memory; above, windows are joined by shuffle.
MAX_HELD = 4_000_000

#: Words that begin sentences and are no names.
COMMON = tuple(
    (
        "a about after again all also although always an and another any are as at be because been before being below between both but by can could did do does during each either every few find first for from give given had has have he her here hers him his how however i if in into is it its just let let's many me more most much my next no not now of off often on once one only or other our out over please show so some such suppose than that the their them then there these they this those three through thus to today too two under until up us use very was we were what when where whether which while who whose why will with without would you your calculate compute consider determine explain prove write solve assume evaluate estimate "
        "der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war wenn als wie was wer wo warum in im an am auf aus bei mit nach von vor zu zum zur es er sie wir ich ihr sein seine dieser diese dieses jede jeder jedes alle für über unter so da dann nur noch "
        "le la les l un une des de du d et ou mais ne pas est sont était si que qui quoi où quand comment pourquoi dans en sur sous avec sans pour par il elle nous vous ils elles je tu ce cette ces chaque tout tous toute son sa ses au aux "
        "el los las una unos unas y o pero no es son era si qué que quién quien dónde donde cuándo cuando cómo como por para con sin sobre entre en del al lo su sus este esta estos estas cada todo todos toda se ella ellos nosotros yo"
    ).split()
)

UNITS = tuple("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw mw v kv a ma j kj n pa kpa c f k mph kph percent usd eur gbp dollar dollars euro euros cent cents pound pounds meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mile miles foot feet inch inches degree degrees".split())

NUMBER, UNIT, NAME = (v.mix(np.array([c], dtype=v.U64))[0] for c in (101, 102, 103))
_PLAIN = v.U64(0xA0761D6478BD642F)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    data, offs = v.buffers(pa.array(sorted(set(words))))
    return np.unique(v.words(data, offs, 0, len(offs) - 1).hash)


_UNIT_HASHES, _COMMON_HASHES = _hashes(UNITS), _hashes(tuple(w for w in COMMON if "'" not in w))


def _among(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), dtype=bool)


def lowered(b: np.ndarray) -> np.ndarray:
    """The bytes with every letter lowered whose lower case is as long; the others stay."""
    out = v.LOWER[b]
    out[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)] += 32
    # capitals beyond Latin-1
    if ((b >= 0xC4) & (b <= 0xDF) | (b == 0xE1) | (b == 0xE2) | (b == 0xEA) | (b == 0xEF) | (b == 0xF0)).any():
        text = b.tobytes().decode("utf-8", "replace")
        low = "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in text)
        if len(raw := low.encode()) == len(b):
            return np.frombuffer(raw, dtype=np.uint8)
    return out


@dataclass
class Symbols:
    """Symbols of a range of documents: document, symbol, hash of the value behind it, whether it is a placeholder."""

    doc: np.ndarray
    sym: np.ndarray
    value: np.ndarray
    slot: np.ndarray


def _cut_units(w: v.Words, low: np.ndarray, sums: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the words, with a unit that follows digits a word of its own."""
    digit = _DIGIT[low]
    mixed = np.flatnonzero(digit[w.start] & ~digit[w.end - 1])
    if not len(mixed):
        return w.doc, w.start, w.end
    other = np.flatnonzero(~digit)
    at = other[np.searchsorted(other, w.start[mixed])]
    unit = _among(_UNIT_HASHES, v.slice_hash(sums, down, at, w.end[mixed]))
    mixed, at = mixed[unit], at[unit]
    end = w.end.copy()
    end[mixed] = at
    return np.insert(w.doc, mixed + 1, w.doc[mixed]), np.insert(w.start, mixed + 1, at), np.insert(end, mixed + 1, w.end[mixed])


def symbols(data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[Symbols, Symbols]:
    """(template, plain words) of the documents lo..hi."""
    b = data[offs[lo] : offs[hi]]
    low = lowered(b)
    rel = offs[lo : hi + 1] - offs[lo]
    w = v.words(low, rel, 0, hi - lo)
    plain = Symbols(w.doc, v.mix(w.hash ^ _PLAIN), w.hash, np.zeros(len(w.doc), dtype=bool))
    if not len(w.doc):
        return plain, plain
    sums, down = v.prefix_hash(low)
    doc, start, end = _cut_units(w, low, sums, down)
    number = _DIGIT[low[start]]
    h = v.slice_hash(sums, down, start, end)
    gap = np.r_[start[1:] - end[:-1], 0]
    near = np.r_[doc[1:] == doc[:-1], False] & (gap == 1)
    between = low[np.minimum(end, len(low) - 1)]
    pure = number & _DIGIT[low[end - 1]]
    unit = np.r_[False, number[:-1] & (doc[1:] == doc[:-1])] & ~number & _among(_UNIT_HASHES, h)
    name = _capital(b, low, start, end) & ~number & ~unit & ~_among(_COMMON_HASHES, h)
    onward = near & (pure & np.r_[pure[1:], False] & ((between == 44) | (between == 46)) | name & np.r_[name[1:], False] & (between == 32))
    first = np.flatnonzero(~np.r_[False, onward[:-1]])
    last = np.flatnonzero(~onward)
    sym = h[first]
    for mark, kind in ((NUMBER, number), (UNIT, unit), (NAME, name)):
        sym[kind[first]] = mark
    return Symbols(doc[first], sym, v.slice_hash(sums, down, start[first], end[last]), (number | unit | name)[first]), plain


def _capital(b: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each word, whether it begins with a capital and is not all capitals."""
    changed, char = b != low, np.arange(len(b))
    if (b >= 0x80).any():
        lead = (b & 0xC0) != 0x80
        lead[0] = True
        char = np.cumsum(lead) - 1
        changed = np.logical_or.reduceat(changed, np.flatnonzero(lead))
    capitals = np.r_[0, np.cumsum(changed)]
    a, z = char[start], char[end - 1] + 1
    return changed[a] & (capitals[z] - capitals[a] < z - a)


def windows(s: Symbols, size: int, plain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first symbol, hash) of windows of ``size`` symbols with ``plain`` or more that are no placeholder."""
    n = len(s.sym)
    at = np.arange(max(0, n - size + 1))
    at = at[s.doc[at] == s.doc[at + size - 1]]
    held = np.r_[0, np.cumsum(s.slot)]
    at = at[held[at + size] - held[at] <= size - plain]
    up, down = v._POWERS.get(n + 1)
    sums = np.zeros(n + 1, dtype=v.U64)
    np.cumsum(s.sym * up[:n], out=sums[1:])
    return s.doc[at], at, v.slice_hash(sums, down, at, at + size)


def _least(size: int, window: int, plain: int) -> int:
    return min(plain, size) if size == window else -(-size // 2)


def _values(s: Symbols, at: np.ndarray, size: int) -> pa.Array:
    """Hashes of the values behind each window's placeholders, by place, 0 elsewhere; an empty list where there are none."""
    grid = at[:, None] + np.arange(size)
    slots = np.where(s.slot[grid], s.value[grid].view(np.int64), 0)
    some = s.slot[grid].any(axis=1)
    return v.lists(slots[some].ravel(), np.where(some, size, 0), pa.int64())


def _scan(window: int, plain: int, shortest: int, sizes: list[int] | None, known: np.ndarray | None):
    """Windows of the given sizes; without sizes, those of an item: of its own length if it is shorter than a window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = v.buffers(batch.column(2))
            for lo, hi in v.chunks(offs):
                for kind, s in enumerate(symbols(data, offs, lo, hi)):
                    total = np.bincount(s.doc, minlength=hi - lo)
                    base = np.r_[0, np.cumsum(total)]
                    for size in sizes if sizes is not None else range(shortest, window + 1):
                        doc, at, h = windows(s, size, 0 if kind else _least(size, window, plain))
                        if sizes is None and size < window:
                            mine = total[doc] == size
                            doc, at, h = doc[mine], at[mine], h[mine]
                        if known is not None:
                            hit = _among(known, h)
                            doc, at, h = doc[hit], at[hit], h[hit]
                        if not len(h):
                            continue
                        take = pa.array(doc + lo)
                        n = len(h)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(n, kind, dtype=np.int32)), pa.array(np.full(n, size, dtype=np.int32)), pa.array((at - base[doc]).astype(np.int32)), _values(s, at, size)],
                            ["h", ID, KEY, "kind", "size", "p", "slots"],
                        )

    return run


def agreed(matches: list[tuple[int, int, list[int], list[int]]]) -> tuple[set[int], int]:
    """(places of the item's windows with consistent slots, slot values that differ) of matches (p, ip, slots, islots).

    Each value of the item has one value in the document and the other way
    round.  A pair of values counts by the most matches that lie one after
    another as in the item (equal p - ip), then by all its matches; the pair
    with most goes first, of equals the one with the least values.  The order of
    the matches plays no part, and a chance match cannot displace a copy.
    """
    along = Counter(p - ip for p, ip, _, _ in matches)
    weight: dict[tuple[int, int], list[int]] = {}
    pairs = [{(a, b) for a, b in zip(there, here) if a} for _, _, here, there in matches]
    for (p, ip, _, _), mine in zip(matches, pairs):
        for pair in mine:
            w = weight.setdefault(pair, [0, 0])
            w[0], w[1] = max(w[0], along[p - ip]), w[1] + 1
    there: dict[int, int] = {}
    taken: set[int] = set()
    for (a, b), _ in sorted(weight.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
        if a not in there and b not in taken:
            there[a] = b
            taken.add(b)
    seen, used = set(), set()
    for (_, ip, _, _), mine in zip(matches, pairs):
        if all(there.get(a) == b for a, b in mine):
            seen.add(ip)
            used |= mine
    return seen, sum(a != b for a, b in used)


def _consistent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (document, item) pair, the windows that count, by kind."""
    for batch in batches:
        counts = []
        for matches in batch.column(3).to_pylist():
            seen, changed = agreed([(m["p"], m["ip"], m["slots"], m["islots"]) for m in matches if m["kind"] == 0])
            counts.append((len(seen), len({m["ip"] for m in matches if m["kind"] == 1}), changed))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array([c[k] for c in counts], type=pa.int32()) for k in range(3))], [ID, KEY, "item_id", "template", "verbatim", "n_changed"])


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, plain: int, share: float, max_held: int, shortest: int, id_col: str, text_col: str) -> DataFrame:
    k = keyed(docs, id_col, text_col)
    kind = k.schema[ID].dataType.simpleString()
    items = benchmark.select(F.col("item_id").alias(ID), F.lit(0).cast("bigint").alias(KEY), F.col("text").cast("string").alias(TEXT)).where(F.col(ID).isNotNull())
    item_kind = items.schema[ID].dataType.simpleString()
    columns = "kind int, size int, p int, slots array<bigint>"
    of_items = items.mapInArrow(_scan(window, plain, shortest, None, None), f"h bigint, {ID} {item_kind}, {KEY} bigint, {columns}").select("h", F.col(ID).alias("item_id"), "kind", "size", F.col("p").alias("ip"), F.col("slots").alias("islots"))
    n_windows = of_items.groupBy("item_id").agg(*(F.countDistinct(F.when(F.col("kind") == c, F.col("ip"))).alias(f"n_{c}") for c in (0, 1)))
    sizes = sorted(r[0] for r in of_items.select("size").distinct().collect())  # at most one for each length up to a window
    known = None
    distinct = of_items.select("h").distinct()
    if distinct.count() <= max_held:
        known = np.sort(distinct.toArrow().column(0).to_numpy().view(v.U64))
    found = k.mapInArrow(_scan(window, plain, shortest, sizes, known), f"h bigint, {ID} {kind}, {KEY} bigint, {columns}")
    # repeated rows give their matches once, and one place of a repeated window is enough
    found = found.groupBy("h", ID, KEY, "slots").agg(F.min("p").alias("p"))
    pairs = found.join(of_items, "h").groupBy(ID, KEY, "item_id").agg(F.collect_list(F.struct("kind", "p", "ip", "slots", "islots")).alias("m"))
    checked = pairs.mapInArrow(_consistent, f"{ID} {kind}, {KEY} bigint, item_id {item_kind}, template int, verbatim int, n_changed int")
    both = checked.join(n_windows, "item_id")
    # the kind of windows of which the document holds the larger share
    part = lambda c, n: F.when(F.col(n) > 0, F.col(c) / F.col(n)).otherwise(F.lit(0.0))
    first = part("template", "n_0") >= part("verbatim", "n_1")
    chosen = both.select(ID, KEY, "item_id", F.when(first, F.col("template")).otherwise(F.col("verbatim")).alias("n_windows"), F.greatest(part("template", "n_0"), part("verbatim", "n_1")).alias("share"), F.when(first, F.col("n_changed")).otherwise(F.lit(0)).alias("n_changed"))
    return chosen.where((F.col("n_windows") > 0) & (F.col("share") >= share))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, plain: int = PLAIN, share: float = SHARE, max_held: int = MAX_HELD, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, share, n_changed) of every document that holds an item.

    ``n_windows`` of the item's windows, ``share`` of them, occur in the document
    with consistent slots (see :func:`agreed`) or as plain words, whichever is
    the larger share; ``n_changed`` slot values differ from the item's (0: a
    verbatim copy, more: re-parameterised).  An item shorter than ``window`` is
    one window of its own length, of which at least half are plain words; one of
    fewer than ``shortest`` words matches nothing.  Null and empty texts match
    nothing; null item ids are ignored, null document ids kept.  Texts have any
    length and are scanned whole, one document at a time if it is long.  Rows
    equal in id and text give one row an item; copies of an item with different
    ids each match.  Extra columns are ignored whatever their names; an empty
    table on either side gives no rows.

    Up to ``max_held`` distinct item windows are sent to the tasks, which drop
    other windows at once; beyond that all windows are joined by shuffle.
    """
    m = _matches(docs, benchmark, window, plain, share, max_held, shortest, id_col, text_col)
    return m.select(F.col(ID).alias("doc_id"), "item_id", "n_windows", F.round("share", 6).alias("share"), "n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, plain: int = PLAIN, share: float = SHARE, max_held: int = MAX_HELD, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; edge cases as in :func:`contaminated`."""
    bad = _matches(docs, benchmark, window, plain, share, max_held, shortest, id_col, text_col).select(F.col(ID).alias("__gl_i"), F.col(KEY).alias("__gl_k")).distinct()
    mine = docs.withColumn(KEY, F.xxhash64(docs[text_col].cast("string")))
    return mine.join(bad, mine[id_col].eqNullSafe(F.col("__gl_i")) & (mine[KEY] == F.col("__gl_k")), "left_anti").select(*docs.columns)
