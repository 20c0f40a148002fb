"""Repeated passages: sliding spans of sentences, joined across the corpus.

A sentence ends after ``.``, ``!`` or ``?`` before white space, or at a line
end.  From every sentence on, the shortest run of at least ``run`` consecutive
sentences that has ``min_words`` words is hashed from its words, so case,
spacing and punctuation do not matter; short sentences make a run longer and
never drop it.  The shortest such run that ends with the document counts too,
and so does every single sentence of ``min_words`` words: a repeated passage of
whole sentences with twice as many words holds a run for sure.
A sentence goes if any run that covers it occurred before, in an earlier
document or earlier in its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as v
from ._rows import ID, KEY, TEXT, keyed, saved

#: Sentences of a run, at least.
RUN = 3
#: Words of a run, at least.
MIN_WORDS = 24

_END = np.zeros(256, dtype=bool)
_END[[46, 33, 63]] = True


def sentences(data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, v.Words, np.ndarray]:
    """Sentences with words: (document, first byte, end byte, words, first word of each + end).

    Bytes count from the start of document ``lo``.  A piece without words
    (a blank line, a rule) belongs to no sentence and is never removed.
    """
    b = data[offs[lo] : offs[hi]]
    rel = offs[lo : hi + 1] - offs[lo]
    cut = b == 10
    cut[:-1] |= _END[b[:-1]] & v.SPACE[b[1:]]
    starts = np.union1d(np.flatnonzero(cut) + 1, rel)
    w = v.words(data, offs, lo, hi)
    of = np.searchsorted(starts, w.start, "right") - 1
    new = np.ones(len(of), dtype=bool)
    new[1:] = of[1:] != of[:-1]
    first = np.flatnonzero(new)
    s = of[first]
    return w.doc[first], starts[s], starts[s + 1] if len(s) else s, w, np.r_[first, len(of)]


def runs(doc: np.ndarray, w: v.Words, first: np.ndarray, n_docs: int, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number of the first sentence in it, number after the last, hash) of every run."""
    up, down = v._POWERS.get(len(w.hash) + 1)
    sums = np.zeros(len(w.hash) + 1, dtype=v.U64)
    np.cumsum(w.hash * up[: len(w.hash)], out=sums[1:])
    base = np.searchsorted(doc, np.arange(n_docs + 1))
    start = np.arange(len(doc))
    end = np.maximum(start + run, np.searchsorted(first, first[:-1] + min_words, "left"))
    whole = end <= base[1:][doc]
    long = np.flatnonzero(np.diff(first) >= min_words) if run > 1 else np.zeros(0, dtype=np.int64)
    # the shortest run that ends with the document covers what is left after the others
    tail = base[1:][np.diff(base) > 0]
    ahead = np.minimum(tail - run, np.searchsorted(first, first[tail] - min_words, "right") - 1)
    fits = ahead >= base[:-1][np.diff(base) > 0]
    start, end = np.r_[start[whole], ahead[fits], long], np.r_[end[whole], tail[fits], long + 1]
    return doc[start], start - base[doc[start]], end - base[doc[start]], v.slice_hash(sums, down, first[start], first[end])


def _emit(run: int, min_words: int):
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = v.buffers(batch.column(2))
            for lo, hi in v.chunks(offs):
                doc, _, _, w, first = sentences(data, offs, lo, hi)
                d, number, end, h = runs(doc, w, first, hi - lo, run, min_words)
                take = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(end.astype(np.int32))], ["h", ID, KEY, "n", "e"])

    return go


def _cut():
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(2), batch.column(3)
            out, removed = texts.to_pylist(), np.zeros(len(texts), dtype=np.int32)
            for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                data, offs = v.buffers(texts.slice(i, 1))
                data, offs = data[offs[0] : offs[1]], np.array([0, offs[1] - offs[0]])
                doc, a, z, _, _ = sentences(data, offs, 0, 1)
                spans = gone[int(i)].values
                over = np.zeros(len(doc) + 1, dtype=np.int64)
                np.add.at(over, spans.field("n").to_numpy(zero_copy_only=False), 1)
                np.add.at(over, spans.field("e").to_numpy(zero_copy_only=False), -1)
                hit = np.cumsum(over)[:-1] > 0
                raw, parts, at = data.tobytes(), [], 0
                for s in np.flatnonzero(hit):
                    parts.append(raw[at : a[s]])
                    at = z[s]
                out[i] = b"".join([*parts, raw[at:]]).decode()
                removed[i] = hit.sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string()), pa.array(removed)], ["doc_id", "text", "n_removed"])

    return go


def repeated(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n, e): the sentences from n up to e of a document are a run that occurred before; one row each."""
    k = keyed(docs, id_col, text_col)
    kind = k.schema[ID].dataType.simpleString()
    spans = saved(k.select(ID, KEY, F.lower(TEXT).alias("text")).mapInArrow(_emit(run, min_words), f"h bigint, {ID} {kind}, {KEY} bigint, n int, e int"))
    # null ids come last; the extremes are found before the shuffle, so a run with a billion copies is no hot key
    place = F.struct(F.col(ID).isNull().alias("z"), F.col(ID).alias("i"), F.col(KEY).alias("k"), F.col("n").alias("n"))
    ends = spans.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "first")
    return spans.join(ends, "h").where(place != F.col("first")).select(ID, KEY, "n", "e").distinct()


def remove_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_removed) of every row of ``docs``, without its repeated sentences.

    Documents are ordered by id (null last), then by text hash; runs inside a
    document by position.  The first occurrence of a run stays.  A document of
    fewer than ``min_words`` words has no run and stays as it is; texts have any
    length and are split whole.  A null text stays null, an empty one empty; a text whose
    sentences are all repeats becomes what lay between them, mostly "".  Rows equal
    in id and text are one document and get the same result.  Extra columns are
    ignored whatever their names; no rows give no rows.
    """
    gone = repeated(docs, run, min_words, id_col, text_col).groupBy(ID, KEY).agg(F.collect_set(F.struct("n", "e")).alias("gone"))
    k = keyed(docs, id_col, text_col)
    kind = k.schema[ID].dataType.simpleString()
    right = gone.select(F.col(ID).alias("i"), F.col(KEY).alias("k"), "gone")
    joined = k.join(right, k[ID].eqNullSafe(right.i) & (k[KEY] == right.k), "left").select(k[ID], k[KEY], TEXT, "gone")
    return joined.mapInArrow(_cut(), f"doc_id {kind}, text string, n_removed int")
