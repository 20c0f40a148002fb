"""Byte-pair encoding and decoding, with tree concatenation for long text.

A token sequence is an encoding of its bytes exactly if every two neighbours
are, that is, if encoding their joined bytes gives the two again.  So two
encoded halves join like this: re-encode a window around the cut; once its
first token is the left half's token there and its last token the right half's,
every pair of neighbours lies inside an encoding, and the three parts in a row
are the encoding of the whole.  Until then the window grows.

This happens at two levels.  A text longer than ``leaf`` characters is cut into
leaves that become rows of their own, encoded by any task in parallel, and
joined in rounds: ``FAN`` neighbours in a task, then what they have become.  A
join splits the text around a cut anew, from a blank that is a boundary for
sure until a boundary of the right text is met.  A word that spans the cut is
made of words that either side has encoded already, so it is their
concatenation; nothing but windows is encoded again.  A single word (text free
of white space, say) of more than ``unsplit`` bytes is encoded as a tree of
halves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as v
from . import vocabulary
from ._rows import ID, KEY, TEXT, keyed

#: A blank after another character.
_BLANK = re.compile(rb"[^\s] ")

LEAF = 1 << 16
UNSPLIT = 512
#: Tokens on each side of a cut in the first window.
WINDOW = 4
#: Leaves that one task joins in the first round.
FAN = 16
#: No pattern looks further than so many characters beyond the end of a word.
LOOK = 64
#: Tokens on each side of a cut where words are split anew at first.
NEAR = 64


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str = vocabulary.RANKS, pattern: str = vocabulary.PATTERN, unsplit: int = UNSPLIT) -> None:
        import regex

        self.encoding = vocabulary.encoding(path, pattern)
        self.core = self.encoding._core_bpe
        self.bytes_of = {i: b for b, i in vocabulary.ranks(path).items()}
        self.split = regex.compile(pattern)
        self.unsplit = unsplit

    def decode(self, tokens: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))

    def tree(self, raw: bytes) -> list[int]:
        """Encodes bytes that no pattern splits."""
        if len(raw) <= max(2, self.unsplit):
            return self.core.encode_single_piece(raw)
        cut = len(raw) // 2
        return self.concat(self.tree(raw[:cut]), self.tree(raw[cut:]))

    def concat(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings in a row."""
        if not left or not right:
            return left + right
        size = WINDOW
        while True:
            a, z = max(0, len(left) - size), min(len(right), size)
            window = self.core.encode_single_piece(self.decode(left[a:] + right[:z]))
            left_agrees = a == 0 or window[0] == left[a]
            right_agrees = z == len(right) or window[-1] == right[z - 1]
            if left_agrees and right_agrees:
                return left[:a] + window + right[z:]
            size *= 2

    def encode(self, text: str, long: bool = True) -> list[int]:
        """``long``: whether a word may be longer than ``unsplit`` bytes."""
        if not long:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for word in self.split.findall(text):
            out += self.tree(word.encode())
        return out

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of two texts in a row from their encodings.

        A blank after another character ends a word whatever follows it, so from
        there on the whole is split anew, until a boundary of the right text is
        met; from that one on the splits are equal.  A word of the whole that is
        tiled by words of the two sides is the concatenation of their tokens;
        one that cuts through a run of white space is encoded anew.
        """
        if not a or not b:
            return a + b
        size = NEAR
        while True:
            i, j = max(0, len(a) - size), min(len(b), size)
            size *= 4
            raw = self.decode(a[i:])
            p = 0 if not i else next((m.start() + 1 for m in _BLANK.finditer(raw)), -1)
            if p < 0:
                continue
            left, right = raw[p:].decode(), self.decode(b[:j]).decode(errors="ignore")
            mine = [m.span() for m in self.split.finditer(left)]
            # words that end this far before the cut are the same in the whole
            skip = next((k for k in range(len(mine) - 1, -1, -1) if mine[k][0] <= len(left) - LOOK), 0)
            start = mine[skip][0] if mine else 0
            p += len(left[:start].encode())
            mine, left = [(x - start, y - start) for x, y in mine[skip:]], left[start:]
            # the window ends inside the right text: its second half may split otherwise in the whole
            limit = len(right) if j == len(b) else len(right) // 2
            theirs = [m.span() for m in self.split.finditer(right) if m.end() <= limit]
            ends, cut, words, end = {z for _, z in theirs}, len(left), [], None
            for m in self.split.finditer(left + right):
                words.append(m.span())
                if m.end() - cut in ends:
                    end = m.end() - cut
                    break
            if end is not None:
                break
        pieces = mine + [(cut + x, cut + y) for x, y in theirs if y <= end]
        text = left + right
        head = self._tokens(a, i, p)
        coded, at_a, at_b = [], head, 0
        for x, y in pieces:
            bytes_ = len(text[x:y].encode())
            if x < cut:
                stop = self._tokens(a, at_a, bytes_)
                coded.append(a[at_a:stop])
                at_a = stop
            else:
                stop = self._tokens(b, at_b, bytes_)
                coded.append(b[at_b:stop])
                at_b = stop
        out, k = a[:head], 0
        for x, y in words:
            while k < len(pieces) and pieces[k][0] < x:
                k += 1
            first = k
            while k < len(pieces) and pieces[k][1] <= y:
                k += 1
            if k > first and pieces[first][0] == x and pieces[k - 1][1] == y:
                joined = coded[first]
                for more in coded[first + 1 : k]:
                    joined = self.concat(joined, more)
                out += joined
            else:
                out += self.tree(text[x:y].encode())
        return out + b[at_b:]

    def _tokens(self, tokens: list[int], at: int, size: int) -> int:
        """The place in ``tokens`` that is ``size`` bytes after place ``at``; a word boundary is a token boundary."""
        while size > 0:
            size -= len(self.bytes_of[tokens[at]])
            at += 1
        assert size == 0, "a word boundary is a token boundary"
        return at

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours pairwise, level by level."""
        while len(parts) > 1:
            joined = [self.join(x, y) for x, y in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0] if parts else []


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, unsplit: int) -> Codec:
    return Codec(path, pattern, unsplit)


def _lists(rows: list[list[int] | None]) -> pa.Array:
    return pa.array(rows, type=pa.list_(pa.int32()))


def _long(column: pa.Array, unsplit: int) -> np.ndarray:
    """Of each text, whether it may have a run of ``unsplit`` bytes without, or of, ASCII white space.

    Such a run covers a whole aligned block of half its length.
    """
    data, offs = v.buffers(column)
    out = np.zeros(len(offs) - 1, dtype=bool)
    block = max(1, unsplit // 2)
    first, blocks = int(offs[0]), int(offs[-1] - offs[0]) // block
    blank = v.SPACE[data[first : first + blocks * block].reshape(blocks, block)]
    whole = np.flatnonzero(~blank.any(axis=1) | blank.all(axis=1)) * block
    out[np.searchsorted(offs - first, whole, "right") - 1] = True
    return out


def _encode(path: str, pattern: str, unsplit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, unsplit)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts, long = column.to_pylist(), _long(column, unsplit)
            # the tokens of a few documents at a time are Python objects
            for lo in range(0, len(texts), 256):
                part = batch.slice(lo, 256)
                tokens = [None if t is None else c.encode(t, far) for t, far in zip(texts[lo : lo + 256], long[lo : lo + 256])]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(tokens)], [*part.schema.names, "tokens"])

    return run


def _join(path: str, pattern: str, unsplit: int, fan: int | None):
    """Joins the rows of a group in order of ``leaf``; the result has the number of its group of ``fan``."""

    def run(key: tuple[pa.Scalar, ...], groups: pa.Table) -> pa.Table:
        rows = groups.sort_by("leaf")
        tokens = codec(path, pattern, unsplit).join_all(rows.column("tokens").to_pylist())
        place = {"leaf": pa.array([rows.column("leaf")[0].as_py() // fan], type=pa.int32())} if fan else {}
        return pa.table({ID: rows.column(ID).slice(0, 1), KEY: rows.column(KEY).slice(0, 1)} | place | {"tokens": _lists([tokens])})

    return run


def _encoded(docs: DataFrame, path: str, pattern: str, leaf: int, unsplit: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, tokens) of every row."""
    k = keyed(docs, id_col, text_col)
    kind = k.schema[ID].dataType.simpleString()
    short = k.where(F.coalesce(F.length(TEXT) <= leaf, F.lit(True)))
    done = short.mapInArrow(_encode(path, pattern, unsplit), f"{ID} {kind}, {KEY} bigint, {TEXT} string, tokens array<int>").select(ID, KEY, "tokens")
    long = k.where(F.length(TEXT) > leaf)
    # one set of leaves for rows that are equal, and how many rows there are
    whole = long.groupBy(ID, KEY).agg(F.first(TEXT).alias(TEXT), F.count(F.lit(1)).alias("copies"))
    leaves = whole.select(ID, KEY, F.explode(F.sequence(F.lit(0), ((F.length(TEXT) - 1) / leaf).cast("int"))).alias("leaf"), TEXT)
    leaves = leaves.withColumn(TEXT, F.substring(F.col(TEXT), F.col("leaf") * leaf + 1, F.lit(leaf))).repartition(ID, KEY, "leaf")
    coded = leaves.select(ID, KEY, "leaf", TEXT).mapInArrow(_encode(path, pattern, unsplit), f"{ID} {kind}, {KEY} bigint, leaf int, {TEXT} string, tokens array<int>").drop(TEXT)
    some = coded.groupBy(ID, KEY, (F.col("leaf") / FAN).cast("int")).applyInArrow(_join(path, pattern, unsplit, FAN), f"{ID} {kind}, {KEY} bigint, leaf int, tokens array<int>")
    joined = some.groupBy(ID, KEY).applyInArrow(_join(path, pattern, unsplit, None), f"{ID} {kind}, {KEY} bigint, tokens array<int>")
    copies = whole.select(F.col(ID).alias("i"), F.col(KEY).alias("k"), "copies")
    back = joined.join(copies, joined[ID].eqNullSafe(copies.i) & (joined[KEY] == copies.k)).select(ID, KEY, "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("n"))
    return done.unionByName(back.select(ID, KEY, "tokens"))


def encode(docs: DataFrame, path: str = vocabulary.RANKS, pattern: str = vocabulary.PATTERN, leaf: int = LEAF, unsplit: int = UNSPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) of every row.

    Texts up to ``leaf`` characters are encoded where they are read; longer
    ones are cut into leaves, which are spread over all tasks and joined by
    document in two rounds.  The result never depends on ``leaf``.  A null text has null
    tokens, an empty one none.  Rows equal in id and text give equal rows, as
    many as there were; null ids stay; extra columns are ignored whatever their
    names; no rows give no rows.
    """
    return _encoded(docs, path, pattern, leaf, unsplit, id_col, text_col).select(F.col(ID).alias("doc_id"), "tokens")


def _decode(path: str, at: int, name: str):
    """Adds the text of the tokens in column ``at``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, vocabulary.PATTERN, UNSPLIT)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if t is None else c.decode(t).decode("utf-8", "replace") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.string())], [*part.schema.names, name])

    return run


def decode(tokens: DataFrame, path: str = vocabulary.RANKS, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) of (doc_id, tokens): null gives null, no tokens give "".

    Bytes that are no UTF-8 become U+FFFD; an unknown token is an error.
    """
    source = tokens.select(tokens[id_col].alias(ID), tokens[tokens_col].cast("array<int>").alias("tokens"))
    kind = source.schema[ID].dataType.simpleString()
    return source.mapInArrow(_decode(path, 1, "text"), f"{ID} {kind}, tokens array<int>, text string").select(F.col(ID).alias("doc_id"), "text")


def round_trip(docs: DataFrame, path: str = vocabulary.RANKS, pattern: str = vocabulary.PATTERN, leaf: int = LEAF, unsplit: int = UNSPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, tokens, restored) of every row: whether the decoded tokens are the text.

    Edge cases as in :func:`encode`; a null text has -1 tokens and is restored as null.
    """
    coded = _encoded(docs, path, pattern, leaf, unsplit, id_col, text_col)
    kind = coded.schema[ID].dataType.simpleString()
    back = coded.mapInArrow(_decode(path, 2, "text"), f"{ID} {kind}, {KEY} bigint, tokens array<int>, text string")
    return back.select(F.col(ID).alias("doc_id"), F.coalesce(F.size("tokens"), F.lit(-1)).alias("n_tokens"), "tokens", (F.xxhash64("text") == F.col(KEY)).alias("restored"))


def encoded(docs: DataFrame, path: str = vocabulary.RANKS, **options) -> DataFrame:
    """(doc_id, n_tokens, tokens) of every row; edge cases as in :func:`encode`."""
    return encode(docs, path, **options).select("doc_id", F.size("tokens").alias("n_tokens"), "tokens")
