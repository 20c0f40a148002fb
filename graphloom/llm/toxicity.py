"""Toxicity scores from an induced lexicon.

Labelled documents give seed terms of either polarity.  Random walks with
restart at the seeds run over a graph of words; the ratio of the two walks'
probabilities is a word's polarity.  A document's score is the mean positive
polarity of its words, smoothed for short texts.

The graph has every word of the corpus, however rare, and an edge between any
two different words whose pointwise mutual information is positive, from their
co-occurrences over all documents.  Edges are distributed and compressed, each
stored once, or twice where neither word is among the most frequent.  A walk is
a product of that matrix and a vector: the vector and the words' counts, about
40 bytes a distinct word, are held by the driver and by every Python worker, so
they grow with the vocabulary.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as v
from ._rows import ID, KEY, keyed, saved

#: Words within this distance co-occur.
WINDOW = 4
#: Labelled documents that seeds and the threshold are taken from, at most.
LABELLED = 20_000
#: Up to so many chosen ids are sent to the tasks; with a larger bound documents are shuffled to them.
BROADCAST = 500_000
#: Words of the lexicon that every task may hold; above, documents are joined with it by shuffle.
HELD = 2_000_000
#: Words of the shingles by which copies in the labelled sample are told.
SHINGLE = 3
#: Seeds: of the words with a z-score of their log odds from SEED_Z on those of highest z, of the words of z up to 0 those in most clean documents.
SEED_Z = 3.0
TOXIC_SEEDS, CLEAN_SEEDS = 256, 512
RESTART = 0.5
STEPS = 8
#: Co-occurrences at which a word's polarity counts by half.
EVIDENCE = 7.0
#: Words that a short text counts as having in addition.
SMOOTH = 20
#: A word's polarity counts from the median by so many scaled deviations; the labelled sample chooses one.
LEANS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)
#: Pairs that a task holds before it passes them on.
_PAIRS = 1 << 22
#: Passes over the texts, of which each makes a share of the links; what one shuffles is deleted before the next.
PASSES = 2
#: Links in a row of the graph.
_ROW = 1 << 18
#: So many words of most co-occurrences have a sum in every task; a pair with one of them is stored once.
HEAD = 1 << 14
#: Stands for "all words" in an edge list.
_ALL = 0xFFFF


def sample_labelled(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label 0/1) of at most ``limit`` labelled documents, those of least id hash; null labels and texts are ignored."""
    chosen = labels.select(labels[id_col].alias("i"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and i is not null").orderBy(F.xxhash64("i"), "label").limit(limit)
    return docs.select(docs[id_col].alias("i"), F.lower(docs[text_col].cast("string")).alias("t")).where("t is not null").join(F.broadcast(chosen) if limit <= BROADCAST else chosen, "i").select("t", "label")


def _families(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = v.buffers(batch.column(0))
            for lo, hi in v.chunks(offs):
                least, some = np.zeros(hi - lo, dtype=v.U64), np.zeros(hi - lo, dtype=bool)
                for doc, h in v.distinct_shingles(data, offs, lo, hi, size):
                    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else doc
                    at = doc[first]
                    least[at] = np.where(some[at], np.minimum(least[at], h[first]), h[first])
                    some[at] = True
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(least.view(np.int64), mask=~some)], ["t", "label", "family"])

    return run


def apart(sample: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(t, label) of one text of each family and label, the one of least hash: texts are of a family if the least hash of their shingles is the same.

    Exact copies are of one family, near copies of resemblance r with probability
    r.  Words of a text with many copies would else be the seeds.
    """
    families = sample.mapInArrow(_families(size), "t string, label int, family bigint").where("family is not null")
    return families.groupBy("family", "label").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).select("t", "label")


def _held_by(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): how many documents of either label hold a word."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offs = v.buffers(batch.column(0))
        for lo, hi in v.chunks(offs):
            w = v.words(data, offs, lo, hi)
            word, at = np.unique(w.hash, return_inverse=True)
            pair = np.unique(w.doc * np.int64(max(1, len(word))) + at)
            toxic = label[lo:hi][pair // max(1, len(word))]
            n = np.bincount(pair % max(1, len(word)), minlength=len(word))
            t = np.bincount(pair % max(1, len(word)), weights=toxic, minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(t), pa.array(n - t)], ["h", "toxic", "clean"])


@dataclass
class Seeds:
    """Seed words in order of their hashes, and what each walk starts with at them."""

    hashes: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray


def choose_seeds(sample: DataFrame, seed_z: float = SEED_Z, toxic_seeds: int = TOXIC_SEEDS, clean_seeds: int = CLEAN_SEEDS) -> Seeds:
    """Seeds of a (t, label) sample; each weighs by the documents of its side that hold it.  Of equal words the one of least hash goes first."""
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    t, c = float(counts.get(1, 0)), float(counts.get(0, 0))
    held = sample.mapInArrow(_held_by, "h bigint, toxic bigint, clean bigint").groupBy("h").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    side = lambda x, n: F.log((x + 0.5) / (F.lit(n) - x + 0.5))
    spread = lambda x, n: F.lit(1.0) / (x + 0.5) + F.lit(1.0) / (F.lit(n) - x + 0.5)
    a, b = F.col("a"), F.col("b")
    scored = saved(held.withColumn("z", (side(a, t) - side(b, c)) / F.sqrt(spread(a, t) + spread(b, c)))) if t and c else held.withColumn("z", F.lit(0.0)).limit(0)
    bad = scored.where(F.col("z") >= seed_z).orderBy(F.desc("z"), "h").limit(toxic_seeds).collect()
    good = scored.where("z <= 0 and b > 0").orderBy(F.desc("b"), "h").limit(clean_seeds).collect()
    rows = sorted([(np.int64(r.h).view(np.uint64), r.a, 0) for r in bad] + [(np.int64(r.h).view(np.uint64), 0, r.b) for r in good])
    table = np.array([r[1:] for r in rows], dtype=np.float64).reshape(-1, 2)
    return Seeds(np.array([r[0] for r in rows], dtype=v.U64), table[:, 0], table[:, 1])


def _place(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted array, -1 where it is none of it."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _lists_of(word: np.ndarray, seed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(words, edge lists): each list is pairs of 16-bit numbers, a seed and a count; larger counts take several pairs."""
    key = (word.astype(np.int64) << 16) | seed
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    key, n = key[first], np.add.reduceat(n, first) if len(first) else n
    times = np.maximum(1, -(-n // 0xFFFF))
    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    count = np.minimum(0xFFFF, np.repeat(n, times) - part * 0xFFFF)
    key = np.repeat(key, times)
    pairs = np.stack([key & 0xFFFF, count], axis=1).astype(np.uint16)
    words = key >> 16
    start = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, dtype=np.int64)
    offsets = np.r_[start, len(words)].astype(np.int32) * 4
    return words[start], pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(pairs.tobytes())])


def _cooccur(seeds: np.ndarray, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, seed, n = (np.concatenate([p[k] for p in held]) for k in range(3))
            word, at = np.unique(h, return_inverse=True)
            number, lists = _lists_of(at, seed, n)
            return pa.RecordBatch.from_arrays([pa.array(word[number].view(np.int64)), lists], ["h", "edges"])

        for batch in batches:
            data, offs = v.buffers(batch.column(0))
            for lo, hi in v.chunks(offs):
                w = v.words(data, offs, lo, hi)
                word, at = np.unique(w.hash, return_inverse=True)
                seed = _place(seeds, word)[at]
                every = np.zeros(len(word), dtype=np.int64)
                keys = []
                for d in range(1, window + 1):
                    a, b = at[:-d], at[d:]
                    near = (w.doc[:-d] == w.doc[d:]) & (a != b)
                    every += np.bincount(a[near], minlength=len(word)) + np.bincount(b[near], minlength=len(word))
                    for x, s in ((a, seed[d:]), (b, seed[:-d])):
                        some = near & (s >= 0)
                        keys.append(x[some] << 16 | s[some])
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                # a word may meet seeds in another task, so all its co-occurrences are passed on
                some = np.flatnonzero(every)
                held += [(word[key >> 16], key & 0xFFFF, n), (word[some], np.full(len(some), _ALL), every[some])]
                size += len(key) + len(word)
                if size > _PAIRS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One edge list a word, of rows in order of words; a word of many lists is merged batch by batch."""
    kept: pa.RecordBatch | None = None

    def merged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        h = np.concatenate([r.column(0).to_numpy() for r in rows])
        seed, n, row = _entries(pa.concat_arrays([r.column(1) for r in rows]))
        word, at = np.unique(h, return_inverse=True)
        number, lists = _lists_of(at[row], seed, n)
        return pa.RecordBatch.from_arrays([pa.array(word[number]), lists], ["h", "edges"])

    for batch in batches:
        if not batch.num_rows:
            continue
        done = merged([kept, batch] if kept is not None else [batch])
        # the last word may go on in the next batch
        kept = done.slice(done.num_rows - 1)
        if done.num_rows > 1:
            yield done.slice(0, done.num_rows - 1)
    if kept is not None:
        yield kept


def _entries(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, count, row) of all pairs of edge lists."""
    data, offs = v.buffers(lists)
    pairs = np.frombuffer(data[offs[0] : offs[-1]].tobytes(), dtype=np.uint16).reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1], np.repeat(np.arange(len(offs) - 1), np.diff(offs) // 4)


def edges(docs: DataFrame, seeds: Seeds, window: int = WINDOW, text_col: str = "text", finish=_merge, kind: str = "h bigint, edges binary") -> DataFrame:
    """(h, edges): for every word with a neighbour, how often each seed, and any word at all, is within the window.

    Counted over every document; a word does not co-occur with itself.  With
    ``finish``, what it makes of the lists in the same worker.
    """
    source = docs.select(F.lower(docs[text_col].cast("string")).alias("t")).where("t is not null")
    parts = source.mapInArrow(_cooccur(seeds.hashes, window), "h bigint, edges binary")
    return parts.repartition("h").sortWithinPartitions("h").mapInArrow(finish, kind)


@dataclass
class Graph:
    """Words by number, those of most co-occurrences first; how many each has; the links of all pairs of them, in parts."""

    hashes: np.ndarray
    degree: np.ndarray
    links: DataFrame
    parts: int
    head: int

    def number(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 of words that have no neighbour."""
        order = np.argsort(self.hashes)
        at = _place(self.hashes[order], h)
        return np.where(at >= 0, order[at], -1) if len(order) else at


def _every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n) of edge lists: all co-occurrences of a word."""
    for batch in batches:
        seed, n, row = _entries(batch.column(1))
        every = seed == _ALL
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row[every], weights=n[every], minlength=batch.num_rows).astype(np.int64))], ["h", "n"])


def _coded(x: np.ndarray) -> bytes:
    """Numbers of 0 and more: how many bytes the largest takes, then bytes of equal rank together, compressed."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _decoded(data: memoryview, m: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], width * m, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, m)
    out = planes[0].astype(np.int64)
    for k in range(1, width):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def _packed(part: int, key: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """A row of links of sorted keys: the first words as differences, how many links each has, the second words as differences within them; and the counts."""
    own, other = key >> 32, key & 0xFFFFFFFF
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    step = np.diff(other, prepend=0)
    step[first] = other[first]
    streams = [_coded(np.diff(own[first], prepend=0)), _coded(np.diff(np.r_[first, len(key)])), _coded(step)]
    head = np.array([len(first), len(streams[0]), len(streams[1])], dtype="<i8").tobytes()
    return part, len(key), b"".join([head, *streams]), _coded(n)


def _runs(m: int, key: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first words, how many links each has, second words, counts) of a row of ``m`` links."""
    data = memoryview(key)
    runs, a, b = np.frombuffer(data[:24], dtype="<i8").tolist()
    own, times = np.cumsum(_decoded(data[24 : 24 + a], runs)), _decoded(data[24 + a : 24 + a + b], runs)
    other = np.cumsum(_decoded(data[24 + a + b :], m))
    other -= np.repeat(np.r_[0, other[np.cumsum(times)[:-1] - 1]], times)
    return own, times, other, _decoded(memoryview(n), m)


def _unpacked(m: int, key: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    own, times, other, n = _runs(m, key, n)
    return np.repeat(own << 32, times) | other, n


def _rows_of(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "m", "keys", "counts"])


_LINKS = "part bigint, m bigint, keys binary, counts binary"


def _tagged(key: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Keys with their counts in the low ``bits``, to be sorted as plain numbers; a larger count takes several."""
    top = (1 << bits) - 1
    x = key.astype(v.U64) << v.U64(bits)
    big = np.flatnonzero(n > top)
    if len(big):
        more = (n[big] - 1) // top
        rest = n.copy()
        rest[big] -= more * top
        return np.r_[x | rest.astype(v.U64), np.repeat(x[big] | v.U64(top), more)]
    return x | n.astype(v.U64)


def _summed(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts; sorts ``x`` in place."""
    x.sort()
    n = (x & v.U64((1 << bits) - 1)).view(np.int64)
    x >>= v.U64(bits)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[first].view(np.int64), np.add.reduceat(n, first)


def _numbering(h: np.ndarray, number: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted hashes and the number of each, in few bytes."""
    return len(h), _coded(np.diff(h, prepend=v.U64(0))), _coded(number)


def _numbered(n: int, h: bytes, number: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_decoded(memoryview(h), n).view(v.U64)), _decoded(memoryview(number), n).astype(np.int32)


def _pairs(sent: Broadcast, window: int, parts: int, head: int, turn: int):
    """Links of the words within the window, each in the part of its rarer word; of two words that are both not of the ``head``, in the part of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = _numbered(*sent.value)
        # words of a part have places that follow each other, so that sorted keys are in order of parts
        size = -(-len(order) // parts)
        bits = 32 - max(1, (parts * size).bit_length())
        held: list[np.ndarray] = []
        count = 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            key, n = _summed(x, bits)
            place = key >> 32
            cut = np.r_[0, np.searchsorted(place, np.arange(1, parts + 1) * size)]
            rows = []
            for part in range(parts):
                lo, hi = cut[part], cut[part + 1]
                if lo < hi:
                    own = (place[lo:hi] - part * size) * parts + part
                    rows.append(_packed(part, own << 32 | key[lo:hi] & 0xFFFFFFFF, n[lo:hi]))
            return _rows_of(rows)

        for batch in batches:
            data, offs = v.buffers(batch.column(0))
            for lo, hi in v.chunks(offs):
                w = v.words(data, offs, lo, hi)
                word, at = np.unique(w.hash, return_inverse=True)
                place = _place(known, word)
                number = np.where(place >= 0, order[place], -1).astype(np.int64) if len(order) else place
                part = number % parts
                to = ((part * size + number // parts) << 32)[at]
                mine, at = (part % PASSES == turn)[at], number[at]
                keys = []
                for d in range(1, window + 1):
                    a, b = at[:-d], at[d:]
                    near, less = (w.doc[:-d] == w.doc[d:]) & (a != b), a < b
                    rare, often = np.where(less, to[d:], to[:-d]), np.minimum(a, b)
                    some = near & np.where(less, mine[d:], mine[:-d])
                    keys.append(rare[some] | often[some])
                    some = near & (often >= head) & np.where(less, mine[:-d], mine[d:])
                    keys.append(np.where(less, to[:-d], to[d:])[some] | np.maximum(a, b)[some])
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                if not len(key):
                    continue
                held.append(_tagged(key, n, bits))
                count += len(held[-1])
                if count > _PAIRS:
                    yield out()
                    count = 0
        if held:
            yield out()

    return run


def _merge_links(words: int):
    """Rows of links, each pair once a part, of rows in order of their parts."""
    bits = 32 - max(1, words.bit_length())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []

        def out() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            held.clear()
            key, n = _summed(x, bits)
            for lo in range(0, len(key), _ROW):
                yield _rows_of([_packed(part, key[lo : lo + _ROW], n[lo : lo + _ROW])])

        for batch in batches:
            for p, m, key, n in zip(*batch.columns):
                if p.as_py() != part and held:
                    yield from out()
                part = p.as_py()
                held.append(_tagged(*_unpacked(m.as_py(), key.as_py(), n.as_py()), bits))
        if held:
            yield from out()

    return run


def _free(spark: SparkSession) -> None:
    """Has Spark delete the shuffles that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def graph(docs: DataFrame, window: int = WINDOW, text_col: str = "text", head: int = HEAD) -> Graph:
    """The graph of all words that have a neighbour, and of every pair of different words within the window, counted over every document."""
    spark = docs.sparkSession
    nothing = Seeds(np.zeros(0, dtype=v.U64), np.zeros(0), np.zeros(0))
    t = edges(docs, nothing, window, text_col, lambda batches: _every(_merge(batches)), "h bigint, n bigint").toArrow()
    h, n = t.column("h").to_numpy().view(v.U64), t.column("n").to_numpy()
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    del t, order
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.lower(docs[text_col].cast("string")).alias("t")).where("t is not null")
    _free(spark)
    by_hash = np.argsort(h)
    sent = spark.sparkContext.broadcast(_numbering(h[by_hash], by_hash))
    del by_hash
    links = []
    for turn in range(PASSES):
        links.append(saved(source.mapInArrow(_pairs(sent, window, parts, head, turn), _LINKS).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge_links(len(h)), _LINKS)))
        _free(spark)
    sent.destroy(blocking=True)
    return Graph(h, n.astype(np.float64), reduce(DataFrame.unionAll, links), parts, head)


def _reach(sent: Broadcast, parts: int, head: int):
    """(part, least, got): what reaches words ``least``, ``least`` + ``parts`` and so on over their links from the two rows of ``by``; part -1 has the head.

    A link weighs the positive pointwise mutual information of its words,
    discounted for small counts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degree, times, total, by = sent.value
        log, less = np.repeat(np.log(degree), times), np.repeat(degree / (degree + 1), times)
        often = np.zeros((2, min(head, len(log))))
        logs = np.log(np.arange(1, 1 << 12))
        row = lambda part, least, got: pa.RecordBatch.from_arrays([pa.array([part]), pa.array([least]), pa.array([got.tobytes()], type=pa.binary())], ["part", "least", "got"])
        for batch in batches:
            for part, m, key, n in zip(*batch.columns):
                own, times, other, n = _runs(m.as_py(), key.as_py(), n.as_py())
                first = np.cumsum(times) - times
                w = logs[n - 1] if n.max() <= len(logs) else np.log(n)
                w += np.repeat(np.log(total) - log[own], times)
                w -= log[other]
                np.maximum(w, 0, out=w)
                w *= n / (n + 1)
                whose = np.repeat(own, times)
                # the rarer word has the larger number
                w *= less[np.maximum(whose, other)]
                at = (own - own[0]) // parts
                got = np.zeros((2, int(at[-1]) + 1))
                once = np.flatnonzero(other < np.minimum(head, whose))
                to, back, whose = other[once], w[once], whose[once]
                for k in range(2):
                    got[k, at] = np.add.reduceat(w * by[k][other], first)
                    often[k] += np.bincount(to, weights=back * by[k][whose], minlength=often.shape[1])
                yield row(part.as_py(), int(own[0]), got)
        yield row(-1, 0, often)

    return run


def _reached(g: Graph, by: np.ndarray) -> np.ndarray:
    """What reaches each word over its links from the two rows of ``by``; it takes their place."""
    spark = g.links.sparkSession
    first = np.flatnonzero(np.r_[True, g.degree[1:] != g.degree[:-1]]) if len(g.degree) else np.zeros(0, dtype=np.int64)
    sent = spark.sparkContext.broadcast((g.degree[first], np.diff(np.r_[first, len(g.degree)]), float(g.degree.sum()), by))
    t = g.links.mapInArrow(_reach(sent, g.parts, g.head), "part bigint, least bigint, got binary").toArrow()
    # each step sends its own vector, so the files of the last one go, and what the driver's JVM held of it
    sent.destroy(blocking=True)
    _free(spark)
    by[:] = 0
    for part, least, got in zip(*t.columns):
        x = np.frombuffer(got.as_buffer(), dtype=np.float64).reshape(2, -1)
        step = 1 if part.as_py() < 0 else g.parts
        by[:, least.as_py() :: step][:, : x.shape[1]] += x
    return by


def walk(g: Graph, at: np.ndarray, home: np.ndarray, out: np.ndarray, restart: float = RESTART, steps: int = STEPS) -> np.ndarray:
    """The two walks' probabilities at every word; rows are toxic and clean, ``home`` has what each starts with at the words ``at``.

    A step is one pass over the links.  With probability ``restart``, and where
    a walk has no way on, it returns to its seeds.
    """
    now = np.zeros((2, len(out)))
    now[:, at] = home
    for _ in range(steps):
        np.divide(now, out, out=now, where=out > 0)
        now[:, out <= 0] = 0
        now = _reached(g, now)
        now *= 1 - restart
        now[:, at] += home * (1 - now.sum(axis=1))[:, None]
    return now


def polarities(docs: DataFrame, seeds: Seeds, window: int = WINDOW, restart: float = RESTART, steps: int = STEPS, evidence: float = EVIDENCE, text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(h, polarity) of every word with an edge.

    Polarity is the base-10 logarithm of the toxic over the clean walk's
    probability, each first divided by the word's share of all edges; it counts
    by half for a word with ``evidence`` co-occurrences.
    """
    spark = docs.sparkSession
    g = graph(docs, window, text_col, head)
    at = g.number(seeds.hashes)
    known = at >= 0
    home = np.stack([side[known] / side.sum() for side in (seeds.toxic, seeds.clean)])
    out = _reached(g, np.ones((2, len(g.degree))))[0].copy()
    now = walk(g, at[known], home, out, restart, steps)
    whole = max(out.sum(), 1e-30)
    rows = []
    # rows of many words: the driver would else hold an object for each of them
    for lo in range(0, len(out), _ROW):
        met = lo + np.flatnonzero(out[lo : lo + _ROW] > 0)
        share = out[met] / whole
        x = np.log10((now[0, met] / share + 1e-3) / (now[1, met] / share + 1e-3)) * (g.degree[met] / (g.degree[met] + evidence))
        rows.append((g.hashes[met].tobytes(), x.tobytes()))
    del g, out, now
    _free(spark)
    packed = pa.table({"h": pa.array([r[0] for r in rows], type=pa.binary()), "polarity": pa.array([r[1] for r in rows], type=pa.binary())})
    del rows
    return saved(spark.createDataFrame(packed, "h binary, polarity binary").mapInArrow(_words_of, "h bigint, polarity double"))


def _words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a word, of rows of many words."""
    for batch in batches:
        for h, x in zip(*batch.columns):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_buffer(), dtype=np.int64)), pa.array(np.frombuffer(x.as_buffer(), dtype=np.float64))], ["h", "polarity"])


@dataclass
class Lexicon:
    """(h, weight) of the words that count, and the score from which a document is toxic."""

    words: DataFrame | None
    threshold: float


class _Weights:
    """Weights by word hash, for several lexicons at once."""

    def __init__(self, h: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(h.view(v.U64))
        self.hashes, self.weights = h.view(v.U64)[order], weights[order]

    def totals(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums of weights of each document, its number of words)."""
        w = v.words(data, offs, lo, hi)
        at = _place(self.hashes, w.hash)
        known = at >= 0
        sums = [np.bincount(w.doc[known], weights=self.weights[at[known], k], minlength=hi - lo) for k in range(self.weights.shape[1])]
        return np.stack(sums, axis=1), np.diff(w.first)


def _score_all(weights: _Weights, smooth: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = v.buffers(batch.column(1))
            for lo, hi in v.chunks(offs):
                sums, n = weights.totals(data, offs, lo, hi)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), v.lists((sums / (n + smooth)[:, None]).ravel(), np.full(hi - lo, sums.shape[1]), pa.float64())], ["label", "scores"])

    return run


def best_cut(label: np.ndarray, scores: np.ndarray) -> tuple[int, float]:
    """(column of ``scores``, score from which a document is toxic) of best F1 on the labels; of equals the last column.  (-1, inf) if no cut finds any."""
    best = (0.0, -1, np.inf)
    for k in range(scores.shape[1]):
        order = np.argsort(-scores[:, k], kind="stable")
        down = scores[order, k]
        hit = np.cumsum(label[order])
        f1 = 2 * hit / (np.arange(1, len(order) + 1) + label.sum())
        f1[~(np.r_[down[1:] < down[:-1], True] & (down > 0))] = 0
        at = int(np.argmax(f1)) if len(f1) else 0
        if len(f1) and f1[at] >= best[0] and f1[at] > 0:
            best = (f1[at], k, float(down[at]))
    return best[1], best[2]


def induce(docs: DataFrame, labels: DataFrame, window: int = WINDOW, limit: int = LABELLED, seed_z: float = SEED_Z, smooth: float = SMOOTH, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The lexicon of a corpus and the score from which a document is toxic.

    A word's weight is its polarity above the median by a number of scaled
    deviations (``LEANS``); that number and the threshold have the best F1 on
    the labelled sample, and seeds are chosen from it with each family of copies
    counted once (:func:`apart`).  Without labels, without seeds of both kinds or without
    words nothing is toxic.
    """
    sample = saved(sample_labelled(docs, labels, limit, id_col, text_col))
    seeds = choose_seeds(saved(apart(sample)), seed_z)
    if not seeds.toxic.any() or not seeds.clean.any():
        return Lexicon(None, np.inf)
    polarity = polarities(docs, seeds, window, text_col=text_col)
    middle = polarity.agg(F.percentile_approx("polarity", 0.5, 10_000)).first()[0]
    if middle is None:
        return Lexicon(None, np.inf)
    spread = 1.4826 * polarity.agg(F.percentile_approx(F.abs(F.col("polarity") - middle), 0.5, 10_000)).first()[0]
    # the words of the sample are as bounded as it is; the planner knows only the rows that polarities were packed in, and must not broadcast them
    mine = sample.mapInArrow(_held_by, "h bigint, toxic bigint, clean bigint").select("h").distinct().join(polarity.hint("merge"), "h").toArrow()
    leaning = np.maximum(mine.column("polarity").to_numpy()[:, None] - middle - np.array(LEANS) * spread, 0)
    scored = sample.select("label", "t").mapInArrow(_score_all(_Weights(mine.column("h").to_numpy(), leaning), smooth), "label int, scores array<double>").toArrow()
    chosen, threshold = best_cut(scored.column("label").to_numpy(), np.array(scored.column("scores").to_pylist()).reshape(-1, len(LEANS)))
    if chosen < 0:
        return Lexicon(None, np.inf)
    weight = F.col("polarity") - F.lit(float(middle + LEANS[chosen] * spread))
    return Lexicon(polarity.select("h", weight.alias("weight")).where("weight > 0"), threshold)


def _score(weights: _Weights, threshold: float, smooth: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = v.buffers(batch.column(1))
            for lo, hi in v.chunks(offs):
                sums, n = weights.totals(data, offs, lo, hi)
                out = sums[:, 0] / (n + smooth)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.round(out, 6)), pa.array((out >= threshold) & (out > 0))], [ID, "score", "toxic"])

    return run


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = v.buffers(batch.column(2))
        for lo, hi in v.chunks(offs):
            w = v.words(data, offs, lo, hi)
            word, at = np.unique(w.hash, return_inverse=True)
            key, n = np.unique(w.doc * np.int64(max(1, len(word))) + at, return_counts=True)
            doc = key // max(1, len(word))
            take = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(word[key % max(1, len(word))].view(np.int64)), pa.array(n), pa.array(np.diff(w.first)[doc])], [ID, KEY, "h", "n", "words"])


def _score_by_join(docs: DataFrame, lexicon: Lexicon, smooth: float, id_col: str, text_col: str) -> DataFrame:
    k = keyed(docs, id_col, text_col)
    kind = k.schema[ID].dataType.simpleString()
    counts = k.select(ID, KEY, F.lower(k["__gl_text"]).alias("t")).mapInArrow(_word_counts, f"{ID} {kind}, {KEY} bigint, h bigint, n bigint, words bigint")
    # rows equal in id and text count once
    sums = counts.join(lexicon.words.hint("merge"), "h").groupBy(ID, KEY, "h").agg(F.max(F.col("n") * F.col("weight")).alias("x"), F.max("words").alias("words")).groupBy(F.col(ID).alias("i"), F.col(KEY).alias("k")).agg((F.sum("x") / (F.max("words") + F.lit(float(smooth)))).alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    return k.join(sums, k[ID].eqNullSafe(sums.i) & (k[KEY] == sums.k), "left").select(k[ID].alias("doc_id"), F.round(s, 6).alias("score"), ((s >= F.lit(lexicon.threshold)) & (s > 0)).alias("toxic"))


def score(docs: DataFrame, lexicon: Lexicon, smooth: float = SMOOTH, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic) of every row, in one pass without a shuffle while the lexicon has up to ``held`` words, else by a join.

    A text that is null, empty or without a word of the lexicon has score 0 and
    is not toxic.  Texts have any length.  Repeated rows each give a row, null
    ids stay, extra columns are ignored whatever their names, no rows give no
    rows.
    """
    if lexicon.words is not None and lexicon.words.count() > held:
        return _score_by_join(docs, lexicon, smooth, id_col, text_col)
    if lexicon.words is None:
        weights = _Weights(np.zeros(0, dtype=np.int64), np.zeros((0, 1)))
    else:
        t = lexicon.words.toArrow()
        weights = _Weights(t.column("h").to_numpy(), t.column("weight").to_numpy()[:, None])
    source = docs.select(docs[id_col].alias(ID), F.lower(docs[text_col].cast("string")).alias("t"))
    kind = source.schema[ID].dataType.simpleString()
    return source.mapInArrow(_score(weights, lexicon.threshold, smooth), f"{ID} {kind}, score double, toxic boolean").withColumnRenamed(ID, "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of a corpus by its own lexicon; see :func:`induce` and :func:`score`."""
    return score(docs, induce(docs, labels, **options))
