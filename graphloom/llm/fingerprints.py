"""Document fingerprints: bottom-k sketches of shingle hashes.

The sketch of a set of shingles is its k smallest 64-bit hashes.  The k
smallest of the union of two sketches are the sketch of the union of the sets,
so sketches of parts merge without the texts.  With fewer than k hashes a
sketch holds the whole set and all its answers are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vec as v
from ._rows import saved

SHINGLE = 5
K = 128
#: Smallest hashes by which documents meet.
LOW = 8
_RANGE = float(1 << 64)


def _sketches(k: int, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = v.buffers(batch.column(1))
            for lo, hi in v.chunks(offs):
                # a long document comes in pieces, whose sketches merge
                held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=v.U64)
                for doc, h in v.distinct_shingles(data, offs, lo, hi, size):
                    if len(held[1]):
                        h = np.union1d(held[1][:k], h)
                        doc = np.zeros(len(h), dtype=np.int64)
                    held = doc, h
                doc, h = held
                total = np.bincount(doc, minlength=hi - lo)
                rank = np.arange(len(doc)) - np.repeat(np.cumsum(total) - total, total)
                h = h[rank < k]
                # stored with the sign bit flipped: signed order is then the order of the hashes
                signed = (h ^ v.U64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), v.lists(signed, np.minimum(total, k), pa.int64())], ["doc_id", "sketch"])

    return run


def sketch(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch): one row per row of ``docs``, in one pass without a shuffle.

    A null, empty or wordless text has an empty sketch; a text of fewer words
    than a shingle has one shingle, of all of them.  Repeated rows give
    repeated sketches, null ids stay, other columns are ignored whatever their
    names, and no rows give no rows.
    """
    source = docs.select(docs[id_col].alias("doc_id"), F.lower(docs[text_col].cast("string")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_sketches(k, shingle), f"doc_id {kind}, sketch array<bigint>")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge(parts: DataFrame, by: list[str], k: int = K, column: str = "sketch") -> DataFrame:
    """(by..., sketch): the sketch of the union of each group's sets.

    Only k hashes a group and task cross the shuffle: hashes are made distinct
    and ranked per group, and Spark applies the rank limit before it shuffles.
    Groups whose sketches are all empty, and null sketches, give an empty sketch.
    """
    from pyspark.sql import Window

    groups = parts.select(*by).distinct()
    flat = parts.select(*by, F.explode(column).alias("__gl_h"))
    window = Window.partitionBy(*by).orderBy("__gl_h")
    # dense_rank counts distinct hashes, so copies of a hash that several parts hold take one place
    kept = flat.withColumn("__gl_r", F.dense_rank().over(window)).where(F.col("__gl_r") <= k)
    lists = kept.groupBy(*by).agg(F.array_sort(F.collect_set("__gl_h")).alias("__gl_s"))
    right = lists.select(*[F.col(c).alias(f"__gl_{i}") for i, c in enumerate(by)], "__gl_s")
    match = F.lit(True)
    for i, c in enumerate(by):
        match = match & groups[c].eqNullSafe(right[f"__gl_{i}"])
    return groups.join(right, match, "left").select(*by, F.coalesce("__gl_s", F.array().cast("array<bigint>")).alias(column))


def distinct(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k-1) over the k-th hash as a share of the range."""
    top = (F.element_at(s, -1).cast("double") + F.lit(float(1 << 63)) + F.lit(1.0)) / F.lit(_RANGE)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(float(k - 1)) / top)


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    union = merged(a, b, k)
    return union, F.size(F.array_intersect(union, F.array_intersect(a, b)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|; 0 where both are empty."""
    union, common = _shared(a, b, k)
    return F.when(F.size(union) == 0, F.lit(0.0)).otherwise(common / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|; 0 where A is empty, at most 1."""
    both = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), both / distinct(a, k)))


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_distinct, sketch) of every document; edge cases as in :func:`sketch`."""
    return sketch(docs, k, shingle, id_col, text_col).select("doc_id", F.round(distinct(F.col("sketch"), k), 3).alias("n_distinct"), "sketch")


def compare(a: DataFrame, b: DataFrame, pairs: DataFrame, k: int = K) -> DataFrame:
    """(a_id, b_id, resemblance, containment of a in b, containment of b in a) of given pairs of ids.

    ``a`` and ``b`` are (doc_id, sketch) frames.  Pairs with an unknown or null id give no row.
    """
    left, right = a.select(F.col("doc_id").alias("a_id"), F.col("sketch").alias("__gl_a")), b.select(F.col("doc_id").alias("b_id"), F.col("sketch").alias("__gl_b"))
    x, y = F.col("__gl_a"), F.col("__gl_b")
    return pairs.select("a_id", "b_id").join(left, "a_id").join(right, "b_id").select("a_id", "b_id", resemblance(x, y, k).alias("resemblance"), containment(x, y, k).alias("a_in_b"), containment(y, x, k).alias("b_in_a"))


def families(docs: DataFrame, k: int = K, shingle: int = SHINGLE, low: int = LOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_distinct, n_copies, head_id, resemblance, containment, sketch) of every document.

    Documents with equal sketches are one class, however many they are
    (``n_copies``), and its least id speaks for it.  A class is compared with
    the head of each of its ``low`` smallest hashes: the least id of all classes
    with that hash among their own smallest.  Of the heads the one with the
    highest estimated resemblance or containment is taken, of equals the least
    id; ``containment`` is the share of the document's shingles that the head
    contains.  Two documents of resemblance r meet in a hash with a probability
    of about 1 - (1 - r) ** low.  A class without another head is its own, and
    so is a document with an empty sketch.

    Ids of one class with a null among them are spoken for by the others; a class
    of null ids alone is never a head of others and has a null head.  Texts have
    any length; long ones are sketched piece by piece.  Hot hashes have one head
    each, so nothing grows with their size.

    Sketches are the bulk of the data.  They are not written but made again each
    time, which gives the same, and shuffled twice, one a class and task to be
    compared and all to meet the result, where adaptive execution splits a class
    with a large share of all rows.  Only the sketches of heads go on to the
    classes that meet them.
    """
    rows = fingerprints(docs, k, shingle, id_col, text_col).withColumn("__gl_s", F.when(F.size("sketch") > 0, F.xxhash64("sketch")))
    some = rows.where("__gl_s is not null")
    classes = saved(some.groupBy("__gl_s").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first(F.slice("sketch", 1, low)).alias("lows")))
    lows = classes.select("__gl_s", "rep", F.explode("lows").alias("h"))
    head = lows.where("rep is not null").groupBy("h").agg(F.min(F.struct("rep", "__gl_s")).alias("head"))
    met = lows.select("__gl_s", "h").join(head, "h").where("__gl_s != head.__gl_s").select(F.col("__gl_s").alias("a"), F.col("head.__gl_s").alias("b"), F.col("head.rep").alias("b_rep"))
    met = saved(met.distinct())
    # rows of a class have the same sketch, of which each task passes on one
    sketches = some.groupBy("__gl_s").agg(F.first("sketch").alias("sketch"))
    right = sketches.select(F.col("__gl_s").alias("b"), F.col("sketch").alias("__gl_b"))
    left = sketches.select(F.col("__gl_s").alias("a"), F.col("sketch").alias("__gl_a"))
    x, y = F.col("__gl_a"), F.col("__gl_b")
    both = met.join(right, "b").select("a", "b_rep", "__gl_b").join(left, "a")
    compared = both.select(F.col("a").alias("__gl_s"), F.col("b_rep").alias("head_id"), resemblance(x, y, k).alias("r"), containment(x, y, k).alias("c"))
    best = compared.groupBy("__gl_s").agg(F.min(F.struct((-F.greatest("r", "c")).alias("x"), "head_id", "r", "c")).alias("b"))
    whole = F.when(F.col("__gl_s").isNotNull(), 1.0).otherwise(0.0)
    known = classes.join(best, "__gl_s", "left").select("__gl_s", "n_copies", F.coalesce("b.head_id", "rep").alias("head_id"), F.coalesce("b.r", F.lit(1.0)).alias("r"), F.coalesce("b.c", F.lit(1.0)).alias("c"))
    return rows.join(known, "__gl_s", "left").select(
        "doc_id",
        "n_distinct",
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.when(F.col("__gl_s").isNull(), F.col("doc_id")).otherwise(F.col("head_id")).alias("head_id"),
        F.coalesce("r", whole).alias("resemblance"),
        F.coalesce("c", whole).alias("containment"),
        "sketch",
    )
