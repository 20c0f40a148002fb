"""Near-duplicate groups by SuperMinHash signatures.

SuperMinHash gives element x in step j the value j + r, r uniform in [0, 1),
at slot p_j of a permutation of the slots that belongs to x; a slot keeps its
least value.  As the permutations spread each element over distinct slots the
signature's variance is below MinHash's.  A document whose slots are all below
j + 1 is done after step j, since later steps only bring larger values.  Here
step j runs over all unfinished documents of a chunk at once; the minimum does
not depend on the order, so the signature equals the sequential algorithm's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vec as v
from ._rows import ID, KEY, keyed, saved

SHINGLE = 3
SLOTS = 128
BANDS = 32
THRESHOLD = 0.5
#: Bands of up to so many members are compared pair by pair, larger ones by their rarest slots; the result is the same.
PAIRED = 64
#: Elements whose permutations are held at once.
_HELD = 1 << 17


def _draw(seed: np.ndarray, step: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, slot to swap with) of step ``step`` for each element."""
    r = v.mix(seed + v.U64((0x9E3779B97F4A7C15 * (step + 1)) & (2**64 - 1)))
    swap = step + ((r & v.U64(0xFFFFFFFF)) * v.U64(slots - step) >> v.U64(32)).astype(np.int64)
    # the step above 40 random bits: as exact as j + r, and one integer
    return (v.U64(step) << v.U64(40)) | (v.mix(r) >> v.U64(24)), swap


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """n_docs x slots values; ``doc`` is sorted and holds each element's document."""
    top = v.U64(2**64 - 1)
    sig = np.full((n_docs, slots), top, dtype=v.U64)
    flat = sig.reshape(-1)
    value, swap = _draw(h, 0, slots)
    np.minimum.at(flat, doc * slots + swap, value)
    has = np.bincount(doc, minlength=n_docs) > 0
    open_docs = has & (sig.max(axis=1) >= v.U64(1 << 40))
    held = np.flatnonzero(open_docs[doc])
    at = 0
    while at < len(held):
        stop = min(at + _HELD, len(held))
        # whole documents only: a document's step must be over before it is tested
        while stop < len(held) and doc[held[stop]] == doc[held[stop - 1]]:
            stop += 1
        part = held[at:stop]
        at = stop
        d, seed = doc[part], h[part]
        perm = np.tile(np.arange(slots, dtype=np.int16), (len(part), 1))
        rows = np.arange(len(part))
        _, swap = _draw(seed, 0, slots)
        perm[rows, 0], perm[rows, swap] = perm[rows, swap], 0
        for step in range(1, slots):
            value, swap = _draw(seed, step, slots)
            slot = perm[rows, swap]
            perm[rows, swap] = perm[rows, step]
            perm[rows, step] = slot
            np.minimum.at(flat, d * slots + slot, value)
            if step == slots - 1:
                break
            touched = np.unique(d)
            done = touched[sig[touched].max(axis=1) < v.U64((step + 1) << 40)]
            if len(done):
                live = ~np.isin(d, done)
                d, seed, perm = d[live], seed[live], perm[live]
                rows = np.arange(len(d))
                if not len(d):
                    break
    return sig


def _sign(size: int, slots: int, bands: int):
    per = slots // bands
    weights = v.mix(np.arange(1, slots + 1, dtype=v.U64))
    number = v.mix(np.arange(1, bands + 1, dtype=v.U64) * v.U64(0xC2B2AE3D27D4EB4F))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = v.buffers(batch.column(2))
            for lo, hi in v.chunks(offs):
                sig = np.full((hi - lo, slots), v.U64(2**64 - 1))
                for doc, h in v.distinct_shingles(data, offs, lo, hi, size):
                    sig = np.minimum(sig, signatures(doc, h, hi - lo, slots))
                full = np.flatnonzero(sig[:, 0] != v.U64(2**64 - 1))
                if not len(full):
                    continue
                mixed = v.mix(sig[full])
                band = v.mix((mixed * weights).reshape(len(full), bands, per).sum(axis=2, dtype=v.U64) + number)
                whole = v.mix((mixed * weights).sum(axis=1, dtype=v.U64))
                short = (mixed & v.U64(0xFFFF)).astype(np.uint16)  # unequal values agree by chance once in 65,536
                take = pa.array(full + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(whole.view(np.int64)),
                        pa.array([row.tobytes() for row in short], type=pa.binary()),
                        v.lists(band.reshape(-1).view(np.int64), np.full(len(full), bands), pa.int64()),
                    ],
                    [ID, KEY, "s", "sig", "bands"],
                )

    return run


def signed(docs: DataFrame, shingle: int = SHINGLE, slots: int = SLOTS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, s, sig, bands) of every document with a word; s identifies the signature."""
    k = keyed(docs, id_col, text_col)
    source = k.select(ID, KEY, F.lower(k["__gl_text"]).alias("text"))
    kind = source.schema[ID].dataType.simpleString()
    return source.mapInArrow(_sign(shingle, slots, bands), f"{ID} {kind}, {KEY} bigint, s bigint, sig binary, bands array<bigint>")


def _agree(slots: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(v.buffers(batch.column(i))[0][v.buffers(batch.column(i))[1][0] : v.buffers(batch.column(i))[1][-1]].tobytes(), dtype=np.uint16).reshape(-1, slots) for i in (2, 3))
            keep = pa.array((a == b).mean(axis=1) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def verified(pairs: DataFrame, sigs: DataFrame, slots: int, threshold: float) -> DataFrame:
    """Those (u, v) whose signatures agree in at least ``threshold`` of the slots."""
    a, b = sigs.select(F.col("s").alias("u"), F.col("sig").alias("a")), sigs.select(F.col("s").alias("v"), F.col("sig").alias("b"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b")
    return both.mapInArrow(_agree(slots, threshold), "u bigint, v bigint")


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges: each node with its root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, type=pa.int64()), pa.array([find(x) for x in part], type=pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the undirected graph with an edge to another: root is the least node of its component.

    Union-find runs inside every partition and leaves a star for each local
    component.  Stars are then joined across partitions by alternating
    large-star and small-star steps, which shuffle edges only, until nothing
    changes; nothing is gathered on one machine.
    """
    forest = saved(edges.mapInArrow(_unite, "u bigint, v bigint").distinct())
    before = None
    while True:
        both = forest.union(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        less = large.where("v < u")
        low = less.groupBy("u").agg(F.min("v").alias("m"))
        small = less.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        forest = saved(small)
        state = tuple(forest.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return forest.select("u", F.col("v").alias("root"))
        before = state


def _slot_keys(slots: int):
    """A key of each (band, slot, value)."""
    number = v.mix(np.arange(1, slots + 1, dtype=v.U64) * v.U64(0x9E3779B97F4A7C15))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 12):
                batch = whole.slice(lo, 1 << 12)
                n = batch.num_rows
                data, offs = v.buffers(batch.column(3))
                value = data[offs[0] : offs[-1]].view(np.uint16).reshape(n, slots).astype(v.U64)
                band = np.ascontiguousarray(batch.column(0).to_numpy()).view(v.U64)
                key = v.mix((value << v.U64(16)) + number + band[:, None])
                row = pa.array(np.repeat(np.arange(n), slots))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(3)), pa.array(key.ravel().view(np.int64))], ["band", "s", "c", "key"])

    return run


def rare_keys(apart: DataFrame, sigs: DataFrame, slots: int, threshold: float) -> DataFrame:
    """(key, s, c): the rarest slots of each member of a band, so that two that agree enough share one of them.

    Two signatures that agree in t of k slots share one of the k - t + 1 slots
    that are rarest in the band, whatever the order among equals (the prefix
    filter of set similarity joins).  A slot that no other member has takes a
    place but needs no key, so members that only have the band in common, or
    less than t slots of a template, meet nowhere.
    """
    prefix = slots - int(np.ceil(threshold * slots)) + 1
    every = apart.join(sigs.select("s", "sig"), "s").select("band", "s", "c", "sig").mapInArrow(_slot_keys(slots), "band bigint, s bigint, c bigint, key bigint")
    every = saved(every)
    often = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = every.join(often, "key").groupBy("band", "s", "c").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("l"))
    kept = ranked.select("s", "c", F.explode(F.slice("l", 1, F.greatest(F.lit(0), F.lit(prefix - slots) + F.size("l")))).alias("e"))
    return kept.select("e.key", "s", "c").distinct()


def across(keys: DataFrame) -> DataFrame:
    """Pairs (u, v) of members of a key in different groups: those outside a key's largest group meet all others."""
    groups = keys.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("key").agg(F.max(F.struct("n", "c")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", F.col("m.c").alias("main"))
    mixed = keys.join(main, "key")
    other = mixed.where("c != main").select("key", F.col("s").alias("x"), F.col("c").alias("cx"))
    return other.join(mixed.select("key", F.col("s").alias("y"), F.col("c").alias("cy")), "key").where("cx != cy").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with c, the group that ``s`` is in."""
    return members.join(roots.select(F.col("u").alias("s"), "root"), "s", "left").withColumn("c", F.coalesce("root", "s")).drop("root")


def join_apart(members: DataFrame, sigs: DataFrame, roots: DataFrame, slots: int, threshold: float, paired: int = PAIRED) -> DataFrame:
    """Roots after every pair of a band of (band, s, n) that is not in one group yet has been compared, or could not agree.

    Small bands compare all such pairs.  In larger ones members meet by their
    rarest slots: first each with the least member of a key, then, of what that
    left in different groups, all.
    """
    placed = with_roots(members, roots)
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
    apart = saved(placed.join(mixed, "band"))
    few = apart.where(F.col("n") <= paired)
    x, y = few.select("band", F.col("s").alias("u"), F.col("c").alias("cu")), few.select("band", F.col("s").alias("v"), F.col("c").alias("cv"))
    edges = saved(verified(x.join(y, "band").where("cu < cv").select("u", "v").distinct(), sigs, slots, threshold))
    many = apart.where(F.col("n") > paired)
    if not many.isEmpty():
        keys = saved(rare_keys(many, sigs, slots, threshold))
        least = keys.groupBy("key").agg(F.min(F.struct("s", "c")).alias("h"))
        stars = keys.join(least, "key").where("c != h.c").select(F.col("h.s").alias("u"), F.col("s").alias("v")).distinct()
        # saved, so that no task runs the workers of two steps at once
        edges = edges.union(saved(verified(stars, sigs, slots, threshold)))
        roots = components(roots.select("u", F.col("root").alias("v")).union(edges))
        edges = saved(verified(across(with_roots(keys.select("key", "s"), roots)), sigs, slots, threshold))
    return roots if edges.isEmpty() else components(roots.select("u", F.col("root").alias("v")).union(edges))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, slots: int = SLOTS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED) -> DataFrame:
    """(id, key, group, kept) of every row in a group of two rows or more."""
    rows = saved(signed(docs, shingle, slots, bands, id_col, text_col))
    # documents with equal signatures are one node from here on, however many they are
    sigs = rows.groupBy("s").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    banded = sigs.select("s", F.explode("bands").alias("band"))
    size = F.count(F.lit(1))
    heads = banded.groupBy("band").agg(F.min("s").alias("head"), size.alias("n")).where("n > 1")
    members = saved(banded.join(heads, "band"))
    slim = sigs.select("s", "sig")
    first = saved(verified(members.where("s != head").select(F.col("head").alias("u"), F.col("s").alias("v")).distinct(), slim, slots, threshold))
    roots = join_apart(members.drop("head"), slim, components(first), slots, threshold, paired)
    grouped = with_roots(rows.select(ID, KEY, "s"), roots).select(ID, KEY, F.col("c").alias("g"))
    best = grouped.groupBy("g").agg(F.min(F.struct(F.col(ID).isNull().alias("z"), F.col(ID).alias("i"), F.col(KEY).alias("k"))).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return grouped.join(best, "g").select(ID, KEY, "g", "n", F.col("b.i").alias("rep"), (F.col(ID).eqNullSafe(F.col("b.i")) & (F.col(KEY) == F.col("b.k"))).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, slots: int = SLOTS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, group_size, is_kept) of every row that has a near duplicate.

    Two documents are linked if they share a band and their signatures agree in
    at least ``threshold`` of the slots; groups are the connected components.
    group_id is the least id of the group, and its row is kept (of equal ids,
    the one with the least text hash).  A text without a word (null, empty,
    punctuation) is never a duplicate.  Repeated rows are duplicates of each
    other; where id and text are both equal all of them read is_kept and
    :func:`deduplicate` keeps one.  A null id comes last in a group's order.
    Texts have any length: long ones are signed piece by piece, and shingles
    count once, so memory does not grow with repetition.  Extra columns are
    ignored whatever their names; no rows give no rows.

    Bands compare with one head each, then what this left in different groups
    (see :func:`join_apart`), so no candidate is capped or skipped, and a band
    of many unlike members costs in proportion to them.
    """
    g = near_groups(docs, threshold, shingle, slots, bands, id_col, text_col)
    return g.select(F.col(ID).alias("doc_id"), F.col("rep").alias("group_id"), F.col("n").alias("group_size"), F.col("kept").alias("is_kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group; edge cases as in :func:`near_duplicates`.

    Of rows equal in id and text the one stays whose other columns, written as
    JSON, come first.
    """
    name = lambda id_: F.when(id_.isNull(), "n").otherwise(F.concat(F.lit("i"), id_.cast("string"))).alias("__gl_i")
    g = near_groups(docs, id_col=id_col, text_col=text_col, **options)
    g = g.groupBy(name(F.col(ID)), F.col(KEY)).agg(F.max("kept").alias("__gl_kept"))
    mine = docs.select("*", name(docs[id_col]), F.xxhash64(docs[text_col].cast("string")).alias(KEY))
    # the join's partitioning serves the window too, which tells equal rows apart
    others = [docs[c] for c in docs.columns if c not in (id_col, text_col)]
    mine = mine.withColumn("__gl_o", F.to_json(F.struct(*others)) if others else F.lit(""))
    copy = F.row_number().over(Window.partitionBy("__gl_i", KEY).orderBy("__gl_o"))
    joined = mine.join(g, ["__gl_i", KEY], "left").withColumn("__gl_n", copy)
    return joined.where("__gl_kept is null or (__gl_kept and __gl_n = 1)").select(*docs.columns)
