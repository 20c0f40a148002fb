import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from graphloom.llm import _vec as v
from graphloom.llm import minhash as m

from .helpers import docs, empty, odd_rows, prose, words


def sequential(h, slots):
    sig = np.full(slots, 2**64 - 1, dtype=np.uint64)
    for x in h:
        p = list(range(slots))
        for j in range(slots):
            value, swap = m._draw(np.array([x], dtype=np.uint64), j, slots)
            s = int(swap[0])
            p[j], p[s] = p[s], p[j]
            sig[p[j]] = min(sig[p[j]], value[0])
    return sig


def test_signatures_equal_the_sequential_algorithm():
    rng = np.random.default_rng(0)
    doc = np.repeat(np.arange(4), [3, 40, 0, 200])
    h = rng.integers(0, 2**63, len(doc)).astype(np.uint64)
    sig = m.signatures(doc, h, 4, 16)
    for i in (0, 1, 3):
        assert (sig[i] == sequential(h[doc == i], 16)).all()
    assert (sig[2] == np.uint64(2**64 - 1)).all()


def test_variance_is_below_minhash():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        h = rng.integers(0, 2**63, 150).astype(np.uint64)
        sig = m.signatures(np.repeat([0, 1], 100), np.r_[h[:100], h[50:]], 2, 64)
        errors.append((sig[0] == sig[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert np.var(errors) < (1 / 3) * (2 / 3) / 64


def jaccard(a, b):
    return len(a & b) / len(a | b)


def noisy(text, share, r):
    return " ".join("x%d" % r.randrange(10**6) if r.random() < share else w for w in text.split())


def test_groups_match_brute_force(spark):
    r = random.Random(2)
    rows, sets = [], []
    for i in range(60):
        base = prose(r.randint(30, 300), 100 + i)
        rows.append(base)
        for _ in range(r.choice([0, 0, 1, 3])):
            rows.append(noisy(base, r.choice([0.0, 0.02, 0.05]), r))
    rows = list(enumerate(rows))
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    out = m.near_duplicates(docs(spark, rows)).collect()
    group = {x.doc_id: x.group_id for x in out}
    far = [(a, b) for (a, _), (b, _) in itertools.combinations(rows, 2) if jaccard(sets[a], sets[b]) >= 0.6]
    found = sum(group.get(a, -1) == group.get(b, -2) for a, b in far)
    assert far and found >= 0.95 * len(far)
    linked = {a for a, b in far} | {b for a, b in far}
    for x in out:
        if x.doc_id not in linked:
            assert max(jaccard(sets[x.doc_id], s) for i, s in enumerate(sets) if i != x.doc_id) > 0.4
        assert x.is_kept == (x.doc_id == x.group_id)
    kept = {x.doc_id for x in m.deduplicate(docs(spark, rows)).collect()}
    assert kept == {i for i, _ in rows if group.get(i, i) == i}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (101, 103), (102, 101), (200, 201)]
    random.Random(0).shuffle(edges)
    out = {r.u: r.root for r in m.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 103: 100, 201: 200}


def test_edge_cases(spark):
    rows = odd_rows()
    d = docs(spark, rows)
    out = m.near_duplicates(d).collect()
    assert sorted((x.doc_id, x.group_id, x.group_size) for x in out) == [(4, 4, 2), (4, 4, 2)]
    kept = m.deduplicate(d)
    assert kept.columns == d.columns
    assert kept.count() == len(rows) - 1
    assert m.near_duplicates(empty(spark)).count() == 0 and m.deduplicate(empty(spark)).count() == 0
    nulls = docs(spark, [(None, "some words that are equal"), (7, "some words that are equal")])
    assert [x.group_id for x in m.near_duplicates(nulls).collect()] == [7, 7]
    assert [x.doc_id for x in m.deduplicate(nulls).collect()] == [7]


def test_pieces_of_a_long_text_give_all_its_shingles():
    for text in (prose(900, 1), " " * 500 + "one two three", "x" * 900, prose(3, 1) + " " * 400 + prose(200, 2), " " * 700):
        data, offs = v.buffers(pa.array(["before", text, "after"]))
        want = {int(h) for _, hs in v.distinct_shingles(data, offs, 1, 2, 3) for h in hs}
        old, v.PIECE_BYTES = v.PIECE_BYTES, 64
        v.pieces.__defaults__ = (64,)
        try:
            parts = [hs for _, hs in v.distinct_shingles(data, offs, 1, 2, 3)]
        finally:
            v.PIECE_BYTES, v.pieces.__defaults__ = old, (old,)
        assert {int(h) for hs in parts for h in hs} == want


def test_repetition_costs_neither_time_nor_memory():
    column = pa.array(["spam " * 2_000_000])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), column], ["i", "k", "t"])
    list(m._sign(3, 128, 32)([batch.slice(0, 0)]))
    tracemalloc.start()
    began = time.perf_counter()
    out = list(m._sign(3, 128, 32)([batch]))
    assert len(out) == 1 and time.perf_counter() - began < 10
    assert tracemalloc.get_traced_memory()[1] < 900e6
    tracemalloc.stop()


def test_large_bands_lose_no_link(spark):
    r = random.Random(9)
    rows = []
    for i in range(12):
        base = prose(60, 700 + i % 4)
        rows += [(len(rows) + k, noisy(base, 0.12, r)) for k in range(8)]
    d = docs(spark, rows)
    group = lambda p: sorted((x["__gl_id"], x["rep"], x["n"]) for x in m.near_groups(d, paired=p).collect())
    assert group(1) == group(10**9) and len(group(1)) > 20


def test_a_band_of_unlike_members_stays_linear(spark):
    rng = np.random.default_rng(4)
    n, slots = 3_000, 128
    sig = rng.integers(0, 65536, (n, slots)).astype(np.uint16)
    sig[:, :4] = 7  # the band
    sig[:, 4:60] = 9  # a template, less than the threshold
    for a, b in ((1000, 2000), (1500, 2500)):
        sig[b, :70] = sig[a, :70]
    sigs = spark.createDataFrame([(i, row.tobytes()) for i, row in enumerate(sig)], "s long, sig binary")
    members = spark.createDataFrame([(i, 5, n) for i in range(n)], "s long, band long, n long")
    none = spark.createDataFrame([], "u long, root long")
    assert m.rare_keys(members.selectExpr("band", "s", "s as c"), sigs, slots, 0.5).count() < n
    out = {x.u: x.root for x in m.join_apart(members, sigs, none, slots, 0.5).collect()}
    assert out == {2000: 1000, 2500: 1500}


def test_other_columns_decide_between_equal_rows(spark):
    rows = [(1, "the same few words", {"a": i}, i) for i in (3, 1, 2)]
    for order in itertools.permutations(rows):
        d = spark.createDataFrame(list(order), "doc_id long, text string, m map<string,int>, h int").repartition(3)
        assert [x.h for x in m.deduplicate(d).collect()] == [1]
