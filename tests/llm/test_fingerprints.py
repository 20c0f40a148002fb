import random

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import _vec as v
from graphloom.llm import fingerprints as f

from .helpers import docs, empty, odd_rows, prose, words


def shingle_sets(rows, size):
    out = []
    for _, t in rows:
        w = words(t)
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def test_small_sets_are_exact(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f x"), (3, "c d e f g"), (4, "zz"), (5, "")]
    s = f.sketch(docs(spark, rows), k=64, shingle=3)
    sets = shingle_sets(rows, 3)
    got = {r.doc_id: r.n for r in s.select("doc_id", f.distinct(F.col("sketch"), 64).alias("n")).collect()}
    assert got == {i: float(len(x)) for (i, _), x in zip(rows, sets)}
    pairs = spark.createDataFrame([(a, b) for a in range(1, 6) for b in range(1, 6)], "a_id long, b_id long")
    for r in f.compare(s, s, pairs, 64).collect():
        a, b = sets[r.a_id - 1], sets[r.b_id - 1]
        assert abs(r.resemblance - (len(a & b) / len(a | b) if a | b else 0)) < 1e-9
        assert abs(r.a_in_b - (len(a & b) / len(a) if a else 0)) < 1e-9


def test_estimates_and_merge(spark):
    base = prose(6000, 1).split()
    rows = [(1, " ".join(base[:4000])), (2, " ".join(base[2000:])), (3, " ".join(base[:4000]))]
    sets = shingle_sets(rows, 5)
    s = f.sketch(docs(spark, rows), k=256)
    r = f.compare(s, s, spark.createDataFrame([(1, 2)], "a_id long, b_id long"), 256).first()
    assert abs(r.resemblance - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12
    assert abs(r.a_in_b - len(sets[0] & sets[1]) / len(sets[0])) < 0.2
    merged = f.merge(s.withColumn("part", F.lit(1)), ["part"], 256)
    n = merged.select(f.distinct(F.col("sketch"), 256)).first()[0]
    assert abs(n / len(sets[0] | sets[1]) - 1) < 0.25
    whole = f.sketch(docs(spark, [(9, " ".join(base))]), k=256).first().sketch
    assert len(set(whole) & set(merged.first().sketch)) > 250


def test_edge_cases(spark):
    out = f.families(docs(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    by = {(r.doc_id, r.n_distinct) for r in out}
    assert {(1, 0.0), (2, 0.0), (3, 0.0), (6, 1.0)} <= by
    assert all(r.resemblance == 1 and r.head_id == 4 for r in out if r.doc_id == 4 and r.n_distinct == 2.0 and r.head_id == 4)
    assert f.families(empty(spark)).count() == 0
    parts = spark.createDataFrame([(None, [1, 2]), (None, [2, 3]), ("a", []), ("b", None)], "p string, sketch array<long>")
    assert {r.p: r.sketch for r in f.merge(parts, ["p"], 2).collect()} == {None: [1, 2], "a": [], "b": []}


def brute_families(rows, k, low, size):
    """By the definition, with exact sketches as sorted lists."""
    sk = [(i, tuple(sorted(r.sketch))) for i, r in rows]
    classes = {}
    for i, s in sk:
        if s:
            classes.setdefault(s, []).append(i)
    rep = {s: min((i for i in ids if i is not None), default=None) for s, ids in classes.items()}
    heads = {}
    for s, r in rep.items():
        if r is not None:
            for h in s[:low]:
                heads[h] = min(heads.get(h, (r, s)), (r, s))
    return {s: {heads[h][0] for h in s[:low] if h in heads and heads[h][1] != s} or {rep[s]} for s in classes}, rep


def test_families_equal_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(25):
        base = prose(r.randint(5, 250), 40 + i).split()
        rows += [(len(rows) + j, " ".join(w if r.random() > x else "y%d" % r.randrange(999) for w in base)) for j, x in enumerate((0.0, 0.0, 0.03, 0.1))]
    rows += [(None, rows[0][1]), (None, prose(40, 999)), (900, ""), (901, None)]
    out = f.families(docs(spark, rows), k=32).collect()
    assert len(out) == len(rows)
    candidates, rep = brute_families([(x.doc_id, x) for x in out], 32, f.LOW, 5)
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    for x in out:
        s = tuple(sorted(x.sketch))
        if not s:
            assert x.head_id == x.doc_id and x.resemblance == 0
            continue
        assert x.head_id in candidates[s] and x.n_copies == sum(tuple(sorted(y.sketch)) == s for y in out)
        if x.head_id is not None and x.doc_id is not None and len(sets[x.doc_id] | sets[x.head_id]) < 32:
            assert abs(x.resemblance - len(sets[x.doc_id] & sets[x.head_id]) / len(sets[x.doc_id] | sets[x.head_id])) < 1e-9
    head = {x.doc_id: x for x in out}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    alike = [(a, max(b for b in range(a) if jac(a, b) >= 0.5)) for a in range(100) if any(jac(a, b) >= 0.5 for b in range(a))]
    found = sum(jac(a, head[a].head_id) >= 0.3 for a, _ in alike)
    assert len(alike) > 50 and found >= 0.95 * len(alike)


def test_sketches_are_not_written(spark, monkeypatch):
    written, saved = [], f.saved
    monkeypatch.setattr(f, "saved", lambda df: written.append(df.columns) or saved(df))
    out = f.families(docs(spark, odd_rows())).collect()
    assert written and not any("sketch" in x for x in written)
    assert len(out) == len(odd_rows())


def test_sketches_of_pieces_merge(spark):
    text = prose(900, 3)
    whole = f.sketch(docs(spark, [(1, text)])).first().sketch
    data = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    old = v.pieces.__defaults__
    v.pieces.__defaults__ = (200,)
    try:
        parts = next(iter(f._sketches(f.K, f.SHINGLE)([data]))).column(1).to_pylist()[0]
    finally:
        v.pieces.__defaults__ = old
    assert parts == whole
