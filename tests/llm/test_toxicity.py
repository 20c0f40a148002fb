import math
import random
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from graphloom.llm import _vec as v
from graphloom.llm import toxicity as m

from .helpers import docs, empty, odd_rows, prose, words

BAD = "idiot moron scumbag loserly trashy".split()


def corpus(n=300):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        w = prose(r.randint(40, 120), i).split()
        toxic = i % 7 == 0
        if toxic:
            for b in r.sample(BAD, 3) * 2:
                w.insert(r.randrange(len(w)), b)
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if toxic else 0))
    return rows, labels


def hashes(ws):
    data, offs = v.buffers(pa.array(ws))
    return v.words(data, offs, 0, len(ws)).hash


def seeds_of(toxic, clean):
    rows = sorted([(h, x, 0.0) for h, x in zip(hashes(list(toxic)).tolist(), toxic.values())] + [(h, 0.0, x) for h, x in zip(hashes(list(clean)).tolist(), clean.values())])
    return m.Seeds(np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def brute_edges(rows, seeds, window):
    """{word: Counter of seeds}, {word: all co-occurrences}."""
    with_seed, every = defaultdict(Counter), Counter()
    for _, t in rows:
        w = words(t)
        for i, a in enumerate(w):
            for b in w[i + 1 : i + 1 + window]:
                if a != b:
                    every[a] += 1
                    every[b] += 1
                    for x, y in ((a, b), (b, a)):
                        if y in seeds:
                            with_seed[x][y] += 1
    return with_seed, every


def brute_polarity(rows, toxic, clean, window, restart=0.5, steps=8, evidence=7.0):
    """Word -> polarity, with the whole graph in memory, an edge between any two words, and one probability for every word."""
    seeds = [*toxic, *clean]
    _, every = brute_edges(rows, seeds, window)
    links, _ = brute_edges(rows, set(every), window)
    total = sum(every.values())
    weight = {}
    for a, c in links.items():
        for s, k in c.items():
            less = min(every[a], every[s])
            x = math.log(k * total / every[a] / every[s]) * k / (k + 1) * less / (less + 1)
            if x > 0:
                weight[a, s] = weight[s, a] = x
    out = defaultdict(float)
    for (a, _), x in weight.items():
        out[a] += x
    walks = []
    for side in (toxic, clean):
        home = {s: x / sum(side.values()) for s, x in side.items()}
        p = dict(home)
        for _ in range(steps):
            moved = defaultdict(float)
            for (a, b), x in weight.items():
                moved[b] += (1 - restart) * p.get(a, 0.0) * x / out[a]
            back = 1 - sum(moved.values())
            for s, x in home.items():
                moved[s] += back * x
            p = moved
        walks.append(p)
    whole = sum(out.values())
    share = lambda a: out[a] / whole
    polar = lambda a: math.log10((walks[0].get(a, 0) / share(a) + 1e-3) / (walks[1].get(a, 0) / share(a) + 1e-3)) * every[a] / (every[a] + evidence)
    return {a: polar(a) for a in out if out[a] > 0}


def test_edge_lists_equal_brute_force(spark):
    rows = [(i, prose(80, i)) for i in range(12)] + [(50, None), (51, "")]
    seeds = words(prose(80, 0))[:6]
    old, m._PAIRS = m._PAIRS, 50
    try:
        lists = m.edges(docs(spark, rows).repartition(3), m.Seeds(np.sort(hashes(seeds)), np.ones(len(set(seeds))), np.zeros(len(set(seeds)))), 3).collect()
    finally:
        m._PAIRS = old
    with_seed, every = brute_edges(rows, set(seeds), 3)
    number = {int(h): w for w, h in zip(every, hashes(list(every)))}
    order = [number[int(h)] for h in np.unique(hashes(seeds))]
    assert len(lists) == len(every)
    for r in lists:
        pairs = np.frombuffer(r.edges, dtype=np.uint16).reshape(-1, 2)
        got = {(order[s] if s != m._ALL else None): int(k) for s, k in pairs}
        w = number[int(np.int64(r.h).view(np.uint64))]
        assert got == {**with_seed[w], None: every[w]}


def test_large_counts_take_several_pairs():
    number, lists = m._lists_of(np.array([7, 7, 3]), np.array([2, 2, m._ALL]), np.array([70_000, 70_000, 5]))
    seed, n, row = m._entries(lists)
    assert number.tolist() == [3, 7] and n[row == 1].sum() == 140_000 and set(seed[row == 1].tolist()) == {2} and n[row == 0].tolist() == [5]


def test_polarities_equal_brute_force(spark):
    rows, _ = corpus(60)
    toxic, clean = {"idiot": 3.0, "moron": 2.0}, {w: 1.0 + i for i, w in enumerate(dict.fromkeys(words(rows[1][1])[:8]))}
    want = brute_polarity(rows, toxic, clean, 4)
    out = m.polarities(docs(spark, rows).repartition(3), seeds_of(toxic, clean)).collect()
    number = {int(h): w for w, h in zip(want, hashes(list(want)))}
    got = {number[int(np.int64(r.h).view(np.uint64))]: r.polarity for r in out}
    assert set(got) == set(want)
    assert all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_links_of_all_words_equal_brute_force(spark):
    rows = [(i, prose(80, i)) for i in range(12)] + [(50, None), (51, ""), (52, "alone"), (53, "same same")]
    _, every = brute_edges(rows, set(), 3)
    want, _ = brute_edges(rows, set(every), 3)
    name = dict(zip(hashes(list(every)).tolist(), every))
    old, m._PAIRS = m._PAIRS, 50
    try:
        for head in (0, 20, 1000):
            g = m.graph(docs(spark, rows).repartition(3), 3, head=head)
            word = [name[h] for h in g.hashes.tolist()]
            assert sorted(word) == sorted(every) and [every[w] for w in word] == g.degree.tolist() == sorted(every.values(), reverse=True)
            got = {}
            for r in g.links.collect():
                key, n = m._unpacked(r.m, r.keys, r.counts)
                for k, c in zip(key.tolist(), n.tolist()):
                    assert (k >> 32) % g.parts == r.part and (k >> 32, k & 0xFFFFFFFF) not in got
                    got[k >> 32, k & 0xFFFFFFFF] = c
            pairs = {(a, b) for a in range(len(word)) for b in range(len(word)) if want[word[a]][word[b]]}
            assert set(got) == {(a, b) for a, b in pairs if a > b or b >= head and a >= head}
            assert all(c == want[word[a]][word[b]] for (a, b), c in got.items())
    finally:
        m._PAIRS = old


def test_links_are_made_in_bounded_memory():
    r = np.random.default_rng(2)
    # words of a few frequent and many rare ones, as in prose
    texts = [" ".join(f"w{k}" for k in (200_000 * r.random(1000) ** 6).astype(int)) for _ in range(600)]
    data, offs = v.buffers(pa.array(texts))
    h, n = np.unique(v.words(data, offs, 0, len(texts)).hash, return_counts=True)
    number = np.empty(len(h), dtype=np.int64)
    number[np.argsort(-n, kind="stable")] = np.arange(len(h))
    sent = SimpleNamespace(value=m._numbering(h, number))
    old, m.PASSES = m.PASSES, 1
    tracemalloc.start()
    try:
        made = list(m._pairs(sent, 4, 3, 1000, 0)(pa.record_batch([pa.array(texts)], ["t"]).slice(k, 50) for k in range(0, 600, 50)))
        merged = [row for b in made for row in b.to_pylist()]
        at_most = tracemalloc.get_traced_memory()[1]
    finally:
        m.PASSES = old
        tracemalloc.stop()
    pairs = sum(row["m"] for row in merged)
    assert pairs > 800_000
    assert at_most < 65 * pairs


def test_sums_of_links_do_not_depend_on_the_room_for_counts():
    r = np.random.default_rng(3)
    key, n = r.integers(0, 50, 2000) << 32 | r.integers(0, 60, 2000), r.integers(1, 40, 2000)
    n[:3] = 100_000
    want = Counter()
    for k, c in zip(key.tolist(), n.tolist()):
        want[k] += c
    for bits in (1, 3, 26):
        got, count = m._summed(m._tagged(key, n, bits), bits)
        assert got.tolist() == sorted(want) and count.tolist() == [want[k] for k in sorted(want)]
    _, m_links, keys, counts = m._packed(0, got, count)
    assert [x.tolist() for x in m._unpacked(m_links, keys, counts)] == [got.tolist(), count.tolist()]
    hashes_ = np.sort(r.integers(0, 2**64, 500, dtype=np.uint64))
    order = r.permutation(500)
    assert [x.tolist() for x in m._numbered(*m._numbering(hashes_, order))] == [hashes_.tolist(), order.tolist()]


def test_a_word_that_meets_no_seed_has_a_polarity(spark):
    rows = [(i, f"bad mild{i % 3} x{i % 5}") for i in range(20)] + [(50 + i, f"good well{i % 3} y{i % 5}") for i in range(20)] + [(100 + i, f"mild{i % 3} far") for i in range(6)]
    want = brute_polarity(rows, {"bad": 20.0}, {"good": 20.0}, 1)
    out = {r.h: r.polarity for r in m.polarities(docs(spark, rows), seeds_of({"bad": 20.0}, {"good": 20.0}), 1).collect()}
    far = out[int(hashes(["far"]).view(np.int64)[0])]
    assert far > 0.5 and abs(far - want["far"]) < 1e-9


def test_seeds_equal_brute_force(spark):
    rows, labels = corpus(120)
    d = docs(spark, rows)
    got = m.choose_seeds(m.sample_labelled(d, spark.createDataFrame(labels, "doc_id long, toxic int")), 1.0, 4, 6)
    t, c = sum(x for _, x in labels), sum(1 - x for _, x in labels)
    a, b = Counter(), Counter()
    for (_, text), (_, y) in zip(rows, labels):
        (a if y else b).update(set(words(text)))
    z = {}
    for w in a | b:
        p, q = a[w], b[w]
        odds = math.log((p + 0.5) / (t - p + 0.5)) - math.log((q + 0.5) / (c - q + 0.5))
        z[w] = odds / math.sqrt(1 / (p + 0.5) + 1 / (t - p + 0.5) + 1 / (q + 0.5) + 1 / (c - q + 0.5))
    signed = dict(zip(z, hashes(list(z)).view(np.int64).tolist()))
    bad = sorted((w for w in z if z[w] >= 1.0), key=lambda w: (-z[w], signed[w]))[:4]
    good = sorted((w for w in z if z[w] <= 0 and b[w]), key=lambda w: (-b[w], signed[w]))[:6]
    want = seeds_of({w: float(a[w]) for w in bad}, {w: float(b[w]) for w in good})
    assert (got.hashes == want.hashes).all() and (got.toxic == want.toxic).all() and (got.clean == want.clean).all()


def test_copies_of_one_document_give_no_seeds(spark):
    rows, labels = corpus()
    r = random.Random(8)
    odd = [f"odd{i}" for i in range(60)]
    for i in range(60):
        w = list(odd)
        w[r.randrange(50, 60)] += "x" * (i % 3)
        rows.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, 1))
    rows += [(2000, ""), (2001, " .. ")]
    labels += [(2000, 0), (2001, 1)]
    sample = m.sample_labelled(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(hashes(odd).tolist()) & set(m.choose_seeds(sample, toxic_seeds=5).hashes.tolist())
    kept = m.apart(sample)
    texts = [x.t for x in kept.collect()]
    assert len(texts) == len(set(texts)) and 300 <= len(texts) < 320
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, m.apart(sample.repartition(5)).collect()))
    seeds = m.choose_seeds(kept, toxic_seeds=5)
    assert set(seeds.hashes[seeds.toxic > 0].tolist()) == set(hashes(BAD).tolist())


def test_best_cut_equals_trying_all():
    r = np.random.default_rng(1)
    for _ in range(30):
        label, scores = r.integers(0, 2, 25), np.round(r.random((25, 3)), 1)
        k, cut = m.best_cut(label, scores)
        f1 = lambda k, c: 2 * ((scores[:, k] >= c) & (label == 1)).sum() / ((scores[:, k] >= c).sum() + label.sum())
        if label.any():
            assert abs(f1(k, cut) - max(f1(j, c) for j in range(3) for c in scores[:, j] if c > 0)) < 1e-12
    assert m.best_cut(np.zeros(0, dtype=int), np.zeros((0, 2))) == (-1, np.inf)


def test_held_out_documents_and_a_lexicon_that_is_joined(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id long, toxic int")
    d = docs(spark, [*rows, *rows[:3]])
    lexicon = m.induce(d, lab)
    weight = {int(np.int64(r.h).view(np.uint64)): r.weight for r in lexicon.words.collect()}
    first = sorted(weight, key=weight.get)[-len(BAD) :]
    assert set(first) == {int(h) for h in hashes(BAD)}
    out = m.score(d, lexicon).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, m.score(d, lexicon, held=0).collect()))
    toxic = {r.doc_id: r.toxic for r in out}
    for r in out[:20]:
        w = words(dict(rows)[r.doc_id])
        assert abs(r.score - sum(weight.get(int(h), 0.0) for h in hashes(w)) / (len(w) + m.SMOOTH)) < 1e-6
    held = [x for x in labels if x[0] % 2 == 1]
    assert all(not toxic[i] for i, t in held if not t)
    assert sum(toxic[i] for i, t in labels if t) >= 0.95 * sum(t for _, t in labels)


def test_edge_cases(spark):
    rows, labels = corpus(120)
    lab = spark.createDataFrame([(*x, 1, "x") for x in [*labels, (None, 1), (5000, 1), (3, None)]], "doc_id long, toxic int, label int, t string")
    d = docs(spark, [*rows, *((1000 + i if i else None, t) for i, t in odd_rows())])
    out = m.toxicity(d, lab).collect()
    assert len(out) == d.count()
    assert all(r.score == 0 and not r.toxic for r in out if r.doc_id in (1001, 1002, 1003))
    assert m.toxicity(empty(spark), lab).count() == 0
    assert not any(r.toxic for r in m.toxicity(docs(spark, rows), lab.limit(0)).collect())
    assert not any(r.toxic for r in m.toxicity(docs(spark, rows), lab.where("toxic = 0")).collect())
