import math
from collections import Counter

import pytest

from graphloom.llm import lm_scoring as m

from .helpers import docs, empty, odd_rows, prose


def brute(texts, order, discount):
    seen = [Counter() for _ in range(order + 1)]
    context = [Counter() for _ in range(order + 1)]
    padded = [bytes(order - 1) + t.encode() for t in texts]
    for b in padded:
        for i in range(order - 1, len(b)):
            for k in range(1, order + 1):
                seen[k][b[i - k + 1 : i + 1]] += 1
                context[k][b[i - k + 1 : i]] += 1
    kinds = [Counter(g[:-1] for g in seen[k]) for k in range(order + 1)]

    def p(h, c, k):
        if not k:
            return 1 / 256
        n = context[k][h]
        if not n:
            return p(h[1:], c, k - 1)
        return max(seen[k][h + c] - discount, 0) / n + discount * kinds[k][h] / n * p(h[1:], c, k - 1)

    return lambda t: sum(math.log(p(b[i - order + 1 : i], b[i : i + 1], order)) for b in [bytes(order - 1) + t.encode()] for i in range(order - 1, len(b)))


@pytest.mark.parametrize("order", [2, 3, 5])
def test_scores_equal_the_formula(spark, order):
    texts = ["hello world", "hello there, world", "aaaa aaab", "ñandú" * 300, prose(700, 1), ""]
    want = brute(texts, order, 0.75)
    model = m.train(docs(spark, list(enumerate(texts))), order)
    new = [*texts, "unseen QZ \x7f", "ñ"]
    for r in m.score(docs(spark, list(enumerate(new))), model).collect():
        assert r.log_prob == pytest.approx(want(new[r.doc_id]), rel=1e-9)
        assert r.n_bytes == len(new[r.doc_id].encode())


def test_probabilities_sum_to_one(spark):
    import numpy as np

    for keep in (1e-9, 0.02):
        model = m.train(docs(spark, [(1, prose(300, 2)), (2, "aab aac")]), 3, keep=keep)
        for state in range(0, len(model.fail), max(1, len(model.fail) // 40)):
            logp, _ = model.step(np.full(256, state), np.arange(256))
            assert np.exp(logp).sum() == pytest.approx(1, abs=1e-9)


def test_edge_cases(spark):
    out = m.lm_scores(docs(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    by = {r.doc_id: r for r in out}
    assert by[1].log_prob == by[2].log_prob == 0 and by[1].bits_per_byte is None
    assert m.lm_scores(empty(spark)).count() == 0
    nothing = m.train(empty(spark), 3)
    r = m.score(docs(spark, [(1, "abcd")]), nothing).first()
    assert r.log_prob == pytest.approx(-4 * math.log(256))


def test_rare_ngrams_of_a_large_corpus_stay(spark):
    from pyspark.sql import functions as F

    common = spark.range(12).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefghij"), 100_000).alias("text"))
    rare = docs(spark, [(20, "zqxjk")])
    model = m.train(common.unionByName(rare.select("doc_id", "text")))
    # each byte after the first has its own arc, of (1 - 0.75) / 1 at least
    assert m.score(rare, model).first().log_prob > math.log(0.25 / 13) + 4 * math.log(0.25)
