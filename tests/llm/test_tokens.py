import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, token_counts, vocabulary

from .helpers import docs, empty, odd_rows

PIECES = ["hello", "don't", "we're", "'", "'r", "e", " ", "  ", "\n", "\n\n", "foo", "123", "٣", "é", "日本語", "!!", "\t", "a" * 40, "ab" * 30, " x", "'ll", "'l", "l", "½", "\x1c", "\xa0"]


def reference():
    return vocabulary.encoding(vocabulary.RANKS).encode_ordinary


def random_text(r, n=40):
    return "".join(r.choice(PIECES) for _ in range(r.randint(0, n)))


def test_counts_equal_the_encoder():
    r = random.Random(1)
    split, known = token_counts.splitter(vocabulary.PATTERN), token_counts.Counter(vocabulary.RANKS)
    for _ in range(1500):
        t = random_text(r)
        assert sum(known[w] for w in split(t)) == len(reference()(t))
    long = "".join(r.choice("abcdeo") for _ in range(5000))
    assert known[long] == len(reference()(long)) and long not in dict(known)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9))
def test_joined_leaves_equal_the_whole(text, leaves):
    c = bpe.codec(vocabulary.RANKS, vocabulary.PATTERN, 8)
    size = max(1, len(text) // leaves)
    parts = [text[i : i + size] for i in range(0, len(text), size)]
    want = reference()(text)
    assert c.join_all([c.encode(p) for p in parts]) == want
    assert c.encode(text) == want and c.decode(want).decode() == text


@pytest.mark.parametrize("alphabet", ["ab", "abcdeo", "a", "日本é"])
def test_tree_equals_the_encoder(alphabet):
    r = random.Random(2)
    c = bpe.codec(vocabulary.RANKS, vocabulary.PATTERN, 16)
    text = "".join(r.choice(alphabet) for _ in range(3000))
    assert c.tree(text.encode()) == vocabulary.encoding(vocabulary.RANKS)._core_bpe.encode_single_piece(text.encode())


def test_leaves_over_rows_and_edge_cases(spark):
    r = random.Random(3)
    rows = [*odd_rows(), *((100 + i, random_text(r, 300)) for i in range(20)), (200, "ab" * 5000), (200, "ab" * 5000)]
    d = docs(spark, rows)
    want = sorted((str(i), None if t is None else reference()(t)) for i, t in rows if t is not None)
    for leaf in (97, 1 << 16):
        out = bpe.encode(d, leaf=leaf)
        assert sorted((str(x.doc_id), x.tokens) for x in out.collect() if x.tokens is not None) == want
        assert out.where("tokens is null").count() == 1
        assert sorted(str(tuple(x)) for x in bpe.decode(out).collect()) == sorted(str(x) for x in rows)
    checked = bpe.round_trip(d, leaf=97)
    assert checked.where("restored").count() == len(rows) and checked.where("tokens is null and n_tokens = -1").count() == 1
    counts = token_counts.count_tokens(d)
    assert sorted((str(x.doc_id), x.n_tokens) for x in counts.collect() if x.n_tokens is not None) == sorted((i, len(t)) for i, t in want)
    assert counts.where("n_tokens is null").count() == 1
    for f in (bpe.encoded, bpe.round_trip, token_counts.count_tokens):
        assert f(empty(spark)).count() == 0


class Counting:
    """The compiled encoder, with the bytes that it was given."""

    def __init__(self, core):
        self.core, self.bytes = core, 0

    def encode_single_piece(self, raw):
        self.bytes += len(raw)
        return self.core.encode_single_piece(raw)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ab1,.", "日本é語"])
def test_joins_of_unsplit_text_encode_windows_only(alphabet):
    r = random.Random(5)
    text = "".join(r.choice(alphabet) for _ in range(2_000_000 // len(alphabet[-1].encode())))
    c = bpe.Codec()
    parts = [c.encode(text[i : i + bpe.LEAF]) for i in range(0, len(text), bpe.LEAF)]
    c.core = Counting(c.core)
    out = c.join_all(parts)
    assert c.core.bytes < len(text.encode()) / 100
    assert c.decode(out).decode() == text
    assert out == c.tree(text.encode()) if alphabet.isalpha() else out == reference()(text)


def test_a_text_of_many_groups_of_leaves(spark):
    r = random.Random(6)
    text = "".join(r.choice(PIECES) for _ in range(3_000))
    assert len(text) > 3 * bpe.FAN * 97
    out = bpe.encode(docs(spark, [(1, text), (2, "x" * 5_000), (3, " " * 5_000 + "y")]), leaf=97).collect()
    assert {x.doc_id: x.tokens for x in out} == {i: reference()(t) for i, t in ((1, text), (2, "x" * 5_000), (3, " " * 5_000 + "y"))}
