"""Fixtures of the operators for training data."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, sketch string, key string, tokens string"


def docs(spark, rows):
    """Documents with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA)


def empty(spark):
    return docs(spark, [])


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def prose(n, seed, size=400):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ba be bi bo bu ca ce co du fa ga la ma na ra sa ta".split() for b in "n r s t l ndo rto mpa lki".split()][:size]
    return " ".join(r.choice(vocabulary) for _ in range(n))


#: Nulls, empty and wordless texts, a null id, repeated rows, a repeated id, one very long text.
def odd_rows():
    long = prose(30_000, 5)
    return [(1, None), (2, ""), (3, " .. "), (None, "a text without an id, of some words"), (4, "twice the same row is here"), (4, "twice the same row is here"), (4, "the same id with another text"), (5, long), (6, "word")]
