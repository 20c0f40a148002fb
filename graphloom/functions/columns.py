"""Scalar functions over columns: paths, predicates, vectors, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def cluster_key(file: Column) -> Column:
    """The cluster of a file: its first two parts below ``src``; a single part loses ``.rs``."""
    parts = F.split(F.regexp_replace(file, r"^src(/|$)", ""), "/")
    alone = F.when(file == "src", "root").otherwise(F.regexp_replace(parts[0], r"(\.rs)+$", ""))
    return F.when(F.size(parts) == 1, alone).otherwise(F.concat_ws("/", F.slice(parts, 1, 2)))


def module_path(file: Column) -> Column:
    """The folder of a file; a file directly in ``src`` or at the top stands for itself."""
    folder = F.regexp_extract(file, r"^(.*)/[^/]*$", 1)
    return F.when(folder.isin("", "src", "."), file).otherwise(folder)


def is_test_like(name: Column, file: Column) -> Column:
    """Whether a node looks like a test by its file or name."""
    return F.coalesce(F.contains(file, F.lit("test")), F.lit(False)) | name.startswith("test_") | name.endswith("_test")


def is_container(kind: Column) -> Column:
    return kind.isin(*schema.CONTAINERS)


def is_readable(kind: Column) -> Column:
    return kind.isin(*schema.READABLE)


def terms(query: str) -> list[str]:
    """Search terms: runs of ASCII letters, digits and underscores of the lower-case query."""
    import re

    return [t for t in re.split(r"[^a-z0-9_]+", query.lower()) if t]


def hits(haystack: Column, words: list[str], points: int) -> Column:
    """Points for every term that the text contains."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.contains(haystack, F.lit(w)), points).otherwise(0)
    return total


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "name", "qualified_name", F.coalesce("file", F.lit("")), F.coalesce("docs", F.lit(""))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays over their common length; 0 if either has no length."""

    def plus(s: Column, x: Column) -> Column:
        return s + x

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), plus)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), plus))
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot / size)


def compact(text: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def node_key(kind: Column, qualified_name: Column) -> Column:
    """The id of a node before it is made unique."""
    return F.concat(kind, F.lit(":"), F.translate(qualified_name, " \n\t", "___"))


def plain_id(id_: Column) -> Column:
    """An id of letters, digits and underscores."""
    return F.regexp_replace(id_, "[^0-9A-Za-z]", "_")


def dot_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
