"""Row identity and checkpoints: what the operators share on Spark's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import saved, shared_folder

__all__ = ["ID", "KEY", "TEXT", "keyed", "same", "saved", "shared_folder"]

#: Names for internal columns; they are dropped before a result is returned.
ID, KEY, TEXT = "__gl_id", "__gl_key", "__gl_text"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash of the text, text): two rows are the same document iff their id and text are equal."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias(ID), F.xxhash64(text).alias(KEY), text.alias(TEXT))


def same(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on row identity; a null id equals a null id."""
    return a[ID].eqNullSafe(b[ID]) & (a[KEY] == b[KEY])
