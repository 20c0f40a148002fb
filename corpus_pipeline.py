"""A corpus from raw documents to tokens, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; it is written
and read again before the next.  All but the last return the columns of
``documents``, whatever others there are beside doc_id, text, lang and n_chars
and however they are called.  Texts have any length and are taken whole; an
empty table stays empty.  The written result of the last stage is the caller's
to remove.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, langid, minhash, pseudonyms
from graphloom.llm._rows import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is uncertain.

    A null, empty or letterless text goes, as does one whose two best languages
    tie.  Rows without a language label or an id are judged like others; repeated
    rows are each judged.  Without any label no language is known and all go.
    """
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the least id.

    Of a repeated id the row with the least text hash stays, of rows equal in
    both the one whose other columns, written as JSON, come first.  A null id
    comes last in its group.  Texts without a word are no one's duplicates and stay.
    """
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Rows equal in id and text share their fate; null ids and null or empty texts
    stay.  Null, empty and repeated items, and an empty benchmark, add nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms; n_chars follows the text.

    Every row stays.  A null text stays null, with a null n_chars; repeated rows
    and equal values get equal pseudonyms.  The key is the session's.
    """
    return pseudonyms.replace(docs, pseudonyms.key_of(spark)).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens) of each row.

    A null text has null tokens and a null count, an empty one an empty list;
    repeated rows and null ids stay.
    """
    return bpe.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Compression, signatures and merges cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder as Parquet and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Removes what a later stage has replaced."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
