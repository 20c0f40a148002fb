"""Language identification by compression.

Each language has a Zstandard dictionary of raw text.  A text is compressed
with every dictionary; the language whose dictionary gives the fewest bytes
wins.  Long texts are compressed in pieces, so that the dictionary, not the
text's own start, is what every piece is compared with.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vec as v
from ._rows import ID

#: Bytes of sample text in each language's dictionary, and the most documents they are taken from.
DICT_BYTES = 64 << 10
SAMPLE_DOCS = 200
#: Pieces that a long sample text gives, evenly spread over it.
SPREAD = 16
#: Bytes of a piece.
PIECE = 4 << 10
#: Log2 of the tries per match.
SEARCH = 3
#: Least lead over the second language, as a share of the second's size.
MARGIN = 0.02

_NOISE = r"[^\p{L}\p{M}]+"


def _clean(text):
    """Words with single blanks: digits, marks and spacing belong to no language."""
    return F.lower(F.regexp_replace(text.cast("string"), _NOISE, " "))


def train(labelled: DataFrame, dict_bytes: int = DICT_BYTES, sample_docs: int = SAMPLE_DOCS, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary, from at most ``sample_docs`` labelled documents a language.

    The sample is the documents of least text hash, so it does not depend on
    order or partitioning; each gives at most an equal share of the dictionary,
    of which what others leave unused goes to longer ones.  A longer text gives
    pieces from all over it.  Extra columns are ignored.  Rows with a null or
    empty text or a null language are ignored; equal texts count once a language.
    """
    rows = labelled.select(labelled[lang_col].cast("string").alias("l"), _clean(labelled[text_col]).alias("t")).where("l is not null and length(trim(t)) > 0").withColumn("h", F.xxhash64("t"))
    # ranks come before texts are shuffled: each task passes on its first rows only
    first = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= sample_docs)
    spread = F.concat(*(F.substring("t", (F.length("t") * (i / SPREAD)).cast("int") + 1, F.lit(dict_bytes // SPREAD)) for i in range(SPREAD)))
    sample = first.groupBy("l", "r").agg(F.first(F.when(F.length("t") <= dict_bytes, F.col("t")).otherwise(spread)).alias("t")).orderBy("l", "r").collect()
    by: dict[str, list[bytes]] = {}
    for lang, _, text in sample:
        by.setdefault(lang, []).append(text.encode())
    out = {}
    for lang, texts in by.items():
        share, left, parts = 0, dict_bytes, sorted(texts, key=len)
        taken = []
        for i, t in enumerate(parts):
            share = left // (len(parts) - i)
            size = max(1, share // SPREAD)
            some = t if len(t) <= share else b"".join(t[len(t) * j // SPREAD :][:size] for j in range(SPREAD))
            taken.append(some.decode(errors="ignore").encode())
            left -= len(taken[-1])
        out[lang] = b"\n".join(taken)
    return out


def _classify(dictionaries: dict[str, bytes], margin: float, piece: int, search: int):
    langs = sorted(dictionaries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # made per task: compressors cannot be shipped
        # short matches tell related languages apart, so three bytes are a match
        setting = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=search, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_checksum=False, write_content_size=False, write_dict_id=False)
        with_dict = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=setting)
            with_dict.append(zstandard.ZstdCompressor(dict_data=d, compression_params=setting))
        empty = len(with_dict[0].compress(b"")) if langs else 0
        for batch in batches:
            data, offs = v.buffers(batch.column(1))
            raw = memoryview(data)
            sizes = np.zeros((len(offs) - 1, max(1, len(langs))))
            for i in range(len(offs) - 1):
                for a in range(int(offs[i]), int(offs[i + 1]), piece):
                    part = raw[a : min(a + piece, int(offs[i + 1]))]
                    for k, c in enumerate(with_dict):
                        sizes[i, k] += len(c.compress(part)) - empty
            best = sizes.argmin(axis=1)
            low = sizes.min(axis=1)
            second = np.sort(sizes, axis=1)[:, 1] if len(langs) > 1 else low
            lead = np.where(second > 0, (second - low) / np.maximum(second, 1), 0.0)
            known = (np.diff(offs) > 0) & bool(langs)
            sure = known & ((lead >= margin) | (len(langs) == 1))
            names = pa.array([langs[b] if k else None for b, k in zip(best, known)], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(np.round(lead, 6)), pa.array(~sure)], [ID, "language", "margin", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, piece: int = PIECE, search: int = SEARCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, margin, rejected) of every row, in one pass without a shuffle.

    ``margin`` is (second - best) / second over compressed sizes; below the
    limit the document is rejected, though its best language is still named.
    Ties go to the language first in order, with margin 0, and are rejected.  A
    text without a letter (null, empty, digits) has no language and is
    rejected; so is every text when there is no dictionary.  With one
    dictionary nothing with letters is rejected.  Texts have any length and are
    compressed whole.  Repeated rows each give a row, null ids stay, extra
    columns are ignored whatever their names, no rows give no rows.
    """
    text = F.trim(_clean(docs[text_col]))
    source = docs.select(docs[id_col].alias(ID), F.when(F.length(text) > 0, text).alias("t"))
    kind = source.schema[ID].dataType.simpleString()
    return source.mapInArrow(_classify(dictionaries, margin, piece, search), f"{ID} {kind}, language string, margin double, rejected boolean").withColumnRenamed(ID, "doc_id")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, piece: int = PIECE, search: int = SEARCH, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected; edge cases as in :func:`identify`."""
    run = _classify(dictionaries, margin, piece, search)

    @F.pandas_udf("boolean")
    def sure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            batch = pa.RecordBatch.from_arrays([pa.nulls(len(t), pa.int8()), pa.array(t, type=pa.string(), from_pandas=True)], ["i", "t"])
            yield ~next(run([batch])).column(3).to_pandas()

    return docs.where(sure(F.trim(_clean(docs[text_col]))))
