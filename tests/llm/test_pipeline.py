import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from graphloom.llm import queries, vocabulary

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert i == len(pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] <= before and counts[1] < counts[0] and counts[2] < counts[1] and counts[2] == counts[3] == counts[4]
    clean = spark.read.parquet(str(tmp_path / "personal_data"))
    want = vocabulary.encoding(vocabulary.RANKS).encode_ordinary
    tokens = {r.doc_id: r.tokens for r in docs.collect()}
    for r in clean.collect():
        assert tokens[r.doc_id] == want(r.text) and r.n_chars == len(r.text)
    assert sorted(tokens.items()) == sorted((r.doc_id, r.tokens) for r in pipeline.run(spark, SMALL).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 0), (None, "", None, None, None)]])
def test_odd_tables(spark, tmp_path, rows):
    for name in ("benchmark",):
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


CLASH = ("language", "score", "gone", "n", "h", "band", "item_id", "tokens", "kept", "key", "i", "t")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def odd(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, *(f"{c}{n}" for c in CLASH)) for n, (i, t, lang) in enumerate(rows)], DOCS)


def outcome(spark, name, rows, sf_dir):
    docs = odd(spark, rows)
    out = dict(pipeline.STAGES)[name](spark, docs, sf_dir)
    assert name == "tokens" or out.columns == docs.columns
    return out.collect()


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bench"))
    items = [(1, "What is the colour of the tall house behind the old mill by the river?"), (1, "What is the colour of the tall house behind the old mill by the river?"), (2, None), (None, ""), (3, None)]
    spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, h string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


LONG = " ".join(f"{w} river {w[::-1]} stone" for w in (f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(15_000)))
ODD = [(1, None, "en"), (2, "", "en"), (3, " .. ", None), (None, "a small text that has no id but some words of its own", None), (4, "twice the very same row is in here", "en"), (4, "twice the very same row is in here", "en"), (4, "quite another text with an id that occurs above", "en"), (5, LONG, "en")]


def test_language_of_odd_rows(spark, bench):
    english, german = "the house and the river are where they have been for all these years ", "das Haus und der Fluss sind noch immer dort wo sie seit Jahren waren "
    rows = [(10 + i, english * 3 + str(i), "en") for i in range(3)] + [(20 + i, german * 3 + str(i), "de") for i in range(3)] + [(1, None, "en"), (2, "", "de"), (3, "12 ..", "en"), (None, english * 2, None), (30, german * 2, None), (30, german * 2, None), (40, english * 40_000, "en")]
    assert sorted((r.doc_id or 0) for r in outcome(spark, "language", rows, bench)) == [0, 10, 11, 12, 20, 21, 22, 30, 30, 40]
    assert outcome(spark, "language", ODD[:0], bench) == []
    assert outcome(spark, "language", [(1, english, None)], bench) == []


def test_near_duplicates_of_odd_rows(spark, bench):
    near = LONG + " and one word more"
    got = outcome(spark, "near_duplicates", [*ODD, (6, near, "en"), (0, None, None)], bench)
    assert sorted(((r.doc_id, len(r.text or "")) for r in got), key=str) == sorted([(0, 0), (1, 0), (2, 0), (3, 4), (None, len(ODD[3][1])), (4, len(ODD[4][1])), (4, len(ODD[6][1])), (5, len(LONG))], key=str)
    assert next(r.score for r in got if r.text == ODD[4][1]) == "score4", "of equal rows the one whose other columns come first"
    assert outcome(spark, "near_duplicates", [], bench) == []


def test_decontamination_of_odd_rows(spark, bench, tmp_path):
    item = "What is the colour of the tall house behind the old mill by the river?"
    rows = [*ODD, (7, item, "en"), (7, item, "en"), (None, f"so {item} yes", None), (7, "clean text under an id that also has the item in it", "en"), (8, f"{LONG} {item} {LONG}", "en")]
    assert len(outcome(spark, "decontamination", rows, bench)) == len(ODD) + 1
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(outcome(spark, "decontamination", rows, str(tmp_path))) == len(rows)
    assert outcome(spark, "decontamination", [], bench) == []


def test_personal_data_and_tokens_of_odd_rows(spark, bench):
    rows = [*ODD, (9, "write to ann.lee@example.org", "en"), (9, "write to ann.lee@example.org", "en"), (10, f"{LONG} ann.lee@example.org", "en")]
    got = outcome(spark, "personal_data", rows, bench)
    assert len(got) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    mails = [re.search(r"\S+@example.org", r.text).group() for r in got if r.doc_id in (9, 10)]
    assert len(set(mails)) == 1 and mails[0] != "ann.lee@example.org" and {r.text for r in got if r.doc_id not in (9, 10)} == {t for _, t, _ in ODD}
    want = vocabulary.encoding(vocabulary.RANKS).encode_ordinary
    tokens = outcome(spark, "tokens", rows, bench)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or [])
    assert sorted(((r.doc_id, r.tokens) for r in tokens), key=key) == sorted(((i, None if t is None else want(t)) for i, t, _ in rows), key=key)
    assert all(r.n_tokens == (None if r.tokens is None else len(r.tokens)) for r in tokens)


def test_every_operator_has_its_query():
    assert [q for n in range(1, 11) for q in queries.queries() if q.startswith(f"op{n}_")] == list(queries.queries())


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for path in glob.glob(f"{root}/graphloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"import.*\bllm\b|\bllm\b.*import", open(path).read()), path
