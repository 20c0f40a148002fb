import itertools
import random

import regex
import zstandard

from graphloom.llm import langid as m

from .helpers import docs, empty, odd_rows

SYLLABLES = {"en": "th er on and ing ion ed the he in wh sh ou".split(), "de": "sch ei ch der ung keit ge ver lich ein ü ä".split(), "fr": "eau eux que ment ai ou é è ré tion elle oi".split()}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def labelled(spark, n=60):
    rows = [(i * 3 + k, text(lang, 40 + i, i), lang) for i in range(n) for k, lang in enumerate(SYLLABLES)]
    return spark.createDataFrame([*rows, (9999, None, "en"), (9998, "", "en"), (9997, "some words", None)], "doc_id long, text string, lang string")


def test_held_out_accuracy_and_rejection(spark):
    d = m.train(labelled(spark), dict_bytes=8192)
    assert set(d) == set(SYLLABLES) and all(len(x) <= 8192 + 200 for x in d.values())
    rows = [(i, text(lang, n, 5000 + i), lang) for i, (lang, n) in enumerate((lang, n) for lang in SYLLABLES for n in (15, 60, 400, 4000) for _ in range(5))]
    out = {r.doc_id: r for r in m.identify(docs(spark, [x[:2] for x in rows]), d).collect()}
    right = sum(out[i].language == lang and not out[i].rejected for i, _, lang in rows)
    assert right >= 0.95 * len(rows)
    assert m.identify(docs(spark, [(1, "zz qq xx zz qq xx")]), d).first().rejected


def test_training_does_not_depend_on_order(spark):
    rows = labelled(spark, 20)
    assert m.train(rows.repartition(3)) == m.train(rows.orderBy("doc_id", ascending=False))


def test_edge_cases(spark):
    d = m.train(labelled(spark, 20), dict_bytes=4096)
    rows = [*odd_rows(), (8, "12345 67")]
    out = m.identify(docs(spark, rows), d).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in (1, 2, 3, 8):
        assert by[i].rejected and by[i].language is None
    kept = m.keep_identified(docs(spark, rows), d)
    assert kept.columns == docs(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if not r.rejected)
    assert m.identify(empty(spark), d).count() == 0 and m.keep_identified(empty(spark), d).count() == 0
    assert m.train(labelled(spark).limit(0)) == {}
    assert all(r.rejected and r.language is None for r in m.identify(docs(spark, rows), {}).collect())


def test_matches_brute_force(spark):
    """Sizes, margin and rejection text by text, each piece with a compressor of its own."""
    d = m.train(labelled(spark, 20), dict_bytes=4096)
    rows = [*odd_rows(), *((20 + i, text(lang, n, i) + " 12, é!") for i, (lang, n) in enumerate(itertools.product(SYLLABLES, (1, 3, 10, 50, 9000)))), (90, "x" * 30_000)]
    setting = dict(window_log=17, chain_log=16, hash_log=16, search_log=m.SEARCH, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(raw, lang):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters(**setting))
        return len(c.compress(raw))

    want = []
    for i, t in rows:
        raw = regex.sub(r"[^\p{L}\p{M}]+", " ", t or "").lower().strip(" ").encode()
        if not raw:
            want.append((i, None, True))
            continue
        total = {lang: sum(size(raw[a : a + m.PIECE], lang) - size(b"", lang) for a in range(0, len(raw), m.PIECE)) for lang in d}
        best = min(sorted(total), key=total.get)
        second = sorted(total.values())[1]
        want.append((i, best, (second - total[best]) / second < m.MARGIN))
    got = [(r.doc_id, r.language, r.rejected) for r in m.identify(docs(spark, rows), d).collect()]
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_long_sample_text_gives_pieces_from_all_over(spark):
    rows = spark.createDataFrame([(1, text("en", 3000, 1) + " " + text("de", 3000, 1), "x")], "doc_id long, text string, lang string")
    d = m.train(rows, dict_bytes=4096)["x"].decode()
    assert len(d) > 3500 and "keit" in d and "ing" in d
