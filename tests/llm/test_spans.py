import random

from graphloom.llm import spans as s

from .helpers import docs, empty, odd_rows, prose, words


def sentences(text):
    """[(words, first, end)] with white space kept by the sentence before."""
    out, start = [], 0
    for i, c in enumerate(text):
        if c == "\n" or (c in ".!?" and text[i + 1 : i + 2].isspace()):
            out.append((start, i + 1))
            start = i + 1
    out.append((start, len(text)))
    return [(words(text[a:z]), a, z) for a, z in out if words(text[a:z])]


def brute(rows, run, least):
    seen, out = set(), []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        parts, hit = sentences(t), set()
        spans = []
        for k in range(len(parts)):
            if len(parts[k][0]) >= least and run > 1:
                spans.append((k, k + 1))
            for e in range(k + run, len(parts) + 1):
                if sum(len(p[0]) for p in parts[k:e]) >= least:
                    spans.append((k, e))
                    break
        for k in reversed(range(len(parts) - run + 1)):
            if sum(len(p[0]) for p in parts[k:]) >= least:
                spans.append((k, len(parts)))
                break
        for k, e in sorted(set(spans)):
            w = tuple(x for p in parts[k:e] for x in p[0])
            if w in seen:
                hit |= set(range(k, e))
            seen.add(w)
        text, at = "", 0
        for k in sorted(hit):
            text += t[at : parts[k][1]]
            at = parts[k][2]
        out.append((i, text + t[at:], len(hit)))
    return out


def test_matches_brute_force(spark):
    r = random.Random(4)
    pool = [prose(r.randint(1, 12), i).capitalize() + r.choice([". ", "! ", ".\n", "?\n\n"]) for i in range(60)]
    rows = [(i, "".join(r.choice(pool) for _ in range(r.randint(0, 25)))) for i in range(40)]
    shared = "".join(pool[:8])
    rows += [(50 + i, prose(20, 500 + i) + ". " + shared.upper() + prose(9, 900 + i)) for i in range(5)]
    for run, least in ((s.RUN, s.MIN_WORDS), (2, 8), (3, 5), (1, 4)):
        got = sorted((x.doc_id, x.text, x.n_removed) for x in s.remove_repeats(docs(spark, rows), run, least).collect())
        assert got == brute(rows, run, least)


def test_edge_cases(spark):
    rows = odd_rows() + [*((i, "One two. Three four. " * 4 + "Five six seven eight nine ten eleven twelve. Thirteen.") for i in (20, 21, None))]
    out = s.remove_repeats(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {(x.doc_id, x.text) for x in out}
    assert {(1, None), (2, ""), (3, " .. "), (20, rows[-3][1]), (21, ""), (None, "")} <= by
    assert sum(x.text == rows[7][1] for x in out) == 1
    assert s.remove_repeats(empty(spark)).count() == 0


def test_short_sentences_and_long_ones_are_found(spark):
    short = " ".join(f"{w}." for w in prose(60, 8).split())
    long = prose(60, 9)
    rows = [(1, f"{prose(9, 1)}. {short} {prose(9, 2)}."), (2, f"{prose(9, 3)}. {short} {prose(9, 4)}."), (3, f"{prose(9, 5)}. {long}. {prose(9, 6)}."), (4, f"{prose(9, 7)}. {long}. {prose(9, 11)}.")]
    out = {x.doc_id: x for x in s.remove_repeats(docs(spark, rows)).collect()}
    assert out[1].n_removed == out[3].n_removed == 0
    assert out[2].n_removed >= 55 and out[4].n_removed == 1
    assert len(words(out[4].text)) == 18
