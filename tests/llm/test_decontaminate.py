import random
import re

from graphloom.llm import decontaminate as d

from .helpers import docs, empty, odd_rows, prose

ITEM = "A train of Northern leaves at 9 and covers 120 km in 3 hours before it meets the slow train of Western near the old bridge"


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "item_id long, text string, h string, slots int")


def run(spark, rows, items=((1, ITEM),), **options):
    return {(r.doc_id, r.item_id): r for r in d.contaminated(docs(spark, rows), bench(spark, items), **options).collect()}


def test_verbatim_changed_and_inconsistent(spark):
    changed = ITEM.replace("9", "7").replace("120", "250").replace("km", "miles").replace("Northern", "Southern")
    twice = "It pays 5 dollars for 5 apples and then 5 more dollars to the man who sold the apples at the market"
    items = ((1, ITEM), (2, twice))
    rows = [(1, prose(50, 1) + ". " + ITEM + ". " + prose(50, 2)), (2, "We ask: " + changed + ", they say."), (3, prose(200, 3)), (4, twice.replace("5", "8")), (5, "It pays 1 dollars for 2 apples and then 3 more dollars to the man who sold the apples at the market")]
    out = run(spark, rows, items)
    assert set(out) >= {(1, 1), (2, 1), (4, 2)} and not {k for k in out if k[0] == 3}
    assert out[1, 1].n_changed == 0 and out[1, 1].share == 1
    assert out[2, 1].n_changed >= 3
    assert out[4, 2].share == 1
    assert (5, 2) not in out or out[5, 2].share < out[4, 2].share


def test_shuffle_path_gives_the_same(spark):
    rows = [(1, prose(50, 1) + ". " + ITEM), (2, prose(80, 2))]
    assert run(spark, rows) == run(spark, rows, max_held=0)


def test_case_and_marks_do_not_matter(spark):
    text = "éclair and the old men of the sea went up the hill to fetch a pail of water for us"
    assert set(run(spark, [(1, "*** ".join(text.upper().split()))], ((1, text),))) == {(1, 1)}


def test_edge_cases(spark):
    rows = [*odd_rows(), (7, ITEM), (7, ITEM), (None, ITEM)]
    items = ((1, ITEM), (2, ITEM), (3, None), (4, ""), (None, ITEM), (5, "too short so"), (6, "1 2 3 4 5 6 7 8 9 10 11"))
    assert set(run(spark, rows, items)) == {(7, 1), (7, 2), (None, 1), (None, 2)}
    kept = d.decontaminate(docs(spark, rows), bench(spark, items))
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(rows) - 3
    assert run(spark, []) == {} and run(spark, rows, ()) == {}
    assert d.decontaminate(empty(spark), bench(spark, ())).count() == 0
    assert d.decontaminate(docs(spark, rows), bench(spark, ())).count() == len(rows)


STORY = "Natalia Novak sold 1,250 clips to her friends in April, and then she sold half as many clips in May for 3.5 dollars. How many kg did Natalia Novak carry over 5km to New York altogether?"


def test_story_problem_with_other_names_and_numbers(spark):
    other = "Bob sold 800 clips to her friends in October, and then she sold half as many clips in June for 4 dollars. How many kg did Bob carry over 12 miles to Old Ravenna Town altogether?"
    lower, upper = STORY.lower(), STORY.upper()
    mixed = other.replace("Bob carry", "Ann carry")
    out = run(spark, [(1, "So. " + other), (2, lower), (3, upper), (4, mixed), (5, prose(300, 1))], ((1, STORY),))
    assert out[1, 1].share == 1 and out[1, 1].n_changed >= 6
    assert out[2, 1].share == out[3, 1].share == 1 and out[2, 1].n_changed == 0
    assert out[4, 1].share < 1 and (5, 1) not in out


def test_capitals_beyond_latin(spark):
    item = "вчера Анна Каренина купила 12 яблок и потом продала половину своих яблок на рынке"
    other = item.replace("Анна Каренина", "Пётр").replace("12", "1.500")
    assert run(spark, [(1, other)], ((1, item),))[1, 1].share == 1


def test_short_items_count_as_a_whole(spark):
    out = run(spark, [(1, "he asks what is 2 plus 7 today"), (2, "what is it")], ((1, "What is 3 plus 5?"), (2, "What is")))
    assert set(out) == {(1, 1)} and out[1, 1].n_changed == 2


def test_a_chance_match_does_not_displace_a_copy():
    # item values 1 and 2; one stray match maps 1 to 9 before the copy maps it to 5
    copy = [(10 + i, i, [5, 0, 6], [1, 0, 2]) for i in range(3)]
    stray = (0, 0, [9, 0, 6], [1, 0, 2])
    want = ({0, 1, 2}, 2)
    assert d.agreed([stray, *copy]) == d.agreed([*copy, stray]) == want
    assert d.agreed([]) == (set(), 0)


WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def canonical(text):
    """[(symbol, value)], word by word."""
    out = []
    for m in WORD.finditer(text):
        w, at = m[0], m.start()
        parts = [(w, at)]
        if u := re.fullmatch(r"(\d+)(.*\D)", w):
            if u[2].lower() in d.UNITS:
                parts = [(u[1], at), (u[2], at + len(u[1]))]
        for w, at in parts:
            if w[0] in "0123456789":
                kind = "#"
            elif out and out[-1][0] == "#" and w.lower() in d.UNITS:
                kind = "unit"
            elif w[0] != w[0].lower() and any(c == c.lower() for c in w) and w.lower() not in d.COMMON:
                kind = "name"
            else:
                kind = None
            if out and kind in ("#", "name") and out[-1][0] == kind:
                between = text[out[-1][2] : at]
                if between in (".", ",") and kind == "#" and w.isdigit() and text[out[-1][2] - 1].isdigit() or between == " " and kind == "name":
                    out[-1] = (kind, out[-1][1] + between + w.lower(), at + len(w))
                    continue
            out.append((kind or w.lower(), w.lower() if kind else None, at + len(w)))
    return [(s, x) for s, x, _ in out]


def pieces(seq, size, plain):
    return [(i, [s for s, _ in seq[i : i + size]], [x for _, x in seq[i : i + size]]) for i in range(len(seq) - size + 1) if sum(x is None for _, x in seq[i : i + size]) >= plain]


def brute(text, item, window=8, plain=4, shortest=4):
    best = 0.0
    words = lambda t: [(w.lower(), None) for w in WORD.findall(t)]
    for a, b, templates in ((canonical(text), canonical(item), True), (words(text), words(item), False)):
        size = min(window, len(b))
        if size < shortest:
            continue
        least = (plain if size == window else -(-size // 2)) if templates else 0
        mine, theirs = pieces(a, size, least), pieces(b, size, least)
        first = {}
        for p, s, x in mine:
            first.setdefault((tuple(s), tuple(x)), p)
        number = lambda x: 0 if x is None else int.from_bytes(x.encode(), "big")
        hits = [(p, ip, [number(y) for y in x], [number(y) for y in ix]) for (s, x), p in first.items() for ip, its, ix in theirs if list(s) == its]
        seen = d.agreed(hits)[0] if templates else {h[1] for h in hits}
        best = max(best, len(seen) / len(theirs) if theirs else 0.0)
    return best


def test_matches_brute_force(spark):
    r = random.Random(8)
    items = [(i, make(r, 6 if i % 7 == 0 else 30)) for i in range(25)]
    rows = []
    for i in range(60):
        text = " ".join(make(r, 12) for _ in range(2))
        for _, item in r.sample(items, 2):
            words = item.split(" ")
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = make(r, 1)
            text += r.choice([". ", "\n", " "]) + " ".join(words) + " " + make(r, 5)
        rows.append((i, text))
    want = {(i, j): round(x, 6) for i, t in rows for j, item in items if (x := brute(t, item)) >= 0.5}
    got = {k: x.share for k, x in run(spark, rows, items).items()}
    assert got == want and len(want) > 40


def make(r, n):
    pick = lambda: r.choice(["the", "old", "mill", "river", "sold", "apples", "many", "how", "then", "Anna", "Ben Lee", "Ödön", "Жанна", "12", "1,250", "3.5", "5km", "7 miles", "USA", "a", "grew", "near", "under", "tree"])
    return " ".join(pick() for _ in range(n))
