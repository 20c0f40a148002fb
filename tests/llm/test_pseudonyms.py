import itertools
import random
import re
import time

import pytest

from graphloom.llm import pseudonyms as p

from .helpers import docs, empty, odd_rows

VALID = {
    "card": "4539 1488 0343 6467",
    "iban": "DE89370400440532013000",
    "ssn": "123-45-6789",
    "phone": "+1 (017) 555-7713",
    "local": "017-555-7713",
    "blanks": "555 123 4567",
    "slashes": "03/04/1990",
    "token": "ghp_16C7e42F292c6912E7710c838347Ae178B4a",
    "date": "2024-02-29",
    "ip": "97.51.17.173",
    "email": "und.34@mail7.example.com",
    "secret": "04dbebab91ab85687d33eeaaf9ac699e1188f962",
}
INVALID = ["4539 1488 0343 6468", "DE88370400440532013000", "000-45-6789", "2023-02-29", "31.02.2020", "300.1.1.1", "12345678901234567890123", "1.5"]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100, 997])
def test_feistel_is_a_permutation(n):
    net = p.Feistel("k")
    out = [net.permute("t", n, x) for x in range(n)]
    assert sorted(out) == list(range(n))
    assert [net.invert("t", n, y) for y in out] == list(range(n))


def test_ssn_and_dates_are_permuted_within_their_format():
    q = p.Pseudonymiser("k")
    for s in ("001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999"):
        new = q.ssn(s)
        assert q.ssn(new) is not None and p.Pseudonymiser("k", True).ssn(new) == s
    for s in ("1800-01-01", "2199-12-31", "29.02.2024", "3.4.1990", "13.1.1850", "03/04/1990", "25/12/1990", "4/9/2001", "13.11.1990"):
        assert p.Pseudonymiser("k", True).date(q.date(s)) == s


@pytest.mark.parametrize("kind", VALID)
def test_format_validity_links_and_reversal(kind):
    s = VALID[kind]
    q, back = p.Pseudonymiser("k"), p.Pseudonymiser("k", True)
    text, n = q.text(f"see {s} and {s}, so")
    assert n == 2
    a, b = re.fullmatch(r"see (.*) and (.*), so", text).groups()
    assert a == b != s
    shape = lambda x: re.sub("[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", x)))
    if kind not in ("ip", "secret"):
        assert shape(a) == shape(s)
    assert q.text(a)[1] == 1, "a pseudonym is as valid as what it replaced"
    assert back.text(text)[0] == f"see {s} and {s}, so"
    assert p.Pseudonymiser("other").text(s)[0] != a


@pytest.mark.parametrize("s", INVALID)
def test_what_fails_its_check_stays(s):
    assert p.Pseudonymiser("k").text(f"see {s} so") == (f"see {s} so", 0)


def test_numbers_torn_by_marks():
    q = p.Pseudonymiser("k")
    whole = re.sub(r"\D", "", q.text("+1 (017) 555-7713")[0])
    for s in ("+1%%% (017)*** 555-7713&&&", "| +1 | (017) | 555-7713 |", "+1!! (017)!! 555-7713!!"):
        new, n = q.text(s)
        assert n == 1 and re.sub(r"\D", "", new) == whole and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", s)


def test_neighbours_stay_apart():
    q = p.Pseudonymiser("k")
    phone, ip, card = "+1 (826) 555-4081", "190.137.223.204", "4845168114407329"
    alone = [q.text(x)[0] for x in (phone, ip, card)]
    assert q.text(" ".join((phone, ip, phone, card, ip)))[0].count(" ") == 8
    assert q.text(f"{phone} {ip}")[0] == f"{alone[0]} {alone[1]}" and q.text(f"{phone} {card}")[0] == f"{alone[0]} {alone[2]}"


def test_unequal_values_stay_unequal():
    q = p.Pseudonymiser("k")
    cards = [f"453914880343{a}{b}{c}" for a, b, c in itertools.product("0123456789", repeat=3)]
    cards = [c + str(-p.luhn(c + "0") % 10) for c in cards]
    assert len({q.card(c) for c in cards}) == len(cards) and all(p.luhn(q.card(c)) == 0 for c in cards)


def test_edge_cases(spark):
    rows = [*odd_rows(), (9, "x" * 100_000 + " 97.51.17.173"), (10, "97.51.17.173")]
    out = p.pseudonymise(docs(spark, rows), "k").collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].text is None and by[1].n_replaced == 0 and by[2].text == "" and by[5].text == dict(rows)[5]
    assert by[9].text.split()[1] == by[10].text and by[10].n_replaced == 1
    kept = p.replace(docs(spark, rows), "k")
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(rows)
    assert p.pseudonymise(empty(spark), "k").count() == 0


def test_values_before_other_digits_and_capitals():
    card, iban = "4111 1111 1111 1111", "DE89370400440532013000"
    q, back = p.Pseudonymiser("k"), p.Pseudonymiser("k", True)
    new_card, new_iban = q.text(card)[0], q.text(iban)[0]
    assert card != new_card and iban != new_iban
    for old, new in ((card, new_card), (iban, new_iban)):
        for rest in (" 12/26", " 123", " EUR 500", " BIC COBADEFF", "."):
            assert q.text(old + rest) == (new + rest, 1)
            assert back.text(new + rest) == (old + rest, 1)
    assert q.text("DE89 3704 0044 0532 0130 00 BIC COBADEFF")[1] == 1
    assert q.text(f"12 {card}") == (f"12 {new_card}", 1)
    for k in range(200):
        body = f"4111 1111 1111 {k:04d} 12"
        whole = body + str(-p.luhn(body.replace(" ", "") + "0") % 10)
        assert back.text(q.text(whole)[0])[0] == whole


@pytest.mark.parametrize("size", [32, 40, 96, 97, 128, 511, 512, 513, 1024, 3572, 5000, 10_000])
def test_long_secrets_keep_no_digits_and_reverse(size):
    s = "".join(random.Random(size).choice("0123456789abcdef") for _ in range(size))
    q, back = p.Pseudonymiser("k"), p.Pseudonymiser("k", True)
    new = q.text(f"key {s}.")[0]
    assert back.text(new)[0] == f"key {s}." and len(new) == size + 5
    same = sum(a == b for a, b in zip(s, new[4:]))
    # chance is one in 16
    assert same < size / 16 + 5 * (size * 15 / 256) ** 0.5
    assert not re.search("1{10}", "".join("01"[a == b] for a, b in zip(s, new[4:])))


def test_long_values_take_linear_time():
    text = "z" * 1_000_000 + " " + "0f" * 500_000 + " " + "Ab.9" * 2_000 + "@mail.example.com " + "x" * 1_000_000
    began = time.perf_counter()
    new, n = p.Pseudonymiser("k").text(text)
    assert n == 2 and time.perf_counter() - began < 20
    assert p.Pseudonymiser("k", True).text(new)[0] == text
    assert "Ab.9Ab.9" not in new


def test_email_case_keeps_the_link():
    q = p.Pseudonymiser("k")
    low, high = q.email("bob@x.org"), q.email("Bob@x.org")
    assert low != "bob@x.org" and high == low[0].upper() + low[1:]


def _brute(q, text):
    """The values of a text of blank-separated words, each tried alone with every rule."""
    out, n = [], 0
    for word in text.split(" "):
        new, k = q.text(word)
        out, n = [*out, new], n + k
    return " ".join(out), n


def test_texts_equal_values_one_by_one():
    r, q = random.Random(3), p.Pseudonymiser("k")
    single = [v for v in [*VALID.values(), *INVALID] if " " not in v and v[0] != "+"]
    for _ in range(200):
        text = " so ".join(r.choice(single + ["word", "x"]) for _ in range(12))
        assert q.text(text) == _brute(q, text)


def test_a_key_is_required_and_read_from_the_session(spark):
    with pytest.raises(TypeError):
        p.pseudonymise(docs(spark, []))
    with pytest.warns(UserWarning):
        assert p.key_of(spark) == p.EXAMPLE_KEY
    spark.conf.set(p.SETTING, "mine")
    assert p.key_of(spark) == "mine"
    spark.conf.unset(p.SETTING)
