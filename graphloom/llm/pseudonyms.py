"""Format-preserving pseudonyms of personal numbers, dates and addresses.

A keyed Feistel network permutes the values of each format, so a pseudonym has
the format and validity of what it replaces, and equal values get equal
pseudonyms in every document.  It is a permutation: unequal values stay
unequal, and the holder of the key can reverse it.

=========  ==========================================================  =============================
kind       found and validated                                          permuted
=========  ==========================================================  =============================
card       13 to 19 digits, single blanks or hyphens, Luhn's check      all but the check digit, which is recomputed
iban       country, check digits, the country's length (other           digits and letters of the account; check digits recomputed
           countries: 15 to 34 letters or digits), mod 97
ssn        ddd-dd-dddd, no area 000, 666 or 9dd, no zero group          ordinal among the valid numbers
phone      ``+`` country code and 7 to 14 digits with separators, or     all digits but the country code
           ddd-ddd-dddd with hyphens, dots or blanks
date       yyyy-mm-dd, yyyy/mm/dd, d.m.yyyy, m/d/yyyy or d/m/yyyy,       day number within 1800..2199
           padded or not, a day of the calendar
ip         four numbers up to 255                                       the 32 bits
email      local part @ domain with a dot                               letters and digits of the local part
token      the prefix of a service's access tokens (``TOKENS``) and     letters and digits after the prefix
           16 characters or more
secret     a hexadecimal string of 32 or more digits                    its digits
=========  ==========================================================  =============================

Letters and digits of mixed strings are permuted by class and case, so an
email's local part of letters stays one of letters.  Addresses that differ in
case alone get pseudonyms that differ in case alone.

Strings of any length are permuted whole.  Beyond ``BLOCK`` characters this is
done block by block, each under a key that the block's place and the pseudonym
of the block before it give, so the time is linear in the length and the whole
can be reversed; long strings with a common start keep a common start.

A card ends at the first blank or hyphen up to which it is valid, and an IBAN at
its country's length, so what follows them may be digits or capitals.  A card
with such a place inside is permuted among those that are valid as a whole
alone, so it is found again.  After a value that fails its check the search goes
on at its second character.  The one case that may not reverse: digits and a
blank before a card, when the pseudonym makes them valid together by chance.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import warnings
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

ROUNDS = 8
#: Characters that are permuted as one number.
BLOCK = 512
#: Where a session holds its secret key.
SETTING = "spark.graphloom.pseudonyms.key"
#: Stands in where a session names no key; it is published, so it protects nothing.
EXAMPLE_KEY = "graphloom-example-key"
#: Public prefixes of access tokens.
TOKENS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "AKIA", "ASIA", "AIza", "sk_live_", "sk_test_", "rk_live_", "sk-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "hf_", "npm_", "pypi-")

_HINT = re.compile(r"[0-9@]|[A-Fa-f]{32}")
_SCAN = re.compile(
    r"""(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})
    |(?<![0-9A-Za-z])(?P<token>(?:@T)[0-9A-Za-z_-]{16,})
    |(?<![0-9A-Za-z])(?P<secret>[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])
    |(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![0-9A-Za-z])
    |(?<![\w.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])
    |(?P<phone>\+[0-9]{1,3}@S(?:\([0-9]{1,4}\)@S)?[0-9]{2,4}(?:@S[0-9]{2,4}){1,4}(?![0-9]|\.[0-9]))
    |(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])
    |(?<![\w-])(?<![0-9][ ])(?P<local>[0-9]{3}(?P<g>[-. ])[0-9]{3}(?P=g)[0-9]{4}|\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4})(?![\w-])(?![ ][0-9])
    |(?<![\w/.-])(?P<date>[0-9]{4}(?P<s>[-/])[0-9]{2}(?P=s)[0-9]{2}|[0-9]{1,2}(?P<t>[./])[0-9]{1,2}(?P=t)[0-9]{4})(?![\w/-])
    |(?<![0-9])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])"""
    # parts of a phone number may be torn by marks
    .replace("@T", "|".join(map(re.escape, TOKENS))).replace("@S", r"[ .$%&*|!#-]{0,6}").replace("#-]", r"\#-]"),
    re.X,
)
_DAY0 = datetime.date(1800, 1, 1).toordinal()
_DAYS = datetime.date(2200, 1, 1).toordinal() - _DAY0
_SSN = [a for a in range(1, 900) if a != 666]
#: Characters of an IBAN by country.
_IBAN = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in names.split()
}
_CLASSES = (("0123456789", 10), ("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))
_OF = {c: (i, n) for i, (chars, _) in enumerate(_CLASSES) for n, c in enumerate(chars)}


def luhn(digits: str) -> int:
    """Luhn's sum modulo 10, over digits that include the check digit."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _raw(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


class Feistel:
    """A keyed permutation of range(n) for any n, by an alternating network over n's two factors and cycle walking."""

    def __init__(self, key: str, rounds: int = ROUNDS) -> None:
        self.key, self.rounds = key.encode(), rounds
        self._permute = lru_cache(maxsize=1 << 16)(self._walk)

    def _f(self, tag: str, n: int, r: int, x: int, side: int) -> int:
        """A number below ``side``: the keyed hash in counter mode, 64 bits wider than the side, so all its digits are even."""
        said = f"{tag}|{r}|".encode() + b"".join(len(v).to_bytes(8, "big") + v for v in (_raw(n), _raw(x)))
        seed, size = hmac.digest(self.key, said, "sha256"), side.bit_length() + 64
        out = seed if size <= 256 else b"".join(hmac.digest(self.key, seed + i.to_bytes(4, "big"), "sha256") for i in range(-(-size // 256)))
        return int.from_bytes(out, "big") % side

    @staticmethod
    def _sides(n: int) -> tuple[int, int]:
        a = 1 << ((n - 1).bit_length() + 1) // 2
        return a, -(-n // a)

    def _once(self, tag: str, n: int, x: int) -> int:
        a, b = self._sides(n)
        left, right = divmod(x, b)
        for r in range(self.rounds):
            if r % 2 == 0:
                left = (left + self._f(tag, n, r, right, a)) % a
            else:
                right = (right + self._f(tag, n, r, left, b)) % b
        return left * b + right

    def _back(self, tag: str, n: int, x: int) -> int:
        a, b = self._sides(n)
        left, right = divmod(x, b)
        for r in reversed(range(self.rounds)):
            if r % 2 == 0:
                left = (left - self._f(tag, n, r, right, a)) % a
            else:
                right = (right - self._f(tag, n, r, left, b)) % b
        return left * b + right

    def _walk(self, tag: str, n: int, x: int) -> int:
        y = self._once(tag, n, x)
        while y >= n:
            y = self._once(tag, n, y)
        return y

    def permute(self, tag: str, n: int, x: int) -> int:
        # long values are rarely met twice and would fill the memory
        return self._permute(tag, n, x) if n.bit_length() <= 256 else self._walk(tag, n, x)

    def invert(self, tag: str, n: int, x: int) -> int:
        y = self._back(tag, n, x)
        while y >= n:
            y = self._back(tag, n, y)
        return y


class Pseudonymiser:
    """Replaces the values of one text; ``back`` reverses it."""

    def __init__(self, key: str, back: bool = False) -> None:
        self.net, self.reverse = Feistel(key), back
        self.move = self.net.invert if back else self.net.permute

    def _digits(self, tag: str, digits: str) -> str:
        return str(self.move(tag, 10 ** len(digits), int(digits))).zfill(len(digits)) if digits else ""

    def _blocks(self, tag: str, text: str, one) -> str:
        """``one(tag, text)`` over the blocks of a text, each tagged with its place and the pseudonym before it."""
        if len(text) <= BLOCK:
            return one(tag, text)
        out, before = [], ""
        for i in range(0, len(text), BLOCK):
            part = text[i : i + BLOCK]
            new = one(f"{tag}|{len(text)}|{i}|{hashlib.sha256(before.encode()).hexdigest()}", part)
            out.append(new)
            before = part if self.reverse else new
        return "".join(out)

    def _chars(self, tag: str, text: str) -> str:
        """Permutes letters and digits among the strings of the same pattern of classes."""
        return self._blocks(tag, text, self._mixed)

    def _mixed(self, tag: str, text: str) -> str:
        n, x = 1, 0
        for c in text:
            if c in _OF:
                size = _CLASSES[_OF[c][0]][1]
                n, x = n * size, x * size + _OF[c][1]
        shape = "".join("dlu"[_OF[c][0]] if c in _OF else c for c in text)
        x = self.move(f"{tag}|{shape}", n, x)
        out = []
        for c in reversed(text):
            if c in _OF:
                chars, size = _CLASSES[_OF[c][0]]
                x, i = divmod(x, size)
                c = chars[i]
            out.append(c)
        return "".join(reversed(out))

    def _hex(self, tag: str, text: str) -> str:
        return f"{self.move(tag, 16 ** len(text), int(text, 16)):0{len(text)}x}"

    @staticmethod
    def _fill(shape: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    @staticmethod
    def _card(shape: str, digits: str) -> int:
        """Digits of the shortest valid card that ends at a blank, a hyphen or the end of the shape; 0 if there is none."""
        ends = [len(re.sub(r"[ -]", "", shape[: m.start()])) for m in re.finditer(r"[ -]|$", shape)]
        return next((n for n in ends if n >= 13 and not luhn(digits[:n])), 0)

    def card(self, s: str) -> str | None:
        d = re.sub(r"[ -]", "", s)
        n = self._card(s, d)
        if not n:
            return None
        s = next(s[:i] for i in range(n, len(s) + 1) if len(re.sub(r"[ -]", "", s[:i])) == n)
        d = d[:n]
        while True:
            body = self._digits("card", d[:-1])
            d = body + str(-luhn(body + "0") % 10)
            if self._card(s, d) == n:
                return self._fill(s, d)

    def iban(self, s: str) -> str | None:
        d = s.replace(" ", "")
        if size := _IBAN.get(d[:2]):
            if len(d) < size:
                return None
            end = next(i for i in range(size, len(s) + 1) if len(s[:i].replace(" ", "")) == size)
            if s[end : end + 1].strip():
                return None
            s, d = s[:end], d[:size]
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if number(d[4:] + d[:4]) % 97 != 1:
            return None
        body = self._chars("iban" + d[:2], d[4:])
        new = iter(d[:2] + f"{98 - number(body + d[:2] + '00') % 97:02d}" + body)
        return "".join(c if c == " " else next(new) for c in s)

    def ssn(self, s: str) -> str | None:
        a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
        if a in (0, 666) or a >= 900 or not g or not n:
            return None
        x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
        x, n = divmod(self.move("ssn", len(_SSN) * 99 * 9999, x), 9999)
        a, g = divmod(x, 99)
        return f"{_SSN[a]:03d}-{g + 1:02d}-{n + 1:04d}"

    def phone(self, s: str) -> str | None:
        code = re.match(r"\+[0-9]{1,3}(?![0-9])|\+[0-9]{1,2}", s)
        head = code[0] if code else ""
        d = re.sub(r"\D", "", s[len(head) :])
        return head + self._fill(s[len(head) :], self._digits("phone", d)) if 7 <= len(d) <= 14 else None

    local = phone

    def date(self, s: str) -> str | None:
        mark = next(c for c in s if not c.isdigit())
        if s[4] == mark and s[:4].isdigit():
            y, m, d = (int(x) for x in s.split(mark))
            return self._day("date", y, m, d, lambda d: d.strftime(f"%Y{mark}%m{mark}%d"), lambda d: True)
        a, b, y = s.split(mark)
        # a leading nought, or two digits twice, is a padded date; else nothing is padded
        wide = len(a) == len(b) == 2
        if not wide and "0" in (a[0], b[0]):
            return None
        a, b, y = int(a), int(b), int(y)
        # with slashes the month comes first unless it can only be the day
        first = mark == "." or a > 12
        write = lambda d: ("{0:02d}{2}{1:02d}{2}{3:04d}" if wide else "{0}{2}{1}{2}{3:04d}").format(*((d.day, d.month) if first else (d.month, d.day)), mark, d.year)
        fits = lambda d: (wide or d.day < 10 or d.month < 10) and (mark == "." or not first or d.day > 12)
        return self._day(f"date{mark}{wide}{first}", y, b if first else a, a if first else b, write, fits)

    def _day(self, tag: str, y: int, m: int, d: int, write, fits) -> str | None:
        """The day's pseudonym among those that are written the same way."""
        try:
            x = datetime.date(y, m, d).toordinal() - _DAY0
        except ValueError:
            return None
        if not 0 <= x < _DAYS:
            return None
        while True:
            x = self.move(tag, _DAYS, x)
            new = datetime.date.fromordinal(x + _DAY0)
            if fits(new):
                return write(new)

    def ip(self, s: str) -> str | None:
        p = [int(x) for x in s.split(".")]
        if max(p) > 255:
            return None
        x = self.move("ip", 1 << 32, (p[0] << 24) + (p[1] << 16) + (p[2] << 8) + p[3])
        return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))

    def email(self, s: str) -> str:
        local, at, domain = s.partition("@")
        low = self._chars("email", local.lower())
        return "".join(c.upper() if o.isupper() else c for c, o in zip(low, local)) + at + domain

    def token(self, s: str) -> str:
        head = next(t for t in TOKENS if s.startswith(t))
        return head + self._chars("token" + head, s[len(head) :])

    def secret(self, s: str) -> str:
        new = self._blocks("secret", s.lower(), self._hex)
        return new if s == s.lower() else new.upper()

    def text(self, s: str) -> tuple[str, int]:
        """(the text with pseudonyms, number of values replaced)."""
        if not _HINT.search(s):
            return s, 0
        parts, count, done, at = [], 0, 0, 0
        while m := _SCAN.search(s, at):
            new = getattr(self, {"s": "date", "t": "date", "g": "local"}.get(m.lastgroup, m.lastgroup))(m[0])
            if new is None:
                at = m.start() + 1
                continue
            parts += [s[done : m.start()], new]
            # a card or IBAN may be less than the match, and is as long as its pseudonym
            done = at = m.start() + len(new) if m.lastgroup in ("card", "iban") else m.end()
            count += 1
        return "".join([*parts, s[done:]]), count


def pseudonymised(text: Column, key: str, back: bool = False) -> Column:
    """struct(text, n_replaced) of a text column: null stays null with 0, empty stays empty."""
    kind = StructType([StructField("text", StringType()), StructField("n_replaced", IntegerType())])

    @F.pandas_udf(kind)
    def run(batches: pd.Series) -> pd.DataFrame:
        p = _of(key, back)
        done = [(None, 0) if t is None else p.text(t) for t in batches]
        return pd.DataFrame(done, columns=["text", "n_replaced"])

    return run(text.cast("string"))


def key_of(spark: SparkSession) -> str:
    """The session's key; where it has none, the published example key, with a warning."""
    key = spark.conf.get(SETTING, None)
    if not key:
        warnings.warn(f"{SETTING} is not set: pseudonyms are made with a published key and can be reversed by anyone", stacklevel=2)
    return key or EXAMPLE_KEY


@lru_cache(maxsize=4)
def _of(key: str, back: bool) -> Pseudonymiser:
    return Pseudonymiser(key, back)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced) of every row, in one pass without a shuffle.

    Values that fail their check (a wrong check digit, 31 February, an octet
    above 255) stay as they are.  A value inside a longer run of digits or
    letters is none.  Texts, and values in them, may have any length.  Repeated
    rows and ids each give a row, nulls stay null, extra columns are ignored
    whatever their names, no rows give no rows.  ``key`` has no default: who
    knows it can reverse the pseudonyms.
    """
    done = docs.select(docs[id_col].alias("doc_id"), pseudonymised(docs[text_col], key).alias("__gl_p"))
    return done.select("doc_id", "__gl_p.text", "__gl_p.n_replaced")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with pseudonyms in the text; edge cases as in :func:`pseudonymise`."""
    return docs.withColumn(text_col, pseudonymised(docs[text_col], key)["text"])
