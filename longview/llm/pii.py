"""Format-preserving pseudonyms: keyed Feistel permutations of validated personal numbers, dates and addresses.

A value is mapped to a whole number below the size of its format (all valid values of the kind), permuted there under a
key, and written back with the same separators. Equal values get equal pseudonyms in all documents, different values
different ones, no value stays as it is, and who has the key can go back.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import math
import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
#: First and last day of the dates that count as dates.
DAYS = (datetime.date(1900, 1, 1), datetime.date(2099, 12, 31))
KINDS = ("email", "card", "iban", "ssn", "ip", "date", "phone", "secret")


class Feistel:
    """A keyed permutation of 0 .. size - 1 without fixed points: P(x) -> P(x + 1) for a Feistel permutation P."""

    def __init__(self, key: bytes, name: str, size: int):
        self.key, self.name, self.size = hashlib.blake2b(key, digest_size=32).digest(), name.encode(), size
        self.a = math.isqrt(max(1, size - 1)) + 1
        self.b = -(-size // self.a)

    def _mix(self, r: int, half: int) -> int:
        data = b"%d/%d/%d/" % (self.size, r, half) + self.name
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _walk(self, x: int, forward: bool) -> int:
        while True:
            left, right = divmod(x, self.b)
            for r in range(ROUNDS) if forward else reversed(range(ROUNDS)):
                sign = 1 if forward else -1
                if r % 2:
                    right = (right + sign * self._mix(r, left)) % self.b
                else:
                    left = (left + sign * self._mix(r, right)) % self.a
            x = left * self.b + right
            if x < self.size:
                return x

    def move(self, x: int, back: bool = False) -> int:
        return self._walk((self._walk(x, False) + (-1 if back else 1)) % self.size, True)


def luhn_digit(digits: str) -> str:
    """Check digit that completes ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced by ``chars`` in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Replaces values of all kinds under one key; ``back`` undoes it."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.known = key, back, {}

    def _move(self, name: str, size: int, x: int) -> int:
        f = self.known.get((name, size))
        if f is None:
            if len(self.known) > 4096:
                self.known.clear()
            f = self.known[name, size] = Feistel(self.key, name, size)
        return f.move(x, self.back)

    def by_class(self, name: str, value: str) -> str:
        """Letters go to letters of their case and digits to digits; all else stays."""
        sets = {**dict.fromkeys(string.digits, string.digits), **dict.fromkeys(string.ascii_lowercase, string.ascii_lowercase), **dict.fromkeys(string.ascii_uppercase, string.ascii_uppercase)}
        x, size = 0, 1
        for c in value:
            if s := sets.get(c):
                x, size = x * len(s) + s.index(c), size * len(s)
        shape = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c in sets else c for c in value)
        x, out = self._move(f"{name}/{shape}", size, x), []
        for c in reversed(value):
            if s := sets.get(c):
                x, d = divmod(x, len(s))
                c = s[d]
            out.append(c)
        return "".join(reversed(out))

    def email(self, m) -> str | None:
        local, at, domain = m["email"].partition("@")
        return self.by_class("email", local) + at + domain if re.search("[A-Za-z0-9]", local) and "." in domain else None

    def card(self, m) -> str | None:
        value = m["card"]
        digits = re.sub(r"\D", "", value)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = str(self._move("card", 10 ** (len(digits) - 1), int(digits[:-1]))).zfill(len(digits) - 1)
        return _refill(value, body + luhn_digit(body))

    def iban(self, m) -> str | None:
        value = m["iban"]
        plain = re.sub(r"[ -]", "", value)
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self.by_class("iban" + plain[:2], plain[4:])
        return _refill(value, plain[:2] + str(98 - number(body + plain[:2] + "00") % 97).zfill(2) + body)

    def ssn(self, m) -> str | None:
        area, group, serial = map(int, m["ssn"].split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(self._move("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, m) -> str | None:
        parts = m["ip"].split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self._move("ip", 2 ** 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, m) -> str | None:
        """Dates move within DAYS; the same day moves alike in all notations. With dots or slashes the day is first."""
        value = m["date"]
        a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", value).groups()
        year, month, day = (a, b, c) if len(a) == 4 else (c, b, a)
        swap = int(month) > 12 and len(a) != 4
        if swap:
            month, day = day, month
        try:
            d = datetime.date(int(year), int(month), int(day))
        except ValueError:
            return None
        if not DAYS[0] <= d <= DAYS[1]:
            return None
        if swap:
            # Written month first: such days, and only they, stay recognisable as month first.
            x = self._move("date/month first", (DAYS[1].year - DAYS[0].year + 1) * 12 * 16, ((d.year - DAYS[0].year) * 12 + d.month - 1) * 16 + d.day - 13)
            while not (new := _day(x)):
                x = self._move("date/month first", (DAYS[1].year - DAYS[0].year + 1) * 12 * 16, x)
        else:
            new = DAYS[0] + datetime.timedelta(self._move("date", (DAYS[1] - DAYS[0]).days + 1, (d - DAYS[0]).days))
        pad = lambda n: str(n).zfill(2)
        if len(a) == 4:
            return f"{new.year}{sep}{pad(new.month)}{sep}{pad(new.day)}"
        first, second = (new.month, new.day) if swap else (new.day, new.month)
        return f"{pad(first)}{sep}{pad(second)}{sep}{new.year}"

    def phone(self, m) -> str | None:
        value = m["phone"]
        digits = re.sub(r"\D", "", value)
        if not 8 <= len(digits) <= 15:
            return None
        national = digits[-10:]
        if re.fullmatch(r"1?[2-9]\d\d[2-9]\d{6}", digits):
            area, office, line = int(national[:3]), int(national[3:6]), int(national[6:])
            rest, line = divmod(self._move("phone/1", 800 * 800 * 10000, ((area - 200) * 800 + office - 200) * 10000 + line), 10000)
            area, office = divmod(rest, 800)
            return _refill(value, f"{digits[:-10]}{area + 200}{office + 200}{line:04d}")
        if not value.startswith("+"):
            return None
        head, tail = digits[:2], digits[2:]
        return _refill(value, head + str(self._move(f"phone/{head}", 10 ** len(tail), int(tail))).zfill(len(tail)))

    def secret(self, m) -> str | None:
        return m["named"] + self.by_class("secret", m["value"]) if m["value"] else m["secret"][:4] + self.by_class("secret", m["secret"][4:])

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        found = dict.fromkeys(KINDS, 0)

        def one(m):
            kind = m.lastgroup if m.lastgroup in found else next(k for k in KINDS if m[k] is not None)
            new = getattr(self, kind)(m)
            if new is None:
                return m[0]
            found[kind] += 1
            return new

        return (_VALUES.sub(one, text) if _HINT.search(text) else text), found


def _day(x: int) -> datetime.date | None:
    year, rest = divmod(x, 12 * 16)
    month, day = rest // 16 + 1, rest % 16 + 13
    year += DAYS[0].year
    return datetime.date(year, month, day) if day <= calendar.monthrange(year, month)[1] and month <= 12 and day > 12 else None


_HINT = re.compile(r"[0-9@]|AKIA|pass|pwd|secret|token|key")
_VALUES = re.compile(r"""
(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
|(?P<secret>\bAKIA[0-9A-Z]{16}\b|(?P<named>\b(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*["']?)(?P<value>[A-Za-z0-9]{12,}))
|(?P<iban>\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b)
|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))
|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
|(?P<date>(?<![\d./-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?![\d]|[./-]\d))
|(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\d]|-\d))
|(?P<phone>(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w-]))
""", re.X)


def pseudonymised(text: Column, key: bytes, back: bool = False) -> Column:
    """Struct of the new text and the number of values replaced, by kind; null counts as empty."""
    kind = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]])

    @F.pandas_udf(kind)
    def f(texts: pd.Series) -> pd.DataFrame:
        p = Pseudonyms(key, back)
        rows = [(t, *found.values()) for t, found in map(p.replace, texts)]
        return pd.DataFrame(rows, columns=[n.name for n in kind])

    return f(F.coalesce(text, F.lit("")))


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text with pseudonyms, n_email, n_card, ... (values replaced by kind).

    Numbers count only if they are valid: cards by Luhn, IBANs by their check digits, addresses and dates by range.
    Null texts count as empty. Each text is read where it is stored and whole; nothing is shuffled, and an empty table
    gives an empty result. Values in two notations (spaces, dashes) keep theirs and get the same new value.
    """
    return docs.select(F.col(id_col), pseudonymised(F.col(text_col), key).alias("p")).select(id_col, "p.*")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """The key is the session's ``longview.pii.key``; without one, a fixed key that protects nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonyms(docs, spark.conf.get("longview.pii.key", "open test key").encode())
