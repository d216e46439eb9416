"""Format-preserving pseudonyms for validated numbers, dates and addresses.

A value that passes its check (Luhn for cards, mod 97 for IBANs, the calendar for dates,
the numbering rules for phones, social security numbers and IP addresses) is permuted
inside its own format by a keyed Feistel network with cycle walking: the result passes
the same check and has the same signs in the same places, equal values get equal
pseudonyms in all documents, and whoever holds the key can go back.  Values that fail
their check, and everything else in the text, stay as they are.

The permutation is a bijection of the format's domain and moves every value.  Null texts stay null; empty texts stay empty.
Very long texts are scanned whole, in time linear in their length.  Repeated rows and
clashing extra columns pass through.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE32 = _LETTERS + "234567"


class Feistel:
    """A keyed bijection of the numbers below ``size``."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(key, digest_size=32, person=b"pseudonym").digest()
        self.label = f"{kind}/{size}/".encode()

    def _round(self, turn: int, x: int) -> int:
        text = self.label + turn.to_bytes(1, "big") + x.to_bytes((self.half + 7) // 8, "big")
        return int.from_bytes(hashlib.blake2b(text, digest_size=64, key=self.key).digest(), "big") & self.mask

    def _once(self, x: int, turns: range) -> int:
        left, right = x >> self.half, x & self.mask
        if turns.step > 0:
            for t in turns:
                left, right = right, left ^ self._round(t, right)
        else:
            for t in turns:
                left, right = right ^ self._round(t, left), left
        return left << self.half | right

    def _inside(self, x: int, turns: range) -> int:
        """Cycle walking: the network's domain is a power of two, the walk stays below ``size``."""
        x = self._once(x, turns)
        while x >= self.size:
            x = self._once(x, turns)
        return x

    def _step(self, x: int, by: int, allowed: Callable[[int], bool]) -> int:
        # A step of one between the network and its inverse: one cycle through all numbers, so none stays in place.
        while True:
            x = self._inside((self._inside(x, _AHEAD) + by) % self.size, _BACK)
            if allowed(x):
                return x

    def forward(self, x: int, allowed: Callable[[int], bool] = lambda x: True) -> int:
        return self._step(x, 1, allowed)

    def back(self, x: int, allowed: Callable[[int], bool] = lambda x: True) -> int:
        return self._step(x, -1, allowed)


_AHEAD, _BACK = range(ROUNDS), range(ROUNDS - 1, -1, -1)


@functools.lru_cache(maxsize=256)
def _network(key: bytes, kind: str, size: int) -> Feistel:
    return Feistel(key, kind, size)


def _moved(key: bytes, kind: str, x: int, size: int, allowed: Callable[[int], bool] = lambda x: True) -> int:
    """The pseudonym of x among the allowed numbers below ``size``."""
    return _network(key, kind, size).forward(x, allowed)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(pattern: str, signs: str, places: str = "0123456789") -> str:
    """``pattern`` with its signs out of ``places`` replaced one by one."""
    it = iter(signs)
    return "".join(next(it) if c in places else c for c in pattern)


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn(digits[:-1]) != int(digits[-1]):
        return None
    # The issuer's first digit stays; the check digit follows from the others.
    body = digits[1:-1]
    new = digits[0] + str(_moved(key, f"card{digits[0]}", int(body), 10 ** len(body))).zfill(len(body))
    return _refill(text, new + str(luhn(new)))


def social(text: str, key: bytes) -> str | None:
    def good(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    x = int(re.sub(r"\D", "", text))
    return _refill(text, str(_moved(key, "social", x, 10**9, good)).zfill(9)) if good(x) else None


def phone(text: str, key: bytes) -> str | None:
    """North American numbers by their numbering plan; others with + and a country code keep that code."""
    digits = re.sub(r"\D", "", text)
    if not text.startswith("+") and len(digits) == 10 or digits.startswith("1") and len(digits) == 11:
        def good(x: int) -> bool:
            return x // 10**9 > 1 and x // 10**6 % 10 > 1

        own = digits[-10:]
        if not good(int(own)):
            return None
        return _refill(text, digits[:-10] + str(_moved(key, "phone", int(own), 10**10, good)).zfill(10))
    if text.startswith("+") and 9 <= len(digits) <= 15 and digits[0] != "0":
        own = digits[2:]
        return _refill(text, digits[:2] + str(_moved(key, f"phone{digits[:2]}", int(own), 10 ** len(own))).zfill(len(own)))
    return None


def address(text: str, key: bytes) -> str | None:
    """IPv4; private, loopback and other special ranges map into themselves."""
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None

    def region(x: int) -> int:
        a, b = x >> 24, x >> 16 & 255
        return 1 if a == 10 else 2 if a == 172 and 16 <= b < 32 else 3 if a == 192 and b == 168 else 4 if a in (0, 127) else 5 if a >= 224 else 0

    x = int.from_bytes(bytes(map(int, parts)), "big")
    own = region(x)
    low, size = {1: (10 << 24, 1 << 24), 2: (0xAC100000, 1 << 20), 3: (0xC0A80000, 1 << 16)}.get(own, (0, 1 << 32))
    y = low + _moved(key, f"address{own}", x - low, size, lambda n: region(low + n) == own)
    return ".".join(map(str, y.to_bytes(4, "big")))


def date(text: str, key: bytes) -> str | None:
    """Year-month-day, or day and month before the year (month first where both readings are dates)."""
    a, b, c = map(int, re.findall(r"\d+", text))
    for year, month, day, layout in ((a, b, c, "ymd"),) if a > 999 else ((c, a, b, "mdy"), (c, b, a, "dmy")):
        try:
            x = datetime.date(year, month, day).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= x <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + _moved(key, "date", x - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
        value = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
        return re.sub(r"\d+", lambda _, it=iter(layout): value[next(it)], text)
    return None


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _mixed(plain[4:], key, "iban" + plain[:2])
    return _refill(text, plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02}" + body, _LETTERS + "0123456789")


def _mixed(text: str, key: bytes, kind: str) -> str:
    """Letters move among letters of their case and digits among digits; other signs stay."""
    sets = {c: s for s in ("0123456789", _LETTERS, _LETTERS.lower()) for c in s}
    radix = [sets[c] for c in text if c in sets]
    if not radix:
        return text
    x = 0
    for s, c in zip(radix, (c for c in text if c in sets)):
        x = x * len(s) + s.index(c)
    shape = "".join("0Aa"["0Aa".index(s[0])] for s in radix)
    x = _moved(key, kind + shape, x, int(np.prod([len(s) for s in radix], dtype=object)))
    out = []
    for s in reversed(radix):
        x, i = divmod(x, len(s))
        out.append(s[i])
    it = iter(reversed(out))
    return "".join(next(it) if c in sets else c for c in text)


def email(text: str, key: bytes) -> str | None:
    """The local part moves; the domain, which names no person, stays."""
    local, _, domain = text.rpartition("@")
    return _mixed(local, key, "email@" + domain.lower()) + "@" + domain


def access_key(text: str, key: bytes) -> str | None:
    x = functools.reduce(lambda n, c: n * 32 + _BASE32.index(c), text[4:], 0)
    y = _moved(key, "access", x, 32 ** (len(text) - 4))
    return text[:4] + "".join(_BASE32[y >> 5 * i & 31] for i in range(len(text) - 5, -1, -1))


_NO = r"(?<![A-Za-z0-9])"
KINDS: dict[str, tuple[re.Pattern, Callable[[str, bytes], str | None]]] = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), email),
    "iban": (re.compile(_NO + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    "access_key": (re.compile(_NO + r"A[KS]IA[A-Z2-7]{16}(?![A-Za-z0-9])"), access_key),
    "card": (re.compile(r"(?<![\d.+-])(?<![A-Za-z])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])"), card),
    "ip": (re.compile(r"(?<![\d.])(?<![A-Za-z])\d{1,3}(?:\.\d{1,3}){3}(?![\d])(?!\.\d)(?![A-Za-z])"), address),
    "date": (re.compile(_NO + r"(?<!\d[./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![A-Za-z0-9])(?![./-]\d)"), date),
    "social": (re.compile(_NO + r"(?<!\d-)\d{3}-\d{2}-\d{4}(?![A-Za-z0-9])(?!-\d)"), social),
    "phone": (re.compile(r"(?<![A-Za-z0-9+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})(?![A-Za-z0-9])"), phone),
}


def pseudonyms(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind; the first kind that accepts a stretch has it."""
    spans: list[tuple[int, int, str]] = []
    counts: dict[str, int] = {}
    for kind, (pattern, change) in KINDS.items():
        if kind == "email" and "@" not in text:
            continue
        taken = sorted((a, b) for a, b, _ in spans)
        at = 0
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at < len(taken) and taken[at][0] < m.end():
                continue
            new = change(m.group(), key)
            if new is not None:
                spans.append((m.start(), m.end(), new))
                counts[kind] = counts.get(kind, 0) + 1
    if not spans:
        return text, counts
    out, last = [], 0
    for a, b, new in sorted(spans):
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), counts


# Whatever a kind accepts is found by one of these: email, access key, six digits close together (card, date, social, phone), IP, IBAN.
_WORTH = re.compile(r"@|A[KS]IA|\d(?:\D{0,4}\d){5}|\d{1,3}(?:\.\d{1,3}){3}|[A-Z]{2}\d{2} ?[A-Z0-9]{4}")


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in text, and n_found and n_<kind> (replacing columns of these names)."""
    names = ["n_found", *[f"n_{k}" for k in KINDS]]
    columns = [c for c in docs.columns if c not in names]
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = np.zeros((len(KINDS), len(texts)), np.int64)
            for i, text in enumerate(texts):
                if text and _WORTH.search(text):
                    texts[i], counts = pseudonyms(text, key)
                    found[:, i] = [counts.get(k, 0) for k in KINDS]
            made = {"text": pa.array(texts, batch.column("text").type), "n_found": pa.array(found.sum(axis=0))}
            made |= {f"n_{k}": pa.array(found[i]) for i, k in enumerate(KINDS)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in [*columns, *names]], [*columns, *names])

    return docs.mapInArrow(run, schema)
