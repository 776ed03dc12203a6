"""Format-preserving pseudonyms: what is found is permuted within its own format by a keyed Feistel network.

Numbers are validated (card check digits, IBAN check numbers, address octets, calendar dates) and stay valid. A value, however
it is written, has one pseudonym under one key, so equal values stay linked across documents, and whoever holds the key
can undo it. Separators, letter case and length stay as they were.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateworks.llm._common import bounded_batches

#: For tests and queries; a real run passes its own secret.
DEFAULT_KEY = b"slateworks demonstration key"
KINDS = ("email", "secret", "iban", "card", "phone", "ssn", "ip", "date")
_ROUNDS = 10
#: Words before a secret; the search, its prefilter and the replacement all use these.
_SECRET_WORDS = r"password|passwd|pwd|token|secret|api[_-]?key"
_SECRET_START = re.compile(rf"AKIA|ASIA|(?i:(?:{_SECRET_WORDS})\s*[=:]\s*[\"']?)")
#: Characters of a secret that are permuted together; longer ones are permuted in pieces.
_PIECE = 200
_DATE_FROM, _DATE_DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


class Feistel:
    """Keyed permutations of 0 .. size-1; tweak makes those of different formats independent."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.key, self.mask = hashlib.sha256(key + b"\x00" + tweak.encode()).digest(), (1 << self.half) - 1

    def _round(self, i: int, x: int) -> int:
        data = bytes([i]) + x.to_bytes((self.half + 7) // 8, "big")
        out, n = b"", (self.half + 7) // 8
        while len(out) < n:
            out += hashlib.blake2b(data + len(out).to_bytes(4, "big"), key=self.key, digest_size=min(64, max(8, n))).digest()
        return int.from_bytes(out[:n], "big") & self.mask

    def _once(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for i in range(_ROUNDS):
            left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def _back(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for i in reversed(range(_ROUNDS)):
            left, right = right ^ self._round(i, left), left
        return left << self.half | right

    def permute(self, x: int, valid=lambda x: True) -> int:
        """Walks the cycle until it is inside the range and valid again; x itself must be valid."""
        y = self._once(x)
        while y >= self.size or not valid(y):
            y = self._once(y)
        return y

    def invert(self, x: int, valid=lambda x: True) -> int:
        y = self._back(x)
        while y >= self.size or not valid(y):
            y = self._back(y)
        return y


def luhn(digits: str) -> int:
    """The check digit after these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, filling: str, is_part=str.isalnum) -> str:
    """shape with its parts replaced in order, letters in the case they had."""
    it = iter(filling)
    return "".join((c2.upper() if c.isupper() else c2) if is_part(c) and (c2 := next(it)) is not None else c for c in shape)


def _iban_ok(compact: str) -> bool:
    return len(compact) >= 15 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


class Pseudonymizer:
    def __init__(self, key: bytes = DEFAULT_KEY, inverse: bool = False):
        self.key, self.inverse, self.nets, self.known = key, inverse, {}, {}

    def _map(self, tweak: str, size: int, x: int, valid=lambda x: True) -> int:
        net = self.nets.get((tweak, size))
        if net is None:
            if len(self.nets) > 10_000:
                self.nets.clear()
            net = self.nets[tweak, size] = Feistel(self.key, f"{tweak}/{size}", size)
        return (net.invert if self.inverse else net.permute)(x, valid)

    def _digits(self, tweak: str, digits: str, valid=lambda s: True) -> str:
        n = len(digits)
        return str(self._map(f"{tweak}{n}", 10**n, int(digits), lambda x: valid(str(x).zfill(n)))).zfill(n)

    def _alnum(self, tweak: str, text: str) -> str:
        """Letters and digits, each place within its own alphabet; ASCII, lower case."""
        sizes = [10 if c.isdigit() else 26 for c in text]
        size = value = 0
        for c, s in zip(text, sizes):
            value = value * s + (int(c) if s == 10 else ord(c) - 97)
            size = (size or 1) * s
        value = self._map(f"{tweak}{''.join('9' if s == 10 else 'a' for s in sizes)}", size, value)
        out = []
        for s in reversed(sizes):
            value, at = divmod(value, s)
            out.append(str(at) if s == 10 else chr(97 + at))
        return "".join(reversed(out))

    def _hex(self, tweak: str, text: str) -> str:
        return format(self._map(f"{tweak}x{len(text)}", 16 ** len(text), int(text, 16)), "x").zfill(len(text))

    def _pieces(self, mapping, text: str) -> str:
        """A secret of any length; each piece has its own permutations."""
        return "".join(mapping(f"secret{at // _PIECE or ''}", text[at : at + _PIECE]) for at in range(0, len(text), _PIECE))

    def email(self, m: str) -> str | None:
        local, _, domain = m.rpartition("@")
        name, dot, top = domain.rpartition(".")
        part = lambda s, k: _refill(s, self._alnum(k, "".join(c for c in s.lower() if c.isalnum())), str.isalnum) if any(c.isalnum() for c in s) else s
        return f"{part(local, 'local')}@{part(name, 'domain')}{dot}{top}"

    def secret(self, m: str) -> str | None:
        start = _SECRET_START.match(m)
        head, body = (m[: start.end()], m[start.end() :]) if start else ("", m)
        if not body.strip("\"'"):
            return None
        if re.fullmatch(r"[0-9a-f]{8,}", body):
            return head + self._pieces(self._hex, body)
        parts = "".join(c for c in body.lower() if c.isascii() and c.isalnum())
        return head + _refill(body, self._pieces(self._alnum, parts), lambda c: c.isascii() and c.isalnum()) if parts else None

    def iban(self, m: str) -> str | None:
        compact = m.replace(" ", "")
        if not _iban_ok(compact):
            return None
        body = self._alnum("iban" + compact[:2], compact[4:].lower()).upper()
        check = 98 - int("".join(str(int(c, 36)) for c in body + compact[:2] + "00")) % 97
        return _refill(m, f"{compact[:2]}{check:02d}{body}")

    def card(self, m: str) -> str | None:
        digits = "".join(c for c in m if c.isdigit())
        if not 12 <= len(digits) <= 19:
            return None
        if luhn(digits[:-1]) == int(digits[-1]):
            body = digits[0] + self._digits("card", digits[1:-1])
            return _refill(m, body + str(luhn(body)))
        # Long numbers without a right check digit stay without one, so both kinds stay apart.
        return _refill(m, self._digits("number" + digits[0], digits[1:], lambda s: luhn(digits[0] + s[:-1]) != int(s[-1])).rjust(len(digits), digits[0]))

    def phone(self, m: str) -> str | None:
        digits = "".join(c for c in m if c.isdigit())
        if not 7 <= len(digits) <= 15:
            return None
        if (area := re.match(r"0\d+(?= ?[/-])", m)) is not None:
            # With a trunk zero: the area code stays, so the number keeps its form.
            return _refill(m, area[0] + self._digits("phone" + area[0], digits[len(area[0]) :]))
        if len(digits) >= 10 and (not m.startswith("+") or m.startswith("+1")):
            code, ten = digits[:-10], digits[-10:]
            valid = lambda s: s[0] > "1" and s[3] > "1"
            # The country code does not count, so a number has one pseudonym with and without it.
            return _refill(m, code + self._digits("phone" if valid(ten) else "phone*", ten, valid if valid(ten) else lambda s: not valid(s)))
        code = re.match(r"\+(\d{1,3})\b", m)
        keep = len(code[1]) if code else 0
        return _refill(m, digits[:keep] + self._digits("phone" + digits[:keep], digits[keep:])) if len(digits) > keep else None

    def ssn(self, m: str) -> str | None:
        digits = m.replace("-", "")
        valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        return _refill(m, self._digits("ssn", digits, valid if valid(digits) else lambda s: not valid(s)))

    def ip(self, m: str) -> str | None:
        octets = m.split(".")
        if any(int(o) > 255 or o != str(int(o)) for o in octets):
            return None
        value = self._map("ip", 1 << 32, int.from_bytes(bytes(map(int, octets)), "big"))
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, m: str) -> str | None:
        a, s1, b, s2, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", m).groups()
        orders = ((0, 1, 2),) if len(a) == 4 else ((2, 1, 0), (2, 0, 1)) if s1 == "." else ((2, 0, 1), (2, 1, 0))
        for order in orders:
            try:
                day = dt.date(*(int((a, b, c)[i]) for i in order)).toordinal() - _DATE_FROM
            except ValueError:
                continue
            if s1 != s2 or not 0 <= day < _DATE_DAYS:
                return None
            loose = order[1:] == (1, 0) and s1 != "." or order[1:] == (0, 1) and s1 == "."
            # A day above 12 in the place of the month was what told the order: it stays above.
            own = (lambda x: dt.date.fromordinal(_DATE_FROM + x).day > 12) if loose else (lambda x: True)
            new = dt.date.fromordinal(_DATE_FROM + self._map("date>12" if loose else "date", _DATE_DAYS, day, own))
            parts = ["", "", ""]
            for i, v in zip(order, (new.year, new.month, new.day)):
                parts[i] = str(v).zfill(len((a, b, c)[i]) if i == order[0] or len((a, b, c)[i]) == 2 else 0)
            return s1.join(parts)
        return None

    def replaced(self, kind: str, found: str) -> str | None:
        key = (kind, found)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = getattr(self, kind)(found)
        return self.known[key]

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, begin, end) in the old text for each."""
        if not _TRIGGER.search(text):
            return text, []
        out, spans, at, pos = [], [], 0, 0
        while m := _FIND.search(text, pos):
            new = self.replaced(kind := m.lastgroup, m[0])
            if new is None:
                # Not valid as this: the next alternatives may begin inside it.
                pos = m.start() + 1
                while pos < m.end() and text[pos - 1].isalnum():
                    pos += 1
                continue
            out += [text[at : m.start()], new]
            spans.append((kind, m.start(), m.end()))
            at = pos = m.end()
        return "".join(out) + text[at:], spans


_TRIGGER = re.compile(rf"[\d@]|AKIA|ASIA|(?i:{_SECRET_WORDS})")
_FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    rf"|(?P<secret>\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b|\b(?i:{_SECRET_WORDS})\s?[=:]\s?[\"']?[^\s\"',;]{{6,}})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b)"
    r"|(?P<date>(?<![\d./-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?![\d/-]|\.\d))"
    r"|(?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\d./-])0\d{1,4}(?: ?/ ?|-)\d{5,9}(?:[ -]\d{1,5}){0,2}(?![\d/-]))"
    r"|(?P<card>(?<![\d.])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?!\d)|(?<![\d.])\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)|(?<![\d.])\d{12,19}(?!\d|\.\d))"
)


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


def pseudonymize(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """(doc_id, text, n_found, kinds) for every row of docs(doc_id, text): whole texts with pseudonyms for what was found.

    kinds counts the finds, as kind=number joined by commas in alphabetical order. Null texts stay null and empty ones
    empty, with nothing found; repeated rows give repeated results; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("text string, n_found long, kinds string")
    def run(texts: pd.Series) -> pd.DataFrame:
        own, rows = Pseudonymizer(key), []
        for t in texts:
            new, spans = own.text(t) if t is not None else (None, [])
            rows.append((new, len(spans), ",".join(f"{k}={n}" for k, n in sorted(Counter(s[0] for s in spans).items()))))
        return pd.DataFrame(rows, columns=["text", "n_found", "kinds"])

    return docs.select(F.col("doc_id"), run(F.col("text").cast("string")).alias("_pii")).select("doc_id", "_pii.text", "_pii.n_found", "_pii.kinds")


def with_pseudonyms(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """docs(doc_id, text, ..) with pseudonyms in text and, where docs has n_chars, that count to match; else as they are.

    Null texts stay null (so does their n_chars), empty ones empty; repeated rows, and equal values in any rows, get equal
    pseudonyms; doc_id is not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        own = Pseudonymizer(key)
        return pd.Series([None if t is None else own.text(t)[0] for t in texts], dtype=object)

    out = docs.withColumn("text", run(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
