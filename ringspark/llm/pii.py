"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted within their format by a keyed Feistel network, so equal values stay equal in
all documents and distinct ones stay distinct, and no value maps to itself: the permutation is P^-1(P(x) + shift) for a
Feistel permutation P of the numbers below N and a keyed shift that is not zero. Where a permutation of a larger set is
walked until it comes back to the format, a value could meet itself again, with a chance of about 1 in N.

- card: 13 to 19 digits that pass the Luhn check; the digits before the check digit are permuted, the check digit
  is computed anew. Separators stay. Of digits that fail the check, shorter runs up to a separator are tried.
- iban: two letters, two check digits that pass mod 97, 11 to 30 letters and digits; letters and digits are permuted
  in place and the check digits computed anew.
- ssn: 3-2-4 digits with dashes and an area that is in use; the permutation stays among such numbers.
- phone: 7 to 15 digits with a plus, brackets, a leading zero or as 3-3-4; a country code or a leading zero stays, the national digits are
  permuted whatever their separators, so all spellings of a number get the same digits.
- ip: dotted quads and IPv6 addresses; permuted among all of them, in all spellings alike.
- date: valid calendar dates of the years 1000 to 2999, as Y-M-D, D.M.Y, M/D/Y, or D/M/Y if only that is valid; permuted
  among the days of these years (D/M/Y: among those whose day is over 12).
- email: the local part's letters and digits are permuted in place; the domain stays.
- secret: runs of 32 or more hexadecimal digits, keys that begin with a known prefix (which stays), and values of eight or more
  characters, one a digit at least, after words such as token= or password:, in place. Values longer than a block are
  permuted block by block, each under a key that all before it goes into.

No match goes over a line's end. A line without a digit, an @, a long run of hexadecimal letters or a key's prefix can hold
no match, and is left after one look. Texts of any length take time in proportion to it.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringspark.llm.common import fresh, small_batches

KINDS = ("email", "secret", "iban", "card", "ssn", "date", "ip", "phone")
ROUNDS = 8
#: Characters of a block of a long value.
BLOCK = 64

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++")
_PREFIX = r"(?:[sp]k[_\-]|gh[opsu]_|AKIA|ASIA|xox[abps]-)"
_HEX = r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
PATTERN = re.compile(
    # what begins with a letter
    r"(?<![0-9A-Za-z])(?=[A-Za-z])(?:"
    r"(?i:passw(?:or)?d|pwd|passphrase|secret|token|api[_\-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?(?=[^\s\"'<>\d]*+\d)(?P<value>[0-9A-Za-z_\-+/=~!#$%^&*.]{7,}[0-9A-Za-z_\-+/=~])"
    rf"|{_PREFIX}(?P<rest>[0-9A-Za-z_\-]{{16,}}+)"
    rf"|(?P<letters>{_HEX})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])))"
    # what begins with a digit, plus or bracket
    r"|(?=[\d+(])(?:"
    rf"(?P<digits>(?<![0-9A-Za-z]){_HEX})"
    r"|(?P<card>(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-]))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<date>(?<![\d\-./])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d\-/]|\.\d))"
    r"|(?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\+\d{7,15}|\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\d{3}(?P<sep>[ .\-])\d{3}(?P=sep)\d{4}|0\d{2,4}[ /\-]\d{3,4}[ \-]?\d{3,5})(?![\d\-])))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{6,39}(?![\w:]))"
)
#: What a line needs for any match: each alternative above has a digit, or is one of these.
HINT = re.compile(rf"[0-9@]|[a-f]{{32}}|[A-F]{{32}}|{_PREFIX}|:[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f]{{0,4}}:")
SECRET = frozenset(("value", "rest", "letters", "digits"))
DAYS = (datetime.date(1000, 1, 1).toordinal(), datetime.date(2999, 12, 31).toordinal())
# The first digits of telephone numbers by country, one or two digits; all others are of three.
COUNTRY_1 = frozenset("17")
COUNTRY_2 = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def luhn(digits: str) -> int:
    """The Luhn sum mod 10, 0 for a valid number."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10


class Permutation:
    """A keyed permutation of the numbers from 0 to n - 1 that moves all of them."""

    def __init__(self, key: bytes, tweak: bytes, n: int):
        size = n.to_bytes(n.bit_length() // 8 + 1, "big")
        self.key, self.n = hashlib.sha256(key + b"\0" + tweak + b"\0" + size).digest(), n
        self.half = math.isqrt(max(n, 1) - 1) + 1
        self.bytes = self.half.bit_length() // 8 + 1
        self.wide = self.bytes + 8  # so that taking it modulo half is even enough
        self.shift = 1 + int.from_bytes(hashlib.shake_256(self.key).digest(2 * self.wide), "big") % (n - 1) if n > 1 else 0

    def _round(self, i: int, x: int) -> int:
        data = bytes((i,)) + x.to_bytes(self.bytes, "big")
        if self.wide <= 64:
            return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=self.wide).digest(), "big") % self.half
        return int.from_bytes(hashlib.shake_256(self.key + data).digest(self.wide), "big") % self.half

    def _network(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.half)
        if back:
            for i in reversed(range(ROUNDS)):
                a, b = (b - self._round(i, a)) % self.half, a
        else:
            for i in range(ROUNDS):
                a, b = b, (a + self._round(i, b)) % self.half
        return a * self.half + b

    def _walk(self, x: int, back: bool) -> int:
        x = self._network(x, back)
        while x >= self.n:  # cycle walking: half * half is the least square that holds n
            x = self._network(x, back)
        return x

    def __call__(self, x: int, back: bool = False) -> int:
        if self.n < 2:
            return x
        return self._walk((self._walk(x, False) + (-self.shift if back else self.shift)) % self.n, True)


@functools.lru_cache(4096)
def permutation(key: bytes, tweak: str, n: int) -> Permutation:
    return Permutation(key, tweak.encode(), n)


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER_HEX, UPPER_HEX = "0123456789abcdef", "0123456789ABCDEF"


def shape(text: str) -> str:
    """Which letters and digits a secret has: its pseudonym has the same."""
    plain = re.sub(r"[^0-9A-Za-z]", "", text)
    if plain.isdigit():
        return "digits"
    return "lower" if re.fullmatch("[0-9a-f]+", plain) else "upper" if re.fullmatch("[0-9A-F]+", plain) else "other"


def in_place(text: str, key: bytes, tweak: str, back: bool, hexadecimal: str = "") -> str:
    """Permutes letters and digits among those of their class (or all of them among hexadecimal digits); all else stays."""
    out, before = [], hashlib.sha256()
    for start in range(0, len(text), BLOCK):
        block = text[start : start + BLOCK]
        value, n, bases = 0, 1, []
        for c in block:
            alphabet = hexadecimal if c in hexadecimal else next((a for a in ALPHABETS if c in a), None)
            bases.append(alphabet)
            if alphabet:
                value, n = value * len(alphabet) + alphabet.index(c), n * len(alphabet)
        p = Permutation(key, tweak.encode() + before.digest(), n) if start else permutation(key, tweak, n)
        value, new = p(value, back), []
        for c, alphabet in zip(reversed(block), reversed(bases), strict=True):
            if alphabet:
                value, at = divmod(value, len(alphabet))
                c = alphabet[at]
            new.append(c)
        new = "".join(reversed(new))
        out.append(new)
        before.update((new if back else block).encode("utf-8", "surrogatepass"))
    return "".join(out)


def secret(text: str, key: bytes, back: bool) -> str:
    kind = shape(text)
    digits = {"lower": LOWER_HEX, "upper": UPPER_HEX}.get(kind, "")
    new = in_place(text, key, f"secret {kind}", back, digits)
    while shape(new) != kind:
        new = in_place(new, key, f"secret {kind}", back, digits)
    return new


def refill(text: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits):
        return None
    m = len(digits) - 1
    body = f"{permutation(key, 'card', 10**m)(int(digits[:m]), back):0{m}d}"
    return refill(text, body + str(-luhn(body + "0") % 10))


def date(text: str, key: bytes, back: bool) -> str | None:
    mark = next(c for c in text if not c.isdigit())
    first, second, third = text.split(mark)
    orders = {"-": ["ymd"], ".": ["dmy"], "/": ["mdy", "dmy"]}[mark]
    for order in orders:
        part = dict(zip(order, (first, second, third), strict=True))
        try:
            at = datetime.date(*(int(part[x]) for x in "ymd")).toordinal()
        except ValueError:
            continue
        if not DAYS[0] <= at <= DAYS[1]:
            continue
        p = permutation(key, "date", DAYS[1] - DAYS[0] + 1)
        new = datetime.date.fromordinal(DAYS[0] + p(at - DAYS[0], back))
        while order == "dmy" and mark == "/" and new.day <= 12:
            new = datetime.date.fromordinal(DAYS[0] + p(new.toordinal() - DAYS[0], back))
        wide = "0" in (part["m"][0], part["d"][0]) or len(part["m"]) + len(part["d"]) == 4
        said = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if wide else str(new.month), "d": f"{new.day:02d}" if wide else str(new.day)}
        return mark.join(said[x] for x in order)
    return None


def phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    keep = 0
    if text.startswith("+"):
        keep = 1 if digits[0] in COUNTRY_1 else 2 if digits[:2] in COUNTRY_2 else 3
    elif digits[0] == "0":  # the trunk prefix
        keep = 1
    n = len(digits) - keep
    return refill(text, digits[:keep] + f"{permutation(key, 'phone', 10**n)(int(digits[keep:]), back):0{n}d}")


def replaced(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of one match; None if it isn't valid for its kind."""
    if kind == "email":
        local, _, domain = text.partition("@")
        return f"{in_place(local, key, 'email', back)}@{domain}"
    if kind in SECRET or kind == "secret":
        return secret(text, key, back)
    if kind == "card":
        return card(text, key, back)
    if kind == "date":
        return date(text, key, back)
    if kind == "phone":
        return phone(text, key, back)
    if kind == "iban":
        plain = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
        if not 15 <= len(plain) <= 34 or number(plain) % 97 != 1:
            return None
        body = in_place(plain[4:], key, "iban", back)
        checked = iter(f"{plain[:2]}{98 - number(f'{plain[:2]}00{body}') % 97:02d}{body}")
        return "".join(c if c == " " else next(checked) for c in text)
    if kind == "ssn":
        area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [*range(1, 666), *range(667, 900)]
        x = permutation(key, "ssn", len(areas) * 99 * 9999)((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, back)
        return f"{areas[x // 9999 // 99]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"
    if kind == "ip6":
        if text.count(":") < 3:
            return None
        try:
            at = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        new = ipaddress.IPv6Address(permutation(key, "ip6", 1 << 128)(at, back))
        return new.exploded if len(text) == 39 else str(new)
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    x = permutation(key, "ip", 1 << 32)(int.from_bytes(bytes(parts), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def matches(line: str, key: bytes, back: bool) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of a line, in order; what fails its check is looked at again from the next place on."""
    emails = [m.span() for m in EMAIL.finditer(line)] if "@" in line else []
    at = 0
    for start, end in [*emails, (len(line), len(line))]:
        while at < start and (m := PATTERN.search(line, at, start)):
            kind = m.lastgroup or "phone"
            lo, hi = m.span(kind)
            new = replaced(kind, m[kind], key, back)
            if new is None and kind == "card":
                for cut in reversed([lo + x.start() for x in re.finditer("[ -]", m[kind])]):
                    if sum(map(str.isdigit, line[lo:cut])) >= 13 and (new := card(line[lo:cut], key, back)) is not None:
                        hi = cut
                        break
            if new is None:
                at = m.start() + 1
                continue
            yield lo, hi, "secret" if kind in SECRET else "ip" if kind == "ip6" else kind, new
            at = hi
        if end > start:
            yield start, end, "email", replaced("email", line[start:end], key, back)
        at = end


def pseudonymised(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[int]]:
    """The text with all matches replaced, and how many of each kind."""
    counts = [0] * len(KINDS)
    if not text or not HINT.search(text):
        return text, counts
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if not HINT.search(line):
            continue
        out, at = [], 0
        for lo, hi, kind, new in matches(line, key, back):
            out += (line[at:lo], new)
            at = hi
            counts[KINDS.index(kind)] += 1
        if out:
            lines[i] = "".join((*out, line[at:]))
    return "\n".join(lines), counts


def replacer(key: str, back: bool = False):
    """A function of a text column: a struct of the new text and n_<kind>."""
    secret = key.encode()

    @F.pandas_udf("text string, " + ", ".join(f"n_{k} int" for k in KINDS))
    def change(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [pseudonymised(t, secret, back) for t in batch]
            out = pd.DataFrame([c for _, c in found], columns=[f"n_{k}" for k in KINDS], dtype="int32")
            out.insert(0, "text", pd.Series([t for t, _ in found], dtype=object))
            yield out

    return change


def pseudonymise(docs: DataFrame, key: str = "ringspark", back: bool = False) -> DataFrame:
    """docs with text replaced, and n_<kind> for each kind (columns of these names are replaced).

    back undoes it under the same key, where the replaced values match the same patterns. Null texts stay null and empty ones
    empty; numbers that fail their check (cards, IBANs, dates, areas of SSNs, quads) are no personal data and stay.
    Repeated rows stay repeated, and rows with a null or repeated doc_id are changed like any other. An empty table gives
    an empty one; other columns stay.
    """
    small_batches(docs.sparkSession)
    new = fresh(docs, "new")
    out = docs.withColumn(new, replacer(key, back)("text"))
    return out.withColumns({"text": F.col(f"{new}.text")} | {f"n_{k}": F.col(f"{new}.n_{k}") for k in KINDS}).drop(new)


def in_texts(docs: DataFrame, key: str = "ringspark") -> DataFrame:
    """docs with text replaced, and n_chars, where there is one, made that of the new text; all else as it was."""
    small_batches(docs.sparkSession)
    out = docs.withColumn("text", replacer(key)("text")["text"])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
