"""Column expressions on circular 160-bit ids.

An id is a string of 40 lower-case hexadecimal digits, so that strings sort as the numbers do. Arithmetic takes it apart
into five limbs of 32 bits; everything stays a built-in expression, so Catalyst compiles it into the stage that uses it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 5
DIGITS = 40
BITS = 160
LOW = (1 << 32) - 1
ZERO = "0" * DIGITS
TOP = "f" * DIGITS
#: The distance from an id to itself is the whole circle, which needs one digit more.
CIRCLE = "1" + ZERO


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_id(data: Column | str) -> Column:
    """The id of bytes or text: its SHA-1."""
    return F.sha1(_c(data).cast("binary"))


def node_id(host: Column | str, port: Column | str, vnode: Column | str) -> Column:
    """The id of a virtual node: SHA-1 of host.port.vnode."""
    return F.sha1(F.concat_ws(".", _c(host), _c(port).cast("string"), _c(vnode).cast("string")).cast("binary"))


def is_authentic(id: Column | str, host: Column | str, port: Column | str, vnode: Column | str, most: int = 1024) -> Column:
    """Whether an id is that of its host, port and vnode, and these are in range."""
    return (_c(port) >= 0) & (_c(port) <= 65535) & (_c(vnode) >= 0) & (_c(vnode) <= most) & (node_id(host, port, vnode) == _c(id))


def parse(text: Column | str) -> Column:
    """Up to 40 hexadecimal digits of any case as an id; null for all else."""
    return F.when(_c(text).rlike("^[0-9a-fA-F]{0,40}$"), F.lpad(F.lower(_c(text)), DIGITS, "0"))


def limbs(id: Column | str) -> list[Column]:
    """Five numbers, the highest first."""
    return [F.conv(F.substring(_c(id), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LIMBS)]


def joined(parts: list[Column]) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(p), 8, "0")) for p in parts))


#: Sums need few parts: three of 13, 13 and 14 digits, so that a carry fits a long as well.
WIDE = ((1, 13), (14, 13), (27, 14))


def wide(id: Column | str) -> list[Column]:
    return [F.conv(F.substring(_c(id), at, n), 16, 10).cast("long") for at, n in WIDE]


def _wide_joined(parts: list[Column]) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(p), n, "0") for p, (_, n) in zip(parts, WIDE, strict=True))))


def add(a: Column | str, b: Column | str) -> Column:
    """(a + b) mod 2^160."""
    return add_wide(wide(a), wide(b))


def add_wide(a: list[Column], b: list[Column]) -> Column:
    """add of two ids that are taken apart already."""
    out, carry = [], None
    for x, y, (_, n) in zip(reversed(a), reversed(b), reversed(WIDE), strict=True):
        total = x + y if carry is None else x + y + carry
        out.append(total.bitwiseAND(F.lit((1 << 4 * n) - 1)))
        carry = F.shiftright(total, 4 * n)
    return _wide_joined(out[::-1])


def subtract(a: Column | str, b: Column | str) -> Column:
    """(a - b) mod 2^160."""
    return subtract_wide(wide(a), wide(b))


def subtract_wide(a: list[Column], b: list[Column]) -> Column:
    """subtract of two ids that are taken apart already."""
    out, borrow = [], None
    for x, y, (_, n) in zip(reversed(a), reversed(b), reversed(WIDE), strict=True):
        total = x - y if borrow is None else x - y + borrow
        out.append(total.bitwiseAND(F.lit((1 << 4 * n) - 1)))
        borrow = F.shiftright(total, 63)  # -1 below zero
    return _wide_joined(out[::-1])


def power(p: Column | str) -> Column:
    """2^p as an id, 0 <= p < 160."""
    p = _c(p)
    digit = F.substring(F.lit("1248"), (p % 4 + 1).cast("int"), F.lit(1))
    nibbles = F.floor(p / 4).cast("int")
    return F.concat(F.repeat(F.lit("0"), F.lit(DIGITS - 1) - nibbles), digit, F.repeat(F.lit("0"), nibbles))


def increment(id: Column | str) -> Column:
    return add(id, F.lit("1".rjust(DIGITS, "0")))


def decrement(id: Column | str) -> Column:
    return subtract(id, F.lit("1".rjust(DIGITS, "0")))


def double(id: Column | str, k: int) -> Column:
    """(id << k) mod 2^160."""
    whole, bits = divmod(k, 32)
    parts = [*limbs(id), *[F.lit(0).cast("long")] * (whole + 1)]
    return joined([F.shiftleft(parts[i + whole], bits).bitwiseOR(F.shiftright(parts[i + whole + 1], 32 - bits)).bitwiseAND(F.lit(LOW)) for i in range(LIMBS)])


def drop_top_bits(id: Column | str, n: int) -> Column:
    """Without the highest n bits, moved left by n: what is left of a path that used n bits."""
    return double(id, n)


def distance(a: Column | str, b: Column | str) -> Column:
    """Clockwise from a to b; from an id to itself it is the whole circle, 41 digits. Order by length, then text."""
    return F.when(_c(a) == _c(b), F.lit(CIRCLE)).otherwise(subtract(b, a))


def as_double(id: Column | str) -> Column:
    """The id as a number of limited precision."""
    return sum((x.cast("double") * float(1 << 32 * (LIMBS - 1 - i)) for i, x in enumerate(limbs(id))), F.lit(0.0))


def between(a: Column | str, b: Column | str, n: Column | str) -> Column:
    """n in the open interval (a, b) of the circle; if a is b, all but a."""
    a, b, n = _c(a), _c(b), _c(n)
    return F.when(a == b, n != a).when(a < b, (n > a) & (n < b)).otherwise((n > a) | (n < b))


def between_left(a: Column | str, b: Column | str, n: Column | str) -> Column:
    """n in [a, b); if a is b, the whole circle."""
    a, b, n = _c(a), _c(b), _c(n)
    return F.when(a == b, F.lit(True)).when(a < b, (n >= a) & (n < b)).otherwise((n >= a) | (n < b))


def between_right(a: Column | str, b: Column | str, n: Column | str) -> Column:
    """n in (a, b]; if a is b, the whole circle. This is what a node is responsible for."""
    a, b, n = _c(a), _c(b), _c(n)
    return F.when(a == b, F.lit(True)).when(a < b, (n > a) & (n <= b)).otherwise((n > a) | (n <= b))


def between_both(a: Column | str, b: Column | str, n: Column | str) -> Column:
    """n in [a, b]; if a is b, the whole circle."""
    a, b, n = _c(a), _c(b), _c(n)
    return F.when(a == b, F.lit(True)).when(a < b, (n >= a) & (n <= b)).otherwise((n >= a) | (n <= b))


def overlap(a: tuple, b: tuple) -> Column:
    """Whether two closed ranges of the circle share an id: an end of one lies in the other."""
    (l1, r1), (l2, r2) = a, b
    return between_both(l1, r1, l2) | between_both(l1, r1, r2) | between_both(l2, r2, l1) | between_both(l2, r2, r1)


def in_range(id: Column | str, low: str, high: str) -> Column:
    """between_both for bounds known now: plain comparisons that reach the Parquet scan. The bounds must differ."""
    id = _c(id)
    return (id >= low) & (id <= high) if low < high else (id >= low) | (id <= high)


def top_bits(id: Column | str, n: int) -> Column:
    """The highest n (at most 32) bits as a number."""
    return F.shiftright(F.conv(F.substring(_c(id), 1, 8), 16, 10).cast("long"), 32 - n)


def low_ones(id: Column | str) -> Column:
    """The number of ones in the lowest 32 bits."""
    return F.bit_count(limbs(id)[-1]).cast("int")


def log2_floor(n: Column | str) -> Column:
    """The place of the highest one of a number of 32 bits; 0 for 0."""
    n = _c(n).cast("long")
    return F.when(n > 0, F.length(F.bin(n)) - 1).otherwise(F.lit(0)).cast("int")


def bit_length(id: Column | str) -> Column:
    rest = F.ltrim(_c(id), F.lit("0"))
    first = F.conv(F.substring(rest, 1, 1), 16, 10).cast("int")
    return F.when(rest == "", F.lit(0)).otherwise(4 * (F.length(rest) - 1) + F.length(F.bin(first))).cast("int")


def highest_mismatch(a: Column | str, b: Column | str) -> Column:
    """The highest bit in which two ids differ; the top bit of b if their lengths do, -1 if they are equal."""
    mixed = joined([x.bitwiseXOR(y) for x, y in zip(limbs(a), limbs(b), strict=True)])
    return F.when(bit_length(a) != bit_length(b), bit_length(b) - 1).otherwise(bit_length(mixed) - 1).cast("int")


def bits_of(id: Column | str) -> Column:
    """The id as 160 characters 0 and 1, the highest first."""
    return F.concat(*(F.lpad(F.bin(x), 32, "0") for x in limbs(id)))


def zero_run(id: Column | str, top: int, zeros: int) -> Column:
    """The index of the highest bit, from `top` down, at which `zeros` zero bits in a row begin (going down); -1 if none."""
    at = F.locate("0" * zeros, F.substring(bits_of(id), BITS - top, top + 1))
    return F.when(at > 0, F.lit(top + 1) - at).otherwise(F.lit(-1)).cast("int")


def replace_low_bits(id: Column | str, position: int, source: Column | str) -> Column:
    """The bits from `position` up of id, and below them the highest bits of source."""
    joined_bits = F.concat(F.substring(bits_of(id), 1, BITS - position), F.substring(bits_of(source), 1, position))
    return F.lower(F.concat(*(F.lpad(F.conv(F.substring(joined_bits, 1 + 32 * i, 32), 2, 16), 8, "0") for i in range(LIMBS))))


def slot(id: Column | str, k: int) -> Column:
    """The k-th group of six bits from the top, k from 0 to 26; the last has four bits."""
    three = F.conv(F.substring(_c(id), 1 + 3 * (k // 2), 3), 16, 10).cast("int")
    return three.bitwiseAND(F.lit(63)) if k % 2 else (three if k == 26 else F.shiftright(three, 6))


def slots(id: Column | str, depth: int) -> Column:
    """The path of the first `depth` slots, two digits each: a prefix that sorts as ids do."""
    return F.concat(*(F.lpad(slot(id, k).cast("string"), 2, "0") for k in range(depth))) if depth else F.lit("")


def database_key(id: Column | str) -> Column:
    """Without the lowest 32 bits, which hold auxiliary data."""
    return F.concat(F.substring(_c(id), 1, 32), F.lit("0" * 8))


def with_aux(id: Column | str, aux: Column | str) -> Column:
    """The lowest 32 bits replaced by auxiliary data."""
    return F.concat(F.substring(_c(id), 1, 32), F.lower(F.lpad(F.hex(_c(aux).cast("long")), 8, "0")))


def angle(id: Column | str) -> Column:
    """The place on a drawn circle, in radians, from the top 16 bits."""
    return F.conv(F.substring(_c(id), 1, 4), 16, 10).cast("double") / 65535.0 * 2.0 * F.pi()


def place(id: Column | str, width: int) -> tuple[Column, Column]:
    """x and y, whole numbers, of an id on a circle drawn in a square of this width with a margin of 30; zero is at the top."""
    half, radius = F.lit(width // 2), F.lit((width - 60) / 2)
    return (half + F.sin(angle(id)) * radius).cast("int"), (half - F.cos(angle(id)) * radius).cast("int")


def word_xor(data: Column | str) -> Column:
    """The exclusive or of the little-endian 32-bit words of bytes; bytes after the last whole word don't count."""
    digits = F.hex(_c(data).cast("binary"))
    n = F.floor(F.length(digits) / 8).cast("int")
    word = lambda i: F.conv(F.concat(*(F.substring(digits, (i * 8 + 1 + 2 * k).cast("int"), F.lit(2)) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(word(i)))).otherwise(F.lit(0).cast("long"))


def seconds(text: Column | str) -> Column:
    """A lifetime such as 90s, 5m, 2h, 1d, 3w, 6M or 1y in seconds; a month has 30 days, a year 365 and six hours."""
    n, unit = F.regexp_extract(_c(text), r"^(\d+)([smhdwMy])$", 1), F.regexp_extract(_c(text), r"^(\d+)([smhdwMy])$", 2)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return F.when(n != "", n.cast("long") * size.when(unit == "M", 2592000).when(unit == "y", 31557600))


def size_bytes(text: Column | str) -> Column:
    """A size such as 10b, 3K, 2M or 1G in bytes; a plain number counts gigabytes."""
    n, unit = F.regexp_extract(_c(text), r"^(\d+)([bKMG]?)$", 1), F.regexp_extract(_c(text), r"^(\d+)([bKMG]?)$", 2)
    return F.when(n != "", n.cast("long") * F.when(unit == "b", 1).when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).otherwise(1 << 30))
