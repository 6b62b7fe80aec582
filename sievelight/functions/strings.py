"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 32 symbols of the text token.
ALPHABET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: Fixed value: the digits of base 32 without I, L, O and U.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Generator of the token's checksum.
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def squeeze(x: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(x), r"\s", "")


def runs(x: Column, alphabet: str = ALPHABET) -> Column:
    """Maximal runs of symbols of the alphabet."""
    return F.regexp_extract_all(x, F.lit(f"[{alphabet}]+"), F.lit(0))


def wrap(x: Column, width: int) -> Column:
    return F.regexp_extract_all(x, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def grouped(x: Column, size: int = 4, sep: str = "-") -> Column:
    return F.regexp_replace(x, f"(.{{{size}}})(?=.)", f"$1{sep}")


def wrapped_lines(x: Column, budget: int) -> Column:
    """Number of lines of a greedy word wrap; a word longer than the budget has a line of its own."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"))

    def step(s: Column, w: Column) -> Column:
        fits = (s.lines > 0) & (s.used + 1 + F.length(w) <= budget)
        return F.struct(F.when(fits, s.lines).otherwise(s.lines + 1).alias("lines"), F.when(fits, s.used + 1 + F.length(w)).otherwise(F.length(w)).alias("used"))

    return F.aggregate(words, start, step, lambda s: s.lines)


def five_bits(hexed: Column, n_bytes: int) -> Column:
    """array<int>: bytes (as hex text) cut into groups of five bits, the highest first, zeros behind the last."""
    groups = -(-8 * n_bytes // 5)
    four = lambda h, k: F.lpad(F.conv(F.substr(h, k, F.lit(1)), 16, 2), 4, "0")
    bits = lambda h: F.rpad(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2 * n_bytes)), lambda k: four(h, k)), ""), 5 * groups, "0")
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda k: F.conv(F.substr(b, k * 5 + 1, F.lit(5)), 2, 10).cast("int"))
    # arrays of one element, so that the digest and the bits are made once a row
    return F.transform(F.transform(F.array(hexed), lambda h: F.when(h.isNotNull(), bits(h))), cut)[0]


def symbols(values: Column, alphabet: str = ALPHABET) -> Column:
    return F.array_join(F.transform(values, lambda v: F.substr(F.lit(alphabet), v + 1, F.lit(1))), "")


def from_base32(x: Column, n_bytes: int) -> Column:
    """Hex text of exactly n_bytes written in the digits BASE32; hyphens and white space are skipped, O is 0, I and L are 1.

    Null for other characters, too few or too many of them, or bits behind the last byte that aren't zero.
    """
    clean = F.translate(F.upper(F.regexp_replace(x, r"[-\s]", "")), "OIL", "011")
    place = lambda c: F.instr(F.lit(BASE32), c) - 1
    bits = F.array_join(F.transform(F.split(clean, ""), lambda c: F.when(c == "", "").otherwise(F.lpad(F.bin(place(c)), 5, "0"))), "")
    spare = F.length(bits) - 8 * n_bytes
    good = clean.rlike(f"^[{BASE32}]*$") & spare.between(0, 7) & ~F.substr(bits, F.lit(8 * n_bytes + 1)).contains("1")
    read = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2 * n_bytes - 1)), lambda k: F.conv(F.substr(b, k * 4 + 1, F.lit(4)), 2, 16)), "")
    return F.when(good, F.lower(F.transform(F.array(bits), read)[0]))


def polymod(values: Column) -> Column:
    """The checksum's remainder over 5-bit values, as a long."""

    def step(c: Column, v: Column) -> Column:
        top = F.shiftright(c, 25)
        out = F.shiftleft(c.bitwiseAND(F.lit(0x1FFFFFF).cast("long")), 5).bitwiseXOR(v.cast("long"))
        for k, g in enumerate(GENERATOR):
            out = out.bitwiseXOR(F.shiftright(top, k).bitwiseAND(F.lit(1).cast("long")) * F.lit(g).cast("long"))
        return out

    return F.aggregate(values, F.lit(1).cast("long"), step)


def touched_bytes(chars: Column, n_bytes: int) -> Column:
    """Distinct bytes that the 5-bit characters at these places overlap: {5i div 8, (5i+4) div 8} below n_bytes."""
    both = F.flatten(F.transform(chars, lambda i: F.array(F.floor(i * 5 / 8), F.floor((i * 5 + 4) / 8))))
    return F.array_sort(F.array_distinct(F.filter(both, lambda b: b < n_bytes)))


def half_up_div(a: Column, b: int) -> Column:
    """Integer division rounding halves up, for negatives too."""
    return F.floor((a * 2 + b) / (2 * b))


def extract_token(text: Column, sentinel: str, length: int, erased: str = "?") -> Column:
    """struct<token, method>: the first `length` symbols from a sentinel on, else the trailing ones of a long enough run.

    White space never counts. In each run the exact places of the sentinel hold; only where a run has none, places at which
    some of its symbols are erased, one at least being there.
    """
    n = len(sentinel)
    like = "".join(f"[{c}{erased}]" for c in sentinel)
    places = lambda r: F.when(F.length(r) >= length, F.sequence(F.lit(1), F.length(r) - (length - 1))).otherwise(F.array().cast("array<int>"))
    every = lambda r: F.when(F.length(r) >= n, F.sequence(F.lit(1), F.length(r) - (n - 1))).otherwise(F.array().cast("array<int>"))
    at = lambda r, i: F.substr(r, i, F.lit(n))
    exact = lambda r: F.filter(every(r), lambda i: at(r, i) == sentinel)
    loose = lambda r: F.filter(places(r), lambda i: at(r, i).rlike(f"^{like}$") & (at(r, i) != erased * n))
    fits = lambda r: F.when(F.size(exact(r)) > 0, F.filter(exact(r), lambda i: i <= F.length(r) - (length - 1))).otherwise(loose(r))
    found = runs(squeeze(text), ALPHABET + erased)
    marked = F.get(F.flatten(F.transform(found, lambda r: F.transform(fits(r), lambda i: F.substr(r, i, F.lit(length))))), F.lit(0))
    tail = F.get(F.transform(F.filter(found, lambda r: F.length(r) >= length), lambda r: F.right(r, F.lit(length))), F.lit(0))
    return F.struct(F.coalesce(marked, tail).alias("token"), F.when(marked.isNotNull(), "sentinel").when(tail.isNotNull(), "length-run").alias("method"))


def prefix_values(prefix: str) -> list[int]:
    """The human-readable part as 5-bit values: high bits, 0, low bits."""
    return [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix)]


def with_checksum(values: Column, prefix: str) -> Column:
    """The values and six more that make the remainder 1."""
    head = F.array(*map(F.lit, prefix_values(prefix)))
    left = lambda v: polymod(F.concat(head, v, F.array_repeat(F.lit(0), 6))).bitwiseXOR(F.lit(1).cast("long"))
    return F.transform(F.array(values), lambda v: F.concat(v, F.transform(F.array(left(v)), lambda m: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.pmod(F.floor(m / F.pow(F.lit(32.0), 5 - k)), F.lit(32)).cast("int")))[0]))[0]


def checksum_holds(values: Column, prefix: str) -> Column:
    return polymod(F.concat(F.array(*map(F.lit, prefix_values(prefix))), values)) == 1


def values_of(token: Column, alphabet: str = ALPHABET) -> Column:
    """array<int>: the place of each symbol; null for one that is none."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c) - 1))


def stride(n: int) -> int:
    """The least number from the root of n on that shares no factor with n."""
    from math import gcd, isqrt

    s = max(1, isqrt(n))
    while gcd(s, n) != 1:
        s += 1
    return s


def interleaved(values: Column, n: int, back: bool = False) -> Column:
    """An array of n values read in steps of the stride; back: undone."""
    step = pow(stride(n), -1, n) if back and n > 1 else stride(n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(values, ((k * step) % n + 1).cast("int")))


def counted_int(seed: Column, bound: int, tries: int = 8) -> Column:
    """An even draw below bound from SHA-256 of seed and a counter: the first of 32-bit words that isn't beyond the last whole multiple of bound."""
    top = (1 << 32) // bound * bound
    words = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: F.conv(F.substring(F.sha2(F.concat_ws(":", seed, k.cast("string")), 256), 1, 8), 16, 10).cast("long"))
    return F.get(F.filter(words, lambda w: w < top), F.lit(0)) % bound


def isqrt(x: Column) -> Column:
    """The integer square root of a long below 2**53, corrected where floating point rounds up."""
    r = F.floor(F.sqrt(x.cast("double")))
    return F.when(r * r > x, r - 1).when((r + 1) * (r + 1) <= x, r + 1).otherwise(r)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def differing_bytes(a: Column, b: Column, n_bytes: int) -> Column:
    """How many bytes of two arrays of 5-bit values differ, once both are packed."""
    bits = lambda v: F.array_join(F.transform(v, lambda x: F.lpad(F.bin(x), 5, "0")), "")
    packed = F.array(F.struct(bits(a).alias("a"), bits(b).alias("b")))
    return F.transform(packed, lambda p: F.size(F.filter(F.sequence(F.lit(0), F.lit(n_bytes - 1)), lambda k: F.substr(p.a, k * 8 + 1, F.lit(8)) != F.substr(p.b, k * 8 + 1, F.lit(8)))))[0]
