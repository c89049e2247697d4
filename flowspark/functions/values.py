"""Numbers, times and keys as column expressions; nothing here needs a Python worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(payload: Column, offset, length: int) -> Column:
    """An unsigned big-endian integer of 1 to 7 bytes at a byte offset (from 0; may be a column)."""
    at = offset + 1 if isinstance(offset, int) else offset + F.lit(1)
    return F.conv(F.hex(F.substring(payload, at, length)), 16, 10).cast("long")


def floor_div(a: Column, n: int) -> Column:
    """Exact integer division, rounded down; a double's 53 bits do not hold nanoseconds since 1970."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def uint_be(b: Column, bits: int = 64) -> Column:
    """Big-endian bytes as an unsigned number, cut to `bits`; 0 for none, null for more than eight.

    64-bit values above the signed range wrap, as bit patterns, to negatives.
    """
    n = F.length(b)
    wide = F.conv(F.hex(b), 16, -10).cast("long")
    value = F.when(n == 0, F.lit(0).cast("long")).when(n <= 8, wide)
    return value if bits == 64 else F.pmod(value, F.lit(2**bits))


def uint_le(b: Column, bits: int = 64) -> Column:
    return uint_be(reverse_bytes(b), bits)


def reverse_bytes(b: Column) -> Column:
    hex_ = F.hex(b)
    pairs = F.transform(F.sequence(F.length(b), F.lit(1), F.lit(-1)), lambda i: F.substring(hex_, 2 * i - 1, 2))
    return F.when(F.length(b) > 0, F.unhex(F.array_join(pairs, ""))).otherwise(b)


def int_be(b: Column) -> Column:
    """Signed: only 1, 2, 4 and 8 bytes extend their sign; other widths stay unsigned."""
    u = uint_be(b)
    out = u
    for n in (1, 2, 4):
        top = F.lit(2 ** (8 * n - 1))
        out = F.when((F.length(b) == n) & (u >= top), u - 2 * top).otherwise(out)
    return out


def int_le(b: Column) -> Column:
    return int_be(reverse_bytes(b))


def all_zeros(b: Column) -> Column:
    return F.hex(b).rlike("^0*$")


def replace_address(old: Column, new: Column) -> Column:
    """The address that stays: a new one replaces the old unless it is all zeros and the old is set."""
    return F.when((F.length(old) == 0) | ~all_zeros(new), new).otherwise(old)


def unmap_v4(b: Column) -> Column:
    """IPv4 addresses in IPv6 form as four bytes; others as they are."""
    mapped = (F.length(b) == 16) & (F.hex(F.substring(b, 1, 12)) == "00000000000000000000FFFF")
    return F.when(mapped, F.substring(b, 13, 4)).otherwise(b)


def ntp_to_ns(ntp: Column) -> Column:
    """64-bit NTP time (a long's bit pattern) to nanoseconds since 1970; the fraction is cut, not rounded."""
    seconds = F.shiftrightunsigned(ntp, 32) - F.lit(2208988800)
    fraction = ntp.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") * F.lit(1e9) / F.lit(float(2**32))
    return seconds * F.lit(1_000_000_000) + F.floor(fraction).cast("long")


def timestamp_of_ns(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1000))


def bucket_of_ns(ns: Column, seconds: int) -> Column:
    """The start of the ns' bucket, in ns."""
    step = F.lit(seconds * 1_000_000_000)
    return ns - F.pmod(ns, step)


def decimal_text(column: Column, kind: str) -> Column:
    """A value as the partition key sees it: bytes as ``[10 0 0 1]``, lists likewise, numbers in decimals."""
    if kind == "binary":
        hex_ = F.hex(column)
        each = F.transform(F.sequence(F.lit(1), F.length(column)), lambda i: F.conv(F.substring(hex_, 2 * i - 1, 2), 16, 10))
        return F.when(F.length(column) > 0, F.concat(F.lit("["), F.array_join(each, " "), F.lit("]"))).otherwise("[]")
    if kind.startswith("array"):
        inner = kind[len("array<") : -1]
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: decimal_text(x, inner)), " "), F.lit("]"))
    return column.cast("string")


def fnv1_32(text: Column) -> Column:
    """32-bit FNV-1 of a text's UTF-8 bytes, as a long."""
    hex_ = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(hex_) / 2).cast("int")), lambda i: F.conv(F.substring(hex_, 2 * i - 1, 2), 16, 10).cast("long"))
    value = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, o: F.pmod(h * F.lit(16777619), F.lit(2**32)).bitwiseXOR(o))
    return F.when(F.length(hex_) > 0, value).otherwise(F.lit(2166136261).cast("long"))


def partition_key(columns: Sequence[tuple[str, str]]) -> Column:
    """The key of a flow: four bytes of FNV-1 over its key columns (name, type) without separators; null without any."""
    if not columns:
        return F.lit(None).cast("binary")
    text = F.concat(*[decimal_text(F.col(n), k) for n, k in columns])
    return F.unhex(F.lpad(F.hex(fnv1_32(text)), 8, "0"))


def template_key(version: Column, domain: Column, template: Column) -> Column:
    """version << 48 | domain << 16 | template, as one long."""
    return F.shiftleft(version.cast("long"), 48) + F.shiftleft(domain.cast("long"), 16) + template.cast("long")


def template_key_text(key: Column) -> Column:
    version, domain = F.shiftrightunsigned(key, 48), F.shiftrightunsigned(key, 16).bitwiseAND(F.lit(2**32 - 1))
    return F.concat_ws("/", version.cast("string"), domain.cast("string"), key.bitwiseAND(F.lit(65535)).cast("string"))


def parse_template_key(text: Column) -> Column:
    part = F.split(text, "/")
    return F.struct(*[part[i].cast("long").alias(n) for i, n in enumerate(("version", "obs_domain_id", "template_id"))])


def bit_slice(b: Column, offset: int, length: int) -> Column:
    """Bits offset to offset + length - 1 of b as a number, most significant first; bits past the end are zero.  Up to 56 bits."""
    if not 0 < length <= 56:
        raise ValueError("1 to 56 bits")
    first, last = offset // 8, (offset + length - 1) // 8
    n = last - first + 1
    octets = F.rpad(F.substring(F.hex(b), 2 * first + 1, 2 * n), 2 * n, "0")
    high = F.conv(F.substring(octets, 1, min(14, 2 * n)), 16, 10).cast("long")
    if n <= 7:
        return F.shiftrightunsigned(high, 8 * n - (offset % 8) - length).bitwiseAND(F.lit(2**length - 1))
    low = F.conv(F.substring(octets, 15, 2), 16, 10).cast("long")
    drop = 64 - (offset % 8) - length
    return (F.shiftleft(high.bitwiseAND(F.lit(2 ** (56 - offset % 8) - 1)), 8 - drop) + F.shiftrightunsigned(low, drop)).bitwiseAND(F.lit(2**length - 1))
