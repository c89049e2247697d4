"""Renderers: flow values to text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FLOW_TYPES, LAYERS
from .names import ETYPES, ICMP6_TYPES, ICMP_TYPES, PROTOCOL_NAMES, PROTOCOL_RANGES
from .values import timestamp_of_ns


def looked_up(key: Column, table: Mapping[int, str], default: str = "") -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, key.cast("int")), F.lit(default))


def ipv4(b: Column) -> Column:
    hex_ = F.hex(b)
    return F.concat_ws(".", *[F.conv(F.substring(hex_, i, 2), 16, 10) for i in (1, 3, 5, 7)])


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ipv6(b: Column) -> Column:
    """RFC 5952: small letters, no leading zeros, the first longest run of zero groups as ``::``."""

    def shortened(groups: Column) -> Column:
        def text(zeros: Column) -> Column:
            out = F.array_join(groups, ":")
            for run in range(2, 9):  # the longest is tested last, so it stands outermost
                at = F.instr(zeros, "0" * run)
                short = F.concat(F.array_join(F.slice(groups, 1, at - 1), ":"), F.lit("::"), F.array_join(F.slice(groups, at + run, 8), ":"))
                out = F.when(at > 0, short).otherwise(out)
            return out

        return bound(F.array_join(F.transform(groups, lambda g: F.when(g == "0", "0").otherwise("1")), ""), text)

    def split(hex_: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.regexp_replace(F.substr(hex_, i, F.lit(4)), "^0{1,3}", ""))
        mapped = F.substring(hex_, 1, 24) == "00000000000000000000ffff"
        return F.when(mapped, F.concat(F.lit("::ffff:"), ipv4(F.unhex(F.substring(hex_, 25, 8))))).otherwise(bound(groups, shortened))

    return bound(F.lower(F.hex(b)), split)


def ip(b: Column) -> Column:
    """4 or 16 bytes as address text, else an empty text."""
    return F.when(F.length(b) == 4, ipv4(b)).when(F.length(b) == 16, ipv6(b)).otherwise("")


def mac(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.lpad(F.hex(value), 12, "0")), "(..)(?!$)", "$1:")


def etype(value: Column) -> Column:
    return looked_up(value, ETYPES)


def protocol(value: Column) -> Column:
    out = F.try_element_at(F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair]), value.cast("int"))
    for low, high, name in PROTOCOL_RANGES:
        out = F.when(value.between(low, high), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def icmp(proto: Column, kind: Column) -> Column:
    return F.when(proto == 1, looked_up(kind, ICMP_TYPES)).when(proto == 58, looked_up(kind, ICMP6_TYPES)).otherwise("unknown")


def network(address: Column, prefix: Column) -> Column:
    """address masked to prefix bits, as CIDR text; ``invalid Prefix`` where that does not fit."""
    size = F.length(address)
    fits = size.isin(4, 16) & prefix.between(0, size * 8)
    hex_ = F.hex(address)

    def nibble(i: Column) -> Column:
        keep = F.greatest(F.lit(0), F.least(F.lit(4), prefix.cast("int") - 4 * (i - 1)))
        value = F.conv(F.substring(hex_, i, 1), 16, 10).cast("int")
        return F.hex(value - F.pmod(value, F.pow(F.lit(2), 4 - keep).cast("int")))

    masked = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size * 2)), nibble), ""))
    return F.when(fits, F.concat(ip(masked), F.lit("/"), prefix.cast("string"))).otherwise("invalid Prefix")


def datetime(seconds: Column) -> Column:
    """Seconds as RFC 3339 in UTC (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def datetime_nano(ns: Column) -> Column:
    """Nanoseconds as RFC 3339; trailing zeros of the fraction are left out."""
    fraction = F.regexp_replace(F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), "0+$", "")
    dotted = F.when(F.length(fraction) > 0, F.concat(F.lit("."), fraction)).otherwise("")
    return F.concat(F.date_format(timestamp_of_ns(ns), "yyyy-MM-dd'T'HH:mm:ss"), dotted, F.lit("Z"))


def plain(value: Column, kind: str) -> Column:
    """Bytes as small hex digits, others in decimals."""
    return F.lower(F.hex(value)) if kind == "binary" else value


def string(value: Column) -> Column:
    return F.decode(value, "UTF-8")


def flow_type(value: Column) -> Column:
    return looked_up(value, FLOW_TYPES, "UNKNOWN")


def layer(value: Column) -> Column:
    return looked_up(value, LAYERS, "UNKNOWN")


Renderer = Callable[[Column], Column]
RENDERERS: dict[str, Renderer] = {
    "none": lambda c: c,
    "ip": ip,
    "mac": mac,
    "etype": etype,
    "proto": protocol,
    "datetime": datetime,
    "datetimenano": datetime_nano,
    "string": string,
}

#: Renderers that columns have unless the configuration gives another.
DEFAULTS: dict[str, Renderer] = {
    "type": flow_type, "src_mac": mac, "dst_mac": mac, "src_addr": ip, "dst_addr": ip, "sampler_address": ip, "next_hop": ip,
    "bgp_next_hop": ip, "mpls_ip": ip, "etype": etype, "proto": protocol, "ipv6_routing_header_addresses": ip, "layer_stack": layer,
    "src_net": lambda c: network(F.col("src_addr"), c), "dst_net": lambda c: network(F.col("dst_addr"), c),
}

#: Columns that exist only when rendered.
VIRTUAL: dict[str, Callable[[], Column]] = {"icmp_name": lambda: icmp(F.col("proto"), F.col("icmp_type"))}
