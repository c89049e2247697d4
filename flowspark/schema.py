"""The normalised flow record and the input schemas."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, B = T.LongType(), T.IntegerType(), T.BinaryType()
LONGS, INTS, BINARIES = T.ArrayType(L), T.ArrayType(I), T.ArrayType(B)

#: Columns of a flow in output order, with their protobuf tags.
FLOW_FIELDS = (
    ("type", I, 1), ("time_received_ns", L, 110), ("sequence_num", L, 4), ("sampling_rate", L, 3), ("sampler_address", B, 11),
    ("time_flow_start_ns", L, 111), ("time_flow_end_ns", L, 112), ("bytes", L, 9), ("packets", L, 10), ("src_addr", B, 6),
    ("dst_addr", B, 7), ("etype", L, 30), ("proto", L, 20), ("src_port", L, 21), ("dst_port", L, 22), ("in_if", L, 18),
    ("out_if", L, 19), ("src_mac", L, 27), ("dst_mac", L, 28), ("src_vlan", L, 33), ("dst_vlan", L, 34), ("vlan_id", L, 29),
    ("ip_tos", L, 23), ("forwarding_status", L, 24), ("ip_ttl", L, 25), ("ip_flags", L, 38), ("tcp_flags", L, 26),
    ("icmp_type", L, 31), ("icmp_code", L, 32), ("ipv6_flow_label", L, 37), ("fragment_id", L, 35), ("fragment_offset", L, 36),
    ("src_as", L, 14), ("dst_as", L, 15), ("next_hop", B, 12), ("next_hop_as", L, 13), ("src_net", L, 16), ("dst_net", L, 17),
    ("bgp_next_hop", B, 100), ("bgp_communities", LONGS, 101), ("as_path", LONGS, 102), ("mpls_ttl", LONGS, 80),
    ("mpls_label", LONGS, 81), ("mpls_ip", BINARIES, 82), ("observation_domain_id", L, 70), ("observation_point_id", L, 71),
    ("layer_stack", INTS, 103), ("layer_size", LONGS, 104), ("ipv6_routing_header_addresses", BINARIES, 105),
    ("ipv6_routing_header_seg_left", L, 106),
)
FLOW_SCHEMA = T.StructType([T.StructField(n, t) for n, t, _ in FLOW_FIELDS])
FLOW_COLUMNS = [n for n, _, _ in FLOW_FIELDS]
FLOW_TAGS = {n: tag for n, _, tag in FLOW_FIELDS}

#: Flow types and packet layers by number.
FLOW_TYPES = {0: "FLOWUNKNOWN", 1: "SFLOW_5", 2: "NETFLOW_V5", 3: "NETFLOW_V9", 4: "IPFIX"}
LAYERS = {
    0: "Ethernet", 1: "IPv4", 2: "IPv6", 3: "TCP", 4: "UDP", 5: "MPLS", 6: "Dot1Q", 7: "ICMP", 8: "ICMPv6", 9: "GRE",
    10: "IPv6HeaderRouting", 11: "IPv6HeaderFragment", 12: "Geneve", 13: "Teredo", 99: "Custom",
}

DATAGRAM_SCHEMA = T.StructType([
    T.StructField("src_addr", B), T.StructField("src_port", I), T.StructField("dst_addr", B), T.StructField("dst_port", I),
    T.StructField("payload", B), T.StructField("received_ns", L), T.StructField("seq", L),
])
DATAGRAM_COLUMNS = DATAGRAM_SCHEMA.names


_BLANK = {n: b"" if isinstance(t, T.BinaryType) else 0 for n, t, _ in FLOW_FIELDS}
_LISTS = [n for n, t, _ in FLOW_FIELDS if isinstance(t, T.ArrayType)]


def empty_flow() -> dict:
    """A flow whose every field is unset: zero, empty bytes or an empty list, never null."""
    out = dict(_BLANK)
    for n in _LISTS:
        out[n] = []
    return out
