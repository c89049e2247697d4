"""Fixed values, all tables of this module: names of ethertypes, protocols, ICMP types, version 9 and IPFIX fields, by number."""

ETYPES = {0x806: "ARP", 0x800: "IPv4", 0x86DD: "IPv6"}

#: Internet protocols.
PROTOCOL_NAMES = {
    0: "HOPOPT", 1: "ICMP", 2: "IGMP", 3: "GGP", 4: "IPv4", 5: "ST", 6: "TCP", 7: "CBT", 8: "EGP", 9: "IGP", 10: "BBN-RCC-MON", 11: "NVP-II",
    12: "PUP", 13: "ARGUS", 14: "EMCON", 15: "XNET", 16: "CHAOS", 17: "UDP", 18: "MUX", 19: "DCN-MEAS", 20: "HMP", 21: "PRM", 22: "XNS-IDP",
    23: "TRUNK-1", 24: "TRUNK-2", 25: "LEAF-1", 26: "LEAF-2", 27: "RDP", 28: "IRTP", 29: "ISO-TP4", 30: "NETBLT", 31: "MFE-NSP", 32: "MERIT-INP",
    33: "DCCP", 34: "3PC", 35: "IDPR", 36: "XTP", 37: "DDP", 38: "IDPR-CMTP", 39: "TP++", 40: "IL", 41: "IPv6", 42: "SDRP", 43: "IPv6-Route",
    44: "IPv6-Frag", 45: "IDRP", 46: "RSVP", 47: "GRE", 48: "DSR", 49: "BNA", 50: "ESP", 51: "AH", 52: "I-NLSP", 53: "SWIPE", 54: "NARP",
    55: "Min-IPv4", 56: "TLSP", 57: "SKIP", 58: "IPv6-ICMP", 59: "IPv6-NoNxt", 60: "IPv6-Opts", 61: "any-host-internal-protocol", 62: "CFTP",
    63: "any-local-network", 64: "SAT-EXPAK", 65: "KRYPTOLAN", 66: "RVD", 67: "IPPC", 68: "any-distributed-file-system", 69: "SAT-MON", 70: "VISA",
    71: "IPCV", 72: "CPNX", 73: "CPHB", 74: "WSN", 75: "PVP", 76: "BR-SAT-MON", 77: "SUN-ND", 78: "WB-MON", 79: "WB-EXPAK", 80: "ISO-IP", 81: "VMTP",
    82: "SECURE-VMTP", 83: "VINES", 84: "IPTM", 85: "NSFNET-IGP", 86: "DGP", 87: "TCF", 88: "EIGRP", 89: "OSPFIGP", 90: "Sprite-RPC", 91: "LARP",
    92: "MTP", 93: "AX.25", 94: "IPIP", 95: "MICP", 96: "SCC-SP", 97: "ETHERIP", 98: "ENCAP", 99: "any-private-encryption-scheme", 100: "GMTP",
    101: "IFMP", 102: "PNNI", 103: "PIM", 104: "ARIS", 105: "SCPS", 106: "QNX", 107: "A/N", 108: "IPComp", 109: "SNP", 110: "Compaq-Peer",
    111: "IPX-in-IP", 112: "VRRP", 113: "PGM", 114: "any-0-hop-protocol", 115: "L2TP", 116: "DDX", 117: "IATP", 118: "STP", 119: "SRP", 120: "UTI",
    121: "SMP", 122: "SM", 123: "PTP", 124: "ISIS over IPv4", 125: "FIRE", 126: "CRTP", 127: "CRUDP", 128: "SSCOPMCE", 129: "IPLT", 130: "SPS",
    131: "PIPE", 132: "SCTP", 133: "FC", 134: "RSVP-E2E-IGNORE", 135: "Mobility Header", 136: "UDPLite", 137: "MPLS-in-IP", 138: "manet", 139: "HIP",
    140: "Shim6", 141: "WESP", 142: "ROHC", 143: "Ethernet", 144: "AGGFRAG", 145: "NSH",
}
PROTOCOL_RANGES = ((146, 252, "unassigned"), (253, 254, "experimental"), (255, 255, "reserved"))

ICMP_TYPES = {0: "EchoReply", 3: "DestinationUnreachable", 8: "Echo", 9: "RouterAdvertisement", 10: "RouterSolicitation", 11: "TimeExceeded"}
ICMP6_TYPES = {
    1: "DestinationUnreachable", 2: "PacketTooBig", 3: "TimeExceeded", 128: "EchoRequest", 129: "EchoReply",
    133: "RouterSolicitation", 134: "RouterAdvertisement",
}

#: NetFlow version 9 field types.
V9_FIELDS = {
    1: "IN_BYTES", 2: "IN_PKTS", 3: "FLOWS", 4: "PROTOCOL", 5: "SRC_TOS", 6: "TCP_FLAGS", 7: "L4_SRC_PORT", 8: "IPV4_SRC_ADDR",
    9: "SRC_MASK", 10: "INPUT_SNMP", 11: "L4_DST_PORT", 12: "IPV4_DST_ADDR", 13: "DST_MASK", 14: "OUTPUT_SNMP",
    15: "IPV4_NEXT_HOP", 16: "SRC_AS", 17: "DST_AS", 18: "BGP_IPV4_NEXT_HOP", 19: "MUL_DST_PKTS", 20: "MUL_DST_BYTES",
    21: "LAST_SWITCHED", 22: "FIRST_SWITCHED", 23: "OUT_BYTES", 24: "OUT_PKTS", 25: "MIN_PKT_LNGTH", 26: "MAX_PKT_LNGTH",
    27: "IPV6_SRC_ADDR", 28: "IPV6_DST_ADDR", 29: "IPV6_SRC_MASK", 30: "IPV6_DST_MASK", 31: "IPV6_FLOW_LABEL", 32: "ICMP_TYPE",
    33: "MUL_IGMP_TYPE", 34: "SAMPLING_INTERVAL", 35: "SAMPLING_ALGORITHM", 36: "FLOW_ACTIVE_TIMEOUT",
    37: "FLOW_INACTIVE_TIMEOUT", 38: "ENGINE_TYPE", 39: "ENGINE_ID", 40: "TOTAL_BYTES_EXP", 41: "TOTAL_PKTS_EXP",
    42: "TOTAL_FLOWS_EXP", 44: "IPV4_SRC_PREFIX", 45: "IPV4_DST_PREFIX", 46: "MPLS_TOP_LABEL_TYPE",
    47: "MPLS_TOP_LABEL_IP_ADDR", 48: "FLOW_SAMPLER_ID", 49: "FLOW_SAMPLER_MODE", 50: "FLOW_SAMPLER_RANDOM_INTERVAL",
    52: "MIN_TTL", 53: "MAX_TTL", 54: "IPV4_IDENT", 55: "DST_TOS", 56: "IN_SRC_MAC", 57: "OUT_DST_MAC", 58: "SRC_VLAN",
    59: "DST_VLAN", 60: "IP_PROTOCOL_VERSION", 61: "DIRECTION", 62: "IPV6_NEXT_HOP", 63: "BGP_IPV6_NEXT_HOP",
    64: "IPV6_OPTION_HEADERS", 70: "MPLS_LABEL_1", 71: "MPLS_LABEL_2", 72: "MPLS_LABEL_3", 73: "MPLS_LABEL_4",
    74: "MPLS_LABEL_5", 75: "MPLS_LABEL_6", 76: "MPLS_LABEL_7", 77: "MPLS_LABEL_8", 78: "MPLS_LABEL_9", 79: "MPLS_LABEL_10",
    80: "IN_DST_MAC", 81: "OUT_SRC_MAC", 82: "IF_NAME", 83: "IF_DESC", 84: "SAMPLER_NAME", 85: "IN_PERMANENT_BYTES",
    86: "IN_PERMANENT_PKTS", 88: "FRAGMENT_OFFSET", 89: "FORWARDING_STATUS", 90: "MPLS_PAL_RD", 91: "MPLS_PREFIX_LEN",
    92: "SRC_TRAFFIC_INDEX", 93: "DST_TRAFFIC_INDEX", 94: "APPLICATION_DESCRIPTION", 95: "APPLICATION_TAG",
    96: "APPLICATION_NAME", 98: "postipDiffServCodePoint", 99: "replication_factor",
}
V9_SCOPES = {1: "System", 2: "Interface", 3: "Line Card", 4: "NetFlow Cache", 5: "Template"}


#: IPFIX information elements, those that flows commonly carry; ipfix_elements() reads the whole registry.
IPFIX_FIELDS = {
    1: "octetDeltaCount", 2: "packetDeltaCount", 3: "deltaFlowCount", 4: "protocolIdentifier", 5: "ipClassOfService", 6: "tcpControlBits",
    7: "sourceTransportPort", 8: "sourceIPv4Address", 9: "sourceIPv4PrefixLength", 10: "ingressInterface", 11: "destinationTransportPort",
    12: "destinationIPv4Address", 13: "destinationIPv4PrefixLength", 14: "egressInterface", 15: "ipNextHopIPv4Address", 16: "bgpSourceAsNumber",
    17: "bgpDestinationAsNumber", 18: "bgpNextHopIPv4Address", 19: "postMCastPacketDeltaCount", 20: "postMCastOctetDeltaCount",
    21: "flowEndSysUpTime", 22: "flowStartSysUpTime", 23: "postOctetDeltaCount", 24: "postPacketDeltaCount", 25: "minimumIpTotalLength",
    26: "maximumIpTotalLength", 27: "sourceIPv6Address", 28: "destinationIPv6Address", 29: "sourceIPv6PrefixLength",
    30: "destinationIPv6PrefixLength", 31: "flowLabelIPv6", 32: "icmpTypeCodeIPv4", 33: "igmpType", 34: "samplingInterval",
    35: "samplingAlgorithm", 36: "flowActiveTimeout", 37: "flowIdleTimeout", 38: "engineType", 39: "engineId", 40: "exportedOctetTotalCount",
    41: "exportedMessageTotalCount", 42: "exportedFlowRecordTotalCount", 44: "sourceIPv4Prefix", 45: "destinationIPv4Prefix",
    46: "mplsTopLabelType", 47: "mplsTopLabelIPv4Address", 48: "samplerId", 49: "samplerMode", 50: "samplerRandomInterval", 52: "minimumTTL",
    53: "maximumTTL", 54: "fragmentIdentification", 55: "postIpClassOfService", 56: "sourceMacAddress", 57: "postDestinationMacAddress",
    58: "vlanId", 59: "postVlanId", 60: "ipVersion", 61: "flowDirection", 62: "ipNextHopIPv6Address", 63: "bgpNextHopIPv6Address",
    64: "ipv6ExtensionHeaders", 70: "mplsTopLabelStackSection", 71: "mplsLabelStackSection2", 72: "mplsLabelStackSection3",
    80: "destinationMacAddress", 81: "postSourceMacAddress", 82: "interfaceName", 83: "interfaceDescription", 85: "octetTotalCount",
    86: "packetTotalCount", 88: "fragmentOffset", 89: "forwardingStatus", 90: "mplsVpnRouteDistinguisher", 94: "applicationDescription",
    95: "applicationId", 96: "applicationName", 130: "exporterIPv4Address", 131: "exporterIPv6Address", 136: "flowEndReason",
    138: "observationPointId", 139: "icmpTypeCodeIPv6", 140: "mplsTopLabelIPv6Address", 141: "lineCardId", 142: "portId",
    143: "meteringProcessId", 144: "exportingProcessId", 145: "templateId", 148: "flowId", 149: "observationDomainId",
    150: "flowStartSeconds", 151: "flowEndSeconds", 152: "flowStartMilliseconds", 153: "flowEndMilliseconds", 154: "flowStartMicroseconds",
    155: "flowEndMicroseconds", 156: "flowStartNanoseconds", 157: "flowEndNanoseconds", 158: "flowStartDeltaMicroseconds",
    159: "flowEndDeltaMicroseconds", 160: "systemInitTimeMilliseconds", 161: "flowDurationMilliseconds", 176: "icmpTypeIPv4",
    177: "icmpCodeIPv4", 178: "icmpTypeIPv6", 179: "icmpCodeIPv6", 192: "ipTTL", 195: "ipDiffServCodePoint", 197: "fragmentFlags",
    224: "ipTotalLength", 225: "postNATSourceIPv4Address", 226: "postNATDestinationIPv4Address", 227: "postNAPTSourceTransportPort",
    228: "postNAPTDestinationTransportPort", 233: "firewallEvent", 234: "ingressVRFID", 235: "egressVRFID", 239: "biflowDirection",
    243: "dot1qVlanId", 252: "ingressPhysicalInterface", 253: "egressPhysicalInterface", 302: "selectorId", 304: "selectorAlgorithm",
    305: "samplingPacketInterval", 306: "samplingPacketSpace", 312: "dataLinkFrameSize", 315: "dataLinkFrameSection",
}


def ipfix_elements(path: str) -> dict[int, str]:
    """IPFIX element names by number, from IANA's registry as CSV (columns ElementID and Name); ranges and blanks are skipped."""
    import csv

    with open(path, newline="") as f:
        rows = csv.DictReader(f)
        return {int(r["ElementID"]): r["Name"] for r in rows if r["ElementID"].isdigit() and r["Name"]}
