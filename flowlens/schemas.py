"""Column contracts shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_D, _S, _L, _I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()

FLOW_SCHEMA = _struct(dur=_D, proto=_S, saddr=_S, sport=_S, daddr=_S, dport=_S,
                      spkts=_L, dpkts=_L, sbytes=_L, dbytes=_L, state=_S)

PACKET_SCHEMA = _struct(t=_D, ip_proto=_S, v6_nxt=_S, ip_src=_S, ip_dst=_S, v6_src=_S, v6_dst=_S,
                        tcp_sp=_S, tcp_dp=_S, udp_sp=_S, udp_dp=_S, flen=_L)

LABELLED_FLOW_SCHEMA = T.StructType(
    FLOW_SCHEMA.fields + _struct(y_true=_I, attack_type=_S, rep=_I, iteration=_I, row_id=_L).fields)

PRED_COLUMNS = ["row_id", "attack_type", "y_true", "y_score", "y_pred"]

# Exporter headers and the canonical names they map to.
EXPORTER_HEADERS = {
    "Dur": "dur",
    "Proto": "proto",
    "SrcAddr": "saddr",
    "Sport": "sport",
    "DstAddr": "daddr",
    "Dport": "dport",
    "SrcPkts": "spkts",
    "DstPkts": "dpkts",
    "SrcBytes": "sbytes",
    "DstBytes": "dbytes",
    "State": "state",
}

# Columns a labelled flow table must have before labelling.
REQUIRED_FLOW_COLUMNS = ["saddr", "daddr", "dur", "proto", "spkts", "dpkts", "sbytes", "dbytes", "state"]

# Numeric columns of a flow table.
FLOW_NUMERIC = ["dur", "spkts", "dpkts", "sbytes", "dbytes"]

# Feature lists.
FEATURE_SETS = {
    "portable": ["dur", "proto", "state", "spkts", "dpkts", "sbytes", "dbytes"],
    "ports": ["dur", "proto", "state", "spkts", "dpkts", "sbytes", "dbytes", "sport", "dport"],
}

# Identifier and leakage columns, by kind of table.
LEAKAGE_COLUMNS = {
    "benchmark": ["id", "ID", "srcip", "dstip", "stime", "ltime"],
    "day": ["Flow ID", "FlowID", "Source IP", "Src IP", "srcip", "src_ip", "Destination IP", "Dst IP",
            "dstip", "dst_ip", "Timestamp", "TimeStamp", "time", "timestamp"],
    "day_model": ["Flow ID", "Timestamp", "Src IP", "Dst IP", "Source IP", "Destination IP",
                  "src_ip", "dst_ip", "flow_id", "timestamp"],
}

# Protocol numbers and names.
PROTOCOL_NAMES = {1: "icmp", 6: "tcp", 17: "udp", 58: "ipv6-icmp"}

# Weekdays looked for in file names.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]

# Columns that never count as features in a shift report.
LABEL_COLUMNS = ["Label", "label", "y_true", "y_pred", "y_score"]
