"""Turning raw records into canonical flow tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import cleaning as C
from flowlens.functions.relational import attach, require_columns
from flowlens.schemas import EXPORTER_HEADERS, FLOW_NUMERIC, LEAKAGE_COLUMNS, REQUIRED_FLOW_COLUMNS


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without outer spaces; inner spaces stay."""
    return df.toDF(*[name.strip() for name in df.columns])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lower() for name in df.columns])


def canonical_names(df: DataFrame, names: Mapping[str, str] = EXPORTER_HEADERS,
                    only_if_absent: bool = False) -> DataFrame:
    """Exporter headers to canonical names; optionally only where the canonical name is not taken."""
    wanted = {old: new for old, new in names.items()
              if old in df.columns and not (only_if_absent and new in df.columns)}
    return df.withColumnsRenamed(wanted)


def trim_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trimmed text with null as ``nan``, for the listed columns that exist."""
    return df.withColumns({c: C.text_or_nan(F.col(f"`{c}`")) for c in columns if c in df.columns})


def numbers_or_zero(df: DataFrame, columns: Sequence[str] = FLOW_NUMERIC) -> DataFrame:
    return df.withColumns({c: C.number_or_zero(F.col(f"`{c}`")) for c in columns if c in df.columns})


def numbers_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: C.number_or_null(F.col(f"`{c}`")) for c in columns if c in df.columns})


def finite_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: C.finite_number(F.col(f"`{c}`")) for c in columns})


def drop_leakage(df: DataFrame, kind: str) -> DataFrame:
    """Without the identifier and leakage columns of that kind of table."""
    return df.drop(*[c for c in df.columns if c in LEAKAGE_COLUMNS[kind]])


def one_label(df: DataFrame) -> DataFrame:
    """The label column under the name ``Label``, or an error if there is none."""
    if "Label" in df.columns:
        return df
    return require_columns(df, ["label"]).withColumnRenamed("label", "Label")


def labelled_only(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows with a label, the label trimmed. Missing labels go before the text is touched."""
    return df.where(F.col(label).isNotNull()).withColumn(label, F.trim(F.col(label).cast("string")))


def drop_junk_addresses(df: DataFrame) -> DataFrame:
    return df.where((F.col("saddr") != "0") & (F.col("daddr") != "0"))


def ipv6_only(df: DataFrame) -> DataFrame:
    return df.where(F.contains("saddr", F.lit(":")) & F.contains("daddr", F.lit(":")))


def with_defaults(df: DataFrame, columns: Sequence[str], numeric: Sequence[str],
                  as_is: Sequence[str] = ()) -> DataFrame:
    """Just ``columns``; missing ones are added as 0 or ``unk``, and present ones read leniently."""
    def expression(name: str):
        if name in as_is:
            return F.col(name)
        if name in numeric:
            return (C.number_or_zero(F.col(name)) if name in df.columns else F.lit(0.0)).alias(name)
        return (F.coalesce(F.col(name).cast("string"), F.lit("unk")) if name in df.columns else F.lit("unk")).alias(name)
    return df.select(*[expression(c) for c in columns])


def clean_flows(df: DataFrame) -> DataFrame:
    """Raw exporter records to usable IPv6 flows: names, addresses, numbers."""
    named = require_columns(canonical_names(strip_names(df)), REQUIRED_FLOW_COLUMNS)
    return numbers_or_zero(ipv6_only(drop_junk_addresses(trim_text(named, ["saddr", "daddr"]))))


def clean_day_table(df: DataFrame, keep: Sequence[str] = ("day",)) -> DataFrame:
    """Day flow table: no leakage columns, one trimmed label, every text feature read as a finite number."""
    tidy = labelled_only(one_label(drop_leakage(strip_names(df), "day")))
    features = [f.name for f in tidy.schema.fields if f.name not in ("Label", *keep)
                and isinstance(f.dataType, (T.StringType, T.DoubleType, T.FloatType))]
    return finite_or_null(tidy, features)


# --- packets ------------------------------------------------------------------------------------------

def transport_packets(packets: DataFrame) -> DataFrame:
    """IP packets over TCP or UDP."""
    has_ip = F.col("ip_src").isNotNull() | F.col("v6_src").isNotNull()
    has_ports = (F.col("tcp_sp").isNotNull() | F.col("tcp_dp").isNotNull()
                 | F.col("udp_sp").isNotNull() | F.col("udp_dp").isNotNull())
    return packets.where(has_ip & has_ports)


def packet_endpoints(packets: DataFrame) -> DataFrame:
    """Adds ``saddr, daddr, sport, dport, transport`` with IPv6 and TCP preferred."""
    return packets.withColumns({
        "saddr": C.first_filled(F.col("v6_src"), F.col("ip_src")),
        "daddr": C.first_filled(F.col("v6_dst"), F.col("ip_dst")),
        "sport": C.first_filled(F.col("tcp_sp"), F.col("udp_sp")),
        "dport": C.first_filled(F.col("tcp_dp"), F.col("udp_dp")),
        "transport": C.transport_by_port([F.col("tcp_sp"), F.col("tcp_dp")]),
        "protocol": C.protocol_name(F.coalesce(F.col("v6_nxt"), F.col("ip_proto"))),
    })


def usable_packets(packets: DataFrame) -> DataFrame:
    """Packets with a time and both addresses."""
    return packets.where(F.col("t").isNotNull() & ~F.isnan("t")
                         & F.col("saddr").isNotNull() & F.col("daddr").isNotNull())


def first_packets(packets: DataFrame, k: int, key: str) -> DataFrame:
    """The first ``k`` packets in time order; all of them if ``k`` is 0."""
    return packets.orderBy("t", key).limit(k) if k > 0 else packets


def min_max_scores(df: DataFrame, score: str = "y_score") -> DataFrame:
    """Scores scaled to [0, 1] if any lies outside it."""
    ends = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    inside = (F.col("__lo") >= 0) & (F.col("__hi") <= 1)
    scaled = (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-12))
    return (attach(df, ends, [])
            .withColumn(score, F.when(inside, F.col(score)).otherwise(scaled)).drop("__lo", "__hi"))
