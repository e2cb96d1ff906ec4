"""Packets to flows: one shuffle on the flow key, with partial sums before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.relational import finite
from flowlens.operators.cleaning import packet_endpoints, transport_packets, usable_packets
from flowlens.schemas import FLOW_SCHEMA

FIVE_TUPLE = ["proto", "saddr", "sport", "daddr", "dport"]


def _flow_columns(df: DataFrame, *extra: str, state: str) -> DataFrame:
    return df.select(*extra, "dur", *FIVE_TUPLE, "spkts", F.lit(0).cast("bigint").alias("dpkts"), "sbytes",
                     F.lit(0).cast("bigint").alias("dbytes"), F.lit(state).alias("state")).select(
        *extra, *FLOW_SCHEMA.names)


def _span() -> Column:
    t = finite(F.col("t"))
    return F.coalesce(F.max(t) - F.min(t), F.lit(0.0))


def directional_flows(packets: DataFrame) -> DataFrame:
    """One flow per protocol, source and destination; missing ports are empty text."""
    keyed = packet_endpoints(transport_packets(packets)).select(
        F.col("transport").alias("proto"), "saddr", F.coalesce("sport", F.lit("")).alias("sport"), "daddr",
        F.coalesce("dport", F.lit("")).alias("dport"), "t", "flen")
    flows = keyed.groupBy(*FIVE_TUPLE).agg(
        _span().alias("dur"), F.count(F.lit(1)).alias("spkts"), F.coalesce(F.sum("flen"), F.lit(0)).alias("sbytes"))
    return _flow_columns(flows, state="NA")


def window_packets(packets: DataFrame) -> DataFrame:
    """Usable packets of any protocol with a numeric port (0 if there is none; ``443.0`` is 443)."""
    ready = usable_packets(packet_endpoints(packets))

    def port(name: str) -> Column:
        number = finite(F.col(name).try_cast("double"))
        return F.coalesce(number.try_cast("bigint"), F.lit(0)).cast("string").alias(name)

    return ready.select(
        F.col("protocol").alias("proto"), "saddr", port("sport"), "daddr", port("dport"), "t",
        F.coalesce("flen", F.lit(0)).alias("flen"))


def windowed_flows(packets: DataFrame, width: float = 1.0) -> DataFrame:
    """Flows per tumbling window of ``width`` seconds counted from the first packet."""
    return window_ablation(packets, [width]).drop("width")


def window_ablation(packets: DataFrame, widths: Sequence[float]) -> DataFrame:
    """Windowed flows for several widths in one pass; ``width`` and ``win`` lead the columns."""
    ready = window_packets(packets)
    start = ready.agg(F.min("t")).scalar()
    spread = ready.withColumn("width", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    placed = spread.withColumn("win", F.floor((F.col("t") - start) / F.col("width")).cast("bigint"))
    flows = placed.groupBy("width", "win", *FIVE_TUPLE).agg(
        (F.max("t") - F.min("t")).alias("dur"), F.count(F.lit(1)).alias("spkts"), F.sum("flen").alias("sbytes"))
    return _flow_columns(flows, "width", "win", state="OK")


def conversations(packets: DataFrame) -> DataFrame:
    """Both directions of a conversation in one flow; the source is who sent its first packet.

    If both sides start at the same time, the lower address counts as the source. Every measure is a plain
    number that is combined before the shuffle, so one conversation with a third of all packets costs one
    row per task.
    """
    ready = usable_packets(packet_endpoints(transport_packets(packets)))
    ends = ready.select(
        F.col("transport").alias("proto"),
        F.struct(F.col("saddr").alias("addr"), F.coalesce("sport", F.lit("")).alias("port")).alias("src"),
        F.struct(F.col("daddr").alias("addr"), F.coalesce("dport", F.lit("")).alias("port")).alias("dst"),
        "t", "flen")
    sided = ends.withColumns({"low": F.least("src", "dst"), "high": F.greatest("src", "dst")})
    up = F.col("src") == F.col("low")
    sums = sided.groupBy("proto", "low", "high").agg(
        F.min(F.when(up, F.col("t"))).alias("up_start"), F.min(F.when(~up, F.col("t"))).alias("down_start"),
        (F.max("t") - F.min("t")).alias("dur"),
        F.sum(F.when(up, 1).otherwise(0)).alias("up_packets"), F.sum(F.when(up, 0).otherwise(1)).alias("down_packets"),
        F.sum(F.when(up, F.col("flen")).otherwise(0)).alias("up_bytes"),
        F.sum(F.when(up, 0).otherwise(F.col("flen"))).alias("down_bytes"))
    begun = F.col("down_start").isNull() | F.coalesce(F.col("up_start") <= F.col("down_start"), F.lit(False))

    def side(a: str, b: str) -> Column:
        return F.when(begun, F.col(a)).otherwise(F.col(b))

    return sums.select(
        "dur", "proto", side("low.addr", "high.addr").alias("saddr"), side("low.port", "high.port").alias("sport"),
        side("high.addr", "low.addr").alias("daddr"), side("high.port", "low.port").alias("dport"),
        side("up_packets", "down_packets").alias("spkts"), side("down_packets", "up_packets").alias("dpkts"),
        side("up_bytes", "down_bytes").alias("sbytes"), side("down_bytes", "up_bytes").alias("dbytes"),
        F.lit("OK").alias("state"))


# Section headers of a conversation report, the arrow between the ends, and what follows them.
CONVERSATION_HEADERS = {"TCP Conversations": "tcp", "UDP Conversations": "udp"}
ARROW = "<->"
CONVERSATION_NUMBERS = ["spkts", "sbytes", "dpkts", "dbytes", "dur"]


def parse_conversations(reports: DataFrame, text: str = "value") -> DataFrame:
    """Flows from whole conversation reports: each line belongs to the section header above it.

    A report is one row; its sections and lines are split in place, whole.
    """
    sections = reports.select(F.explode(F.split(F.col(text), r"(?=[TU])(?=(?:TCP|UDP) Conversations)")).alias("section"))
    header = F.trim(F.substring_index(F.substring_index("section", "\n", 1), "\r", 1))
    names = F.create_map(*[F.lit(x) for pair in CONVERSATION_HEADERS.items() for x in pair])
    typed = sections.select(F.try_element_at(names, header).alias("proto"), "section").where(F.col("proto").isNotNull())
    lines = F.filter(F.split("section", "\n"), lambda line: F.contains(line, F.lit(ARROW)))
    # Words come out of the explode itself, so that each condition below reads them and none splits the line anew.
    words = (typed.select("proto", F.explode(F.transform(lines, lambda line: F.split(F.trim(line), r"\s+"))).alias("w"))
             .where((F.size("w") >= 3 + len(CONVERSATION_NUMBERS)) & (F.try_element_at("w", F.lit(2)) == ARROW)))

    def end(i: int) -> Column:
        """An address and its port; an IPv6 address has colons of its own, so the last one divides."""
        text = F.col("w")[i]
        return F.struct(F.substring_index(text, ":", -1).alias("port"),
                        F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, ":", -1)) - 1).alias("addr"))

    found = words.select("proto", end(0).alias("src"), end(2).alias("dst"), *[
        F.col("w")[3 + i].try_cast("double" if name == "dur" else "bigint").alias(name)
        for i, name in enumerate(CONVERSATION_NUMBERS)])
    return (found.where(F.col("src.port").try_cast("int").isNotNull() & F.col("dst.port").try_cast("int").isNotNull())
            .dropna(subset=CONVERSATION_NUMBERS).select(
        "dur", "proto", F.col("src.addr").alias("saddr"), F.col("src.port").alias("sport"),
        F.col("dst.addr").alias("daddr"), F.col("dst.port").alias("dport"), "spkts", "dpkts", "sbytes", "dbytes",
        F.lit("OK").alias("state")))
