"""Flow-analytics views over the given tables: each once in Spark and once in SQL.

The tables carry no network data, so orders, lines and events stand in for flows and packets. Scores use
whole-number arithmetic followed by one division, which both engines round alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def _line_key():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _cents("l_extendedprice"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction table with heavily tied scores."""
    lines = table(spark, folder, "lineitem")
    return _scored(lines, (F.col("l_quantity").cast("bigint") * 12 + F.round(F.col("l_discount") * 100).cast("bigint") * 20
                           + F.when(F.col("l_returnflag") == "R", 150).otherwise(0)) / F.lit(1000.0))


def scored_fine(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction table with nearly continuous scores."""
    lines = table(spark, folder, "lineitem")
    return _scored(lines, (_cents("l_extendedprice") + F.when(F.col("l_returnflag") == "R", 2000000).otherwise(0))
                   / F.lit(13000000.0))


def _scored(lines: DataFrame, score) -> DataFrame:
    positive = F.col("l_returnflag") == "R"
    return lines.select(
        _line_key().alias("row_id"),
        F.when(positive, 1).otherwise(0).alias("y_true"),
        score.alias("y_score"),
        (score >= 0.5).cast("int").alias("y_pred"),
        F.when(~positive, "benign").when(F.col("l_linestatus") == "O", "attack_scan")
        .otherwise("attack_exfil_burst").alias("attack_type"),
        F.concat(F.lit("profile_"), F.col("l_linenumber") % 3).alias("profile"),
        F.col("l_shipdate").alias("seen"))


_SCORED_SQL = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  {score} AS y_score,
  CASE WHEN {score} >= 0.5e0 THEN 1 ELSE 0 END AS y_pred,
  CASE WHEN l_returnflag <> 'R' THEN 'benign' WHEN l_linestatus = 'O' THEN 'attack_scan'
    ELSE 'attack_exfil_burst' END AS attack_type,
  'profile_' || CAST(l_linenumber % 3 AS VARCHAR) AS profile, l_shipdate AS seen
FROM lineitem"""


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packet table in the 12-field form; users talk to seven servers, every fourth over IPv6."""
    e = table(spark, folder, "events")
    six = F.col("user_id") % 4 == 0
    source, target = F.col("user_id"), F.col("user_id") % 7
    tcp = F.col("event_type").isin("click", "view", "purchase")
    udp = F.col("event_type") == "signup"
    return e.select(
        # The stored time has no zone; seconds are counted without bringing the session's zone in.
        (F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
         / F.lit(1000000.0)).alias("t"),
        F.when(six, None).when(tcp, "6").when(udp, "17").otherwise("1").alias("ip_proto"),
        F.when(~six, None).when(tcp, "6").when(udp, "17").otherwise("58").alias("v6_nxt"),
        F.when(~six, F.concat(F.lit("10.0.0."), source)).alias("ip_src"),
        F.when(~six, F.concat(F.lit("10.1.0."), target)).alias("ip_dst"),
        F.when(six, F.concat(F.lit("fd00::"), source)).alias("v6_src"),
        F.when(six, F.concat(F.lit("fd01::"), target)).alias("v6_dst"),
        F.when(tcp, (1000 + source % 5).cast("string")).alias("tcp_sp"),
        F.when(tcp, F.lit("443")).alias("tcp_dp"),
        F.when(udp, (2000 + source % 3).cast("string")).alias("udp_sp"),
        F.when(udp, F.lit("53")).alias("udp_dp"),
        F.floor("value").cast("bigint").alias("flen"),
        F.col("event_id").alias("packet_id"), F.col("ts"))


_PACKETS_SQL = """SELECT epoch_us(ts) / 1000000.0e0 AS t,
  CASE WHEN six THEN NULL WHEN tcp THEN '6' WHEN udp THEN '17' ELSE '1' END AS ip_proto,
  CASE WHEN NOT six THEN NULL WHEN tcp THEN '6' WHEN udp THEN '17' ELSE '58' END AS v6_nxt,
  CASE WHEN NOT six THEN '10.0.0.' || user_id END AS ip_src,
  CASE WHEN NOT six THEN '10.1.0.' || (user_id % 7) END AS ip_dst,
  CASE WHEN six THEN 'fd00::' || user_id END AS v6_src,
  CASE WHEN six THEN 'fd01::' || (user_id % 7) END AS v6_dst,
  CASE WHEN tcp THEN CAST(1000 + user_id % 5 AS VARCHAR) END AS tcp_sp,
  CASE WHEN tcp THEN '443' END AS tcp_dp,
  CASE WHEN udp THEN CAST(2000 + user_id % 3 AS VARCHAR) END AS udp_sp,
  CASE WHEN udp THEN '53' END AS udp_dp,
  CAST(floor(value) AS BIGINT) AS flen, event_id AS packet_id, ts
FROM (SELECT *, user_id % 4 = 0 AS six, event_type IN ('click', 'view', 'purchase') AS tcp,
        event_type = 'signup' AS udp FROM events)"""


def day_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Day-partitioned flow table with a padded text label."""
    e = table(spark, folder, "events")
    return e.select(
        F.date_format("ts", "EEEE").alias("day"),
        F.when(F.col("event_type") == "error", F.concat(F.lit(" Attack-"), F.col("user_id") % 5, F.lit(" ")))
        .otherwise(" Benign ").alias("Label"),
        F.col("value"), F.hour("ts").alias("hour"), F.col("event_type"), F.col("user_id"), F.col("event_id"))


_DAY_FLOWS_SQL = """SELECT dayname(ts) AS day,
  CASE WHEN event_type = 'error' THEN ' Attack-' || (user_id % 5) || ' ' ELSE ' Benign ' END AS "Label",
  value, CAST(hour(ts) AS INTEGER) AS hour, event_type, user_id, event_id
FROM events"""


def raw_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Exporter-style records: text columns, padding, blanks and junk, as a capture tool writes them."""
    lines = table(spark, folder, "lineitem")
    six = F.col("l_suppkey") % 3 != 0
    return lines.select(
        F.when(F.col("l_tax") == 0.0, "").otherwise(
            F.concat(F.lit(" "), (F.col("l_tax") * 100).cast("int").cast("string"))).alias("Dur"),
        F.element_at(F.array(F.lit("6"), F.lit("17.0"), F.lit(" TCP "), F.lit("58"), F.lit(""), F.lit("1"), F.lit("gre")),
                     F.col("l_linenumber")).alias("Proto"),
        F.when(F.col("l_quantity") == 7, " 0 ").when(six, F.concat(F.lit(" fd00::"), F.col("l_suppkey")))
        .otherwise(F.concat(F.lit("10.0.0."), F.col("l_suppkey"))).alias("SrcAddr"),
        (F.col("l_partkey") % 1000).cast("string").alias("Sport"),
        F.when(six, F.concat(F.lit("fd01::"), F.col("l_partkey") % 50)).otherwise(
            F.concat(F.lit("10.1.0."), F.col("l_partkey") % 50)).alias("DstAddr"),
        F.lit("443").alias("Dport"),
        F.col("l_quantity").cast("int").cast("string").alias("SrcPkts"),
        F.when(F.col("l_quantity") > 45, "n/a").otherwise(F.col("l_linenumber").cast("string")).alias("DstPkts"),
        F.when(F.col("l_discount") == 0.0, "Infinity").otherwise(
            F.round(F.col("l_extendedprice")).cast("bigint").cast("string")).alias("SrcBytes"),
        F.lit(" 40 ").alias("DstBytes"),
        F.concat(F.lit(" "), F.col("l_returnflag")).alias("State"))


_RAW_FLOWS_SQL = """SELECT
  CASE WHEN l_tax = 0 THEN '' ELSE ' ' || CAST(CAST(trunc(l_tax * 100) AS INTEGER) AS VARCHAR) END AS "Dur",
  list_extract(['6', '17.0', ' TCP ', '58', '', '1', 'gre'], l_linenumber) AS "Proto",
  CASE WHEN l_quantity = 7 THEN ' 0 ' WHEN l_suppkey % 3 <> 0 THEN ' fd00::' || l_suppkey
    ELSE '10.0.0.' || l_suppkey END AS "SrcAddr",
  CAST(l_partkey % 1000 AS VARCHAR) AS "Sport",
  CASE WHEN l_suppkey % 3 <> 0 THEN 'fd01::' || (l_partkey % 50) ELSE '10.1.0.' || (l_partkey % 50) END AS "DstAddr",
  '443' AS "Dport", CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS "SrcPkts",
  CASE WHEN l_quantity > 45 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS "DstPkts",
  CASE WHEN l_discount = 0 THEN 'Infinity' ELSE CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) END AS "SrcBytes",
  ' 40 ' AS "DstBytes", ' ' || l_returnflag AS "State"
FROM lineitem"""


def ref_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The reference side of a shift report: orders of 1995 to 1997."""
    return _side(table(spark, folder, "orders").where("o_orderdate < timestamp'1998-01-01 00:00:00'"))


def tgt_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The target side: later orders, with prices that drift and a priority that vanishes."""
    later = table(spark, folder, "orders").where("o_orderdate >= timestamp'1998-01-01 00:00:00'")
    return _side(later, drift=1.25)


def _side(orders: DataFrame, drift: float = 1.0) -> DataFrame:
    priority = F.col("o_orderpriority")
    return orders.select(
        (F.col("o_totalprice") * F.lit(drift)).alias("price"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"),
        F.when(F.col("o_custkey") % 10 == 0, None).otherwise((F.col("o_custkey") % 97).cast("double")).alias("cust"),
        F.lit(1.0).alias("flat"),
        F.col("o_orderstatus").alias("status"),
        (F.when(priority == "5-LOW", None).otherwise(priority) if drift != 1.0 else priority).alias("priority"),
        F.lit(1).alias("Label"))


_SIDE_SQL = """SELECT o_totalprice * {drift} AS price, CAST(day(o_orderdate) AS DOUBLE) AS day,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 97 AS DOUBLE) END AS cust, 1.0e0 AS flat,
  o_orderstatus AS status, {priority} AS priority
FROM orders WHERE o_orderdate {when} TIMESTAMP '1998-01-01 00:00:00'"""


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth per document: the key, the class and the kind."""
    labels, docs = table(spark, folder, "labels"), table(spark, folder, "documents")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("y_true"),
                                              F.when(F.col("toxic") == 0, "benign").otherwise(F.col("lang")).alias("attack_type"))


def preds(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per labelled document, with a ``y_true`` of their own that must lose to the truth."""
    labels, docs = table(spark, folder, "labels"), table(spark, folder, "documents")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.lit(0).alias("y_true"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("y_score"))


def multiclass(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(F.col("l_returnflag").alias("y_true"),
                        F.when(F.col("l_quantity") < 20, "A").when(F.col("l_linestatus") == "O", "N")
                        .otherwise("R").alias("y_pred"))


def gap_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled flows with missing values, which any classifier tells apart: packets and bytes of an attack lie beyond
    all others', and one of the two is there in every row. ``kind`` numbers three such classes."""
    lines = table(spark, folder, "lineitem")
    attack, key = F.when(F.col("l_returnflag") == "R", 1).otherwise(0), F.col("l_partkey")
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    return lines.select(
        _line_key().alias("row_id"), attack.alias("y_true"), kind.alias("kind"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_tax")).alias("dur"),
        F.when(key % 13 != 0, F.col("l_linestatus")).alias("proto"),
        F.concat(F.lit("S"), F.col("l_linenumber")).alias("state"),
        F.when(key % 5 != 0, F.col("l_quantity") + 100.0 * attack).alias("spkts"), F.lit(0.0).alias("dpkts"),
        F.when(key % 5 != 1, F.floor(F.col("l_extendedprice") / 5000) * 5000.0 + 400000.0 * attack).alias("sbytes"), F.lit(0.0).alias("dbytes"),
        (key % 1000).cast("double").alias("sport"), (F.lit(80) + F.col("l_suppkey") % 3).cast("double").alias("dport"),
        (F.col("l_quantity") + 100.0 * kind).alias("volume"))


def group_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of capture iterations: the customer stands for the iteration."""
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("iteration"), F.col("o_orderkey").alias("row_id"))


SQL_VIEWS = {
    "scored": _SCORED_SQL.format(score="(CAST(l_quantity AS BIGINT) * 12 + CAST(round(l_discount * 100) AS BIGINT) * 20 "
                                 "+ CASE WHEN l_returnflag = 'R' THEN 150 ELSE 0 END) / 1000.0e0"),
    "scored_fine": _SCORED_SQL.format(score="(CAST(round(l_extendedprice * 100) AS BIGINT) "
                                      "+ CASE WHEN l_returnflag = 'R' THEN 2000000 ELSE 0 END) / 13000000.0e0"),
    "packets": _PACKETS_SQL,
    "day_flows": _DAY_FLOWS_SQL,
    "raw_flows": _RAW_FLOWS_SQL,
    "ref": _SIDE_SQL.format(drift="1.0e0", when="<", priority="o_orderpriority"),
    "tgt": _SIDE_SQL.format(drift="1.25e0", when=">=", priority="nullif(o_orderpriority, '5-LOW')"),
    "truth": "SELECT doc_id AS row_id, toxic AS y_true, CASE WHEN toxic = 0 THEN 'benign' ELSE lang END AS attack_type "
             "FROM labels JOIN documents USING (doc_id)",
    "preds": "SELECT doc_id AS row_id, 0 AS y_true, (n_chars % 1000) / 1000.0e0 AS y_score "
             "FROM labels JOIN documents USING (doc_id)",
    "multiclass": "SELECT l_returnflag AS y_true, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_linestatus = 'O' THEN 'N' "
                  "ELSE 'R' END AS y_pred FROM lineitem",
    "gap_flows": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id, attack AS y_true,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS kind,
  CASE WHEN l_suppkey % 11 <> 0 THEN l_tax END AS dur, CASE WHEN l_partkey % 13 <> 0 THEN l_linestatus END AS proto,
  'S' || l_linenumber AS state, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity + 100.0e0 * attack END AS spkts,
  CASE WHEN l_partkey % 5 <> 1 THEN floor(l_extendedprice / 5000) * 5000.0e0 + 400000.0e0 * attack END AS sbytes
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS attack FROM lineitem)""",
    "group_rows": "SELECT o_custkey AS iteration, o_orderkey AS row_id FROM orders",
    # Exact cumulative counts per distinct score, the SQL way, over whichever of the scored views is named first.
    "curve": """SELECT *, tp / nullif(n_pos, 0)::DOUBLE AS tpr, fp / nullif(n_neg, 0)::DOUBLE AS fpr,
    tp / (tp + fp)::DOUBLE AS precision FROM (
  SELECT y_score AS threshold, pos, neg,
    CAST(sum(pos) OVER (ORDER BY y_score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY y_score DESC) AS BIGINT) AS fp,
    CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(neg) OVER () AS BIGINT) AS n_neg
  FROM (SELECT y_score, CAST(sum(y_true) AS BIGINT) AS pos, CAST(sum(1 - y_true) AS BIGINT) AS neg
        FROM {first} GROUP BY y_score))""",
    "group_curve": """SELECT *, tp / nullif(n_pos, 0)::DOUBLE AS tpr, fp / nullif(n_neg, 0)::DOUBLE AS fpr,
    tp / (tp + fp)::DOUBLE AS precision FROM (
  SELECT g, y_score AS threshold, pos, neg,
    CAST(sum(pos) OVER (PARTITION BY g ORDER BY y_score DESC) AS BIGINT) AS tp,
    CAST(sum(neg) OVER (PARTITION BY g ORDER BY y_score DESC) AS BIGINT) AS fp,
    CAST(sum(pos) OVER (PARTITION BY g) AS BIGINT) AS n_pos, CAST(sum(neg) OVER (PARTITION BY g) AS BIGINT) AS n_neg
  FROM (SELECT g, y_score, CAST(sum(y_true) AS BIGINT) AS pos, CAST(sum(1 - y_true) AS BIGINT) AS neg
        FROM grouped GROUP BY g, y_score))""",
}


def sql_views(names: Sequence[str], body: str) -> str:
    """``body`` behind the named views. ``name=SQL`` texts may be given in ``body`` itself."""
    if not names:
        return body
    parts = [f"{name} AS ({SQL_VIEWS[name].replace('{first}', names[0])})" for name in names]
    joiner = ",\n" if body.lstrip().startswith(",") else "\n"
    return "WITH " + ",\n".join(parts) + joiner + body.lstrip().removeprefix(",")
