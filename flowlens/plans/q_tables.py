"""Queries: cleaning, labelling, flows, merges, shift and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import cleaning as C
from flowlens.functions.relational import require_columns, required_columns
from flowlens.operators import cleaning as CL
from flowlens.operators import features as FT
from flowlens.operators import flows as FL
from flowlens.operators import labels as LB
from flowlens.operators import merge as MG
from flowlens.operators import shift as SH
from flowlens.operators.ordered import exact_quantiles
from flowlens.plans import views as V
from flowlens.plans.registry import query, rounded
from flowlens.schemas import EXPORTER_HEADERS, FLOW_NUMERIC, FLOW_SCHEMA, LEAKAGE_COLUMNS

NUM = "coalesce(CASE WHEN isnan(TRY_CAST(trim({c}) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim({c}) AS DOUBLE) END, 0)"


def count_of(df, *columns):
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


# --- cleaning -----------------------------------------------------------------------------------------

@query("cl_1_strip_names", """SELECT CAST(count(*) AS BIGINT) AS "Flow Duration", CAST(sum(l_linenumber) AS BIGINT) AS "Label" FROM lineitem""")
def _(spark, d):
    messy = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias(" Flow Duration "), F.col("l_linenumber").alias(" Label"))
    return CL.strip_names(messy).agg(F.count("Flow Duration").alias("Flow Duration"), F.sum("Label").alias("Label"))


@query("cl_2_lower_names", """SELECT "SrcPkts" AS srcpkts, CAST(count(*) AS BIGINT) AS n FROM raw_flows GROUP BY 1""", "raw_flows")
def _(spark, d):
    return count_of(CL.lower_names(V.raw_flows(spark, d)), "srcpkts")


@query("cl_3_canonical_names", "SELECT " + ", ".join(f'"{o}" AS {n}' for o, n in EXPORTER_HEADERS.items()) + " FROM raw_flows",
       "raw_flows")
def _(spark, d):
    return CL.canonical_names(V.raw_flows(spark, d))


@query("cl_3_canonical_if_absent", """SELECT "Dur" AS raw_dur, 'kept' AS dur, "Proto" AS proto FROM raw_flows""", "raw_flows")
def _(spark, d):
    # The table already has the name that Time would get, so only Proto is renamed.
    rows = V.raw_flows(spark, d).select(F.col("Dur").alias("Time"), F.lit("kept").alias("dur"), "Proto")
    named = CL.canonical_names(rows, {"Proto": "proto", "Time": "dur"}, only_if_absent=True)
    return named.withColumnRenamed("Time", "raw_dur")


@query("cl_4_trim_text", """, s AS (SELECT CASE WHEN "SrcPkts" = '7' THEN NULL ELSE "SrcAddr" END AS saddr, "State" AS state FROM raw_flows)
SELECT coalesce(trim(saddr), 'nan') AS saddr, coalesce(trim(state), 'nan') AS state, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2""",
       "raw_flows")
def _(spark, d):
    rows = V.raw_flows(spark, d).select(F.when(F.col("SrcPkts") == "7", None).otherwise(F.col("SrcAddr")).alias("saddr"),
                                        F.col("State").alias("state"))
    return count_of(CL.trim_text(rows, ["saddr", "state"]), "saddr", "state")


@query("cl_5_numbers_or_zero", "SELECT " + ", ".join(
    f'round({NUM.format(c=chr(34) + o + chr(34))}, 6) AS {n}' for o, n in EXPORTER_HEADERS.items() if n in FLOW_NUMERIC)
    + " FROM raw_flows", "raw_flows")
def _(spark, d):
    return rounded(CL.numbers_or_zero(CL.canonical_names(V.raw_flows(spark, d))).select(*FLOW_NUMERIC))


@query("cl_6_numbers_or_null", """SELECT TRY_CAST("DstPkts" AS DOUBLE) AS dpkts, CAST(count(*) AS BIGINT) AS n FROM raw_flows GROUP BY 1""",
       "raw_flows")
def _(spark, d):
    return count_of(CL.numbers_or_null(CL.canonical_names(V.raw_flows(spark, d)), ["dpkts"]), "dpkts")


@query("cl_7_finite_or_null", """SELECT CASE WHEN isfinite(TRY_CAST("SrcBytes" AS DOUBLE)) THEN TRY_CAST("SrcBytes" AS DOUBLE) END AS sbytes,
  CAST(count(*) AS BIGINT) AS n FROM raw_flows GROUP BY 1""", "raw_flows")
def _(spark, d):
    return count_of(CL.finite_or_null(CL.canonical_names(V.raw_flows(spark, d)), ["sbytes"]), "sbytes")


def _with_identifiers(spark, d):
    lines = V.table(spark, d, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("srcip"), F.col("l_suppkey").alias("Flow ID"),
        F.col("l_linenumber").alias("Src IP"), F.col("l_quantity").alias("spkts"), F.col("l_returnflag").alias("attack_cat"),
        F.col("l_linestatus").alias("label"))


for _kind in LEAKAGE_COLUMNS:
    _left = [c for c in ("id", "srcip", "Flow ID", "Src IP") if c not in LEAKAGE_COLUMNS[_kind]]
    _names = {"id": "l_orderkey", "srcip": "l_partkey", "Flow ID": "l_suppkey", "Src IP": "l_linenumber"}

    @query(f"cl_8_drop_leakage_{_kind}", "SELECT " + "".join(f'{_names[c]} AS "{c}", ' for c in _left)
           + "l_quantity AS spkts, l_returnflag AS attack_cat, l_linestatus AS label FROM lineitem")
    def _(spark, d, kind=_kind):
        return CL.drop_leakage(_with_identifiers(spark, d), kind)


@query("cl_9_one_label", """SELECT l_linestatus AS "Label", CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    return count_of(CL.one_label(_with_identifiers(spark, d)), "Label")


@query("cl_10_labelled_only", """, s AS (SELECT CASE WHEN hour = 3 THEN NULL ELSE "Label" END AS "Label" FROM day_flows)
SELECT trim("Label") AS "Label", CAST(count(*) AS BIGINT) AS n FROM s WHERE "Label" IS NOT NULL GROUP BY 1""", "day_flows")
def _(spark, d):
    rows = V.day_flows(spark, d).withColumn("Label", F.when(F.col("hour") == 3, None).otherwise(F.col("Label")))
    return count_of(CL.labelled_only(rows), "Label")


ADDRESSED = """, s AS (SELECT trim("SrcAddr") AS saddr, trim("DstAddr") AS daddr FROM raw_flows)"""


def _addressed(spark, d):
    return CL.trim_text(CL.canonical_names(V.raw_flows(spark, d)), ["saddr", "daddr"]).select("saddr", "daddr")


@query("cl_11_drop_junk_addresses", ADDRESSED + """ SELECT saddr, daddr, CAST(count(*) AS BIGINT) AS n FROM s
WHERE saddr <> '0' AND daddr <> '0' GROUP BY 1, 2""", "raw_flows")
def _(spark, d):
    return count_of(CL.drop_junk_addresses(_addressed(spark, d)), "saddr", "daddr")


@query("cl_12_ipv6_only", ADDRESSED + """ SELECT saddr, daddr, CAST(count(*) AS BIGINT) AS n FROM s
WHERE contains(saddr, ':') AND contains(daddr, ':') GROUP BY 1, 2""", "raw_flows")
def _(spark, d):
    return count_of(CL.ipv6_only(_addressed(spark, d)), "saddr", "daddr")


@query("cl_13_protocol_name", """SELECT CASE "Proto" WHEN '6' THEN 'tcp' WHEN '17' THEN 'udp' WHEN '58' THEN 'ipv6-icmp' WHEN '1' THEN 'icmp'
  WHEN '' THEN 'unk' ELSE "Proto" END AS proto, CAST(count(*) AS BIGINT) AS n FROM raw_flows GROUP BY 1""", "raw_flows")
def _(spark, d):
    return count_of(V.raw_flows(spark, d).select(C.protocol_name(F.col("Proto")).alias("proto")), "proto")


PROTO_ANY = """CASE lower(trim("Proto")) WHEN '6' THEN 'tcp' WHEN '17.0' THEN 'udp' WHEN '58' THEN 'ipv6-icmp' WHEN '1' THEN 'icmp'
  WHEN '' THEN 'unk' ELSE lower(trim("Proto")) END"""


@query("cl_14_protocol_any", f"SELECT {PROTO_ANY} AS proto, CAST(count(*) AS BIGINT) AS n FROM raw_flows GROUP BY 1", "raw_flows")
def _(spark, d):
    return count_of(V.raw_flows(spark, d).select(C.protocol_any(F.col("Proto")).alias("proto")), "proto")


@query("cl_15_with_defaults", """SELECT l_quantity AS spkts, 0.0e0 AS dpkts, l_returnflag AS proto, 'unk' AS state, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY ALL""")
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_quantity").alias("spkts"), F.col("l_returnflag").alias("proto"))
    full = CL.with_defaults(rows, ["spkts", "dpkts", "proto", "state"], ["spkts", "dpkts"])
    return count_of(full, "spkts", "dpkts", "proto", "state")


ENDPOINTS = """ends AS (SELECT *, coalesce(nullif(v6_src, ''), ip_src) AS saddr, coalesce(nullif(v6_dst, ''), ip_dst) AS daddr,
  coalesce(tcp_sp, udp_sp) AS sport, coalesce(tcp_dp, udp_dp) AS dport,
  CASE WHEN tcp_sp IS NOT NULL OR tcp_dp IS NOT NULL THEN 'tcp' ELSE 'udp' END AS transport,
  CASE coalesce(v6_nxt, ip_proto, '') WHEN '6' THEN 'tcp' WHEN '17' THEN 'udp' WHEN '58' THEN 'ipv6-icmp' WHEN '1' THEN 'icmp'
    WHEN '' THEN 'unk' ELSE coalesce(v6_nxt, ip_proto) END AS protocol FROM packets)"""


@query("cl_16_packet_endpoints", f", {ENDPOINTS} SELECT packet_id, saddr, daddr, sport, dport, transport, protocol FROM ends", "packets")
def _(spark, d):
    return CL.packet_endpoints(V.packets(spark, d)).select(
        "packet_id", "saddr", "daddr", "sport", "dport", "transport", "protocol")


TRANSPORT = """(tcp_sp IS NOT NULL OR tcp_dp IS NOT NULL OR udp_sp IS NOT NULL OR udp_dp IS NOT NULL)
  AND (ip_src IS NOT NULL OR v6_src IS NOT NULL)"""


@query("cl_17_transport_packets", f"SELECT packet_id FROM packets WHERE {TRANSPORT}", "packets")
def _(spark, d):
    return CL.transport_packets(V.packets(spark, d)).select("packet_id")


@query("cl_18_usable_packets", f""", {ENDPOINTS.replace('FROM packets', "FROM (SELECT * REPLACE (CASE WHEN packet_id % 11 = 0 THEN NULL ELSE t END AS t, CASE WHEN packet_id % 13 = 0 THEN '' ELSE ip_src END AS ip_src) FROM packets)")}
SELECT packet_id FROM ends WHERE t IS NOT NULL AND nullif(saddr, '') IS NOT NULL AND nullif(daddr, '') IS NOT NULL""", "packets")
def _(spark, d):
    broken = V.packets(spark, d).withColumns({
        "t": F.when(F.col("packet_id") % 11 == 0, None).otherwise(F.col("t")),
        "ip_src": F.when(F.col("packet_id") % 13 == 0, "").otherwise(F.col("ip_src"))})
    return CL.usable_packets(CL.packet_endpoints(broken)).select("packet_id")


@query("cl_19_first_packets", "SELECT packet_id, flen FROM packets ORDER BY t, packet_id LIMIT 500", "packets")
def _(spark, d):
    return CL.first_packets(V.packets(spark, d), 500, "packet_id").select("packet_id", "flen")


CLEAN = ADDRESSED.replace("AS daddr FROM raw_flows)", f"""AS daddr, "Proto" AS proto, "Sport" AS sport, "Dport" AS dport, "State" AS state,
  {', '.join(f"round({NUM.format(c=chr(34) + o + chr(34))}, 6) AS {n}" for o, n in EXPORTER_HEADERS.items() if n in FLOW_NUMERIC)}
  FROM raw_flows), clean AS (SELECT * FROM s WHERE saddr <> '0' AND daddr <> '0' AND contains(saddr, ':') AND contains(daddr, ':'))""")


@query("cl_clean_flows", CLEAN + " SELECT * FROM clean", "raw_flows")
def _(spark, d):
    return rounded(CL.clean_flows(V.raw_flows(spark, d)))


# --- labels -------------------------------------------------------------------------------------------

@query("lb_1_text_label", """SELECT day, CASE WHEN upper(trim("Label")) <> 'BENIGN' THEN 1 ELSE 0 END AS y_true, CAST(count(*) AS BIGINT) AS n
FROM day_flows GROUP BY 1, 2""", "day_flows")
def _(spark, d):
    return count_of(LB.text_label(V.day_flows(spark, d)), "day", "y_true")


@query("lb_2_numeric_label", """SELECT CASE WHEN coalesce(TRY_CAST("DstPkts" AS DOUBLE), 0) <> 0 THEN 1 ELSE 0 END AS y_true, CAST(count(*) AS BIGINT) AS n
FROM raw_flows GROUP BY 1""", "raw_flows")
def _(spark, d):
    return count_of(LB.numeric_label(V.raw_flows(spark, d), "DstPkts"), "y_true")


@query("lb_3_multiclass_label", """SELECT l_quantity AS spkts, l_returnflag AS y_true, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    rows = _with_identifiers(spark, d).select("spkts", "attack_cat", "label")
    return count_of(LB.multiclass_label(rows, "attack_cat", "label"), "spkts", "y_true")


@query("lb_4_attacker_label", CLEAN + """ SELECT saddr, CASE WHEN saddr = 'fd00::7' THEN 1 ELSE 0 END AS y_true, CAST(count(*) AS BIGINT) AS n
FROM clean GROUP BY 1, 2""", "raw_flows")
def _(spark, d):
    return count_of(LB.attacker_label(CL.clean_flows(V.raw_flows(spark, d)), " fd00::7 "), "saddr", "y_true")


@query("lb_4_attacker_set", CLEAN + """, bad AS (SELECT DISTINCT 'fd00::' || s_suppkey AS a FROM supplier WHERE s_acctbal < 0)
SELECT saddr, CASE WHEN saddr IN (SELECT a FROM bad) THEN 1 ELSE 0 END AS y_true, CAST(count(*) AS BIGINT) AS n FROM clean GROUP BY 1, 2""",
       "raw_flows")
def _(spark, d):
    bad = V.table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("fd00::"), "s_suppkey").alias("address"))
    return count_of(LB.attackers_label(CL.clean_flows(V.raw_flows(spark, d)), bad, "address"), "saddr", "y_true")


@query("lb_5_phase_label", """SELECT l_linestatus AS state, 1 AS y_true, 'attack_scan' AS attack_type, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("state"))
    return count_of(LB.phase_label(rows, 1, "attack_scan"), "state", "y_true", "attack_type")


@query("lb_6_label_from_type", """SELECT attack_type, CASE WHEN attack_type = 'benign' THEN 0 ELSE 1 END AS y_true, CAST(count(*) AS BIGINT) AS n
FROM scored GROUP BY 1""", "scored")
def _(spark, d):
    return count_of(LB.label_from_type(V.scored(spark, d).drop("y_true")), "attack_type", "y_true")


@query("lb_7_family_label", """SELECT name, CASE WHEN name LIKE 'benign\\_%' ESCAPE '\\' THEN 'benign' WHEN name LIKE 'attack\\_exfil\\_%' ESCAPE '\\' THEN 'attack_exfil'
  WHEN name LIKE 'attack\\_%' ESCAPE '\\' THEN 'attack_main' END AS attack_type, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CASE WHEN y_true = 0 AND y_pred = 0 THEN 'other' ELSE attack_type || '_1' END AS name FROM scored) GROUP BY 1, 2""", "scored")
def _(spark, d):
    rows = V.scored(spark, d).select(F.when((F.col("y_true") == 0) & (F.col("y_pred") == 0), "other").otherwise(
        F.concat("attack_type", F.lit("_1"))).alias("name"))
    return count_of(LB.family_label(rows, "name"), "name", "attack_type")


# --- flows --------------------------------------------------------------------------------------------

@query("fl_1_directional_flows", f""", {ENDPOINTS.replace('FROM packets', f'FROM packets WHERE {TRANSPORT}')}
SELECT round(max(t) - min(t), 6) AS dur, transport AS proto, saddr, coalesce(sport, '') AS sport, daddr, coalesce(dport, '') AS dport,
  CAST(count(*) AS BIGINT) AS spkts, CAST(0 AS BIGINT) AS dpkts, CAST(sum(flen) AS BIGINT) AS sbytes, CAST(0 AS BIGINT) AS dbytes,
  'NA' AS state FROM ends GROUP BY transport, saddr, sport, daddr, dport""", "packets")
def _(spark, d):
    return rounded(FL.directional_flows(V.packets(spark, d)))


def windowed_sql(widths, lead: str) -> str:
    values = ", ".join(f"({w}e0)" for w in widths)
    return f""", {ENDPOINTS}, w AS (SELECT *, CAST(floor((t - (SELECT min(t) FROM ends)) / width) AS BIGINT) AS win
  FROM ends, (VALUES {values}) v(width))
SELECT {lead}win, round(max(t) - min(t), 6) AS dur, protocol AS proto, saddr, coalesce(sport, '0') AS sport, daddr, coalesce(dport, '0') AS dport,
  CAST(count(*) AS BIGINT) AS spkts, CAST(0 AS BIGINT) AS dpkts, CAST(sum(flen) AS BIGINT) AS sbytes, CAST(0 AS BIGINT) AS dbytes,
  'OK' AS state FROM w GROUP BY {lead}win, protocol, saddr, sport, daddr, dport"""


@query("fl_2_windowed_flows", windowed_sql([3600.0], ""), "packets")
def _(spark, d):
    return rounded(FL.windowed_flows(V.packets(spark, d), 3600.0))


@query("fl_3_conversations", f""", {ENDPOINTS.replace('FROM packets', f'FROM (SELECT * REPLACE (CASE WHEN packet_id % 3 = 0 THEN ip_dst ELSE ip_src END AS ip_src, CASE WHEN packet_id % 3 = 0 THEN ip_src ELSE ip_dst END AS ip_dst, CASE WHEN packet_id % 3 = 0 THEN tcp_dp ELSE tcp_sp END AS tcp_sp, CASE WHEN packet_id % 3 = 0 THEN tcp_sp ELSE tcp_dp END AS tcp_dp) FROM packets WHERE {TRANSPORT})')},
o AS (SELECT *, least((saddr, sport), (daddr, dport)) AS lo, greatest((saddr, sport), (daddr, dport)) AS hi FROM ends),
r AS (SELECT *, row_number() OVER (PARTITION BY transport, lo, hi ORDER BY t, (saddr, sport)) AS i FROM o),
f AS (SELECT transport, lo, hi, saddr, sport, daddr, dport FROM r WHERE i = 1)
SELECT round(max(t) - min(t), 6) AS dur, transport AS proto, f.saddr, f.sport, f.daddr, f.dport,
  CAST(count(*) FILTER (WHERE r.saddr = f.saddr AND r.sport = f.sport) AS BIGINT) AS spkts,
  CAST(count(*) FILTER (WHERE NOT (r.saddr = f.saddr AND r.sport = f.sport)) AS BIGINT) AS dpkts,
  CAST(coalesce(sum(flen) FILTER (WHERE r.saddr = f.saddr AND r.sport = f.sport), 0) AS BIGINT) AS sbytes,
  CAST(coalesce(sum(flen) FILTER (WHERE NOT (r.saddr = f.saddr AND r.sport = f.sport)), 0) AS BIGINT) AS dbytes, 'OK' AS state
FROM r JOIN f USING (transport, lo, hi) GROUP BY transport, lo, hi, f.saddr, f.sport, f.daddr, f.dport""", "packets")
def _(spark, d):
    back = F.col("packet_id") % 3 == 0
    swapped = V.packets(spark, d).withColumns({
        a: F.when(back, F.col(b)).otherwise(F.col(a))
        for a, b in (("ip_src", "ip_dst"), ("ip_dst", "ip_src"), ("tcp_sp", "tcp_dp"), ("tcp_dp", "tcp_sp"))})
    return rounded(FL.conversations(swapped))


@query("fl_4_parse_conversations", """SELECT round(l_quantity / 8.0e0, 6) AS dur, CASE WHEN l_linenumber % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto,
  '10.0.0.' || l_suppkey AS saddr, CAST(l_partkey AS VARCHAR) AS sport, '10.1.0.' || l_linenumber AS daddr, '443' AS dport,
  l_orderkey AS spkts, CAST(l_linenumber AS BIGINT) AS dpkts, l_partkey AS sbytes, l_suppkey AS dbytes, 'OK' AS state FROM lineitem""")
def _(spark, d):
    # One report per order line: a TCP and a UDP section, of which one is empty.
    lines = V.table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 2 == 0).alias("tcp"),
        F.format_string("10.0.0.%s:%s   <->  10.1.0.%s:443   %s %s  %s %s  %s", F.col("l_suppkey").cast("string"),
                        F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string"),
                        F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"),
                        (F.col("l_quantity") / 8.0).cast("string")).alias("line"))
    rule = "=" * 40
    reports = lines.select(F.concat_ws(
        "\n", F.lit(rule), F.lit("TCP Conversations"), F.lit("Filter:<No Filter>"), F.when(F.col("tcp"), F.col("line")),
        F.lit(rule), F.lit("UDP Conversations"), F.lit("Filter:<No Filter>"), F.when(~F.col("tcp"), F.col("line")),
        F.lit(rule)).alias("value"))
    return rounded(FL.parse_conversations(reports))


@query("fl_5_window_ablation", windowed_sql([60.0, 3600.0, 86400.0], "width, "), "packets")
def _(spark, d):
    return rounded(FL.window_ablation(V.packets(spark, d), [60.0, 3600.0, 86400.0]))


# --- merges and audits --------------------------------------------------------------------------------

def _sides(spark, d):
    lines = V.table(spark, d, "lineitem").select(F.col("l_quantity").alias("spkts"), F.col("l_linestatus").alias("state"),
                                                 F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("rep"))
    return (lines.where("flag <> 'R'").drop("flag"),
            lines.where("flag = 'R' AND rep % 9 <> 4").select("rep", "state", "spkts"))


SIDES = """, s AS (SELECT l_quantity AS spkts, l_linestatus AS state, l_suppkey AS rep, l_returnflag AS flag FROM lineitem),
b AS (SELECT * FROM s WHERE flag <> 'R'), a AS (SELECT * FROM s WHERE flag = 'R' AND rep % 9 <> 4)"""


@query("mg_1_benign_and_attack", SIDES.replace(", s AS", "WITH s AS", 1) + """ SELECT spkts, state, rep, y_true, attack_type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT spkts, state, rep, 0 AS y_true, 'benign' AS attack_type FROM b UNION ALL SELECT spkts, state, rep, 1, 'attack' FROM a) GROUP BY ALL""")
def _(spark, d):
    return count_of(MG.benign_and_attack(*_sides(spark, d)), "spkts", "state", "rep", "y_true", "attack_type")


@query("mg_2_merge_phases", f"""SELECT round({NUM.format(c='"Dur"')}, 6) AS dur, coalesce(trim("State"), 'nan') AS state, CASE WHEN "DstPkts" = 'n/a' THEN 'attack_scan' ELSE 'benign' END AS attack_type,
  CASE WHEN "DstPkts" = 'n/a' THEN 1 ELSE 0 END AS y_true, round({NUM.format(c='"DstPkts"')}, 6) AS dpkts, CAST(count(*) AS BIGINT) AS n FROM raw_flows GROUP BY ALL""",
       "raw_flows")
def _(spark, d):
    rows = CL.canonical_names(V.raw_flows(spark, d)).withColumn(
        "attack_type", F.when(F.col("dpkts") == "n/a", " attack_scan ").otherwise("benign"))
    phases = [rows.where("attack_type = 'benign'"), rows.where("attack_type <> 'benign'").select(*reversed(rows.columns))]
    return count_of(rounded(MG.merge_phases(MG.union_by_name(phases))), "dur", "state", "attack_type", "y_true", "dpkts")


@query("mg_3_paired_phases", SIDES.replace(", s AS", "WITH s AS", 1) + """ SELECT rep, y_true, attack_type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT rep, 0 AS y_true, 'benign' AS attack_type FROM b WHERE rep IN (SELECT rep FROM a)
  UNION ALL SELECT rep, 1, 'attack' FROM a WHERE rep IN (SELECT rep FROM b)) GROUP BY ALL""")
def _(spark, d):
    return count_of(MG.paired_phases(*_sides(spark, d)), "rep", "y_true", "attack_type")


@query("mg_3_unpaired", SIDES.replace(", s AS", "WITH s AS", 1) + """ SELECT DISTINCT rep, 'benign' AS only_in FROM b WHERE rep NOT IN (SELECT rep FROM a)
UNION SELECT DISTINCT rep, 'attack' FROM a WHERE rep NOT IN (SELECT rep FROM b)""")
def _(spark, d):
    return MG.unpaired(*_sides(spark, d))


@query("mg_4_days", """SELECT day, event_id FROM day_flows WHERE day IN ('Monday', 'Friday')""", "day_flows")
def _(spark, d):
    return MG.days(V.day_flows(spark, d), ["Monday", "Friday"]).select("day", "event_id")


@query("mg_5_dataset_summary", """SELECT profile, CAST(count(*) AS BIGINT) AS n, round(avg(y_true), 6) AS pos_rate, CAST(min(length(row_id)) AS INTEGER) AS rep_min,
  CAST(max(length(row_id)) AS INTEGER) AS rep_max FROM scored GROUP BY profile""", "scored")
def _(spark, d):
    return rounded(MG.dataset_summary(V.scored(spark, d).withColumn("rep", F.length("row_id")), ["profile"]))


@query("mg_5_type_counts", "SELECT attack_type, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1 ORDER BY n DESC", "scored")
def _(spark, d):
    return MG.value_counts(V.scored(spark, d), "attack_type").orderBy(F.col("n").desc())


@query("mg_6_day_statistics", """, c AS (SELECT day, trim("Label") AS label_name, count(*) AS n FROM day_flows GROUP BY 1, 2)
SELECT day, label_name, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY day) AS BIGINT) AS day_n,
  round(sum(CASE WHEN upper(label_name) <> 'BENIGN' THEN n ELSE 0 END) OVER (PARTITION BY day) / (sum(n) OVER (PARTITION BY day))::DOUBLE, 6) AS attack_ratio,
  CAST(row_number() OVER (PARTITION BY day ORDER BY n DESC, label_name) AS INTEGER) AS place FROM c QUALIFY place <= 15""", "day_flows")
def _(spark, d):
    return rounded(MG.day_statistics(V.day_flows(spark, d)))


@query("mg_7_crosstab", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return MG.crosstab(V.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("mg_7_crosstab_wide", """SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS "F",
  CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS "O" FROM lineitem GROUP BY 1""")
def _(spark, d):
    return MG.crosstab_wide(V.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("mg_8_top_values", """SELECT CAST(cust AS DOUBLE) AS cust, CAST(count(*) AS BIGINT) AS n FROM ref GROUP BY 1 ORDER BY n DESC, cust NULLS FIRST LIMIT 10""", "ref")
def _(spark, d):
    return MG.top_values(V.ref_orders(spark, d), "cust", 10)


@query("mg_9_content_row_id", """SELECT md5('0:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey) AS row_id, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1""")
def _(spark, d):
    return count_of(MG.content_row_id(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]), "row_id")


@query("mg_9_positions", """SELECT row_number() OVER () - 1 AS row_id, l_returnflag, l_linenumber FROM lineitem""")
def _(spark, d):
    """Positions tell rows apart that are equal in every column kept."""
    return MG.with_positions(spark, f"{d}/lineitem.parquet").select("row_id", "l_returnflag", "l_linenumber")


@query("sl_5_zipped", """WITH a AS (SELECT row_number() OVER () - 1 AS row_id, o_orderstatus AS y_true FROM orders),
b AS (SELECT row_number() OVER () - 1 AS row_id, c_acctbal AS y_score FROM customer) SELECT row_id, y_true, y_score FROM a JOIN b USING (row_id)""")
def _(spark, d):
    truth = MG.with_positions(spark, f"{d}/orders.parquet").select("row_id", F.col("o_orderstatus").alias("y_true"))
    scores = MG.with_positions(spark, f"{d}/customer.parquet").select("row_id", F.col("c_acctbal").alias("y_score"))
    return MG.zipped(truth, scores)


@query("mg_9_duplicate_keys", """SELECT l_orderkey AS row_id, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return MG.duplicate_keys(V.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "row_id"))


# --- shift --------------------------------------------------------------------------------------------

NUMBERS = ["price", "day", "cust", "flat"]
LONG = """long AS (SELECT feature, value, side FROM (SELECT price, day, cust, flat, 1 AS side FROM ref
  UNION ALL SELECT price, day, cust, flat, 0 FROM tgt) UNPIVOT (value FOR feature IN (price, day, cust, flat)))"""
PSI_SQL = """sorted AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rn,
  count(*) OVER (PARTITION BY feature) AS n FROM long WHERE side = 1),
cuts AS (SELECT DISTINCT p.feature, a.value + (b.value - a.value) * (rest / 10.0e0) AS edge FROM (
  SELECT feature, j, ((n - 1) * j) // 10 AS lo, ((n - 1) * j) % 10 AS rest FROM (SELECT DISTINCT feature, n FROM sorted), range(0, 11) t(j)) p
  JOIN sorted a ON a.feature = p.feature AND a.rn = lo JOIN sorted b ON b.feature = p.feature AND b.rn = lo + CASE WHEN rest > 0 THEN 1 ELSE 0 END),
bins AS (SELECT feature, edge AS low, lead(edge) OVER w AS high, row_number() OVER w AS b, count(*) OVER (PARTITION BY feature) - 1 AS k
  FROM cuts WINDOW w AS (PARTITION BY feature ORDER BY edge)),
cells AS (SELECT bins.feature, b, count(*) FILTER (WHERE side = 1) AS r, count(*) FILTER (WHERE side = 0) AS t FROM bins LEFT JOIN long
  ON long.feature = bins.feature AND value >= low AND (value < high OR (b = k AND value <= high)) WHERE high IS NOT NULL GROUP BY 1, 2),
shares AS (SELECT feature, greatest(r / (sum(r) OVER p)::DOUBLE, {eps}) AS r, greatest(t / greatest(sum(t) OVER p, 1)::DOUBLE, {eps}) AS t,
  count(*) OVER p AS k FROM cells WINDOW p AS (PARTITION BY feature)),
psi AS (SELECT f.feature, (SELECT sum((t - r) * ln(t / r)) FROM shares s WHERE s.feature = f.feature AND k >= 2) AS psi
  FROM (SELECT DISTINCT feature FROM long) f)"""
KS_SQL = """ks AS (SELECT feature, max(abs(r / nr::DOUBLE - t / nt::DOUBLE)) AS ks FROM (SELECT feature, sum(sum(side)) OVER w AS r, sum(sum(1 - side)) OVER w AS t,
  sum(sum(side)) OVER p AS nr, sum(sum(1 - side)) OVER p AS nt FROM long GROUP BY feature, value
  WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)) GROUP BY feature)"""
MEANS_SQL = """means AS (SELECT feature, avg(value) FILTER (WHERE side = 1) AS mean_ref, avg(value) FILTER (WHERE side = 0) AS mean_tgt FROM long GROUP BY 1)"""
TV_SQL = """kinds AS (SELECT feature, category, count(*) FILTER (WHERE side = 1) AS r, count(*) FILTER (WHERE side = 0) AS t FROM (
  SELECT 'status' AS feature, status AS category, 1 AS side FROM ref UNION ALL SELECT 'status', status, 0 FROM tgt
  UNION ALL SELECT 'priority', priority, 1 FROM ref UNION ALL SELECT 'priority', priority, 0 FROM tgt) GROUP BY 1, 2),
tv AS (SELECT feature, 0.5e0 * sum(abs(r / nr - t / nt)) AS tv FROM (SELECT *, (sum(r) OVER p)::DOUBLE AS nr, (sum(t) OVER p)::DOUBLE AS nt
  FROM kinds WINDOW p AS (PARTITION BY feature)) GROUP BY feature)"""
REPORT_SQL = f""", {LONG}, {PSI_SQL.format(eps='1e-6')}, {KS_SQL}, {MEANS_SQL}, {TV_SQL},
report AS (SELECT feature, 'num' AS type, psi, ks, NULL::DOUBLE AS tv, mean_ref, mean_tgt FROM psi JOIN ks USING (feature) JOIN means USING (feature)
  UNION ALL SELECT feature, 'cat', NULL, NULL, tv, NULL, NULL FROM tv)"""


def _values(spark, d):
    return SH.long_numbers(V.ref_orders(spark, d), V.tgt_orders(spark, d), NUMBERS)


@query("sh_1_psi", f", {LONG}, {PSI_SQL.format(eps='1e-6')} SELECT feature, round(psi, 6) AS psi FROM psi", "ref tgt")
def _(spark, d):
    return rounded(SH.psi(_values(spark, d)))


@query("sh_2_psi_variant", f", {LONG}, {PSI_SQL.format(eps='1e-8')} SELECT feature, round(psi, 6) AS psi FROM psi", "ref tgt")
def _(spark, d):
    return rounded(SH.psi(_values(spark, d), eps=1e-8, min_n=1))


@query("sh_3_ks", f", {LONG}, {KS_SQL} SELECT feature, round(ks, 6) AS ks FROM ks", "ref tgt")
def _(spark, d):
    return rounded(SH.ks(_values(spark, d)))


@query("sh_4_total_variation", f", {TV_SQL} SELECT feature, round(tv, 6) AS tv FROM tv", "ref tgt")
def _(spark, d):
    return rounded(SH.total_variation(V.ref_orders(spark, d), V.tgt_orders(spark, d), ["status", "priority"]))


@query("sh_5_means", f", {LONG}, {MEANS_SQL} SELECT feature, round(mean_ref, 6) AS mean_ref, round(mean_tgt, 6) AS mean_tgt FROM means", "ref tgt")
def _(spark, d):
    return rounded(SH.means(_values(spark, d)))


@query("sh_6_shift_report", REPORT_SQL + """ SELECT feature, type, round(psi, 6) AS psi, round(ks, 6) AS ks, round(tv, 6) AS tv,
  round(mean_ref, 6) AS mean_ref, round(mean_tgt, 6) AS mean_tgt FROM report""", "ref tgt")
def _(spark, d):
    return rounded(SH.shift_report(V.ref_orders(spark, d), V.tgt_orders(spark, d)))


@query("sh_7_top_shifts", REPORT_SQL + """, keyed AS (SELECT *, CASE WHEN type = 'num' THEN coalesce(psi, 0) * 10 + coalesce(ks, 0) ELSE coalesce(tv, 0) END AS rank_key FROM report)
SELECT feature, type, round(rank_key, 6) AS rank_key, CAST(row_number() OVER (PARTITION BY type ORDER BY keyed.rank_key DESC, feature) AS INTEGER) AS place
FROM keyed QUALIFY place <= 25""", "ref tgt")
def _(spark, d):
    top = SH.top_shifts(SH.shift_report(V.ref_orders(spark, d), V.tgt_orders(spark, d)))
    return rounded(top.select("feature", "type", "rank_key", "place"))


@query("sh_8_equivalence_report", f""", {LONG}, {PSI_SQL.format(eps='1e-8')}, {KS_SQL}, {MEANS_SQL}
SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, round(mean_ref, 6) AS mean_ref, round(mean_tgt, 6) AS mean_tgt
FROM psi JOIN ks USING (feature) JOIN means USING (feature)""", "ref tgt")
def _(spark, d):
    return rounded(SH.equivalence_report(V.ref_orders(spark, d), V.tgt_orders(spark, d), NUMBERS))


@query("sh_8_equivalence_counts", """, v AS (SELECT 'ref' AS side, * FROM ref UNION ALL SELECT 'tgt', * FROM tgt),
c AS (SELECT side, 'status' AS "column", status AS value, count(*) AS n FROM v GROUP BY ALL
  UNION ALL SELECT side, 'priority', priority, count(*) FROM v GROUP BY ALL)
SELECT side, 'rows' AS "column", NULL AS value, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY side
UNION ALL SELECT side, "column", value, CAST(n AS BIGINT) FROM c QUALIFY row_number() OVER (PARTITION BY side, "column" ORDER BY n DESC, value NULLS FIRST) <= 10""",
       "ref tgt")
def _(spark, d):
    return SH.equivalence_counts(V.ref_orders(spark, d), V.tgt_orders(spark, d), ["status", "priority"])


@query("sh_9_verdict", REPORT_SQL + """ SELECT round(max(psi), 6) AS max_psi, round(max(ks), 6) AS max_ks, CASE WHEN max(psi) > 0.25 THEN 'large'
  WHEN max(psi) >= 0.1 THEN 'moderate' ELSE 'small' END AS verdict FROM report""", "ref tgt")
def _(spark, d):
    return rounded(SH.verdict(SH.shift_report(V.ref_orders(spark, d), V.tgt_orders(spark, d))))


@query("sh_10_histogram", """, long AS (SELECT feature, value FROM (SELECT price, day, flat FROM ref) UNPIVOT (value FOR feature IN (price, day, flat))),
ends AS (SELECT feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5e0 ELSE min(value) END AS lo,
  CASE WHEN min(value) = max(value) THEN max(value) + 0.5e0 ELSE max(value) END AS hi, count(*) AS n FROM long GROUP BY 1),
c AS (SELECT feature, least(floor((value - lo) / ((hi - lo) / 50.0e0)), 49) AS bin, count(*) AS c FROM long JOIN ends USING (feature) GROUP BY 1, 2)
SELECT feature, CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 50.0e0), 6) AS "left", CAST(coalesce(c, 0) AS BIGINT) AS n,
  round(coalesce(c, 0) / (n * ((hi - lo) / 50.0e0)), 6) AS density FROM ends CROSS JOIN range(0, 50) t(b) LEFT JOIN c ON c.feature = ends.feature AND c.bin = b""".replace(
    "SELECT feature, CAST(b", "SELECT ends.feature, CAST(b"), "ref")
def _(spark, d):
    return rounded(SH.histogram(V.ref_orders(spark, d), ["price", "day", "flat"]))


# --- feature preparation ------------------------------------------------------------------------------

def _gaps(spark, d):
    """Training rows with gaps in numbers and text."""
    lines = V.table(spark, d, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("k"),
        F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_extendedprice")).alias("sbytes"),
        F.when(F.col("l_linenumber") == 5, float("inf")).otherwise(F.col("l_quantity")).alias("spkts"),
        F.lit(None).cast("double").alias("void"), F.lit(2.0).alias("flat"),
        F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_returnflag")).alias("state"),
        F.when(F.col("l_linenumber") <= 4, F.col("l_linestatus")).alias("proto"))


GAPS = """WITH gaps AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS sbytes,
  CASE WHEN l_linenumber = 5 THEN 'inf'::DOUBLE ELSE l_quantity END AS spkts, NULL::DOUBLE AS void, 2.0e0 AS flat,
  CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS state, CASE WHEN l_linenumber <= 4 THEN l_linestatus END AS proto FROM lineitem)"""
MEDIANS = """(SELECT median(sbytes) FROM gaps) AS m1, (SELECT median(spkts) FROM gaps WHERE isfinite(spkts)) AS m2"""


@query("ft_1_column_kinds", GAPS + """, c AS (SELECT count(k) AS k, count(sbytes) AS sbytes, count(spkts) AS spkts, count(void) AS void, count(flat) AS flat,
  count(state) AS state, count(proto) AS proto FROM gaps)
SELECT name, CASE WHEN name IN ('state', 'proto') THEN 'cat' ELSE 'num' END AS kind, filled FROM c UNPIVOT (filled FOR name IN (k, sbytes, spkts, void, flat, state, proto))""")
def _(spark, d):
    return FT.column_kinds(_gaps(spark, d))


@query("io_16_required_columns", GAPS + """ SELECT 'sbytes' AS name, true AS present, count(sbytes) AS filled FROM gaps UNION ALL SELECT 'void', true, count(void) FROM gaps
UNION ALL SELECT 'saddr', false, 0""")
def _(spark, d):
    """The check before a job; ``require_columns`` refuses a table that lacks any."""
    return required_columns(require_columns(_gaps(spark, d), ["sbytes", "void"]), ["sbytes", "void", "saddr"])


@query("ft_2_numeric_only", GAPS + " SELECT k, sbytes, flat, void, CASE WHEN isfinite(spkts) THEN spkts ELSE -1 END AS spkts FROM gaps")
def _(spark, d):
    return FT.numeric_only(_gaps(spark, d)).withColumn("spkts", F.when(F.col("spkts") == float("inf"), -1.0).otherwise(F.col("spkts")))


@query("ft_3_medians", GAPS + """ SELECT 'sbytes' AS feature, round(median(sbytes), 6) AS median FROM gaps
UNION ALL SELECT 'spkts', round(median(spkts), 6) FROM gaps WHERE isfinite(spkts) UNION ALL SELECT 'void', 0.0e0 UNION ALL SELECT 'flat', 2.0e0""")
def _(spark, d):
    return rounded(FT.fit_medians(_gaps(spark, d), ["sbytes", "spkts", "void", "flat"]))


@query("ft_3_impute_medians", GAPS + f""" SELECT k, round(coalesce(sbytes, m1), 6) AS sbytes, CASE WHEN isfinite(spkts) THEN spkts ELSE m2 END AS spkts,
  0.0e0 AS void FROM gaps, (SELECT {MEDIANS})""")
def _(spark, d):
    rows, columns = _gaps(spark, d), ["sbytes", "spkts", "void"]
    return rounded(FT.impute_medians(rows, FT.fit_medians(rows, columns), columns).select("k", *columns))


@query("ft_3_quantiles_by_group", """, q AS (SELECT y_true, unnest(quantile_cont(y_score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS v, generate_subscripts([0,1,2,3,4,5,6,7,8,9,10], 1) - 1 AS step
  FROM scored_fine GROUP BY y_true)
SELECT y_true, CAST(step AS INTEGER) AS step, round(v, 6) AS quantile FROM q""", "scored_fine")
def _(spark, d):
    return rounded(exact_quantiles(V.scored_fine(spark, d), ["y_true"], "y_score", 10))


@query("ft_4_modes", GAPS + """, c AS (SELECT 'state' AS feature, state AS v, count(*) AS n FROM gaps WHERE state IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'proto', proto, count(*) FROM gaps WHERE proto IS NOT NULL GROUP BY 2)
SELECT feature, v AS mode FROM c QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) = 1""")
def _(spark, d):
    return FT.fit_modes(_gaps(spark, d), ["state", "proto"])


@query("ft_4_impute_modes", GAPS + """, m AS (SELECT (SELECT state FROM gaps WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, state LIMIT 1) AS a,
  (SELECT proto FROM gaps WHERE proto IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, proto LIMIT 1) AS b)
SELECT coalesce(state, a) AS state, coalesce(proto, b) AS proto, CAST(count(*) AS BIGINT) AS n FROM gaps, m GROUP BY 1, 2""")
def _(spark, d):
    rows = _gaps(spark, d)
    return count_of(FT.impute_modes(rows, FT.fit_modes(rows, ["state", "proto"]), ["state", "proto"]), "state", "proto")


@query("ft_5_scales", GAPS + """ SELECT 'sbytes' AS feature, round(stddev_pop(sbytes), 6) AS scale FROM gaps UNION ALL SELECT 'flat', 1.0e0""")
def _(spark, d):
    return rounded(FT.fit_scales(_gaps(spark, d), ["sbytes", "flat"]))


@query("ft_5_scaled", GAPS + """ SELECT k, round(sbytes / s, 6) AS sbytes, 2.0e0 AS flat FROM gaps, (SELECT stddev_pop(sbytes) AS s FROM gaps)""")
def _(spark, d):
    rows = _gaps(spark, d)
    return rounded(FT.scale(rows, FT.fit_scales(rows, ["sbytes", "flat"]), ["sbytes", "flat"]).select("k", "sbytes", "flat"))


CODES = """codes AS (SELECT feature, v, dense_rank() OVER (PARTITION BY feature ORDER BY v) - 1 AS code FROM (
  SELECT DISTINCT 'state' AS feature, coalesce(state, 'NA') AS v FROM {rows} UNION SELECT DISTINCT 'proto', coalesce(proto, 'NA') FROM {rows}))"""


@query("ft_7_union_codes", GAPS + ", " + CODES.format(rows="gaps") + " SELECT feature, v AS value, CAST(code AS BIGINT) AS code FROM codes")
def _(spark, d):
    rows = _gaps(spark, d)
    return FT.union_codes(rows.where("k % 2 = 0"), rows.where("k % 2 = 1"), ["state", "proto"])


@query("ft_8_train_codes", GAPS + ", train AS (SELECT * FROM gaps WHERE state IS DISTINCT FROM 'R'), " + CODES.format(rows="train")
       + " SELECT feature, v AS value, CAST(code AS BIGINT) AS code FROM codes")
def _(spark, d):
    return FT.fit_codes(_gaps(spark, d).where("state IS DISTINCT FROM 'R'"), ["state", "proto"])


@query("ft_9_encode_unknown", GAPS + ", train AS (SELECT * FROM gaps WHERE state IS DISTINCT FROM 'R'), " + CODES.format(rows="train") + """
SELECT k, CAST(coalesce(a.code, 0) AS BIGINT) AS state, CAST(coalesce(b.code, 0) AS BIGINT) AS proto FROM gaps
LEFT JOIN codes a ON a.feature = 'state' AND a.v = coalesce(state, 'NA') LEFT JOIN codes b ON b.feature = 'proto' AND b.v = coalesce(proto, 'NA')""")
def _(spark, d):
    rows = _gaps(spark, d)
    codes = FT.fit_codes(rows.where("state IS DISTINCT FROM 'R'"), ["state", "proto"])
    return FT.encode(rows, codes, ["state", "proto"]).select("k", "state", "proto")


for _set, _extra in (("portable", ""), ("ports", "sport, dport, ")):
    @query(f"ft_10_features_{_set}", f""", {ENDPOINTS.replace('FROM packets', f'FROM packets WHERE {TRANSPORT}')},
flows AS (SELECT round(max(t) - min(t), 6) AS dur, transport AS proto, coalesce(sport, '') AS sport, coalesce(dport, '') AS dport, 'NA' AS state,
  CAST(count(*) AS BIGINT) AS spkts, CAST(0 AS BIGINT) AS dpkts, CAST(sum(flen) AS BIGINT) AS sbytes, CAST(0 AS BIGINT) AS dbytes
  FROM ends GROUP BY transport, saddr, sport, daddr, dport)
SELECT dur, proto, state, {_extra}spkts, dpkts, sbytes, dbytes FROM flows""", "packets")
    def _(spark, d, name=_set):
        return rounded(FT.feature_set(FL.directional_flows(V.packets(spark, d)), name))


@query("ft_11_numeric_without_label", "SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(spark, d):
    return FT.numeric_only(V.table(spark, d, "lineitem"), ["l_orderkey"])


@query("io_15_empty_schema", "SELECT " + ", ".join(
    f"CAST(NULL AS {dict(double='DOUBLE', string='VARCHAR', bigint='BIGINT')[f.dataType.simpleString()]}) AS {f.name}" for f in FLOW_SCHEMA.fields)
    + " FROM events WHERE event_id < 0")
def _(spark, d):
    return FL.directional_flows(V.packets(spark, d).where("packet_id < 0"))
