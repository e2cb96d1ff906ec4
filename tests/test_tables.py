"""Cleaning, sources, flows, shift, features, models and streams on small fixtures."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import cleaning as C
from flowlens.functions.relational import require_columns
from flowlens.operators import cleaning as CL
from flowlens.operators import features as FT
from flowlens.operators import flows as FL
from flowlens.operators import labels as LB
from flowlens.operators import merge as MG
from flowlens.operators import models as ML
from flowlens.operators import shift as SH
from flowlens.schemas import FLOW_SCHEMA, PACKET_SCHEMA
from flowlens.session import scratch_path
from flowlens.sources import files as S
from flowlens.streaming import flows as ST


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,number", [(" 1 ", 1.0), ("abc", None), ("", None), (None, None), ("NaN", None), ("-2.5e3", -2500.0)])
def test_number_or_null(spark, text, number):
    assert one(spark, text, C.number_or_null) == number
    assert one(spark, text, C.number_or_zero) == (number or 0.0)


@pytest.mark.parametrize("text,name", [("6", "tcp"), ("6.0", "tcp"), (" TCP ", "tcp"), ("17", "udp"), ("58", "ipv6-icmp"), ("1", "icmp"),
                                       ("47", "47"), ("", "unk"), ("gre", "gre")])
def test_protocol_any(spark, text, name):
    assert one(spark, text, C.protocol_any) == name


def test_infinity_is_missing(spark):
    assert one(spark, "Infinity", C.finite_number) is None and one(spark, "-inf", C.finite_number) is None


@pytest.mark.parametrize("name,day", [("Friday-x.csv", "Friday"), ("a-TUESDAY.csv", "Tuesday"), ("week.csv", "Unknown")])
def test_weekday(spark, name, day):
    assert one(spark, name, C.weekday_in) == day


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="daddr"):
        CL.clean_flows(spark.createDataFrame([("1",)], "SrcAddr string"))
    with pytest.raises(ValueError):
        require_columns(spark.range(1), ["nope"])
    with pytest.raises(ValueError):
        CL.one_label(spark.range(1))


def test_missing_labels_go_before_text(spark):
    df = spark.createDataFrame([(" BENIGN ",), (None,), ("nan",)], "Label string")
    assert sorted(r[0] for r in CL.labelled_only(df).collect()) == ["BENIGN", "nan"]


def test_longest_prefix_wins(spark):
    df = spark.createDataFrame([("attack_exfil_1",), ("attack_2",), ("benign_1",), ("x",)], "name string")
    assert [r[0] for r in LB.family_label(df, "name").select("attack_type").collect()] == ["attack_exfil", "attack_main", "benign", None]


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "phases")


def test_phase_folder(spark, folder):
    write(folder, "benign_1.csv", "dur , spkts\n1,2\n,3\n")
    write(folder, "attack_exfil_burst_1.csv", "spkts,dur\n7,0.5\n")
    write(folder, "attack_scan_2.csv", "dur,spkts\n")
    write(folder, "notes_1.csv", "dur,spkts\n9,9\n")
    rows = MG.merge_phases(S.with_phase(S.union_csv(spark, folder)))
    got = sorted((r["attack_type"], r["rep"], r["y_true"], r["dur"], r["spkts"]) for r in rows.collect())
    assert got == [("attack_exfil_burst", 1, 1, 0.5, 7.0), ("benign", 1, 0, 0.0, 3.0), ("benign", 1, 0, 1.0, 2.0)]
    assert [r["file_name"] for r in S.empty_files(spark, folder).collect()] == ["attack_scan_2.csv"]
    files = {r["phase"]: r["files"] for r in S.phase_inventory(S.list_files(spark, folder)).collect()}
    assert files["benign"] == 1 and files["attack_c2_beacon"] == 0


def test_two_files_of_a_day_add_up(spark, folder, tmp_path):
    header = " Source IP, Flow Bytes, Label\n"
    write(folder, "Monday-a.csv", header + "1.1.1.1,5, BENIGN\n")
    write(folder, "Monday-b.csv", header + "1.1.1.2,Infinity,Bot \n1.1.1.3,,\n")
    write(folder, "extra.csv", header + "1.1.1.4,7,BENIGN\n")
    target = str(tmp_path / "days")
    S.csv_to_days(spark, folder, target)
    days = S.scan_days(spark, target, ["Monday"])
    assert sorted(days.columns) == ["Flow Bytes", "Label", "day"]
    assert sorted((r["Flow Bytes"], r["Label"]) for r in days.fillna(-1.0).collect()) == [(-1.0, "Bot"), (5.0, "BENIGN")]
    with pytest.raises(ValueError, match="Friday"):
        S.scan_days(spark, target, ["Friday"])


def test_empty_folder(spark, folder):
    os.makedirs(folder)
    with pytest.raises(ValueError):
        S.union_csv(spark, folder)


def test_unpaired_repetitions(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "rep int"), spark.createDataFrame([(2,), (3,)], "rep int")
    assert sorted((r["rep"], r["only_in"]) for r in MG.unpaired(a, b).collect()) == [(1, "benign"), (3, "attack")]


# --- packets and flows --------------------------------------------------------------------------------

def packet(t, src, dst, sp=None, dp=None, udp=False, six=False, n=10):
    port = (None, None, sp, dp) if udp else (sp, dp, None, None)
    number = "17" if udp else ("6" if sp else "1")
    return (t, None if six else number, number if six else None, None if six else src, None if six else dst,
            src if six else None, dst if six else None, *port, n)


PACKETS = [packet(10.0, "a", "b", "1", "2"), packet(11.0, "a", "b", "1", "2", n=5), packet(10.5, "b", "a", "2", "1"),
           packet(12.0, "x", "y", "1", "2", udp=True, six=True), packet(None, "a", "b", "1", "2"), packet(13.0, "p", "q")]


def test_directional_flows(spark):
    got = {(r["proto"], r["saddr"]): r for r in FL.directional_flows(spark.createDataFrame(PACKETS, PACKET_SCHEMA)).collect()}
    assert set(got) == {("tcp", "a"), ("tcp", "b"), ("udp", "x")}
    assert (got["tcp", "a"]["dur"], got["tcp", "a"]["spkts"], got["tcp", "a"]["sbytes"]) == (1.0, 3, 25)


def test_windows_start_at_the_first_packet(spark):
    got = FL.windowed_flows(spark.createDataFrame(PACKETS, PACKET_SCHEMA), 1.0)
    assert sorted((r["win"], r["proto"], r["saddr"], r["spkts"]) for r in got.collect()) == [
        (0, "tcp", "a", 1), (0, "tcp", "b", 1), (1, "tcp", "a", 1), (2, "udp", "x", 1), (3, "icmp", "p", 1)]


def test_conversation_starts_with_its_first_packet(spark):
    got = {r["proto"]: r for r in FL.conversations(spark.createDataFrame(PACKETS, PACKET_SCHEMA)).collect()}
    assert (got["tcp"]["saddr"], got["tcp"]["spkts"], got["tcp"]["dpkts"], got["tcp"]["dbytes"]) == ("a", 2, 1, 10)


def test_no_packets_keep_the_schema(spark):
    flows = FL.directional_flows(spark.createDataFrame([], PACKET_SCHEMA))
    assert flows.columns == FLOW_SCHEMA.names and flows.count() == 0


def test_stream_equals_batch_and_drops_late_packets(spark):
    rows = [packet(float(t), "a", "b", "1", "2") for t in range(100)]
    source, target = scratch_path(spark, "p"), scratch_path(spark, "f")
    spark.createDataFrame(rows, PACKET_SCHEMA).repartitionByRange(5, "t").write.parquet(source)
    stream = ST.streaming_flows(ST.packet_stream(spark, source, PACKET_SCHEMA, 1), "10 seconds", "1000 seconds")
    ST.run_available(stream, target, scratch_path(spark, "c"), mode="update")
    got = ST.latest_flows(spark.read.parquet(target))
    assert got.count() == 10 and got.agg(F.sum("spkts")).first()[0] == 100


# --- shift --------------------------------------------------------------------------------------------

def brute_psi(ref, tgt, eps, min_n):
    if len(ref) < min_n or len(tgt) < min_n:
        return None
    cuts = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    if len(cuts) < 3:
        return None
    e, a = (np.clip(np.histogram(v, cuts)[0] / max(np.histogram(v, cuts)[0].sum(), 1), eps, 1) for v in (ref, tgt))
    return float(np.sum((a - e) * np.log(a / e)))


def test_psi_and_ks_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    sides = {1: {"near": rng.normal(size=500), "ties": rng.integers(0, 4, 500).astype(float), "flat": np.ones(500), "few": rng.normal(size=49)},
             0: {"near": rng.normal(0.3, 1.5, size=400), "ties": rng.integers(1, 6, 400).astype(float), "flat": np.ones(400), "few": rng.normal(size=400)}}
    rows = [(f, float(v), side) for side, cols in sides.items() for f, vs in cols.items() for v in vs]
    values = spark.createDataFrame(rows, "feature string, value double, is_ref int")
    for eps, min_n in ((1e-6, 50), (1e-8, 1)):
        got = {r["feature"]: r["psi"] for r in SH.psi(values, eps=eps, min_n=min_n).collect()}
        for f in sides[1]:
            want = brute_psi(sides[1][f], sides[0][f], eps, min_n)
            assert got[f] == (pytest.approx(want, abs=1e-9) if want is not None else None)
    got = {r["feature"]: r["ks"] for r in SH.ks(values).collect()}
    for f in sides[1]:
        x, y = np.sort(sides[1][f]), np.sort(sides[0][f])
        at = np.union1d(x, y)
        want = np.max(np.abs(np.searchsorted(x, at, side="right") / len(x) - np.searchsorted(y, at, side="right") / len(y)))
        assert got[f] == pytest.approx(want)


def test_a_table_has_no_shift_from_itself(spark):
    df = spark.range(300).select((F.col("id") % 17).cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("c"),
                                 F.when(F.col("id") == 3, math.inf).otherwise(1.0 * F.col("id")).alias("w"))
    for r in SH.shift_report(df, df).collect():
        assert (r["psi"], r["ks"], r["tv"]) in ((0.0, 0.0, None), (None, None, 0.0))


# --- features and models ------------------------------------------------------------------------------

def test_codes_of_unseen_values(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "p string")
    codes = FT.fit_codes(train, ["p"])
    got = FT.encode(spark.createDataFrame([("a",), ("z",), (None,)], "p string"), codes, ["p"], unknown=-1)
    assert sorted(r[0] for r in got.collect()) == [-1, 0, 1]


def test_scale_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    got = {r["feature"]: r["scale"] for r in FT.fit_scales(df, ["a", "b"]).collect()}
    assert got == {"a": 1.0, "b": 1.0}


def test_forbidden_columns_never_reach_the_features(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 0, "c")], "id int, srcip string, dur double, label int, attack_cat string")
    assert CL.drop_leakage(df, "benchmark").columns == ["dur", "label", "attack_cat"]


def test_classifiers_learn_a_separable_table(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y_true"),
                                 (F.col("id") % 2 + F.rand(1) * 0.5).alias("dur"), F.when(F.col("id") % 2 == 0, "tcp").otherwise("udp").alias("proto"))
    for classifier in (ML.logistic(20), ML.forest(5, 3), ML.boosted(3, 2, 0.3)):
        model = ML.fit(df, classifier, ["dur"], ["proto"])
        assert ML.score(model, df).where("y_true = y_pred").count() > 390
    path = scratch_path(spark, "model")
    ML.save(model, path)
    again = ML.score_new(ML.load(path), df.select("row_id", "dur"))
    assert again.count() == 400 and again.columns == ["row_id", "y_score", "y_pred"]
    best, _, grid = ML.best_by_validation(df, df, ML.logistic, [1, 10], ["dur"])
    assert best in (1, 10) and grid.count() == 2


# --- positions and checks -----------------------------------------------------------------------------

def test_positions_of_equal_rows_over_many_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.lit("same").alias("a"), (F.col("id") % 3).alias("b")).repartition(7).write.parquet(path)
    spark.createDataFrame([], "a string, b bigint").write.mode("append").parquet(path)
    one = [tuple(r) for r in MG.with_positions(spark, path).collect()]
    assert sorted(r[2] for r in one) == list(range(1000))
    assert sorted(one) == sorted(tuple(r) for r in MG.with_positions(spark, path).repartition(3).collect())
    files = sorted({r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).collect()})
    want = [tuple(r) for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
    assert [r[:2] for r in sorted(one, key=lambda r: r[2])] == want


def test_zip_stops_at_the_shorter_table(spark, tmp_path):
    for name, n in (("x", 5), ("y", 3)):
        spark.range(n).select(F.col("id").alias(name), F.lit(name).alias("both")).coalesce(1).write.parquet(str(tmp_path / name))
    x, y = (MG.with_positions(spark, str(tmp_path / n)) for n in "xy")
    for a, b in ((x, y), (y, x)):
        got = MG.zipped(a, b).orderBy("row_id").collect()
        assert [(r.row_id, r.x, r.y) for r in got] == [(i, i, i) for i in range(3)] and {r.both for r in got} == {a.first().both}


def test_column_kinds_and_required_columns(spark):
    from flowlens.functions.relational import required_columns
    df = spark.createDataFrame([(1, None, True, "a"), (2, 2.0, None, None)], "i int, d double, `b.x` boolean, s string")
    assert [tuple(r) for r in FT.column_kinds(df, ["i"]).collect()] == [("d", "num", 1), ("b.x", "num", 1), ("s", "cat", 1)]
    assert [tuple(r) for r in required_columns(df.limit(0), ["s", "none"]).collect()] == [("s", True, 0), ("none", False, 0)]
