"""Numbers and tables read back out of logs, against plain readers of the same lines."""

import duckdb
import pytest
from checking import compare

from flowlens.operators import reports as RP
from flowlens.plans.catalog import ORACLES, QUERIES


def logs(spark, *texts):
    return spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(texts)], "experiment string, value string")


def test_every_way_to_print_a_number(spark):
    texts = [f"x\n  PR-AUC   mean={n}  CI95=[{n}, {n}]\n  TPR mean=9 CI95=[9,9]" for n in ("1e-05", "0.5", ".5", "-2.5E+3", "nan", "7", "inf", "-NaN")]
    got = {r.experiment: tuple(r.ci) for r in RP.log_intervals(logs(spark, *texts, "PR-AUC mean=abc CI95=[1,2]", "", None), RP.SCORE_LABELS).collect()}
    want = [1e-05, 0.5, 0.5, -2500.0, None, 7.0, None, None]
    assert got == {f"e{i}": (w, w, w) for i, w in enumerate(want)}


def test_a_label_is_a_whole_word(spark):
    text = "TPR mean=1 CI95=[1,1]\nMAP mean= 3 std= 3\n[FewShot]  k= 5 reps=2\n F1 mean= 1 std= 1e-05\n P  mean= 2 std= nan\n R  mean=4 std=5"
    row = RP.log_few_shot(logs(spark, text)).first()
    assert tuple(row) == ("e0", 5, 2, 1.0, 1e-05, 2.0, None, 4.0, 5.0)
    assert RP.log_few_shot(logs(spark, text.replace(" R  mean", " TPR mean"))).count() == 0
    assert [r.metric for r in RP.log_intervals(logs(spark, text), {"pr": "PR", "tpr": "TPR"}).collect()] == ["tpr"]


@pytest.mark.parametrize("line,text,want", [
    (RP.POINT, "PR-AUC(AP): 0.25\nmore\nlines\nFPR@TPR=0.95:1e-3", (0.25, 0.001)),
    (RP.ORACLE, "[ORACLE] best_F1= 0.9 thr=.5\n precision= 1.0 junk recall= 0.8", (0.9, 0.5, 1.0, 0.8)),
    (RP.BEST_F1, "[BestF1]\n  thr= 1e-05  F1= 0.5 P= nan R=1", (1e-05, 0.5, None, 1.0)),
    (RP.BEST_F1, "[BestF1] other thr= 1", None),
])
def test_point_lines(spark, line, text, want):
    got = RP.log_points(logs(spark, text), line, ["a", "b", "c", "d"][:line.count("#")]).collect()
    assert [tuple(r)[1:] for r in got] == ([want] if want else [])


def plain_table(text):
    lines = [" ".join(x.split()) for x in text.split("\n")]
    start = next((i for i, x in enumerate(lines) if x.lower().startswith("feature") and " psi" in x.lower() and " ks" in x.lower()), None)
    out = []
    for line in lines[start + 1:] if start is not None else []:
        if not line:
            break
        words = line.split()
        at = next((i for i, w in enumerate(words) if w in ("num", "cat")), 0)
        if line.startswith("#") or at < 1 or at + 2 >= len(words):
            continue

        def number(w):
            try:
                return float(w)
            except ValueError:
                return None
        found = [number(w) for w in words[at + 1:]]
        if found[0] is None or found[1] is None:
            found = [x for x in found if x is not None]
        if len(found) >= 2 and all(abs(x) < 1e300 for x in found[:2]):
            out.append((" ".join(words[:at]), *found[:2]))
    return out


def test_shift_tables(spark):
    texts = [
        "log\nearly num 9 9\n feature  type psi  ks tv\nBwd Packet Length  Std num 3.600012 0.442312 NaN 1e3\n# x num 8 8\nproto cat NaN NaN 0.5\n"
        "odd num n/a 0.25 0.75\nshort num 1\nnum 1 2 3\nnum num 2 3\nFlow cat 1e-05 -2 num 5\n\nlate num 7 7\n",
        "feature type ks\na num 1 2", "  FEATURE kind  PSI  KS\r\nb\tnum\t1\t2\r\n", "", None]
    got = sorted(tuple(r) for r in RP.parse_shift_table(logs(spark, *texts), k=100).collect())
    assert got == sorted(r for t in texts for r in plain_table(t or "")) and len(got) == 4
    assert [r.feature for r in RP.parse_shift_table(logs(spark, *texts), k=2).collect()] == ["Bwd Packet Length Std", "b"]


@pytest.mark.parametrize("name", ["rp_1_log_intervals", "rp_1_log_decision_intervals"])
def test_intervals_that_reach_below_zero_are_printed_and_read(spark, tmp_path, name):
    """A balance under a cent's hundredfold: the lower end is negative, and once was printed with the sign inside."""
    spark.createDataFrame([(1, 0.27), (2, -0.99), (3, 0.0), (4, 9999.99)], "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(
        f"{tmp_path}/supplier.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert compare(spark, connection, QUERIES[name], ORACLES[name], str(tmp_path)) is None
