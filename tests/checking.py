"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else ("float", value + 0.0)
    return (type(value).__name__, value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, connection, function, sql: str, folder: str) -> str | None:
    """None if equal, else what differs."""
    df = function(spark, folder)
    left_columns, left = table(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    right_columns, right = table([c[0] for c in result.description], result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} vs {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}; first {left[:2]} / {right[:2]}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}" if wrong else None


def main(folder: str, wanted: list[str]) -> int:
    from flowlens.plans.catalog import ORACLES, QUERIES
    from flowlens.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name, function in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, connection, function, ORACLES[name], folder)
                state = "ok" if problem is None else f"DIFF {problem[:600]}"
            else:
                state = f"rows {function(spark, folder).count()}"
        except Exception as error:  # one broken query must not hide the others
            state = f"FAIL {type(error).__name__}: {str(error)[:700]}"
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"@ {name} {time.time() - start:.1f}s {state}", flush=True)
    print(f"@ done, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
