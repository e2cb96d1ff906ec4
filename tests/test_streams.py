"""Captures in several runs: late packets, windows from the first packet, runs that break off."""

import math
import random
from collections import defaultdict

import pytest

from flowlens.schemas import PACKET_SCHEMA
from flowlens.session import scratch_path
from flowlens.streaming import flows as ST

WIDTH, LATENESS = 10, 30


def packet(t, source, size):
    row = dict.fromkeys(PACKET_SCHEMA.names)
    return tuple((row | {"t": t, "ip_proto": "6", "ip_src": source, "ip_dst": "z", "tcp_sp": "1", "tcp_dp": "2", "flen": size}).values())


def capture(seed):
    """Runs of packets; some come a run or two late, some before the capture's first one."""
    rng = random.Random(seed)
    runs = [[] for _ in range(5)]
    for i in range(400):
        t = 1003.25 + rng.random() * 300
        late = rng.choice([0] * 12 + [1, 2])
        runs[min(4, int((t - 1003.25) / 60) + late)].append((t, rng.choice("abc"), rng.randint(40, 90)))
    runs[0].insert(0, (1003.25, "a", 40))
    runs[1].append((1001.0, "b", 50))
    return runs


def plain_flows(runs, start):
    """Windows from ``start``; a packet is dropped if its window ended at or before what earlier runs had seen less LATENESS."""
    seen, cells, dropped = -1e9, defaultdict(list), 0
    for run in runs:
        mark = math.floor(seen * 1000) / 1000 - LATENESS
        for t, source, size in run:
            win = math.floor((t - start) / WIDTH)
            if start + (win + 1) * WIDTH <= mark:
                dropped += 1
            else:
                cells[win, source].append((t, size))
        seen = max([seen, *(t for t, _, _ in run)])
    closed = {k: v for k, v in cells.items() if start + (k[0] + 1) * WIDTH <= seen - LATENESS}
    return sorted((w, s, len(v), sum(x for _, x in v), round(max(v)[0] - min(v)[0], 6)) for (w, s), v in closed.items()), dropped


def feed(spark, runs, broken=()):
    source, target, state = (scratch_path(spark, n) for n in ("packets", "flows", "state"))
    start = None
    for i, run in enumerate(runs):
        spark.createDataFrame([packet(*p) for p in run], PACKET_SCHEMA).coalesce(2).write.mode("append").parquet(source)
        start = ST.capture_start(spark.read.parquet(source), f"{state}-start")
        stream = ST.capture_flows(ST.packet_stream(spark, source, PACKET_SCHEMA), start, WIDTH, f"{LATENESS} seconds")
        if i in broken:  # the batch is written, but the run is lost before it is committed
            def lost(batch, batch_id):
                batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
                raise OSError("the driver was lost")
            query = (stream.writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(lost)
                     .trigger(availableNow=True).start())
            with pytest.raises(Exception):
                query.awaitTermination()
        ST.run_available(stream, target, state)
    rows = spark.read.parquet(target).collect()
    return start, sorted((r.win, r.saddr, r.spkts, r.sbytes, round(r.dur, 6)) for r in rows)


@pytest.mark.parametrize("seed,broken", [(1, ()), (2, (0, 2, 3))])
def test_late_packets_are_dropped_and_restarts_change_nothing(spark, seed, broken):
    runs = capture(seed)
    start, got = feed(spark, runs, broken)
    assert start == 1003250000
    want, dropped = plain_flows(runs, start / 1e6)
    assert got == want and dropped > 3 and len(want) > 40


def test_a_capture_without_packets(spark):
    with pytest.raises(ValueError):
        ST.capture_start(spark.createDataFrame([], PACKET_SCHEMA), scratch_path(spark, "start"))
