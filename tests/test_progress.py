"""Records of a download let through at most once an interval: side by side, against one after the other."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from veilspark.streaming import progress as P

T0 = dt.datetime(2024, 1, 1, 0, 0, 59, 999000)


def twin(rows, interval):
    out, last, total = [], {}, {}
    for d, _, n, _ in rows:
        total[d] = total.get(d, 0) + n
    done, so_far = {}, {}
    for d, ts, n, seq in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        ms = int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1) // 1)
        so_far[d] = so_far.get(d, 0) + n
        last.setdefault(d, ms)
        if ms - last[d] >= interval:
            out.append((d, so_far[d]))
            last[d] = ms
        done[d] = so_far[d]
    return sorted(out + list(done.items()))


def test_throttled_side_by_side(spark, monkeypatch):
    r = random.Random(0)
    rows = []
    for d, gap in ((1, 3), (2, 400), (3, 90_000), (4, 1), (5, 251)):
        us = 0
        for seq in range(400):
            us += r.choice((0, 1, gap * 1000, r.randint(0, 2000 * gap), 250_000))
            rows.append((d, T0 + dt.timedelta(microseconds=us), r.randint(1, 1000), seq))
    rows.append((6, T0, 7, 0))
    rows.append((7, dt.datetime(1969, 12, 31, 23, 59, 59, 500), 7, 0))
    df = spark.createDataFrame(rows, "download_id long, ts timestamp, bytes long, seq long").repartition(5)
    for bucket, interval in ((1 << 16, 250), (1000, 250), (64, 250), (1 << 16, 100_000), (1 << 16, 1)):
        monkeypatch.setattr(P, "BUCKET_MS", bucket)
        got = P.throttled(P.progress(df), interval).select("download_id", "downloaded").collect()
        assert sorted(map(tuple, got)) == twin(rows, interval), (bucket, interval)
    assert P.throttled(P.progress(df.limit(0))).collect() == []


def test_one_download_of_many_chunks(spark):
    n = 10_000_000
    ids = spark.range(0, n, 1, 8)
    ms = F.col("id") * 37 % 1_000_003 + F.col("id") % 5  # out of order, some at one moment
    records = ids.select(F.lit(1).cast("long").alias("download_id"), F.timestamp_millis(ms).alias("ts"), F.col("id").alias("seq"), F.col("id").alias("downloaded"), F.lit(n).cast("long").alias("total"))
    got = [r.ms for r in P.passed(records).orderBy("ms").collect()]
    i = np.arange(n, dtype=np.int64)
    moments = np.unique(i * 37 % 1_000_003 + i % 5)
    expected = [int(moments[k]) for k in P._chain(moments, int(np.searchsorted(moments, moments[0] + 250)), 250)]
    last, out = moments[0], []
    for m in moments.tolist():
        if m - last >= 250:
            out.append(m)
            last = m
    assert got == expected == out and len(got) > 3000


def test_rates_by_whole_microseconds(spark):
    """Rates and times left at limits that sums of doubles miss."""
    rows = []
    for d in range(400):
        base = T0 + dt.timedelta(microseconds=123_457 * d)
        rows += [(d, base, 0, 0), (d, base + dt.timedelta(microseconds=3 * (d + 1)), 3 * (d + 1), 1), (d, base + dt.timedelta(seconds=9), 10**9 + d, 2)]
    rows += [(1000, T0, 0, 0), (1000, T0 + dt.timedelta(seconds=1), round(1.005 * 1048576), 1)]
    df = spark.createDataFrame(rows, "download_id long, ts timestamp, bytes long, seq long")
    got = {(r.download_id, r.seq): r for r in P.progress(df).collect()}
    for d in range(400):  # a million bytes a second exactly
        assert got[d, 1].eta_secs == (10**9 + d) // 10**6, d
    assert got[1000, 1].mib_per_s == round(round(1.005 * 1048576) / 1048576 * 100) / 100
