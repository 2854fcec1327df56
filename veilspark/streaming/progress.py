"""Progress of downloads: running totals, rate and time left, at most one record in each interval."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

INTERVAL_MS = 250


BUCKET_MS = 1 << 16  #: a stretch of time that one array of moments covers at most


def _ms(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def rounded(x: Column, places: int) -> Column:
    """Half away from zero of x times a power of ten, as doubles, the way SQL engines round them; F.round goes by the shortest decimal of x."""
    return F.round(x * float(10**places)) / float(10**places)


def progress(chunks: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(download_id, ts, downloaded, total, percent, mib_per_s, eta_secs) after each chunk (download_id, ts, bytes, seq); totals: (download_id, total), by default the sums.

    A running sum is that of the stretches of time before, summed up in a window over
    stretches, and that within a stretch: however many chunks one download has, no task sorts
    more of them than arrive in a stretch.
    """
    cut = chunks.withColumn("bucket", F.floor(_ms() / BUCKET_MS))
    sums = cut.groupBy("download_id", "bucket").agg(F.sum("bytes").alias("sum"), F.min("ts").alias("first"))
    w = Window.partitionBy("download_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("download_id")
    before = sums.select("download_id", "bucket", F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("before"), F.min("first").over(own).alias("began"), F.sum("sum").over(own).alias("all"))
    within = Window.partitionBy("download_id", "bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumn("sum", F.sum("bytes").over(within)).join(before, ["download_id", "bucket"])
    run = run.withColumn("downloaded", (F.col("before") + F.col("sum")).cast("long"))
    run = run.withColumn("total", F.col("all")) if totals is None else run.join(totals, "download_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    secs = (us("ts") - us("began")) / 1e6  # whole microseconds: two doubles of today's seconds are 0.24 of one apart
    rate = F.when(secs > 0, F.col("downloaded") / secs).otherwise(0.0)
    left = F.col("total") - F.col("downloaded")
    return run.select(
        "download_id", "seq", "ts", "downloaded", "total",
        F.when(F.col("total") > 0, F.least(F.col("downloaded") / F.col("total") * 100, F.lit(100.0))).otherwise(0.0).alias("percent"),
        rounded(rate / 1048576, 2).alias("mib_per_s"),
        F.when((rate > 0) & (left > 0), F.floor(left / F.when(rate > 0, rate))).otherwise(0).cast("long").alias("eta_secs"),
    )


RECORD = "download_id long, downloaded long, total long, percent double, mib_per_s double, eta_secs long"


def _chain(moments: np.ndarray, start: int, interval: int) -> list[int]:
    """Indices of the moments let through, from the one at `start` on: each the first at least `interval` after the one before."""
    out, i = [], start
    while i < len(moments):
        out.append(i)
        i = int(np.searchsorted(moments, moments[i] + interval))
    return out


def _exits(moments: np.ndarray, interval: int) -> np.ndarray:
    """For each moment the last one let through if it is let through itself: its successor's, from the end on."""
    after = np.searchsorted(moments, moments + interval)
    out = moments.copy()
    for i in range(len(moments) - 1, -1, -1):
        if after[i] < len(moments):
            out[i] = out[after[i]]
    return out


def _functions(batches: Iterator[pa.RecordBatch], interval: int) -> Iterator[pa.RecordBatch]:
    """What a stretch does with the moment of the last record before it: only moments within `interval` of the stretch's first can be the first let through, so the table is as long as the interval at most."""
    for batch in batches:
        entries, exits = [], []
        for row in batch.column("moments"):
            m = np.asarray(row.values)
            n = int(np.searchsorted(m, m[0] + interval)) + 1
            entries.append(m[:n])
            exits.append(_exits(m, interval)[:n])
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("download_id"), batch.column("bucket"), pa.array(entries, lists), pa.array(exits, lists)], ["download_id", "bucket", "entries", "exits"])


def _states(batches: Iterator[pa.RecordBatch], interval: int) -> Iterator[pa.RecordBatch]:
    """Stretches come sorted by (download_id, bucket); to each the moment of the last record before it, for the first the download's own first moment."""
    now, last = None, 0
    for batch in batches:
        out = []
        for d, entries, exits in zip(batch.column("download_id").to_pylist(), batch.column("entries"), batch.column("exits"), strict=True):
            m = np.asarray(entries.values)
            if d != now:
                now, last = d, int(m[0])
            out.append(last)
            i = int(np.searchsorted(m, last + interval))
            if i < len(m):
                last = int(np.asarray(exits.values)[i])
        yield pa.RecordBatch.from_arrays([batch.column("download_id"), batch.column("bucket"), pa.array(out, pa.int64())], ["download_id", "bucket", "last"])


def _passed(batches: Iterator[pa.RecordBatch], interval: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, out = [], []
        for k, (row, last) in enumerate(zip(batch.column("moments"), batch.column("last").to_pylist(), strict=True)):
            m = np.asarray(row.values)
            got = m[_chain(m, int(np.searchsorted(m, last + interval)), interval)]
            out.append(got)
            at += [k] * len(got)
        yield pa.RecordBatch.from_arrays([batch.column("download_id").take(pa.array(at, pa.int64())), pa.array(np.concatenate(out) if out else [], pa.int64())], ["download_id", "ms"])


def passed(records: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """(download_id, ms) of the moments at which a record is let through.

    Which moments pass depends on the one before, all the way back to the first. But what a
    stretch of time does is a function of the last moment let through before it, and a small
    one: it depends on which moment of the stretch's first interval_ms comes first. Stretches
    give their functions side by side, one pass over these (a row for each stretch) gives every
    stretch its state, and the stretches then mark their moments side by side again.
    """
    ids = records.schema["download_id"].dataType.simpleString()
    moments = records.select("download_id", _ms().alias("ms")).distinct().groupBy("download_id", F.floor(F.col("ms") / max(BUCKET_MS, interval_ms)).alias("bucket")).agg(F.array_sort(F.collect_list("ms")).alias("moments"))
    tables = moments.mapInArrow(lambda it: _functions(it, interval_ms), f"download_id {ids}, bucket long, entries array<long>, exits array<long>")
    states = tables.repartition("download_id").sortWithinPartitions("download_id", "bucket").mapInArrow(lambda it: _states(it, interval_ms), f"download_id {ids}, bucket long, last long")
    return moments.join(states, ["download_id", "bucket"]).select("download_id", "moments", "last").mapInArrow(lambda it: _passed(it, interval_ms), f"download_id {ids}, ms long")


def throttled(records: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """Records of progress() at least interval_ms after the last one let through, the first chunk beginning the count, and behind them a last one for each download that is complete: 100 per cent, no rate, nothing left."""
    cols = ["downloaded", "percent", "mib_per_s", "eta_secs"]
    first = records.groupBy("download_id", _ms().alias("ms")).agg(F.min(F.struct("ts", "seq", *cols)).alias("x"), F.max("total").alias("total"))
    out = first.join(passed(records, interval_ms), ["download_id", "ms"]).select("download_id", "x.downloaded", "total", "x.percent", "x.mib_per_s", "x.eta_secs")
    each = records.groupBy("download_id").agg(F.max("total").alias("total"), F.max("downloaded").alias("most"))
    done = each.where(F.col("most") >= F.col("total")).select("download_id", F.col("total").alias("downloaded"), "total", F.lit(100.0).alias("percent"), F.lit(0.0).alias("mib_per_s"), F.lit(0).cast("long").alias("eta_secs"))
    return out.union(done)


def progress_stream(chunks: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """throttled(progress(...)) over a stream of chunks (download_id, ts, seq, bytes, total) that come in the order of ts: state is the sum so far, the first chunk's time and that of the last record let through. A complete download's last record comes once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        downloaded, began, last = state.get if state.exists else (0, None, None)
        out = []
        for ts, n, total in pd.concat(list(batches)).sort_values(["ts", "seq"])[["ts", "bytes", "total"]].itertuples(index=False):
            us, ms = ts.value // 1000, ts.value // 1_000_000
            began, last = (us if began is None else began), (ms if last is None else last)
            before, downloaded = downloaded, downloaded + int(n)
            if ms - last >= interval_ms:
                rate = downloaded / ((us - began) / 1e6) if us > began else 0.0
                left = total - downloaded
                out.append((key[0], downloaded, total, min(downloaded / total * 100, 100.0) if total > 0 else 0.0, float(Decimal(rate / 1048576 * 100).quantize(Decimal(1), ROUND_HALF_UP)) / 100, int(left / rate) if rate > 0 and left > 0 else 0))
                last = ms
            if before < total <= downloaded:
                out.append((key[0], total, total, 100.0, 0.0, 0))
        state.update((downloaded, began, last))
        if out:
            yield pd.DataFrame(out, columns=["download_id", "downloaded", "total", "percent", "mib_per_s", "eta_secs"])

    return chunks.groupBy("download_id").applyInPandasWithState(step, RECORD, "downloaded long, began long, last long", "append", "NoTimeout")
