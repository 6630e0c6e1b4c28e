"""Streaming forms: each takes a streaming DataFrame of events and returns one, with a watermark that bounds its state."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.operators.resolve import upsert
from plotmere.operators.shared import names_in, shared_folder


def heartbeats(beats: DataFrame, key: str = "run", at: str = "at", gap: str = "45 seconds", late: str = "2 minutes") -> DataFrame:
    """(run, started, ended, beats): runs that fell silent for the gap; emitted once the watermark has passed."""
    return beats.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("beats")).drop("session_window")


def once_by_id(events: DataFrame, key: str = "id", at: str = "at", late: str = "1 day") -> DataFrame:
    """Each id once, however often it is delivered within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def rolling_budget(calls: DataFrame, key: str = "name", at: str = "at", seconds: int = 86_490, late: str = "10 minutes") -> DataFrame:
    """(name, at, used): for each call, the name's calls in the seconds up to it, less than that ago.

    Counts by second are kept for each name, and dropped when the watermark leaves them behind. A call that arrives
    late counts for itself and for what arrives after it; rows without a name or time are no calls.
    """

    def counted(name, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        have = dict(zip(*state.get, strict=True)) if state.exists else {}
        new = pd.concat(list(frames))
        for s, n in new["_s"].value_counts().items():
            have[int(s)] = have.get(int(s), 0) + int(n)
        times = np.array(sorted(have), np.int64)
        total = np.r_[0, np.cumsum([have[s] for s in times.tolist()])]
        own = new["_s"].to_numpy(np.int64)
        new["used"] = total[np.searchsorted(times, own, "right")] - total[np.searchsorted(times, own - seconds, "right")]
        passed = state.getCurrentWatermarkMs() // 1000
        times = times[times > min(passed, int(times[-1])) - seconds]
        state.update((times.tolist(), [have[s] for s in times.tolist()]))
        state.setTimeoutTimestamp(max(int(times[-1]) + seconds, passed + 1) * 1000)
        yield new[[key, at, "used"]]

    calls = calls.select(key, at).filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late).withColumn("_s", F.unix_seconds(F.col(at).cast("timestamp")))
    kinds = ", ".join(f"`{c}` {calls.schema[c].dataType.simpleString()}" for c in (key, at))
    return calls.groupBy(key).applyInPandasWithState(counted, f"{kinds}, used long", "seconds array<long>, calls array<long>", "append", "EventTimeTimeout")


def changed_uids(log: DataFrame, uid: str = "uid", at: str = "at", late: str = "120 seconds") -> DataFrame:
    """Each changed uid once in a minute; events later than the look-back are dropped, as the batch form misses them."""
    return log.withWatermark(at, late).groupBy(F.window(at, "1 minute").alias("minute"), uid).agg(F.count(F.lit(1)).alias("n"))


def maintain_list(spark, folder: str, key: str = "uid") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: upserts a micro-batch (its latest row of each key) into the Parquet list below a folder.

    Versions are written side by side, and a version's number is the batch's, so a batch that is run again writes the
    same version anew, from the last one before it, whichever that is. The whole list is written every time: for one of any
    size KeptList writes what a batch touches.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "last_seen").alias("_r")).select("_r.*")
        before = [int(n[1:]) for n in names_in(spark, folder) if n[1:].isdigit() and int(n[1:]) < number]
        have = spark.read.parquet(f"{folder}/v{max(before)}") if before else fresh.limit(0)
        upsert(have, fresh, key).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append") -> str:
    """Process what is there and stop; returns the folder of a Parquet sink where no function is given."""
    spark = stream.sparkSession
    path = path or shared_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    return path
