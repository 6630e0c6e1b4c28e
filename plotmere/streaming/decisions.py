"""Streams of events that are let through or held as they come, by what was let through before.

A decision depends on those before it, so each batch is decided together with what the batches before left (a state in
the shared folder, of what still counts), in order of time. A batch's decisions and the state after it are one version,
made once: a batch that is run again changes nothing, and a stream that is cut anywhere gives the decisions of one pass.
An event that comes with a later batch than its time stands among those decided before it.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmere.operators.activity import throttled
from plotmere.operators.searches import rate_limited
from plotmere.operators.shared import names_in, publish, read_file, removed

#: Seconds between equal alerts; messages in an hour.
THROTTLE, MESSAGES, HOUR = 900, 10, 3600
#: Seconds in which a call counts.
WINDOW = 86_490


class Decisions:
    """Decides batches of events (with id and at) in a folder that driver and executors share.

    decide gets a batch's events and the state's and returns them with allowed (and more); keep gets that, and returns the
    events that still count for those to come.
    """

    def __init__(self, spark: SparkSession, folder: str, decide: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.decide, self.keep = spark, folder.rstrip("/"), decide, keep

    def _last(self) -> dict | None:
        names = [n for n in names_in(self.spark, f"{self.folder}/versions") if n.endswith(".json") and n.count(".") == 1]
        return json.loads(read_file(self.spark, f"{self.folder}/versions/{names[-1]}")) if names else None

    def apply(self, batch: DataFrame, number: int) -> None:
        last = self._last()
        if last is not None and number <= last["batch"]:
            return
        events = batch.withColumn("_was", F.lit(False))
        if last is not None:
            events = events.union(self.spark.read.schema(events.schema).parquet(last["state"]))
        place = f"{self.folder}/{{}}/{number:012d}"
        self.decide(events).write.mode("overwrite").parquet(place.format("all"))
        told = self.spark.read.parquet(place.format("all"))
        told.filter("not _was").drop("_was").write.mode("overwrite").parquet(place.format("decided"))
        self.keep(told).select(*batch.columns, F.lit(True).alias("_was")).write.mode("overwrite").parquet(place.format("state"))
        removed(self.spark, place.format("all"))
        publish(self.spark, f"{self.folder}/versions/{number:012d}.json", json.dumps({"batch": number, "state": place.format("state")}))
        if last is not None:
            removed(self.spark, last["state"])

    def sink(self) -> Callable[[DataFrame, int], None]:
        return self.apply

    def decided(self) -> DataFrame:
        """All decisions so far: the events with allowed."""
        done = [n.removesuffix(".json") for n in names_in(self.spark, f"{self.folder}/versions") if n.endswith(".json") and n.count(".") == 1]
        return self.spark.read.parquet(*(f"{self.folder}/decided/{n}" for n in done))


def budget(spark: SparkSession, folder: str, limit: int, key: str = "name", at: str = "at", id: str = "id", seconds: int = WINDOW) -> Decisions:
    """Calls of each name: fewer than limit of those that were let through in the seconds up to each. Refused ones don't count."""

    def keep(told: DataFrame) -> DataFrame:
        newest = told.groupBy(key).agg(F.max(at).alias("_newest"))
        return told.filter("allowed").join(newest, key).filter(_micros("_newest") - _micros(at) < seconds * 1_000_000)

    return Decisions(spark, folder, lambda rows: rate_limited(rows.filter(F.col(key).isNotNull()), [key], at, limit, seconds, id), keep)


def alerts(spark: SparkSession, folder: str, at: str = "at", id: str = "id", throttle: int = THROTTLE, messages: int = MESSAGES) -> Decisions:
    """Problems (kind, text): recorded once in so many seconds for each kind and text (recorded), and of those so many sent in an hour (allowed).

    What is recorded is few, and is read in order by one task that keeps the last messages.
    """

    def decide(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col(at).isNotNull())
        keyed = rows.withColumn("_key", F.concat_ws(":", F.coalesce("kind", F.lit("")), F.coalesce("text", F.lit(""))))
        passed = throttled(keyed, "_key", at, throttle, tie=id).select(F.col(id)).withColumn("recorded", F.lit(True))
        told = rows.join(passed, id, "left").fillna({"recorded": False})
        sent = told.filter("recorded").select(id, _micros(at).alias("us")).coalesce(1).sortWithinPartitions("us", id).mapInArrow(_hourly(messages), f"{id} {rows.schema[id].dataType.simpleString()}, allowed boolean")
        return told.join(sent, id, "left").fillna({"allowed": False}).select(*rows.columns, "recorded", "allowed")

    def keep(told: DataFrame) -> DataFrame:
        newest = told.agg(F.max(at).alias("_newest"))
        return told.filter("recorded").crossJoin(F.broadcast(newest)).filter(_micros("_newest") - _micros(at) < max(throttle, HOUR) * 1_000_000)  # one row

    return Decisions(spark, folder, decide, keep)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _hourly(messages: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sending(batches):
        sent = deque(maxlen=messages)
        for batch in batches:
            allowed = []
            for us in batch.column(1).to_pylist():
                allowed.append(len(sent) < messages or us - sent[0] >= HOUR * 1_000_000)
                if allowed[-1]:
                    sent.append(us)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(allowed, pa.bool_())], [batch.schema.names[0], "allowed"])

    return sending
