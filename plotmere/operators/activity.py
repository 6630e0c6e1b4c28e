"""Activity logs: latest events, undo windows, rolling counts, change feeds. Rows with a null key belong to no listing.

Logs may have one key with a third of all rows: latest values and counts are aggregated (combined before the shuffle);
only operators whose result is a row for each event sort a key's events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(log: DataFrame, key: str, at: str, *columns: str, tie: str | None = None, place: str | None = None) -> DataFrame:
    """(key, columns of the latest row, n rows). Equal times are decided by the larger tie, rows that are equal in that too by the least place."""
    log, order = log.filter(F.col(key).isNotNull()), F.struct(at, tie) if tie else F.col(at)
    rows, n = F.struct(*columns), F.count(F.lit(1))
    if place:
        log = log.groupBy(key, order.alias("_order")).agg(F.min_by(rows, place).alias("_row"), n.alias("_n"))
        rows, order, n = F.col("_row"), F.col("_order"), F.sum("_n")
    found = log.groupBy(key).agg(F.max_by(rows, order).alias("_last"), n.alias("n"))
    return found.select(key, *(F.col(f"_last.{c}") for c in columns), "n")


def latest_filled(log: DataFrame, key: str, at: str, column: str, tie: str) -> DataFrame:
    """(key, column): the latest value that is not blank."""
    filled = F.when(F.coalesce(F.col(column), F.lit("")) != "", F.struct(at, tie))
    return log.groupBy(key).agg(F.max_by(column, filled).alias(column))


def with_latest(listings: DataFrame, log: DataFrame, key: str, at: str, *columns: str, tie: str | None = None, prefix: str = "last_") -> DataFrame:
    found = latest(log, key, at, *columns, tie=tie)
    return listings.join(found.select(key, *(F.col(c).alias(prefix + c) for c in columns), F.col("n").alias(prefix + "n")), key, "left").fillna({prefix + "n": 0})


def previous_value(log: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """log with previous: the value before each change ("" at first)."""
    return log.withColumn("previous", F.lag(value, 1, "").over(W.partitionBy(key).orderBy(at, tie)))


def undoable(log: DataFrame, key: str, at: str, tie: str, now: Column, seconds: int = 300) -> DataFrame:
    """Each key's latest row, where it is at most so many seconds old at the time now."""
    recent = log.filter((F.col(at) <= now) & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) <= seconds * 1_000_000))
    last = recent.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(at, tie)).alias("_last"))
    return last.select("_last.*")


def rolling_count(log: DataFrame, key: str, at: str, seconds: int = 86_490) -> DataFrame:
    """log with in_window: the key's events in the seconds up to each event, less than that ago.

    Counted by whole seconds: events of one second are summed first, and an hour's totals before the window, so that a
    busy key sorts its seconds, not its events.
    """
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    per = log.groupBy(key, second.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("in_window", F.sum("_n").over(W.partitionBy(key).orderBy("_s").rangeBetween(-(seconds - 1), 0)))
    return log.withColumn("_s", second).join(per.drop("_n"), [key, "_s"]).drop("_s")


def sessions(log: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, started, ended, n): runs of events without a gap that long."""
    return log.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, F.session_window(at, f"{gap_seconds} seconds").alias("_w")).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n")).drop("_w")


def change_feed(logs: list[tuple[DataFrame, str, str]], since: Column, overlap_seconds: int = 120) -> DataFrame:
    """Distinct uids of (log, uid column, time column) changed since a time, with a look-back for late commits."""
    start = since - F.expr(f"interval {overlap_seconds} seconds")
    feeds = [log.filter(F.col(at) > start).select(F.col(uid).alias("uid")) for log, uid, at in logs]
    out = feeds[0]
    for f in feeds[1:]:
        out = out.union(f)
    return out.distinct()


def throttled(log: DataFrame, key: str, at: str, seconds: float, changed: str | None = None, tie: str | None = None) -> DataFrame:
    """Rows that pass a throttle: a key's first, those so many seconds or more after the last that passed, and those
    where changed differs from it.

    Whether a row passes depends on the last that did, so a key's rows are read in order, a batch at a time: a task keeps
    the last passed row of one key, however many rows the key has. Rows without a key or a time do not pass.
    """
    names = log.columns
    order = [c for c in (at, tie) if c]
    rows = log.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.withColumns({"__micros": F.unix_micros(F.col(at).cast("timestamp")), "__key": F.col(key).cast("string"), "__state": F.col(changed).cast("string") if changed else F.lit("")})
    span = int(seconds * 1_000_000)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)
        for batch in batches:
            keep = []
            for who, micros, state in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("__key", "__micros", "__state")), strict=True):
                passes = who != last[0] or state != last[2] or micros - last[1] >= span
                keep.append(passes)
                if passes:
                    last = who, micros, state
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return rows.repartition("__key").sortWithinPartitions("__key", *order).mapInArrow(passing, log.schema)


def first_of_day(log: DataFrame, day: Column, at: str, tie: str) -> DataFrame:
    """The first row of each day: one claim a day."""
    return log.groupBy(day.alias("day")).agg(F.min_by(F.struct(*log.columns), F.struct(at, tie)).alias("_f")).select("day", "_f.*")


def joined_text(log: DataFrame, key: str, at: str, tie: str, column: str) -> DataFrame:
    """(key, text): a key's values in order of time, in lower case, joined by spaces. A key's text is one value."""
    found = F.array_sort(F.collect_list(F.struct(at, tie, column)))
    return log.filter(F.col(column).isNotNull()).groupBy(key).agg(F.lower(F.concat_ws(" ", F.transform(found, lambda r: r[column]))).alias("text"))


def without_tombstones(events: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """Events once each by id, without those taken back, whichever came first."""
    return events.dropDuplicates([key]).join(tombstones.select(key).distinct(), key, "left_anti")
