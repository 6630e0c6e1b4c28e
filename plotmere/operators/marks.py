"""Clicks of yes and no on saved rows: which are saved, which would replace a colleague's answer unseen, which are taken back.

Actions have id, uid, at, kind (click or undo), value (yes or no; of an undo the id of its click), by (who) and was (the
answer that the page showed, null where it doesn't say). An action depends on those before it on its row, so a row's
actions are read in order of time, a batch at a time; a task keeps of one row what may still be taken back, and who gave
each answer last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Seconds in which a click can be taken back.
UNDO_SECONDS = 300
VALUES = ("yes", "no")


class _Row:
    """The marks of one saved row as they are."""

    def __init__(self) -> None:
        self.value, self.unconfirmed = "", False
        self.standing: list[tuple[int, str, str, str, str]] = []  # (at, id, value, previous, by), oldest first

    def trim(self, at: int) -> None:
        """Keep what can be taken back, and before it the last click of each answer."""
        late = [c for c in self.standing if c[0] > at - UNDO_SECONDS * 1_000_000]
        early = self.standing[: len(self.standing) - len(late)]
        last = {c[2]: c for c in early}
        self.standing = sorted(last.values()) + late

    def click(self, at: int, id: str, value: str, by: str, was: str | None) -> tuple[str, str]:
        if value not in VALUES:
            return "bad value", self.value
        if self.value == value and not self.unconfirmed:
            return "same", self.value
        if was is not None and self.value and self.value not in (was, value):
            given = next((c[4] for c in reversed(self.standing) if c[2] == self.value), "")
            if given and given.casefold() != by.casefold():
                return "changed", self.value
        previous = self.value
        self.standing.append((at, id, value, previous, by))
        self.value, self.unconfirmed = value, False
        self.trim(at)
        return "saved", previous

    def undo(self, at: int, id: str) -> tuple[str, str]:
        before = self.value
        last = self.standing[-1] if self.standing else None
        if last is None or last[1] != id or last[0] <= at - UNDO_SECONDS * 1_000_000 or self.value != last[2]:
            return "too late", before
        self.standing.pop()
        self.value = last[3]
        return "undone", before


def decided(actions: DataFrame, rows: DataFrame, disagreed: DataFrame | None = None) -> DataFrame:
    """actions with outcome and previous (the answer before it).

    outcome: saved; same (the row has that answer already); changed (a colleague has given another one than the page showed: ask
    first); unknown (no saved row of rows (uid)); bad value; undone; too late (an undo after UNDO_SECONDS, of a click that isn't
    the last one that stands, or of an unknown one). disagreed (uid, at): when the row was joined from rows marked yes and no; until the next
    click, clicking the answer that it has confirms it. Actions without a row or a time are unknown.
    """
    names = actions.columns
    known = rows.select("uid").distinct().withColumn("__known", F.lit(True))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = actions.select(*names, F.unix_micros(F.col("at").cast("timestamp")).alias("__us"), F.lit(1).alias("__what"), text("id").alias("__id"), text("kind").alias("__kind"), text("value").alias("__value"), text("by").alias("__by"), F.col("was").cast("string").alias("__was"))
    if disagreed is not None:
        blank = [F.lit(None).cast(actions.schema[c].dataType).alias(c) if c != "uid" else F.col("uid") for c in names]
        own = own.union(disagreed.select(*blank, F.unix_micros(F.col("at").cast("timestamp")), F.lit(0), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(None).cast("string")))
    own = own.join(known, "uid", "left").select(*names, "__us", "__what", "__id", "__kind", "__value", "__by", "__was", F.coalesce("__known", F.lit(False)).alias("__known"))
    place = names.index("uid")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, row = None, _Row()
        for batch in batches:
            keep, outcomes, before = [], [], []
            for who, us, what, id, kind, value, by, was, there in zip(*(batch.column(i).to_pylist() for i in (place, *range(len(names), len(names) + 8))), strict=True):
                if who != uid:
                    uid, row = who, _Row()
                keep.append(what == 1)
                if what == 0:
                    row.unconfirmed = True
                    continue
                if not there or who is None or us is None:
                    found = "unknown", ""
                else:
                    found = row.undo(us, value) if kind == "undo" else row.click(us, id, value, by, was)
                outcomes.append(found[0])
                before.append(found[1])
            own_rows = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*own_rows.columns[: len(names)], pa.array(outcomes, pa.string()), pa.array(before, pa.string())], [*names, "outcome", "previous"])

    schema = StructType([*actions.schema.fields, StructField("outcome", StringType()), StructField("previous", StringType())])
    return own.repartition("uid").sortWithinPartitions("uid", "__us", "__what", "__id").mapInArrow(told, schema)


def current(decided_actions: DataFrame) -> DataFrame:
    """(uid, value, at, by) of the rows that have an answer after these actions: what their last action left."""
    done = decided_actions.filter("outcome in ('saved', 'undone')")
    undone = done.filter("outcome = 'undone'").select(F.col("value").alias("id"))
    clicks = done.filter("outcome = 'saved'").join(undone, "id", "left_anti")
    last = clicks.groupBy("uid").agg(F.max_by(F.struct("value", "at", "by"), F.struct("at", "id")).alias("c"))
    return last.select("uid", "c.*")


def attributed(log: DataFrame, makers: DataFrame, id: str = "id") -> DataFrame:
    """log with by: who made each change (makers: id, name), "" where it isn't recorded."""
    return log.join(makers.select(F.col("id").alias(id), F.col("name").alias("by")).dropDuplicates([id]), id, "left").fillna({"by": ""})


def given_by(clicks: DataFrame, makers: DataFrame) -> DataFrame:
    """(uid, value, by, at): who gave each answer of a row last, of clicks (id, uid, value, at, undone_at) that weren't undone."""
    own = attributed(clicks.filter("undone_at is null"), makers)
    last = own.groupBy("uid", "value").agg(F.max_by(F.struct("by", "at"), F.struct("at", "id")).alias("c"))
    return last.select("uid", "value", "c.*")
