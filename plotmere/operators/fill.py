"""Boxes of a search that are asked in rounds: a failed one is cut in four once, what still fails is asked again later.

Parts are (area, s, w, n, e, depth): a box of an area, or a quarter of one (each depth is a quarter of the one before). A
round asks all parts that are left, each in its own task; what answers is kept, an element that several parts have once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmere.operators.shared import shared_folder, written

#: How often a failed box is cut.
SPLITS = 1
PART = ["area", "s", "w", "n", "e", "depth"]
#: An answer: the part, whether it came, its elements (JSON), the reason where it did not.
Ask = Callable[[DataFrame], DataFrame]


class Filled(NamedTuple):
    """state is complete, gave_up or stopped; found the answers (PART, answer, pass); missing the parts left; rounds; errors (PART, error)."""

    state: str
    found: DataFrame
    missing: DataFrame
    rounds: int
    errors: DataFrame


def quarters(parts: DataFrame) -> DataFrame:
    """The four quarters of each part."""
    mid_lat, mid_lon = (F.col("s") + F.col("n")) / 2, (F.col("w") + F.col("e")) / 2
    one = lambda s, w, n, e: F.struct(F.col(s).alias("s") if isinstance(s, str) else s.alias("s"), F.col(w).alias("w") if isinstance(w, str) else w.alias("w"), F.col(n).alias("n") if isinstance(n, str) else n.alias("n"), F.col(e).alias("e") if isinstance(e, str) else e.alias("e"))
    four = F.array(one("s", "w", mid_lat, mid_lon), one("s", mid_lon, mid_lat, "e"), one(mid_lat, "w", "n", mid_lon), one(mid_lat, mid_lon, "n", "e"))
    return parts.select("area", F.explode(four).alias("q"), (F.col("depth") + 1).alias("depth")).select("area", "q.*", "depth").select(*PART)


def ask_round(parts: DataFrame, ask: Ask, splits: int = SPLITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, missing parts, errors) of one round: parts that fail at a depth below splits are asked again in quarters."""
    folder = shared_folder(parts.sparkSession, "round")
    todo, answers, missing, errors = parts.select(*PART), None, None, None
    add = lambda a, b: b if a is None else a.union(b)
    for number in range(splits + 1):
        told = written(ask(todo).select(*PART, "ok", "answer", "error"), f"{folder}/{number}")
        answers = add(answers, told.filter("ok").select(*PART, "answer", F.lit(number).alias("pass")))
        failed = told.filter("not ok")
        errors = add(errors, failed.select(*PART, "error"))
        missing = add(missing, failed.filter(F.col("depth") >= splits).select(*PART))
        todo = quarters(failed.filter(F.col("depth") < splits))
        if todo.isEmpty():
            break
    return answers, missing, errors


def fill_in(parts: DataFrame, ask: Ask, rounds: int, splits: int = SPLITS, stop: Callable[[], bool] = lambda: False) -> Filled:
    """Ask the parts that are missing again and again, up to so many rounds or until stop says so."""
    spark, folder = parts.sparkSession, shared_folder(parts.sparkSession, "fill")
    found, errors, state, number = None, None, "gave_up", 0
    left = written(parts.select(*PART), f"{folder}/left0")
    while number < rounds and not left.isEmpty():
        if stop():
            state = "stopped"
            break
        number += 1
        answers, missing, failed = ask_round(left, ask, splits)
        answers = answers.withColumn("round", F.lit(number))
        found = answers if found is None else found.union(answers)
        errors = failed if errors is None else errors.union(failed)
        left = written(missing, f"{folder}/left{number}")
    if left.isEmpty():
        state = "complete"
    none = spark.createDataFrame([], parts.select(*PART).schema)
    found = none.withColumns({"answer": F.lit(""), "pass": F.lit(0), "round": F.lit(0)}) if found is None else found
    return Filled(state, found, left, number, none.withColumn("error", F.lit("")) if errors is None else errors)


def missing_share(missing: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, share) of every area: how much of it is missing, exactly (a sum of powers of a quarter)."""
    share = missing.groupBy("area").agg(F.sum(F.pow(F.lit(4.0), -F.col("depth"))).alias("share"))
    return areas.select("area").distinct().join(share, "area", "left").fillna({"share": 0.0})


def areas_left(share: Column) -> Column:
    """How many areas the missing parts make up (share: their sum over areas): at least 1 while anything is missing, halves to even."""
    return F.when(share > 0.001, F.greatest(F.lit(1), F.bround(share))).otherwise(0).cast("int")


def first_seen(found: DataFrame, id: Column, *values: Column) -> DataFrame:
    """One row for each element's id (a column of found, exploded): as the earliest round, pass and part has it."""
    order = F.struct("round", "pass", "area", "depth", "s", "w")
    rows = found.select(id.alias("id"), F.struct(*values).alias("v"), order.alias("_o"))
    return rows.groupBy("id").agg(F.min_by("v", "_o").alias("v")).select("id", "v.*")


def box_key(*columns: str) -> Column:
    """What an answer of a box lands under: a digest of its request."""
    return F.sha2(F.concat_ws(",", *(F.format_string("%.6f", F.col(c)) for c in columns or ("s", "w", "n", "e"))), 256)


def landed(folder: str) -> Ask:
    """Answers that lie in a folder, key.json for each box; one that is absent or empty is a failure. A reader of a live service takes its place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        for batch in batches:
            ok, answers, errors = [], [], []
            for key in batch.column("key").to_pylist():
                try:
                    text = store.open_input_stream(f"{root}/{key}.json").read().decode()
                except FileNotFoundError:
                    text = ""
                ok.append(bool(text))
                answers.append(text)
                errors.append("" if text else "no answer")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ok), pa.array(answers), pa.array(errors)], [*PART, "ok", "answer", "error"])

    def ask(parts: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in PART)
        return parts.select(*PART, box_key().alias("key")).mapInArrow(read, f"{kinds}, ok boolean, answer string, error string")

    return ask
