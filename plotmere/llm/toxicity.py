"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, pairs of neighbours and pairs with one word between, in lower case, hashed into
2**bits cells; each present cell counts once. Per-coordinate rates adapt to how often a cell was updated, and the L1
term keeps weights of cells without evidence at zero, so the model is a short list that every worker gets by broadcast.

Training uses a bounded sample of labelled rows (``sample`` rows or so, chosen by a hash of the id), dealt over
``shards`` groups. In each round every group runs FTRL over its rows from the last round's state, and a cell changes by
the mean of the changes of the groups that met it, worked out by range of cells from packed arrays. The driver gets one state of at most 2**bits
cells a round, and at the end only the cells whose weight is not zero. Every text is scored whole.

Edge cases: null and empty texts have no feature and get the bias alone. Labels that are null are not learnt; of several
labels for an id the largest holds. Without labelled rows every score is 0.5 and predicted 1 by the fixed rule
score >= 0.5; with labels of one kind scores follow the bias. Repeated rows each get a row. Columns that are added
replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm.shared import alphabet, held_out, mix, pack, saved, slices, unpack, unzipped, words, workspace, zipped

#: Cells (as a power of two), labelled rows to learn from, groups that learn side by side, rounds.
BITS, SAMPLE, SHARDS, ROUNDS = 20, 24_000, 4, 3
#: Rate, its smoothing, and the weights of the L1 and L2 terms.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1

LETTERS = alphabet(lower=True, letters=True)
#: Odd factors that tell the kinds of feature apart.
_KINDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPAN = 1 << 40
#: Ranges of cells whose changes are added up side by side.
RANGES, _STATE = 16, "part int, cell binary, z binary, n binary"


def features(piece, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of each feature of a slice's rows; cell 0 is left to the bias."""
    found = words(piece, LETTERS)
    h, row = found.hash, found.row
    rows, cells = [row], [mix(h * _KINDS[0])]
    for gap in (1, 2):
        if h.size > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            cells.append(mix(h[:-gap] * _KINDS[gap] + h[gap:])[same])
    cell = np.concatenate(cells) >> np.uint64(64 - bits)
    return np.concatenate(rows), np.maximum(cell, np.uint64(1)).astype(np.int64)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0
    return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def learn(texts: list[str], labels: np.ndarray, order: np.ndarray, z: np.ndarray, n: np.ndarray, bits: int = BITS) -> None:
    """One pass of FTRL-proximal over the texts in the given order, changing z and n. Cell 0 is the bias (no L1)."""
    parts: list[np.ndarray] = []
    for piece in slices(pa.array(texts, pa.string())):
        row, cell = features(piece, bits)
        size = piece.offsets.size - 1
        key = np.unique(row.astype(np.int64) << bits | cell)
        parts += np.split(key & ((1 << bits) - 1), np.searchsorted(key, np.arange(1, size, dtype=np.int64) << bits))
    for i in order:
        cell = parts[i]
        zi, ni = z[cell], n[cell]
        bias = -z[0] / ((BETA + np.sqrt(n[0])) / ALPHA + L2)
        w = _weights(zi, ni)
        g = _sigmoid(float(w.sum()) + bias) - labels[i]
        root = np.sqrt(ni + g * g)
        z[cell] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
        n[cell] = ni + g * g
        root = np.sqrt(n[0] + g * g)
        z[0] += g - (root - np.sqrt(n[0])) / ALPHA * bias
        n[0] += g * g


def _packed(cell: np.ndarray, z: np.ndarray, n: np.ndarray, bits: int) -> pd.DataFrame:
    """Cells (ascending) with their z and n as one row for each range that has any."""
    cuts = np.searchsorted(cell, np.arange(RANGES + 1) * ((1 << bits) // RANGES))
    full = np.flatnonzero(np.diff(cuts))
    own = [cell[cuts[i] : cuts[i + 1]] for i in full]
    return pd.DataFrame({"part": full, "cell": [pack(c, True) for c in own], "z": [pack(z[c].astype(np.float32)) for c in own], "n": [pack(n[c].astype(np.float32)) for c in own]})


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack(row.cell, np.int64, True), unpack(row.z, np.float32), unpack(row.n, np.float32)


def train(labelled: DataFrame, bits: int = BITS, shards: int = SHARDS, rounds: int = ROUNDS) -> dict:
    """Weights from (id, text, label) rows, already bounded in number. Returns cells, weights and the bias."""
    spark, folder = labelled.sparkSession, workspace(labelled.sparkSession, "toxicity")
    rows = labelled.filter("label is not null").select("id", F.col("label").cast("double").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    rows = zipped(rows, "id", "label", "text").withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int"))
    rows = saved(rows, f"{folder}/sample")
    state = {"cell": np.zeros(0, np.int64), "z": np.zeros(0, np.float32), "n": np.zeros(0, np.float32)}
    for number in range(rounds):
        start, last = spark.sparkContext.broadcast(state), number == rounds - 1

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            """Learn from a group's rows; what changed, packed by range of cells."""
            z, n = np.zeros(1 << bits), np.zeros(1 << bits)
            z[start.value["cell"]], n[start.value["cell"]] = start.value["z"], start.value["n"]
            pdf = pdf.sort_values("id", kind="stable")
            learn([unzipped(t).decode() for t in pdf["text"]], pdf["label"].to_numpy(), np.random.default_rng(number).permutation(len(pdf)), z, n, bits)  # noqa: B023
            z[start.value["cell"]] -= start.value["z"]
            n[start.value["cell"]] -= start.value["n"]
            return _packed(np.flatnonzero(n), z, n, bits)

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            """A cell changes by the mean over the groups that changed it: a sum would overshoot where all agree."""
            z, n, groups = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
            for cell, dz, dn in (_unpacked(r) for r in pdf.itertuples(index=False)):
                z[cell] += dz
                n[cell] += dn
                groups[cell] += 1
            z /= np.maximum(groups, 1)
            n /= np.maximum(groups, 1)
            part, width = int(pdf["part"].iloc[0]), (1 << bits) // RANGES
            old = (start.value["cell"] >= part * width) & (start.value["cell"] < (part + 1) * width)  # noqa: B023
            z[start.value["cell"][old]] += start.value["z"][old]  # noqa: B023
            n[start.value["cell"][old]] += start.value["n"][old]  # noqa: B023
            cell = np.flatnonzero(n)
            return _packed(cell[(np.abs(z[cell]) > L1) | (cell == 0)] if last else cell, z, n, bits)  # noqa: B023

        changed = rows.groupBy("shard").applyInPandas(one, _STATE)
        found = changed.groupBy("part").applyInPandas(total, _STATE).toPandas()
        parts = [_unpacked(r) for r in found.sort_values("part").itertuples(index=False)]
        # A range that no group changed stays as it was.
        kept = ~np.isin(state["cell"] // ((1 << bits) // RANGES), found["part"].to_numpy())
        parts.append((state["cell"][kept], state["z"][kept], state["n"][kept]))
        state = dict(zip(("cell", "z", "n"), map(np.concatenate, zip(*parts, strict=True)), strict=True))
    z, n, cell = state["z"], state["n"], state["cell"]
    bias = cell == 0
    return {"bits": bits, "cells": cell[~bias], "weights": _weights(z[~bias], n[~bias]), "bias": float((-z[bias] / ((BETA + np.sqrt(n[bias])) / ALPHA + L2)).sum())}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0)."""
    docs = docs.drop("score", "predicted")
    names, place = docs.columns, docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = spread.value["bits"]
        weight = np.zeros(1 << bits)
        weight[spread.value["cells"]] = spread.value["weights"]
        for batch in batches:
            sums = []
            for piece in slices(batch.column(place)):
                row, cell = features(piece, bits)
                some = weight[cell] != 0
                key = np.unique(row[some].astype(np.int64) << bits | cell[some])
                sums.append(np.bincount(key >> bits, weight[key & ((1 << bits) - 1)], piece.offsets.size - 1))
            if sums:
                found = _sigmoid(np.concatenate(sums) + spread.value["bias"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(scored, f"{schema}, score double, predicted int")


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of about so many labelled documents. Their ids are few and broadcast, so only their texts are shuffled.

    An id stands once, with the least of its texts, however often it repeats; so the sample is bounded.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    share = min(1.0, sample / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64(id_col), F.lit(_SPAN)) < int(share * _SPAN))
    found = docs.select(id_col, text_col).join(F.broadcast(known), id_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), "label")
    return found.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of the rows whose crc32(doc_id) mod 5 is not 0 and score every row of documents."""
    held = F.coalesce(held_out("doc_id", 0), F.lit(False))
    model = train(sampled(docs, labels.filter(~held)))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
