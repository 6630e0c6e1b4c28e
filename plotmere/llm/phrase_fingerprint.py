"""Document fingerprints by locally consistent parsing.

A text starts as its UTF-8 bytes. At each level runs of one symbol become one symbol, and deterministic coin tossing
labels the rest: a symbol's label is the lowest bit in which it differs from the symbol before it, and that bit. Four
tosses leave labels below 6, three recolourings labels below 3. Local maxima, and local minima away from them, begin
phrases of two or three symbols, and a phrase's name (a hash of its symbols) is a symbol of the next level. A cut
depends on a few neighbours only, so equal substrings are parsed alike but for their ends, wherever they stand.

The fingerprint is the bottom-k sketch (k smallest 32-bit values) of the names of level ``LEVEL`` and above, phrases of a
dozen bytes and more, with the name of the whole text; the likeness of two is the sketch's estimate of Jaccard's index.

Edge cases: null and empty texts have an empty fingerprint, alike with each other only (1.0, else 0.0). The order of
documents is that of ids, then of texts where ids repeat; null ids come first. A document alone is followed by itself.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm.shared import mix, part_count, powers, saved, slices, workspace

#: Names from this level on are sketched; values that a sketch keeps.
LEVEL, KEPT = 3, 32
#: Bytes of text that are parsed together.
TOGETHER = 1 << 20

_RUN, _LENGTH = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _toss_table(values: int) -> np.ndarray:
    """The label for each pair of different small symbols (left, right)."""
    left, right = np.meshgrid(np.arange(values), np.arange(values), indexing="ij")
    low = (left ^ right) & -(left ^ right)
    bit = np.bitwise_count(np.maximum(low - 1, 0).astype(np.uint64)).astype(np.int64)
    return (2 * bit + (right >> bit & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table(128)
#: The least of 0, 1, 2 that neither neighbour has (9 stands for none).
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(10)] for a in range(10)], np.uint8).ravel()


def _labels(symbols: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Labels 0 to 2, different from symbol to symbol of a text; opens marks the places where texts begin."""
    first, edge = np.flatnonzero(opens), np.r_[opens, True]
    x = symbols[1:] ^ symbols[:-1]
    bit = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
    label = np.empty(symbols.size, np.uint8)
    label[1:] = 2 * bit + ((symbols[1:] >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    label[first] = symbols[first].astype(np.uint8) & 1
    for _ in range(3):
        head = label[first] & 1
        label[1:] = _TOSS[label[:-1].astype(np.int32) * 128 + label[1:]]
        label[first] = head
    around = np.full(label.size + 1, 9, np.uint8)  # a text's neighbours at its ends count as 9
    for value in (3, 4, 5):
        at = np.flatnonzero(label == value)
        around[:-1] = label
        before = np.where(edge[at], 9, around[at - 1])
        after = np.where(edge[at + 1], 9, around[at + 1])
        label[at] = _FREE[before.astype(np.int32) * 10 + after]
    return label


def levels(symbols: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level the phrases' names, their rows, and whether a phrase is the whole text. Rows ascend."""
    while symbols.size:
        begins = np.r_[True, (row[1:] != row[:-1]) | (symbols[1:] != symbols[:-1])]
        start = np.flatnonzero(begins)
        if start.size < symbols.size:
            length = np.diff(np.r_[start, symbols.size]).astype(np.uint64)
            symbols, row = symbols[start], row[start]
            symbols = np.where(length > 1, mix(symbols * _RUN + length), symbols)
        opens = np.r_[True, row[1:] != row[:-1]]
        first = np.flatnonzero(opens)
        label = _labels(symbols, opens).astype(np.int8)
        left, right = np.r_[np.int8(-1), label[:-1]], np.r_[label[1:], np.int8(-1)]
        closes = np.r_[opens[1:], True]
        left[first] = -1
        right[closes] = -1
        top = (label > left) & (label > right)
        beside = np.zeros(label.size, bool)
        beside[1:] |= top[:-1]
        beside[:-1] |= top[1:]
        cut = top | ((label < left) & (label < right) & ~beside)
        cut[closes] = False  # no phrase of one symbol at either end
        cut[1:][opens[:-1]] = False
        cut |= opens
        start = np.flatnonzero(cut)
        length = np.diff(np.r_[start, symbols.size])
        place = np.arange(symbols.size) - np.repeat(start, length)
        sums = np.add.reduceat(symbols * powers(max(int(length.max()) + 2, 8))[place + 1], start)
        symbols, row = mix(sums + length.astype(np.uint64) * _LENGTH), row[start]
        whole = np.r_[True, row[1:] != row[:-1]] & np.r_[row[1:] != row[:-1], True]
        yield symbols, row, whole
        symbols, row = symbols[~whole], row[~whole]


def sketches(texts: list[str], level: int = LEVEL, kept: int = KEPT) -> list[np.ndarray]:
    """The k smallest values (uint32, ascending) of each text's names."""
    out: list[np.ndarray] = []
    for piece in slices(pa.array(texts, pa.large_string()), TOGETHER):
        rows = piece.offsets.size - 1
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(piece.offsets))
        keys = []
        for depth, (names, at, whole) in enumerate(levels(piece.data.astype(np.uint64), row), 1):
            if depth < level:
                names, at = names[whole], at[whole]
            keys.append(at.astype(np.uint64) << np.uint64(32) | mix(names) >> np.uint64(32))
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        cuts = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(32))
        values = key.astype(np.uint32)
        out += [values[a : min(a + kept, b)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


def as_text(sketch: np.ndarray) -> str:
    """Eight hexadecimal digits for each value."""
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """The share of the union's k smallest values that both sketches have; 1.0 for two empty ones."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    least = np.flatnonzero(np.r_[True, ~twice])[:kept]
    return float(np.count_nonzero(np.r_[twice, False][least])) / least.size


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fingerprint, a string; a column of that name is replaced."""
    docs = docs.drop("fingerprint")
    names, place = docs.columns, docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches([t or "" for t in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([as_text(x) for x in found], pa.string())], [*names, "fingerprint"])

    return docs.mapInArrow(of, f"{schema}, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDITED = "part int, id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(part: int, rows: list[tuple], following: list[tuple]) -> dict[str, list]:
    """Columns of rows (id, text, sketch) that have these rows after them."""
    after = [edited(t, u) for (_, t, _), (_, u, _) in zip(rows, following, strict=True)]
    new = sketches(after)
    return {
        "part": [part] * len(rows), "id": [r[0] for r in rows], "n_chars": [len(r[1]) for r in rows],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in after],
        "fingerprint": [as_text(r[2]) for r in rows], "edited_fingerprint": [as_text(x) for x in new],
        "near_edited": [likeness(r[2], x) for r, x in zip(rows, new, strict=True)],
        "near_next": [likeness(r[2], f[2]) for r, f in zip(rows, following, strict=True)],
    }


def _batch(columns: dict[str, list], **more: list) -> pa.RecordBatch:
    n = len(columns["id"])
    kinds = {"part": pa.int32(), "id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "head": pa.binary(), "tail": pa.binary()}
    columns = columns | {k: more.get(k, [None] * n) for k in ("head", "tail")}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in columns.items()], list(columns))


def _zip(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text.encode())


def _unzip(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode()


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    Texts are dealt by ranges of ids (compressed) and walked in order; a range's first and last texts are kept in the
    written rows, and each last one is compared with the next range's first in a join of one row for each range.
    """
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "phrases")

    def smaller(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_zip(t or "") for t in batch.column(1).to_pylist()], pa.binary())], ["id", "text"])

    def walked(batches):
        part, last, first = TaskContext.get().partitionId(), None, True

        def rows(held: list[tuple]) -> list[tuple]:
            return [(i, t, s) for (i, t), s in zip(held, sketches([t for _, t in held]), strict=True)]

        def told(found: list[tuple]) -> pa.RecordBatch:
            nonlocal first
            heads = [None] * (len(found) - 1)
            if first and heads:
                heads[0], first = _zip(found[0][1]), False
            return _batch(_compared(part, found[:-1], found[1:]), head=heads)

        held, size = [], 0
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((i, _unzip(data.as_py())))
                size += len(held[-1][1])
                if size >= TOGETHER:
                    found = ([last] if last else []) + rows(held)
                    if len(found) > 1:
                        yield told(found)
                    last, held, size = found[-1], [], 0
        found = ([last] if last else []) + rows(held)
        if len(found) > 1:
            yield told(found)
        if found:
            i, text, sketch = found[-1]
            none = dict.fromkeys(("edited_sha256", "edited_fingerprint", "near_edited", "near_next"), [None])
            columns = {"part": [part], "id": [i], "n_chars": [len(text)], "fingerprint": [as_text(sketch)]} | none
            order = [c.split()[0] for c in _EDITED.split(", ")]
            yield _batch({k: columns[k] for k in order}, head=[_zip(text) if first else None], tail=[_zip(text)])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Texts of equal ids are put in order by their bytes, compressed.
    ordered = texts.mapInArrow(smaller, "id long, text binary").repartitionByRange(part_count(spark), "id").sortWithinPartitions("id", "text")
    found = saved(ordered.mapInArrow(walked, f"{_EDITED}, head binary, tail binary"), f"{folder}/rows")
    parts = sorted(r.part for r in found.filter("tail is not null").select("part").collect())  # one number for each range
    turns = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, turn int")
    heads = found.filter("head is not null").select(F.col("part").alias("turn"), F.col("head").alias("following"))
    ends = found.filter("tail is not null").select("part", "id", "tail").join(turns, "part").join(heads, "turn").select("part", "id", "tail", "following")

    def ended(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = _unzip(row["tail"]), _unzip(row["following"])
                x, y = sketches([a, b])
                columns = _compared(row["part"], [(row["id"], a, x)], [(None, b, y)])
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "part" else None) for k, v in columns.items()} | {"id": pa.array([row["id"]], pa.int64())})

    inner = found.filter("tail is null").drop("head", "tail")
    return inner.union(ends.mapInArrow(ended, _EDITED)).drop("part").withColumnRenamed("id", id_col)
