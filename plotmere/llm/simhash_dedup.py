"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at 3 or fewer differing bits.

Candidates come from a covering code. Of any three differing bits at most one falls in one of two disjoint 31-bit
halves of the fingerprint (the two bits left over only help), so in one of them the fingerprints differ in at most
one bit. In each half the anchors are the words of the perfect Hamming code of length 31, whose covering radius is 1:
every fingerprint has a home anchor at distance 0 or 1, and is replicated to every anchor within radius plus threshold,
1 + 1 = 2 (1 or 16 anchors). Two fingerprints within one bit meet at the home anchor of either. Fingerprints are
compared per anchor, over all 64 bits, and an anchor hands on a spanning forest of its links, never all pairs.

Only distinct fingerprints are replicated, so a group of exact copies is one row. An anchor's members are walked from
one to the next over the members not yet reached, with numpy, so a dense ball of near copies is reached in few steps
and an anchor's output is at most its members.

Edge cases: null or empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id keep a row
each. Rows with a null doc_id are linked, but never name a component (component_id is null if no member has an id).
An empty table gives an empty result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm.shared import components, saved, workspace

HALF = 31
MASK = np.uint64((1 << HALF) - 1)
ONE = np.uint64(1)
#: Each row holds the positions 1 to 31 whose number has one of the five bits: the code's parity checks.
CHECKS = [np.uint64(sum(1 << (p - 1) for p in range(1, HALF + 1) if p >> b & 1)) for b in range(5)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of each bit over the XXH64 (seed 42) of the text's word shingles, A-Z in lower case."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = max(len(found) - shingle + 1, 1)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[min(shingle, len(found)) - 1 :].tolist(), strict=True)), np.uint64, last)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(of, "id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    return sum(((np.bitwise_count(x & c) & 1).astype(np.uint64) << np.uint64(b) for b, c in enumerate(CHECKS)), np.zeros(x.size, np.uint64))


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints (uint64): keys of anchors, the index of the fingerprint at each, and whether it is at home there."""
    keys, index, home = [], [], []
    everyone = np.arange(fps.size)
    for half in (0, 1):
        x = (fps >> np.uint64(HALF * half)) & MASK
        syndrome = _syndrome(x)
        tag = np.uint64(half << HALF)
        off = syndrome > 0
        keys.append(np.where(off, x ^ (ONE << (np.maximum(syndrome, ONE) - ONE)), x) | tag)
        index.append(everyone)
        home.append(np.ones(fps.size, bool))
        for i in range(1, HALF + 1):  # two flips i < j with i xor j the syndrome also lead to a code word
            j = syndrome ^ np.uint64(i)
            two = off & (j > i)
            keys.append((x[two] ^ np.uint64(1 << (i - 1)) ^ (ONE << (j[two] - ONE))) | tag)
            index.append(everyone[two])
            home.append(np.zeros(int(two.sum()), bool))
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def forest(members: np.ndarray, bits: int = 3) -> tuple[list[int], list[int]]:
    """Links (as two lists) that join the members wherever a chain of members within so many bits does."""
    left, a, b = members, [], []
    while left.size > 1:
        stack, left = [left[0]], left[1:]
        while stack and left.size:
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                a += [int(x)] * found.size
                b += found.tolist()
                stack += list(found)
                left = left[~near]
    return a, b


def _compared(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, fp, home) come ordered by anchor; groups may span batches."""
    rest: pa.Table | None = None

    def links(keys, fps, home) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], keys.size]
        full = (ends - starts > 1) & (np.add.reduceat(home.astype(np.int64), starts) > 0)
        a, b = [], []
        for s, e in zip(starts[full].tolist(), ends[full].tolist(), strict=True):
            if e - s == 2:
                if (int(fps[s]) ^ int(fps[s + 1])).bit_count() <= bits:
                    a.append(int(fps[s]))
                    b.append(int(fps[s + 1]))
                continue
            x, y = forest(fps[s:e], bits)
            a += x
            b += y
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    def columns(t: pa.Table):
        return t["anchor"].to_numpy(), t["fp"].to_numpy().view(np.uint64), np.asarray(t["home"])

    for batch in batches:
        if batch.num_rows:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = rest["anchor"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield links(*columns(rest.slice(0, cut)))
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield links(*columns(rest))


def linked(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps (fp long): a spanning forest for each anchor."""
    if not 0 <= bits <= 3:
        raise ValueError("the two halves cover at most 3 differing bits")

    def replicate(batches):
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            keys, index, home = anchors(found)
            order = np.argsort(index, kind="stable")
            for i in range(0, order.size, 100_000):
                part = order[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(found[index[part]].view(np.int64)), pa.array(home[part])], ["anchor", "fp", "home"])

    spread = fps.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    meeting = spread.repartition("anchor").sortWithinPartitions("anchor")
    return meeting.mapInArrow(lambda batches: _compared(batches, bits), "a long, b long")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id: the least id that links lead to) for every row."""
    folder = workspace(docs.sparkSession, "simhash")
    rows = saved(fingerprints(docs, id_col, text_col, shingle), f"{folder}/fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("id").alias("least")), f"{folder}/distinct")
    links = saved(linked(distinct, bits), f"{folder}/links")
    joined = components(links, "simhash-components").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = distinct.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    out = rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """docs without the near-duplicates: of each component the row with the least id stays, as it was.

    Rows of the component that repeat the kept id stay with it, and rows with a null id are kept.
    """
    gone = cluster(docs, id_col, text_col, shingle, bits).filter(F.col(id_col) != F.col("component_id"))
    gone = gone.select(F.col(id_col).alias("__near_id"), F.conv("fingerprint", 16, -10).cast("long").alias("__near_of")).distinct()
    names = docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(len(names))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*names, "__near_fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", __near_fp long"
    marked = docs.withColumn("__near_text", F.col(text_col).cast("string")).mapInArrow(of, schema)
    return marked.join(gone, (F.col(id_col).cast("long") == F.col("__near_id")) & (F.col("__near_fp") == F.col("__near_of")), "left_anti").drop("__near_fp")
