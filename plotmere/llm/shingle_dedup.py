"""Near-duplicates by the exact Jaccard similarity of word shingles (the pipeline's stage: five words, 0.8 or more).

Texts at this similarity lie too many bits apart for a covering code of 64-bit fingerprints, so candidates come from
MinHash bands: 20 bands of 4 least hashes each. Two texts of similarity s meet in a band with probability
1 - (1 - s^4)^20: 0.99997 at 0.8, more above it. Every meeting is checked with the whole shingle sets, so no link is wrong.

Texts with equal words (A-Z as a-z) are one node. Buckets with the same members are compared once. A bucket hands on a
spanning forest of its links. One of more than ``hot`` nodes is dealt over several shards, each with the bucket's least
node; members that no chain in their shard joins to that node go, in a second pass, to the bucket's other shards, so
every two members are either joined by chains or compared, and a dense bucket costs no more than its members.

With ``bits`` the SimHash fingerprints of the texts (simhash_dedup: three words, covering-code anchors) link as well, and
groups are those of both kinds of links: texts within so many bits, and those of this similarity that lie further apart.

Edge cases: a text of fewer words than a shingle is one shingle; null and texts without a word are one node, linked to
nothing else. Rows that repeat a doc_id keep a row each. Rows with a null doc_id are linked, but never name a component
(component_id is null if no member has an id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm import simhash_dedup
from plotmere.llm.shared import alphabet, components, grams, mix, saved, slices, words, workspace

SHINGLE, LIKENESS = 5, 0.8
BANDS, LEAST = 20, 4
#: Nodes of a bucket that are compared in one group.
HOT = 2000

LETTERS = alphabet(lower=True)
#: Odd factors: each orders the shingles' hashes anew.
FACTORS = mix(np.arange(1, BANDS * LEAST + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending, from those of its words."""
    return np.unique(grams(hashes, min(shingle, hashes.size))) if hashes.size else hashes


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """For sets of shingles (none empty): the key of each of their bands."""
    values, starts = np.concatenate(sets), np.cumsum([0, *(s.size for s in sets[:-1])])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for j in range(BANDS):
        key = np.full(len(sets), j + 1, np.uint64)
        for f in FACTORS[j * LEAST : (j + 1) * LEAST]:
            key = mix(key + np.minimum.reduceat(values * f, starts))
        keys[:, j] = key
    return keys


def _hashed(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The word hashes of each text, slice by slice."""
    for piece in slices(column):
        found = words(piece, LETTERS)
        yield [found.hash[a:b] for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)]


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash of the text, text): what tells rows apart, without Python."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def signatures(docs: DataFrame, shingle: int = SHINGLE, bits: int | None = None) -> DataFrame:
    """(id, hash, node, bands: their keys as bytes, none for a text without a word) for every row of (id, hash, text).

    With bits also fp, the SimHash fingerprint (of equal nodes it is equal: it is made of the same words).
    """
    names, schema = ["id", "hash", "node", "bands"], "id long, hash long, node long, bands binary"
    if bits is not None:
        names, schema = [*names, "fp"], f"{schema}, fp long"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for part in _hashed(batch.column(2)):
                nodes += map(_node, part)
                full = [h for h in part if h.size]
                found = iter(bands([grams(h, min(shingle, h.size)) for h in full])) if full else iter(())
                keys += [next(found).tobytes() if h.size else b"" for h in part]
            columns = [*batch.columns[:2], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.binary())]
            if bits is not None:
                fps = np.fromiter((simhash_dedup.fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
                columns.append(pa.array(fps.view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(of, schema)


def forest(sets: list[np.ndarray], likeness: float) -> tuple[list[int], list[int]]:
    """Links between places in the list that join the sets wherever a chain of sets of this similarity does."""
    sizes = np.array([s.size for s in sets])
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    distinct, rank = np.unique(np.concatenate(sets), return_inverse=True)
    left, a, b, mark = np.ones(sizes.size, bool), [], [], np.zeros(distinct.size, bool)
    for first in range(sizes.size):
        if not left[first]:
            continue
        left[first] = False
        stack = [first]
        while stack and left.any():
            x = stack.pop()
            own = rank[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            shared = np.add.reduceat(mark[rank], starts, dtype=np.int64)
            mark[own] = False
            near = np.flatnonzero(left & (shared >= likeness * (sizes + sizes[x] - shared) - 1e-9)).tolist()
            a += [x] * len(near)
            b += near
            stack += near
            left[near] = False
    return a, b


def _compared(batches: Iterator[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, salt, node, rep, set) come ordered by bucket and salt; groups may span batches.

    Gives links (null bucket, a, b), and the nodes (bucket, a, null b) that their group does not join to rep.
    """
    group, key = {}, None

    def links() -> pa.RecordBatch:
        nodes = list(group)
        x, y = forest([group[n] for n in nodes], likeness)
        joined = {key[2]}
        for i, j in zip(x, y, strict=True):  # from a tree's root outwards, and the rep is the first root
            if nodes[i] in joined:
                joined.add(nodes[j])
        alone = [n for n in nodes if n not in joined]
        at = pa.array([None] * len(x) + [key[0]] * len(alone), pa.int64())
        return pa.RecordBatch.from_arrays([at, pa.array([nodes[i] for i in x] + alone, pa.int64()), pa.array([nodes[j] for j in y] + [None] * len(alone), pa.int64())], ["bucket", "a", "b"])

    for batch in batches:
        for bucket, salt, node, rep, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and key[:2] != (bucket, salt):
                yield links()
                group = {}
            key = bucket, salt, rep
            if node == rep:
                group = {node: np.frombuffer(found, np.uint64), **group}
            else:
                group[node] = np.frombuffer(found, np.uint64)
    if group:
        yield links()


def linked(docs: DataFrame, rows: DataFrame, shingle: int, likeness: float, hot: int, folder: str) -> DataFrame:
    """Links (a, b) between the nodes of docs (id, hash, text), whose signatures are rows."""

    def explode(batches):
        for batch in batches:
            keys = [np.frombuffer(b, np.int64) for b in batch.column(1).to_pylist()]
            n = [k.size for k in keys]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), n))], ["bucket", "node"])

    meetings = rows.select("node", "bands").distinct().mapInArrow(explode, "bucket long, node long")
    full = meetings.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("rep"), F.bit_xor(F.xxhash64("node")).alias("all")).filter("n > 1")
    full = saved(full.groupBy("n", "rep", "all").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "rep"), f"{folder}/buckets")
    shards = F.ceil(F.col("n") / hot).cast("int")
    salt = F.pmod(F.xxhash64("node"), shards).cast("int")
    members = saved(meetings.join(full, "bucket").select("bucket", "node", "rep", shards.alias("shards"), salt.alias("salt")), f"{folder}/members")

    def as_sets(batches):
        for batch in batches:
            found = [shingles(h, shingle).tobytes() for part in _hashed(batch.column(1)) for h in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    # One row of each node that meets another; ids are part of the key, so the rows of copies are spread.
    one = rows.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("r"))
    one = saved(one.select("node", F.col("r.id").alias("_id"), F.col("r.hash").alias("_hash")), f"{folder}/one")
    texts = docs.join(one, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).groupBy("node").agg(F.first("text").alias("text"))
    sets = saved(texts.mapInArrow(as_sets, "node long, shingles binary"), f"{folder}/sets")

    def compared(dealt: DataFrame, name: str) -> DataFrame:
        dealt = dealt.join(sets, "node").select("bucket", "salt", "node", "rep", "shingles").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
        return saved(dealt.mapInArrow(lambda batches: _compared(batches, likeness), "bucket long, a long, b long"), f"{folder}/{name}")

    def everywhere(some: DataFrame) -> DataFrame:
        """Rows of buckets with several shards, in all shards but their own."""
        spread = some.filter("shards > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        return spread.filter("other <> salt").select("bucket", "node", "rep", "shards", F.col("other").alias("salt"))

    first = compared(members.union(everywhere(members.filter("node = rep"))), "links")
    links = first.filter("b is not null").select("a", "b")
    split = members.filter("shards > 1")
    if split.isEmpty():
        return links
    alone = first.filter("b is null").select("bucket", F.col("a").alias("node"))
    guests = everywhere(split.join(alone, ["bucket", "node"], "left_semi"))
    return links.union(compared(split.union(guests), "more").filter("b is not null").select("a", "b"))


def near_prints(rows: DataFrame, bits: int, folder: str) -> DataFrame:
    """Links (a, b) between nodes of rows (node, fp) whose fingerprints differ in so many bits or fewer, or by chains of such."""
    nodes = saved(rows.select("node", "fp").distinct(), f"{folder}/prints")
    first = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")), f"{folder}/first")
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = simhash_dedup.linked(first, bits)
    for end in ("a", "b"):
        ends = ends.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
    return same.union(ends.select("a", "b"))


def _components(docs: DataFrame, shingle: int, likeness: float, hot: int, bits: int | None) -> DataFrame:
    """(id, hash, node, component_id) for every row of (id, hash, text)."""
    folder = workspace(docs.sparkSession, "shingles")
    rows = saved(signatures(docs, shingle, bits), f"{folder}/signatures")
    links = linked(docs, rows, shingle, likeness, hot, folder)
    if bits is not None:
        links = links.union(near_prints(rows, bits, folder))
    joined = components(links, "shingle-components").withColumnRenamed("component", "root")
    distinct = rows.groupBy("node").agg(F.min("id").alias("least"))
    named = saved(distinct.join(joined, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), f"{folder}/roots")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.join(named, "node").select("id", "hash", "node", "component_id")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, likeness: float = LIKENESS, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """(id, node, component_id: the least id that links lead to) for every row."""
    return _components(_keyed(docs, id_col, text_col), shingle, likeness, hot, bits).select(F.col("id").alias(id_col), "node", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, likeness: float = LIKENESS, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """docs without the near-duplicates: of each component the row with the least id stays, as it was.

    Rows of the component that repeat the kept id stay with it, and rows with a null id are kept.
    """
    gone = _components(_keyed(docs, id_col, text_col), shingle, likeness, hot, bits).filter("id <> component_id")
    gone = gone.select(F.col("id").alias("__near_id"), F.col("hash").alias("__near_hash")).distinct()
    same = (F.col(id_col).cast("long") == F.col("__near_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__near_hash"))
    return docs.join(gone, same, "left_anti")
