"""Benchmark decontamination by winnowing.

Of every run of ``window - gram + 1`` consecutive word grams the one with the least hash is kept, on both sides alike,
so any shared span of ``window`` words shares a kept gram. Kept grams of the benchmark are joined with kept grams of the
documents, and every meeting is extended to the windows that hold the gram; those that are an item's, word by word, are
hits. A window is looked up once, so the work follows the text, whatever repeats in it or in the items. An item of fewer
words is one window and is looked up whole, through runs of its own length.

The benchmark's kept grams and words are broadcast while they are below ``most`` grams; beyond it the kept grams are
joined by a shuffle, and each document is extended against only the items it meets.

Edge cases: a null text, or one without a word, has no words, is no item and is never hit. Repeated items count once
for each item_id; repeated documents get a row each. An item with a null item_id is hit like any other, but has no name
in ``items``; all such items count as one in the n_items of ``report``. An empty benchmark hits nothing. Other columns are carried through
(``mark``) or not read (``report``); the columns that ``mark`` adds replace columns of the same names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm.shared import alphabet, grams, slices, window_least, words

WINDOW, GRAM = 10, 5
#: Kept grams of a benchmark that may be broadcast (about 50 bytes each).
MOST = 2_000_000

LETTERS = alphabet(lower=True, letters=True)
_ADDED = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,words:long>>"


def winnow(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams kept for one sequence of word hashes."""
    values = grams(hashes, gram)
    if not values.size or hashes.size < window:
        return np.zeros(0, np.int64), values[:0]
    # The least hash, the first on ties: its place is kept in the low 24 bits.
    packed = (values >> np.uint64(24) << np.uint64(24)) | (np.arange(values.size, dtype=np.uint64) & np.uint64(0xFFFFFF))
    least = window_least(packed, window - gram + 1)
    new = np.r_[True, least[1:] != least[:-1]]
    low = (least[new] & np.uint64(0xFFFFFF)).astype(np.int64)
    base = np.flatnonzero(new)
    at = base + ((low - base) & 0xFFFFFF)
    return at, values[at]


class Benchmark:
    """Items as word hashes, their kept grams, their windows with the items that have each, and the whole hashes of short items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, gram: int):
        self.window, self.names = window, [name for name, _ in items]
        long = [n for n, (_, h) in enumerate(items) if h.size >= window]
        every = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        self.keys = np.unique(every([winnow(items[n][1], window, gram)[1] for n in long], np.uint64))
        self.text = every([items[n][1] for n in long], np.uint64)
        starts = np.cumsum([0, *(items[n][1].size for n in long)])
        at = every([s + np.arange(items[n][1].size - window + 1) for n, s in zip(long, starts[:-1], strict=True)], np.int64).astype(np.int64)
        hashes = every([grams(items[n][1], window) for n in long], np.uint64)
        owner = np.repeat(np.array(long, np.int64), [items[n][1].size - window + 1 for n in long])
        order = np.lexsort((owner, hashes))
        hashes, owner, at = hashes[order], owner[order], at[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]] if hashes.size else np.zeros(0, bool)
        self.windows, self.place = hashes[new], at[new]  # different windows, and where one stands in text
        kept = new | np.r_[False, owner[1:] != owner[:-1]] if hashes.size else new
        self.owner, self.bounds = owner[kept], np.searchsorted(hashes[kept], self.windows)
        self.bounds = np.r_[self.bounds, self.owner.size]
        self.short = defaultdict(lambda: defaultdict(list))
        for n, (_, h) in enumerate(items):
            if 0 < h.size < window:
                self.short[h.size][int(grams(h, h.size)[0])].append(n)

    def hits(self, hashes: np.ndarray, at: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of a document are hit, and the items that hit them.

        A kept gram that an item keeps too is extended to the windows that hold it. Each such window is looked up once,
        however often its grams stand in the document or the items, and compared with the item's words.
        """
        hit, items = np.zeros(hashes.size, bool), set()
        met = at[np.isin(kept, self.keys)]
        if met.size and hashes.size >= self.window:
            near = np.zeros(hashes.size + 1, np.int64)  # windows that hold a gram which meets one of an item
            np.add.at(near, np.maximum(met - self.window + 1, 0), 1)
            np.add.at(near, met + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[: hashes.size - self.window + 1] > 0)
            asked = grams(hashes, self.window)[starts]
            i = np.minimum(np.searchsorted(self.windows, asked), self.windows.size - 1)
            same = self.windows[i] == asked
            starts, i = starts[same], i[same]
            for k in range(self.window):
                ok = hashes[starts + k] == self.text[self.place[i] + k]
                starts, i = starts[ok], i[ok]
            cover = np.zeros(hashes.size + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + self.window, -1)
            hit |= np.cumsum(cover)[:-1] > 0
            for j in np.unique(i).tolist():
                items.update(self.owner[self.bounds[j] : self.bounds[j + 1]].tolist())
        for size, known in self.short.items():
            runs = grams(hashes, size)
            some = np.flatnonzero(np.isin(runs, np.fromiter(known, np.uint64, len(known))))
            for k in range(size):
                hit[some + k] = True
            for run in np.unique(runs[some]).tolist():
                items.update(known[run])
        return hit, items


def _hashes(column: pa.Array) -> Iterator[np.ndarray]:
    for piece in slices(column):
        found = words(piece, LETTERS)
        for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
            yield found.hash[a:b]


def _result(size: int, found: tuple[np.ndarray, set[int]] | None, names: list[str | None]) -> tuple:
    """n_words, n_hit, the items' names in order (a null last, where one has none) and the spans of hit words."""
    if found is None:
        return size, 0, [], []
    hit, items = found
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    own = {names[n] for n in items}
    own = sorted(own - {None}) + [None] * (None in own)
    return size, int(hit.sum()), own, [{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _named(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_words", "n_hit", "items", "spans"])


def _read_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.filter(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))


def _as_benchmark(rows, window: int, gram: int) -> Benchmark:
    texts = pa.array([r["text"] for r in rows], pa.string())
    return Benchmark([(r["item"], h) for r, h in zip(rows, _hashes(texts), strict=True)], window, gram)


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids of the items with windows in the text) and spans (of hit words)."""
    found = _mark(docs, benchmark, text_col, item_col, item_text, window, gram, most)
    return found.withColumn("items", F.array_compact("items"))


def _mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``mark``, where a null at the end of items stands for items without an id."""
    items = _read_items(benchmark, item_col, item_text)
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + _ADDED
    place = docs.columns.index(text_col)
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    if size // 8 > most:  # a kept gram stands for three words or so
        return _mark_by_join(docs, items, schema, text_col, window, gram)
    spread = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in items.collect()])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _as_benchmark(spread.value, window, gram)
        lengths = {n: np.fromiter(x, np.uint64, len(x)) for n, x in known.short.items()}
        for batch in batches:
            rows = []
            for piece in slices(batch.column(place)):
                found = words(piece, LETTERS)
                at, kept = winnow(found.hash, window, gram)
                near = np.isin(kept, known.keys)
                some = set(found.row[at[near]].tolist())
                for n, short in lengths.items():  # a run over two documents is looked at again below
                    some.update(found.row[np.flatnonzero(np.isin(grams(found.hash, n), short))].tolist())
                # The least gram of a window that spans two documents is kept too; windows inside a document keep theirs.
                for i, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
                    rows.append(_result(b - a, known.hits(found.hash[a:b], *winnow(found.hash[a:b], window, gram)) if i in some else None, known.names))
            if batch.num_rows:
                yield _named(batch, rows)

    return docs.mapInArrow(marked, schema)


def _mark_by_join(docs: DataFrame, items: DataFrame, schema: str, text_col: str, window: int, gram: int) -> DataFrame:
    """For benchmarks too large to broadcast: kept grams meet in a shuffle, then each document meets its items' texts."""

    def kept(batches: Iterator[pa.RecordBatch], of_items: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, hashes in enumerate(_hashes(batch.column(1))):
                found = set(winnow(hashes, window, gram)[1].tolist())
                if not of_items:
                    found |= {x for n in lengths for x in grams(hashes, n).tolist()}
                elif 0 < hashes.size < window:  # a short item is known by all its words
                    found.add(int(grams(hashes, hashes.size)[0]))
                if found:
                    ids = batch.column(0).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(found, np.uint64, len(found)).view(np.int64)), ids], ["gram", "id"])

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([h.size for h in _hashes(batch.column(1))], pa.int32())], ["n"])

    lengths = [r.n for r in items.mapInArrow(sizes, "n int").filter(f"n between 1 and {window - 1}").distinct().collect()]
    names = docs.columns
    docs = docs.withColumn("__bench_row", F.xxhash64(*names))
    items = items.withColumn("__bench_item", F.xxhash64("item", "text"))  # ids may be null, or stand on several texts
    of_items = items.select("__bench_item", "text").mapInArrow(lambda batches: kept(batches, True), "gram long, id long")
    of_docs = docs.select("__bench_row", F.col(text_col).alias("text")).mapInArrow(lambda batches: kept(batches, False), "gram long, id long")
    pairs = of_docs.withColumnRenamed("id", "__bench_row").join(of_items, "gram").select("__bench_row", F.col("id").alias("__bench_item")).distinct()
    met = pairs.join(items, "__bench_item").groupBy("__bench_row").agg(F.collect_set(F.struct("item", "text")).alias("__bench_items"))

    def marked(batches):
        for batch in batches:
            met_items = batch.column(batch.schema.names.index("__bench_items")).to_pylist()
            own = batch.select(names)
            rows = []
            for hashes, some in zip(_hashes(own.column(names.index(text_col))), met_items, strict=True):
                known = _as_benchmark(some or [], window, gram)
                rows.append(_result(hashes.size, known.hits(hashes, *winnow(hashes, window, gram)) if some else None, known.names))
            if batch.num_rows:
                yield _named(own, rows)

    return docs.join(met, "__bench_row", "left").drop("__bench_row").mapInArrow(marked, schema)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256 of the sorted, comma-joined ids, contaminated) for every row."""
    found = _mark(docs.select(id_col, text_col), benchmark, text_col, **options)
    joined = F.array_join("items", ",")
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
