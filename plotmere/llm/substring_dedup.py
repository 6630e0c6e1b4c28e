"""Substring deduplication: words covered by a window of words that also starts anywhere else are removed.

1. Every document is winnowed: of the word grams in each window the one with the least hash is its anchor. Equal
   windows have equal anchors at equal offsets, so a window can only repeat where its anchor does. Anchors are counted
   (combined before the shuffle) and those that occur once are dropped.
2. For each other anchor the windows that chose it form a region of consecutive words, known by a hash of its words.
   Places (document, region) are grouped by region, so a passage of any number of copies is one region with a count.
   Where an anchor has one region only, all its windows repeat, and no text is looked at.
3. The words of each other region are cut out of one document that has it. Regions are dealt by anchor, so equal windows
   meet; each shard of anchors is the reference for exactly the regions that can match it. A shard builds a suffix
   automaton over its regions and streams the regions through it for matching statistics: at each word, the longest
   suffix that the shard holds at two places or more. Where that reaches the threshold, the window that ends there
   repeats. The runs of such windows go back to all places of their region by a join, where the places of a frequent
   region are dealt over several tasks. Maximal spans of such windows are removed from the documents.

An automaton over a whole corpus could not be broadcast (its size follows the corpus; the README has figures), so the
automata stay where the shuffle put their regions, and only regions with the shard's anchors are streamed there. An
anchor with more than ``hot`` regions is dealt over several shards by region; windows that are alone in such a shard
are then matched between shards by fingerprint, so no shard grows with an anchor.

Edge cases: null, empty and short texts have no window and stay as they are. Rows that repeat a document (id and text)
are places of their own, so each makes the other's windows repeat. Other columns are carried through by ``strip``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm.shared import alphabet, grams, inverse_powers, mix, powers, saved, slices, unzipped, window_least, words, workspace, zipped

WINDOW, GRAM, HOT = 35, 12, 4000
#: A region with more than one in so many of all places (and more than ``hot``) is spread when its places are joined.
FREQUENT = 100_000

PLAIN = alphabet()
#: Places in a slice are kept in so many low bits of a packed hash.
_LOW = np.uint64(22)
_PLACE = np.uint64((1 << 22) - 1)
#: Names of columns that exist within ``strip`` only.
_KEY, _SPANS = "__substring_key", "__substring_spans"
_WORD = regex.compile(rb"[^\x20\x09-\x0D]+")


def regions(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a document's word hashes: each region's anchor hash, first window and number of windows."""
    if hashes.size < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    values = grams(hashes, gram)
    place = np.arange(values.size, dtype=np.uint64)
    least = window_least((values >> _LOW << _LOW) | (place & _PLACE), window - gram + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    at = first + (((least[first] & _PLACE).astype(np.int64) - first) & int(_PLACE))
    return values[at], first, np.diff(np.r_[first, least.size])


def _range_hashes(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash for each run of so many word hashes from each start, by sums up to each word."""
    sums = np.zeros(hashes.size + 1, np.uint64)
    np.cumsum(hashes * powers(hashes.size), out=sums[1:])
    return mix((sums[start + size] - sums[start]) * inverse_powers(hashes.size)[start] + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, anchor, region: a hash of its words, first, n) for each region of docs (id struct, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                found = words(piece, PLAIN)
                parts = [regions(found.hash[a:b], window, gram) for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
                row = np.repeat(np.arange(len(parts)), [p[1].size for p in parts])
                if row.size:
                    anchor, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    region = _range_hashes(found.hash, found.bounds[row] + first, n + window - 1)
                    ids = batch.column(0).take(pa.array(row + piece.first))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(anchor.view(np.int64)), pa.array(region.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "anchor", "region", "first", "n"])

    return docs.select("id", "text").mapInArrow(of, f"id {docs.schema['id'].dataType.simpleString()}, anchor long, region long, first int, n int")


class Automaton:
    """A suffix automaton over several sequences of words, with the number of places of each state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def add(self, sequence: list, times: int) -> list[int]:
        """Add a sequence that stands at so many places; returns the state after each word."""
        nxt, link, size, count = self.next, self.link, self.size, self.count
        last, path = 0, []
        for word in sequence:
            have = nxt[last].get(word)
            if have is not None and size[have] == size[last] + 1:
                last = have
            else:
                if have is not None:  # a path of this length exists only inside a longer state
                    new = self._split(last, word, have)
                else:
                    new = len(nxt)
                    nxt.append({})
                    link.append(0)
                    size.append(size[last] + 1)
                    count.append(0)
                    p = last
                    while p >= 0 and word not in nxt[p]:
                        nxt[p][word] = new
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][word]
                        link[new] = q if size[q] == size[p] + 1 else self._split(p, word, q)
                last = new
            count[last] += times
            path.append(last)
        return path

    def _split(self, p: int, word, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        self.count.append(0)
        link[q] = new
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = new
            p = link[p]
        return new

    def repeated(self) -> list[int]:
        """For each state, the length of its longest suffix that stands at two places or more."""
        size, link, count = self.size, self.link, list(self.count)
        order = sorted(range(1, len(size)), key=size.__getitem__)
        for s in reversed(order):
            if link[s] > 0:
                count[link[s]] += count[s]
        longest = [0] * len(size)
        for s in order:
            longest[s] = size[s] if count[s] > 1 else longest[link[s]]
        return longest


def repeats(sequences: list[list], times: list[int], window: int) -> list[np.ndarray]:
    """For distinct sequences, each at so many places: which of their windows stand at two places or more."""
    if len(sequences) == 1:
        return [np.full(max(len(sequences[0]) - window + 1, 0), times[0] > 1)]
    automaton = Automaton()
    paths = [automaton.add(s, t) for s, t in zip(sequences, times, strict=True)]
    longest = automaton.repeated()
    return [np.fromiter((longest[s] >= window for s in path[window - 1 :]), bool, max(len(path) - window + 1, 0)) for path in paths]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()


def _matched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, salt, region, times, hot, content) come ordered by anchor and salt.

    Gives runs of repeated windows (anchor, region, at, n, print null) and, of hot anchors, the windows that are alone in
    the shard (anchor, region, at, 1, print) or stand for several in it (null region, print).
    """
    names = ["anchor", "region", "at", "n", "print"]
    key, group, hot, out = None, {}, False, []

    def shard() -> None:
        """A row that comes twice (from a document that is repeated) is one region."""
        sequences = [content.split(b" ") for content, _ in group.values()]
        for region, sequence, flags in zip(group, sequences, repeats(sequences, [times for _, times in group.values()], window), strict=True):
            out.extend((key[0], region, at, n, None) for at, n in zip(*_runs(flags), strict=True))
            if hot:
                for a, repeated in enumerate(flags.tolist()):
                    out.append((key[0], None if repeated else region, a, 1, xxhash.xxh3_128_digest(b" ".join(sequence[a : a + window]))))

    def told() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        out.clear()
        return batch

    for batch in batches:
        for anchor, salt, region, times, is_hot, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and key != (anchor, salt):
                shard()
                group = {}
                if len(out) > 10_000:
                    yield told()
            key, hot = (anchor, salt), is_hot
            group[region] = content, times
    if group:
        shard()
    if out:
        yield told()


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, spans array<struct<first, n>>): runs of windows of docs (id struct, text) that stand at two places or more."""
    folder = workspace(docs.sparkSession, "substrings")
    found = anchored(docs, window, gram)
    # Written, so that the joins shuffle both sides and Spark can split the rows of a frequent anchor or region.
    counted = saved(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("anchor"), f"{folder}/anchors")
    placed = saved(found.join(counted, "anchor", "left_semi"), f"{folder}/places")
    distinct = placed.groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "first")).alias("place"), F.min("n").alias("n"))
    distinct = saved(distinct, f"{folder}/distinct")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("several"))
    distinct = distinct.join(several, "anchor")
    alone = distinct.filter("several = 1").select("anchor", "region", F.lit(0).alias("at"), "n")
    shards = F.ceil(F.col("several") / hot).cast("long")
    asked = distinct.filter("several > 1").select(
        F.col("place.id").alias("id"), F.struct("anchor", F.pmod("region", shards).cast("int").alias("salt"), "region", "times", (shards > 1).alias("hot"), F.col("place.first").alias("first"), "n").alias("r")
    )
    asked = asked.groupBy("id").agg(F.collect_list("r").alias("regions"))

    def cut(batches):
        """The words of each region, joined by spaces. Rows that repeat a document come together and are cut once a batch."""
        for batch in batches:
            rows, done = [], set()
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                own = own.as_py()
                if own[0]["region"] in done:
                    continue
                every = unzipped(text.as_py()).split()
                for r in own:
                    done.add(r["region"])
                    rows.append((r["anchor"], r["salt"], r["region"], r["times"], r["hot"], b" ".join(every[r["first"] : r["first"] + r["n"] + window - 1])))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "salt", "region", "times", "hot", "content"])

    pieces = zipped(docs, "id", "text").join(asked, "id").mapInArrow(cut, "anchor long, salt int, region long, times long, hot boolean, content binary")
    dealt = pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    matched = saved(dealt.mapInArrow(lambda b: _matched(b, window), "anchor long, region long, at int, n int, print binary"), f"{folder}/runs")
    prints = matched.filter("print is not null").groupBy("print").agg(F.count(F.lit(1)).alias("shards")).filter("shards > 1")
    between = matched.filter("print is not null and region is not null").join(prints, "print", "left_semi").drop("print")
    runs = alone.union(matched.filter("print is null").drop("print")).union(between).groupBy("anchor", "region").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    # At most so many regions can each have more than this share of all places, so their list may be broadcast.
    most = max(hot, placed.count() // FREQUENT)
    frequent = F.broadcast(distinct.filter(F.col("times") > most).select("anchor", "region", F.ceil(F.col("times") / most).cast("int").alias("shards")))
    spread = placed.drop("n").join(frequent, ["anchor", "region"], "left").withColumn("shard", F.pmod(F.xxhash64("id", "first"), F.coalesce("shards", F.lit(1))).cast("int")).drop("shards")
    runs = runs.join(frequent, ["anchor", "region"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1))).drop("shards")
    every = spread.join(runs, ["anchor", "region", "shard"]).select("id", F.explode(F.transform("runs", lambda r: F.struct((F.col("first") + r["at"]).alias("first"), r["n"].alias("n")))).alias("s"))
    return every.groupBy("id").agg(F.collect_set("s").alias("spans"))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the key that tells documents apart: the id and a hash of the text."""
    text = F.col(text_col).cast("string")
    return docs.withColumn("id", F.struct(F.col(id_col).cast("string").alias("doc"), F.xxhash64(text).alias("hash"))).withColumn("text", text)


def _removed(size: int, found: list | None, window: int) -> np.ndarray:
    gone = np.zeros(size + 1, np.int64)
    for s in found or ():
        gone[s["first"]] += 1
        gone[s["first"] + s["n"] + window - 1] -= 1
    return np.cumsum(gone)[:size] > 0


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 of the words that stay, joined by spaces) for every row."""
    own = _identified(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col).select(F.col(id_col).alias("doc_id"), "id", "text")
    together = zipped(own, "doc_id", "id", "text").join(spans(own.filter("text is not null"), window, gram, hot), "id", "left").select("doc_id", "text", "spans")

    def kept(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                every = unzipped(text.as_py()).split()
                gone = _removed(len(every), found.as_py(), window) if found.is_valid else None
                stay = every if gone is None else [w for w, g in zip(every, gone.tolist(), strict=True) if not g]
                rows.append((len(every), len(every) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
            if rows:
                n, removed, digests = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = together.mapInArrow(kept, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs with the repeated spans cut out of the text: with each removed word goes the white space after it."""
    own = _identified(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col).select("id", "text")
    found = spans(own.filter("text is not null"), window, gram, hot).withColumnRenamed("id", _KEY).withColumnRenamed("spans", _SPANS)
    keyed = docs.withColumn(_KEY, F.struct(F.col(id_col).cast("string").alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("hash")))
    together = keyed.join(found, _KEY, "left").select(*(F.col(f"`{c}`") for c in docs.columns), _SPANS)
    names, place = docs.columns, docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            texts = []
            for text, some in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                if not some.is_valid:
                    texts.append(text.as_py())
                    continue
                data = text.as_py().encode()
                at = [m.start() for m in _WORD.finditer(data)]
                gone = _removed(len(at), some.as_py(), window)
                stops = [*at, len(data)]
                texts.append((data[: at[0]] + b"".join(data[stops[i] : stops[i + 1]] for i in np.flatnonzero(~gone).tolist())).decode())
            if texts:
                columns = list(batch.columns[:-1])
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return together.mapInArrow(cut, docs.schema)
