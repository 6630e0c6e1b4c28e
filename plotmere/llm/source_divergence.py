"""Source divergence audit: how far each source of a language lies from the others, and by which terms.

Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased. Partitions count them in radix tries
over bytes, whose keys are a language, a zero byte and a term, and whose leaves count documents and, for each source,
occurrences. A trie is laid out in preorder (RadixTrie): leaf by leaf, the depth at which its path leaves that of the
leaf before, and the label from there on. Tries are cut at the bounds of prefix ranges, dealt by range and merged there,
as the documents that hold a term are known only then. A walk over a merged trie, which goes in UTF-8 order, adds up the pairs of sources and
keeps the best terms of each.

A partition's trie is handed on at LEAVES leaves, and a range folds what has come into one trie at every FOLD leaves, so
neither grows with the corpus. A language's totals (a number for each source of it) go to the walk beside its tries;
the result has the square of them in rows, and a walk holds as many sums.

Null text, language or source: ''. A text without terms counts nothing, but its (lang, source) gives rows. Every row is
a document, rows that repeat an id too. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm.shared import Alphabet, mix, part_count, saved, slices, words, workspace

#: A kept term stands in so many documents of its language.
LEAST_DOCUMENTS = 3
#: Terms that a group lists.
TOP = 200
#: Probabilities are whole parts of this.
ONE = 1_000_000_000
#: Leaves of a partition's trie before it is handed on; leaves in a row of the file; leaves that a range gathers before it folds them.
LEAVES, ROW, FOLD = 400_000, 8192, 2_000_000
#: Bytes of text that are counted at once (64-bit hashes tell the terms of so much apart); numbers that a walk holds at once beside its sums.
TEXT, CELLS = 8 << 20, 1 << 20
#: Rows that stand for a language's totals, so that the tries of a large language meet them in as many tasks.
SALTS = 64
#: What a walk returns, and the audit.
PARTIAL = [("lang", pa.string()), ("source", pa.string()), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("values", pa.list_(pa.int64()))]
FOUND = [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("rank", pa.int32())]


def _letters() -> Alphabet:
    inside = np.zeros(256, bool)
    inside[65:91] = inside[97:123] = True
    inside[128:] = True
    value = np.arange(256, dtype=np.uint8)
    value[65:91] += 32
    return Alphabet(inside, value)


# ---------------------------------------------------------------- tries


class RadixTrie(NamedTuple):
    """Leaves in byte order of their keys.

    keys: binary; docs: documents of each leaf; bounds: where each leaf's counters lie in source and count (one more
    than leaves); sources: what the numbers in source name.
    """

    keys: pa.BinaryArray
    docs: np.ndarray
    bounds: np.ndarray
    source: np.ndarray
    count: np.ndarray
    sources: list[str]

    def part(self, a: int, b: int) -> RadixTrie:
        x, y = self.bounds[a], self.bounds[b]
        return RadixTrie(self.keys[a:b], self.docs[a:b], self.bounds[a : b + 1] - x, self.source[x:y], self.count[x:y], self.sources)

    def kept(self, which: np.ndarray) -> RadixTrie:
        sizes = np.diff(self.bounds)
        of = np.repeat(which, sizes)
        return RadixTrie(self.keys.filter(pa.array(which)), self.docs[which], np.concatenate([[0], np.cumsum(sizes[which])]), self.source[of], self.count[of], self.sources)


def merge(tries: list[RadixTrie]) -> RadixTrie:
    """One trie of several: leaves of equal keys add up."""
    names = {s: i for i, s in enumerate(sorted({s for t in tries for s in t.sources}))}
    keys = pa.concat_arrays([t.keys.cast(pa.large_binary()) for t in tries]).dictionary_encode()
    order = pc.sort_indices(keys.dictionary).to_numpy()
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    leaf = place[keys.indices.to_numpy()]
    docs = np.zeros(order.size, np.int64)
    np.add.at(docs, leaf, np.concatenate([t.docs for t in tries]))
    own = np.concatenate([np.array([names[s] for s in t.sources], np.int64)[t.source] for t in tries])
    pair = np.repeat(leaf, np.concatenate([np.diff(t.bounds) for t in tries])) * max(1, len(names)) + own
    pairs, at = np.unique(pair, return_inverse=True)
    count = np.zeros(pairs.size, np.int64)
    np.add.at(count, at, np.concatenate([t.count for t in tries]))
    bounds = np.searchsorted(pairs, np.arange(order.size + 1) * max(1, len(names)))
    return RadixTrie(keys.dictionary.take(pa.array(order)), docs, bounds, pairs % max(1, len(names)), count, list(names))


def _raw(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the keys and where each begins."""
    keys = keys.cast(pa.large_binary())
    _, at, data = keys.buffers()
    at = np.frombuffer(at, np.int64)[keys.offset : keys.offset + len(keys) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes from each start, size of them, one after another."""
    total = np.cumsum(size)
    return data[np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if total.size else 0)]


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), size.size, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def dumped(trie: RadixTrie) -> bytes:
    """The trie in preorder: depths, labels, counters."""
    data, at = _raw(trie.keys)
    size = np.diff(at)
    depth, on = np.zeros(size.size, np.int64), np.arange(1, size.size)
    while on.size:  # paths that still run along the leaf before
        d = depth[on]
        on = on[(d < size[on]) & (d < size[on - 1])]
        d = depth[on]
        on = on[data[at[on] + d] == data[at[on - 1] + d]]
        depth[on] += 1
    label = _gathered(data, at[:-1] + depth, size - depth)
    names = json.dumps(trie.sources).encode()
    columns = [depth.astype(np.uint32), (size - depth).astype(np.uint32), trie.docs, np.diff(trie.bounds).astype(np.uint32), trie.source.astype(np.uint32), trie.count]
    head = np.array([size.size, label.size, trie.count.size, len(names)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(c.size, c.itemsize).T).tobytes() for c in columns), label.tobytes(), names]))


def loaded(blob: bytes) -> RadixTrie:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    (n, n_label, n_count, n_names), at = raw[:32].view(np.int64).tolist(), 32
    found = []
    for kind, many in ((np.uint32, n), (np.uint32, n), (np.int64, n), (np.uint32, n), (np.uint32, n_count), (np.int64, n_count)):
        wide = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(raw[at : at + wide * many].reshape(wide, many).T).view(kind).reshape(-1).astype(np.int64))
        at += wide * many
    depth, tail, docs, counters, source, count = found
    label, sources = raw[at : at + n_label], json.loads(raw[at + n_label : at + n_label + n_names].tobytes())
    size = depth + tail
    ends, to = np.cumsum(tail), np.concatenate([[0], np.cumsum(size)])
    data = np.empty(int(to[-1]), np.uint8)
    data[np.repeat(to[:-1] + depth - (ends - tail), tail) + np.arange(label.size)] = label
    on, d = np.flatnonzero(depth > 0), 0
    while on.size:  # byte d of a path comes from the last leaf that left the path at d or before
        last = np.maximum.accumulate(np.where(depth <= d, np.arange(n), 0))[on]
        data[to[on] + d] = data[to[last] + d]
        d += 1
        on = on[depth[on] > d]
    return RadixTrie(_binary(data, size), docs, np.concatenate([[0], np.cumsum(counters)]), source, count, sources)


def _key(lang: str) -> bytes:
    """What a language's keys begin with. Terms have no zero byte, so the last one ends the language."""
    return lang.encode() + b"\0"


# ---------------------------------------------------------------- counting


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[RadixTrie]:
    """Tries of (lang, source, text) rows."""
    letters, found, leaves = _letters(), [], 0
    for batch in batches:
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        lang, source = (x.indices.to_numpy() for x in (langs, sources))
        begin = [_key(x) for x in langs.dictionary.to_pylist()]
        for piece in slices(batch.column(2), TEXT):
            w = words(piece, letters)
            if not w.start.size:
                continue
            row = w.row + piece.first
            _, first, term = np.unique(mix(w.hash + mix(lang[row].astype(np.uint64))), return_index=True, return_inverse=True)
            pairs, count = np.unique(term * np.int64(len(sources.dictionary)) + source[row], return_counts=True)
            held = np.unique(term * np.int64(batch.num_rows) + row)
            docs = np.bincount(held // batch.num_rows, minlength=first.size)
            head = [begin[i] for i in lang[row[first]]]
            text = letters.value[_gathered(piece.data, w.start[first], w.end[first] - w.start[first])].tobytes()
            ends = np.cumsum(w.end[first] - w.start[first]).tolist()
            keys = pa.array([h + text[a:b] for h, a, b in zip(head, [0, *ends], ends, strict=False)], pa.large_binary())
            bounds = np.searchsorted(pairs, np.arange(first.size + 1) * len(sources.dictionary))
            found.append(RadixTrie(keys, docs, bounds, pairs % len(sources.dictionary), count, sources.dictionary.to_pylist()))
            leaves += first.size
            if leaves >= LEAVES:
                found = [merge(found)]
                leaves = len(found[0].keys)
                if leaves >= LEAVES // 2:
                    yield found[0]
                    found, leaves = [], 0
    if found:
        yield merge(found)


def _in_rows(trie: RadixTrie) -> Iterator[tuple[bytes, bytes]]:
    for a in range(0, len(trie.keys), ROW):
        part = trie.part(a, min(a + ROW, len(trie.keys)))
        yield part.keys[0].as_py(), dumped(part)


def _out(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)], [name for name, _ in schema])


def count(docs: DataFrame, folder: str) -> DataFrame:
    """Tries of partitions in a file, a row for ROW leaves: (first binary, trie binary)."""

    def tries(batches):
        for trie in _counted(batches):
            for r in _in_rows(trie):
                yield _out([r], [("first", pa.binary()), ("trie", pa.binary())])

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return saved(texts.mapInArrow(tries, "first binary, trie binary"), f"{folder}/tries")


def merged(tries: DataFrame, folder: str, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Tries of prefix ranges in a file, of kept terms: (lang, trie binary, terms long, totals array of (source, n))."""
    spark = tries.sparkSession
    ranges = max(part_count(spark), tries.count() * ROW // FOLD + 1)

    def least(batches):
        if firsts := [min(batch.column(0).to_pylist()) for batch in batches if batch.num_rows]:
            yield _out([(min(firsts),)], [("least", pa.binary())])

    found = tries.select("first").repartitionByRange(ranges, "first").mapInArrow(least, "least binary")
    bounds = sorted(bytes(r.least) for r in found.collect())[1:]  # one for each range

    def cut(batches):
        limits = pa.array(bounds, pa.large_binary())
        for batch in batches:
            for blob in batch.column(1):
                trie = loaded(blob.as_py())
                keys = trie.keys.cast(pa.large_binary())
                # the range of each leaf: how many bounds aren't above it
                both = pc.sort_indices(pa.table({"k": pa.concat_arrays([limits, keys]), "o": np.repeat([0, 1], [len(limits), len(keys)])}), [("k", "ascending"), ("o", "ascending")]).to_numpy()
                of = np.cumsum(both < len(limits))[both >= len(limits)]
                edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
                yield _out([(int(of[a]), dumped(trie.part(int(a), int(b)))) for a, b in zip(edges[:-1], edges[1:], strict=True)], [("range", pa.int64()), ("trie", pa.binary())])

    def fold(batches):
        held, leaves, at = [], 0, None
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != at and held:
                    yield from finished(merge(held))
                    held, leaves = [], 0
                at = number
                held.append(loaded(blob.as_py()))
                leaves += len(held[-1].keys)
                if leaves >= FOLD:
                    held = [merge(held)]
                    leaves = len(held[0].keys) // 2  # at least as many must come before the next fold
        if held:
            yield from finished(merge(held))

    def finished(trie):
        trie = trie.kept(trie.docs >= least_documents)
        keys = trie.keys.to_pylist()
        langs = [k[: k.rindex(b"\0")] for k in keys]
        edges = [i for i in range(len(keys)) if i == 0 or langs[i] != langs[i - 1]] + [len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = trie.part(a, b)
            totals = np.zeros(len(part.sources), np.int64)
            np.add.at(totals, part.source, part.count)
            listed = [{"source": s, "n": int(n)} for s, n in zip(part.sources, totals, strict=True) if n]
            for x in range(a, b, ROW):
                y = min(x + ROW, b)
                yield _out([(langs[a].decode(), dumped(trie.part(x, y)), y - x, listed if x == a else [])], [("lang", pa.string()), ("trie", pa.binary()), ("terms", pa.int64()), ("totals", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])

    dealt = tries.mapInArrow(cut, "range long, trie binary").repartition(ranges, "range").sortWithinPartitions("range")
    return saved(dealt.mapInArrow(fold, "lang string, trie binary, terms long, totals array<struct<source: string, n: long>>"), f"{folder}/merged")


# ---------------------------------------------------------------- the walk


def smoothed(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / total), exactly, for totals below 9e15."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


class _Best:
    """The highest values of a group, the least term first among equals."""

    def __init__(self, top: int):
        self.top, self.values, self.terms = top, np.zeros(0, np.int64), []

    def offer(self, values: np.ndarray, terms: list[bytes], at: np.ndarray) -> None:
        least = self.values[-1] if len(self.terms) >= self.top else -1
        if values.size > self.top:
            least = max(least, np.partition(values, -self.top)[-self.top])
        values, at = values[values >= least], at[values >= least]
        values = np.concatenate([self.values, values])
        names = [*self.terms, *(terms[i] for i in at.tolist())]
        order = sorted(range(len(names)), key=lambda i: (-int(values[i]), names[i]))[: self.top]
        self.values, self.terms = values[order], [names[i] for i in order]


def walked(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (lang, trie, kept terms of the language, its sources, their totals): partial sums of pairs, best terms."""

    def walk(batches):
        sums: dict[str, tuple[list[str], np.ndarray]] = {}
        best: dict[tuple[str, str], _Best] = {}
        for batch in batches:
            for lang, blob, kept, sources, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, n = {s: i for i, s in enumerate(sources)}, np.array(totals, np.int64)
                held = sums.setdefault(lang, (sources, np.zeros((len(sources), len(sources)), np.int64)))[1]
                whole = loaded(blob)
                own = np.array([number.get(s, 0) for s in whole.sources], np.int64)
                step = max(1, CELLS // len(sources))
                for trie in (whole.part(a, min(a + step, len(whole.keys))) for a in range(0, len(whole.keys), step)):
                    counts = np.zeros((len(sources), len(trie.keys)), np.int64)
                    counts[own[trie.source], np.repeat(np.arange(len(trie.keys)), np.diff(trie.bounds))] = trie.count
                    p, q = smoothed(counts, (n + kept)[:, None]), smoothed(counts.sum(axis=0), n.sum() + kept)
                    for j in range(len(sources)):  # the sums of all against source j
                        held[:, j] += ((p - p[j]) ** 2 // p[j]).sum(axis=1)
                    terms = [k[k.rindex(b"\0") + 1 :] for k in trie.keys.to_pylist()]
                    for i in range(len(sources)):
                        at = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                        best.setdefault((lang, sources[i]), _Best(top)).offer((p[i, at] - q[at]) ** 2 // q[at], terms, at)
        for lang, (sources, held) in sums.items():
            for i, s in enumerate(sources):
                top_ = best[lang, s]
                yield _out([(lang, s, sources, held[i].tolist(), [t.decode() for t in top_.terms], top_.values.tolist())], PARTIAL)

    return walk


def ranked(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From partial rows of groups (equal ones together): sums added up, the best terms of all, both in order."""

    def merge_rows(batches):
        at, sources, sums, best = None, [], None, _Best(top)
        for batch in batches:
            for lang, source, others, partial, terms, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, source) != at:
                    if at is not None:
                        yield from rows(at, sources, sums, best)
                    at, sources, sums, best = (lang, source), others, np.zeros(len(others), np.int64), _Best(top)
                sums += np.array(partial, np.int64)
                best.offer(np.array(values, np.int64), [t.encode() for t in terms], np.arange(len(terms)))
        if at is not None:
            yield from rows(at, sources, sums, best)

    def rows(at, sources, sums, best):
        pairs = sorted(((-int(v), t.encode(), t) for t, v in zip(sources, sums, strict=True) if t != at[1]))
        found = [(*at, "pair", t, -v, i + 1) for i, (v, _, t) in enumerate(pairs)]
        found += [(*at, "term", t.decode(), int(v), i + 1) for i, (t, v) in enumerate(zip(best.terms, best.values, strict=True))]
        if found:
            yield _out(found, FOUND)

    return merge_rows


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value long, rank int): each source against the others ("pair"), and what marks it ("term").

    p and q are smoothed parts of ONE of the kept terms (those in least_documents documents of the language);
    f = floor((p - q)**2 / q). A pair's value adds f over the kept terms, with q of the other source. A term's value is
    f with q of the language, for terms of the source with p > q, the top of them. Ties go by item in UTF-8 order.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "divergence")
    tries = merged(count(docs, folder), folder, least_documents)
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    n = tries.select("lang", F.explode("totals").alias("t")).groupBy("lang", "t.source").agg(F.sum("t.n").alias("n"))
    groups = saved(groups.join(n, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0))), f"{folder}/groups")
    totals = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g")).select("lang", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    beside = totals.join(tries.groupBy("lang").agg(F.sum("terms").alias("kept")), "lang").withColumn("salt", spread)
    salted = tries.select("lang", "trie", F.pmod(F.crc32("trie"), F.lit(SALTS)).cast("int").alias("salt"))
    kind = "lang string, source string, sources array<string>, sums array<long>, terms array<string>, values array<long>"
    found = salted.join(beside, ["lang", "salt"]).select("lang", "trie", "kept", "sources", "totals").mapInArrow(walked(top), kind)
    none = totals.select("lang", F.explode("sources").alias("source"), "sources", F.transform("sources", lambda s: F.lit(0).cast("long")).alias("sums"), F.array().cast("array<string>").alias("terms"), F.array().cast("array<long>").alias("values"))
    dealt = found.union(none).repartition("lang", "source").sortWithinPartitions("lang", "source")  # a row for each task that met a group
    return dealt.mapInArrow(ranked(top), "lang string, source string, part string, item string, value long, rank int")
