"""Language-model scoring: an interpolated modified Kneser-Ney model of any order, counted and scored in Spark.

The model lies in the shared folder as sorted arrays, cut into shards by the leading bits of a 64-bit hash:

* words: the hash of each word, ascending, and the word's count. A word's id is its rank over all shards.
* level k, for each length k up to the order: the hash of each sequence of k ids, ascending, and its adjusted count (at
  the highest level, and for sequences from a text's beginning, how often it occurs, else how many different words stand
  before it). Below the highest level it also has what is needed where it is a context: the sum of the adjusted counts
  of its continuations, and how many of those have count 1, 2, and 3 or more.

Keys are stored without the bits that their place in the file tells. All counts of a sequence take one byte together (or
half a byte, where that is smaller), the number of their row in a table of the shard's most frequent rows; other rows lie
in a list beside it, in full.
Workers map the files into memory, so what a worker holds does not grow with the model; a text's look-ups are sorted
first and go shard by shard.

Counting shuffles packed arrays (one row for each run of tokens and shard), which tasks have already summed, so a
sequence that a third of the corpus repeats is one number in each. Sequences are dealt by their own hash, never by their
context, so a frequent context is spread. A shard of one level writes its file and hands on what the next lower level
needs. Shards follow the estimated size of the input (``shard_bytes`` each), with one task for each.

Edge cases: a null or empty text has one token, its end. Rows are independent, so repeated rows count as often as they
occur. With no training rows every probability is 1/(V+1) with V=0, so scores are 0. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm.shared import Alphabet, alphabet, find_file, held_out, mix, pack, part_count, powers, put_file, slices, unpack, words, workspace

#: Longest sequences that are counted; bytes of input (as Spark estimates them) for each shard; fewest shards; tokens or
#: so that a task sums before it hands them on.
ORDER, SHARD_BYTES, FEWEST, FLUSH = 3, 4 << 20, 16, 4_000_000
#: Bytes of text whose words and sequences are looked up together, each shard's file once.
LOOKUP_BYTES = 8 << 20
#: Fixed hashes of the end of a text (a token) and of its beginning (only ever a context).
END, BEGIN = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0xBE61BE61BE61BE63)
#: Columns of a level: the adjusted count, then (below the highest level) the sum and the three numbers of continuations.
_COUNT, _CONTEXT = 1, 5

_ROWS = "shard int, parts array<binary>"


def _tokens(piece, letters: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words with an end after each row's words, and the rows' ranges in them."""
    found = words(piece, letters)
    rows = found.bounds.size - 1
    bounds = found.bounds + np.arange(rows + 1)
    out = np.full(int(bounds[-1]), END, np.uint64)
    out[np.arange(found.hash.size) + found.row] = found.hash
    return out, bounds


def _hashed(ids: list[np.ndarray]) -> np.ndarray:
    """A hash for each sequence of ids, given as one array for each place."""
    factors = powers(len(ids) + 1)
    return mix(sum((mix(x.astype(np.uint64) + np.uint64(1)) * factors[j + 1] for j, x in enumerate(ids)), np.zeros(ids[0].size, np.uint64)))


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in ascending 64-bit keys (shards+1 places); shards is a power of two."""
    if shards == 1:
        return np.array([0, keys.size])
    step = np.uint64((1 << 64) // shards)
    return np.r_[np.searchsorted(keys, np.arange(shards, dtype=np.uint64) * step), keys.size]


class Counts:
    """Distinct sequences: their hashes (ascending), ids (an array for each place; none for words) and columns of counts."""

    def __init__(self, keys: np.ndarray, ids: list[np.ndarray], columns: list[np.ndarray]):
        self.keys, self.ids, self.columns = keys, ids, columns

    @staticmethod
    def summed(parts: list[Counts]) -> Counts:
        keys = np.concatenate([p.keys for p in parts])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, np.int64)
        ids = [np.concatenate(x)[order[first]] for x in zip(*(p.ids for p in parts), strict=True)]
        columns = [np.add.reduceat(np.concatenate(x)[order], first) if first.size else np.zeros(0, np.int64) for x in zip(*(p.columns for p in parts), strict=True)]
        return Counts(keys[first], ids, columns)

    def packed(self, shards: int) -> pa.RecordBatch:
        """A row for each shard that has any, with the ids (or, for words, the hashes) in ascending order of the first."""
        cuts = _cuts(self.keys, shards)
        full, rows = np.flatnonzero(np.diff(cuts)), []
        lead = self.ids or [self.keys]
        for i in full.tolist():
            part = slice(cuts[i], cuts[i + 1])
            order = np.argsort(lead[0][part], kind="stable")
            ids = [x[part][order] for x in lead]
            rows.append([pack(ids[0], True), *(y for x in ids[1:] for y in _coded(x)), *_packed_rows([c[part][order] for c in self.columns])])
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(rows, pa.list_(pa.binary()))], ["shard", "parts"])

    @staticmethod
    def unpacked(parts: list[bytes], places: int, kind: str) -> Counts:
        rest = 1 + 3 * max(places - 1, 0)
        lead = [unpack(parts[0], kind if places else "u8", True), *(_decoded(parts[i : i + 3], kind) for i in range(1, rest, 3))]
        columns = _unpacked_rows(parts[rest:])
        return Counts(_hashed(lead), lead, columns) if places else Counts(lead[0], [], columns)


def _small(values: np.ndarray) -> bytes:
    """Counts in the narrowest kind that holds them, named in two bytes before them."""
    kind = np.min_scalar_type(int(values.max(initial=0))).str[1:]
    return kind.encode() + pack(values.astype(kind))


def _large(data: bytes) -> np.ndarray:
    return unpack(data[2:], data[:2].decode()).astype(np.int64)


#: Rows in a table of frequent rows; also the code of all others.
_OTHER = 255


def _row_codes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's number in a table of the most frequent rows of small numbers; that table; and the places of all others."""
    shift = 8 * np.arange(rows.shape[1])
    # Rows of small numbers are one 64-bit number each, so that the most frequent ones are found by one sort.
    short = np.flatnonzero((rows < 256).all(axis=1))
    every, which, n = np.unique(rows[short] @ (1 << shift), return_inverse=True, return_counts=True)
    often = np.argsort(-n, kind="stable")[:_OTHER]
    number = np.full(every.size, _OTHER, np.uint8)
    number[often] = np.arange(often.size)
    codes = np.full(rows.shape[0], _OTHER, np.uint8)
    codes[short] = number[which]
    return codes, (every[often, None] >> shift).astype(np.uint8), np.flatnonzero(codes == _OTHER)


def _packed_rows(columns: list[np.ndarray]) -> list[bytes]:
    """Columns of counts; several ones as codes of their rows, as the columns mostly tell one another."""
    if len(columns) == 1:
        return [_small(columns[0])]
    rows = np.stack(columns, axis=1)
    codes, table, other = _row_codes(rows)
    return [pack(codes), pack(table.ravel()), _small(other), *(_small(c) for c in rows[other].T)]


def _unpacked_rows(parts: list[bytes]) -> list[np.ndarray]:
    if len(parts) == 1:
        return [_large(parts[0])]
    width = len(parts) - 3
    codes, table = unpack(parts[0], "u1"), np.zeros((_OTHER + 1, width), np.int64)
    often = unpack(parts[1], "u1").reshape(-1, width)
    table[: often.shape[0]] = often
    rows, other = table[codes], _large(parts[2])
    for j in range(width):
        rows[other, j] = _large(parts[3 + j])
    return [np.ascontiguousarray(c) for c in rows.T]


def _coded(values: np.ndarray) -> list[bytes]:
    """The different values, how often each occurs, and for each place its value's rank by that: most ranks are small."""
    every, code, n = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(every.size, np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(every.size)
    return [pack(every, True), _small(n), _small(rank[code])]


def _decoded(parts: list[bytes], kind: str) -> np.ndarray:
    every, n, rank = unpack(parts[0], kind, True), _large(parts[1]), _large(parts[2])
    return every[np.argsort(-n, kind="stable")][rank]


def _gathered(batches: Iterator[pa.RecordBatch], places: int, kind: str) -> Iterator[tuple[int, Counts]]:
    """Sums of each shard's rows; the rows come ordered by shard. They are summed whenever enough have come."""
    shard, parts, size = None, [], 0
    for batch in batches:
        for number, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard is not None and number != shard:
                yield shard, Counts.summed(parts)
                parts, size = [], 0
            shard = number
            parts.append(Counts.unpacked(row.as_py(), places, kind))
            size += parts[-1].keys.size
            if size > FLUSH and len(parts) > 1:
                parts = [Counts.summed(parts)]
                size = parts[0].keys.size // 2
    if shard is not None:
        yield shard, Counts.summed(parts)


# ---------------------------------------------------------------- files

#: Numbers before a file's arrays: how many keys, how many have count 1 to 4, the sum of the counts, the code of other rows.
_HEAD = 7
#: The code of other rows where codes take half a byte.
_HALF = 15


def _cells(keys: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """The cell of a shard's directory that each key lies in: its first 16 bits, less those that the shard has in common."""
    common = shards.bit_length() - 1
    return (keys >> np.uint64(48)).astype(np.int64) - (shard << (16 - common)) if common < 16 else np.zeros(keys.size, np.int64)


def _as_file(keys: np.ndarray, columns: list[np.ndarray], shard: int, shards: int) -> bytes:
    """A shard's file. Of a key the last 48 bits are stored, as 32 and 16; the directory says where each cell begins."""
    count, cells = columns[0], max(1, (1 << 16) // shards)
    filled = lambda n: np.zeros(-n % 8, np.uint8)  # noqa: E731  (arrays begin at multiples of 8)
    rows = np.stack(columns, axis=1)
    codes, often, other = _row_codes(rows)
    table = np.zeros((_OTHER, len(columns)), np.uint8)
    table[: often.shape[0]] = often
    # Codes go by frequency, so those that fit half a byte are the table's first; the rest would join the others.
    rare, each, code = np.flatnonzero(codes >= _HALF), 4 * (1 + len(columns)), _OTHER
    if rare.size * each < codes.size // 2 + other.size * each:
        codes, other, code = np.minimum(codes, _HALF), rare, _HALF
        codes = np.r_[codes, np.zeros(codes.size % 2, np.uint8)]
        codes = codes[::2] | codes[1::2] << 4
    out = [
        np.array([keys.size, *((count == c).sum() for c in (1, 2, 3, 4)), count.sum(), code], np.int64), np.searchsorted(_cells(keys, shard, shards), np.arange(cells + 1)),
        (keys >> np.uint64(16)).astype(np.uint32), filled(4 * keys.size), keys.astype(np.uint16), filled(2 * keys.size),
        codes, filled(codes.size), table, filled(table.size), np.array([other.size], np.int64),
    ]
    for column in (other, *rows[other].T):
        column = column.astype(np.min_scalar_type(int(column.max(initial=0))))
        out += [np.array([column.itemsize], np.int64), column, filled(column.nbytes)]
    return b"".join(x.tobytes() for x in out)


class Mapped(NamedTuple):
    head: np.ndarray
    starts: np.ndarray
    high: np.ndarray
    low: np.ndarray
    codes: np.ndarray
    table: np.ndarray
    other: list[np.ndarray]

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The counts at places, a column for each."""
        last = self.head[-1]
        code = self.codes[at] if last == _OTHER else self.codes[at >> 1] >> (4 * (at & 1)).astype(np.uint8) & _HALF
        out = self.table[np.minimum(code, _OTHER - 1)].astype(np.int64)
        rare = np.flatnonzero(code == last)
        if rare.size:
            where, *columns = self.other
            i = np.searchsorted(where, at[rare].astype(where.dtype))
            for j, column in enumerate(columns):
                out[rare, j] = column[i]
        return out

    def places(self, keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if absent: a binary search in its cell, for all keys side by side."""
        last, wanted = self.high.size - 1, keys & np.uint64((1 << 48) - 1)
        at, end = self.starts[cells], self.starts[cells + 1]

        def key(i: np.ndarray) -> np.ndarray:
            i = np.minimum(i, last)
            return self.high[i].astype(np.uint64) << np.uint64(16) | self.low[i]

        until = end.copy()
        while (open_ := at < end).any():
            middle = (at + end) >> 1
            less = key(middle) < wanted
            at, end = np.where(open_ & less, middle + 1, at), np.where(open_ & ~less, middle, end)
        return np.where((at < until) & (key(at) == wanted), at, -1)


@functools.lru_cache(maxsize=4096)
def _file(uri: str, columns: int, cells: int) -> Mapped | None:
    """A mapped file (None if there is none); a worker process keeps those it used last."""
    data = find_file(uri)
    if data is None:
        return None
    head = np.frombuffer(data[: 8 * _HEAD], np.int64)
    n, at = int(head[0]), 8 * _HEAD

    def take(size: int, kind) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data[at : at + size * np.dtype(kind).itemsize], kind)
        at += found.nbytes + -found.nbytes % 8
        return found

    starts, high, low = take(cells + 1, np.int64), take(n, np.uint32), take(n, np.uint16)
    codes = take(n if head[-1] == _OTHER else (n + 1) // 2, np.uint8)
    table, more = take(_OTHER * columns, np.uint8).reshape(_OTHER, columns), int(take(1, np.int64)[0])
    other = [take(more, f"u{int(take(1, np.int64)[0])}") for _ in range(columns + 1)]
    return Mapped(head, starts, high, low, codes, table, other)


class Keys:
    """Ascending keys in mapped files, one for each shard, and the columns beside them."""

    def __init__(self, folder: str, name: str, shards: int, columns: int):
        self.path, self.shards, self.columns = f"{folder}/{name}", shards, columns

    def file(self, shard: int) -> Mapped | None:
        return _file(f"{self.path}-{shard}", self.columns, max(1, (1 << 16) // self.shards))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For ascending keys: their place in their shard (-1 if absent) and the columns' values (0 if absent)."""
        place, values = np.full(keys.size, -1, np.int64), [np.zeros(keys.size, np.int64) for _ in range(self.columns)]
        cuts = _cuts(keys, self.shards)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            found = self.file(i)
            if found is None or not found.high.size:
                continue
            part = slice(cuts[i], cuts[i + 1])
            at = found.places(keys[part], _cells(keys[part], i, self.shards))
            hit, place[part] = at >= 0, at
            rows = found.rows(np.maximum(at, 0))
            for out, value in zip(values, rows.T, strict=True):
                out[part] = np.where(hit, value, 0)
        return place, values


class Vocabulary:
    """Ids and counts of words; ids are ranks over all shards."""

    def __init__(self, folder: str, shards: int, sizes: dict[int, int]):
        self.words = Keys(folder, "words", shards, _COUNT)
        self.offset = np.r_[0, np.cumsum([sizes.get(i, 0) for i in range(shards)])]

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of token hashes (-1 and 0 if unknown)."""
        keys, back = np.unique(tokens, return_inverse=True)
        place, (count,) = self.words.find(keys)
        shard = np.repeat(np.arange(self.words.shards), np.diff(_cuts(keys, self.words.shards)))
        return np.where(place < 0, -1, place + self.offset[shard])[back], count[back]


def _levels(model: dict) -> dict[int, Keys]:
    return {k: Keys(model["folder"], f"level{k}", model["shards"], _COUNT if k == model["order"] else _CONTEXT) for k in range(1, model["order"] + 1)}


# ---------------------------------------------------------------- training


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many items occur once, twice, three and four times (Chen and Goodman)."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 3 * y)
    return tuple(min(max(d, 0.05), c) for d, c in zip(out, (1, 2, 3), strict=True))


def _shard_count(df: DataFrame, shard_bytes: int) -> int:
    """A power of two that follows Spark's own estimate of the rows' size, from the files' sizes.

    Rows of no file (made by the driver, say) have no estimate: their shards follow the shuffle partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = size // shard_bytes if size < 1 << 60 else part_count(df.sparkSession)
    return 1 << (max(FEWEST, wanted) - 1).bit_length()


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> dict:
    """Count a model from texts. Returns what scoring needs: the folder, sizes, totals and discounts (small numbers).

    The tasks before a shard's hand on a row for each of their runs of ``FLUSH`` tokens; where that would be too many
    rows (beyond some 10 TB at the defaults) ``shard_bytes`` goes up with the executors' memory.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark, folder = texts.sparkSession, workspace(texts.sparkSession, "ngrams")
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    shards = _shard_count(texts, shard_bytes)
    letters = alphabet(lower=True)

    def runs(batches, counts_of) -> Iterator[pa.RecordBatch]:
        """Summed counts of what counts_of finds in each slice's tokens, packed for every so many tokens."""
        parts, size = [], 0
        for batch in batches:
            for piece in slices(batch.column(0), LOOKUP_BYTES):
                parts.append(counts_of(*_tokens(piece, letters)))
                size += parts[-1].keys.size
                if size > FLUSH:
                    yield Counts.summed(parts).packed(shards)
                    parts, size = [], 0
        if parts:
            yield Counts.summed(parts).packed(shards)

    def by_shard(df: DataFrame) -> DataFrame:
        return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")

    def count_words(batches):
        def counts(tokens, bounds):
            keys = np.r_[tokens, np.full(bounds.size - 1, BEGIN)]
            return Counts(keys, [], [np.ones(keys.size, np.int64)])

        yield from runs(batches, counts)

    def write_words(batches):
        for shard, found in _gathered(batches, 0, "u8"):
            put_file(f"{folder}/words-{shard}", _as_file(found.keys, found.columns, shard, shards))
            word = found.keys != BEGIN
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "size": [found.keys.size], "n": [int(found.columns[0][word].sum())], "v": [int(word.sum())]})

    rows = by_shard(texts.mapInArrow(count_words, _ROWS)).mapInArrow(write_words, "shard int, size long, n long, v long").collect()
    sizes = {r.shard: r.size for r in rows}
    model = {"folder": folder, "order": order, "shards": shards, "words": sizes, "tokens": sum(r.n for r in rows), "vocabulary": sum(r.v for r in rows)}
    pad = sum(sizes.values())  # the id that fills the places before a text's beginning
    kind = "u4" if pad < 1 << 32 else "u8"

    def count_sequences(batches):
        """Sequences of ``order`` ids that end at each token."""
        vocabulary = Vocabulary(folder, shards, sizes)
        begin = int(vocabulary.find(np.array([BEGIN]))[0][0])

        def counts(tokens, bounds):
            found = vocabulary.find(tokens)[0]
            place = np.arange(tokens.size) - np.repeat(bounds[:-1], np.diff(bounds))
            ids = []
            for back in range(order - 1, 0, -1):
                before = np.full(tokens.size, pad, np.int64)
                before[back:] = found[:-back] if back < tokens.size else found[:0]
                before[place < back] = pad
                before[place == back - 1] = begin
                ids.append(before.astype(kind))
            ids.append(found.astype(kind))
            return Counts(_hashed(ids), ids, [np.ones(tokens.size, np.int64)])

        yield from runs(batches, counts)

    def write_level(level: int):
        def of(batches):
            for shard, found in _gathered(batches, level, kind):
                filled = found.ids[0] == pad  # no sequence of this length: it only hands on its end
                real = ~filled
                put_file(f"{folder}/level{level}-{shard}", _as_file(found.keys[real], [c[real] for c in found.columns], shard, shards))
                if level == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([[]], pa.list_(pa.binary()))], ["shard", "parts"])
                    continue
                count, none = found.columns[0], np.zeros(found.keys.size, np.int64)
                # Two rows for each shard to come: counts of either kind are nearly all alike, and pack better apart.
                yield Counts.summed([Counts(_hashed(found.ids[1:]), found.ids[1:], [np.where(filled, count, 1), none, none, none, none])]).packed(shards)
                count, ids = count[real], [x[real] for x in found.ids[:-1]]
                yield Counts.summed([Counts(_hashed(ids), ids, [none[real], count, *(x.astype(np.int64) for x in (count == 1, count == 2, count > 2))])]).packed(shards)

        return of

    found = texts.mapInArrow(count_sequences, _ROWS)
    for level in range(order, 0, -1):
        found = by_shard(found).mapInArrow(write_level(level), _ROWS)
    found.count()

    def heads(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for level, table in _levels(model).items():
                    if (file := table.file(shard)) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([level]), *(pa.array([int(x)]) for x in file.head[1:6])], ["level", "n1", "n2", "n3", "n4", "total"])

    every = spark.range(0, shards, 1, max(1, shards // 16)).mapInArrow(heads, "level long, n1 long, n2 long, n3 long, n4 long, total long")
    seen = {r.level: r for r in every.groupBy("level").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "total"))).collect()}
    model["discounts"] = {k: discounts([seen[k].n1, seen[k].n2, seen[k].n3, seen[k].n4]) if k in seen else (0.5, 0.5, 0.5) for k in range(1, order + 1)}
    model["types"] = types = seen[1].total if seen else 0  # distinct pairs of neighbours
    # The mass that goes to unknown words: distinct words by how often they continue something.
    more = model["vocabulary"] - seen[1].n1 - seen[1].n2 if seen else 0
    model["gamma"] = sum(d * n for d, n in zip(model["discounts"][1], (seen[1].n1, seen[1].n2, more), strict=True)) / types if types else 1.0
    return model


# ---------------------------------------------------------------- scoring


def _probabilities(ids: np.ndarray, start: np.ndarray, tables: dict[int, Keys], model: dict) -> np.ndarray:
    """For each place of the texts' ids (-1 unknown; start: the place of each one's text's beginning) its probability."""
    place, order = np.arange(ids.size), model["order"]
    # Known ids in a row, up to each place, within its text.
    run = place - np.maximum.accumulate(np.where(ids < 0, place, start - 1))
    mixed, factors = mix(ids.astype(np.uint64) + np.uint64(1)), powers(order + 1)
    p, context = np.full(ids.size, model["gamma"] / (model["vocabulary"] + 1)), None
    for level in range(1, order + 1):
        at = np.flatnonzero(run >= level)
        keys = np.zeros(at.size, np.uint64)
        for j in range(level):
            keys += mixed[at - level + 1 + j] * factors[j + 1]
        keys, back = np.unique(mix(keys), return_inverse=True)
        columns = []
        for x in tables[level].find(keys)[1]:
            columns.append(np.zeros(ids.size, np.int64))
            columns[-1][at] = x[back]
        d = np.array((0.0, *model["discounts"][level]))
        left = np.maximum(columns[0] - d[np.minimum(columns[0], 3)], 0)
        if level == 1:
            p += left / max(model["types"], 1)
        else:  # the context is the sequence before, in its own text
            total, *kinds = (np.r_[0, x[:-1]] for x in context)
            seen = (total > 0) & (place > start)
            total = np.where(seen, total, 1)
            d = model["discounts"][level]
            p = np.where(seen, (left + sum(a * n for a, n in zip(d, kinds, strict=True)) * p) / total, p)
        context = columns[1:]
    return p


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """Score every text: (id, carried..., n_tokens, n_known, base_score, score), scores as log10 probabilities."""
    letters = alphabet(lower=True)
    docs = docs.select(F.col(text_col).cast("string").alias("text"), id_col, *carried)
    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes[1:]) + ", n_tokens long, n_known long, base_score double, score double"
    folder, shards, n, v = (model[k] for k in ("folder", "shards", "tokens", "vocabulary"))

    def scored(batches):
        vocabulary = Vocabulary(folder, shards, model["words"])
        tables = _levels(model)
        begin = int(vocabulary.find(np.array([BEGIN]))[0][0])
        for batch in batches:
            out = [[], [], [], []]
            for piece in slices(batch.column(0), LOOKUP_BYTES):
                tokens, bounds = _tokens(piece, letters)
                found, count = vocabulary.find(tokens)
                rows = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
                at = np.arange(tokens.size) + rows + 1  # each text has its beginning before it
                ids, first = np.full(tokens.size + bounds.size - 1, begin, np.int64), bounds[:-1] + np.arange(bounds.size - 1)
                ids[at] = found
                p = _probabilities(ids, np.repeat(first, np.diff(bounds) + 1), tables, model)[at]
                base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                for to, x in zip(out, (np.diff(bounds), *(np.add.reduceat(x, bounds[:-1]) for x in ((count > 0).astype(np.int64), base, np.log10(p)))), strict=True):
                    to.append(x)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(np.concatenate(x)) for x in out)], [*batch.schema.names[1:], "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(scored, schema)


def score_held_out(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod 5 is not 1 and score every row of documents."""
    docs = docs.select("doc_id", "text", F.coalesce(held_out("doc_id", 1), F.lit(False)).alias("held_out"))
    model = train(docs.filter(~F.col("held_out")), order=order)
    out = score(docs, model, carried=("held_out",))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * math.log2(10) / F.col("n_tokens")).alias("bits_per_token"))
