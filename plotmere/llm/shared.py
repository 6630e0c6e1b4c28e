"""What the operators of this package share: the cluster's shared folder, packed arrays, word arrays, components.

Word arrays: an Arrow string column is cut into slices of about a megabyte (always whole documents), and the
words of a slice are found and hashed with numpy over its bytes, so that no Python object is made per word.
"""

from __future__ import annotations

import itertools
import mmap
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a slice holds at least (its last document goes over).
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- the shared folder


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder (as a URI) below spark.checkpoint.dir, which all executors share.

    Where the setting is absent on one machine (tests) a temporary folder becomes the checkpoint folder; on a cluster
    that is an error, as executors could not read each other's disks. The files stay, as lazily evaluated results read them; the cluster clears its checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class NewFile:
    """A file that is written under another name and moved when whole: a task that is run twice leaves one whole file."""

    def __init__(self, uri: str):
        self.uri, self.size = uri, 0
        self._fs, self._path = _opened(uri)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._part = f"{self._path}.{uuid.uuid4().hex}"
        self._out = self._fs.open_output_stream(self._part)

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self._out.close()
        self._fs.move(self._part, self._path)
        return self.uri


def put_file(uri: str, data: bytes) -> None:
    file = NewFile(uri)
    file.write(data)
    file.close()


def get_file(uri: str) -> memoryview:
    """A file's bytes: memory-mapped where the folder is mounted, else from a mapped local copy without a name."""
    fs, path = _opened(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as file:
            return _mapped(file)
    with fs.open_input_stream(path) as source, tempfile.TemporaryFile() as copy:
        while chunk := source.read(1 << 22):
            copy.write(chunk)
        copy.flush()
        return _mapped(copy)


def _mapped(file) -> memoryview:
    """A file's bytes, mapped. Where Python lets go of the descriptor (from 3.13 on), any number of files can stay mapped."""
    if not os.fstat(file.fileno()).st_size:
        return memoryview(b"")
    loose = {"trackfd": False} if sys.version_info >= (3, 13) else {}
    return memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **loose))


def find_file(uri: str) -> memoryview | None:
    """get_file, or None where there is no such file."""
    fs, path = _opened(uri)
    return None if fs.get_file_info(path).type == pafs.FileType.NotFound else get_file(uri)


def saved(df: DataFrame, uri: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def zipped(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, the last of them (text) as zstandard frames: half the bytes in a shuffle."""
    docs = docs.select(*columns)

    def smaller(batches):
        for batch in batches:
            zip_ = zstandard.ZstdCompressor(level=3).compress
            texts = pa.array([zip_(t.as_py().encode()) if t.is_valid else None for t in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], list(columns))

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns[:-1])
    return docs.mapInArrow(smaller, f"{schema}, {columns[-1]} binary")


def unzipped(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


# ---------------------------------------------------------------- packed arrays


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as bytes: differences if ascending, the bytes of equal weight together, zstandard."""
    values = np.asarray(values)
    if ascending and values.size:
        values = np.diff(values, prepend=values.dtype.type(0))
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(values.size, values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)
    return np.cumsum(values, dtype=dtype) if ascending else values


# ---------------------------------------------------------------- words


class Alphabet(NamedTuple):
    """For each byte: whether it belongs to a word, and what it counts as there."""

    inside: np.ndarray
    value: np.ndarray


def alphabet(lower: bool = False, letters: bool = False) -> Alphabet:
    """Words are runs of bytes other than space and 09-0D; with letters, of ASCII letters, digits and non-ASCII bytes.

    With lower, A-Z count as a-z.
    """
    value = np.arange(256, dtype=np.uint8)
    if lower:
        value[65:91] += 32
    inside = np.ones(256, bool)
    inside[[32, 9, 10, 11, 12, 13]] = False
    if letters:
        inside[:128] = False
        inside[48:58] = inside[65:91] = inside[97:123] = True
    return Alphabet(inside, value)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the splitmix64 finalizer)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers 0 to n-1 of an odd base, modulo 2**64."""
    global _powers
    if _powers.size < n:
        more = np.full(max(n, 2 * _powers.size, 4096), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


_inverse_powers = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """What takes powers 0 to n-1 back to 1."""
    global _inverse_powers
    if _inverse_powers.size < n:
        more = np.full(max(n, 2 * _inverse_powers.size, 4096), pow(int(_BASE), -1, 1 << 64), np.uint64)
        more[0] = 1
        _inverse_powers = np.multiply.accumulate(more)
    return _inverse_powers[:n]


class Slice(NamedTuple):
    """Rows first to first+n-1 of a batch: their bytes, and where each row's bytes begin (n+1 numbers)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of whole rows; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


class Words(NamedTuple):
    """Words of a slice: where each begins and ends in its bytes, its row, its hash; per row, its words' range."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


#: Bytes that are looked at together, and of one word that are hashed together.
_CHUNK, _LONG = 1 << 21, 1 << 12


def words(piece: Slice, letters: Alphabet) -> Words:
    """The words of a slice. A long text is cut where no word is, so the arrays per byte stay small."""
    data, offsets = piece.data, piece.offsets
    rows = offsets.size - 1
    found, a = [], 0
    while a < data.size:
        b = min(a + _CHUNK, data.size)
        while b < data.size:  # on to the next byte outside a word, or the next row's first
            ahead = np.flatnonzero(~letters.inside[data[b : b + _CHUNK]])
            row = offsets[np.searchsorted(offsets, b)]
            b = int(min(row, b + ahead[0] if ahead.size else b + _CHUNK, data.size))
            if ahead.size or b == row:
                break
        first, last = np.searchsorted(offsets, [a, b])
        found.append([x + y for x, y in zip(_runs_of_words(data[a:b], offsets[first:last] - a, letters), (a, a, np.uint64(0)), strict=True)])
        a = b
    if not found:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), np.zeros(rows + 1, np.int64))
    start, end, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
    bounds = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(rows), np.diff(bounds)), hashes, bounds)


def _runs_of_words(data: np.ndarray, edges: np.ndarray, letters: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data; texts begin at its start and at the edges."""
    inside = letters.inside[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = edges[edges < data.size]
    begins[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not start.size:
        return start, end, start.astype(np.uint64)
    size = end - start
    if size.max() > _LONG:
        hashes = np.empty(size.size, np.uint64)
        short = size <= _LONG
        if short.any():
            hashes[short] = _hashed_words(data, start[short], size[short], letters)
        for i in np.flatnonzero(~short).tolist():
            hashes[i] = _hashed_long(data[start[i] : end[i]], letters)
        return start, end, hashes
    return start, end, _hashed_words(data, start, size, letters)


_WORD_END = np.uint64(0xD6E8FEB86659FD93)


def _hashed_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, letters: Alphabet) -> np.ndarray:
    total = np.cumsum(size)
    place = np.arange(int(total[-1])) - np.repeat(total - size, size)
    value = (letters.value[data[np.repeat(start, size) + place]].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, total - size) + size.astype(np.uint64) * _WORD_END)


def _hashed_long(data: np.ndarray, letters: Alphabet) -> np.uint64:
    """The same hash for a word of any length, some bytes at a time."""
    total, factor, step = 0, 1, pow(int(_BASE), _LONG, 1 << 64)
    for a in range(0, data.size, _LONG):
        value = letters.value[data[a : a + _LONG]].astype(np.uint64) + np.uint64(1)
        total += factor * int((value * powers(value.size)).sum(dtype=np.uint64))
        factor = factor * step % (1 << 64)
    return mix(np.array([(total + data.size * int(_WORD_END)) % (1 << 64)], np.uint64))[0]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k hashes (k-1 fewer than those; none if there are fewer than k)."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * powers(k + 1)[j + 1]
    return mix(total)


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n, have, out = values.size - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out[:n] if have == width else np.minimum(out[:n], out[width - have : width - have + n])


# ---------------------------------------------------------------- tables


def held_out(column, share: int):
    """crc32(id as text) mod 5 is the given remainder."""
    return (F.crc32(F.col(column).cast("string")) % 5) == share


def part_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the least node.

    Alternates two steps until nothing changes: every node hands its least neighbour to its larger neighbours, then
    to its smaller ones. Each step is an aggregation (combined before the shuffle) and a join back, so a node of any
    degree is spread over tasks; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    folder = workspace(spark, name)
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    pairs, last = saved(pairs, f"{folder}/0"), None
    for step in itertools.count(1):  # each pair of steps shrinks every tree that is not a star, so this ends
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b"))))
        small = large.join(least, "b").select(ends.alias("e")).select("e.a", "e.b")
        pairs = saved(small.filter("a < b").distinct(), f"{folder}/{step}")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
        last = tuple(state)
