"""Token ids in files of Simple-8b words.

A file holds the ids of consecutive documents in ascending order of their id. Ids are cut into blocks of 1,024, and a
block into 64-bit words: the low four bits select how many ids of how many bits follow. Selector 0 is an escape: the
next word is one id as it is (for ids of more than 60 bits). Blocks start at words that the file lists, so blocks are
packed and unpacked side by side in numpy, one step for each word of the longest block.

File layout, little-endian: one segment after the other, so a file of any size is written and read in bounded memory. A
segment is "S8BLOCK1", then as int64 the numbers of documents, ids, blocks and words, then arrays: document ids and their
numbers of ids (int64; the complement of the number where the document's id is null), the blocks' first words (int64), the
words (uint64).

Texts are encoded by the tokenizers library. It never looks across ASCII white space, so a text is cut there and the
parts (with A-Z in lower case, if the tokenizer lower-cases) are looked up in a bounded table; the library encodes those
not in it. Documents are range-partitioned by id and sorted, so files follow each other in order of id. A table beside the
files has their numbers of ids; a document's place is the sum of the files before it plus its place in its file.

Edge cases: a null or empty text has the end id only. Equal document ids keep a place each, in order of their texts; null
ids come first. Ids are integers, or texts of integers. An empty table writes no file. Rows' other columns are not read.
"""

from __future__ import annotations

import array
import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plotmere.llm.shared import NewFile, get_file, part_count, saved, workspace

MAGIC = b"S8BLOCK1"
BLOCK = 1024
#: Fixed values of the format: ids in a word and bits of each, for selectors 1 to 15 (0 is the escape).
PACKINGS = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
#: Ids of a segment and bytes of a file, at least, before the next one begins; parts that a worker remembers (about 150
#: bytes each); documents that it encodes together.
SEGMENT_IDS, FILE_BYTES, REMEMBERED, TOGETHER = 2_000_000, 256 << 20, 1_000_000, 2000


def _chosen(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of each block starts (ascending), its selector, and how many ids it takes.

    A word takes the most ids that all fit, up to the block's end. All blocks are followed side by side; where a word of
    more ids fits, one of fewer ids and more bits does too, so a block tries one selector after the other.
    """
    n = ids.size
    bits = np.zeros(n + 1, np.uint8)  # the place after the last stands for none
    bits[:n] = np.frexp(ids.astype(np.float64))[1]
    at = np.arange(0, n, BLOCK)
    block, ends, found = np.arange(at.size), np.minimum(at + BLOCK, n), []
    counts = np.zeros(at.size, np.int64)
    while at.size:
        select, take = np.zeros(at.size, np.uint8), np.ones(at.size, np.int64)
        open_, most, seen = np.arange(at.size), bits[at], 1
        for selector in range(len(PACKINGS), 0, -1):
            count, width = PACKINGS[selector - 1]
            start, end = at[open_], ends[open_]
            for k in range(seen, count):
                place = start + k
                most = np.maximum(most, bits[np.where(place < end, place, n)])
            seen = count
            fits = most <= width
            open_, most = open_[fits], most[fits]
            if not open_.size:
                break
            select[open_] = selector
            take[open_] = np.minimum(count, ends[open_] - at[open_])
        found.append((block, at, select, take))
        counts[block] += 1
        at = at + take
        more = at < ends
        block, at, ends = block[more], at[more], ends[more]
    # The words of a block follow each other, step by step.
    first = np.cumsum(counts) - counts
    place = np.concatenate([first[f[0]] + step for step, f in enumerate(found)])
    out = []
    for column in list(zip(*found, strict=True))[1:]:
        joined = np.concatenate(column)
        out.append(np.empty_like(joined))
        out[-1][place] = joined
    return out[0], out[1], out[2]


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) of ids and the first word of each block."""
    ids = np.asarray(ids, np.uint64)
    if not ids.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, chosen, take = _chosen(ids)
    size = np.where(chosen == 0, 2, 1)
    spot = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == selector)
        first = starts[mine]
        if selector == 0:
            words[spot[mine] + 1] = ids[first]
            continue
        count, bits = PACKINGS[selector - 1]
        out, many = np.full(first.size, selector, np.uint64), take[mine]
        for j in range(count if bits else 0):
            some = slice(None) if j < int(many.min()) else np.flatnonzero(j < many)
            out[some] |= ids[first[some] + j] << np.uint64(4 + j * bits)
        words[spot[mine]] = out
    return words, spot[np.searchsorted(starts, np.arange(0, ids.size, BLOCK))]


def unpack_ids(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The n ids of words; blocks are the first words of each block."""
    ids = np.zeros(n, np.uint64)
    if not n:
        return ids
    ends, to = np.r_[blocks[1:], words.size], np.arange(blocks.size) * BLOCK
    until = np.minimum(to + BLOCK, n)
    counts = np.array([1, *(c for c, _ in PACKINGS)])
    at = blocks.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    while at.size:
        selector = (words[at] & np.uint64(15)).astype(np.int64)
        size = np.minimum(counts[selector], until - to)
        found.append((at, to, selector, size))
        at, to = at + 1 + (selector == 0), to + size
        more = at < ends
        at, ends, to, until = at[more], ends[more], to[more], until[more]
    at, to, selector, size = (np.concatenate(x) for x in zip(*found, strict=True))
    for s in np.unique(selector):
        mine = selector == s
        word, where, many = words[at[mine]], to[mine], size[mine]
        if s == 0:
            ids[where] = words[at[mine] + 1]
            continue
        count, bits = PACKINGS[s - 1]
        full = int(many.min(initial=count))
        for j in range(count if bits else 0):
            some = slice(None) if j < full else np.flatnonzero(j < many)
            ids[where[some] + j] = word[some] >> np.uint64(4 + j * bits) & np.uint64((1 << bits) - 1)
    return ids


def segment_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, blocks = pack_ids(ids)
    head = np.array([len(doc_ids), ids.size, blocks.size, words.size], np.int64)
    named = np.array([x is not None for x in doc_ids], bool)
    names, numbers = np.array([x or 0 for x in doc_ids], np.int64), np.where(named, sizes, ~sizes)
    return MAGIC + b"".join(x.tobytes() for x in (head, names, numbers.astype(np.int64), blocks.astype(np.int64), words))


def read_segments(data: memoryview) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Document ids, their numbers of ids, and all ids of each segment of a file."""
    start = 0
    while start < len(data):
        if bytes(data[start : start + 8]) != MAGIC:
            raise ValueError("not a file of token ids")
        docs, n, blocks, words = np.frombuffer(data[start + 8 : start + 40], np.int64).tolist()
        at = start + 40 + 8 * np.cumsum([0, docs, docs, blocks, words])
        names, sizes, first, packed = (np.frombuffer(data[a:b], kind) for a, b, kind in zip(at[:-1], at[1:], (np.int64, np.int64, np.int64, np.uint64), strict=True))
        yield pa.array(names, mask=sizes < 0), np.where(sizes < 0, ~sizes, sizes), unpack_ids(packed, first, n)
        start = int(at[-1])


class Encoder:
    """Ids of texts as bytes of little-endian uint32, by the tokenizers library."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("A") == "a"
        self.apart = self._ids("a b") == self._ids("a") + self._ids("b")
        self.known: dict[bytes, bytes] = {}
        #: How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(others) for b in range(256)}
        trial = [w.encode() for w in ("the", "éàß", "straße", "я")]
        self.direct = self.apart and self.lower and all(np.array(self._ids(w.decode()), "<u4").tobytes() == x for w, x in zip(trial, self._words(trial), strict=True))

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _is_word(self, word: bytes) -> bool:
        """Letters only, already in the form that the library's normalizer leaves: one word to its pre-tokenizer."""
        if word.isalpha():  # of ASCII
            return word.islower()
        text = word.decode()
        return text.isalpha() and unicodedata.is_normalized("NFC", text) and text.lower() == text

    def _words(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of words that the pre-tokenizer leaves whole, from the library's model."""
        tokenize = self.library.model.tokenize
        for w in words:
            found = tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(self.letters))
            yield array.array("I", [t.id for t in found]).tobytes()

    def learn(self, parts: set[bytes]) -> None:
        """Put new parts into the table."""
        known, rest, tailed = self.known, [], []
        words: set[bytes] = set()
        for part in parts:
            # A full stop or comma after a letter of ASCII is a part of its own in a word-level pre-tokenizer.
            tail = part[-1:] in (b".", b",") and part[-2:-1].isalpha()
            word = part[:-1] if tail else part
            if self.direct and self._is_word(word):
                if word not in known:
                    words.add(word)
                if tail:
                    tailed.append(part)
            else:
                rest.append(part)
        new = list(words)
        known.update(zip(new, self._words(new), strict=True))
        if tailed:
            marks = {t: np.array(self._ids(t.decode()), "<u4").tobytes() for t in (b".", b",")}
            for part in tailed:
                known[part] = known[part[:-1]] + marks[part[-1:]]
        for part, e in zip(rest, self.library.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False), strict=True):
            known[part] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts in UTF-8."""
        if not self.apart:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        split = []
        for data in texts:
            # Special tokens are found in the text as it is, so a text that may hold one keeps its capitals.
            split.append((data.lower() if self.lower and b"<|" not in data else data).split())
        known, before = self.known, len(self.known)
        if new := set().union(*split).difference(known):
            self.learn(new)
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        if len(known) > REMEMBERED:  # what came last goes
            for part in list(itertools.islice(known, max(before, REMEMBERED), None)):
                del known[part]
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, segment_ids: int = SEGMENT_IDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all texts below folder, with a table of its files; returns (path, start, docs, ids) of each file."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        file: NewFile | None = None
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        docs_of_file = ids_of_file = size = 0

        def segment() -> None:
            nonlocal file, docs_of_file, ids_of_file, size
            if file is None:
                file = NewFile(f"{folder}/ids-{part:06d}-{number:04d}.s8b")
            every = np.frombuffer(b"".join(ids), "<u4")
            file.write(segment_bytes(doc_ids, np.array([len(x) // 4 for x in ids]), every))
            docs_of_file, ids_of_file, size = docs_of_file + len(ids), ids_of_file + int(every.size), 0
            ids.clear()
            doc_ids.clear()

        def closed() -> pa.RecordBatch:
            nonlocal file, number, docs_of_file, ids_of_file
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [file.close()], "docs": [docs_of_file], "ids": [ids_of_file]})
            file, number, docs_of_file, ids_of_file = None, number + 1, 0, 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                found = model.encode(some.column(1).cast(pa.binary()).to_pylist())
                ids += [x + end for x in found]
                doc_ids += some.column(0).to_pylist()
                size += sum(map(len, found)) // 4
                if size >= segment_ids:
                    segment()
                    if file.size >= file_bytes:
                        yield closed()
        if ids:
            segment()
        if file is not None:
            yield closed()

    ordered = docs.repartitionByRange(part_count(spark), "id").sortWithinPartitions("id", "text")
    files = saved(ordered.mapInArrow(written, "part long, number long, path string, docs long, ids long"), f"{folder}/files")
    # One row for each part goes through the window over all.
    before = files.groupBy("part").agg(F.sum("ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("number")) - F.col("ids")
    return files.withColumn("inside", inside).join(before, "part").select("path", (F.col("before") + F.col("inside")).alias("start"), "docs", "ids")


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the documents in files, as write returns them."""

    def unpacked(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for doc_ids, sizes, ids in read_segments(get_file(path)):
                    ends = np.cumsum(sizes)
                    data = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                    columns = [doc_ids, pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), pa.array(ids.astype(np.int64))))
                    for at in range(0, len(doc_ids), 10_000):
                        yield pa.RecordBatch.from_arrays([c.slice(at, 10_000) for c in columns], names)
                    start += int(ids.size)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    parts = max(1, min(files.count(), 4 * part_count(files.sparkSession)))
    return files.select("path", "start").repartition(parts).mapInArrow(unpacked, schema)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Encode documents to files and read every document's place, number of ids and checksum back from them."""
    return read(write(docs, tokenizer, workspace(docs.sparkSession, "token-ids"), **options))
