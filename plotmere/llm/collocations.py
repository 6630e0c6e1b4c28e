"""Phrase collocation mining: which words of a language stand together more often than their parts would.

Texts, A-Z lower-cased, are split into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs.
Equal pieces of a language are one row with a multiplicity. Phrases are then counted by length. For each length, tasks
hash the phrases of their pieces, add up equal ones, and deal the numbers out by hash; a bucket's sums are made by
duckdb, which sorts out of core, and the hashes that reach the least frequency go to the shared folder as sorted arrays.
A phrase is hashed only where the two phrases one word shorter, its first and its last words, reached it, and beyond
pairs only runs of frequent pairs are read at all. Where a hash is frequent, the phrase itself is counted, by its words:
the hashes choose, they don't count. So every phrase that reaches the least frequency, as its parts then do, has its
exact frequency, and no other phrase is shuffled by its words.

Parts of a candidate meet their frequencies by requests that are dealt by part; one-word parts, which many phrases share,
are salted. Sums that may pass 64 bits are decimals.

A null text is empty; a null language is "und" (and joins a language of that name). Other columns aren't read. Repeated
rows count as often as they stand. An empty table, or one without candidates, gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotmere.llm.shared import Alphabet, Words, get_file, grams, mix, part_count, put_file, saved, slices, words, workspace

#: Words of a phrase; its least frequency; phrases that a language lists.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A phrase goes where a longer one that holds it has so many hundredths of its frequency.
HELD = 100
#: Bytes of pieces that are counted together.
TEXT = 16 << 20
#: Hashes of a file; numbers that a bucket holds on average; memory of duckdb in a bucket.
FILE, BUCKET, MEMORY = 1 << 23, 4_000_000, "256MB"
#: Stands between the runs of a piece: a word that no piece has, so no pair with it is frequent.
BREAK = " \n "
#: Rows that a frequent one-word part is spread over.
SALTS = 16


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, many): distinct pieces, their words with one space between, and how often they stand."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", "abcdefghijklmnopqrstuvwxyz" + "\n" * 9 + " ")
    split = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lower, "\n")).alias("piece"))
    plain = F.trim(F.when(F.col("piece").contains("  "), F.regexp_replace("piece", " +", " ")).otherwise(F.col("piece")))
    return split.select("lang", plain.alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("many"))


# ---------------------------------------------------------------- hashes of phrases in a task


def _spaced() -> Alphabet:
    inside = np.ones(256, bool)
    inside[32] = False
    return Alphabet(inside, np.arange(256, dtype=np.uint8))


class Part(NamedTuple):
    """Pieces of a task: their words, the number of each word's language and its piece's multiplicity."""

    data: np.ndarray
    words: Words
    langs: list[str]
    lang: np.ndarray
    many: np.ndarray

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of n words begin (numbers of words), and their hashes."""
        w = self.words
        if w.hash.size < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(w.row[: w.row.size - n + 1] == w.row[n - 1 :])
        seed = np.array([_hashed(x) for x in self.langs], np.uint64)
        return at, mix(grams(w.hash, n)[at] + seed[self.lang[at]] + np.uint64(n))


def _hashed(lang: str) -> int:
    data = np.frombuffer(lang.encode() or b" ", np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        return int(mix(np.array([functools.reduce(lambda h, x: (h * 0x100000001B3 ^ int(x)) % (1 << 64), data.tolist(), 0xCBF29CE484222325)], np.uint64))[0])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """From (lang, many, piece) rows."""
    letters, held, size = _spaced(), [], 0

    def made(held):
        table = pa.Table.from_batches(held).combine_chunks()
        langs = table.column(0).chunk(0).dictionary_encode()
        for piece in slices(table.column(2).chunk(0), TEXT):
            w = words(piece, letters)
            row = w.row + piece.first
            yield Part(piece.data, w, langs.dictionary.to_pylist(), langs.indices.to_numpy()[row], table.column(1).to_numpy()[row])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= TEXT:
            yield from made(held)
            held, size = [], 0
    if held:
        yield from made(held)


def _summed(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, weights = hashes[order], weights[order]
    edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if hashes.size else np.zeros(0, np.int64)
    return hashes[edges], np.add.reduceat(weights, edges) if edges.size else weights


# ---------------------------------------------------------------- frequent hashes


class Frequent(NamedTuple):
    """Sorted files of the hashes of phrases of n words that reach the least frequency: each file's first hash and name."""

    n: int
    files: list[tuple[int, str]]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each is frequent: distinct ones are looked up file after file."""
        asked, back = np.unique(hashes, return_inverse=True)
        found = np.zeros(asked.size, bool)
        cuts = [0, *np.searchsorted(asked, np.array([f for f, _ in self.files[1:]], np.uint64)).tolist(), asked.size]
        for (_, name), a, b in zip(self.files, cuts[:-1], cuts[1:], strict=True) if self.files else ():
            if a < b:
                known = _mapped(name)
                found[a:b] = known[np.minimum(np.searchsorted(known, asked[a:b]), known.size - 1)] == asked[a:b]
        return found[back]


@functools.lru_cache(maxsize=64)
def _mapped(name: str) -> np.ndarray:
    return np.frombuffer(get_file(name), np.uint64)


def _bucketed(least: int, folder: str):
    """Sums of (hash, many) rows by duckdb, out of core; those of least or more."""

    def sums(batches):
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY}) as con:
            if "://" not in folder or folder.startswith("file:"):  # spills go to the shared folder
                con.execute(f"SET temp_directory = '{folder.removeprefix('file://').removeprefix('file:')}/spill-{TaskContext.get().taskAttemptId()}'")
            con.execute("CREATE TABLE t (hash BIGINT, many HUGEINT)")
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                con.execute("INSERT INTO t SELECT hash, sum(many) FROM batch GROUP BY hash")
                con.unregister("batch")
            found = con.sql(f"SELECT hash FROM t GROUP BY hash HAVING sum(many) >= {least}").to_arrow_table()
        yield from found.to_batches(max_chunksize=50_000)

    return sums


def frequent(held: DataFrame, n: int, shorter: Frequent | None, least: int, folder: str) -> Frequent:
    """Hashes of phrases of n words in (lang, many, piece) rows that reach the least frequency."""
    spark = held.sparkSession

    def counted(batches):
        for part in _parts(batches):
            at, hashes = part.hashes(n)
            if shorter is not None:
                at, hashes = _where(part, at, hashes, shorter)
            hashes, many = _summed(hashes, part.many[at])
            for a in range(0, hashes.size, 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[a : a + 50_000].view(np.int64)), pa.array(many[a : a + 50_000])], ["hash", "many"])

    def written(batches):
        found = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]).view(np.uint64)
        if found.size:
            found = np.sort(found)
            name = f"{folder}/frequent{n}/{int(found[0]):020d}"
            put_file(name, found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([str(int(found[0]))]), pa.array([name])], ["first", "name"])

    counts = held.mapInArrow(counted, "hash long, many long")
    sums = counts.repartition(buckets(spark, held), "hash").mapInArrow(_bucketed(least, folder), "hash long")
    sums = saved(sums, f"{folder}/hashes{n}")
    unsigned = F.conv(F.hex("hash"), 16, 10).cast("decimal(20,0)")  # files follow each other in unsigned order
    files = sums.withColumn("at", unsigned).repartitionByRange(sums.count() // FILE + 1, "at").select("hash").mapInArrow(written, "first string, name string")
    return Frequent(n, sorted((int(r.first), r.name) for r in files.collect()))  # a row for FILE hashes


def _where(part: Part, at: np.ndarray, hashes: np.ndarray, shorter: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """The phrases whose first words and last words, one fewer, are frequent."""
    before, keys = part.hashes(shorter.n)
    ok = np.zeros(part.words.hash.size + 1, bool)
    ok[before] = shorter.has(keys)
    which = ok[at] & ok[at + 1]
    return at[which], hashes[which]


def buckets(spark: SparkSession, held: DataFrame) -> int:
    """For about four numbers a row of held."""
    return max(part_count(spark), held.count() * 4 // BUCKET)


# ---------------------------------------------------------------- frequencies


def _text(part: Part, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words first to last, of each pair, as they stand in their piece."""
    start, size = part.words.start[first], part.words.end[last] - part.words.start[first]
    total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = part.data[np.repeat(start - total[:-1], size) + np.arange(int(total[-1]))]
    return pa.Array.from_buffers(pa.large_utf8(), size.size, [None, pa.py_buffer(total), pa.py_buffer(data)])


def phrases(held: DataFrame, known: list[Frequent], runs: bool) -> DataFrame:
    """(words int, lang, phrase, many): frequent phrases, a row for each that a task has. With runs, one row with words 0 for what of a piece longer phrases may stand in:
    its runs of two or more frequent pairs, with BREAK between."""

    def found(batches):
        for part in _parts(batches):
            for kind in known:
                at, hashes = part.hashes(kind.n)
                ok = kind.has(hashes)
                at, hashes = at[ok], hashes[ok]
                order = np.argsort(hashes, kind="stable")
                at, hashes = at[order], hashes[order]
                edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if hashes.size else np.zeros(0, np.int64)
                many = np.add.reduceat(part.many[at], edges) if edges.size else np.zeros(0, np.int64)
                yield from rows(part, kind.n, at[edges], at[edges] + kind.n - 1, many)
                if runs and kind.n == 2:
                    w, joined = part.words, np.zeros(part.words.hash.size + 1, bool)
                    joined[at] = True  # word i stands in a frequent pair with word i+1
                    begins = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]]))
                    ends = np.flatnonzero(joined & ~np.concatenate([joined[1:], [False]])) + 1  # its last word
                    long = ends - begins >= 2
                    if w.hash.size:
                        yield from whole(part, begins[long], ends[long])

    def rows(part, n, first, last, many):
        langs = pa.array(part.langs)
        for a in range(0, first.size, 20_000):
            x, y = first[a : a + 20_000], last[a : a + 20_000]
            columns = [np.full(x.size, n, np.int32), langs.take(pa.array(part.lang[x])), _text(part, x, y).cast(pa.string()), many[a : a + 20_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["words", "lang", "phrase", "many"])

    def whole(part, first, last):
        row = part.words.row[first]
        edges = np.append(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), row.size) if row.size else np.zeros(1, np.int64)
        for a in range(0, edges.size - 1, 20_000):
            cuts = edges[a : a + 20_001]
            runs = _text(part, first[cuts[0] : cuts[-1]], last[cuts[0] : cuts[-1]]).cast(pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), runs), BREAK)
            x = first[cuts[:-1]]
            columns = [np.zeros(x.size, np.int32), pa.array(part.langs).take(pa.array(part.lang[x])), joined, part.many[x]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["words", "lang", "phrase", "many"])

    return held.mapInArrow(found, "words int, lang string, phrase string, many long")


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words int, f decimal) of all phrases to the longest that stand least times or more; (lang, n decimal) of all words."""
    folder = folder or workspace(docs.sparkSession, "collocations")
    all_pieces = saved(pieces(docs).select("lang", "many", "piece"), f"{folder}/pieces")
    n = all_pieces.groupBy("lang").agg(F.sum((F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).cast("decimal(20,0)") * F.col("many")).cast("decimal(38,0)").alias("n"))
    one = frequent(all_pieces, 1, None, least, folder)
    two = frequent(all_pieces, 2, one, least, folder)
    short = saved(phrases(all_pieces, [one, two], True), f"{folder}/short")
    held = saved(short.filter("words = 0").groupBy("lang", F.col("phrase").alias("piece")).agg(F.sum("many").alias("many")).select("lang", "many", "piece"), f"{folder}/runs")
    known = [two]
    for words_ in range(3, longest + 1):
        known.append(frequent(held, words_, known[-1], least, folder))
    found = short.filter("words > 0").union(phrases(held, known[1:], False))
    sums = found.groupBy("lang", "phrase", "words").agg(F.sum(F.col("many").cast("decimal(20,0)")).cast("decimal(20,0)").alias("f")).filter(F.col("f") >= least)
    return saved(sums, f"{folder}/frequencies"), n


# ---------------------------------------------------------------- scores


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, held: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), numbers long: each language's phrases with the highest scores.

    Candidates are phrases of 2 to longest words that stand a >= least times. Cut after some words, a candidate has a
    first part that stands l times and a rest that stands r times; of its cuts the one with the least
    floor(1000 * a * n / (l * r)) counts, the first of equal ones. Candidates that lie in a longer one of held
    hundredths of their frequency go. Order: score, a descending, phrase by bytes.
    """
    folder = workspace(docs.sparkSession, "collocations")
    known, n = frequencies(docs, longest, least, folder)
    candidates = known.filter("words > 1").withColumn("w", F.split("phrase", " "))
    spread = F.when(F.col("n_part") == 1, F.pmod(F.hash("phrase"), F.lit(SALTS))).otherwise(0)
    joined = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("k").alias("n_part"), joined(1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), (F.col("words") - F.col("k")).alias("n_part"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("part"))))
    asked = cuts.select("lang", "phrase", "words", "a", "k", sides.alias("s")).select("lang", "phrase", "words", "a", "k", "s.*").withColumn("salt", spread)
    answers = known.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    both = asked.join(answers, ["lang", "part", "salt"]).groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast((cast(1000 as decimal(4,0)) * a * cast(n as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    scored = both.join(n, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))))
    longer = candidates.filter("words > 2").select("lang", inside.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < held * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    whole = lambda c: F.col(c).cast("long").alias(c.rpartition(".")[2])
    ranked = left.select("lang", "phrase", "a", "n", F.col("b.score").alias("score"), F.col("b.l").alias("l"), F.col("b.r").alias("r")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", whole("rank"), "phrase", *(whole(c) for c in ("a", "l", "r", "n", "score")))
