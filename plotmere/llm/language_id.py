"""Language identification by compression.

Each language has a dictionary: raw text of training documents, given to zstandard as content to refer back to. A text
is cut into its first ``HEAD`` bytes, which stand four times over after blanks (zstandard stores tiny inputs as they are;
so it refers back), and blocks of the rest, whatever its length. All of these are compressed with each language's
dictionary, and the language of the fewest bytes in all is the answer. The score is the margin to the second, as a share of the bytes of the best; a
text whose margin is narrow is rejected.

The dictionaries come from a bounded sample of labelled documents (about ``per_language`` for each language, chosen by
a hash of the id; each id gives one piece of at most ``piece`` bytes, at a place that follows from the hash), so they are
small and broadcast. All of the sample is used. Where there are more than ``LANGUAGES`` labels they are learnt and tried in
tiers of so many, one after the other, so that one tier's dictionaries are held at once. Every text is compressed whole.

Edge cases: a null text, or one without a letter, is "und" with score 0 and is rejected. Ties go to the language that
sorts first. Without a labelled row every text is "und". With one language it is the answer, with score 1. Null labels
are not learnt; an empty one is a label like others. Added columns replace columns of the same names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.llm.shared import held_out, saved, workspace

#: Bytes of a block, training documents for each language, and bytes of a document in a dictionary.
BLOCK, PER_LANGUAGE, PIECE = 4096, 48, 1000
#: Bytes of a text's beginning that are compressed four times over.
HEAD = 256
#: Languages whose dictionaries are held at once.
LANGUAGES = 400
#: Below this score a text is rejected.
MARGIN = 0.01
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_SPAN = 1 << 40


#: Matches of three bytes and more, the cheapest of them by cost: texts are short beside the dictionaries.
_SETTINGS = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, min_match=3, search_log=3, hash_log=16, chain_log=16, window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0)
_TO_SPACE = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str) -> bytes:
    """What is compressed: the text in lower case, runs of other ASCII characters than letters as one space."""
    return b" ".join(text.lower().encode().translate(_TO_SPACE).split())


def _cut(text: str, hashed: int, piece: int) -> bytes:
    data = letters(text)
    start = hashed % max(len(data) - piece + 1, 1)
    return data[start : start + piece]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, piece: int = PIECE) -> dict[str, bytes]:
    """Dictionaries by language from a bounded sample of labelled rows, of up to LANGUAGES languages (tiers has the form for more)."""
    found = list(tiers(labelled, text_col, lang_col, id_col, per_language, piece))
    if len(found) > 1:
        raise ValueError(f"more than {LANGUAGES} languages: classify takes tiers()")
    return found[0] if found else {}


def tiers(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, piece: int = PIECE) -> Iterator[dict[str, bytes]]:
    """Dictionaries by language, LANGUAGES of them at a time, in the order of the languages' names."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id"))
    rows = rows.filter("lang is not null and text is not null and text <> ''")
    every = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    hashed = F.pmod(F.xxhash64("id"), F.lit(_SPAN))

    # A long text would weigh on the driver: the piece is cut where the row is.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_cut(t.as_py(), h, piece) for t, h in zip(batch.column(2), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], ["lang", "h", "data"])

    last = None
    while True:
        counts = {r.lang: r.n for r in (every if last is None else every.filter(F.col("lang") > last)).orderBy("lang").limit(LANGUAGES).collect()}
        if not counts:
            return
        below = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, per_language / n) * _SPAN))))
        chosen = rows.select("lang", "text", hashed.alias("h")).filter(F.col("h") < F.try_element_at(below, F.col("lang")))
        one = chosen.select("lang", "h", "text").mapInArrow(cut, "lang string, h long, data binary").groupBy("lang", "h").agg(F.min("data").alias("data"))
        pieces: dict[str, list] = {}
        for r in one.collect():  # about per_language for each of the tier's languages
            pieces.setdefault(r.lang, []).append((r.h, bytes(r.data)))
        yield {lang: b"\n".join(d for _, d in sorted(found)) for lang, found in sorted(pieces.items())}
        if len(counts) < LANGUAGES:
            return
        last = max(counts, key=lambda lang: lang.encode())


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK):
        self.names, self.block, self.by_language = list(dictionaries), block, []
        for data in dictionaries.values():
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=_SETTINGS)
            self.by_language.append(zstandard.ZstdCompressor(dict_data=content, compression_params=_SETTINGS))

    def sizes(self, text: str) -> list[int]:
        data = letters(text)
        blocks = [b" " * 64 + b" ".join([data[:HEAD]] * 4), *(data[i : i + self.block] for i in range(HEAD, len(data), self.block))]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by_language]

    def best(self, text: str | None, before: tuple[str | None, int | None, int | None] = (None, None, None)) -> tuple[str | None, int | None, int | None]:
        """The language of the fewest bytes, its bytes and the second's, of these languages and those before."""
        if not text or not _LETTER.search(text):
            return None, None, None
        name, least, second = before
        for other, size in zip(self.names, self.sizes(text) if self.names else [], strict=True):
            if least is None or size < least:
                name, least, second = other, size, least
            elif second is None or size < second:
                second = size
        return name, least, second


def classify(docs: DataFrame, dictionaries: dict[str, bytes] | Iterable[dict[str, bytes]], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected (no letter, or a score below margin).

    dictionaries are those of train, or tiers of them; between tiers the best so far is written with the rows.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    names, place, spark = docs.columns, docs.columns.index(text_col), docs.sparkSession
    state = ["__lang", "__least", "__second"]
    kinds = "__lang string, __least long, __second long"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def tried(spread: Broadcast, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches):
            model = Compressors(spread.value)
            for batch in batches:
                texts = (t.as_py() for t in batch.column(place))
                before = itertools.repeat((None, None, None)) if first else zip(*(c.to_pylist() for c in batch.columns[len(names) :]), strict=True)
                found = [model.best(t, b) for t, b in zip(texts, before, strict=False)]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, *state])

        return run

    rows, folder = None, None
    for number, tier in enumerate([dictionaries] if isinstance(dictionaries, dict) else dictionaries):
        if rows is not None:
            folder = folder or workspace(spark, "languages")
            rows = saved(rows, f"{folder}/{number}")
        rows = (docs if rows is None else rows).mapInArrow(tried(spark.sparkContext.broadcast(tier), rows is None), f"{schema}, {kinds}")
    if rows is None:
        rows = docs.select("*", *(F.lit(None).cast(k).alias(c) for c, k in zip(state, ("string", "long", "long"), strict=True)))
    least, second = F.col("__least"), F.col("__second")
    score = F.when(least.isNull(), 0.0).when(second.isNull(), 1.0).otherwise(F.least(F.lit(1.0), (second - least) / least))
    told = rows.select(*(F.col(f"`{n}`") for n in names), F.coalesce("__lang", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), least.isNull().alias("__none"))
    return told.select(*(F.col(f"`{n}`") for n in names), "lang_pred", "score", (F.col("__none") | (F.col("score") < margin)).alias("rejected"))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 5 is not 0 and predict every row of documents."""
    docs = docs.select("doc_id", "text", "lang", F.coalesce(held_out("doc_id", 0), F.lit(False)).alias("held_out"))
    learnt = tiers(docs.filter(~F.col("held_out")))
    return classify(docs.select("doc_id", "held_out", "text"), learnt).select("doc_id", "held_out", "lang_pred", "score", "rejected")
