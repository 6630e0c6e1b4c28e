"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols (its characters, spaces as U+2581 with one put before the text). An agenda holds the adjacent
symbol pairs whose concatenation is a piece, by score, the leftmost first on ties; the best is merged until none is
left. Symbols that are no piece fall back to their UTF-8 bytes.

Merges never cross a place where no piece continues, so a text is first cut there (before U+2581 that follows anything
else, at line feeds, between a letter or digit and a full stop or comma, each only if the vocabulary allows it) and
the parts are encoded on their own. Parts seen before come from a bounded table; the new parts of an Arrow batch work
off their agendas side by side in numpy, long ones from a heap. Every new part is then encoded by the sentencepiece
library as well, and a difference stops the job.

Only vocabularies without text normalisation are taken (a leading space added, white space kept); others are refused.

Edge cases: a null or empty text has no ids and decodes to "". Literal U+2581 in a text counts as a space, as in the
library. Very long parts (no space at all) take the heap, so work stays near linear. Rows are independent of each other.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Parts that a worker remembers (about 300 bytes each), and characters of text that are encoded together.
REMEMBERED, TOGETHER = 250_000, 2_000_000
#: Parts of more symbols than this work off their agenda from a heap.
LONG = 48

_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces, merges and byte fallbacks of a sentencepiece model file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        kinds = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        ids = {p: i for i, (p, special) in enumerate(zip(names, kinds, strict=True)) if not special}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.bytes) != 256 or lib.encode("ﬁ  x ", out_type=str)[-1] != SPACE or lib.normalize("ﬁ x") != f"{SPACE}ﬁ{SPACE}x":
            raise ValueError("only vocabularies with byte fallback and without normalisation are supported")
        self.size = n
        #: Symbols: pieces, then characters that only occur inside pieces.
        self.symbol = dict(ids)
        for p in ids:
            for c in p:
                self.symbol.setdefault(c, n + len(self.symbol))
        merges = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    merges[a, b] = i
        self.merges = merges
        order = sorted((i for i in ids.values()), key=lambda i: (-lib.get_score(i), i))
        rank = np.full(n, _NONE, np.int32)
        place, last = -1, None
        for i in order:  # pieces of equal score are equally good: the leftmost pair goes first
            if (s := lib.get_score(i)) != last:
                place, last = place + 1, s
            rank[i] = place
        self.rank = rank
        self.base = 2 * (n + len(self.symbol)) + 2
        keys = np.fromiter((a * self.base + b for a, b in merges), np.int64, len(merges))
        at = np.argsort(keys)
        self.keys, self.made = keys[at], np.fromiter(merges.values(), np.int32, len(merges))[at]
        inner = [p for p in ids if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in inner):
            raise ValueError("pieces go on after a space: parts can't be encoded on their own")
        feed = "" if any("\n" in p for p in inner) else "\n"
        stuck = "".join(sorted({c for p in inner for c in re.findall(r"([^\W_])[.,]", p)}))
        before = rf"{SPACE}*[^\W_{re.escape(stuck)}]++(?=[.,])|"
        self.parts = re.compile(rf"{before}{SPACE}*[^{SPACE}{feed}]+|{SPACE}+" + ("|\n" if feed else ""))
        self.known: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(n)]
        self.lead = len(lib.encode("\n"))

    # -------------------------------------------------- encoding

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        keys = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.made[at], -1)

    def side_by_side(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when every part's agenda is empty, and each part's number of them; a round merges each part's best pair."""
        flat = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        codes, back = np.unique(np.frombuffer(flat.encode("utf-32-le"), np.uint32), return_inverse=True)
        table = np.fromiter((self.symbol.get(chr(c), -2 - int(c)) for c in codes), np.int64, codes.size)
        symbols, owner = table[back], np.repeat(np.arange(len(parts)), sizes)
        done_symbols, done_owner = [], []

        def ranked(a, b, same):
            made = self.look_up(a, b)
            made[~same] = -1
            return made, np.where(made >= 0, self.rank[made], _NONE)

        last = np.r_[owner[1:] != owner[:-1], True]
        made, rank = ranked(symbols, np.r_[symbols[1:], -1], ~last)
        while symbols.size:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, symbols.size])
            active = np.repeat(best < _NONE, sizes)
            if not active.all():
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                symbols, owner, made, rank, last = (x[active] for x in (symbols, owner, made, rank, last))
                keep = best < _NONE
                best, sizes = best[keep], sizes[keep]
                if not symbols.size:
                    break
            row = np.repeat(np.arange(sizes.size), sizes)
            at = np.flatnonzero(rank == best[row])
            at = at[np.r_[True, row[at[1:]] != row[at[:-1]]]]
            symbols[at] = made[at]
            last[at] |= last[at + 1]
            keep = np.ones(symbols.size, bool)
            keep[at + 1] = False
            moved = at - np.arange(at.size)  # each merge before it took one place away
            symbols, owner, made, rank, last = (x[keep] for x in (symbols, owner, made, rank, last))
            follow = np.r_[symbols[1:], -1]
            made[moved], rank[moved] = ranked(symbols[moved], follow[moved], ~last[moved])
            prior = moved[(moved > 0)] - 1
            prior = prior[~last[prior]]
            made[prior], rank[prior] = ranked(symbols[prior], follow[prior], np.ones(prior.size, bool))
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(parts))

    def from_heap(self, part: str) -> list[int]:
        """The same for one part of any length."""
        symbols = [self.symbol.get(c, -2 - ord(c)) for c in part]
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i, j):
            made = self.merges.get((symbols[i], symbols[j]))
            if made is not None:
                heapq.heappush(agenda, (int(self.rank[made]), i, symbols[i], symbols[j], made))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while agenda:
            _, i, a, b, made = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = made, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def fallen_back(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids: symbols that are no piece become their bytes."""
        other = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not other.size:
            return symbols, sizes
        characters = {i: c for c, i in self.symbol.items() if i >= self.size}
        owner, spelt = np.repeat(np.arange(sizes.size), sizes), np.ones(symbols.size, np.int64)
        text = [(chr(-2 - x) if x < 0 else characters[x]).encode() for x in symbols[other].tolist()]
        spelt[other] = [len(t) for t in text]
        ids = np.repeat(symbols, spelt)
        ids[np.repeat(np.isin(np.arange(symbols.size), other), spelt)] = [self.bytes[b] for t in text for b in t]
        return ids, np.bincount(np.repeat(owner, spelt), minlength=sizes.size)

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Encode new parts, hold them against the library, remember them while there is room."""
        parts = sorted(parts, key=len)  # those for the heap come last
        short = next((i for i, p in enumerate(parts) if len(p) > LONG), len(parts))
        ids, sizes = self.side_by_side(parts[:short]) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        heaped = [self.from_heap(p) for p in parts[short:]]
        ids, sizes = self.fallen_back(np.r_[ids, np.fromiter((x for h in heaped for x in h), np.int64)], np.r_[sizes, np.fromiter(map(len, heaped), np.int64, len(heaped))])
        flat, lead, at = ids.tolist(), self.lead, 0
        names, out = self.decimal, {}
        for p, n, theirs in zip(parts, sizes.tolist(), self.library.encode(["\n" + p for p in parts], num_threads=1), strict=True):
            ours = flat[at : at + n]
            at += n
            if ours != theirs[lead:]:
                raise AssertionError(f"{p!r} is {ours} here and {theirs[lead:]} in the library")
            out[p] = ",".join([names[i] for i in ours]).encode()
        if (room := REMEMBERED - len(self.known)) > 0:
            self.known.update(out if len(out) <= room else dict(list(out.items())[:room]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, decimal and joined by commas."""
        split = [self.parts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        new = [p for p in set().union(*split) if p not in known]
        learnt = self.learn(new) if new else {}
        have = known.get
        return [b",".join([have(p) or learnt[p] for p in parts]) for parts in split]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def numbers(joined: bytes) -> np.ndarray:
    """Ids from their decimal form."""
    return np.fromstring(joined.decode(), np.int32, sep=",")


def encode(docs: DataFrame, path: str, text_col: str = "text", checked: bool = False) -> DataFrame:
    """docs with ids (array<int>) of each text; checked: and decoded_again, whether ids decode to the text (null: "").

    Columns of these names are replaced.
    """
    docs = docs.drop("ids", "decoded_again") if checked else docs.drop("ids")
    names, place = docs.columns, docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in _grouped(texts):
                found = [numbers(x) for x in model.encode(texts[a:b])]
                ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(np.concatenate(found)))
                columns, more = [*batch.slice(a, b - a).columns, ids], [*names, "ids"]
                if checked:
                    columns.append(pa.array([model.library.decode(x.tolist()) == t if x.size else not t for x, t in zip(found, texts[a:b], strict=True)], pa.bool_()))
                    more.append("decoded_again")
                yield pa.RecordBatch.from_arrays(columns, more)

    return docs.mapInArrow(encoded, f"{schema}, ids array<int>" + (", decoded_again boolean" if checked else ""))


def decode(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """docs with decoded, the text that ids stand for; a column of that name is replaced. Null ids decode to ""."""
    docs = docs.drop("decoded")
    names, place = docs.columns, docs.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def decoded(batches):
        model = vocabulary(path)
        for batch in batches:
            texts = model.library.decode([x or [] for x in batch.column(place).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return docs.mapInArrow(decoded, f"{schema}, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again in one pass."""
    docs = docs.select(id_col, F.col(text_col).cast("string").alias("text"))

    def digested(batches):
        model = vocabulary(path)
        sha = hashlib.sha256
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _grouped(texts):
                joined = model.encode(texts[a:b])
                back = [model.library.decode(numbers(x).tolist()) if x else "" for x in joined]
                counts = [x.count(b",") + 1 if x else 0 for x in joined]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array([sha(x).hexdigest() for x in joined]), pa.array([sha(t.encode()).hexdigest() for t in back])], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(digested, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
