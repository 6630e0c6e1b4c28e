"""Source divergence, collocations and chat formatting against brute force; long runs, many languages, many files."""

import hashlib
import json
import random
import re
import resource
import subprocess
import sys
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotmere.llm import chat_format, collocations, decontaminate, language_id, shared, source_divergence
from plotmere.llm.queries import ORACLE_SQL, QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = ["alder", "Birch", "cédar", "日本", "elm", "fir-x", "O'Neil", "ginkgo9", "ÉÀ", "a", "z" * 300]


@pytest.fixture(scope="module")
def texts(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names clash with those of the operators."""
    rng = random.Random(12)
    rows = []
    for k in range(120):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s\0x", None, "é"])
        parts = ["".join(rng.choice(WORD) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\u00a0"]) for _ in range(rng.randrange(0, 30)))]
        rows.append((k, rng.choice([None, "", " .;\n "]) if k % 9 == 0 else parts[0] * rng.choice([1, 1, 5]), lang, source))
    rows += [(1000, "Alder birch. " * 20_000, "en", "s1"), (1001, None, "fr", "none"), (1002, "12 34", "xx", "a"), (1003, "12 34", "xx", "b")] + [rows[3]] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("trie", "term", "rank", "salt", "piece", "many", "words", "phrase")})


def as_rows(df):
    return [(r.lang, r.source, r.text) for r in df.collect()]


# ---------------------------------------------------------------- source divergence


def divergence(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        own, q = {s: p(counts[lang, s]) for s in sources}, p(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(own[s][t], q[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (v, t) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(3, 200), (1, 2)])
def test_divergence_is_the_plain_count(texts, least, top, monkeypatch):
    for name, value in (("LEAVES", 40), ("ROW", 16), ("FOLD", 60), ("TEXT", 2000), ("CELLS", 50)):
        monkeypatch.setattr(source_divergence, name, value)
    got = source_divergence.audit(texts, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence(as_rows(texts), least, top)


def test_divergence_of_an_empty_table(texts):
    assert source_divergence.audit(texts.limit(0)).count() == 0


def test_tries_keep_what_they_hold():
    import pyarrow as pa

    rng = random.Random(2)
    whole = []
    for _ in range(3):
        keys = sorted({bytes(rng.choice([97, 98, 200]) for _ in range(rng.randrange(0, 9))) for _ in range(80)} | {b"a" * 500})
        sizes = [rng.randrange(0, 3) for _ in keys]
        n = sum(sizes)
        whole.append(source_divergence.RadixTrie(pa.array(keys, pa.large_binary()), np.arange(len(keys)), np.r_[0, np.cumsum(sizes)], np.array([i % 2 for s in sizes for i in range(s)], np.int64), np.arange(n) + 1, ["x", "y\0\\0"]))
    for trie in whole:
        back = source_divergence.loaded(source_divergence.dumped(trie))
        assert back.keys.to_pylist() == trie.keys.to_pylist() and back.sources == trie.sources
        assert all((a == b).all() for a, b in zip(back[1:5], trie[1:5], strict=True))
    def content(tries):
        out = defaultdict(lambda: [0, Counter()])
        for t in tries:
            for i, k in enumerate(t.keys.to_pylist()):
                out[k][0] += int(t.docs[i])
                for j in range(t.bounds[i], t.bounds[i + 1]):
                    out[k][1][t.sources[t.source[j]]] += int(t.count[j])
        return {k: (n, dict(c)) for k, (n, c) in out.items()}

    merged = source_divergence.merge(whole)
    assert merged.keys.to_pylist() == sorted(merged.keys.to_pylist()) and content([merged]) == content(whole)
    big = source_divergence.smoothed(np.array([0, 5 * 10**13, 8 * 10**14]), np.array([8_999_999_999_999_999]))
    assert big.tolist() == [1 + 10**9 * (c + 1) // 8_999_999_999_999_999 for c in (0, 5 * 10**13, 8 * 10**14)]


# ---------------------------------------------------------------- collocations


def collocate(rows, longest=5, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, _, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, freq in f.items():
        known = {p: a for p, a in freq.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in known.items():
            if any(100 * freq[q] >= 100 * a for q in known if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * a * n[lang] // (freq[p[:k]] * freq[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), freq[p[:k]], freq[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(100, 2000), (3, 2000), (2, 5)])
def test_collocations_are_the_plain_count(texts, least, top):
    got = collocations.mine(texts, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = collocate(as_rows(texts), least=least, top=top)
    assert sorted(map(tuple, got.collect())) == expected and expected


def test_collocations_of_an_empty_table(texts):
    assert collocations.mine(texts.limit(0)).count() == 0


# ---------------------------------------------------------------- chat formatting


def folded(events):
    """Conversations' messages from events (conv, seq, kind, message, role, text), one after the other."""
    convs = defaultdict(list)
    for e in events:
        convs[e[0]].append((e[1], e[2] or "message", e[3] or "", e[4] or "", e[5] or ""))
    out = {}
    for conv, rows in convs.items():
        begins, cuts, removed, log = {}, [], set(), defaultdict(list)
        for seq, kind, message, role, text in rows:
            if kind == "message":
                begins[message] = min(begins.get(message, (seq, role)), (seq, role))
            if kind == "regenerate":
                cuts.append((seq, message))
            if kind == "remove":
                removed.add(message)
            if kind in ("message", "edit", "regenerate", "delta"):
                log[message].append((seq, kind, text))
        left = []
        for message, (at, role) in begins.items():
            if message in removed or any(m in begins and begins[m][0] < at < seq for seq, m in cuts):
                continue
            own = sorted(log[message])
            reset = max(e for e in own if e[1] != "delta")
            text = "".join("" if e[1] == "message" and e > reset else e[2] for e in own if e >= reset)
            left.append((at, message, role, text))
        if left:
            out[conv] = [(role, text) for _, _, role, text in sorted(left)]
    return out


PIECES = ["hi", "</s>", "[INST]", "\\", "\\[/INST]", "<role>", "\n", "é", " ", "<<SYS>>", "&amp;", "&#10;", "[/INST]\n", ""]


def test_logs_are_folded_rendered_and_read_back(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 4)
    monkeypatch.setattr(chat_format, "PART", 3)
    rng = random.Random(31)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 5)))
    events = []
    for conv in (1, 2, 3, None, -7):
        for seq in range(40):
            kind = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate", "remove", None]) if seq else "message"
            kind = "delta" if kind == "remove" and rng.random() < 0.7 else kind
            message = f"m{rng.randrange(max(1, seq))}" if kind not in ("message", None) else f"m{seq}"
            events.append((conv, seq if rng.random() < 0.9 else seq // 2, kind, message, rng.choice(["user", "assistant", "system", "tool\nx</role>", None]), text()))
    events += events[:5]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, message string, role string, text string").withColumn("part", F.lit("clash"))
    messages = chat_format.fold(df)
    got = defaultdict(list)
    for r in sorted(messages.collect(), key=lambda r: r.number):
        got[r.conv_id].append((r.role, r.text))
    expected = folded(events)
    assert dict(got) == expected
    rendered = chat_format.render(messages)
    back = defaultdict(list)
    for r in sorted(rendered.collect(), key=lambda r: r.part):
        turns = list(chat_format.parsed(r.formatted))
        back[r.conv_id] += turns
        assert [chat_format.unescaped(r.formatted[s.start : s.start + s.length]) for s in r.loss] == [t for role, t in turns if role == "assistant"]
    assert dict(back) == expected
    for r in chat_format.digests(rendered).collect():
        turns = expected[r.conv_id]
        trained = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())


def test_conversations_with_odd_rows(spark):
    rows = [(5, 1, "user", "b"), (5, 0, "user", "a"), (5, 1, "user", "b"), (5, 1, "assistant", None), (6, None, None, "x"), (None, 3, "assistant", "</s>" * 3), (None, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.round_trip(df).collect()}
    assert got[5].n_turns == 4 and got[5].turns_sha256 == hashlib.sha256(b"user\na\nassistant\n\nuser\nb\nuser\nb\n").hexdigest()
    assert got[6].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest() and (got[None].n_turns, got[None].loss_chars) == (2, 12)
    planted = got[-7]
    assert (planted.n_turns, planted.loss_chars) == (2, len("</s>[INST] ok [/INST]"))
    assert {r.conv_id for r in chat_format.round_trip(df.limit(0)).collect()} == {-7}


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_collocations", "op13_chat_format"])
def test_queries_match_sql(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = QUERIES[name](spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


# ---------------------------------------------------------------- earlier operators


@pytest.mark.parametrize("most", [decontaminate.MOST, 1])
def test_runs_of_one_word_are_linear(spark, most):
    """100,000 equal words against an item of 500: each window is looked up once."""
    benchmark = spark.createDataFrame([(1, "la " * 500), (2, "la " * 9 + "end"), (3, "la la")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "la " * 100_000), (2, "x " * 50 + "la " * 9 + "x"), (3, "la " * 30 + "end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.mark(docs, benchmark, most=most).collect()}
    assert got == {1: (100_000, 100_000, ["1", "3"]), 2: (60, 9, ["3"]), 3: (31, 31, ["1", "2", "3"])}
    hashes = np.full(100_000, 7, np.uint64)
    known = decontaminate.Benchmark([("a", np.full(500, 7, np.uint64)), ("b", np.full(5000, 7, np.uint64))], 10, 5)
    began = time.time()
    hit, items = known.hits(hashes, *decontaminate.winnow(hashes))
    assert hit.all() and items == {0, 1} and time.time() - began < 1


def test_languages_have_one_rule_at_every_length(spark):
    """Scores hardly move where a text gets one byte more."""
    rng = random.Random(5)
    vocabulary = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    a, b = vocabulary("abcdefghij"), vocabulary("ijklmnopqrstu")
    model = language_id.Compressors({"aa": " ".join(rng.choice(a) for _ in range(4000)).encode(), "bb": " ".join(rng.choice(b) for _ in range(4000)).encode()})
    text = " ".join(rng.choice(a) if rng.random() < 0.8 else rng.choice(b) for _ in range(200))
    scores = []
    for n in range(200, 320):
        name, least, second = model.best(text[:n])
        assert name == "aa"
        scores.append((second - least) / least)
    steps = [abs(x - y) for x, y in zip(scores, scores[1:], strict=False)]
    assert max(steps) < 0.05 and max(steps[54:58]) < max(steps[:54] + steps[58:])  # 254 to 258 bytes are nothing special


def test_more_languages_than_a_tier_holds(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda k: [f"{chr(97 + k)}{chr(97 + (k * 7 + j) % 26)}{'aeiou'[j % 5]}{chr(97 + j)}" for j in range(12)]
    rows = [(i, " ".join(rng.choice(words(i % 9)) for _ in range(60)), f"l{i % 9}" if i % 9 else "") for i in range(270)]
    rows += [(7, rows[7][1], rows[7][2])] * 50  # one id, again and again, is one piece
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language_id.classify(df, language_id.train(df)).collect()}
    monkeypatch.setattr(language_id, "LANGUAGES", 4)
    tiered = {r.doc_id: (r.lang_pred, r.score) for r in language_id.classify(df, language_id.tiers(df)).collect()}
    assert tiered == plain and sum(plain[i][0] == lang for i, _, lang in rows[:270]) > 260 and "" in {p for p, _ in plain.values()}
    with pytest.raises(ValueError):
        language_id.train(df)


def test_more_mapped_files_than_open_files(tmp_path):
    """With 256 open files allowed, 400 files are mapped and read."""
    for k in range(400):
        (tmp_path / str(k)).write_bytes(bytes([k % 251]) * 9)
    code = f"import resource; resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))\nfrom plotmere.llm.shared import get_file\nheld = [get_file('{tmp_path}/' + str(k)) for k in range(400)]\nassert all(bytes(h) == bytes([k % 251]) * 9 for k, h in enumerate(held))"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=".")
    assert resource.getrlimit(resource.RLIMIT_NOFILE)[0] > 0 and json.dumps(str(shared.SLICE_BYTES))
