"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plotmere.llm import decontaminate, language_id, license_scan, ngram_lm, phrase_fingerprint, piece_bpe, shingle_dedup, simhash_dedup, substring_dedup, token_store, toxicity
from plotmere.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, fp string"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel iris juniper kelp laurel maple nettle oak pine quince rose sage thyme".split()


def texts(n=60, seed=3):
    """Random prose, with copies, shared passages, null, empty, blank and long texts."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n", "ing", "É"]) for _ in range(k))
    passage = prose(60)
    out = [prose(rng.randrange(1, 120)) for _ in range(n)]
    out += [out[0], out[0], out[1].replace(" ", "  "), prose(20) + " " + passage + " " + prose(9), passage + prose(5), None, "", "   \n\t", "A", prose(4000), passage * 3]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr"][i % 2], "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def split(t):
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_against_brute_force(docs, empty, order, monkeypatch):
    """Adjusted counts by their definition, level by level, and the interpolation written out."""
    monkeypatch.setattr(ngram_lm, "FLUSH", 500)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    sequences = {i: [*split(ascii_lower(t)), "</s>"] for i, t in rows}
    one = Counter(w for i, s in sequences.items() if not held[i] for w in s)
    total, v = sum(one.values()), len(one)
    raw, counts = Counter(), {}
    for i, s in sequences.items():
        if not held[i]:
            full = ["<s>", *s]
            raw.update(tuple(full[a:b]) for b in range(2, len(full) + 1) for a in range(max(0, b - order), b))
    for k in range(1, order + 1):
        before = defaultdict(set)
        for g in raw:
            if len(g) == k + 1:
                before[g[1:]].add(g[0])
        counts[k] = {g: c if k == order or g[0] == "<s>" else len(before[g]) for g, c in raw.items() if len(g) == k}
    d = {k: ngram_lm.discounts([sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4)]) for k in counts}
    after = defaultdict(list)
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            after[g[:-1]].append(c)
    types = sum(counts[1].values())
    gamma = sum(d[1][min(c, 3) - 1] for c in counts[1].values()) / types

    def p(g):
        k, c = len(g), counts[len(g)].get(g, 0)
        left = max(c - (d[k][min(c, 3) - 1] if c else 0), 0)
        if k == 1:
            return left / types + gamma / (v + 1)
        if not (others := after.get(g[:-1])):
            return p(g[1:])
        return left / sum(others) + sum(d[k][min(x, 3) - 1] for x in others) / sum(others) * p(g[1:])

    for r in ngram_lm.score_held_out(docs, order).collect():
        s = sequences[r.doc_id]
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(s) and r.train_tokens == total and r.n_known == sum(one[w] > 0 for w in s)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 0.5) / (total + 0.5 * (v + 1))) for w in s), rel_tol=1e-9)
        full = ["<s>", *s]
        assert math.isclose(r.score, sum(math.log10(p(tuple(full[max(0, j - order + 1) : j + 1]))) for j in range(1, len(full))), rel_tol=1e-6)
    assert ngram_lm.score_held_out(empty, order).count() == 0


def test_model_without_training_rows_and_with_large_counts(spark, docs, empty):
    assert {r.score for r in ngram_lm.score(docs, ngram_lm.train(empty)).collect()} == {0.0}
    model = ngram_lm.train(spark.createDataFrame([("a b a b c " * 300,), ("a b",), (None,), ("",)], "text string"))
    table = ngram_lm.Keys(model["folder"], "words", model["shards"], 1)
    keys = np.sort(ngram_lm.words(next(ngram_lm.slices(pa.array(["a b c d"]))), ngram_lm.alphabet()).hash)
    assert sorted(table.find(np.sort(np.r_[keys, ngram_lm.END, ngram_lm.BEGIN]))[1][0].tolist()) == [0, 4, 4, 300, 601, 601]


@pytest.mark.parametrize("shards", [1, 16, 1 << 16, 1 << 18])
def test_keys_in_files(shards, tmp_path):
    """Keys of one shard are found, others are not, whatever part of a key the shard and the directory leave out."""
    rng, shard = np.random.default_rng(shards), shards // 3
    low = rng.integers(0, (1 << 64) // shards, 3000, np.uint64, endpoint=False) + np.uint64(shard) * np.uint64((1 << 64) // shards % (1 << 64)) if shards > 1 else rng.integers(0, 1 << 64, 3000, np.uint64)
    keys = np.unique(low)
    count = rng.integers(1, 600, keys.size)
    (tmp_path / f"t-{shard}").write_bytes(ngram_lm._as_file(keys, [count], shard, shards))
    table = ngram_lm.Keys(str(tmp_path), "t", shards, 1)
    place, (found,) = table.find(keys)
    assert (place == np.arange(keys.size)).all() and (found == count).all()
    others = np.setdiff1d(np.unique(np.r_[keys ^ np.uint64(1), keys + np.uint64(1 << 20)]), keys)
    assert (table.find(others)[0] == -1).all()
    # Several counts: frequent rows, rows of small numbers beyond the table's, and numbers of every width.
    columns = [np.where(rng.random(keys.size) < 0.5, 1, rng.integers(0, 1 << bits, keys.size)) for bits in (1, 6, 8, 20, 40)]
    (tmp_path / f"s-{shard}").write_bytes(ngram_lm._as_file(keys, columns, shard, shards))
    for found, column in zip(ngram_lm.Keys(str(tmp_path), "s", shards, 5).find(keys)[1], columns, strict=True):
        assert (found == column).all()
    for size in (0, 1, 2, 2999):  # codes of half a byte, of an odd number of keys too
        few = np.where(rng.random(size) < 0.9, 1, rng.integers(1, 40, size))
        (tmp_path / f"h{size}-{shard}").write_bytes(ngram_lm._as_file(keys[:size], [few], shard, shards))
        assert (ngram_lm.Keys(str(tmp_path), f"h{size}", shards, 1).find(keys[:size])[1][0] == few).all()
    assert len((tmp_path / f"h2999-{shard}").read_bytes()) < len((tmp_path / f"t-{shard}").read_bytes())


def test_simhash_against_brute_force(docs, empty):
    def fingerprint(t):
        w = split(ascii_lower(t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and least[j] < least[i]:
                    least[i], changed = least[j], True
    got = simhash_dedup.cluster(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", least[i]) for i in fps}
    assert simhash_dedup.cluster(empty).count() == 0
    assert {r.doc_id for r in simhash_dedup.one_of_each(docs).collect()} == set(least.values())


def test_simhash_keeps_one_of_each_group_where_ids_repeat(spark):
    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (None, b)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash_dedup.one_of_each(df).collect()) == [(0, b), (3, a), (5, b)]


def test_anchors_cover_three_bits(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, base.size, dtype=np.uint64)
    every = np.unique(np.concatenate([base, near]))
    links = simhash_dedup.linked(spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")).collect()
    assert {frozenset((int(a), int(b))) for a, b in zip(base.view(np.int64), near.view(np.int64), strict=True) if a != b} <= {frozenset((r.a, r.b)) for r in links}


@pytest.mark.parametrize("hot", [2000, 3])
def test_near_duplicate_stage_against_brute_force(spark, docs, empty, hot):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for base in (f"{rng.random()} " + " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(150)) for _ in range(12)):
        for k in range(6):  # each edit replaces up to five of the 147 shingles
            w = base.split()
            for at in rng.sample(range(len(w)), k):
                w[at] = "changed"
            rows.append((len(rows), " ".join(w)))
    words = {i: split(ascii_lower(t or "")) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    near = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    least = {i: i for i in sets}
    for _ in sets:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingle_dedup.cluster(df, hot=hot).collect()} == least
    kept = corpus_pipeline.STAGES[1][1](spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(least.values()) and sum(least[i] == least[j] for i, j in near) == len(near) > 60
    assert shingle_dedup.one_of_each(empty).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (None, b), (7, None), (8, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in shingle_dedup.one_of_each(df).collect()) == [(0, b), (3, a), (5, b), (7, "")]


def test_f11_near_duplicate_stage_links_fingerprints_too(spark):
    """What SimHash links (op2) is one group in the stage, whatever its shingles, and joins the groups of shingles."""
    same = "one two three " * 60
    rows = [(1, same + "alpha beta gamma"), (2, same.upper() + "delta epsilon zeta eta theta iota"), (3, "quite another text of nine words or so, alone"), (4, None), (5, "")]
    long = [f"w{k}" for k in range(200)]
    rows += [(6, " ".join(long)), (7, " ".join([*long[:100], "changed", *long[101:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.fingerprint for r in simhash_dedup.cluster(df).collect()}
    assert (int(found[1], 16) ^ int(found[2], 16)).bit_count() <= 3
    assert {r.doc_id: r.component_id for r in shingle_dedup.cluster(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6}
    assert {r.doc_id: r.component_id for r in shingle_dedup.cluster(df, bits=3).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6}
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, df, "").collect()} == {1, 3, 4, 6}


def test_license_notices_with_many_line_ends(spark):
    """Neither blank lines within a notice nor line feeds after it cut it off."""
    mit = license_scan.TEMPLATES[12][1]
    half = len(mit) // 2 + mit[len(mit) // 2 :].index(" ")
    rows = [mit[:half] + "\n\n" + mit[half:], mit[:half] + "\n\n" + mit[half:] + "\n" * 2000, mit.replace(" ", "\r\n    "), mit.replace(" ", " \n \n ")]
    found = license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert [(r.licenses, r.score) for r in found] == [("MIT", 1.0)] * 4


def test_licenses(spark, empty):
    apache, mit = license_scan.TEMPLATES[1][1], license_scan.TEMPLATES[12][1]
    rows = [(1, "Words.\nReleased under the MIT License."), (2, mit.replace("Software", "Program")), (3, "para\n\n" + apache.replace(" ", "\n") + "\n\nmore text"), (4, None), (5, ""), (6, "mit"), (7, "released under the sea license"), (8, mit + " " + "word " * 900)]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in found.items()} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "", 5: "", 6: "", 7: "", 8: ""}
    assert found[1].score == 1.0 and 0.8 <= found[2].score < 1 and found[4].score is None
    assert license_scan.scan(empty).count() == 0


def test_licence_neighbours(spark):
    fsf = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    opening, clause = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[3][1]
    rows = {
        fsf.format("program", ";", "General Public License", ";", "2"): "GPL-2.0",
        fsf.format("program", ":", "General Public License", ",", "3"): "GPL-3.0",
        fsf.format("program", ":", "Lesser General Public License", ",", "3"): "LGPL-3.0",
        fsf.format("program", ":", "Affero General Public License", ",", "3"): "AGPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.": "CC-BY-SA-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "  GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nbody of many words": "GPL-2.0",
        "Eclipse Public License - v 2.0\n\nbody of many words": "EPL-2.0",
        "CC0 1.0 Universal\n\nbody of many words": "CC0-1.0",
        opening: "BSD-2-Clause OR BSD-3-Clause",
        opening + "\n\nsource, binary\n\n" + clause: "BSD-3-Clause",
        "Thanks for reading our long line. Released under the MIT License. Send us mail about it.": "MIT",
    }
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = license_scan.scan(df, templates=license_scan.NEIGHBOURS, best=True, sentences=True).orderBy("doc_id").collect()
    assert [(r.licenses, r.license) for r in found] == [(name, name) for name in rows.values()]


def test_toxicity_learns(spark, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=40)) + (" scum idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(1500)] + [(5000, None, None), (5001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.score_held_out(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [i for i in range(1500) if got[i].held_out]
    assert len(got) == 1502 and sum(got[i].predicted == int(i % 4 == 0) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    none = toxicity.score_held_out(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_held_out(empty, df.select("doc_id", "toxic")).count() == 0


M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_levels(text):
    """The parsing written out for one text: runs, tosses, cuts, names. Yields the names of each level, and whether one is whole."""
    symbols = list(text.encode())
    run, length_of, base = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x9E3779B97F4A7C15
    while symbols:
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        if len(runs) < len(symbols):
            symbols = [plain_mix((s * run + n) & M64) if n > 1 else s for s, n in runs]
        bit = lambda a, b: ((a ^ b) & -(a ^ b)).bit_length() - 1
        label = [symbols[0] & 1] + [2 * bit(a, b) + (b >> bit(a, b) & 1) for a, b in itertools.pairwise(symbols)]
        for _ in range(3):
            label = [label[0] & 1] + [2 * bit(a, b) + (b >> bit(a, b) & 1) for a, b in itertools.pairwise(label)]
        for value in (3, 4, 5):
            around = [None, *label, None]
            label = [min({0, 1, 2} - {around[i], around[i + 2]}) if x == value else x for i, x in enumerate(label)]
        n = len(label)
        inner = lambda i, d: label[i + d] if 0 <= i + d < n else -1
        top = [label[i] > inner(i, -1) and label[i] > inner(i, 1) for i in range(n)]
        low = [label[i] < inner(i, -1) and label[i] < inner(i, 1) and not any(0 <= i + d < n and top[i + d] for d in (-1, 1)) for i in range(n)]
        cut = [i == 0 or ((top[i] or low[i]) and i not in (1, n - 1)) for i in range(n)]
        starts = [i for i in range(n) if cut[i]] + [n]
        symbols = [plain_mix((sum(s * pow(base, k + 1, 1 << 64) for k, s in enumerate(symbols[a:b])) + (b - a) * length_of) & M64) for a, b in itertools.pairwise(starts)]
        yield symbols, len(symbols) == 1
        if len(symbols) == 1:
            return


def plain_sketch(text):
    kept = set()
    for depth, (names, whole) in enumerate(plain_levels(text), 1):
        if depth >= phrase_fingerprint.LEVEL or whole:
            kept |= {plain_mix(x) >> 32 for x in names}
    return sorted(kept)[: phrase_fingerprint.KEPT]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    least = sorted({*a, *b})[: phrase_fingerprint.KEPT]
    return sum(x in a and x in b for x in least) / len(least)


def test_phrases_against_plain_walk(docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in phrase_fingerprint.compare_edits(docs).collect()}
    shown = lambda s: "".join(f"{x:08x}" for x in s)
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        new = t[: len(t) - half] + after[:half]
        a, b, c = plain_sketch(t), plain_sketch(new), plain_sketch(after)
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint, got[i].edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), shown(a), shown(b))
        assert (got[i].near_edited, got[i].near_next) == (plain_likeness(a, b), plain_likeness(a, c))
    assert phrase_fingerprint.compare_edits(empty).count() == 0


def test_toxicity_against_plain_ftrl(spark):
    """One group, one round: FTRL-proximal written out cell by cell, over features hashed one at a time."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 12))) + (" rotten" if i % 3 == 0 else ""), i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame([(i, t, int(y)) for i, t, y in rows], "id long, text string, label int")
    model = toxicity.train(df, shards=1, rounds=1)
    kinds = [int(k) for k in toxicity._KINDS]

    def cells(text):
        h = [int(x) for x in toxicity.words(next(toxicity.slices(pa.array([text]))), toxicity.LETTERS).hash] if text else []
        every = {plain_mix(x * kinds[0] & M64) for x in h} | {plain_mix((a * kinds[gap] + b) & M64) for gap in (1, 2) for a, b in zip(h, h[gap:], strict=False)}
        return sorted({max(x >> 64 - toxicity.BITS, 1) for x in every})

    z, n = Counter(), Counter()

    def weight(c, plain=False):
        if not plain and abs(z[c]) <= toxicity.L1:
            return 0.0
        return -(z[c] - (0 if plain else math.copysign(toxicity.L1, z[c]))) / ((toxicity.BETA + math.sqrt(n[c])) / toxicity.ALPHA + toxicity.L2)

    for k in np.random.default_rng(0).permutation(len(rows)).tolist():
        own = cells(rows[k][1])
        w = {0: weight(0, True), **{c: weight(c) for c in own}}
        g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][2]
        for c, x in w.items():
            z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / toxicity.ALPHA * x
            n[c] += g * g
    want = {c: weight(c) for c in z if c and weight(c)}
    assert dict(zip(model["cells"].tolist(), model["weights"].tolist(), strict=True)) == pytest.approx(want, rel=1e-4, abs=1e-5) and model["bias"] == pytest.approx(weight(0, True), rel=1e-4)
    for r in toxicity.score(df, model).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-weight(0, True) - sum(want.get(c, 0) for c in cells(r.text)))), abs=1e-4)


def test_toxicity_of_odd_labels(spark):
    """Null labels teach nothing; the largest of an id's labels holds; repeated rows and clashing columns stay."""
    rows = [(1, "fine words"), (1, "fine words"), (2, None), (None, "no id"), (3, "rotten"), (8, "rotten words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (3, 0), (3, 1), (8, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    learnt = {(r.id, r.label) for r in toxicity.sampled(df, labels).collect()}
    assert learnt == {(1, 0), (3, 1), (8, 1)}
    assert len(toxicity.score(df, toxicity.train(toxicity.sampled(df, labels))).collect()) == 6


def test_languages_against_plain_zstandard(spark):
    """The dictionary of fewest bytes, each block compressed on its own; ties, one language, and clashing columns."""
    import zstandard

    model = {"aa": b"alder birch cedar dogwood elm fir ginkgo " * 20, "bb": b"hazel iris juniper kelp laurel maple nettle " * 20}
    rows = [(1, "Alder, birch and cedar! " * 30), (2, "kelp maple iris hazel nettle " * 400), (3, None), (4, "12 34"), (5, "é"), (6, " ".join(WORDS))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language_id.classify(df, model).collect()}
    for i, text in rows:
        if not text or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0, True)
            continue
        plain = b" ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).encode().split())
        head, plain = b" " * 64 + b" ".join([plain[:256]] * 4), plain[256:]
        sizes = {}
        for lang, content in model.items():
            one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=language_id._SETTINGS)
            sizes[lang] = len(one.compress(head)) + sum(len(one.compress(plain[k : k + language_id.BLOCK])) for k in range(0, len(plain), language_id.BLOCK))
        best, second = sorted(sizes.values())
        assert got[i][0] == min(sizes, key=lambda k: (sizes[k], k)) and got[i][1] == pytest.approx(min(1, (second - best) / best)) and got[i][2] == (got[i][1] < language_id.MARGIN)
    assert {r.lang_pred for r in language_id.classify(df, {"aa": model["aa"]}).collect()} == {"aa", "und"}
    assert {r.lang_pred for r in language_id.classify(df, {}).collect()} == {"und"}


@pytest.mark.parametrize("name", ["op3_license_scan", "op8_benchmark_decontamination", "op9_substring_dedup"])
def test_queries_match_sql(spark, name):
    import duckdb

    from plotmere.llm.queries import ORACLE_SQL

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = QUERIES[name](spark, sf)
    ours = sorted(found.collect(), key=lambda r: r.doc_id)
    theirs = con.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]}) ORDER BY doc_id").fetchall()
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_long_texts_in_pieces(monkeypatch):
    """Words of a text are the same, however it is cut, and a word of any length has one hash."""
    from plotmere.llm import shared

    text = " ".join("x" * k + "é" for k in range(60)) + "\n" + "y" * 3000
    whole = [shared.words(next(shared.slices(pa.array([text, None, "", "a b"]))), shared.alphabet(lower=True))]
    monkeypatch.setattr(shared, "_CHUNK", 50)
    monkeypatch.setattr(shared, "_LONG", 16)
    parts = shared.words(next(shared.slices(pa.array([text, None, "", "a b"]))), shared.alphabet(lower=True))
    for a, b in zip(whole[0], parts, strict=True):
        assert (a == b).all()


def test_phrases_are_consistent():
    rng = random.Random(4)
    body = "".join(rng.choices("abcdefgh ", k=4000))
    a, b, c = phrase_fingerprint.sketches([body, "".join(rng.choices("xyz", k=777)) + body, "".join(rng.choices("abcdefgh ", k=4000))])
    assert phrase_fingerprint.likeness(a, b) > 0.5 > 0.1 > phrase_fingerprint.likeness(a, c)
    for text in ("", "a", "aa", "aaaaaaa", "ab" * 50, "é"):
        for names, row, _ in phrase_fingerprint.levels(np.frombuffer(text.encode(), np.uint8).astype(np.uint64), np.zeros(len(text.encode()), np.int32)):
            assert names.size == row.size


@pytest.mark.parametrize("options", [{}, {"segment_ids": 50, "file_bytes": 400}])
def test_token_files_round_trip(docs, empty, options):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in token_store.round_trip(docs, path, **options).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.round_trip(empty, path).count() == 0


def test_token_files_tell_null_ids_from_the_least_long(spark, tmp_path):
    rows = [(None, "b c"), (None, "a"), (-(1 << 63), "d"), (0, None), (0, "e")]
    files = token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids[-1]) for r in token_store.read(files, with_ids=True).collect()), key=lambda r: r[1])
    assert got == [(None, 0, 2, 2), (None, 2, 3, 2), (-(1 << 63), 5, 2, 2), (0, 7, 1, 2), (0, 8, 2, 2)]


@pytest.mark.parametrize("most", [0, 1, 200, 50_000, 2**31, 2**60 - 1, 2**63])
def test_simple8b(most):
    rng = np.random.default_rng(most % 97)
    for n in (0, 1, 1023, 1024, 1025, 9000):
        ids = rng.integers(0, most, n, dtype=np.uint64, endpoint=True)
        ids[: n // 2] = np.minimum(ids[: n // 2], 3)
        words, blocks = token_store.pack_ids(ids)
        assert (token_store.unpack_ids(words, blocks, n) == ids).all()


def test_encoder_matches_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    some = ["", "A.B", "don't stop.", "<|endoftext|> Hi", "x<|y", "naïve café. Ünï, ﬁ ß İ Å", "日本語.", "éa क़x", "1.5, 2", "\x1c a\x85b"]
    library = Tokenizer.from_file(path)
    assert token_store.encoder(path).encode([t.encode() for t in some]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_pieces_match_library(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in piece_bpe.digests(docs, path).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    coded = piece_bpe.encode(docs, path, checked=True).collect()
    assert all(r.ids == library.encode(r.text or "") and r.decoded_again == (library.decode(r.ids) == (r.text or "")) for r in coded)
    assert piece_bpe.digests(empty, path).count() == 0


def brute_hits(text, items):
    find = lambda t: __import__("re").findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t or ""))
    w, hit, found = find(text), set(), set()
    for i, t in items:
        b = find(t)
        n = min(10, len(b))
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
        for k in range(len(w) - n + 1) if b else ():
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_decontamination_against_brute_force(spark, docs, empty, most):
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(1, " ".join(split(rows[9])[3:22])), (2, rows[3]), (3, "oak pine"), (4, None), (5, ""), (10, "cedar, CEDAR! elm"), (11, " ".join(split(rows[64])[10:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, bench, most=most).collect()}
    for i, t in rows.items():
        n, hit, found = brute_hits(t, items)
        assert got[i] == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
    assert decontaminate.report(empty, bench).count() == 0 and not any(r.contaminated for r in decontaminate.report(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_benchmark_items_without_id(spark, most):
    import duckdb
    import pandas as pd

    from plotmere.llm.queries import ORACLE_SQL

    prose = lambda k: " ".join(f"{w}{k}" for w in WORDS)
    rows = [(1, prose(1)), (2, prose(2)), (3, prose(1) + " " + prose(3)), (4, prose(4)), (5, "so oak pine it is"), (6, None)]
    items = [(None, prose(1)), (None, prose(4)), (7, prose(3)), (None, "oak pine"), (8, None), (None, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    found = decontaminate.report(df, bench, most=most).orderBy("doc_id")
    assert [tuple(r) for r in found.collect()] == con.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL['op8_benchmark_decontamination']}) ORDER BY doc_id").fetchall()
    assert {r.doc_id: (r.n_hit, r.items) for r in decontaminate.mark(df, bench, most=most).collect()} == {1: (20, []), 2: (0, []), 3: (40, ["7"]), 4: (20, []), 5: (2, []), 6: (0, [])}


@pytest.mark.parametrize("hot", [4000, 2])
def test_substrings_against_brute_force(docs, empty, hot):
    rows = {r.doc_id: split(r.text) for r in docs.collect()}
    windows = Counter(tuple(w[k : k + 35]) for w in rows.values() for k in range(len(w) - 34))
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.report(docs, hot=hot).collect()}
    for i, w in rows.items():
        gone = {p for k in range(len(w) - 34) if windows[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert got[i] == (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert substring_dedup.report(empty).count() == 0
    stripped = {r.doc_id: r.text for r in substring_dedup.strip(docs).collect()}
    assert all(len(split(stripped[i])) == got[i][0] - got[i][1] for i in rows)


def test_repeated_rows_cost_their_number(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(200))
    monkeypatch.setattr(substring_dedup, "workspace", lambda spark, name: f"{tmp_path}/{name}")
    n = 40
    got = substring_dedup.report(spark.createDataFrame([(1, text)] * n + [(2, "short")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 200)] * n + [(2, 0)]
    distinct = spark.read.parquet(f"{tmp_path}/substrings/distinct")
    assert spark.read.parquet(f"{tmp_path}/substrings/places").count() == n * distinct.count() and {r.times for r in distinct.collect()} == {n}
    # All regions are whole repeats, so no text is looked at.
    assert spark.read.parquet(f"{tmp_path}/substrings/runs").count() == 0


def test_many_equal_rows_take_little_time(spark):
    rng = random.Random(7)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(400))
    rows = [(1, text)] * 5000 + [(2, text[: len(text) // 2] + " other words"), (2, text[len(text) // 3 :] + " and others")]
    began = time.time()
    got = Counter((r.doc_id, r.n_removed > 0) for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, True): 5000, (2, True): 2} and time.time() - began < 60


def test_strip_leaves_other_columns_alone(spark):
    passage = " ".join(f"{w}{i}" for i in range(3) for w in WORDS)
    df = spark.createDataFrame([(1, passage + " one", "a", 2), (2, passage + " two", None, None), (None, None, "b", 1), (3, "", "c", 0)], "doc_id long, text string, `_id` string, spans int")
    got = substring_dedup.strip(df)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("text", F.when(F.length("text") > 9, F.substring_index("text", " ", -1)).otherwise(F.col("text"))).collect()))


def test_languages_held_out(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in real.collect()}
    held = [r for r in language_id.predict_held_out(real).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    got = {r.doc_id: r for r in language_id.predict_held_out(docs).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and {r.lang_pred for i, r in got.items() if not (docs_text := texts()[i]) or not docs_text.strip()} == {"und"}
    assert language_id.predict_held_out(docs.limit(0)).count() == 0


def brute_chain(rows, items):
    """What the stages after language ID keep of (id, text): one of each near copy, no repeated windows, no benchmark."""
    words = {i: split(ascii_lower(t or "")) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    least = {i: i for i in sets}
    near = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    for _ in sets:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    kept = {i: split(t) for i, t in rows if least[i] == i}
    windows = Counter(tuple(w[k : k + 35]) for w in kept.values() for k in range(len(w) - 34))
    for i, w in kept.items():
        gone = {p for k in range(len(w) - 34) if windows[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept[i] = [x for k, x in enumerate(w) if k not in gone]
    return {i: w for i, w in kept.items() if not brute_hits(" ".join(w), items)[1]}


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole chain on planted copies, passages and benchmark items, with nulls and extra columns; language ID by itself."""
    rng = random.Random(11)
    prose = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(k))
    passage, item = prose(60), prose(30)
    rows = [(i, prose(rng.randrange(40, 200))) for i in range(80)]
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, rows[5][1] + " more words here"), (103, prose(50) + " " + passage + " " + prose(50)), (104, passage + " " + prose(70)), (105, prose(40) + " " + item), (106, None), (107, ""), (108, "12 !"), (109, rows[9][1] + "\n" + item[:40])]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute_chain([(i, t) for i, t in rows if i not in (106, 107, 108)], [(1, item)])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(got) == set(want)
    assert all(split(library.decode(got[i].ids)) == w for i, w in want.items())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, None, None, None, None), (7, None, "", "", 0), (None, "words", None, "s", 5)], docs.schema)).withColumn("_hits", F.lit(1)).withColumn("id", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, odd):
            kept = stage(spark, rows, "/root/testdata/sf0.001")
            assert kept.columns == rows.columns and 0 < kept.count() <= rows.count(), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(r.n_tokens == len(r.ids) for r in out)


def test_pipeline_batches_are_bounded_by_bytes(spark):
    """Long texts reach Python some megabytes at a time, whatever the number of rows: a batch ends with the row that passes the bound."""
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words "), F.when(F.col("id") == 5, 1_000_000).otherwise(200_000).cast("int")).alias("text"), F.lit("en").alias("lang"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.slice(0, b.num_rows - 1).nbytes])], ["n", "before"]) for b in batches)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
            stage(spark, docs.limit(0).withColumns({"source": F.lit("s"), "n_chars": F.lit(1)}), "/root/testdata/sf0.001")
            found = docs.mapInArrow(sizes, "n long, before long").collect()
            assert sum(r.n for r in found) == 12 and len(found) > 2 and all(r.before <= corpus_pipeline.BATCH_BYTES for r in found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_queries_are_registered(spark):
    assert len(QUERIES) == 13 and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert F is not None
