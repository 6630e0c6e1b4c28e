"""Findings of the fourth round, each with the case that failed before."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_listings import frame, lead

from plotmere.operators import dense, resolve, saved


def _crowds() -> tuple[list, list[str]]:
    """Listings of two names all over a mile, in rows of one to three, and a third name beside one that holds it."""
    rng, rows, owner = random.Random(4), [], []
    for u in range(150):
        name = "Alder Foods" if u % 3 else "Quartz Mill" if u % 2 else "Birch Works"
        lat, lon = 40.7 + rng.random() / 80, -111.9 + rng.random() / 80
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            rows.append(lead(len(rows), name, lat=lat + rng.random() / 5000, lon=lon, source=rng.choice(["osm", "google"]), source_id=f"s{len(rows)}", rating_count=rng.choice([None, 3, rng.randrange(500)])))
            owner.append(f"u{u}")
    rows.append(lead(len(rows), "Birch Works Annex", lat=40.705, lon=-111.895, source_id="annex"))
    return rows, [*owner, "annex"]


def test_f1_dense_listings_are_linked_without_their_pairs(spark, monkeypatch):
    """Groups are those of linkage over all pairs, though pairs are made only where names meet that could be one business."""
    rows, owner = _crowds()
    df = frame(spark, rows).join(spark.createDataFrame(list(enumerate(owner)), "rid long, uid string"), "rid")
    starts = spark.createDataFrame([(u, min(i for i, v in enumerate(owner) if v == u)) for u in set(owner)], "uid string, start long")
    listings = resolve.prepared(df).join(starts, "uid").cache()
    assert dense.dense_regions(listings) is None
    found = dense.dense_regions(listings, least=20)
    names = {r.name for r in found.join(listings.select("rid", "name"), "rid").select("name").distinct().collect()}
    assert names == {"Alder Foods", "Quartz Mill"}  # Birch Works may be one business with its annex
    # All pairs of starts whose listings are duplicates throughout, in the order of the first of them.
    own = {i: owner.index(u) for i, u in enumerate(owner)}
    pairs = {(r.i, r.j): (r.strength, r.reviews, r.miles, r.i, r.j) for r in resolve.ranked_duplicates(listings).collect()}
    between: dict = {}
    for (i, j), rank in pairs.items():
        if own[i] != own[j]:
            between.setdefault((min(own[i], own[j]), max(own[i], own[j])), []).append(rank)
    size = {s: list(own.values()).count(s) for s in own.values()}
    edges = sorted((min(r), e) for e, r in between.items() if len(r) == size[e[0]] * size[e[1]])
    group = resolve._joined([e for _, e in edges])
    dense_starts = {r.start for r in found.collect()}
    expected = {s: group.get(s, s) for s in dense_starts}
    assert len(set(expected.values())) < len(expected) / 2
    for most, reaches in ((10_000, 8), (10, 1.5)):  # in one task, and in tiles
        assert {r.start: r.grp for r in dense.linked_regions(found, most, reaches).collect()} == expected
    # The query's own step: rows of one business are the same, and only what may be mixed is made pairs of.
    seen = df.groupBy("uid").agg(F.min("rid").alias("first_seen"))
    plan = lambda: {tuple(r) for r in saved.same_business(seen, df.drop("rid")).collect()}
    whole, paired = plan(), []
    monkeypatch.setattr(saved, "dense_regions", lambda rows, towns: dense.dense_regions(rows, towns, 20))
    monkeypatch.setattr(saved, "ranked_duplicates", lambda rows, towns, own=saved.ranked_duplicates: paired.append(rows.count()) or own(rows, towns))
    assert plan() == whole
    assert paired == [sum(r[1].startswith("Birch") for r in rows)]


def test_f1_equal_reviews_take_turns(spark):
    """Where all listings are reviewed alike the nearest pair joins first, also where few neighbours are held at a time."""
    rng = np.random.default_rng(5)
    n, reach = 90, 0.2
    lat, lon, rid = 40 + np.round(rng.random(n) / 150, 4), -112 + np.round(rng.random(n) / 150, 4), rng.permutation(n)
    cos = np.cos(np.radians(lat))
    miles = np.array([dense.miles_from(lat[p], lon[p], lat, lon, cos[p], cos) for p in range(n)])
    edges = sorted((miles[x, y], min(rid[x], rid[y]), max(rid[x], rid[y]), x, y) for x in range(n) for y in range(x) if miles[x, y] <= reach)
    expected = resolve._joined([e[3:] for e in edges])
    for held in (1, 2_000_000):
        group, waits = dense.linked_places(rid, np.arange(n), lat, lon, np.zeros(n, np.int64), reach, np.ones(n, bool), held)
        parts = lambda of: {frozenset(k for k in range(n) if of(k) == g) for g in map(of, range(n))}
        assert not waits.any() and parts(lambda k: group[k]) == parts(lambda k: expected.get(k, k))
