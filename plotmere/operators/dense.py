"""Complete linkage among many listings of one name in a small area, whose pairs are told by their places alone.

Listings of one signature (equal clean names, phones and numbers) are duplicates wherever they lie within a fixed reach, so
their pairs, the square of them in number, need not be made: a task holds places, and looks at the neighbours of one listing
at a time. That is exact where no listing of another signature can be a duplicate of theirs; elsewhere pairs are made.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmere.functions.geo import DEGREE_MILES, EARTH_MILES, cell, lon_degrees
from plotmere.operators.resolve import CELL, PHONE_ALONE, SAME_NAME, SAME_PHONE, duplicates
from plotmere.operators.shared import connected, shared_folder, written

#: Listings of one signature in one region from which on their pairs are not made; listings that one task links at once;
#: the side of a tile in reaches.
DENSE, TASK_LISTINGS, TILE_REACHES = 1_000, 200_000, 16


def reach() -> Column:
    """Miles within which listings of one signature and of different records are duplicates; null where they never are."""
    named, phoned = F.col("clean") != "", F.size("phones") > 0
    return F.when(named & phoned, SAME_PHONE).when(named, SAME_NAME).when(phoned, PHONE_ALONE)


def _around(miles: float, size: float) -> Column:
    """The cells within so many miles of a place's own."""
    across = F.ceil(lon_degrees(F.lit(miles), F.col("lat")) / size).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dx: F.transform(F.sequence(-across, across), lambda dy: F.struct((cell(F.col("lat"), size) + dx).alias("x"), (cell(F.col("lon"), size) + dy).alias("y")))))


_own = lambda size: F.struct(cell(F.col("lat"), size).alias("x"), cell(F.col("lon"), size).alias("y"))


def dense_regions(listings: DataFrame, towns: list[str] | None = None, least: int = DENSE) -> DataFrame | None:
    """(rid, start, region, lat, lon, best, reach) of prepared listings with start (what is together already) that lie in dense regions.

    A region has the listings of one signature in cells beside each other, so many at least. It is left out where a listing of
    another signature within half a mile could be a duplicate of one of its own, were they at one place, or where a start
    has listings outside it. None where there is none.
    """
    folder = shared_folder(listings.sparkSession, "dense")
    signature = F.to_json(F.struct("clean", "phones", "nums"))
    placed = listings.filter("lat is not null and lon is not null").withColumn("sig", signature)
    classes = placed.groupBy("sig").agg(F.min("rid").alias("class"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, f"{folder}/classes")
    if classes.filter(F.col("n") >= least).limit(1).isEmpty():
        return None
    best = F.greatest(F.coalesce("rating_count", F.lit(0)), F.coalesce("yelp_reviews", F.lit(0))).cast("long")
    spots = placed.hint("merge").join(classes.withColumnRenamed("n", "alike"), "sig").select("rid", "start", "class", "alike", "lat", "lon", best.alias("best"), reach().alias("reach"))
    spots = written(spots, f"{folder}/spots")
    many = spots.filter((F.col("alike") >= least) & F.col("reach").isNotNull())
    # Cells of a class that touch are one region; a cell is known by its least listing.
    cells = written(many.withColumn("at", _own(CELL)).groupBy("class", "at").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n")), f"{folder}/cells")
    beside = many.select("class", F.explode(_around(SAME_PHONE, CELL)).alias("to"), _own(CELL).alias("at")).distinct()
    touching = beside.join(cells.select("class", "at", F.col("node").alias("a")), ["class", "at"]).join(cells.select("class", F.col("at").alias("to"), F.col("node").alias("b")), ["class", "to"])
    parts = connected(touching.select("a", "b"))
    cells = cells.join(parts, "node", "left").select("class", "at", F.coalesce("component", "node").alias("region"), "n")
    large = cells.groupBy("region").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("region")
    cells = written(cells.join(large, "region", "left_semi").select("class", "at", "region"), f"{folder}/regions")
    inside = written(many.withColumn("at", _own(CELL)).join(cells, ["class", "at"]).select("rid", "start", "region", "lat", "lon", "best", "reach"), f"{folder}/inside")
    # Classes that a region meets, put to the rules for duplicates as if they were at one place, either as a mere building.
    near = spots.select(F.col("class").alias("other"), F.explode(_around(SAME_PHONE, CELL)).alias("at")).distinct()
    meets = written(near.hint("merge").join(cells, "at").filter("class <> other").select("region", "class", "other").distinct(), f"{folder}/meets")
    told = placed.join(classes.select(F.col("class").alias("rid")), "rid", "left_semi")
    texts = ["clean", "nums", "phones", "words", "telling"]
    nothing = {"lat": F.lit(0.0), "lon": F.lit(0.0), "source": F.lit(""), "source_id": F.lit(None).cast("string"), "outline": F.lit(None).cast("struct<s:double,w:double,n:double,e:double>")}
    side = lambda name, key: told.select(F.col("rid").alias(key), F.struct("rid", *texts, *(v.alias(k) for k, v in nothing.items())).alias(name))
    pairs = meets.select("class", "other").distinct().hint("merge").join(side("a", "class"), "class").hint("merge").join(side("b", "other"), "other").withColumn("building", F.explode(F.array(F.lit(True), F.lit(False))))
    pairs = pairs.select(F.col("a").withField("only_building", F.col("building")).alias("a"), F.col("b").withField("only_building", ~F.col("building")).alias("b"), F.lit(0.0).alias("miles"))
    possible = duplicates(pairs, towns).select(F.col("a.rid").alias("class"), F.col("b.rid").alias("other")).distinct()
    mixed = meets.join(possible, ["class", "other"], "left_semi").select("region")
    # Starts that reach out of a region.
    size = listings.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    out = inside.groupBy("region", "start").agg(F.count(F.lit(1)).alias("k")).join(size, "start").filter("k < n").select("region")
    bad = written(mixed.union(out).distinct(), f"{folder}/bad")
    return written(inside.join(bad, "region", "left_anti"), f"{folder}/found")


def miles_from(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray, cos: float, coses: np.ndarray) -> np.ndarray:
    """Great-circle miles, in the order of operations of functions.geo.haversine."""
    a, b = np.sin(np.radians(lats - lat) / 2), np.sin(np.radians(lons - lon) / 2)
    return 2 * EARTH_MILES * np.arcsin(np.sqrt(a * a + cos * coses * b * b))


class _Places:
    """Listings of one task by cells as wide as their reach: the neighbours of one are looked up in nine of them."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, reach: float) -> None:
        self.lat, self.lon, self.reach, self.cos = lat, lon, reach, np.cos(np.radians(lat))
        high = reach / DEGREE_MILES * 1.001
        self.x = np.floor(lat / high).astype(np.int64)
        self.y = np.floor(lon / (high / max(0.01, float(self.cos.min())))).astype(np.int64)
        self.y -= self.y.min() - 1
        self.wide = int(self.y.max()) + 2
        self.spots = np.stack([self.cos * np.cos(np.radians(lon)), self.cos * np.sin(np.radians(lon)), np.sin(np.radians(lat))], axis=1)
        self.chord = 4 * np.sin(reach / (2 * EARTH_MILES)) ** 2
        key = self.x * self.wide + self.y
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def near(self, p: int, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Listings that fit (a flag for each) within reach of p, without itself, and their miles."""
        middle = (self.x[p] + np.array([-1, 0, 1])) * self.wide + self.y[p]
        low, high = np.searchsorted(self.keys, middle - 1, "left"), np.searchsorted(self.keys, middle + 1, "right")
        found = np.concatenate([self.order[a:b] for a, b in zip(low, high, strict=True)])
        found = found[fits[found]]
        found = found[self.reaches(p, found) & (found != p)]
        return found, self.miles(p, found)

    def reaches(self, p: int, others: np.ndarray) -> np.ndarray:
        """Which of the others lie within reach of p: by chords on the unit sphere, and by miles where those are close to it."""
        apart = self.spots[others] - self.spots[p]
        chord = np.einsum("ij,ij->i", apart, apart)
        found = chord <= self.chord
        close = np.flatnonzero(np.abs(chord - self.chord) < 1e-8 * self.chord)
        if close.size:
            found[close] = self.miles(p, others[close]) <= self.reach
        return found

    def miles(self, p: int, others: np.ndarray) -> np.ndarray:
        return miles_from(self.lat[p], self.lon[p], self.lat[others], self.lon[others], self.cos[p], self.cos[others])


def linked_places(rid: np.ndarray, group: np.ndarray, lat: np.ndarray, lon: np.ndarray, best: np.ndarray, reach: float, own: np.ndarray, held: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(group, waits) of each listing after complete linkage of the groups, where listings within reach are duplicates.

    Pairs come in order of their better listing's reviews, the most first, then of miles and rid. So a group is whole when
    the pairs of its best listing have come: each listing, the best first, takes its neighbours, the nearest first, that all
    its group reaches. Listings of equal reviews take turns by a heap; they hold so many neighbours between them. Groups
    that aren't own wait, and so does whatever could join one that waits.
    """
    dealt = _Places(lat, lon, reach).order  # neighbours lie together
    rid, group, lat, lon, best, own = (c[dealt] for c in (rid, group, lat, lon, best, own))
    places = _Places(lat, lon, reach)
    members: dict[int, list[int]] = defaultdict(list)
    for k, g in enumerate(group.tolist()):
        members[g].append(k)
    waits = ~own
    open_, fresh = np.ones(rid.size, bool), own.copy()  # of groups that can still grow; that don't wait either

    def candidates(p: int, most: int, after: tuple | None) -> list:
        """[places, miles, whether there are more]: what p may take next, in order."""
        found, miles = places.near(p, open_)
        keep = group[found] != group[p]
        found, miles = found[keep], miles[keep]
        low, high = np.minimum(rid[found], rid[p]), np.maximum(rid[found], rid[p])
        if after is not None:
            m, i, j = after
            later = (miles > m) | ((miles == m) & ((low > i) | ((low == i) & (high > j))))
            found, miles, low, high = found[later], miles[later], low[later], high[later]
        for m in members[int(group[p])]:
            if m != p and found.size:
                keep = places.reaches(m, found)
                found, miles, low, high = found[keep], miles[keep], low[keep], high[keep]
        order = np.lexsort((high, low, miles))[:most]
        return [found[order], miles[order], found.size > most]

    levels = np.argsort(-best, kind="stable")
    for owners in np.split(levels, np.flatnonzero(np.diff(best[levels])) + 1):
        owners = owners[open_[owners]]
        if not owners.size:
            continue
        most = max(64, held // owners.size)
        left: dict[int, list] = {}
        taking: dict[int, list[int]] = defaultdict(list)  # the owners in each group
        behind: set[int] = set()  # owners that may hold listings which their group doesn't reach
        apart: set[tuple[int, int]] = set()  # groups that don't reach each other, whatever joins them
        turn: dict[int, int] = defaultdict(int)
        heap: list[tuple] = []

        def push(p: int) -> None:
            found, miles, more = left[p]
            if not found.size and more:
                left[p] = found, miles, more = candidates(p, most, last[p])  # noqa: B023
            if found.size:
                q = int(found[0])
                last[p] = float(miles[0]), int(min(rid[p], rid[q])), int(max(rid[p], rid[q]))  # noqa: B023
                heapq.heappush(heap, (*last[p], p, turn[p]))  # noqa: B023

        def stop(p: int) -> None:
            """p's group waits, and all that it could take."""
            found, _ = places.near(p, fresh)
            for g in {int(group[p]), *group[found].tolist()}:
                waits[members[g]], fresh[members[g]] = True, False
            left.pop(p, None)  # noqa: B023

        last: dict[int, tuple] = {}
        for p in owners.tolist():
            if waits[p]:
                stop(p)
            else:
                taking[int(group[p])].append(p)
                left[p] = candidates(p, most, None)
                push(p)
        while heap:
            *_, p, when = heapq.heappop(heap)
            if p not in left or turn[p] != when:
                continue
            if waits[p]:
                stop(p)
                continue
            found, miles, more = left[p]
            q, left[p] = int(found[0]), [found[1:], miles[1:], more]
            g, h = int(group[p]), int(group[q])
            sure = p not in behind and len(members[h]) == 1
            if g != h and (g, h) not in apart and not (sure or all(places.reaches(m, np.array(members[g])).all() for m in members[h])):
                apart |= {(g, h), (h, g)}
            if g == h or (g, h) in apart:
                push(p)
                continue
            if waits[q]:
                stop(p)
                continue
            met = [(o, members[h]) for o in taking[g]] + [(o, members[g]) for o in taking[h]]
            # Pairs that can't come to anything are dropped early where that is cheap; others when their turn comes.
            if len(met) <= 4:
                for o, others in met:
                    if o in left:
                        found, miles, more = left[o]
                        if o != p or len(others) > 1:
                            keep = (group[found] != g) & (group[found] != h)
                            found, miles = found[keep], miles[keep]
                        for m in others:
                            keep = places.reaches(m, found)
                            found, miles = found[keep], miles[keep]
                        left[o] = [found, miles, more]
            else:
                behind.update(o for o, _ in met)
            if len(members[g]) < len(members[h]):
                g, h = h, g
            group[members[h]] = g
            members[g] += members.pop(h)  # a name that goes is never used again
            taking[g] += taking.pop(h, [])
            for o in taking[g] if len(met) <= 4 else [p]:
                if o in left:
                    turn[o] += 1
                    push(o)
        for p in owners.tolist():
            if not waits[p]:
                whole = members[int(group[p])]
                open_[whole], fresh[whole] = False, False
    back = np.argsort(dealt)
    return group[back], waits[back]


def _linked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The groups of a region's tile: (rid, grp, waits) of its own listings. A group is named by its least start."""
    number = {s: k for k, s in enumerate(sorted(set(pdf["grp"].tolist())))}
    names = np.array(sorted(number), np.int64)
    column = lambda c, kind: pdf[c].to_numpy(kind)
    own = column("own", bool)
    group, waits = linked_places(column("rid", np.int64), pdf["grp"].map(number).to_numpy(np.int64), column("lat", float), column("lon", float), column("best", np.int64), float(pdf["reach"].iloc[0]), own)
    name = pd.Series(names[pdf["grp"].map(number).to_numpy(np.int64)]).groupby(group).transform("min").to_numpy()
    return pd.DataFrame({"rid": pdf["rid"].to_numpy()[own], "grp": name[own], "waits": waits[own]})


def linked_regions(found: DataFrame, most: int = TASK_LISTINGS, reaches: float = TILE_REACHES) -> DataFrame:
    """(start, grp) of complete linkage in dense regions (as dense_regions gives them): the least start of each start's group.

    A region of up to so many listings is linked in one task. A larger one is linked in tiles, whose tasks have the listings
    within reach of them too; what those could change waits for the next round, whose tiles lie aside. Where a round
    decides little the tiles double. All that is held is the listings, however many pairs they make.
    """
    folder = shared_folder(found.sparkSession, "regions")
    size = found.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    left = written(found.join(size, "region").select("rid", "start", F.col("start").alias("grp"), "region", (F.col("n") > most).alias("tiled"), "lat", "lon", "best", "reach"), f"{folder}/0")
    done, number, n = left.select("start", "grp").limit(0), 0, left.count()
    while n:
        number += 1
        aside = number * 0.381966 % 1
        # A group lies in the tile of its least listing, and goes to the tiles that are within reach of it too.
        side = F.col("reach") * (reaches / DEGREE_MILES)
        at = left.groupBy("region", "grp").agg(F.min_by(F.struct("lat", "lon"), "rid").alias("at"), F.first("reach").alias("reach"), F.first("tiled").alias("tiled"))
        tile = lambda degrees: F.when(F.col("tiled"), F.floor(degrees / side + aside)).otherwise(0)  # noqa: B023, E731
        up, along = F.col("reach") / 68.0, lon_degrees(F.col("reach"), F.col("at.lat")) * 1.02
        tiles = F.flatten(F.transform(F.sequence(tile(F.col("at.lat") - up), tile(F.col("at.lat") + up)), lambda x: F.transform(F.sequence(tile(F.col("at.lon") - along), tile(F.col("at.lon") + along)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        dealt = at.select("region", "grp", F.struct(tile(F.col("at.lat")).alias("x"), tile(F.col("at.lon")).alias("y")).alias("home"), F.explode(tiles).alias("tile"))
        rows = left.hint("merge").join(dealt, ["region", "grp"]).select("rid", "grp", "region", "tile", (F.col("tile") == F.col("home")).alias("own"), "lat", "lon", "best", "reach")
        told = rows.groupBy("region", "tile").applyInPandas(_linked, "rid long, grp long, waits boolean")
        told = written(left.drop("grp").hint("merge").join(told, "rid"), f"{folder}/{number}")
        whole = told.filter("not waits").select("start", "grp")
        done = done.union(whole)
        left = told.filter("waits").drop("waits")
        before, n = n, left.count()
        if n > 0.7 * before:
            reaches *= 2
    return done.distinct()
