"""Look-ups by place: nearest area, overlap of areas, towns in a circle, a circle's parts, request plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plotmere.functions.geo import DEGREE_MILES, bearing, cell, clipped, compass_word, flat_circle, haversine, lon_degrees, ring_centre

#: Miles beyond an area's edge up to which it is named.
BEYOND = 15.0


def nearest_area(points: DataFrame, areas: DataFrame, key: str = "id", beyond: float = BEYOND, size: float = 0.5) -> DataFrame:
    """(key, name, gap): the area (name, lat, lon, radius_miles) with the least distance less radius, within so many miles.

    Areas are put into every cell that they reach, points into their own, so it is an equi-join whatever the numbers.
    """
    reach = F.col("radius_miles") + beyond
    dlat, dlon = reach / DEGREE_MILES, lon_degrees(reach, F.col("lat"))
    xs = F.sequence(cell(F.col("lat") - dlat, size), cell(F.col("lat") + dlat, size))
    ys = F.sequence(cell(F.col("lon") - dlon, size), cell(F.col("lon") + dlon, size))
    spread = areas.select("name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "radius_miles", F.explode(xs).alias("_x"), ys.alias("_ys")).withColumn("_y", F.explode("_ys")).drop("_ys")
    met = points.select(key, "lat", "lon", cell(F.col("lat"), size).alias("_x"), cell(F.col("lon"), size).alias("_y")).join(spread, ["_x", "_y"])
    gap = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) - F.col("radius_miles")
    best = met.withColumn("_gap", gap).filter(F.col("_gap") <= beyond).groupBy(key).agg(F.min(F.struct(F.col("_gap").alias("gap"), "name")).alias("_b"))
    return best.select(key, F.col("_b.name").alias("name"), F.col("_b.gap").alias("gap"))


def overlap_share(areas: DataFrame, boxes: DataFrame, key: str = "area_id", size: float = 0.5) -> DataFrame:
    """(key, share): how much of each box (s, w, n, e) the other boxes cover, added up and at most 1."""
    def spread(df: DataFrame, *keep: str) -> DataFrame:
        xs, ys = F.sequence(cell(F.col("s"), size), cell(F.col("n"), size)), F.sequence(cell(F.col("w"), size), cell(F.col("e"), size))
        return df.select(*keep, "s", "w", "n", "e", F.explode(xs).alias("_x"), ys.alias("_ys")).withColumn("_y", F.explode("_ys")).drop("_ys")

    other = spread(boxes.withColumn("_box", F.xxhash64("s", "w", "n", "e", "box_id")), "_box").select("_box", *(F.col(c).alias(f"_{c}") for c in "swne"), "_x", "_y")
    met = spread(areas, key).join(other, ["_x", "_y"])
    high, wide = F.least("n", "_n") - F.greatest("s", "_s"), F.least("e", "_e") - F.greatest("w", "_w")
    # Two boxes may meet in several cells: each pair counts once.
    pairs = met.filter((high > 0) & (wide > 0)).groupBy(key, "_box").agg(F.first(high * wide).alias("_in"), F.first((F.col("n") - F.col("s")) * (F.col("e") - F.col("w"))).alias("_all"))
    found = pairs.groupBy(key).agg(F.least(F.sum("_in") / F.first("_all"), F.lit(1.0)).alias("share"))
    return areas.select(key).join(found, key, "left").fillna({"share": 0.0})


def coverage_status(share: Column) -> Column:
    return F.when(share >= 0.99, "missed").when(share <= 0.01, "searched").otherwise("partly")


def towns_in(towns: DataFrame, lat: float, lon: float, miles: float, most: int) -> DataFrame:
    """The largest towns of a circle."""
    away = haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return towns.filter(away <= miles).orderBy(F.desc("radius_miles"), "name").limit(most)


#: Points of a circle's outline; towns that an area names after its own.
CIRCLE_POINTS, TOWNS = 180, 3


def coverage_areas(circles: DataFrame, towns: DataFrame, key: str = "company", side: float = 20.0, size: float = 0.5) -> DataFrame:
    """(key, n, name, towns, s, w, n_, e, outline, label) of circles (key, lat, lon, miles): the areas that a search of each asks, and how a map shows them.

    A circle's bounding square is cut into boxes of at most side miles. Boxes that reach into the circle are numbered, the
    nearest to its centre first, cut to the circle (outline), and named by their largest town in the circle (towns: name, lat,
    lon, radius_miles, place), else by where they lie; the next largest are listed. The label stands at the outline's centre of
    area, or below the circle's own centre in the box that holds it. Boxes of fewer than three corners in the circle are left out.
    """
    lat, lon = F.col("lat"), F.col("lon")
    m = F.greatest(F.lit(1), F.ceil(2 * F.col("miles") / side).cast("int"))
    dlat = F.col("miles") / DEGREE_MILES
    dlon = dlat / F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    rows = circles.select(key, "lat", "lon", "miles", dlat.alias("dlat"), dlon.alias("dlon"), m.alias("m"), grid.alias("g"))
    edge = lambda low, span, k: low - span + k * (2 * span / F.col("m"))
    rows = rows.withColumns({"s": edge(lat, F.col("dlat"), F.col("g.i")), "w": edge(lon, F.col("dlon"), F.col("g.j")), "n_": edge(lat, F.col("dlat"), F.col("g.i") + 1), "e": edge(lon, F.col("dlon"), F.col("g.j") + 1)})
    mid_lat, mid_lon = (F.col("s") + F.col("n_")) / 2, (F.col("w") + F.col("e")) / 2
    near = haversine(lat, lon, F.greatest("s", F.least("n_", lat)), F.greatest("w", F.least("e", lon)))
    rows = rows.withColumns({"near": near, "mid": haversine(lat, lon, mid_lat, mid_lon)}).filter(F.col("near") <= F.col("miles"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("near", "mid", "g")))  # a circle has few boxes
    box = F.struct("s", "w", F.col("n_").alias("n"), "e")
    rows = rows.withColumn("outline", clipped(flat_circle(lat, lon, F.col("miles"), CIRCLE_POINTS), box)).filter(F.size("outline") >= 3)
    # Towns meet the boxes in cells.
    xs, ys = F.sequence(cell(F.col("s"), size), cell(F.col("n_"), size)), F.sequence(cell(F.col("w"), size), cell(F.col("e"), size))
    spread = rows.select(key, "n", "s", "w", "n_", "e", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "miles", F.explode(xs).alias("_x"), ys.alias("_ys")).withColumn("_y", F.explode("_ys"))
    at = towns.select(F.col("name").alias("town"), "lat", "lon", "radius_miles", "place", cell(F.col("lat"), size).alias("_x"), cell(F.col("lon"), size).alias("_y"))
    inside = F.col("lat").between(F.col("s"), F.col("n_")) & F.col("lon").between(F.col("w"), F.col("e")) & (haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= F.col("miles"))
    order = W.partitionBy(key, "n").orderBy(F.desc("radius_miles"), "place")
    best = spread.join(at, ["_x", "_y"]).filter(inside).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= TOWNS + 1)
    best = best.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("_r", "town"))).alias("_t")).select(key, "n", F.transform("_t", lambda t: t["town"]).alias("_towns"))
    rows = rows.join(best, [key, "n"], "left").withColumn("_towns", F.coalesce("_towns", F.array().cast("array<string>")))
    holds = lat.between(F.col("s"), F.col("n_")) & lon.between(F.col("w"), F.col("e"))
    named = F.coalesce(F.try_element_at("_towns", F.lit(1)), F.when(holds, "the area around the search's center").otherwise(F.concat(F.lit("the area to the "), compass_word(bearing(lat, lon, mid_lat, mid_lon)))))
    middle = (F.col("s") < lat) & (lat < F.col("n_")) & (F.col("w") < lon) & (lon < F.col("e"))
    label = F.when(middle, F.struct((lat - (F.col("n_") - F.col("s")) / 4).alias("lat"), lon.alias("lon"))).otherwise(ring_centre(F.col("outline")))
    rows = rows.withColumn("_name", named)
    return rows.select(
        key, "n", F.concat(F.upper(F.substring("_name", 1, 1)), F.substring("_name", 2, 1_000_000)).alias("name"),
        F.slice(F.filter("_towns", lambda t: t != F.col("_name")), 1, TOWNS).alias("towns"), "s", "w", "n_", "e", "outline", label.alias("label"))


def request_plan(phrases: DataFrame, cells: DataFrame, pages: int, budget: int) -> DataFrame:
    """(page, cell, phrase, turn): pages of searches breadth first, up to a budget of requests."""
    every = phrases.crossJoin(cells).select("phrase", "cell", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    return every.orderBy("page", "cell", "phrase").limit(budget).withColumn("turn", F.row_number().over(W.orderBy("page", "cell", "phrase")))


def missing_parts(planned: DataFrame, answered: DataFrame, key: str = "part") -> DataFrame:
    return planned.join(answered.select(key).distinct(), key, "left_anti")


def far_listings(listings: DataFrame, lat: float, lon: float, miles: float, worked_on: DataFrame, key: str = "uid") -> DataFrame:
    """Listings out of the area that nobody has worked on, the farthest first."""
    away = haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return listings.withColumn("miles", away).filter(F.col("miles") > miles).join(worked_on.select(key).distinct(), key, "left_anti").orderBy(F.desc("miles"), F.lower("name"), key)
