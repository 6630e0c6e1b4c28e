"""Statistics of a list: conversion by tier, funnels, clusters of pins, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmere.operators.score import tier_of


def ratio(part: Column, whole: Column, scale: int = 1) -> Column:
    """scale * part / whole as a whole number, halves up; null where whole is 0."""
    part, whole = part.cast("long"), whole.cast("long")
    return F.when(whole != 0, F.floor((part * (2 * scale) + whole) / (whole * 2)).cast("long"))


def tier_conversion(listings: DataFrame) -> DataFrame:
    """(tier, checked, yes, pct, saved) for each of the four tiers, empty ones too; listings have tier and mark."""
    tiers = listings.sparkSession.createDataFrame([(t,) for t in "ABCD"], "tier string")
    yes, checked = F.col("mark") == "yes", F.col("mark").isin("yes", "no")
    found = listings.groupBy("tier").agg(F.count_if(checked).alias("checked"), F.count_if(yes).alias("yes"), F.count(F.lit(1)).alias("saved"))
    out = tiers.join(F.broadcast(found), "tier", "left").fillna(0)  # four rows
    return out.select("tier", "checked", "yes", ratio(F.col("yes"), F.col("checked"), 100).alias("pct"), "saved")


def summary(listings: DataFrame) -> DataFrame:
    """One row: with_equipment, checked, average_score of the yes rows (halves up) and its tier."""
    yes = F.col("mark") == "yes"
    out = listings.agg(F.count_if(yes).alias("with_equipment"), F.count_if(F.col("mark").isin("yes", "no")).alias("checked"), F.sum(F.when(yes, F.col("score"))).alias("_s"))
    average = ratio(F.coalesce("_s", F.lit(0)), F.col("with_equipment"))
    return out.select("with_equipment", "checked", average.alias("average_score"), F.when(average.isNotNull(), tier_of(average)).alias("average_tier"))


def funnel(listings: DataFrame) -> DataFrame:
    """One row of counts by disposition, tier and phone of scored listings."""
    one = lambda c, name: F.count_if(c).alias(name)
    kept = F.col("disposition") == "kept"
    return listings.agg(F.count(F.lit(1)).alias("merged"), *(one(F.col("disposition") == d, d) for d in ("kept", "closed", "low", "no_match")), *(one(kept & (F.col("tier") == t), f"tier_{t}") for t in "ABCD"))


def clusters(points: DataFrame, zoom: int, pixels: int = 60) -> DataFrame:
    """(cx, cy, n, lat, lon): pins by cells of so many pixels on a Web Mercator map of a zoom level."""
    size = 256.0 * 2**zoom
    y = F.lit(0.5) - F.log((1 + F.sin(F.radians("lat"))) / (1 - F.sin(F.radians("lat")))) / (4 * F.pi())
    x = (F.col("lon") + 180) / 360
    return points.groupBy(F.floor(x * size / pixels).alias("cx"), F.floor(y * size / pixels).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


#: Pixels of a square in which pins are one circle, the zoom from which they aren't, and pixels (at that zoom) of one spot.
SQUARE, UNTIL, SPOT = 56, 15, 6
GROUPS = ["unchecked", "no", "yes", "competitor"]


def map_marks(pins: DataFrame, zoom: int, square: int = SQUARE, until: int = UNTIL) -> DataFrame:
    """(uid, cx, cy, n, lat, lon, together, unchecked, no, yes, competitor): what a map of a zoom level draws of pins (uid, lat, lon, grp).

    Pins of one square are one circle (uid null) with how many each group has, at their mean place, where the zoom is below until
    or all of them lie at one spot (together); else each is drawn alone. Squares are aggregated before the shuffle; only the verdict of a square goes back to its pins.
    """
    y = F.lit(0.5) - F.log((1 + F.sin(F.radians("lat"))) / (1 - F.sin(F.radians("lat")))) / (4 * F.pi())
    rows = pins.select("uid", "lat", "lon", "grp", ((F.col("lon") + 180) / 360 * 256).alias("x"), (y * 256).alias("y"))
    rows = rows.withColumns({"cx": F.floor(F.col("x") * 2.0**zoom / square), "cy": F.floor(F.col("y") * 2.0**zoom / square)})
    wide = lambda c: (F.max(c) - F.min(c)) * 2.0**until < SPOT
    found = rows.groupBy("cx", "cy").agg(
        F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), (wide("x") & wide("y")).alias("together"), *(F.count_if(F.col("grp") == g).alias(g) for g in GROUPS)
    )
    found = found.withColumn("circle", (F.col("n") > 1) & (F.lit(zoom < until) | F.col("together")))
    circles = found.filter("circle").select(F.lit(None).cast("string").alias("uid"), "cx", "cy", "n", "lat", "lon", "together", *GROUPS)
    alone = rows.join(found.filter("not circle").select("cx", "cy"), ["cx", "cy"], "left_semi")
    one = alone.select("uid", "cx", "cy", F.lit(1).cast("long").alias("n"), "lat", "lon", F.lit(False).alias("together"), *((F.col("grp") == g).cast("long").alias(g) for g in GROUPS))
    return circles.union(one)


def town_counts(listings: DataFrame, most: int = 10, place: str = "place") -> DataFrame:
    """(town, n): the towns ("city, state", as far as they are listed) with the most listings; of equal ones the first in the order of place."""
    parts = F.concat_ws(", ", *(F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in ("city", "state")))
    named = listings.select(F.when(parts == "", "(no town listed)").otherwise(parts).alias("town"), place)
    found = named.groupBy("town").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_first"))
    return found.orderBy(F.desc("n"), "_first").limit(most).select("town", "n")


def separation(listings: DataFrame) -> DataFrame:
    """(tier, with, without) of listings known to have equipment or not, and the lowest with, the highest without."""
    have, lack = F.col("has_equipment"), ~F.col("has_equipment")
    return listings.groupBy("tier").agg(F.count_if(have).alias("n_with"), F.count_if(lack).alias("n_without"), F.min(F.when(have, F.col("score"))).alias("lowest_with"), F.max(F.when(lack, F.col("score"))).alias("highest_without"))


def latest_status(log: DataFrame) -> DataFrame:
    """A row for each source: the latest time and note of each outcome (ok, failed); log has source, outcome, at, note."""
    pick = lambda o: F.max_by(F.struct("at", "note"), F.when(F.col("outcome") == o, F.struct("at", "note"))).alias(o)
    return log.groupBy("source").agg(pick("ok"), pick("failed"))


def filled_columns(listings: DataFrame, optional: list[str]) -> list[str]:
    """The optional columns that hold a value in some row, from one aggregation."""
    if not optional:
        return []
    row = listings.agg(*(F.max(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in optional)).first()
    return [c for c in optional if row[c]]
