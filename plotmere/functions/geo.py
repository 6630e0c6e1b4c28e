"""Geography as columns: distances in miles, circles, boxes and grid cells in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius and a degree of latitude, in miles.
EARTH_MILES, DEGREE_MILES = 3958.8, 69.0
COMPASS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(a * a + F.cos(p1) * F.cos(p2) * b * b))


def offset_point(lat: Column, lon: Column, miles: Column, bearing: Column) -> Column:
    """The point so far away in a direction (degrees from north), as a struct of lat and lon."""
    d, p, t = miles / EARTH_MILES, F.radians(lat), F.radians(bearing)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    turn = F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), (lon + F.degrees(turn)).alias("lon"))


def circle(lat: Column, lon: Column, miles: Column, points: int = 180) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: offset_point(lat, lon, miles, i * (360.0 / points)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360, for near points."""
    x, y = (lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def compass_word(degrees: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, COMPASS)), (F.bround(degrees / 45) % 8 + 1).cast("int"))


def lon_degrees(miles: Column, lat: Column) -> Column:
    """Degrees of longitude for miles at a latitude."""
    return miles / DEGREE_MILES / F.greatest(F.lit(0.2), F.cos(F.radians(lat)))


def grown_box(box: Column, miles: float) -> Column:
    """A struct s, w, n, e with a margin around it."""
    d = F.lit(miles / DEGREE_MILES)
    dl = lon_degrees(F.lit(float(miles)), (box["s"] + box["n"]) / 2)
    return F.struct((box["s"] - d).alias("s"), (box["w"] - dl).alias("w"), (box["n"] + d).alias("n"), (box["e"] + dl).alias("e"))


def in_box(lat: Column, lon: Column, box: Column) -> Column:
    return lat.between(box["s"], box["n"]) & lon.between(box["w"], box["e"])


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over an array of structs lat, lon; the last point joins the first."""
    pairs = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda p: ((p["a"]["lat"] > lat) != (p["b"]["lat"] > lat)) & (lon < (p["b"]["lon"] - p["a"]["lon"]) * (lat - p["a"]["lat"]) / (p["b"]["lat"] - p["a"]["lat"]) + p["a"]["lon"])
    return F.size(F.filter(pairs, crosses)) % 2 == 1


def cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size)).cast("long")


def near_cells(lat: Column, lon: Column, size: float, reach: int = 1) -> Column:
    """The cell of a point and those around it, as structs x, y."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    one = lambda dx, dy: F.struct((cell(lat, size) + dx).alias("x"), (cell(lon, size) + dy).alias("y"))
    return F.flatten(F.transform(steps, lambda dx: F.transform(steps, lambda dy: one(dx, dy))))


def has_position(lat: Column, lon: Column) -> Column:
    """A point on the map: no null or NaN, in range, not 0, 0."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


# For 1, 7 or 19 circles that cover a circle, the share of its radius that each has, then each ring's distance (as a share) and number.
GRIDS = {1: (1.0, [(0.0, 1)]), 7: (0.5, [(0.0, 1), (0.6, 6)]), 19: (0.3, [(0.0, 1), (0.4, 6), (0.78, 12)])}


def search_cells(lat: Column, lon: Column, miles: Column, cells: int) -> Column:
    """1, 7 or 19 circles that cover a circle, as an array of structs lat, lon, miles: one in the middle and rings around it."""
    share, rings = GRIDS[1 if cells <= 1 else 7 if cells <= 7 else 19]
    spots = F.array(*(F.struct(F.lit(far).alias("far"), F.lit(360.0 / count * k).alias("turn")) for far, count in rings for k in range(count)))
    middle = F.struct(lat.alias("lat"), lon.alias("lon"))
    at = lambda s: F.when(s["far"] == 0, middle).otherwise(offset_point(lat, lon, miles * s["far"], s["turn"]))
    return F.transform(spots, lambda s: F.struct(at(s)["lat"].alias("lat"), at(s)["lon"].alias("lon"), (miles * share).alias("miles")))


# ---------------------------------------------------------------- rings


def flat_circle(lat: Column, lon: Column, miles: Column, points: int = 180) -> Column:
    """A circle as an array of structs lat, lon, on a flat reckoning: it touches the edges of its bounding square."""
    dlat, dlon = miles / DEGREE_MILES, miles / DEGREE_MILES / F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
    turn = lambda i: i * (2 * math.pi / points)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct((lat + dlat * F.cos(turn(i))).alias("lat"), (lon + dlon * F.sin(turn(i))).alias("lon")))


def _once(value: Column, use) -> Column:
    """use(value), where value is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _sides(ring: Column) -> Column:
    """Each point of a ring with the one before it."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))
    return F.when(F.size(ring) > 0, F.zip_with(before, ring, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())


def _half(ring: Column, axis: str, limit: Column, above: bool) -> Column:
    """The part of a ring on one side of a line: sides that cross it are cut there."""
    inside = lambda p: p[axis] >= limit if above else p[axis] <= limit

    def crossing(a: Column, b: Column) -> Column:
        t = (limit - a[axis]) / (b[axis] - a[axis])
        return F.struct((a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"), (a["lon"] + t * (b["lon"] - a["lon"])).alias("lon"))

    def kept(side: Column) -> Column:
        a, b = side["a"], side["b"]
        cut = F.when(inside(a) != inside(b), F.array(crossing(a, b))).otherwise(F.slice(F.array(a), 1, 0))
        return F.concat(cut, F.when(inside(b), F.array(b)).otherwise(F.slice(F.array(b), 1, 0)))

    return F.flatten(F.transform(_sides(ring), kept))


def clipped(ring: Column, box: Column) -> Column:
    """The part of a convex ring (array of structs lat, lon) inside a box (struct s, w, n, e): one edge after the other cuts it."""
    edges = (("lat", "s", True), ("lat", "n", False), ("lon", "w", True), ("lon", "e", False))
    cut = lambda r, k: r if k == len(edges) else _once(_half(r, edges[k][0], box[edges[k][1]], edges[k][2]), lambda v: cut(v, k + 1))
    return _once(ring, lambda r: cut(r, 0))


def ring_centre(ring: Column) -> Column:
    """A ring's centre of area; the mean of its points where it has no area; null for no points."""
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))

    def add(so_far: Column, side: Column) -> Column:
        a, b = side["a"], side["b"]
        step = a["lon"] * b["lat"] - b["lon"] * a["lat"]
        return F.struct((so_far["area"] + step).alias("area"), (so_far["lat"] + (a["lat"] + b["lat"]) * step).alias("lat"), (so_far["lon"] + (a["lon"] + b["lon"]) * step).alias("lon"))

    def centre(r: Column, found: Column) -> Column:
        mean = lambda c: F.aggregate(r, F.lit(0.0), lambda s, p: s + p[c]) / F.size(r)
        of = lambda c: F.when(F.abs(found["area"]) < 1e-12, mean(c)).otherwise(found[c] / (3 * found["area"])).alias(c)
        return F.when(F.size(r) > 0, F.struct(of("lat"), of("lon")))

    return _once(ring, lambda r: _once(F.aggregate(_sides(r), zero, add), lambda found: centre(r, found)))
