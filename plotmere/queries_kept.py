"""Queries over the list that is kept between requests, areas, towns, boxes in rounds and decisions, with the SQL of each beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmere.functions import geo
from plotmere.functions.number import exact_round
from plotmere.functions.text import split_address
from plotmere.operators import fill, marks, places, saved, stats, towns
from plotmere.operators.shared import shared_folder
from plotmere.queries import _AREAS, _LISTINGS, _SCORED, LAT, LON, _areas, _as_entities, _miles, _query, _table, listings, scored
from plotmere.queries_columns import _pick
from plotmere.streaming import decisions
from plotmere.streaming.kept_list import KeptList

# ---------------------------------------------------------------- the kept list

#: Times at which the log is cut: what came up to the first builds the list, the rest comes in two batches.
_CUTS = ["2024-01-12 00:00:00", "2024-01-22 00:00:00"]
_KINDS = "CASE event_type WHEN 'purchase' THEN 'mark' WHEN 'error' THEN 'mark' WHEN 'view' THEN 'contact' ELSE 'call' END"
_VALUES = "CASE event_type WHEN 'purchase' THEN 'yes' WHEN 'error' THEN 'no' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN '' ELSE '8015550100' END ELSE event_type END"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, calls and contacts by user; of every tenth event that is a mark there is an undo too."""
    e = _table(spark, sf_dir, "events").filter("user_id is not null")
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("uid"), F.col("ts").cast("timestamp").alias("at"), F.expr(_KINDS).alias("kind"), F.expr(_VALUES).alias("value"), "event_id")
    undone = rows.filter("kind = 'mark' and event_id % 10 = 0").select(F.concat(F.lit("u"), "id"), "uid", "at", F.lit("undo"), "id", "event_id")
    return rows.union(undone).drop("event_id")


def _kept(spark: SparkSession, sf_dir: str) -> KeptList:
    def rows() -> DataFrame:
        away = geo.haversine(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))
        return scored(spark, sf_dir).select(
            "uid", "name", F.when(F.col("sqft") % 3 == 0, "").otherwise("801555").alias("phone"), "score", exact_round(away, 6).alias("distance_miles"), F.when(F.col("nation") == 24, "Competitor").otherwise("Prospect").alias("lead_type"),
            F.when(F.col("reviews") < 0, "CLOSED_PERMANENTLY").otherwise("").alias("business_status"))

    log, at = _log(spark, sf_dir), [F.lit(t).cast("timestamp") for t in _CUTS]
    kept = KeptList(spark, shared_folder(spark, "kept"), rows, lambda: log.filter(F.col("at") <= at[0]))
    kept.build()
    kept.apply(log.filter((F.col("at") > at[0]) & (F.col("at") <= at[1])), 0)
    kept.apply(log.filter(F.col("at") > at[1]), 1)
    return kept


_LIVE = f"SELECT 'c' || user_id AS uid, ts, CAST(event_id AS VARCHAR) AS id, {_KINDS} AS kind, {_VALUES} AS value FROM events WHERE user_id IS NOT NULL AND NOT (event_type IN ('purchase', 'error') AND event_id % 10 = 0)"
_FIELDS = f"SELECT uid, arg_max(value, (ts, id)) FILTER (kind = 'mark') AS mark, count(*) FILTER (kind = 'call') AS calls, arg_max(value, (ts, id)) FILTER (kind = 'call') AS outcome, arg_max(value, (ts, id)) FILTER (kind = 'contact') AS verified FROM ({_LIVE}) GROUP BY uid"
_KEPT = f"""SELECT uid, name, score, coalesce(mark, '') AS mark, coalesce(calls, 0) AS calls, round(miles, 6) AS miles, sqft % 3 <> 0 OR coalesce(verified, '') <> '' AS phone,
list_filter(['all', CASE WHEN calls > 0 THEN 'called' END, CASE WHEN calls > 0 THEN 'called:' || outcome END, CASE WHEN reviews < 0 THEN 'closed' END, CASE WHEN nation = 24 THEN 'competitors' WHEN coalesce(mark, '') <> '' THEN mark WHEN reviews >= 0 THEN 'unchecked' END], lambda x: x IS NOT NULL) AS tabs
FROM (SELECT *, {_miles('40.5', '-111.5', 'lat', 'lon')} AS miles FROM ({_SCORED})) LEFT JOIN ({_FIELDS}) USING (uid)"""


@_query(f"SELECT uid, mark, calls, CAST(row_number() OVER (ORDER BY score DESC, phone DESC, miles, lower(name), uid) AS BIGINT) AS rank FROM ({_KEPT}) WHERE list_contains(tabs, 'unchecked') QUALIFY rank BETWEEN 31 AND 150")
def kept_list_page(spark, sf_dir):
    """A page of the list after two batches of clicks: no request sorts the list."""
    return _kept(spark, sf_dir).page("unchecked", 30, 120).select("uid", "mark", "calls", "rank")


@_query(f"SELECT tab, count(*) AS n FROM (SELECT unnest(tabs) AS tab FROM ({_KEPT})) GROUP BY tab")
def kept_list_counts(spark, sf_dir):
    """Tabs and outcomes of the list after two batches, from counts that the batches changed."""
    kept = _kept(spark, sf_dir)
    return kept._counts(kept.current()).groupBy("tab").agg(F.sum("n").alias("n"))


@_query("""WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS u, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL),
s AS (SELECT u, r, id, true AS ok, [us] AS kept FROM e WHERE r = 1
UNION ALL SELECT u, r, id, ok, CASE WHEN ok THEN list_append(kept, us) ELSE kept END FROM (SELECT e.*, len(list_filter(s.kept, lambda t: e.us - t < 259200000000)) < 4 AS ok, s.kept FROM s JOIN e ON e.u = s.u AND e.r = s.r + 1))
SELECT id AS event_id, ok AS allowed FROM s""")
def budget_decisions(spark, sf_dir):
    """Four calls in three days for each user, decided in three batches as they come."""
    e = _table(spark, sf_dir, "events").filter("user_id is not null").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    made, at = decisions.budget(spark, shared_folder(spark, "budget"), 4, "user_id", "ts", "event_id", 259_200), [F.lit(t).cast("timestamp") for t in _CUTS]
    for number, part in enumerate((F.col("ts") <= at[0], (F.col("ts") > at[0]) & (F.col("ts") <= at[1]), F.col("ts") > at[1])):
        made.apply(e.filter(part), number)
    return made.decided().select("event_id", "allowed")


# ---------------------------------------------------------------- areas and boxes


def _circles(spark, sf_dir):
    return _areas(spark, sf_dir).select(F.col("n_nationkey").alias("company"), "lat", "lon", (F.lit(8.0) + F.col("n_nationkey") % 4 * 9).alias("miles"))


def _sites(spark, sf_dir):
    """Suppliers as towns of one to five miles."""
    rows = listings(spark, sf_dir).filter("uid like 's%'").withColumn("place", F.substring("uid", 2, 20).cast("long"))
    return rows.select("name", "lat", "lon", (F.lit(1.0) + F.col("place") % 5).alias("radius_miles"), "place")


@_query()
def coverage_areas(spark, sf_dir):
    """Areas of circles around nations, cut and named; tested against plain clipping."""
    found = places.coverage_areas(_circles(spark, sf_dir), _sites(spark, sf_dir))
    return found.select("company", "n", "name", F.array_join("towns", "; ").alias("towns"), "s", "w", "n_", "e", F.size("outline").alias("corners"), F.round("label.lat", 6).alias("label_lat"), F.round("label.lon", 6).alias("label_lon"))


@_query(f"""SELECT company, CAST(row_number() OVER (PARTITION BY company ORDER BY near, mid, i, j) AS INTEGER) AS n, round(s, 6) AS s, round(w, 6) AS w, round(n_, 6) AS n_, round(e, 6) AS e FROM (SELECT *, {_miles('lat', 'lon', 'greatest(s, least(n_, lat))', 'greatest(w, least(e, lon))')} AS near, {_miles('lat', 'lon', '(s + n_) / 2', '(w + e) / 2')} AS mid
FROM (SELECT *, lat - dy + i * (2 * dy / m) AS s, lon - dx + j * (2 * dx / m) AS w, lat - dy + (i + 1) * (2 * dy / m) AS n_, lon - dx + (j + 1) * (2 * dx / m) AS e FROM (SELECT *, unnest(range(m)) AS j FROM (SELECT *, unnest(range(m)) AS i
FROM (SELECT n_nationkey AS company, lat, lon, miles, miles / 69.0 AS dy, miles / 69.0 / cos(radians(lat)) AS dx, CAST(ceil(2 * miles / 20) AS INTEGER) AS m FROM (SELECT *, 8.0::DOUBLE + n_nationkey % 4 * 9 AS miles FROM ({_AREAS}))))))) WHERE near <= miles""")
def circle_parts(spark, sf_dir):
    """The boxes that a search of each circle asks, the nearest to its centre first."""
    found = places.coverage_areas(_circles(spark, sf_dir), _sites(spark, sf_dir))
    return found.select("company", "n", *(F.round(c, 6).alias(c) for c in ("s", "w", "n_", "e")))


_RINGS = {1: [(0.0, 1, 1.0)], 7: [(0.0, 1, 0.5), (0.6, 6, 0.5)], 19: [(0.0, 1, 0.3), (0.4, 6, 0.3), (0.78, 12, 0.3)]}
_CELLS = ", ".join(f"({cells}, {far}, {count}, {k}, {share})" for cells, rings in _RINGS.items() for far, count, share in rings for k in range(count))


@_query(f"""SELECT company, cells, round(t, 7) AS lat, round(lon + degrees(atan2(sin(b) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(radians(t)))), 7) AS lon, round(r, 9) AS miles
FROM (SELECT *, degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(b))) AS t FROM (SELECT company, cells, lat, lon, m * far / 3958.8 AS d, radians(360.0 / n * k) AS b, m * share AS r
FROM (SELECT n_nationkey AS company, lat, lon, 8.0::DOUBLE + n_nationkey % 4 * 9 AS m FROM ({_AREAS})), (VALUES {_CELLS}) v(cells, far, n, k, share)))""")
def search_grids(spark, sf_dir):
    """The circles of one, seven and nineteen that cover each nation's circle."""
    circles, out = _circles(spark, sf_dir), None
    for cells in (1, 7, 19):
        one = circles.select("company", F.lit(cells).alias("cells"), F.explode(geo.search_cells(F.col("lat"), F.col("lon"), F.col("miles"), cells)).alias("c"))
        out = one if out is None else out.union(one)
    return out.select("company", "cells", F.round("c.lat", 7).alias("lat"), F.round("c.lon", 7).alias("lon"), F.round("c.miles", 9).alias("miles"))


#: Listings that a box, and a quarter, may hold to be answered.
_FULL, _QUARTER = 6, 2
_BOX = f"SELECT n_nationkey AS area, lat - 0.1 AS s, lon - 0.1 AS w, lat + 0.1 AS n, lon + 0.1 AS e FROM ({_AREAS})"
_INSIDE = f"SELECT area, s, w, n, e, count(uid) AS k FROM ({{}}) b LEFT JOIN ({_LISTINGS}) l ON l.lat >= s AND l.lat < n AND l.lon >= w AND l.lon < e GROUP BY ALL"
_QUARTERS = f"SELECT area, s + i * (n - s) / 2 AS s, w + j * (e - w) / 2 AS w, s + (i + 1) * (n - s) / 2 AS n, w + (j + 1) * (e - w) / 2 AS e FROM ({_INSIDE.format(_BOX)}), range(2) a(i), range(2) b(j) WHERE k > {_FULL}"


@_query(f"SELECT area, CAST(coalesce(k, 0) AS BIGINT) AS n, coalesce(share, 0.0)::DOUBLE AS share FROM ({_BOX}) LEFT JOIN (SELECT area, sum(k) AS k, 0.0 AS share FROM ({_INSIDE.format(_BOX)}) WHERE k <= {_FULL} GROUP BY area UNION ALL SELECT area, sum(k) FILTER (k <= {_QUARTER}), count(*) FILTER (k > {_QUARTER}) / 4.0 FROM ({_INSIDE.format(_QUARTERS)}) GROUP BY area) USING (area)")
def boxes_in_rounds(spark, sf_dir):
    """Boxes of nations that fail where they hold too many listings: asked in quarters once, and twice over what is left."""
    rows = listings(spark, sf_dir).select("uid", "lat", "lon")

    def ask(parts: DataFrame) -> DataFrame:
        xs, ys = F.sequence(geo.cell(F.col("s"), 0.5), geo.cell(F.col("n"), 0.5)), F.sequence(geo.cell(F.col("w"), 0.5), geo.cell(F.col("e"), 0.5))
        spread = parts.select(*fill.PART, F.explode(xs).alias("x"), ys.alias("ys")).withColumn("y", F.explode("ys")).drop("ys")
        met = spread.join(rows.withColumns({"x": geo.cell(F.col("lat"), 0.5), "y": geo.cell(F.col("lon"), 0.5)}), ["x", "y"]).filter("lat >= s and lat < n and lon >= w and lon < e")
        k = F.coalesce(F.col("k"), F.lit(0))
        found = parts.join(met.groupBy(*fill.PART).agg(F.count(F.lit(1)).alias("k")), fill.PART, "left")
        ok = F.when(F.col("depth") == 0, k <= _FULL).otherwise(k <= _QUARTER)
        return found.select(*fill.PART, ok.alias("ok"), k.cast("string").alias("answer"), F.when(ok, "").otherwise("too many").alias("error"))

    a = _areas(spark, sf_dir)
    areas = a.select(F.col("n_nationkey").alias("area"), (F.col("lat") - 0.1).alias("s"), (F.col("lon") - 0.1).alias("w"), (F.col("lat") + 0.1).alias("n"), (F.col("lon") + 0.1).alias("e"), F.lit(0).alias("depth"))
    done = fill.fill_in(areas, ask, 2)
    counts = done.found.groupBy("area").agg(F.sum(F.col("answer").cast("long")).alias("n"))
    return fill.missing_share(done.missing, areas).join(counts, "area", "left").fillna({"n": 0}).select("area", "n", "share")


# ---------------------------------------------------------------- towns and addresses

_SPELT = "CASE c_custkey % 5 WHEN 0 THEN lower(n_name) || '  City' WHEN 1 THEN n_name || ', UT' WHEN 2 THEN 'Nowhere ' || (c_custkey % 9) WHEN 3 THEN '' ELSE 'xq' END"
_NEAREST = f"(SELECT uid, arg_min(name, (gap, name)) AS near FROM (SELECT uid, a.name, {_miles('round(l.lat, 4)', 'round(l.lon, 4)', 'a.lat', 'a.lon')} - radius_miles AS gap FROM ({_LISTINGS}) l JOIN ({_AREAS}) a ON true) WHERE gap <= 15 GROUP BY uid)"


@_query(f"""SELECT uid, listed AS listed_town, CASE WHEN listed <> '' THEN listed ELSE coalesce(near, '') END AS town, CASE WHEN (listed = '' OR zip = '') AND near IS NOT NULL THEN 'near ' || near || ', UT' ELSE '' END AS near_text
FROM (SELECT 'c' || c_custkey AS uid, CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN 'Nowhere ' || (c_custkey % 9) ELSE '' END AS listed, CASE WHEN c_custkey % 2 = 0 THEN '84001' ELSE '' END AS zip FROM customer JOIN nation ON c_nationkey = n_nationkey) LEFT JOIN {_NEAREST} USING (uid)""")
def towns_of_listings(spark, sf_dir):
    """Customers' towns as their nation's name is spelt, among nations as towns."""
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = _table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uid"), F.expr(_SPELT).alias("city"), F.lit("ut").alias("state"), F.when(F.col("c_custkey") % 2 == 0, "84001").otherwise("").alias("zip"))
    rows = rows.join(listings(spark, sf_dir).select("uid", "lat", "lon"), "uid")
    table = _areas(spark, sf_dir).select("name", F.lit("UT").alias("state"), "lat", "lon", "radius_miles", F.col("n_nationkey").alias("place"))
    return towns.with_towns(rows, table, spark.createDataFrame([], "zip string, lat double, lon double, radius_miles double")).select("uid", "listed_town", "town", "near_text")


_ADDRESS = ["{} South Main Street", "{} S. Main St, Suite 4", "{} Main Street", "1{} S Main St"]


@_query(f"""SELECT DISTINCT uid FROM (SELECT 'c' || c_custkey AS uid, CASE WHEN c_custkey % 4 = 3 THEN CAST('1' || (c_custkey % 30) AS BIGINT) ELSE c_custkey % 30 END AS house, c_custkey % 4 <> 2 AS south, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n_name END AS town FROM customer JOIN nation ON c_nationkey = n_nationkey) c
JOIN (SELECT s_suppkey % 40 AS house, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE '' END AS stands FROM supplier JOIN nation ON s_nationkey = n_nationkey) f ON f.house = c.house AND c.south AND (town = '' OR stands = '' OR stands = town)""")
def parents_by_address(spark, sf_dir):
    """Customers that stand at a supplier's address, written in other ways."""
    n = F.broadcast(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 nations
    c = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    rows = c.select(F.concat(F.lit("c"), k.cast("string")).alias("uid"), F.replace(_pick(_ADDRESS, k), F.lit("{}"), (k % 30).cast("string")).alias("address"), F.when(k % 3 == 0, "").otherwise(F.col("n_name")).alias("listed_town"))
    s = _table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    known = s.select(F.concat((F.col("s_suppkey") % 40).cast("string"), F.lit(" south MAIN st")).alias("street"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise("").alias("town"))
    return towns.at_facilities(rows, known)


# ---------------------------------------------------------------- numbers and saved rows


@_query("SELECT l_orderkey, l_linenumber, ((25 * v) // 2 + CASE WHEN (25 * v) % 2 = 1 AND ((25 * v) // 2) % 2 = 1 THEN 1 ELSE 0 END) / 100.0::DOUBLE AS rounded FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS v FROM lineitem)")
def rounded_as_they_are(spark, sf_dir):
    """Eighths with two digits: ties go to the even one."""
    v = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) / F.lit(8.0)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", exact_round(v, 2).alias("rounded"))


@_query()
def saved_duplicates(spark, sf_dir):
    """Saved rows that are one business: suppliers and customers as listings, two or three to a row; tested against a sequential scan."""
    near = lambda c, zero: F.lit(zero) + (F.col(c) - zero) / 20
    parts = _as_entities(spark, sf_dir).withColumns({"lat": near("lat", 40.0), "lon": near("lon", -112.0)})
    rows = parts.withColumn("uid", F.concat(F.lit("r"), F.floor(F.col("rid") / 2).cast("string")))
    seen = rows.groupBy("uid").agg(F.min("rid").alias("first_seen"))
    return saved.same_business(seen, rows.drop("rid"))




@_query()
def decided_clicks(spark, sf_dir):
    """Purchases and errors as clicks of yes and no, views as undos of the event before; tested against one pass."""
    e = _table(spark, sf_dir, "events").filter("event_type in ('purchase', 'error', 'view')")
    k = F.col("event_id")
    actions = e.select(
        k.cast("string").alias("id"), (k % 40).cast("string").alias("uid"), F.col("ts").alias("at"), F.when(F.col("event_type") == "view", "undo").otherwise("click").alias("kind"),
        F.when(F.col("event_type") == "purchase", "yes").when(F.col("event_type") == "error", "no").otherwise((k - 40).cast("string")).alias("value"), F.col("user_id").cast("string").alias("by"), F.when(k % 3 > 0, F.when(k % 2 == 0, "yes").otherwise("")).alias("was"))
    return marks.decided(actions, _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("uid"))).select("id", "outcome", "previous")


@_query("""SELECT uid, value, arg_max(coalesce(name, ''), (ts, id)) AS by_whom, max(ts) AS seen_at FROM (SELECT 'c' || o_custkey AS uid, o_orderstatus AS value, o_orderdate AS ts, o_orderkey AS id, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_orderkey % 4000) GROUP BY ALL""")
def answers_given_by(spark, sf_dir):
    """Who gave each answer last: changes joined with their makers."""
    o = _table(spark, sf_dir, "orders")
    clicks = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("uid"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("at"), F.lit(None).cast("timestamp").alias("undone_at"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    makers = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4000).alias("k")).join(c, "k").select("id", "name")
    return marks.given_by(clicks, makers).select("uid", "value", F.col("by").alias("by_whom"), F.col("at").alias("seen_at"))


# ---------------------------------------------------------------- maps and downloads

_GROUP = "CASE WHEN nation = 24 THEN 'competitor' WHEN sqft % 5 = 0 THEN 'yes' WHEN sqft % 5 = 1 THEN 'no' ELSE 'unchecked' END"
_PLACED = f"""SELECT uid, lat, lon, grp, x, y, CAST(floor(x * 512.0 / 56) AS BIGINT) AS cx, CAST(floor(y * 512.0 / 56) AS BIGINT) AS cy
FROM (SELECT *, (lon + 180) / 360 * 256 AS x, (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256 AS y FROM (SELECT uid, lat, lon, {_GROUP} AS grp FROM ({_LISTINGS})))"""


@_query(f"SELECT cx, cy, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, CASE WHEN count(*) = 1 THEN min(uid) END AS uid, count(*) FILTER (grp = 'unchecked') AS unchecked, count(*) FILTER (grp = 'yes') AS yes, count(*) FILTER (grp = 'competitor') AS competitor FROM ({_PLACED}) GROUP BY cx, cy")
def map_circles(spark, sf_dir):
    """Circles and single pins of a map at zoom 9, with the groups in each."""
    pins = listings(spark, sf_dir).withColumn("grp", F.expr(_GROUP))
    return stats.map_marks(pins, 9).select("cx", "cy", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "uid", "unchecked", "yes", "competitor")


@_query(f"""SELECT uid, CASE WHEN listed <> '' THEN listed WHEN near IS NOT NULL THEN 'near ' || near ELSE '' END AS city, CASE WHEN k % 7 > 0 THEN 'UT' WHEN (listed = '' OR zip = '') AND near IS NOT NULL THEN 'UT' ELSE '' END AS state, CASE WHEN zip <> '' THEN zip WHEN near IS NOT NULL THEN 'near 84' || (CAST(nearest AS BIGINT) + 100) ELSE '' END AS zip
FROM (SELECT c_custkey AS k, 'c' || c_custkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n_name END AS listed, CASE WHEN c_custkey % 2 = 0 THEN '84001' ELSE '' END AS zip FROM customer JOIN nation ON c_nationkey = n_nationkey) LEFT JOIN {_NEAREST} USING (uid)
LEFT JOIN (SELECT name AS near, n_nationkey AS nearest FROM ({_AREAS})) USING (near)""")
def places_in_downloads(spark, sf_dir):
    """City, state and ZIP as a download shows them; ZIP areas lie where the towns do."""
    n = F.broadcast(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 nations
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.concat(F.lit("c"), k.cast("string")).alias("uid"), F.when(k % 3 == 0, "").otherwise(F.col("n_name")).alias("city"), F.when(k % 7 > 0, "Utah").otherwise("").alias("state"), F.when(k % 2 == 0, "84001").otherwise("").alias("zip"))
    rows = rows.join(listings(spark, sf_dir).select("uid", "lat", "lon"), "uid")
    table = _areas(spark, sf_dir).select("name", F.lit("UT").alias("state"), "lat", "lon", "radius_miles", F.col("n_nationkey").alias("place"))
    zips = table.select(F.concat(F.lit("84"), (F.col("place") + 100).cast("string")).alias("zip"), "lat", "lon", "radius_miles")
    return towns.place_columns(towns.with_towns(rows, table, zips)).select("uid", F.col("shown_city").alias("city"), F.col("shown_state").alias("state"), F.col("shown_zip").alias("zip"))


_WHOLE = ["{} Main St, Provo, UT 84601", "{} Main St, Orem UT 84057-1234", "{} Main St", "{} Elm St, Suite 4, Magna 84044", "{} Elm St, Lehi"]


@_query(f"""SELECT c_custkey, CASE WHEN own = '' THEN ['Provo', 'Orem', '', 'Suite 4', 'Lehi'][c_custkey % 5 + 1] ELSE own END AS city, ['84601', '84057', '', '84044', ''][c_custkey % 5 + 1] AS zip FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Sandy' ELSE '' END AS own FROM customer)""")
def addresses_in_one_column(spark, sf_dir):
    k = F.col("c_custkey")
    city, zip5 = split_address(F.replace(_pick(_WHOLE, k), F.lit("{}"), k.cast("string")), F.when(k % 3 == 0, "Sandy").otherwise(""), F.lit(""))
    return _table(spark, sf_dir, "customer").select("c_custkey", city.alias("city"), zip5.alias("zip"))
