"""Queries that apply operators on tables to the driver's tables, with the SQL of each beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotmere.functions import geo, text
from plotmere.operators import activity, listing, places, resolve, saved, searches, stats, suppress
from plotmere.queries import _AREAS, _LISTINGS, _TABBED, LAT, LON, NOW, _areas, _miles, _query, _table, listings, tabbed
from plotmere.queries_columns import _list, _pick, _pick_sql
from plotmere.sources import exports
from plotmere.sources import listings as sources

_now = lambda: F.lit(NOW).cast("timestamp_ntz")
_AT = f"TIMESTAMP '{NOW}'"
_uid = lambda column: F.concat(F.lit("c"), F.col(column).cast("string"))


# ---------------------------------------------------------------- the list

_PHONE = "CASE WHEN sqft % 3 = 0 THEN '' ELSE '801555' || (sqft % 10000) END"
_CITIES = ["Provo", "orem", "Magna", "", "Sandy"]
_VERIFIED = "CASE WHEN sqft % 5 = 0 THEN '801777' || (sqft % 10000) ELSE ' ' END"
_CALLED = f"CASE WHEN sqft % 4 > 0 THEN {_AT} - to_minutes(CAST(sqft % 997 AS BIGINT)) END"
_ROWS = f"SELECT *, {_miles('40.5', '-111.5', 'lat', 'lon')} AS distance_miles, {_PHONE} AS phone, {_VERIFIED} AS verified_phone, {_CALLED} AS last_call_at, {_pick_sql(_CITIES, 'sqft')} AS city FROM ({_TABBED})"


def _rows(spark, sf_dir):
    away = geo.haversine(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))
    phone = F.when(F.col("sqft") % 3 == 0, "").otherwise(F.concat(F.lit("801555"), (F.col("sqft") % 10000).cast("string")))
    verified = F.when(F.col("sqft") % 5 == 0, F.concat(F.lit("801777"), (F.col("sqft") % 10000).cast("string"))).otherwise(" ")
    called = F.when(F.col("sqft") % 4 > 0, F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(0, 0, cast(sqft % 997 as int))"))
    return tabbed(spark, sf_dir).withColumns({"distance_miles": away, "phone": phone, "verified_phone": verified, "last_call_at": called, "city": _pick(_CITIES, F.col("sqft")), "place": F.col("uid")})


def _page_of(sort: str, order: str):
    @_query(f"SELECT uid FROM ({_ROWS}) WHERE list_contains(tabs, 'unchecked') ORDER BY {order}, uid LIMIT 150 OFFSET 20")
    def page(spark, sf_dir):
        rows = _rows(spark, sf_dir).filter(F.array_contains("tabs", "unchecked"))
        return listing.page(listing.sorted_by(rows, sort, tab="unchecked"), 20, 150).select("uid")

    return page


from plotmere.queries import ORACLE_SQL, QUERIES  # noqa: E402


@_query(f"SELECT uid FROM ({_ROWS}) WHERE list_contains(tabs, 'yes') ORDER BY coalesce(nullif(lower(city), ''), '~') DESC, uid LIMIT 40")
def sorted_by_city_descending(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter(F.array_contains("tabs", "yes"))
    return listing.page(listing.sorted_by(rows, "city", True, tab="yes"), 0, 40).select("uid")


for _sort, _order in (
    ("score", "score DESC, (phone <> '' OR trim(verified_phone) <> '') DESC"), ("miles", "distance_miles"), ("name", "lower(name)"), ("city", "coalesce(nullif(lower(city), ''), '~')"),
    ("contact", "CASE WHEN trim(verified_phone) <> '' THEN 0 WHEN phone <> '' THEN 1 ELSE 2 END"), ("called", "coalesce(epoch_us(last_call_at), 0) DESC"),
):
    _f = _page_of(_sort, _order)
    QUERIES[f"sorted_by_{_sort}"], ORACLE_SQL[f"sorted_by_{_sort}"] = QUERIES.pop("page"), ORACLE_SQL.pop("page")
    _f.__name__ = f"sorted_by_{_sort}"


@_query(f"SELECT uid, tier, phone FROM ({_ROWS}) WHERE tier = 'C' AND phone <> ''")
def filtered_list(spark, sf_dir):
    return listing.filtered(_rows(spark, sf_dir), tier="C", has_phone=True).select("uid", "tier", "phone")


_STAYING = ["c1", "c2", "s1", "s999999"]


@_query(f"SELECT uid FROM ({_ROWS}) WHERE list_contains(tabs, 'unchecked') OR uid IN ('c1', 'c2', 's1', 's999999') ORDER BY score DESC, (phone <> '' OR trim(verified_phone) <> '') DESC, uid LIMIT 5000")
def page_with_pinned_rows(spark, sf_dir):
    return listing.page_with_pins(_rows(spark, sf_dir), "unchecked", _STAYING, 0, 9000).select("uid")


@_query(f"SELECT uid FROM ({_ROWS}) WHERE list_contains(tabs, 'closed') ORDER BY lower(name), uid LIMIT 30 OFFSET 10")
def second_page_without_pinned_rows(spark, sf_dir):
    return listing.page_with_pins(_rows(spark, sf_dir), "closed", _STAYING, 10, 30, "name").select("uid")


_OUTCOMES = ["click", "view", "signup", "none yet"]
_CALLS = "SELECT 'c' || user_id AS uid, arg_max(event_type, (ts, event_id)) AS outcome FROM events WHERE user_id IS NOT NULL GROUP BY user_id"


@_query(f"SELECT o AS outcome, coalesce(n, 0) AS n FROM (SELECT unnest({_list(_OUTCOMES)}) AS o) LEFT JOIN (SELECT outcome AS o, count(*) AS n FROM ({_LISTINGS}) JOIN ({_CALLS}) USING (uid) GROUP BY 1) USING (o)")
def call_outcome_counts(spark, sf_dir):
    calls = _table(spark, sf_dir, "events").select(_uid("user_id").alias("uid"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("outcome"))
    rows = activity.with_latest(listings(spark, sf_dir), calls, "uid", "at", "outcome", tie="id", prefix="call_")
    return listing.outcome_counts(rows, _OUTCOMES)


@_query("SELECT 'c' || o_custkey AS uid FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def removed_since(spark, sf_dir):
    changed = _table(spark, sf_dir, "orders").select(_uid("o_custkey").alias("uid"))
    present = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(_uid("c_custkey").alias("uid"))
    return listing.removed_rows(changed, present)


@_query("""SELECT 'orders' AS log, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL
SELECT 'events', count(*) FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def orphan_tallies(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("uid"))
    return listing.orphans({"orders": (_table(spark, sf_dir, "orders"), "o_custkey"), "events": (_table(spark, sf_dir, "events"), "user_id")}, rows)


_PINNED = f"""SELECT uid, round(lat, 5) AS lat, round(lon, 5) AS lon, CASE WHEN nation = 24 THEN 'competitor' WHEN mark IN ('yes', 'no') THEN mark ELSE 'unchecked' END AS grp, CASE WHEN phone = '' THEN '' WHEN length(phone) = 10 THEN '(' || phone[1:3] || ') ' || phone[4:6] || '-' || phone[7:10] ELSE phone END AS phone,
concat_ws(' · ', CASE WHEN sqft % 4 = 0 THEN 'No street address' END, nullif(concat_ws(', ', CASE WHEN sqft % 4 > 0 THEN sqft || ' Main' END, nullif(city, ''), CASE WHEN sqft % 4 > 1 THEN '84101' END), ''), CASE WHEN city = '' THEN 'near Provo, UT' END) AS address,
strftime(last_call_at - INTERVAL 7 HOUR, '%b %-d, %Y, %-I:%M %p') AS called, reviews < 0 AS closed, CASE WHEN nation <> 24 THEN '' WHEN sqft % 2 = 0 THEN 'Parent company' ELSE 'Competitor' END AS kind FROM ({_ROWS}) WHERE nation <> 3"""


def _addressed(spark, sf_dir):
    k = F.col("sqft") % 4
    return _rows(spark, sf_dir).withColumns({
        "address": F.when(k > 0, F.concat(F.col("sqft").cast("string"), F.lit(" Main"))).otherwise(""), "zip": F.when(k > 1, "84101").otherwise(""), "near_text": F.lit("near Provo, UT"), "call_outcome": F.lit("talked"),
        "flags": F.when(F.col("sqft") % 2 == 0, F.array(F.lit("OWN COMPANY: parent company Alder"))), "business_status": F.when(F.col("reviews") < 0, "CLOSED_PERMANENTLY").otherwise(""), "lat": F.when(F.col("nation") == 3, None).otherwise(F.col("lat")),
    })


@_query(f"SELECT uid, lat, lon, grp, phone, address, coalesce(called, '') AS called, closed, kind FROM ({_PINNED})")
def map_pins(spark, sf_dir):
    return listing.pins(_addressed(spark, sf_dir)).select("uid", "lat", "lon", "grp", "phone", "address", "called", "closed", "kind")


@_query(f"SELECT uid, CAST(grp AS VARCHAR) AS grp, address, len(grp) + len(address) > 0 AS whole FROM ({_PINNED})")
def map_pin_lists(spark, sf_dir):
    """Pins as lists, read by place again."""
    at = lambda n: F.get_json_object("pin", f"$[{listing.PIN.index(n)}]")
    rows = listing.pin_rows(_addressed(spark, sf_dir))
    return rows.select("uid", at("grp").alias("grp"), at("address").alias("address"), (F.size(F.from_json("pin", "array<string>")) == len(listing.PIN)).alias("whole"))


@_query(f"SELECT g AS grp, coalesce(n, 0) AS n FROM (VALUES ('unchecked'), ('yes'), ('no'), ('competitor')) t(g) LEFT JOIN (SELECT grp AS g, count(*) AS n FROM ({_PINNED}) GROUP BY 1) USING (g) UNION ALL SELECT 'no position', count(*) FROM ({_LISTINGS}) WHERE nation = 3")
def map_pin_counts(spark, sf_dir):
    return listing.pin_counts(_addressed(spark, sf_dir))


@_query(f"""SELECT count(*) AS merged, count(*) FILTER (d = 'kept') AS kept, count(*) FILTER (d = 'closed') AS closed, count(*) FILTER (d = 'low') AS low, count(*) FILTER (d = 'no_match') AS no_match, count(*) FILTER (d = 'kept' AND tier = 'A') AS tier_A, count(*) FILTER (d = 'kept' AND tier = 'B') AS tier_B, count(*) FILTER (d = 'kept' AND tier = 'C') AS tier_C, count(*) FILTER (d = 'kept' AND tier = 'D') AS tier_D
FROM (SELECT tier, CASE WHEN reviews < 0 THEN 'closed' WHEN nation = 24 THEN 'kept' WHEN score < 20 THEN 'low' WHEN sqft % 2 = 0 THEN 'no_match' ELSE 'kept' END AS d FROM ({_TABBED}))""")
def search_funnel(spark, sf_dir):
    rows = tabbed(spark, sf_dir).withColumn("business_status", F.when(F.col("reviews") < 0, "CLOSED_PERMANENTLY").otherwise(""))
    rows = rows.withColumn("matched_keywords", F.when(F.col("sqft") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("baler"))))
    return stats.funnel(listing.dispositions(rows, 20, only_hits=True))


@_query(f"SELECT coalesce(nullif(concat_ws(', ', nullif(city, ''), CASE WHEN sqft % 2 = 0 THEN 'UT' END), ''), '(no town listed)') AS town, count(*) AS n FROM ({_ROWS}) GROUP BY 1 ORDER BY n DESC, min(uid) LIMIT 6")
def largest_towns(spark, sf_dir):
    return stats.town_counts(_rows(spark, sf_dir).withColumn("state", F.when(F.col("sqft") % 2 == 0, "UT")), 6)


@_query(f"SELECT tier, count(*) FILTER (sqft % 2 = 0) AS n_with, count(*) FILTER (sqft % 2 = 1) AS n_without, min(score) FILTER (sqft % 2 = 0) AS lowest_with, max(score) FILTER (sqft % 2 = 1) AS highest_without FROM ({_TABBED}) GROUP BY tier")
def score_separation(spark, sf_dir):
    return stats.separation(tabbed(spark, sf_dir).withColumn("has_equipment", F.col("sqft") % 2 == 0))


@_query("SELECT user_id AS source, max(ts) FILTER (event_type <> 'error') AS ok_at, arg_max(event_type, (ts, event_type)) FILTER (event_type <> 'error') AS ok_note, max(ts) FILTER (event_type = 'error') AS failed_at FROM events GROUP BY user_id")
def source_statuses(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"), F.col("ts").alias("at"), F.col("event_type").alias("note"))
    return stats.latest_status(log).select("source", F.col("ok.at").alias("ok_at"), F.col("ok.note").alias("ok_note"), F.col("failed.at").alias("failed_at"))


@_query("SELECT count(*) FILTER (c_mktsegment <> 'BUILDING' OR c_custkey % 3 = 0) AS usable FROM customer")
def usable_customers(spark, sf_dir):
    k = F.col("c_custkey")
    named = F.when((F.col("c_mktsegment") != "BUILDING") | (k % 3 == 0), F.concat(F.lit("Alder "), F.col("c_mktsegment"))).otherwise("Co")
    return suppress.usable(_table(spark, sf_dir, "customer").select(named.alias("name"), F.lit("555").alias("phone"), F.lit("Main St").alias("address"), F.lit("Provo").alias("city"), F.lit("84").alias("zip")))


@_query("SELECT count(*) AS hidden FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def hidden_customers(spark, sf_dir):
    def people(table: str, nation: str):
        return _table(spark, sf_dir, table).select(F.col(f"{table[0]}_{table[:4]}key").alias("uid"), F.concat(F.lit("Nation "), F.char(F.lit(97) + F.col(nation)), F.lit("lder")).alias("name"), F.lit("").alias("phone"), F.lit("").alias("address"), F.lit("Provo").alias("city"), F.lit("").alias("zip"))

    own = people("customer", "c_nationkey")
    return suppress.known(own, suppress.fingerprints(people("supplier", "s_nationkey"), "salt"), "salt", "uid").agg(F.count(F.lit(1)).alias("hidden"))


# ---------------------------------------------------------------- places

@_query(f"SELECT name, CAST(radius_miles AS DOUBLE) AS radius_miles FROM ({_AREAS}) WHERE {_miles('40.5', '-111.5', 'lat', 'lon')} <= 25 ORDER BY radius_miles DESC, name LIMIT 5")
def towns_in_circle(spark, sf_dir):
    return places.towns_in(_areas(spark, sf_dir), LAT, LON, 25.0, 5).select("name", "radius_miles")


@_query(f"SELECT uid, round(miles, 6) AS miles FROM (SELECT *, {_miles('40.5', '-111.5', 'lat', 'lon')} AS miles FROM ({_LISTINGS})) WHERE miles > 30 AND uid NOT IN (SELECT 'c' || o_custkey FROM orders)")
def far_listings(spark, sf_dir):
    worked = _table(spark, sf_dir, "orders").select(_uid("o_custkey").alias("uid"))
    return places.far_listings(listings(spark, sf_dir), LAT, LON, 30.0, worked).select("uid", F.round("miles", 6).alias("miles"))


@_query("SELECT n_nationkey AS part FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey < 20)")
def parts_to_fill(spark, sf_dir):
    planned = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("part"))
    return places.missing_parts(planned, _table(spark, sf_dir, "customer").filter("c_custkey < 20").select(F.col("c_nationkey").alias("part")))


# ---------------------------------------------------------------- search records

_LABELS_OF = ["Alder Shop, 5 Main St", "Alder Co, 5 Main St", "Provo", "provo", ""]
_SEARCHES = f"""SELECT event_id AS id, ts AS seen_at, CAST(ts AS DATE) AS day, {_pick_sql(_LABELS_OF, 'event_id')} AS place, CASE WHEN event_id % 6 > 0 THEN 40.5 + (event_id % 5) / 1000.0 END AS lat, -111.5 AS lon, 5.0 + event_id % 2 * 25 AS radius, (event_id % 8) / 20.0::DOUBLE AS miles,
CASE event_type WHEN 'view' THEN 'osm' WHEN 'click' THEN 'google' WHEN 'purchase' THEN 'both' END AS source, CASE WHEN event_id % 4 > 0 THEN event_id % 100 END AS leads FROM events"""


def _searches(spark, sf_dir):
    k, kind = F.col("event_id"), F.col("event_type")
    return _table(spark, sf_dir, "events").select(
        k.alias("id"), F.col("ts").alias("at"), F.to_date("ts").alias("day"), _pick(_LABELS_OF, k).alias("place"), F.when(k % 6 > 0, F.lit(40.5) + (k % 5) / F.lit(1000.0)).alias("lat"), F.lit(-111.5).alias("lon"), (F.lit(5.0) + k % 2 * 25).alias("radius"),
        ((k % 8) / F.lit(20.0)).alias("miles"), F.when(kind == "view", "osm").when(kind == "click", "google").when(kind == "purchase", "both").alias("source"), F.when(k % 4 > 0, k % 100).alias("leads"))


@_query(f"""SELECT replace(place, 'Alder Co,', 'Alder Shop,') AS place, max(seen_at) AS seen_at, arg_max(id, (seen_at, id)) AS id FROM ({_SEARCHES}) WHERE leads IS NOT NULL AND place <> '' AND day < DATE '2024-01-20' AND seen_at > {_AT} - INTERVAL 3 DAY GROUP BY 1""")
def earlier_searches(spark, sf_dir):
    rows = _searches(spark, sf_dir).withColumn("place", searches.renamed_place(F.col("place"), ["Alder Co"], "Alder Shop"))
    return searches.earlier(rows, F.lit("2024-01-20").cast("date"), _now() - F.expr("interval 3 days")).select("place", F.col("at").alias("seen_at"), "id")


@_query(f"""SELECT id, seen_at FROM (SELECT * FROM ({_SEARCHES}) ORDER BY seen_at DESC, id DESC LIMIT 60) WHERE leads IS NOT NULL AND coalesce(source, 'auto') IN ('auto', 'osm', 'both') AND radius = 30
AND CASE WHEN lat IS NULL THEN miles ELSE {_miles('40.5', '-111.5', 'lat', 'lon')} END <= 0.1 ORDER BY seen_at DESC, id DESC LIMIT 1""")
def latest_area_search(spark, sf_dir):
    return searches.latest_of_area(_searches(spark, sf_dir), LAT, LON, 30.0).select("id", F.col("at").alias("seen_at"))


@_query("SELECT kind, seen_at, id FROM (SELECT 'order' AS kind, o_orderdate AS seen_at, o_orderkey AS id FROM orders UNION ALL SELECT 'event', ts, event_id FROM events) ORDER BY seen_at DESC, kind, id DESC LIMIT 80")
def history_union(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return searches.history(o, _table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("id")), limit=80).withColumnRenamed("at", "seen_at")


_LABELS = ["5-LOW", "1-URGENT", "3-MEDIUM", "unseen"]


@_query(f"SELECT label, n, CAST(list_position({_list(_LABELS)}, label) AS BIGINT) AS place FROM (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1) WHERE list_contains({_list(_LABELS)}, label)")
def labels_in_order(spark, sf_dir):
    return searches.in_label_order(_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n")), _LABELS)


@_query("""WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS u, epoch_us(ts) AS us, event_type = 'signup' AS clears, event_type <> 'view' AS notes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT u, r, id, true AS ok, CASE WHEN notes AND NOT clears THEN [us] ELSE CAST([] AS BIGINT[]) END AS kept FROM e WHERE r = 1
UNION ALL SELECT u, r, id, ok, CASE WHEN ok AND clears THEN [] WHEN ok AND notes THEN list_append(kept, us) ELSE kept END FROM (SELECT e.*, len(list_filter(s.kept, lambda t: e.us - t < 172800000000)) < 3 AS ok, s.kept FROM s JOIN e ON e.u = s.u AND e.r = s.r + 1))
SELECT id AS event_id, ok AS allowed FROM s""")
def rate_limits(spark, sf_dir):
    e = _table(spark, sf_dir, "events").filter("user_id is not null and ts is not null").withColumns({"notes": F.col("event_type") != "view", "clears": F.col("event_type") == "signup"})
    return searches.rate_limited(e, ["user_id"], "ts", 3, 172_800, "event_id", "notes", "clears").select("event_id", "allowed")


@_query(f"SELECT user_id, count(*) AS used, max(ts) + INTERVAL 86490 SECOND AS resets_at FROM events WHERE ts <= {_AT} AND epoch_us({_AT}) - epoch_us(ts) < 86490000000 GROUP BY user_id")
def budget_resets(spark, sf_dir):
    return searches.next_reset(_table(spark, sf_dir, "events"), "user_id", "ts", _now())


@_query(f"SELECT event_id FROM events WHERE epoch_us({_AT}) - epoch_us(ts) < 7200000000")
def cache_entries(spark, sf_dir):
    return searches.unexpired(_table(spark, sf_dir, "events"), "ts", _now(), 7200).select("event_id")


@_query("""WITH RECURSIVE e AS (SELECT event_id AS id, epoch_us(ts) AS us, event_type = 'purchase' AS done, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events),
c AS (SELECT day, r, id, us AS held, done, true AS takes FROM e WHERE r = 1
UNION ALL SELECT day, r, id, CASE WHEN t THEN us ELSE held END, CASE WHEN t THEN d ELSE done END, t FROM (SELECT e.day, e.r, e.id, e.us, c.held, c.done, e.done AS d, NOT c.done AND e.us - c.held > 1800000000 AS t FROM c JOIN e ON e.day = c.day AND e.r = c.r + 1))
SELECT CAST(day AS VARCHAR) AS day, id FROM c WHERE takes""")
def day_claims(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", (F.col("event_type") == "purchase").alias("found"))
    return searches.claims(e, F.to_date("ts"), "ts", "found", "id").select(F.col("day").cast("string").alias("day"), "id")


@_query("SELECT user_id AS source, CASE WHEN f > 0 AND n = 0 THEN 'error' WHEN f > 0 THEN 'warning' ELSE 'ok' END AS verdict FROM (SELECT user_id, count(*) FILTER (event_type = 'error' AND event_id % 3 = 0) AS f, count(*) FILTER (event_type = 'purchase' AND event_id % 9 = 0) AS n FROM events GROUP BY 1)")
def source_failures(spark, sf_dir):
    k, kind = F.col("event_id"), F.col("event_type")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), ((kind == "purchase") & (k % 9 == 0)).cast("int").alias("found"), ((kind == "error") & (k % 3 == 0)).alias("failed"))
    return searches.failures(rows)


@_query("SELECT c_custkey AS company, name, CASE WHEN c_custkey % 3 = 0 AND name = 'radius' AND c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE value END AS value FROM customer JOIN (VALUES ('radius', '30'), ('zone', 'Denver')) t(name, value) ON true")
def company_settings(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("company", F.col("c_custkey"))
    own = c.filter("company % 3 = 0").select("company", F.lit("radius").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("value"))
    return searches.resolved_settings(spark.createDataFrame([("radius", "30"), ("zone", "Denver")], "name string, value string"), own, c)


@_query("""SELECT o_orderkey, why, why = '' AS allowed FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'demo' WHEN o_orderkey % 7 = 0 THEN 'canceled' WHEN o_orderstatus = 'P' THEN 'past due'
WHEN o_orderstatus = 'O' AND TIMESTAMP '1996-01-01' > o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END THEN 'trial ended' WHEN o_orderkey % 5 >= o_orderkey % 4 THEN 'used up' ELSE '' END AS why FROM orders)""")
def company_eligibility(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = _table(spark, sf_dir, "orders").select(
        k, (k % 11 == 0).alias("demo"), F.when(k % 7 == 0, "canceled").when(s == "P", "past_due").when(s == "O", "trialing").otherwise("active").alias("status"), F.col("o_orderdate").alias("trial_ends_at"),
        F.when(k % 2 == 0, "sub").alias("subscription"), (k % 5).alias("used"), F.when(k % 4 > 0, k % 4).alias("searches"))
    return searches.eligible(rows, F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "why", "allowed")


@_query(f"SELECT (SELECT count(*) FROM events WHERE event_type = 'error' AND ts <= {_AT} AND ts > {_AT} - INTERVAL 7 DAY) AS n, (SELECT string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) FROM (SELECT * FROM events WHERE event_type = 'error' AND ts <= {_AT} AND ts > {_AT} - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 5)) AS latest")
def recent_problems(spark, sf_dir):
    log = _table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("text"))
    return searches.recent_problems(log, _now()).select("n", F.array_join("latest", ",").alias("latest"))


@_query("SELECT strftime(o_orderdate, '%Y-%m') AS month, prefix, count(*) AS n FROM orders JOIN (VALUES ('1-'), ('5-L')) t(prefix) ON starts_with(o_orderpriority, prefix) GROUP BY ALL")
def monthly_usage(spark, sf_dir):
    return searches.usage_by_prefix(_table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy-MM"), ["1-", "5-L"], "o_orderpriority")


_STAGES = {"view": 1.0, "click": 2.0, "purchase": 5.0}


@_query("SELECT event_id, round(max(p) OVER (PARTITION BY user_id ORDER BY ts, event_id), 9) AS progress FROM (SELECT *, CASE event_type WHEN 'view' THEN d / 8 WHEN 'click' THEN (1 + 2 * d) / 8 WHEN 'purchase' THEN (3 + 5 * d) / 8 ELSE 0 END AS p FROM (SELECT *, (event_id % 11) / 10.0::DOUBLE AS d FROM events))")
def search_progress(spark, sf_dir):
    steps = _table(spark, sf_dir, "events").withColumn("stage", F.col("event_type")).withColumn("done", (F.col("event_id") % 11) / F.lit(10.0))
    return searches.progress(steps, _STAGES, "user_id", "ts", "event_id").select("event_id", F.round("progress", 9).alias("progress"))


# ---------------------------------------------------------------- the saved list over time

_LEADS = f"SELECT CAST(substr(uid, 2) AS BIGINT) AS rid, name, lat, lon, CASE WHEN nation < 12 THEN 'google' ELSE 'osm' END AS source, CASE WHEN sqft % 2 = 0 THEN uid ELSE '' END AS source_id FROM ({_LISTINGS}) WHERE uid LIKE 'c%'"


_TREES = ["alder", "birch", "cedar", "dogwood", "elm"]


@_query(f"""WITH l AS (SELECT rid, lat, lon, source, source_id, {_pick_sql(_TREES, 'rid')} AS tree FROM ({_LEADS})), s AS (SELECT 'r' || rid AS uid, tree, lat + (rid % 3) * 0.001 AS lat, lon, source, CASE WHEN source_id = '' THEN 's' || rid ELSE source_id END AS source_id FROM l)
SELECT rid, uid, min(priority) AS priority FROM (SELECT l.rid, s.uid, 0 AS priority FROM l JOIN s USING (source, source_id) UNION ALL SELECT l.rid, s.uid, 1 FROM l JOIN s ON l.tree = s.tree AND abs(l.lat - s.lat) < 0.0031 AND abs(l.lon - s.lon) < 0.0041 AND {_miles('l.lat', 'l.lon', 's.lat', 's.lon')} <= 0.2) GROUP BY ALL""")
def saved_row_offers(spark, sf_dir):
    """By id first, then the rows of one name within 0.2 miles: names of other trees are no duplicates."""
    k = F.substring("uid", 2, 20).cast("long")
    none = {c: F.lit("") for c in ("phone", "website", "address", "city", "state", "zip", "business_status", "primary_category")}
    rows = listings(spark, sf_dir).filter("uid like 'c%'").withColumn("rid", k).withColumns({
        "name": F.concat(F.lit("Customer "), _pick(_TREES, k)), "source": F.when(F.col("nation") < 12, "google").otherwise("osm"), "source_id": F.when(F.col("sqft") % 2 == 0, F.col("uid")).otherwise(F.concat(F.lit("n"), k)),
        "raw_categories": F.array().cast("array<string>"), "outline": F.lit(None).cast("struct<s:double,w:double,n:double,e:double>"), "rating_count": F.lit(None).cast("int"), "yelp_reviews": F.lit(None).cast("int"), **none})
    kept = rows.withColumns({"uid": F.concat(F.lit("r"), k.cast("string")), "first_seen": k, "lat": F.col("lat") + (k % 3) * 0.001, "source_id": F.when(F.col("sqft") % 2 == 0, F.col("source_id")).otherwise(F.concat(F.lit("s"), k))})
    return saved.offers(rows.drop("uid"), kept).select("rid", "uid", "priority")


_OLD = "SELECT 'u' || l_orderkey AS uid, l_linestatus AS source, CAST(l_linenumber AS VARCHAR) AS source_id, l_shipdate AS seen_at FROM lineitem WHERE l_linenumber <= 3"
_NEW = "SELECT 'u' || CASE WHEN l_orderkey % 10 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS uid, 'N' AS source, CAST(l_linenumber AS VARCHAR) AS source_id, l_shipdate + INTERVAL 400 DAY AS seen_at FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 AND l_orderkey % 4 < 2"


def _parts(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    row = lambda df, key, source, at: df.select(F.concat(F.lit("u"), key.cast("string")).alias("uid"), source.alias("source"), F.col("l_linenumber").cast("string").alias("source_id"), at.alias("at"))
    k = F.col("l_orderkey")
    old = row(li.filter("l_linenumber <= 3"), k, F.col("l_linestatus"), F.col("l_shipdate"))
    new = row(li.filter("l_linenumber between 2 and 4 and l_orderkey % 4 < 2"), F.when(k % 10 == 0, k + 1).otherwise(k), F.lit("N"), F.col("l_shipdate") + F.expr("interval 400 days"))
    return old, new


_SHUT = "SELECT DISTINCT 'u' || l_orderkey AS uid FROM lineitem WHERE l_orderkey % 3 = 0"
_AGAIN = f"""WITH o AS ({_OLD}), n AS (SELECT * FROM ({_NEW}) WHERE uid NOT IN ({_SHUT}) OR uid IN (SELECT uid FROM ({_OLD}))), every AS (SELECT * FROM o WHERE (uid, source, source_id) NOT IN (SELECT (uid, source, source_id) FROM n) UNION ALL SELECT * FROM n)
SELECT uid, count(*) AS n_parts, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, (SELECT min(seen_at) FROM (SELECT * FROM o UNION ALL SELECT * FROM n) b WHERE b.uid = every.uid) AS first_seen, max(seen_at) AS last_seen, uid NOT IN (SELECT uid FROM o) AS is_new FROM every GROUP BY uid"""


def _shut(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("uid")).distinct()


@_query(_AGAIN)
def saved_again(spark, sf_dir):
    return saved.saved_again(*_parts(spark, sf_dir), _shut(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@_query(f"SELECT count(*) FILTER (is_new) AS new, count(*) FILTER (NOT is_new) AS updated FROM ({_AGAIN}) WHERE uid IN (SELECT uid FROM ({_NEW}))")
def save_counts(spark, sf_dir):
    old, new = _parts(spark, sf_dir)
    return saved.save_counts(saved.saved_again(old, new, _shut(spark, sf_dir)), new)


_GROUPS = "SELECT o_orderkey AS id, o_custkey AS grp, 'u' || o_orderkey AS uid, o_orderdate AS first_seen FROM orders WHERE o_orderstatus = 'P'"


def _saved_groups(spark, sf_dir):
    return _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("grp"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("uid"), F.col("o_orderdate").alias("first_seen"))


@_query(f"SELECT uid AS other_uid, keep AS keep_uid FROM (SELECT *, first(uid) OVER (PARTITION BY grp ORDER BY first_seen, uid) AS keep FROM ({_GROUPS})) WHERE uid <> keep")
def merged_away(spark, sf_dir):
    return saved.kept_rows(_saved_groups(spark, sf_dir))


_ORDER_MARKS = "SELECT 'u' || l_orderkey AS uid, l_shipdate AS seen_at, l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE '' END AS value FROM lineitem"


def _order_marks(spark, sf_dir):
    value = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").otherwise("")
    place = F.struct("_metadata.file_name", "_metadata.row_index")  # an order may have two lines of one number and day
    return _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("uid"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("id"), value.alias("value"), place.alias("place"))


_CURRENT = f"SELECT uid, arg_max(value, (seen_at, id)) AS value, max(seen_at) AS seen_at FROM ({_ORDER_MARKS}) WHERE value <> '' GROUP BY uid"
_TAKEN = f"""SELECT grp, arg_min(uid, (first_seen, uid)) AS keep_uid, bool_or(value = 'yes') AND bool_or(value = 'no') AS disagreed, arg_max(value, (seen_at, value, uid)) FILTER (value IS NOT NULL) AS last, max(seen_at) AS last_at, max(seen_at) FILTER (value = 'yes') AS yes_at
FROM ({_GROUPS}) LEFT JOIN ({_CURRENT}) USING (uid) GROUP BY grp HAVING count(value) > 0"""


def _current_marks(spark, sf_dir):
    return activity.latest(_order_marks(spark, sf_dir).filter("value <> ''"), "uid", "at", "value", "at", tie="id", place="place").select("uid", "value", "at")


@_query(f"SELECT grp, keep_uid, CASE WHEN disagreed THEN 'yes' ELSE last END AS value, CASE WHEN disagreed THEN yes_at ELSE last_at END AS seen_at, disagreed FROM ({_TAKEN})")
def merged_marks(spark, sf_dir):
    found = saved.merged_marks(_saved_groups(spark, sf_dir), _current_marks(spark, sf_dir))
    return found.select("grp", "keep_uid", "value", F.col("at").alias("seen_at"), "disagreed")


_PLAN = f"SELECT uid AS other_uid, keep AS keep_uid FROM (SELECT *, first(uid) OVER (PARTITION BY grp ORDER BY first_seen, uid) AS keep FROM ({_GROUPS})) WHERE uid <> keep"


def _lineage(spark, sf_dir):
    groups, marks = _saved_groups(spark, sf_dir), _current_marks(spark, sf_dir)
    apart = saved.merged_marks(groups, marks).filter("disagreed")
    return saved.with_lineage(groups, saved.kept_rows(groups), F.lit("1997-01-01").cast("timestamp_ntz"), marks=marks, disagreed=apart)[1]


@_query(f"SELECT g.uid, p.keep_uid AS into_uid, grp, coalesce(value, '') AS mark, p.keep_uid IN (SELECT keep_uid FROM ({_TAKEN}) WHERE disagreed) AS disagreed FROM ({_GROUPS}) g JOIN ({_PLAN}) p ON g.uid = p.other_uid LEFT JOIN ({_CURRENT}) m ON m.uid = g.uid")
def merge_lineage(spark, sf_dir):
    return _lineage(spark, sf_dir).select("uid", "into_uid", F.get_json_object("row", "$.grp").cast("long").alias("grp"), "mark", "disagreed")


@_query(f"""SELECT keep_uid AS uid FROM ({_TAKEN}) WHERE disagreed AND keep_uid NOT IN (SELECT uid FROM ({_ORDER_MARKS}) WHERE id % 2 = 0 AND seen_at >= TIMESTAMP '1997-01-01')""")
def unconfirmed_merges(spark, sf_dir):
    clicks = _order_marks(spark, sf_dir).withColumn("undone_at", F.when(F.col("id") % 2 == 1, F.col("at")))
    return saved.disagreements(_lineage(spark, sf_dir), clicks).select("uid")


@_query(f"SELECT coalesce(keep_uid, uid) AS uid, count(*) AS n FROM ({_ORDER_MARKS}) m LEFT JOIN ({_PLAN}) p ON m.uid = p.other_uid GROUP BY 1")
def moved_marks(spark, sf_dir):
    plan = saved.kept_rows(_saved_groups(spark, sf_dir))
    return resolve.moved_uids(_order_marks(spark, sf_dir), plan).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))


_TITLES = ["Shoreline Ridge", "Alder Campus", "Birch Court", "Main Apartments"]


@_query(f"""SELECT l_orderkey, CASE WHEN n > 1 AND base % 4 <> 3 THEN {_pick_sql(_TITLES, 'base')} ELSE {_pick_sql(_TITLES, 'base')} || ' #' || ln || 'B' END AS title FROM (SELECT l_orderkey, l_orderkey % 4 AS base, min(l_linenumber) AS ln, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)""")
def site_titles(spark, sf_dir):
    """Buildings of one site, numbered by an order's lines. Numbers are compared without letters behind them."""
    name = F.concat(_pick(_TITLES, F.col("l_orderkey") % 4), F.lit(" "), F.col("l_linenumber").cast("string"))
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(name).alias("names"), F.min("l_linenumber").alias("ln"))
    shown = F.concat(_pick(_TITLES, F.col("l_orderkey") % 4), F.lit(" #"), F.col("ln").cast("string"), F.lit("B"))
    return rows.select("l_orderkey", text.site_title(shown, F.col("names")).alias("title"))


# ---------------------------------------------------------------- sources and sinks


@_query(f"SELECT l_linestatus || ':' || CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS VARCHAR) ELSE l_returnflag END AS part, count(*) AS n FROM lineitem GROUP BY 1")
def part_ids(spark, sf_dir):
    source_id = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")).otherwise("")
    return _table(spark, sf_dir, "lineitem").select(saved.part_id(F.col("l_linestatus"), source_id, F.col("l_returnflag")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT DISTINCT 'a' AS source, CAST(l_partkey AS VARCHAR) AS source_id FROM lineitem")
def first_seen_records(spark, sf_dir):
    found = _table(spark, sf_dir, "lineitem").select(F.lit("a").alias("source"), F.col("l_partkey").cast("string").alias("source_id"))
    return sources.together(found.filter("source_id like '1%'"), found)


@_query(f"SELECT uid, round(miles, 6) AS miles FROM (SELECT *, {_miles('40.5', '-111.5', 'lat', 'lon')} AS miles FROM ({_LISTINGS})) WHERE miles <= 20.5")
def within_margin(spark, sf_dir):
    return sources.within(listings(spark, sf_dir), LAT, LON, 20.0, 0.5).select("uid", F.round("distance_miles", 6).alias("miles"))


@_query(f"SELECT uid, json_extract_string(row, '$.name') AS name, CAST(json_extract_string(row, '$.score') AS BIGINT) AS score FROM (SELECT uid, json_object('uid', uid, 'name', name, 'score', score) AS row FROM ({_TABBED}))")
def json_lines(spark, sf_dir):
    rows = exports.json_rows(tabbed(spark, sf_dir), "uid", "name", "score", "mark")
    return rows.select(*(F.get_json_object("row", f"$.{c}").alias(c) for c in ("uid", "name"))
                       , F.get_json_object("row", "$.score").cast("long").alias("score"))


@_query("SELECT count(*) AS in_file, count(*) FILTER (has) AS already, count(*) FILTER (NOT has) AS added FROM (SELECT DISTINCT o_custkey, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F') AS has FROM orders WHERE o_orderstatus = 'F')")
def restore_report(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return exports.restore(o.filter("s <> 'F'").dropDuplicates(["k"]), o.filter("s = 'F'"), ["k"])[1]


@_query("SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS note FROM events GROUP BY user_id")
def latest_notes(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("note", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))
    return activity.latest_filled(e, "user_id", "ts", "note", "event_id").select("user_id", "note")


@_query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def events_without_tombstones(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return activity.without_tombstones(e.union(e), _table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_id")), "event_id")


