"""Queries that apply column functions to every row of the driver's tables, with the SQL of each beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotmere.functions import geo, text, time
from plotmere.operators import classify
from plotmere.operators.score import building_name, generic_name
from plotmere.operators.shared import dealt
from plotmere.plans import categories as K
from plotmere.queries import _LISTINGS, _NORM, _miles, _query, _table, listings

_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"


def _pick(values: list[str], index):
    """The element of a fixed list at a number modulo its length."""
    return F.try_element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values: list[str], index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


# ---------------------------------------------------------------- text

_PHONES = [" ext 5: ", "(801) 555-", "+1 801.555.", "1801555", "801-55-", "call ", "801555"]


@_query(f"""SELECT c_custkey, CASE WHEN length(d) = 10 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] ELSE trim(p) END AS phone
FROM (SELECT c_custkey, p, regexp_replace(regexp_replace(p, '[^0-9]', '', 'g'), '^1([0-9]{{10}})$', '\\1') AS d FROM (SELECT c_custkey, {_pick_sql(_PHONES, 'c_custkey')} || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS p FROM customer))""")
def format_phones(spark, sf_dir):
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(k, text.format_phone(F.concat(_pick(_PHONES, k), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"))


_STREETS = ["West Fortune Road, Suite 7", "S Élm Street Apt 4", "north temple", "East Main Ave #3, Provo", "Main", "Place of the Court Bldg 9"]
_WHO = ["The {} Co. & Sons, Inc", "{}'s Café LLC", "Ré {} #12", "{} limited", "12"]
_FOLD = f"translate(lower({{}}), '{text.ACCENTED}', '{text.PLAIN}')"
_WORDS = f"list_filter(string_split(regexp_replace(regexp_replace(replace({_FOLD}, '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SHORT = "MAP {" + ", ".join(f"{_q(a)}: {_q(b)}" for a, b in text.STREET_WORDS.items()) + "}"


@_query(f"""WITH r AS (SELECT c_custkey AS k, replace({_pick_sql(_WHO, 'c_custkey')}, '{{}}', c_mktsegment) AS name, '+1 801 555 ' || lpad(CAST(c_custkey % 20000 AS VARCHAR), 4, '0') AS phone,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE (c_custkey % 900) || ' ' END || {_pick_sql(_STREETS, 'c_custkey')} AS address, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'West ' || n_name END AS city, 'UT ' || lpad(CAST(c_custkey % 90000 AS VARCHAR), 5, '0') || '-12' AS zip
  FROM customer JOIN nation ON c_nationkey = n_nationkey), w AS (SELECT k, regexp_replace(phone, '[^0-9]', '', 'g') AS d, {_WORDS.format("split_part(address, ',', 1)")} AS line, {_WORDS.format('name')} AS who, array_to_string({_WORDS.format('city')}, ' ') AS town, regexp_replace(zip, '[^0-9]', '', 'g')[1:5] AS z FROM r),
s AS (SELECT k, CASE WHEN length(d) = 11 AND d[1] = '1' THEN d[2:] ELSE d END AS d, list_transform(CASE WHEN u IS NULL THEN line ELSE line[1:u - 1] END, lambda x: coalesce({_SHORT}[x], x)) AS line, array_to_string(list_filter(who, lambda x: x NOT IN ({", ".join(map(_q, text.NAME_DROP))}) AND NOT regexp_full_match(x, '[0-9]+')), ' ') AS who, town, z
  FROM (SELECT *, list_min(list_filter([CASE WHEN list_contains({_list(text.UNIT_WORDS)}, x) THEN i END for x, i in line], lambda y: y IS NOT NULL)) AS u FROM w)),
t AS (SELECT k, CASE WHEN length(d) = 10 THEN d ELSE '' END AS d, CASE WHEN len(line) >= 2 AND regexp_matches(line[1], '^[0-9]') THEN array_to_string(line, ' ') ELSE '' END AS street, CASE WHEN length(who) >= 3 THEN who ELSE '' END AS who, town, CASE WHEN length(z) = 5 THEN z ELSE '' END AS z FROM s)
SELECT k, array_to_string(list_filter([CASE WHEN d <> '' THEN 'phone:' || d END, CASE WHEN street <> '' AND z <> '' THEN 'addr:' || street || '|' || z END, CASE WHEN street <> '' AND town <> '' THEN 'addrcity:' || street || '|' || town END,
  CASE WHEN who <> '' AND z <> '' THEN 'name:' || who || '|' || z END, CASE WHEN who <> '' AND town <> '' THEN 'namecity:' || who || '|' || town END], lambda x: x IS NOT NULL), ';') AS keys FROM t""")
def customer_match_keys(spark, sf_dir):
    k, n = F.col("c_custkey"), _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = dealt(_table(spark, sf_dir, "customer")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    name = F.replace(_pick(_WHO, k), F.lit("{}"), F.col("c_mktsegment"))
    address = F.concat(F.when(k % 7 == 0, "").otherwise(F.concat((k % 900).cast("string"), F.lit(" "))), _pick(_STREETS, k))
    city, phone = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("West "), F.col("n_name"))), F.concat(F.lit("+1 801 555 "), F.lpad((k % 20000).cast("string"), 4, "0"))
    keys = text.customer_keys(name, phone, address, city, F.concat(F.lit("UT "), F.lpad((k % 90000).cast("string"), 5, "0"), F.lit("-12")))
    return rows.select(k.alias("k"), F.array_join(keys, ";").alias("keys"))


_SITES = ["Shoreline Ridge Building 825b", "Medical Center North Tower", "343 Apartments", "The Alder & Birch Campus", "Unit 4", "K Street Park"]


@_query(f"""SELECT uid, CASE WHEN len(list_filter(w, lambda x: NOT list_contains({_list(text.GENERIC_WORDS)}, x))) > 0 THEN array_to_string(w, ' ') ELSE '' END AS site
FROM (SELECT uid, list_filter(string_split({_NORM.format('n')}, ' '), lambda x: x <> '' AND NOT list_contains({_list(text.STOP_WORDS + text.SITE_WORDS)}, x) AND length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+[a-z]?')) AS w
FROM (SELECT uid, {_pick_sql(_SITES, 'nation')} || ' ' || (sqft % 100) || chr(CAST(65 + nation AS INTEGER)) AS n FROM ({_LISTINGS})))""")
def site_names(spark, sf_dir):
    name = F.concat(_pick(_SITES, F.col("nation")), F.lit(" "), (F.col("sqft") % 100).cast("string"), F.char(F.lit(65) + F.col("nation")))
    return listings(spark, sf_dir).select("uid", text.site_name(name).alias("site"))


@_query("""SELECT o_custkey, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) <= 4 THEN array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] ELSE array_to_string(l[1:4], ', ') || ' and more' END AS names
FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS l FROM orders GROUP BY o_custkey)""")
def names_joined(spark, sf_dir):
    """At most five different priorities for each customer."""
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.names_text(F.array_sort(F.collect_set("o_orderpriority"))).alias("names"))


@_query(r"""SELECT doc_id, md5(regexp_replace(chr(1) || replace(coalesce(text, ''), ' ', chr(11)), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS clean FROM documents""")
def control_characters(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_controls(F.concat(F.char(F.lit(1)), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.char(F.lit(11)))))).alias("clean"))


@_query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '(?i)([?&](?:key|api_key)=)[^&\s)''"]+', '\1REDACTED', 'g'), '(?i)\b(token|secret|password)=[^&\s]+', '\1=***', 'g'), '(?i)(^|[^?&\w])(key|api_key)=[^&\s]+', '\1\2=***', 'g'), '(?i)\bBearer\s+\S+', 'Bearer ***', 'g') AS safe
FROM (SELECT page_id, coalesce(url, '') || '?a=1&KEY=s' || page_id || '&token=t&api_key=y' || page_id || ') key=z bearer x' || page_id AS u FROM pages)""")
def redacted_urls(spark, sf_dir):
    k = F.col("page_id").cast("string")
    return _table(spark, sf_dir, "pages").select("page_id", text.without_secrets(F.concat(F.coalesce("url", F.lit("")), F.lit("?a=1&KEY=s"), k, F.lit("&token=t&api_key=y"), k, F.lit(") key=z bearer x"), k)).alias("safe"))


_ENTITIES = ["&lt;", "&gt;", "&quot;", "&#39;", "&#x27;", "&apos;", "&nbsp;", "&amp;"]


def _unescaped_sql(inner: str) -> str:
    for name in _ENTITIES:
        inner = f"replace({inner}, {_q(name)}, {_q(text.ENTITIES[name])})"
    return inner


_PLAIN = r"""regexp_replace(regexp_replace(CASE WHEN trim(ti) <> '' THEN ti ELSE t END, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!/?a-z][^>]*>', ' ', 'g'), '(?i)([?&](?:key|api_key)=)[^&\s)''"]+', '\1REDACTED', 'g')"""


@_query(rf"""SELECT page_id, CASE WHEN length(l) <= 300 THEN l ELSE rtrim(l[1:297]) || '...' END AS reason FROM (SELECT page_id, trim(regexp_replace({_unescaped_sql(_PLAIN)}, '[\s\x{{00A0}}]+', ' ', 'g')) AS l
FROM (SELECT page_id, t, regexp_extract(t, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS ti FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(replace(coalesce(html, ''), 'title>', 'b>'), 'h1>', 'b>') ELSE '<TITLE lang="en">504 &amp; page ' || page_id || '?key=abc</title>' || coalesce(html, '') END AS t FROM pages)))""")
def failure_reasons(spark, sf_dir):
    """Answers of servers as one line each."""
    html = F.coalesce("html", F.lit(""))
    bare = F.replace(F.replace(html, F.lit("title>"), F.lit("b>")), F.lit("h1>"), F.lit("b>"))
    page = F.concat(F.lit('<TITLE lang="en">504 &amp; page '), F.col("page_id").cast("string"), F.lit("?key=abc</title>"), html)
    return _table(spark, sf_dir, "pages").select("page_id", text.reason(F.when(F.col("page_id") % 3 == 0, bare).otherwise(page)).alias("reason"))


@_query("""SELECT p_partkey, array_to_string(list_transform(string_split(replace(replace(t, '_', ' '), ';', ', '), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda v: upper(v[1]) || lower(v[2:])), '-')), ' ') AS shown
FROM (SELECT p_partkey, replace(lower(p_type), ' ', '_') || ';drive-in;' || lower(p_name) AS t FROM part)""")
def pretty_tags(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.pretty_tag(F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit(";drive-in;"), F.lower("p_name"))).alias("shown"))


@_query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN list_position(c, x) = i THEN x END for x, i in c], lambda y: y IS NOT NULL), ',') AS words, list_has_any(a, b) AS meets, list_has_all(b, a) AS inside
FROM (SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(upper(p_name), ' ') AS b, string_split(p_type, ' ') || string_split(upper(p_name), ' ') AS c FROM part)""")
def ordered_sets(spark, sf_dir):
    a, b = F.split("p_type", " "), F.split(F.upper("p_name"), " ")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.ordered_union(a, b), ",").alias("words"), F.arrays_overlap(a, b).alias("meets"), (F.size(F.array_except(a, b)) == 0).alias("inside"))


_TERMS_ASKED, _STARTS = ["license", "the quick", "new york"], ["licen", "qui"]


@_query(f"""SELECT doc_id, regexp_matches(' ' || n || ' ', ' ({"|".join(_TERMS_ASKED)}) ') AS whole, regexp_matches(' ' || n, ' ({"|".join(_STARTS)})') AS opening FROM (SELECT doc_id, {_NORM.format("coalesce(text, '')")} AS n FROM documents)""")
def term_matches(spark, sf_dir):
    n = text.normalize("text")
    return _table(spark, sf_dir, "documents").select("doc_id", text.has_term(n, _TERMS_ASKED).alias("whole"), text.has_term(n, _STARTS, whole=False).alias("opening"))


_SEEN_HOSTS = [("api.places.example", "Google"), ("api.listings.example", "Yelp"), ("maps.example", "Map")]


@_query(f"""SELECT h AS host, source, count(*) AS n FROM (SELECT split_part(regexp_replace(lower(u), '^(https?://)?(www\\d?\\.)?', ''), '/', 1) AS h FROM (SELECT 'https://' || {_pick_sql([h for h, _ in _SEEN_HOSTS] + ['other.example'], 'page_id')} || '/v1/' || page_id AS u FROM pages)) LEFT JOIN (VALUES {", ".join(f"({_q(a)}, {_q(b)})" for a, b in _SEEN_HOSTS)}) t(h, source) USING (h) GROUP BY ALL""")
def sources_of_hosts(spark, sf_dir):
    """Requests by the source that their host belongs to."""
    url = F.concat(F.lit("https://"), _pick([h for h, _ in _SEEN_HOSTS] + ["other.example"], F.col("page_id")), F.lit("/v1/"), F.col("page_id").cast("string"))
    known = spark.createDataFrame(_SEEN_HOSTS, "host string, source string")
    return _table(spark, sf_dir, "pages").select(text.host(url).alias("host")).join(F.broadcast(known), "host", "left").groupBy("host", "source").agg(F.count(F.lit(1)).alias("n"))  # three hosts


@_query("SELECT doc_id, sha256('salt' || chr(10) || coalesce(text, '')) AS h FROM documents")
def salted_fingerprints(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.fingerprint("salt", F.coalesce("text", F.lit(""))).alias("h"))


@_query("""SELECT p_partkey, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS cell FROM (SELECT p_partkey, ['=', '+', '-', '@', chr(9), '', ' '][CAST(p_partkey % 7 AS INTEGER) + 1] || p_name AS t FROM part)""")
def guarded_cells(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.guarded_formula(F.concat(_pick(["=", "+", "-", "@", "\t", "", " "], F.col("p_partkey")), F.col("p_name"))).alias("cell"))


# ---------------------------------------------------------------- geography

_RING = [(40.2, -111.9), (40.8, -111.7), (40.7, -111.2), (40.45, -111.5), (40.3, -111.1)]
_EDGES = ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(_RING, _RING[1:] + _RING[:1], strict=True))


@_query(f"""SELECT uid, coalesce(n, 0) % 2 = 1 AS inside FROM ({_LISTINGS}) LEFT JOIN (SELECT uid, count(*) AS n FROM ({_LISTINGS}) JOIN (VALUES {_EDGES}) e(a, b, c, d) ON (a > lat) <> (c > lat) AND lon < (d - b) * (lat - a) / (c - a) + b GROUP BY uid) USING (uid)""")
def points_in_polygon(spark, sf_dir):
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in _RING))
    return listings(spark, sf_dir).select("uid", geo.in_polygon(F.col("lat"), F.col("lon"), ring).alias("inside"))


@_query(f"""SELECT uid, round(t, 7) AS lat, round(lon + degrees(atan2(sin(radians(b)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(radians(t)))), 7) AS lon FROM (SELECT *, degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(b)))) AS t FROM (SELECT *, nation * 2.5 / 3958.8 AS d, CAST(sqft % 360 AS DOUBLE) AS b FROM ({_LISTINGS})))""")
def offset_points(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("p", geo.offset_point(F.col("lat"), F.col("lon"), F.col("nation") * 2.5, (F.col("sqft") % 360).cast("double")))
    return rows.select("uid", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


_TOWARDS = "degrees(atan2((lon + 111.5013) * cos(radians(40.5007)), lat - 40.5007))"


@_query(f"""SELECT uid, round(b, 6) AS degrees, {_list(geo.COMPASS)}[CAST(round_even(b / 45, 0) AS INTEGER) % 8 + 1] AS word FROM (SELECT uid, ({_TOWARDS} + 360) % 360 AS b FROM ({_LISTINGS}))""")
def compass_words(spark, sf_dir):
    b = geo.bearing(F.lit(40.5007), F.lit(-111.5013), F.col("lat"), F.col("lon"))
    return listings(spark, sf_dir).select("uid", F.round(b, 6).alias("degrees"), geo.compass_word(b).alias("word"))


_CIRCLE = "SELECT uid, sum(degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(i * 30.0))))) AS total, count(*) AS n FROM (SELECT uid, lat, lon, (1 + nation) / 3958.8 AS d, unnest(range(12)) AS i FROM ({})) GROUP BY uid"


@_query(f"SELECT uid, n, round(total, 6) AS lats FROM ({_CIRCLE.format(_LISTINGS)})")
def circle_points(spark, sf_dir):
    ring = geo.circle(F.col("lat"), F.col("lon"), (F.col("nation") + 1).cast("double"), 12)
    rows = listings(spark, sf_dir).withColumn("ring", ring)
    return rows.select("uid", F.size("ring").cast("long").alias("n"), F.round(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["lat"]), 6).alias("lats"))


@_query(f"""SELECT uid, round(s, 7) AS s, round(w, 7) AS w, round(n, 7) AS n, round(e, 7) AS e, 40.5 BETWEEN s AND n AND -111.5 BETWEEN w AND e AS holds FROM (SELECT uid, lat - m / 69.0 AS s, lat + 0.01 + m / 69.0 AS n, lon - m / 69.0 / greatest(0.2, cos(radians((lat + lat + 0.01) / 2))) AS w, lon + 0.01 + m / 69.0 / greatest(0.2, cos(radians((lat + lat + 0.01) / 2))) AS e FROM (SELECT *, 7.5 AS m FROM ({_LISTINGS})))""")
def grown_boxes(spark, sf_dir):
    box = F.struct(F.col("lat").alias("s"), F.col("lon").alias("w"), (F.col("lat") + 0.01).alias("n"), (F.col("lon") + 0.01).alias("e"))
    rows = listings(spark, sf_dir).withColumn("g", geo.grown_box(box, 7.5))
    return rows.select("uid", *(F.round(f"g.{c}", 7).alias(c) for c in "swne"), geo.in_box(F.lit(40.5), F.lit(-111.5), F.col("g")).alias("holds"))


_ODD = "CASE nation WHEN 1 THEN NULL WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 0.0 WHEN 4 THEN 91.0 ELSE lat END"


@_query(f"SELECT uid, coalesce(NOT isnan(la) AND la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND NOT (la = 0 AND lo = 0), false) AS ok FROM (SELECT uid, {_ODD} AS la, CASE nation WHEN 3 THEN 0.0 ELSE lon END AS lo FROM ({_LISTINGS}))")
def valid_positions(spark, sf_dir):
    n = F.col("nation")
    lat = F.when(n == 1, None).when(n == 2, F.lit(float("nan"))).when(n == 3, 0.0).when(n == 4, 91.0).otherwise(F.col("lat"))
    return listings(spark, sf_dir).select("uid", geo.has_position(lat, F.when(n == 3, 0.0).otherwise(F.col("lon"))).alias("ok"))


# ---------------------------------------------------------------- civil time (all events lie in winter: seven hours behind)

_LOCAL = "ts - INTERVAL 7 HOUR"


@_query(f"SELECT event_id, strftime({_LOCAL}, '%b %-d, %Y, %-I:%M %p') AS shown FROM events")
def clock_texts(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", time.clock_text(F.col("ts")).alias("shown"))


@_query(f"""SELECT event_id, CASE d WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE strftime(l, '%b %-d') END || ' at ' || strftime(l, '%-I:%M %p') AS shown FROM (SELECT event_id, {_LOCAL} AS l, date_diff('day', DATE '2024-01-15', CAST({_LOCAL} AS DATE)) AS d FROM events)""")
def day_texts(spark, sf_dir):
    now = F.lit("2024-01-15 20:00:00").cast("timestamp_ntz")
    return _table(spark, sf_dir, "events").select("event_id", time.day_clock_text(F.col("ts"), now).alias("shown"))


@_query(f"SELECT strftime({_LOCAL}, '%Y-%m-01') AS month, strftime(CAST({_LOCAL} AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def months_and_days(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(time.month_start(F.col("ts")).cast("string").alias("month"), time.civil_day(F.col("ts")).cast("string").alias("day"))
    return e.groupBy("month", "day").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT event_id, round(25569.0 + (epoch_us(ts) // 1000000 - 25200) / 86400.0, 8) AS serial FROM events")
def excel_serials(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.round(time.excel_serial(F.col("ts"), -25200), 8).alias("serial"))


@_query(f"SELECT event_id, isodow(l) < 6 AND hour(l) * 60 + minute(l) >= 440 AND hour(l) * 60 + minute(l) < 1140 AS working FROM (SELECT event_id, {_LOCAL} AS l FROM events)")
def work_hours(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", time.work_hours(F.col("ts")).alias("working"))


# ---------------------------------------------------------------- what a listing is

#: Words of every list that names are tested by, and words that say nothing.
_NAMES = [
    *(words[k % len(words)] for words in (K.NON_PROSPECT_WORDS, K.STORAGE_WORDS, K.COLD_WORDS, K.LOGISTICS_WORDS, K.WASH_WORDS, K.SERVICE_PLANT_WORDS, K.CLINIC_WORDS, K.UTILITY_WORDS, K.PARCEL_CARRIERS, K.PARCEL_STATIONS, K.NOT_PLANT_WORDS) for k in (0, 1, 5)),
    "storage", "hospital", "Alder & Birch", "", "Co-op", "Warehouse", "Building 4",
]
_TAG_CHOICES = [
    "building=industrial", "shop=mall;gift", "man_made=works", "store", "yelp:breweries", *(k if v is None else f"{k}={v}" for k, v in (K.NON_PROSPECT_TAGS[0], K.UTILITY_TAGS[0], K.RESCUE_TAGS[0], K.STORAGE_TAGS[0], K.WASH_TAGS[0])),
    K.NON_PROSPECT_TYPES[0], f"yelp:{K.NON_PROSPECT_ALIASES[0]}", K.RESCUE_TYPES[0], K.STORAGE_TYPES[0], "operator=" + K.PARCEL_CARRIERS[0],
]


def _facts(spark, sf_dir):
    """Names of two parts and two tags, by the arithmetic of a part's key; with the facts that rules look at."""
    k = F.col("p_partkey")
    name = F.concat_ws(" ", _pick(_NAMES, k), _pick(_NAMES, F.floor(k / len(_NAMES)) + k * 3))
    rows = _table(spark, sf_dir, "part").select(
        k, name.alias("name"), F.array(_pick(_TAG_CHOICES, k), _pick(_TAG_CHOICES, F.floor(k / 7))).alias("raw_categories"), F.array().cast("array<string>").alias("search_terms"), (F.col("p_size") * 200).cast("int").alias("footprint_sqft"))
    return classify.with_facts(rows)


_n = len(_NAMES)
_PARTS = f"""SELECT p_partkey, p_size * 200 AS sqft, ' ' || {_NORM.format(f"{_pick_sql(_NAMES, 'p_partkey')} || ' ' || {_pick_sql(_NAMES, f'p_partkey // {_n} + p_partkey * 3')}")} || ' ' AS name, [{_pick_sql(_TAG_CHOICES, 'p_partkey')}, {_pick_sql(_TAG_CHOICES, 'p_partkey // 7')}] AS raw FROM part"""


def _in_name(words: list[str], column: str = "name") -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(' ' + text.plain(w) + ' ')})" for w in words if text.plain(w)) + ")"


def _has_tag(tags: list[tuple[str, str | None]]) -> str:
    one = lambda k, v: f"(x = {_q(k)} OR starts_with(x, {_q(k + '=')}))" if v is None else f"(starts_with(x, {_q(k + '=')}) AND list_contains(string_split(substr(x, {len(k) + 2}), ';'), {_q(v)}))"
    return "(len(list_filter(raw, lambda x: " + " OR ".join(one(k, v) for k, v in tags) + ")) > 0)"


def _has_type(types: list[str]) -> str:
    return f"list_has_any(raw, {_list(types)})"


_RESCUED = _has_tag(K.RESCUE_TAGS)


@_query(f"""SELECT p_partkey, {_has_type(K.NON_PROSPECT_TYPES)} OR {_has_type(['yelp:' + a for a in K.NON_PROSPECT_ALIASES])} OR {_has_tag(K.NON_PROSPECT_TAGS)} AS not_type, {_in_name(K.NON_PROSPECT_WORDS)} AND NOT ({_RESCUED} OR {_has_type(K.RESCUE_TYPES)}) AS not_name FROM ({_PARTS})""")
def never_prospects(spark, sf_dir):
    return _facts(spark, sf_dir).select("p_partkey", classify.non_prospect_type().alias("not_type"), classify.non_prospect_name().alias("not_name"))


@_query(f"""SELECT p_partkey, {_has_tag(K.UTILITY_TAGS)} AND NOT {_RESCUED} AS structure, {_in_name(K.SERVICE_PLANT_WORDS)} AS plant, sqft > 0 AND sqft < {K.SMALL_BUILDING_SQFT} AND len(list_filter(raw, lambda x: starts_with(x, 'industrial=') OR starts_with(x, 'man_made=works'))) = 0 AS small FROM ({_PARTS})""")
def utility_and_small_buildings(spark, sf_dir):
    return _facts(spark, sf_dir).select("p_partkey", classify.utility_structure().alias("structure"), classify.service_plant().alias("plant"), classify.small_generic_building().alias("small"))


@_query(f"""SELECT p_partkey, NOT {_RESCUED} AND ({_has_tag(K.STORAGE_TAGS)} OR {_has_type(K.STORAGE_TYPES)} OR {_in_name(K.STORAGE_WORDS)} OR ({_in_name(['storage'])} AND NOT {_in_name(K.COLD_WORDS + K.LOGISTICS_WORDS)})) AS storage FROM ({_PARTS})""")
def self_storages(spark, sf_dir):
    return _facts(spark, sf_dir).select("p_partkey", classify.self_storage().alias("storage"))


_OWNERS = "' ' || " + _NORM.format("array_to_string(list_transform(list_filter(raw, lambda x: starts_with(x, 'operator=') OR starts_with(x, 'brand=')), lambda x: substr(x, strpos(x, '=') + 1)), ' ')") + " || ' '"


@_query(f"""SELECT p_partkey, {_in_name(K.PARCEL_CARRIERS, 'both_')} AND {_in_name(K.PARCEL_STATIONS, 'both_')} AS parcel FROM (SELECT *, name || {_OWNERS} AS both_ FROM ({_PARTS}))""")
def parcel_stations(spark, sf_dir):
    return _facts(spark, sf_dir).select("p_partkey", classify.parcel_station().alias("parcel"))


@_query(f"""SELECT p_partkey, {_in_name(K.WASH_WORDS)} OR {_has_tag(K.WASH_TAGS)} AS wash, {_in_name(K.CLINIC_WORDS)} AND NOT {_in_name(['hospital', 'hospitals'])} AS clinic FROM ({_PARTS})""")
def washes_and_clinics(spark, sf_dir):
    return _facts(spark, sf_dir).select("p_partkey", classify.vehicle_wash().alias("wash"), classify.clinic().alias("clinic"))


_PLACES = ["Warehouse", "warehouse at 5 Main St", "Office Building 12", "Alder Office", "Apartments near K St", "Main Warehouse, Provo", "The Building", "Birch Foods"]


@_query(f"""SELECT p_partkey, len(list_filter(w, lambda x: list_contains({_list(K.BUILDING_WORDS)}, x))) > 0 AND len(list_filter(w, lambda x: NOT (list_contains({_list(K.BUILDING_WORDS + K.FILLER_WORDS)}, x) OR regexp_full_match(x, '[0-9]+|.')))) = 0 AS building,
list_contains({_list(sorted({text.plain(g) for g in K.GENERIC_NAMES}))}, {_NORM.format("split_part(regexp_replace(trim(n), '\\s+(at|near)\\s+', ',', 'g'), ',', 1)")}) AS generic FROM (SELECT p_partkey, n, string_split({_NORM.format('n')}, ' ') AS w FROM (SELECT p_partkey, {_pick_sql(_PLACES, 'p_partkey')} || CASE WHEN p_size > 25 THEN ' ' || p_size ELSE '' END AS n FROM part))""")
def nameless_buildings(spark, sf_dir):
    name = F.concat(_pick(_PLACES, F.col("p_partkey")), F.when(F.col("p_size") > 25, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(""))
    return _table(spark, sf_dir, "part").select("p_partkey", name.alias("n")).select("p_partkey", building_name(text.normalize("n")).alias("building"), generic_name("n").alias("generic"))


@_query(f"SELECT p_partkey, {_has_tag([('shop', 'gift')])} AS gift, {_has_tag([('building', None)])} AS building, {_has_tag([('shop', 'mall'), ('man_made', 'works')])} AS either FROM ({_PARTS})")
def tag_predicates(spark, sf_dir):
    raw = F.col("_raw")
    return _facts(spark, sf_dir).select("p_partkey", classify.has_tag(raw, [("shop", "gift")]).alias("gift"), classify.has_tag(raw, [("building", None)]).alias("building"), classify.has_tag(raw, [("shop", "mall"), ("man_made", "works")]).alias("either"))


@_query(f"""SELECT a.uid AS uid, round({_miles('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS miles FROM ({_LISTINGS}) a JOIN ({_LISTINGS}) b ON a.nation = CAST(substr(b.uid, 2) AS BIGINT) AND b.uid LIKE 'c%'""")
def miles_between(spark, sf_dir):
    a, b = listings(spark, sf_dir), listings(spark, sf_dir).filter("uid like 'c%'").select(F.substring("uid", 2, 20).cast("long").alias("nation"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "nation").select("uid", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("miles"))


