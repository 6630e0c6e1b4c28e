"""Sources, classification, resolution and the list, on small examples."""

import datetime as dt
import io
import json
import random
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plotmere.functions import geo, text
from plotmere.operators import activity, listing, resolve, stats
from plotmere.operators.score import flag_types, score
from plotmere.operators.shared import connected
from plotmere.plans import search as plans
from plotmere.sources import exports, listings
from plotmere.sources.requests import RecordedAnswers
from plotmere.streaming import activity as streams

LISTING = (
    "rid long, name string, phone string, lat double, lon double, source string, source_id string, raw_categories array<string>, website string, address string, city string, state string, "
    "zip string, rating_count int, yelp_reviews int, footprint_sqft long, business_status string, outline struct<s:double,w:double,n:double,e:double>, search_terms array<string>, primary_category string"
)


def lead(rid, name, lat=40.7, lon=-111.9, source="osm", source_id=None, phone="", tags=(), **more):
    row = dict(rid=rid, name=name, phone=phone, lat=lat, lon=lon, source=source, source_id=source_id or str(rid), raw_categories=list(tags), website="", address="", city="", state="", zip="",
               rating_count=None, yelp_reviews=None, footprint_sqft=None, business_status="", outline=None, search_terms=[], primary_category="")
    row.update(more)
    return tuple(row.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, LISTING)


#: One made-up listing for each rule, and what it becomes: (name, tags, phrase that found it, category, rule).
EXAMPLES = [
    ("Quokka Balers", ["building=warehouse"], "", "equipment", "equipment name"),
    ("Lakeside Fire Station", ["building=retail"], "", None, "not-a-prospect name"),
    ("Ridge Tank", ["man_made=water_tower"], "", None, "utility structure"),
    ("Copper Hill Power Station", [], "", None, "utility plant"),
    ("Bubbles Car Wash", ["shop=clothes"], "", None, "vehicle wash"),
    ("Willow Urgent Care", ["hospital"], "", None, "clinic"),
    ("Green Door Storage Units", ["building=warehouse"], "", None, "self-storage"),
    ("Mattress Warehouse", ["building=yes"], "", "specialty_retail", "retail chain"),
    ("Fern Foods", ["winery", "yelp:wineries"], "", "food_production", "production listing"),
    ("Pine Peak Ski Resort", ["shop=hardware"], "", "hospitality", "resort or mall name"),
    ("Plum", ["tourism=hotel"], "", "hospitality", "own category"),
    ("Maple Lofts", ["real_estate_agency"], "", "multifamily", "name beats type"),
    ("Nettle", ["dentist"], "", None, "not-a-prospect type"),
    ("Odds and Ends", ["shop=tea"], "", "retail", "shop"),
    ("Nimbus Data Center", ["building=industrial"], "", None, "not a plant"),
    ("Juniper Fabrication", [], "", "manufacturing", "catch-all tag or name"),
    ("Hazel Brothers", ["establishment"], "cold storage", "distribution", "search phrase"),
    ("Hazel Brothers", ["establishment"], "tea rooms", None, "nothing matched"),
]


def test_each_rule_decides(spark):
    rows = [lead(i, name, tags=tags, search_terms=[phrase] if phrase else []) for i, (name, tags, phrase, _, _) in enumerate(EXAMPLES)]
    got = {r.rid: (r.category_key, r.rule) for r in score(frame(spark, rows)).collect()}
    assert got == {i: e[3:] for i, e in enumerate(EXAMPLES)}
    assert len({e[4] for e in EXAMPLES}) == 18


def test_resolved_listings_keep_what_was_merged(spark):
    """Sources, parts, other names, phrases and outlines go through both merges; only parts of a site are merged twice."""
    box = lambda y, x: (y - 0.004, x - 0.004, y + 0.004, x + 0.004)
    rows = [
        lead(1, "Fern Foods", source="google", source_id="a", lat=40.7, lon=-111.9, phone="801-555-0101", search_terms=["foods"], primary_category="Maker"),
        lead(2, "Fern Foods Inc", source="osm", source_id="b", lat=40.7003, lon=-111.9, search_terms=["meats", "foods"]),
        lead(3, "Fern Foods", source="yelp", source_id="c", lat=40.7, lon=-111.9002, website="fern.example"),
        lead(4, "Plum Ridge 825", source="osm", source_id="d", lat=40.5, lon=-111.8, outline=box(40.5, -111.8)),
        lead(5, "Plum Ridge 826", source="osm", source_id="e", lat=40.503, lon=-111.8),
        lead(6, "Alone", source="osm", source_id="f", lat=40.2, lon=-111.8),
    ]
    got = {r.name: r for r in resolve.resolve(frame(spark, rows)).collect()}
    assert set(got) == {"Fern Foods", "Plum Ridge", "Alone"}
    fern = got["Fern Foods"]
    assert (fern.sources, fern.n_parts, fern.search_terms, fern.primary_category) == (["google", "osm", "yelp"], 3, ["foods", "meats"], "Maker") and "Fern Foods Inc" in fern.alt_names
    assert got["Plum Ridge"].n_parts == 2 and set(got["Plum Ridge"].alt_names) == {"Plum Ridge 825", "Plum Ridge 826"} and got["Plum Ridge"].outline is not None


def test_names_of_tags_and_places(spark):
    row = spark.range(1).select(text.pretty_tag(F.lit("fast_food;drive-in")).alias("t"), *(listings.part_label(F.lit(n)).alias(f"p{i}") for i, n in enumerate(["Building B", "bldg. 12", "Suite #4", "B Tower", "Unit", "Building Supplies", "3M"]))).first()
    assert tuple(row) == ("Fast Food, Drive-In", True, True, True, True, False, False, False)


def test_scores_add_up_and_nulls_pass(spark):
    rows = [
        lead(1, "Costco Wholesale", tags=["warehouse_store"], rating_count=3000, footprint_sqft=150_000),
        lead(2, "Warehouse Building B", tags=["building=warehouse"]),
        lead(3, None, tags=[], phone=None, website=None, address=None),
        lead(4, "Hotel near Costco", tags=["tourism=hotel"]),
    ]
    found = {r.rid: r for r in score(frame(spark, rows), ["whole"]).collect()}
    assert found[1].score == 34 + 20 + 15 + 15 + 10 and found[1].tier == "A" and found[1].brand == "costco"
    assert found[2].score == 19 and found[2].tier == "D"
    assert found[3].score == 0 and found[4].brand is None


def test_flags_by_dictionary(spark):
    known = spark.createDataFrame([("Valley Balers", "Competitor", 1), ("valley", "Own", 2)], "alias string, kind string, ord int")
    found = {r.rid: r.matched_kind for r in flag_types(frame(spark, [lead(1, "Valley Balers of Utah"), lead(2, "The Valley"), lead(3, "Other")]), known).collect()}
    assert found == {1: "Competitor", 2: "Own", 3: None}


def groups_of(spark, rows):
    found = resolve.group_duplicates(frame(spark, rows)).filter("grp is not null").collect()
    out = {}
    for r in found:
        out.setdefault(r.grp, set()).add(r.rid)
    return sorted(map(sorted, out.values()))


def test_duplicates_do_not_chain(spark):
    # Each is near the next, the first and the last are too far apart for their names.
    rows = [lead(1, "Alder Foods", lat=40.7000), lead(2, "Alder Foods", lat=40.7028), lead(3, "Alder Foods", lat=40.7056)]
    assert len(groups_of(spark, rows)) == 2
    expected = None
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        found = groups_of(spark, [rows[i] for i in order])
        expected = expected or found
        assert found == expected


def test_duplicate_rules(spark):
    rows = [
        lead(1, "Acme Foods", source="google", source_id="a"), lead(2, "Acme Food", lat=40.7003),
        lead(10, "Building 1 Acme", lat=41.0), lead(11, "Building 2 Acme", lat=41.0),
        lead(20, "Alpha", lat=41.5, phone="801-555-0100"), lead(21, "Beta", lat=41.5002, phone="+1 801 555 0100"),
        lead(30, "Gamma Hotel", lat=42.0, phone="801-555-0100"), lead(31, "Gamma Hotel Two", lat=42.0, phone="801-555-0199"),
        lead(40, "Far Name", lat=43.0), lead(41, "Far Name", lat=43.02), lead(50, "No Place", lat=None), lead(51, "No Place", lat=None),
    ]
    assert groups_of(spark, rows) == [[1, 2], [10], [11], [20, 21], [30], [31], [40], [41], [50], [51]]


def test_many_copies_are_one_node(spark):
    rows = [lead(i, "Chain Store Acme", lat=40.70001 + (i % 7) * 1e-5, source_id=str(i)) for i in range(400)] + [lead(999, "Other", lat=40.7)]
    assert [len(g) for g in groups_of(spark, rows)] == [400, 1]
    listings_ = resolve.prepared(frame(spark, rows))
    assert resolve.candidate_pairs(listings_.limit(0)).count() == 0


def test_every_pair_of_a_group_is_a_duplicate(spark):
    rng = random.Random(5)
    rows = [lead(i, rng.choice(["Alder Foods", "Alder Food", "Birch Mill", "Birch Mills Acme"]), lat=40.7 + rng.random() / 100, lon=-111.9 + rng.random() / 100) for i in range(60)]
    pairs = resolve.duplicates(resolve.candidate_pairs(resolve.prepared(frame(spark, rows)))).select("a.rid", F.col("b.rid").alias("o")).collect()
    linked = {frozenset(p) for p in pairs}
    for g in groups_of(spark, rows):
        assert all(frozenset((x, y)) in linked for x in g for y in g if x < y)


def test_blocking_loses_no_pair(spark):
    rng = random.Random(7)
    rows = [(i, 60.0 + rng.random() / 20, 10 + rng.random() / 20) for i in range(200)]
    df = spark.createDataFrame(rows, "rid long, lat double, lon double")
    got = {(r.x, r.y) for r in resolve.candidate_pairs(df).select(F.col("a.rid").alias("x"), F.col("b.rid").alias("y")).collect()}
    miles = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    other = df.toDF("rid2", "lat2", "lon2")
    assert got == {(r.rid, r.rid2) for r in df.join(other, F.col("rid") < F.col("rid2")).filter(miles <= 0.5).collect()}


def test_merge_and_closures(spark):
    rows = [
        lead(1, "Acme Foods", source="google", source_id="g", business_status="CLOSED_PERMANENTLY", phone="801-555-0100", tags=["supermarket"], rating_count=5),
        lead(2, "Acme Foods", lat=40.7001, tags=["shop=supermarket", "amenity=parking"], footprint_sqft=900, website="acme.com"),
    ]
    df = frame(spark, rows)
    merged = resolve.merge_groups(df, resolve.group_duplicates(df)).collect()
    assert len(merged) == 1
    got = merged[0]
    assert got.business_status == "CLOSED_PERMANENTLY" and got.website == "acme.com" and got.rating_count == 5 and got.footprint_sqft == 900 and got.n_parts == 2
    assert got.raw_categories == ["shop=supermarket", "amenity=parking", "supermarket"]  # the open listing is the base, with its own tags


def test_sites(spark):
    rows = [lead(i, f"Shoreline Ridge {800 + i}", lat=40.7 + i * 0.001) for i in range(5)] + [lead(20, "343 Apartments"), lead(21, "525 Apartments")]
    assert {r.rid for r in resolve.site_groups(frame(spark, rows)).filter("site = 0").collect()} == set(range(5))


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == find(n) for n in got) and set(got) == {n for a, b in edges if a != b for n in (a, b)}


def test_claims_are_made_once(spark):
    offers = spark.createDataFrame([(1, "a", 0, 0.0, 1.0), (2, "a", 0, 0.0, 1.0), (2, "b", 1, 0.1, 2.0), (3, "b", 0, 0.0, 2.0)], "rid long, uid string, priority int, miles double, first_seen double")
    assert {r.rid: r.uid for r in resolve.match_saved(offers).collect()} == {1: "a", 2: "b", 3: None}


def test_upsert_keeps_first_seen(spark):
    cols = "uid string, v int, first_seen int"
    old, new = spark.createDataFrame([("a", 1, 10), ("b", 2, 10)], cols), spark.createDataFrame([("b", None, 99), ("c", 3, 99)], cols)
    assert {tuple(r) for r in resolve.upsert(old, new).collect()} == {("a", 1, 10), ("b", None, 10), ("c", 3, 99)}


def test_text_functions(spark):
    df = spark.createDataFrame([("O'Neil-Shop & Sons", "+1 801-555-0100;801-555-0199 ext. 2", "https://www.acme.com/x", ["a", "b", "c", "d", "e"]), (None, None, None, [])], "n string, p string, w string, l array<string>")
    a, b = df.select(text.normalize("n").alias("n"), text.split_hyphens("n").alias("h"), text.phone_numbers("p").alias("p"), text.host("w").alias("w"), text.names_text(F.col("l")).alias("l"), text.format_phone("p").alias("f")).collect()
    assert a.n == "oneilshop and sons" and a.h == "oneil shop and sons" and a.p == ["8015550100", "8015550199"] and a.w == "acme.com" and a.l == "a, b, c, d and more"
    assert b.n == "" and b.p == [] and b.l == ""
    ratio = spark.createDataFrame([("acme foods", "acme food"), ("", "x")], "a string, b string").select(resolve.name_ratio("a", "b").alias("r")).collect()
    assert ratio[0].r == SequenceMatcher(None, "acme foods", "acme food").ratio() and ratio[1].r == 0


def test_geometry(spark):
    ring = F.array(*(F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in ((0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0))))
    r = spark.range(1).select(geo.in_polygon(F.lit(1.0), F.lit(1.0), ring).alias("i"), geo.in_polygon(F.lit(5.0), F.lit(1.0), ring).alias("o"), geo.haversine(F.lit(40.7), F.lit(-111.9), F.lit(40.7), F.lit(-111.9)).alias("z"), geo.offset_point(F.lit(40.0), F.lit(-111.0), F.lit(10.0), F.lit(0.0)).alias("p")).first()
    assert r.i and not r.o and r.z == 0 and abs(r.p.lat - 40.1447) < 1e-3
    grids = spark.range(1).select(*(geo.search_cells(F.lit(40.0), F.lit(-111.0), F.lit(30.0), n).alias(f"g{n}") for n in (1, 7, 19))).first()
    assert [len(g) for g in grids] == [1, 7, 19] and grids.g1[0].miles == 30.0


def test_dispositions_sum_to_the_input(spark):
    rows = [(i, i % 50, ["CLOSED_PERMANENTLY", "", None][i % 3], ["Prospect", "Competitor"][i % 7 == 0], ["x"] * (i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "uid long, score int, business_status string, lead_type string, matched_keywords array<string>")
    found = listing.dispositions(df, 20, only_hits=True).groupBy("disposition").count().collect()
    assert sum(r["count"] for r in found) == 100


def test_ratio_rounds_halves_up(spark):
    assert [r[0] for r in spark.createDataFrame([(5, 8), (1, 3), (0, 0)], "p int, w int").select(stats.ratio(F.col("p"), F.col("w"), 100)).collect()] == [63, 33, None]


def test_previous_and_tombstones(spark):
    log = spark.createDataFrame([("u", 1, "a", 1), ("u", 2, "b", 2), ("v", 1, "c", 3)], "uid string, at int, value string, id int")
    assert {(r.id, r.previous) for r in activity.previous_value(log, "uid", "at", "value", "id").collect()} == {(1, ""), (2, "a"), (3, "")}
    assert {r.id for r in activity.without_tombstones(log.union(log), log.filter("id = 2").select("id")).collect()} == {1, 3}


PLACES = {"places": [
    {"id": "p1", "displayName": {"text": "Acme"}, "formattedAddress": "1 Main St, Salt Lake City, UT 84101, USA", "location": {"latitude": 40.7, "longitude": -111.9}, "types": ["supermarket"], "userRatingCount": 7,
     "addressComponents": [{"longText": "Provo", "shortText": "Provo", "types": ["locality"]}, {"longText": "Other", "shortText": "O", "types": ["locality"]}]},
    {"id": "p2", "displayName": {"text": "Bare"}, "formattedAddress": "2 Main St, Ogden, UT 84401, USA", "location": {"latitude": 40.7, "longitude": -111.9}},
]}
BUSINESSES = {"businesses": [{"id": "y1", "name": " Deli ", "url": "https://y.com/a?b=1", "review_count": 3, "is_closed": True, "coordinates": {"latitude": 1.0, "longitude": 2.0}, "location": {"address1": "1 A", "city": "Lehi"}, "categories": [{"alias": "delis", "title": "Delis"}]}], "total": 1}
ELEMENTS = {"elements": [
    {"type": "node", "id": 1, "lat": 40.7, "lon": -111.9, "tags": {"name": "Acme", "shop": "supermarket"}},
    {"type": "way", "id": 2, "bounds": {"minlat": 40.7, "minlon": -111.9, "maxlat": 40.701, "maxlon": -111.899}, "tags": {"name": "Recycling", "building": "yes", "addr:city": "Magna"}},
    {"type": "node", "id": 3, "lat": 1.0, "lon": 1.0, "tags": {"name": "Building B", "building": "yes"}},
    {"type": "node", "id": 4, "lat": 1.0, "lon": 1.0, "tags": {"name": "Old Shop", "disused:shop": "yes"}},
    {"type": "node", "id": 5, "lat": 1.0, "lon": 1.0, "tags": {"shop": "yes"}},
    {"type": "way", "id": 6, "lat": 1.0, "lon": 1.0, "tags": {"name": "Main Street", "highway": "primary"}},
]}


def test_sources(spark, tmp_path):
    for name, value in (("places", PLACES), ("businesses", BUSINESSES), ("elements", ELEMENTS)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    p = {r.source_id: r for r in listings.read(spark, str(tmp_path / "places.json"), "places").collect()}
    assert p["p1"].city == "Provo" and p["p1"].state == "UT" and p["p1"].zip == "84101" and p["p1"].address == "1 Main St" and p["p2"].city == "Ogden" and p["p2"].raw_categories == []
    (b,) = listings.read(spark, str(tmp_path / "businesses.json"), "businesses").collect()
    assert (b.name, b.map_url, b.business_status, b.raw_categories) == ("Deli", "https://y.com/a", "CLOSED_PERMANENTLY", ["yelp:delis"])
    e = {r.source_id: r for r in listings.read(spark, str(tmp_path / "elements.json"), "elements").collect()}
    assert set(e) == {"node/1", "way/2"} and e["way/2"].name == "Recycling, Magna" and e["way/2"].footprint_sqft > 0 and e["way/2"].outline.s == 40.7
    every = [listings.read(spark, str(tmp_path / f"{n}.json"), n) for n in ("places", "elements")]
    found = plans.search(every, plans.Search(40.7, -111.9, least_score=0)).collect()
    assert {r.name for r in found} >= {"Acme", "Bare"} and sum(r.name == "Acme" for r in found) == 1


def test_recorded_answers(spark, tmp_path):
    for page in range(2):
        (tmp_path / f"mill-0-{page}.json").write_text(json.dumps({"page": page}))
    spark.dataSource.register(RecordedAnswers)
    df = spark.read.format("recorded_answers").option("folder", str(tmp_path)).option("phrases", "mill,shop").option("cells", 2).load()
    assert {(r.phrase, r.cell, r.page) for r in df.collect()} == {("mill", 0, 0), ("mill", 0, 1)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "a", None), ("b\x01", None, "")], "name string, city string, empty string")
    exports.write_csv(df, str(tmp_path / "csv"), ["name", "city", "empty"], ["city", "empty"])
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert back.columns == ["name", "city"] and "'=1+1" in {r.name for r in back.collect()}
    with zipfile.ZipFile(io.BytesIO(exports.xlsx_bytes(df, ["name", "city"], {"rows": 2}))) as z:
        assert "=1+1" in z.read("xl/worksheets/sheet1.xml").decode()
    exports.backup({"t": df}, str(tmp_path / "backup"))
    assert exports.read_backup(spark, str(tmp_path / "backup"), "t", df).count() == 2
    new, report = exports.restore(df.limit(1), df, ["name"])
    assert new.count() == 2 and tuple(report.first()) == (2, 1, 1)


def test_list_plan(spark):
    leads = spark.createDataFrame([("a", "Acme Mill", 50, "B", "", "Prospect"), ("b", "Birch", 70, "A", "CLOSED_PERMANENTLY", "Prospect"), ("c", "Cedar Mill", 50, "B", "", "Competitor")], "uid string, name string, score int, tier string, business_status string, lead_type string")
    marks = spark.createDataFrame([("a", 1, 1, "yes", None), ("a", 2, 2, "no", 3)], "uid string, at int, id int, value string, undone_at int")
    calls = spark.createDataFrame([("b", 1, 1, "no answer")], "uid string, at int, id int, outcome string")
    rows = plans.saved_list(leads, marks, calls)
    assert {r.uid: sorted(r.tabs) for r in rows.collect()} == {"a": ["all", "yes"], "b": ["all", "called", "closed"], "c": ["all", "competitors"]}
    assert [r.uid for r in plans.list_page(rows, query="mill", texts=("name",)).collect()] == ["a", "c"]


def test_streams_end(spark, tmp_path):
    spark.sql("select * from values ('r', 'i1', timestamp'2024-01-01 00:00:00'), ('r', 'i1', timestamp'2024-01-01 00:00:20'), ('r', 'i2', timestamp'2024-01-01 00:05:00'), ('q', 'i3', timestamp'2024-01-02 00:00:00') as t(run, id, at)").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("run string, id string, at timestamp").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(streams.run_available(streams.once_by_id(source()))).count() == 3
    streams.run_available(streams.heartbeats(source()))
    streams.run_available(streams.rolling_budget(source(), key="run"))
    list_ = streams.maintain_list(spark, str(tmp_path / "list"))
    batch = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 1, 6)], "uid string, v int, first_seen int, last_seen int")
    list_(batch, 0)
    list_(batch.withColumn("v", F.lit(9)), 1)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "list/v1")).collect()] == [("a", 9, 1, 6)]


def test_rolling_budget_counts_whole_windows(spark, tmp_path):
    start = dt.datetime(2024, 5, 1, 10, 30)
    minutes = [0, 1, 1, 700, 1439, 1441, 1442, 1443, 3000]
    rows = [(n, start + dt.timedelta(minutes=m)) for n in ("a", "b") for m in minutes[: None if n == "a" else 5]] + [(None, start)]
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, "name string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("name string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = spark.read.parquet(streams.run_available(streams.rolling_budget(source)))
    calls = spark.createDataFrame(rows, "name string, at timestamp")
    want = activity.rolling_count(calls, "name", "at").select("name", "at", "in_window")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.collect() if r.name)
    assert max(r.used for r in got.collect() if r.name == "b") == 5
