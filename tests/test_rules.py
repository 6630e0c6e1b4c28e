"""Rules of the list and its searches, each with the case that tells it from what one might take it for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_listings import frame, lead

from plotmere.functions import text, time
from plotmere.operators import listing, resolve, saved, searches, stats
from plotmere.operators.score import flagged
from plotmere.plans import search as plans

AT = lambda minutes: dt.datetime(2026, 1, 5, 12) + dt.timedelta(minutes=minutes)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---------------------------------------------------------------- marks of merged rows


def test_a_merged_row_takes_the_latest_yes_where_marks_disagree(spark):
    groups = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", 2), (2, "d", 1), (2, "e", 2), (3, "f", 1), (3, "g", 2)], "grp long, uid string, first_seen int")
    marks = spark.createDataFrame([("a", "yes", 5.0), ("b", "no", 9.0), ("c", "yes", 7.0), ("d", "no", 1.0), ("e", "no", 4.0)], "uid string, value string, at double")
    got = {r.grp: (r.keep_uid, r.value, r.at, r.given_to, r.disagreed) for r in saved.merged_marks(groups, marks).collect()}
    assert got == {1: ("b", "yes", 7.0, "c", True), 2: ("d", "no", 4.0, "e", False)}


def test_disagreement_lasts_until_a_click_that_stands(spark):
    lineage = spark.createDataFrame([("x", "a", 10.0, True), ("y", "b", 10.0, False), ("z", "c", 10.0, True), ("w", "c", 20.0, True), ("v", "d", 10.0, True), ("u", "e", 10.0, True)], "uid string, into_uid string, at double, disagreed boolean")
    clicks = spark.createDataFrame([("c", 15.0, None), ("d", 10.0, None), ("e", 30.0, 31.0), ("b", 1.0, None)], "uid string, at double, undone_at double")
    # a: never clicked; b: its merge agreed; c: clicked before its last merge; d: clicked at the merge; e: the click was undone
    assert {(r.uid, r.since) for r in saved.disagreements(lineage, clicks).collect()} == {("a", 10.0), ("c", 20.0), ("e", 10.0)}


def test_lineage_carries_marks(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "uid string, v int")
    plan = spark.createDataFrame([("b", "a")], "other_uid string, keep_uid string")
    kept, lineage = saved.with_lineage(rows, plan, F.lit(1.0), marks=spark.createDataFrame([("b", "no")], "uid string, value string"), disagreed=spark.createDataFrame([("a",)], "keep_uid string"))
    assert [r.uid for r in kept.collect()] == ["a"]
    assert [tuple(r) for r in lineage.collect()] == [("b", "a", 1.0, '{"uid":"b","v":2}', "no", True)]
    assert [(r.mark, r.disagreed) for r in saved.with_lineage(rows, plan, F.lit(1.0))[1].collect()] == [("", False)]


# ---------------------------------------------------------------- the saved list


def test_offers_go_by_listing_then_duplicate_then_site(spark):
    leads = frame(spark, [
        lead(1, "Alder Foods", source="google", source_id="g1"), lead(2, "Birch Mill", lat=41.0), lead(3, "Shoreline Ridge 830", lat=42.0, source_id="s"), lead(4, "Cedar", lat=43.0, phone="801-555-0100"), lead(5, "Nobody", lat=44.0),
    ])
    kept = [
        ("old", 5, lead(0, "Far Away", lat=45.0, source="google", source_id="g1")), ("older", 2, lead(0, "Far Too", lat=46.0, source="yelp", source_id="y")),
        ("near", 1, lead(0, "Birch Mills", lat=41.0005, source_id="n")), ("nearer", 9, lead(0, "Birch Mill", lat=41.0001, source_id="m")),
        ("site", 1, lead(0, "Shoreline Ridge", lat=42.0, lon=-111.9025, source_id="x")), ("phone", 1, lead(0, "Other Name", lat=43.0004, phone="801-555-0100", source_id="p")),
    ]
    rows = frame(spark, [(i, *r[1:]) for i, (_, _, r) in enumerate(kept)]).join(spark.createDataFrame([(i, u, s) for i, (u, s, _) in enumerate(kept)], "rid long, uid string, first_seen int"), "rid").drop("rid")
    parts = leads.select("rid", "source", "source_id").union(spark.createDataFrame([(1, "yelp", "y")], "rid long, source string, source_id string"))
    found = saved.offers(leads, rows, lead_parts=parts)
    got = {(r.rid, r.uid): r.priority for r in found.collect()}
    assert got == {(1, "old"): 0, (1, "older"): 0, (2, "near"): 1, (2, "nearer"): 1, (3, "site"): 2, (4, "phone"): 1} or {k: v for k, v in got.items() if k != (3, "site")} == {(1, "old"): 0, (1, "older"): 0, (2, "near"): 1, (2, "nearer"): 1, (4, "phone"): 1}
    claimed = {r.rid: r.uid for r in resolve.match_saved(found).collect()}
    assert claimed[1] == "older" and claimed[2] == "nearer" and claimed[4] == "phone"  # saved first; nearest


def test_part_ids_and_closed_new_rows(spark):
    r = one(spark, saved.part_id(F.lit("osm"), F.lit("5")).alias("a"), saved.part_id(F.lit("osm"), F.lit(None)).alias("b"))
    assert (r.a, r.b) == ("osm:5", "osm:")
    part = "uid string, source string, source_id string, at double"
    old, new = spark.createDataFrame([("a", "osm", "1", 1.0)], part), spark.createDataFrame([("a", "osm", "1", 2.0), ("b", "osm", "2", 2.0), ("c", "osm", "3", 2.0)], part)
    closed = spark.createDataFrame([("a",), ("b",)], "uid string")
    assert {(r.uid, r.is_new) for r in saved.saved_again(old, new, closed).collect()} == {("a", False), ("c", True)}


def test_rows_are_rebuilt_from_all_their_parts(spark):
    rows = [lead(1, "Alder Foods", source="osm", source_id="1", tags=["shop=supermarket"]), lead(2, "Alder Foods", source="google", source_id="2", tags=["supermarket"], phone="801-555-0100"), lead(3, "Birch Balers", source_id="3", address="1 Main")]
    parts = frame(spark, rows).join(spark.createDataFrame([(1, "a", 5.0), (2, "a", 1.0), (3, "b", 1.0)], "rid long, uid string, at double"), "rid").drop("rid")
    got = {r.uid: r for r in saved.rebuilt(parts, spark.createDataFrame([("b",)], "uid string")).collect()}
    assert got["a"].phone == "801-555-0100" and got["a"].source == "google" and got["a"].raw_categories == ["supermarket", "shop=supermarket"] and got["a"].score >= 0
    assert got["b"].business_status == "CLOSED_PERMANENTLY" and got["b"].matched_keywords == ["baler"] and got["a"].business_status == ""


# ---------------------------------------------------------------- the list


def rows_of(spark):
    rows = [  # place, score, name, city, phone, verified, miles, called
        ("a", 0, 50, "Zed", "orem", "", "", 3.0, None, ["all", "unchecked"]), ("b", 1, 50, "alder", "", "801", "", None, AT(5), ["all", "unchecked"]), ("c", 2, 40, "Birch", "Provo", "801", "802", 1.0, AT(9), ["all", "unchecked"]), ("d", 3, 30, "cedar", "Provo", " ", "", 2.0, None, ["all", "yes"]),
    ]
    return spark.createDataFrame(rows, "uid string, place int, score int, name string, city string, phone string, verified_phone string, distance_miles double, last_call_at timestamp, tabs array<string>")


@pytest.mark.parametrize(
    "sort, descending, tab, expected",
    [
        ("score", None, "unchecked", "bacd"), ("score", None, "all", "abcd"), ("score", False, "unchecked", "dcab"), ("name", None, "all", "bcda"), ("name", True, "all", "adcb"),
        ("city", None, "all", "acdb"), ("city", True, "all", "bcda"),  # a missing town is "~": it turns with the order
        ("contact", None, "all", "cbad"), ("miles", None, "all", "cdab"), ("miles", True, "all", "badc"), ("called", None, "all", "cbad"), ("called", False, "all", "adbc"),
    ],
)
def test_sorts(spark, sort, descending, tab, expected):
    assert "".join(r.uid for r in listing.sorted_by(rows_of(spark), sort, descending, tab=tab).collect()) == expected


def test_unknown_sorts_and_pinned_rows(spark):
    with pytest.raises(ValueError):
        listing.sorted_by(rows_of(spark), "tier")
    shown = lambda pinned, offset=0: "".join(r.uid for r in listing.page_with_pins(rows_of(spark), "unchecked", pinned, offset, 3).collect())
    assert shown([]) == "bac" and shown(["d"]) == "bac" and shown(["d"], 1) == "ac"
    few = listing.page_with_pins(rows_of(spark), "yes", ["b"], 0, 9)
    assert [r.uid for r in few.collect()] == ["b", "d"]  # in its place, not behind the page
    assert [r.uid for r in listing.page_with_pins(rows_of(spark), "yes", [f"x{i}" for i in range(50)] + ["b"], 0, 9).collect()] == ["d"]


def test_pins(spark):
    rows = [
        ("a", "Alder", 40.0, -111.0, "Prospect", "yes", "CLOSED_PERMANENTLY", "1 Main", "Provo", "84", ["x"], "8015550100", "talked", AT(0), "near X"), ("b", "Birch", 40.123456, -111.0, "Competitor", "yes", "", "", "", "", [], "", "", AT(0), "near Orem, UT 84057"),
        ("c", "Own", 40.0, -111.0, "Own", "", "", "", "Provo", "", ["OWN COMPANY: parent company Ash"], "", "", None, "near X"), ("d", None, 0.0, 0.0, None, None, None, None, None, None, None, None, None, None, None), ("e", "E", 40.0, -111.0, None, "", "", "", "", "", None, "", "", None, ""),
    ]
    df = spark.createDataFrame(rows, "uid string, name string, lat double, lon double, lead_type string, mark string, business_status string, address string, city string, zip string, flags array<string>, phone string, call_outcome string, last_call_at timestamp, near_text string")
    df = df.withColumns({"score": F.lit(1), "tier": F.lit("D")})
    got = {r.uid: r for r in listing.pins(df).collect()}
    assert {u: (r.grp, r.kind, r.address, r.closed) for u, r in got.items()} == {
        "a": ("yes", "", "1 Main, Provo, 84", True), "b": ("competitor", "Competitor", "No street address · near Orem, UT 84057", False), "c": ("competitor", "Parent company", "No street address · Provo", False), "e": ("unchecked", "", "No street address", False),
    }
    assert got["a"].phone == "(801) 555-0100" and got["a"].called == "Jan 5, 2026, 5:00 AM" and got["b"].called == "" and got["b"].lat == 40.12346
    assert {r.grp: r.n for r in listing.pin_counts(df).collect()} == {"unchecked": 1, "yes": 1, "no": 0, "competitor": 2, "no position": 1}
    import json

    lists = {r.uid: json.loads(r.pin) for r in listing.pin_rows(df).collect()}
    assert lists["b"][:4] == ["b", 40.12346, -111.0, "competitor"] and len(lists["b"]) == len(listing.PIN) and lists["a"][12] is True


def test_towns_are_counted_by_city_and_state(spark):
    rows = [("Provo", "UT", 5), ("Provo", "CO", 1), ("Provo", "UT", 9), ("", "", 3), (None, None, 4), ("Orem", "", 0), ("Orem", None, 8)]
    df = spark.createDataFrame(rows, "city string, state string, place int")
    assert [tuple(r) for r in stats.town_counts(df, 4).collect()] == [("Orem", 2), ("(no town listed)", 2), ("Provo, UT", 2), ("Provo, CO", 1)]


# ---------------------------------------------------------------- searches


def test_searches_of_an_earlier_day(spark):
    rows = [(1, "2026-01-04", AT(-1400), "Alder Co, 5 Main", 3), (2, "2026-01-05", AT(-5), "Alder Shop, 5 Main", 9), (3, "2026-01-03", AT(-2900), "Alder Shop, 5 Main", 1), (4, "2026-01-04", AT(-1300), "Alder Shop, 5 Main", None), (5, "2026-01-04", AT(-1300), "alder shop, 5 main", 2), (6, "2025-12-01", AT(-50_000), "Old", 2)]
    df = spark.createDataFrame(rows, "id int, day string, at timestamp, place string, leads int").withColumn("day", F.to_date("day")).withColumn("place", searches.renamed_place(F.col("place"), ["Alder Co"], "Alder Shop"))
    got = {r.place: r.id for r in searches.earlier(df, F.lit("2026-01-05").cast("date"), F.lit(AT(-10_000))).collect()}
    assert got == {"Alder Shop, 5 Main": 1, "alder shop, 5 main": 5}  # not today's, not one that found nothing yet, not a label in other letters


def test_the_latest_search_of_ones_own_area(spark):
    base = dict(at=AT(0), lat=40.7, lon=-111.9, radius=30.0, miles=0.0, source="both", leads=5)
    cases = [dict(), dict(radius=60.0), dict(lat=40.72), dict(source="google"), dict(leads=None), dict(source=None, lat=None, miles=0.05), dict(lat=None, miles=3.0)]
    rows = [tuple({**base, "at": AT(i), "id": i, **c}[k] for k in ("id", "at", "lat", "lon", "radius", "miles", "source", "leads")) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, at timestamp, lat double, lon double, radius double, miles double, source string, leads int")
    latest = lambda d, **o: [r.id for r in searches.latest_of_area(d, 40.7, -111.9, 30.0, **o).collect()]
    assert latest(df) == [5] and latest(df.filter("id <> 5")) == [0]  # a larger circle that holds the asked one doesn't do
    assert latest(df, limit=1) == []


def test_refused_tries_are_not_noted(spark):
    rows = [(i, AT(m), "a", ok) for i, (m, ok) in enumerate([(0, False), (1, False), (2, False), (11, False), (12, False), (13, True), (14, False)])]
    df = spark.createDataFrame(rows, "id int, at timestamp, who string, right boolean").withColumn("wrong", ~F.col("right"))
    got = {r.id: r.allowed for r in searches.rate_limited(df, ["who"], "at", 2, 600, "id", "wrong", "right").collect()}
    # the third is refused and not noted, so the fourth (11 minutes on) is let through; the right one clears what was counted
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: False}
    cleared = {r.id: r.allowed for r in searches.rate_limited(df.filter("id not in (3, 4)"), ["who"], "at", 2, 600, "id", "wrong", "right").collect()}
    assert cleared == {0: True, 1: True, 2: False, 5: True, 6: True}


def test_a_budget_is_back_with_its_newest_call(spark):
    df = spark.createDataFrame([("a", AT(-60)), ("a", AT(-10)), ("a", AT(-2000))], "name string, at timestamp")
    r = searches.next_reset(df, "name", "at", F.lit(AT(0))).first()
    assert r.used == 2 and r.resets_at == AT(-10) + dt.timedelta(seconds=86_490)


def test_claims_are_taken_over_after_half_an_hour(spark):
    rows = [(1, AT(0), False), (2, AT(30), False), (3, AT(31), True), (4, AT(500), False)]
    df = spark.createDataFrame(rows, "id int, at timestamp, found boolean")
    assert sorted(r.id for r in searches.claims(df, F.to_date("at"), "at", "found", "id").collect()) == [1, 3]  # at 30 minutes not yet; a search that found leads is not taken over


def test_who_may_search(spark):
    day = 24 * 60
    rows = [
        ("demo", True, "active", None, None, 0, 9), ("canceled", False, "canceled", None, "s", 0, 9), ("due", False, "past_due", None, "s", 0, 9), ("over", False, "trialing", AT(-1), "", 0, 9), ("grace", False, "trialing", AT(-day + 1), "s", 0, 9),
        ("late", False, "trialing", AT(-day - 1), "s", 0, 9), ("spent", False, "active", None, "s", 9, 9), ("none", False, "active", None, "s", 0, None), ("fine", False, "active", AT(-9), "", 8, 9),
    ]
    df = spark.createDataFrame(rows, "id string, demo boolean, status string, trial_ends_at timestamp, subscription string, used int, searches int")
    got = {r.id: r.why for r in searches.eligible(df, F.lit(AT(0))).collect()}
    assert got == {"demo": "demo", "canceled": "canceled", "due": "past due", "over": "trial ended", "grace": "", "late": "trial ended", "spent": "used up", "none": "used up", "fine": ""}


def test_typed_words_filter_and_do_not_score(spark):
    names = [lead(1, "Quokka Compactor Depot", source_id="a"), lead(2, "Zebra Balers", lat=40.71, source_id="b"), lead(3, "Depot", lat=40.72, source_id="", tags=["building=warehouse"]), lead(4, "Other Depot", lat=40.74, source_id="", tags=["building=warehouse"])]
    found = frame(spark, names).drop("rid").withColumn("map_url", F.lit(""))
    everything = {r.name: r for r in plans.search([found], plans.Search(40.7, -111.9, least_score=0)).collect()}
    typed = {r.name: r for r in plans.search([found], plans.Search(40.7, -111.9, keywords=("depot",), least_score=0)).collect()}
    assert {n: r.score for n, r in typed.items()} == {n: r.score for n, r in everything.items()} and len(typed) == 4  # two listings without an id are two
    assert typed["Depot"].matched_keywords == ["depot"] and typed["Zebra Balers"].matched_keywords == [] and everything["Depot"].matched_keywords == []
    kept = {r.name for r in plans.search([found], plans.Search(40.7, -111.9, keywords=("depot",), least_score=0, only_hits=True)).collect()}
    assert kept == {"Quokka Compactor Depot", "Depot", "Other Depot"}


def test_parents_by_address(spark):
    rows = spark.createDataFrame([("a", "Quiet Yard", "1240 S Wallace Rd Ste 2", ""), ("b", "Rival Co", "1240 S Wallace Rd", ""), ("c", "Other", "12 Elm", "")], "uid string, name string, address string, listed_town string").withColumns({"website": F.lit(""), "raw_categories": F.array().cast("array<string>"), "flags": F.array().cast("array<string>"), "lead_type": F.lit("Prospect")})
    known = spark.createDataFrame([("rival co", "Rival", "Competitor", 1)], "alias string, company string, kind string, ord int")
    facilities = spark.createDataFrame([("Ash", "1240 South Wallace Road", "Elm City")], "company string, street string, town string")
    got = {r.uid: (r.lead_type, r.flags) for r in flagged(rows, known, facilities).collect()}
    assert got == {"a": ("Own", ["OWN COMPANY: parent company Ash"]), "b": ("Competitor", ["COMPETITOR: Rival"]), "c": ("Prospect", [])}


# ---------------------------------------------------------------- wording


def test_wording(spark):
    names = lambda *n: text.names_text(F.array(*map(F.lit, n)).cast("array<string>"))
    r = one(spark, names().alias("a"), names("A").alias("b"), names("A", "The area to the west").alias("c"), names("A", "B", "C", "D").alias("d"), names("A", "B", "C", "D", "E", "F").alias("e"))
    assert tuple(r) == ("", "A", "A and the area to the west", "A, B, C and D", "A, B, C, D and more")
    red = lambda s: text.redact(F.lit(s))
    r = one(spark, red("x?a=1&KEY=secret&token=t").alias("a"), red("key=plain Bearer abc").alias("b"), red("(u?api_key=s) 'v?key=t'").alias("c"))
    assert tuple(r) == ("x?a=1&KEY=REDACTED&token=t", "key=plain Bearer abc", "(u?api_key=REDACTED) 'v?key=REDACTED'")
    why = lambda s: text.reason(F.lit(s))
    r = one(spark, why("<html><head><TITLE>\n504  Gateway &amp; Time-out</title></head><body>more</body>").alias("a"), why("<p>Too <b>busy</b></p><script>x()</script>").alias("b"), why('{"error":\n "no"}').alias("c"), why("x" * 400).alias("d"), why("5 < 6 and ?key=abc").alias("e"), why(None).alias("f"))
    assert tuple(r) == ("504 Gateway & Time-out", "Too busy", '{"error": "no"}', "x" * 297 + "...", "5 < 6 and ?key=REDACTED", "")
    now = F.lit(dt.datetime(2026, 1, 5, 20)).cast("timestamp_ntz")
    said = lambda *t: time.day_clock_text(F.lit(dt.datetime(*t)).cast("timestamp_ntz"), now)
    r = one(spark, said(2026, 1, 5, 23, 43).alias("a"), said(2026, 1, 6, 16, 5).alias("b"), said(2026, 10, 2, 15, 5).alias("c"))
    assert tuple(r) == ("today at 4:43 PM", "tomorrow at 9:05 AM", "Oct 2 at 9:05 AM")
    r = one(spark, text.format_phone(F.lit(" ext 12 ")).alias("a"), text.format_phone(F.lit("1-801-555-0100")).alias("b"))
    assert tuple(r) == ("ext 12", "(801) 555-0100")
