"""The list: tabs, filters, orders, pages and counts over saved listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plotmere.functions.geo import has_position
from plotmere.functions.text import blank, format_phone
from plotmere.functions.time import clock_text

#: The tabs, and the types of listing that are never prospects.
TABS = ["unchecked", "yes", "no", "competitors", "closed", "all", "called"]
EXEMPT = ["Competitor", "Own"]


def tabs(mark: Column, calls: Column, closed: Column, lead_type: Column) -> Column:
    """The tabs that a listing is under."""
    prospect = ~F.coalesce(lead_type, F.lit("")).isin(EXEMPT)
    mark = F.coalesce(mark, F.lit(""))
    own = F.when(~prospect, "competitors").when(mark.isin("yes", "no"), mark).when(~closed, "unchecked")
    return F.array_compact(F.array(F.lit("all"), F.when(calls > 0, "called"), F.when(closed, "closed"), own))


def tab_counts(listings: DataFrame, column: str = "tabs") -> DataFrame:
    """(tab, n) for every tab, empty ones too."""
    every = listings.sparkSession.createDataFrame([(t,) for t in TABS], "tab string")
    found = listings.select(F.explode(column).alias("tab")).groupBy("tab").agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(found), "tab", "left").fillna({"n": 0})  # at most a row for each tab


def has_words(text: Column, query: str) -> Column:
    """Every word of the query is somewhere in the text; an empty query is in every text."""
    out = F.lit(True)
    for word in query.lower().split():
        out = out & F.contains(F.lower(text), F.lit(word))
    return out


def ordered(listings: DataFrame, sort: str = "score", descending: bool = True, place: str = "place") -> DataFrame:
    """By a column; equal values keep the saved order (place), also when descending."""
    key = F.desc(sort) if descending else F.asc(sort)
    return listings.orderBy(key, F.asc(place))


def page(listings: DataFrame, offset: int = 0, limit: int = 100, most: int = 5000) -> DataFrame:
    return listings.offset(offset).limit(min(limit, most))


def best_first(listings: DataFrame, tie: str) -> DataFrame:
    return listings.orderBy(F.desc("score"), F.asc("distance_miles"), F.lower(blank("name")), F.asc(tie))


def ranked_in_tab(listings: DataFrame, tab: str, tie: str) -> DataFrame:
    """Rows of a tab with rank. Ranks are counted by score first (few different values), so no task ranks all rows."""
    rows = listings.filter(F.array_contains("tabs", tab))
    per = rows.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("score", (F.sum("_n").over(W.orderBy(F.desc("score"))) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(W.partitionBy("score").orderBy("distance_miles", F.lower(blank("name")), tie))
    return rows.withColumn("_in", inner).join(F.broadcast(before), "score").withColumn("rank", F.col("_before") + F.col("_in")).drop("_in", "_before")


def top_prospects(listings: DataFrame, limit: int, tie: str) -> DataFrame:
    """The best prospects up to a limit; exempt listings always stay."""
    exempt = F.coalesce(F.col("lead_type"), F.lit("")).isin(EXEMPT)
    return best_first(listings.filter(~exempt), tie).limit(limit).union(listings.filter(exempt))


def dispositions(listings: DataFrame, least_score: int, only_hits: bool = False) -> DataFrame:
    """listings with disposition: each is kept, closed, low or no_match; exempt ones are kept."""
    exempt = F.coalesce(F.col("lead_type"), F.lit("")).isin(EXEMPT)
    hit = F.size(F.col("matched_keywords")) > 0 if only_hits else F.lit(True)
    closed = blank("business_status") == "CLOSED_PERMANENTLY"
    return listings.withColumn("disposition", F.when(closed, "closed").when(exempt, "kept").when(F.col("score") < least_score, "low").when(~hit, "no_match").otherwise("kept"))


def fingerprint(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One row of counts, latest times and sums of tables (name: frame, time column, number column)."""
    out = None
    for name, (df, at, number) in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(f"{name}_n"), F.max(at).alias(f"{name}_max"), F.sum(number).alias(f"{name}_sum"))
        out = one if out is None else out.join(one)  # rows of one
    return out


#: What a user may sort by, and whether the largest come first.
SORTS = {"score": True, "name": False, "city": False, "contact": False, "miles": False, "called": True}
#: Rows that a page keeps in place, at most.
PINNED = 50


def has_phone(phone: Column | str = "phone", verified: Column | str = "verified_phone") -> Column:
    return (F.trim(blank(phone)) != "") | (F.trim(blank(verified)) != "")


def order_by(sort: str = "score", descending: bool | None = None, place: str = "place", tab: str = "all", town: str = "city") -> list[Column]:
    """The order of one of the user's sorts (its own direction unless told); equal values keep the saved order, place.

    Names and towns are compared in lower case, a missing town as "~". Contact: a verified phone, the listing's own, none.
    Missing miles are far, and no call is the earliest. Among equal scores of the unchecked tab, best first, those that can be
    phoned come before the others.
    """
    if sort not in SORTS:
        raise ValueError(f"no such sort: {sort}")
    descending = SORTS[sort] if descending is None else descending
    value = {
        "score": lambda: F.col("score"), "name": lambda: F.lower(blank("name")), "city": lambda: F.lower(F.coalesce(F.nullif(blank(town), F.lit("")), F.lit("~"))),
        "contact": lambda: F.when(F.trim(blank("verified_phone")) != "", 0).when(F.trim(blank("phone")) != "", 1).otherwise(2),
        "miles": lambda: F.coalesce(F.col("distance_miles"), F.lit(1e9)), "called": lambda: F.coalesce(F.unix_micros(F.col("last_call_at").cast("timestamp")), F.lit(0)),
    }[sort]()
    phones = [F.desc(has_phone())] if sort == "score" and descending and tab == "unchecked" else []
    return [value.desc() if descending else value.asc(), *phones, F.asc(place)]


def sorted_by(listings: DataFrame, sort: str = "score", descending: bool | None = None, place: str = "place", tab: str = "all") -> DataFrame:
    """Rows of a tab in one of the user's orders (order_by)."""
    return listings.orderBy(*order_by(sort, descending, place, tab))


def filtered(listings: DataFrame, tier: str = "", has_phone: bool | None = None, uid: str = "", outcome: str = "") -> DataFrame:
    """Rows of a tier, with or without a phone, of one uid, or whose latest call had an outcome; empty values ask nothing."""
    tests = [F.col("tier") == tier] if tier else []
    tests += [(blank("phone") != "") == has_phone] if has_phone is not None else []
    tests += [F.col("uid") == uid] if uid else []
    tests += [blank("call_outcome") == outcome] if outcome else []
    for test in tests:
        listings = listings.filter(test)
    return listings


def page_with_pins(listings: DataFrame, tab: str, pinned: list[str], offset: int, limit: int, sort: str = "score", descending: bool | None = None, place: str = "place", key: str = "uid", most: int = 5000) -> DataFrame:
    """A page of a tab. On the first page, rows with the first PINNED keys of pinned that left the tab stay in their place in the order."""
    stay = F.col(key).isin(pinned[:PINNED]) if pinned and offset == 0 else F.lit(False)
    rows = listings.filter(F.array_contains("tabs", tab) | stay)
    return page(sorted_by(rows, sort, descending, place, tab), offset, max(1, limit), most)


def outcome_counts(listings: DataFrame, outcomes: list[str], column: str = "call_outcome") -> DataFrame:
    """(outcome, n) for every outcome, empty ones too."""
    every = listings.sparkSession.createDataFrame([(o,) for o in outcomes], "outcome string")
    found = listings.filter(F.col(column).isin(outcomes)).groupBy(F.col(column).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(found), "outcome", "left").fillna({"n": 0})  # at most a row for each outcome


def removed_rows(changed: DataFrame, present: DataFrame, key: str = "uid") -> DataFrame:
    """Keys that changed and are not on the list any more."""
    return changed.select(key).distinct().join(present.select(key), key, "left_anti")


def orphans(logs: dict[str, tuple[DataFrame, str]], listings: DataFrame, key: str = "uid") -> DataFrame:
    """(log, n): how many rows of each log (name: frame, its key column) no listing accounts for."""
    out = None
    for name, (log, column) in logs.items():
        lost = log.filter(F.col(column).isNotNull()).join(listings.select(F.col(key).alias(column)), column, "left_anti")
        one = lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("log"), "n")
        out = one if out is None else out.union(one)
    return out


#: Groups of pins; fields of a pin, in order; how the flag of a parent's listing begins.
GROUPS = ["unchecked", "yes", "no", "competitor"]
PIN = ["uid", "lat", "lon", "grp", "name", "tier", "score", "phone", "verified_phone", "address", "outcome", "called", "closed", "kind"]
PARENT_START = "OWN COMPANY: parent company "


def pins(listings: DataFrame) -> DataFrame:
    """Fields PIN of listings with a position: what a map shows.

    The group is competitor (one's own listings too), else the mark, else unchecked; a closed listing keeps its group. The
    kind is blank for a prospect, Parent company where a flag says so, else the type. The address has the town and ZIP that are
    listed, and for a listing without a town the one it is near (near_text); called is the latest call's time, where it has an outcome.
    """
    text = lambda c: blank(c) if c in listings.columns else F.lit("")
    exempt = F.coalesce(F.col("lead_type"), F.lit("")).isin(EXEMPT)
    group = F.when(exempt, "competitor").when(blank("mark").isin("yes", "no"), F.col("mark")).otherwise("unchecked")
    flags = F.coalesce(F.col("flags"), F.array().cast("array<string>")) if "flags" in listings.columns else F.array().cast("array<string>")
    kind = F.when(~exempt, "").when(F.exists(flags, lambda f: f.startswith(PARENT_START)), "Parent company").otherwise(F.col("lead_type"))
    listed = F.concat_ws(", ", *(F.nullif(text(c), F.lit("")) for c in ("address", "city", "zip")))
    near = F.when(text("city") == "", F.nullif(text("near_text"), F.lit("")))
    address = F.concat_ws(" · ", F.when(text("address") == "", "No street address"), F.nullif(listed, F.lit("")), near)
    at = F.col("last_call_at") if "last_call_at" in listings.columns else F.lit(None).cast("timestamp")
    rows = listings.filter(has_position(F.col("lat"), F.col("lon")))
    return rows.select(
        "uid", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), group.alias("grp"), text("name").alias("name"), text("tier").alias("tier"), "score",
        format_phone(text("phone")).alias("phone"), format_phone(text("verified_phone")).alias("verified_phone"), address.alias("address"), text("call_outcome").alias("outcome"),
        F.when(text("call_outcome") != "", F.coalesce(clock_text(at), F.lit(""))).otherwise("").alias("called"), (text("business_status") == "CLOSED_PERMANENTLY").alias("closed"), kind.alias("kind"),
    )


def pin_rows(listings: DataFrame) -> DataFrame:
    """(uid, pin): each pin as a JSON list of its fields in order."""
    return pins(listings).select("uid", F.concat(F.lit("["), F.concat_ws(",", *(_json(F.col(c)) for c in PIN)), F.lit("]")).alias("pin"))


def _json(value: Column) -> Column:
    """One value in JSON: an object's, without its braces and name."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def pin_counts(listings: DataFrame) -> DataFrame:
    """(grp, n) of pins for all GROUPS, empty ones too, and a row "no position" for the listings that have none."""
    every = listings.sparkSession.createDataFrame([(g,) for g in GROUPS], "grp string")
    found = pins(listings).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    lost = listings.agg(F.count_if(~has_position(F.col("lat"), F.col("lon"))).alias("n")).select(F.lit("no position").alias("grp"), "n")
    return every.join(F.broadcast(found), "grp", "left").fillna({"n": 0}).union(lost)  # four rows
