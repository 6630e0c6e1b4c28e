"""Scores of listings: category, brand, reviews, footprint and keywords, less penalties; tiers and reasons.

Listings as for classify, with address, phone, website, rating_count, yelp_reviews, footprint_sqft, business_status and
primary_category. Null numbers count as none, null texts as "". A projection from end to end, dealt over all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmere.functions.text import blank, compact, has_term, literals, normalize, plain, site_label, split_hyphens, term_pattern
from plotmere.operators import classify as C
from plotmere.operators.shared import dealt
from plotmere.operators.towns import at_facilities
from plotmere.plans import categories as K


def tier_of(score: Column) -> Column:
    return reduce(lambda c, t: c.when(score >= t[0], t[1]), K.TIERS[1:-1], F.when(score >= K.TIERS[0][0], K.TIERS[0][1])).otherwise(K.TIERS[-1][1])


def building_name(name: Column) -> Column:
    """The name only describes a building."""
    words = F.split(name, " ")
    return F.exists(words, lambda w: w.isin(K.BUILDING_WORDS)) & F.forall(words, lambda w: w.isin(K.BUILDING_WORDS + K.FILLER_WORDS) | w.rlike("^([0-9]+|.)$"))


def generic_name(column: Column | str) -> Column:
    """Only a generic word, alone or with its street or town."""
    base = F.try_element_at(F.split(F.trim(blank(column)), r"\s+(?:at|near)\s+|,"), F.lit(1))
    return normalize(base).isin(sorted({plain(g) for g in K.GENERIC_NAMES}))


def needs_name() -> Column:
    """No business to look up: a building's or a generic name, and no address, phone or website."""
    bare = (blank("address") == "") & (blank("phone") == "") & (blank("website") == "")
    return bare & (building_name(normalize("name")) | (generic_name("name") & ~blank("name").rlike(r"(?i)\s(at|near)\s")))


def _is_business(brand: str, names: list[Column], own: Column) -> Column:
    """The name is the brand's own: no other brand tag, no location word before it; a place's brand opens the name."""
    before = "(?<!(?:^|[a-z0-9 ])(?:" + "|".join(K.LOCATION_WORDS) + ") )" if brand not in K.PLACE_BRANDS else "^"
    # A location word counts as a whole word, so "flat walmart" is the shop and "hotel at walmart" is not.
    before = before.replace("(?:^|[a-z0-9 ])", "(?<![a-z0-9])")
    found = reduce(lambda a, b: a | b, (n.rlike(before + term_pattern([brand])) for n in names))
    return ((own == "") | has_term(normalize(own), [brand])) & found


def with_brand(listings: DataFrame) -> DataFrame:
    """listings with brand: the first high-volume brand in list order that each is, else null; needs the facts and category_key.

    The texts that brands are looked for in are columns of their own, made once for all brands, and a listing that has no
    brand's words anywhere is not looked at further.
    """
    tags = C.values_of(F.col("_raw"), "brand", "operator")
    found = listings.withColumns({
        "_apart": split_hyphens("name"), "_own": C.values_of(F.col("_raw"), "brand"), "_tag_text": F.trim(F.concat_ws(" ", normalize(tags), split_hyphens(tags))), "_site": site_label("website"),
    }).withColumn("_both", F.concat_ws(" ", "_name", "_apart"))
    found = found.withColumn("_every", F.trim(F.concat_ws(" ", "_both", "_tag_text")))
    found = found.withColumn("_some", has_term(F.col("_every"), [*K.BRANDS, *K.AMBIGUOUS_BRANDS]) & ~has_term(F.col("_name"), K.BRAND_EXCLUDE))
    both, every, tag_text, own = (F.col(c) for c in ("_both", "_every", "_tag_text", "_own"))
    names = [F.col("_name"), F.col("_apart")]
    sure = [F.when(has_term(tag_text, [b]) | (has_term(both, [b]) & _is_business(b, names, own)), F.lit(b)) for b in K.BRANDS]
    label, key = F.col("_site"), F.coalesce(F.col("category_key"), F.lit(""))
    unsure = []
    for b, cats in K.AMBIGUOUS_BRANDS.items():
        rest = F.trim(F.regexp_replace(F.regexp_replace(F.col("_name"), "^(.*?)" + re.escape(plain(b)), "$1"), r"\b(store|stores|home improvement|\d+)\b", ""))
        fits = key.isin(cats) & ((rest == "") | ~key.isin("retail", "specialty_retail"))
        unsure.append(F.when(has_term(every, [b]) & (has_term(tag_text, [b]) | ((label != "") & (label == plain(b).replace(" ", ""))) | fits), F.lit(b)))
    return found.withColumn("brand", F.when(F.col("_some"), F.coalesce(*sure, *unsure)))


def keyword_hits(keywords: Iterable[str]) -> Column:
    """The keywords that begin a word of the name, category, website or tags."""
    tags = F.array_join(F.transform("_raw", lambda c: F.translate(F.regexp_replace(c, "^yelp:", ""), "_=", "  ")), " ")
    hay = normalize(F.concat_ws(" ", blank("name"), blank("primary_category"), blank("website"), tags))
    return F.array_compact(F.array(*(F.when(has_term(hay, [k], whole=False), F.lit(k)) for k in keywords if plain(k))).cast("array<string>"))


def busy() -> Column:
    """The best review bonus as a struct points, count, source (null: none)."""
    options = [F.when(F.col(column) >= least, F.struct(F.lit(points).alias("points"), F.col(column).cast("long").alias("count"), F.lit(source).alias("source")))
               for source, column in (("Google", "rating_count"), ("Yelp", "yelp_reviews")) for least, points in K.REVIEW_BONUS[source]]
    return F.greatest(*options)


def footprint_points(column: Column | str = "footprint_sqft") -> Column:
    sqft = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))
    return reduce(lambda c, t: c.when(sqft >= t[0], t[1]), K.FOOTPRINT_BONUS[1:], F.when(sqft >= K.FOOTPRINT_BONUS[0][0], K.FOOTPRINT_BONUS[0][1])).otherwise(0)


def score(listings: DataFrame, keywords: Iterable[str] = ()) -> DataFrame:
    """listings, classified, with brand, matched_keywords, score (0 to 100), tier, flags, reasons, lead_type and category."""
    added = ("brand", "matched_keywords", "score", "tier", "flags", "reasons", "lead_type", "category")
    found = C.classify(dealt(listings.drop(*added)))
    names = found.columns
    found = C.with_facts(found)
    blocked = F.col("category_key").isNull() & (C.non_prospect_type() | C.non_prospect_name() | C.utility_structure() | C.self_storage() | C.service_plant() | C.vehicle_wash() | C.clinic())
    table = lambda field: F.create_map(*(F.lit(x) for c in K.CATEGORIES for x in (c.key, getattr(c, field))))
    of = lambda field: F.try_element_at(table(field), F.col("category_key"))
    found = with_brand(found).withColumn("brand", F.when(~blocked, F.col("brand")))
    found = found.withColumns({
        "matched_keywords": keyword_hits(keywords),
        "_busy": busy(),
        "_foot": footprint_points(),
        "_weight": F.coalesce(of("weight"), F.lit(0)),
        "_label": of("label"),
        "category": F.coalesce(of("label"), F.when(blank("primary_category") == "", "Uncategorized").otherwise(F.col("primary_category"))),
        "lead_type": F.coalesce(of("lead_type"), F.lit("Prospect")),
        "_generic": generic_name("name"),
        "_needs": needs_name(),
        "_closed": blank("business_status") == "CLOSED_TEMPORARILY",
    })
    hits = F.least(F.size("matched_keywords") * K.KEYWORD_POINTS, F.lit(K.KEYWORD_MOST))
    points = (
        F.col("_weight") + F.when(F.col("brand").isNotNull(), K.BRAND_POINTS).otherwise(0) + F.coalesce(F.col("_busy.points"), F.lit(0)) + F.col("_foot") + hits
        - F.when(F.col("_generic"), K.GENERIC_PENALTY).otherwise(0) - F.when(F.col("_closed"), K.CLOSED_PENALTY).otherwise(0)
    )
    whole = F.greatest(F.lit(0), F.least(F.lit(100), points))
    found = found.withColumn("_whole", whole)
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    labels = F.array_compact(F.transform(F.array_except("also_matched", F.array(blank("category_key"))), lambda k: F.try_element_at(table("label"), k)))
    reasons = F.array_compact(F.array(
        F.coalesce(text("+", F.col("_weight").cast("string"), " ", F.col("_label"), " (by ", F.col("category_how"), ")"), F.lit("+0 category not on the high-volume list")),
        F.when(F.col("rule") != "nothing matched", text("category rule: ", F.col("rule"))),
        text(f"+{K.BRAND_POINTS} known high-volume brand (", F.initcap("brand"), ")"),
        text("+", F.col("_busy.points").cast("string"), " busy site (", F.format_number(F.col("_busy.count"), 0), " ", F.col("_busy.source"), " reviews)"),
        F.when(F.col("_foot") > 0, text("+", F.col("_foot").cast("string"), " large footprint (~", F.format_number("footprint_sqft", 0), " sq ft)")),
        F.when(F.size("matched_keywords") > 0, text("+", hits.cast("string"), " matches keyword(s): ", F.array_join("matched_keywords", ", "))),
        F.when((F.size("also_matched") > 1) & (F.size(labels) > 0), text("also looks like: ", F.array_join(labels, "; "))),
        F.when(F.col("_generic"), text(f"-{K.GENERIC_PENALTY} no business name on the map")),
        F.when(F.col("_closed"), text(f"-{K.CLOSED_PENALTY} temporarily closed")),
        F.when(F.col("_needs"), text("no business name, address or phone on the map")),
    ))
    final = F.when(F.col("_needs"), F.least(F.col("_whole"), F.lit(K.NEEDS_NAME_MOST))).otherwise(F.col("_whole"))
    flags = F.array_compact(F.array(F.when(F.col("_closed"), "Temporarily closed"), F.when(F.col("_needs"), K.NEEDS_NAME_FLAG)))
    return found.select(*names, "brand", "matched_keywords", final.alias("score"), tier_of(final).alias("tier"), flags.alias("flags"), reasons.alias("reasons"), "lead_type", "category")


def flag_types(listings: DataFrame, known: DataFrame) -> DataFrame:
    """lead_type by a dictionary known (alias, kind, ord): the first alias in order that is in the name, operator or host.

    The dictionary is a list that people keep, so it is broadcast where it has at most 10,000 rows; a longer one meets
    the listings by its first word in a shuffle join.
    """
    names = [c for c in listings.columns if c not in ("matched_alias", "matched_kind")]
    listings = listings.withColumn("_key", F.xxhash64(*names))
    others = F.transform("alt_names", lambda n: F.concat_ws(" ", normalize(n), split_hyphens(n))) if "alt_names" in names else literals([])
    text = F.concat_ws(" ", normalize("name"), split_hyphens("name"), F.array_join(others, " . "), normalize(C.values_of(F.coalesce(F.col("raw_categories"), literals([])), "operator", "brand")))
    words = listings.select("_key", text.alias("_text"), F.explode(F.array_distinct(F.split(F.concat_ws(" ", text, site_label("website")), " "))).alias("_word"), site_label("website").alias("_site"))
    aliases = known.select(normalize("alias").alias("_alias"), compact("alias").alias("_compact"), "kind", "ord").filter("_alias <> ''")
    aliases = aliases.select("*", F.explode(F.array_distinct(F.array(F.try_element_at(F.split("_alias", " "), F.lit(1)), F.col("_compact")))).alias("_word"))
    few = aliases.limit(10_001).count() <= 10_000
    met = words.join(F.broadcast(aliases) if few else aliases, "_word")
    met = met.filter(F.contains(F.concat(F.lit(" "), "_text", F.lit(" ")), F.concat(F.lit(" "), "_alias", F.lit(" "))) | (F.col("_site") == F.col("_compact")))
    first = met.groupBy("_key").agg(F.min(F.struct("ord", F.col("_alias").alias("alias"), "kind")).alias("_first"))
    return listings.join(first, "_key", "left").select(*names, F.col("_first.alias").alias("matched_alias"), F.col("_first.kind").alias("matched_kind"))


#: Kinds of company that are no prospects, the most telling first, and how a flag begins.
KINDS = {"Competitor": "COMPETITOR: ", "Own": "OWN COMPANY: ", "Parent": "OWN COMPANY: parent company "}


def flagged(listings: DataFrame, known: DataFrame, facilities: DataFrame | None = None, key: str = "uid") -> DataFrame:
    """Scored listings with lead_type and flags by the companies known (alias, company, kind, ord): a competitor comes
    before one's own company, that before its parent; then the dictionary's order decides. Flags of before are read anew.

    A listing that none of them names is the parent's where its address is one of facilities (company, street, town); listings have listed_town then.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    ranked = known.filter(rank > 0).select("alias", F.concat_ws("|", "kind", "company").alias("kind"), F.struct(rank.alias("rank"), "ord").alias("ord"))
    kept = F.filter(F.coalesce(F.col("flags"), literals([])), lambda f: ~f.startswith(KINDS["Competitor"]) & ~f.startswith(KINDS["Own"]))
    found = flag_types(listings.withColumn("flags", kept), ranked)
    kind, company = F.substring_index("matched_kind", "|", 1), F.substring_index("matched_kind", "|", -1)
    start = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in KINDS.items()))
    flags = F.when(start.isNotNull(), F.concat(F.array(F.concat(start, company)), "flags")).otherwise(F.col("flags"))
    lead_type = F.when(kind == "Competitor", "Competitor").when(kind.isin("Own", "Parent"), "Own").otherwise(F.col("lead_type"))
    found = found.withColumns({"flags": flags, "lead_type": lead_type, "_named": start.isNotNull()}).drop("matched_alias", "matched_kind")
    if facilities is not None:
        there = facilities.groupBy("company").count().select("company").collect()  # parent companies of one company
        for company in sorted(r.company for r in there):
            here = at_facilities(found, facilities.filter(F.col("company") == company), key).withColumn("_here", F.lit(True))
            found = found.join(here, key, "left")
            mine = F.coalesce(F.col("_here"), F.lit(False)) & ~F.col("_named")
            flags = F.when(mine, F.concat(F.array(F.lit(KINDS["Parent"] + company)), "flags")).otherwise(F.col("flags"))
            found = found.withColumns({"flags": flags, "lead_type": F.when(mine, "Own").otherwise(F.col("lead_type")), "_named": F.col("_named") | mine}).drop("_here")
    return found.drop("_named")
