"""Classification: every category that a listing matches, then the first of the rules that applies.

A listing has name string, raw_categories array<string> (types, "yelp:alias", "key=value" tags), search_terms
array<string> and footprint_sqft. Everything is a projection: facts first, then matches, then the decision, so a scan
of any size is classified without a shuffle. Null names and arrays count as empty.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmere.functions.text import has_term, literals, normalize, term_pattern
from plotmere.plans import categories as K

TYPE, ALIAS, TAG, NAME, PHRASE, CHAIN = "Google category", "Yelp category", "map tag", "name", "search query", "retail brand name"


def tag_pattern(tags: list[tuple[str, str | None]]) -> str:
    """A pattern for any of the tags in "key=value;value"; one that matches nothing for none."""
    return "|".join(rf"^{re.escape(k)}" + ("(=.*)?$" if v is None else rf"=(.*;)?{re.escape(v)}(;.*)?$") for k, v in tags) or r"(?!)"


def has_tag(raw: Column, tags: list[tuple[str, str | None]]) -> Column:
    return F.exists(raw, lambda c: c.rlike(tag_pattern(tags)))


def values_of(raw: Column, *keys: str) -> Column:
    """Values of the tags with these keys, joined by spaces."""
    return F.array_join(F.transform(F.filter(raw, lambda c: c.rlike(f"^({'|'.join(keys)})=")), lambda c: F.regexp_replace(c, "^[^=]*=", "")), " ")


def with_facts(listings: DataFrame) -> DataFrame:
    """listings with _raw, _name, _types, _aliases, _terms: what the rules look at."""
    raw = F.coalesce(F.col("raw_categories"), literals([]))
    out = listings.withColumns({"_raw": raw, "_name": normalize("name"), "_terms": F.coalesce(F.col("search_terms"), literals([]))})
    return out.withColumns({
        "_types": F.filter("_raw", lambda c: ~c.contains("=") & ~c.startswith("yelp:")),
        "_aliases": F.transform(F.filter("_raw", lambda c: c.startswith("yelp:")), lambda c: F.substring(c, 6, 1000)),
        "_brand": normalize(values_of(F.col("_raw"), "brand")),
        "_operators": normalize(values_of(F.col("_raw"), "operator")),
        "_owners": normalize(values_of(F.col("_raw"), "operator", "brand")),
    })


def _named(words: list[str]) -> Column:
    return has_term(F.col("_name"), words)


def _typed(types: list[str]) -> Column:
    return F.arrays_overlap("_types", literals(types))


def _aliased(aliases: list[str]) -> Column:
    return F.arrays_overlap("_aliases", literals(aliases))


def _tagged(tags: list[tuple[str, str | None]]) -> Column:
    return has_tag(F.col("_raw"), tags)


def rescued() -> Column:
    return _tagged(K.RESCUE_TAGS)


def non_prospect_type() -> Column:
    return _typed(K.NON_PROSPECT_TYPES) | _aliased(K.NON_PROSPECT_ALIASES) | _tagged(K.NON_PROSPECT_TAGS)


def non_prospect_name() -> Column:
    return _named(K.NON_PROSPECT_WORDS) & ~(rescued() | _typed(K.RESCUE_TYPES))


def utility_structure() -> Column:
    return _tagged(K.UTILITY_TAGS) & ~rescued()


def self_storage() -> Column:
    by_name = _named(K.STORAGE_WORDS) | (_named(["storage"]) & ~_named(K.COLD_WORDS + K.LOGISTICS_WORDS))
    return ~rescued() & (_tagged(K.STORAGE_TAGS) | _typed(K.STORAGE_TYPES) | by_name)


def vehicle_wash() -> Column:
    return _named(K.WASH_WORDS) | _tagged(K.WASH_TAGS)


def service_plant() -> Column:
    return _named(K.SERVICE_PLANT_WORDS)


def clinic() -> Column:
    return _named(K.CLINIC_WORDS) & ~_named(["hospital", "hospitals"])


def parcel_station() -> Column:
    text = F.concat_ws(" ", F.col("_name"), F.col("_owners"))
    return has_term(text, K.PARCEL_CARRIERS) & has_term(text, K.PARCEL_STATIONS)


def retail_chain() -> Column:
    """The retail category of a chain whose name holds a warehouse word, else null."""
    return F.coalesce(*(F.when(has_term(F.col(text), [brand]), F.lit(key)) for text in ("_name", "_brand") for brand, key in K.RETAIL_CHAINS.items()))


def small_generic_building() -> Column:
    sqft = F.coalesce(F.col("footprint_sqft"), F.lit(0))
    return (sqft > 0) & (sqft < K.SMALL_BUILDING_SQFT) & ~F.exists("_raw", lambda c: c.rlike("^(industrial=|man_made=works)"))


def _not_campus() -> Column:
    return _named(K.NOT_CAMPUS) | F.col("_name").rlike("(?<=[a-z0-9] )" + term_pattern(K.NOT_CAMPUS_INNER))


def _mall_shop() -> Column:
    """The only venue tag is shop=mall, nothing in the name says shopping centre, and another sign says shop."""
    others = [t for t in K.BY_KEY["venue"].tags if t != ("shop", "mall")]
    other_shop = F.exists("_raw", lambda c: c.startswith("shop=") & F.exists(F.split(F.substring(c, 6, 1000), ";"), lambda v: v != "mall"))
    return _tagged([("shop", "mall")]) & ~_tagged(others) & ~_named(K.MALL_WORDS) & (other_shop | _named(K.SHOP_WORDS))


def _matches() -> Column:
    """Every category that matches, by the strongest of its ways, without those that a veto takes out."""
    shop_named = _named(K.SHOP_LIKE) | _tagged(K.RETAIL_TAGS)
    hinted = (F.size(F.array_except("_types", literals(K.GENERIC_TYPES))) == 0) & (F.size("_aliases") == 0)
    found = []
    for order, c in enumerate(K.CATEGORIES):
        phrases = literals([p for p, key in K.PHRASE_CATEGORY.items() if key == c.key])
        named = _named(c.words)
        if c.key == "distribution":
            named = named | parcel_station()
        how = F.when(_typed(c.types), TYPE).when(_aliased(c.aliases), ALIAS).when(_tagged(c.tags), TAG).when(named, NAME)
        how = how.when(hinted & F.arrays_overlap("_terms", phrases), PHRASE)
        veto = {
            "education": lambda h: _not_campus(),
            "food_production": lambda h: (h == NAME) & _named(K.SMALL_FOOD_SHOP),
            "manufacturing": lambda h: (h == NAME) & (shop_named | F.col("_chain").isNotNull()),
            "distribution": lambda h: (h == NAME) & F.col("_chain").isNotNull(),
            "venue": lambda h: (h == TAG) & _mall_shop(),
        }.get(c.key)
        telling = _typed(c.types) | _aliased(c.aliases) | _tagged([t for t in c.tags if t not in K.GENERIC_TAGS])
        match = F.struct(F.lit(c.key).alias("key"), F.lit(c.weight).alias("weight"), F.lit(order).alias("ord"), how.alias("how"), telling.alias("telling"), named.alias("named"))
        found.append(F.when(how.isNotNull() & (~veto(how) if veto else F.lit(True)), match))
    return F.array_compact(F.array(*found))


def _heaviest(options: Column) -> Column:
    """The match of most weight, the first of them on ties."""
    return F.reduce(options, F.try_element_at(options, F.lit(1)), lambda best, m: F.when(m["weight"] > best["weight"], m).otherwise(best))


def _one(key: str | Column, how: str | Column, like: Column) -> Column:
    """A match made up by a rule."""
    key = F.lit(key) if isinstance(key, str) else key
    weight = F.try_element_at(F.create_map(*(F.lit(x) for c in K.CATEGORIES for x in (c.key, c.weight))), key)
    order = F.try_element_at(F.create_map(*(F.lit(x) for i, c in enumerate(K.CATEGORIES) for x in (c.key, i))), key)
    how = F.lit(how) if isinstance(how, str) else how
    return F.struct(key.alias("key"), weight.alias("weight"), order.alias("ord"), how.alias("how"), F.lit(False).alias("telling"), F.lit(False).alias("named"))


def _keys(matches: Column) -> Column:
    return F.transform(matches, lambda m: m["key"])


def classify(listings: DataFrame) -> DataFrame:
    """listings with category_key, category_how (null: no category), also_matched array<string>, rule."""
    names = [c for c in listings.columns if c not in ("category_key", "category_how", "also_matched", "rule")]
    found = with_facts(listings.select(*names)).withColumn("_chain", retail_chain())
    found = found.withColumn("_matched", _matches())
    is_tagged = lambda m: m["how"].isin(TYPE, ALIAS, TAG)
    chain = F.col("_chain")
    found = found.withColumns({
        "_tagged": F.filter("_matched", is_tagged),
        "_by_name": F.filter("_matched", lambda m: m["how"] == NAME),
        "_kept": F.when(chain.isNotNull(), F.filter("_matched", lambda m: ~m["key"].isin("distribution", "manufacturing"))).otherwise(F.col("_matched")),
    })
    found = found.withColumn("_specific", F.filter("_kept", lambda m: is_tagged(m) & m["telling"]))
    some = lambda c: F.size(c) > 0
    kept, every = F.col("_kept"), F.col("_matched")
    no_one, nothing = F.lit(None).cast(found.schema["_matched"].dataType.elementType), F.slice(every, 1, 0)
    tagged_keys = _keys(F.col("_tagged"))
    shop = F.exists("_raw", lambda c: c.startswith("shop="))
    equipment = F.filter("_matched", lambda m: (m["key"] == "equipment") & (m["how"] == NAME))
    production = (_typed(K.PRODUCTION_TYPES) | _aliased(K.PRODUCTION_ALIASES)) & ~(_typed(K.SERVICE_TYPES) | _aliased(K.SERVICE_ALIASES))
    made = F.filter("_kept", lambda m: m["key"] == "food_production")
    resort = (F.col("_name").rlike(r"(^|.* )resorts?$") | _named(K.RESORT_WORDS)) & ~_named(K.SHOP_WORDS)
    as_resort = shop & (F.size(F.array_except(tagged_keys, literals(["specialty_retail", "retail"]))) == 0) & resort
    as_mall = (F.array_distinct(tagged_keys) == literals(["multifamily"])) & _named(K.MALL_OWN_WORDS) & ~_named(K.BY_KEY["multifamily"].words)
    only_tags = ~F.exists("_tagged", lambda m: m["how"] != TAG)
    named_as = _one(F.when(as_resort, "hospitality").otherwise("venue"), NAME, every)
    blockers = F.filter("_types", lambda t: t.isin(K.NON_PROSPECT_TYPES))
    allowed = lambda key: (F.size(blockers) > 0) & F.forall(blockers, lambda t: reduce(lambda a, b: a | b, ((t == k) & key.isin(v) for k, v in K.NAME_BEATS_TYPE.items())))
    rescue = F.filter("_by_name", lambda m: allowed(m["key"]))
    other_block = _aliased(K.NON_PROSPECT_ALIASES) | _tagged(K.NON_PROSPECT_TAGS)
    telling_name = some("_by_name") | F.exists("_tagged", lambda m: m["named"])
    utility_named = _named(K.UTILITY_WORDS) | has_term(F.col("_operators"), K.UTILITY_OPERATORS)
    poor = small_generic_building() | utility_named | _named(K.NOT_PLANT_WORDS)
    retail = _one("retail", F.when(F.array_contains("_types", "store"), TYPE).otherwise(TAG), every)
    brand = _one(chain, CHAIN, every)
    both = F.concat("_tagged", "_by_name")
    rules: list[tuple[str, Column, Column, Column]] = [
        ("equipment name", some(equipment), F.try_element_at(equipment, F.lit(1)), every),
        ("not-a-prospect name", non_prospect_name(), no_one, every),
        ("utility structure", utility_structure(), no_one, every),
        ("utility plant", service_plant(), no_one, nothing),
        ("vehicle wash", vehicle_wash(), no_one, nothing),
        ("clinic", clinic() & F.array_contains(_keys(every), "healthcare"), no_one, F.filter(kept, lambda m: m["key"] != "healthcare")),
        ("self-storage", self_storage(), no_one, every),
        ("retail chain", chain.isNotNull() & ~some("_specific"), brand, F.concat(kept, F.array(brand))),
        ("production listing", some("_specific") & (_heaviest(F.col("_specific"))["key"] == "food_service") & production & some(made), F.try_element_at(made, F.lit(1)), kept),
        ("resort or mall name", only_tags & (as_resort | as_mall), named_as, F.concat(kept, F.array(named_as))),
        ("own category", some("_specific"), _heaviest(F.col("_specific")), kept),
        ("name beats type", non_prospect_type() & some(rescue) & ~other_block, _heaviest(rescue), kept),
        ("not-a-prospect type", non_prospect_type(), no_one, kept),
        ("shop", shop | F.array_contains("_raw", "store"), retail, F.concat(kept, F.array(retail))),
        ("not a plant", some("_tagged") & ~telling_name & poor, no_one, kept),
        ("catch-all tag or name", some(both), _heaviest(both), kept),
        ("search phrase", some(kept), _heaviest(kept), kept),
    ]
    decided = reduce(lambda chain_, r: chain_.when(r[1], F.lit(r[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0]))).otherwise("nothing matched")
    found = found.withColumn("rule", decided)
    rule = F.col("rule")
    best = reduce(lambda c, r: c.when(rule == r[0], r[2]), rules[1:], F.when(rule == rules[0][0], rules[0][2]))
    also = reduce(lambda c, r: c.when(rule == r[0], _keys(r[3])), rules[1:], F.when(rule == rules[0][0], _keys(rules[0][3]))).otherwise(literals([]))
    found = found.withColumns({"_best": best, "also_matched": F.array_distinct(also)})
    return found.select(*names, F.col("_best.key").alias("category_key"), F.col("_best.how").alias("category_how"), "also_matched", "rule")
