"""Towns of listings: names as a gazetteer has them, the town and ZIP area that a listing is near, words for both.

The gazetteer has towns (name, state, lat, lon, radius_miles, place: its order) and ZIP areas (zip, lat, lon, radius_miles).
A listing's own text stays as its source gave it; only what is shown changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmere.functions.number import exact_round
from plotmere.functions.text import blank, stripped
from plotmere.operators.places import nearest_area
from plotmere.operators.shared import shared_folder, written

# Words that addresses write short, and states by code.
SHORT = {
    "n": "north", "no": "north", "s": "south", "so": "south", "e": "east", "w": "west", "mt": "mount", "ft": "fort", "pt": "point", "hts": "heights", "hgts": "heights",
    "spg": "springs", "spgs": "springs", "spr": "springs", "vly": "valley", "pk": "park", "cyn": "canyon", "ctr": "center", "cntr": "center", "twp": "township", "saint": "st",
}
STATES = {"UT": "utah", "ID": "idaho", "NV": "nevada", "WY": "wyoming", "CO": "colorado"}
HOME = "UT"

_NOTES = rf"(?i)(\s*\([^)]*\)\s*|[\s,]+({'|'.join(x for s in STATES.items() for x in s)})\.?|,\s*)+$"


def town_key(text: Column) -> Column:
    """A town's words in one form: lower case, no punctuation, short words written out, a plural's s dropped."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    long = F.create_map(*(F.lit(x) for pair in SHORT.items() for x in pair))
    full = F.transform(words, lambda w: F.coalesce(F.try_element_at(long, w), w))
    return F.array_join(F.transform(full, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")


def _initials(key: Column) -> Column:
    return F.array_join(F.transform(F.split(key, " "), lambda w: F.substring(w, 1, 1)), "")


def state_code(state: Column | str) -> Column:
    """UT for ut, Utah or UT; other texts as they are, without spaces around them."""
    text = stripped(state)
    return F.coalesce(*(F.when(F.lower(text).isin(code.lower(), name), code) for code, name in STATES.items()), text)


def table_state(state: Column | str) -> Column:
    """The state whose towns a city is looked up among."""
    code = F.upper(stripped(state))
    return F.when(code.isin(list(STATES)), code).otherwise(HOME)


def readable(text: Column) -> Column:
    """Words in capitals or in small letters only, each with a capital first; mixed ones as they are."""
    words = F.split(text, r"(?<![A-Za-z'])(?=[A-Za-z])|(?<=(?:^|[^A-Za-z])')(?=[A-Za-z])|(?<=[A-Za-z])(?=[^A-Za-z'])")
    raised = F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))).otherwise(w)), "")
    return F.when(text.rlike(r"\p{L}") & ((text == F.upper(text)) | (text == F.lower(text))), raised).otherwise(text)


def tidied(cities: DataFrame, towns: DataFrame) -> DataFrame:
    """(city, state, name, known, short) for each different city and state (of table_state): the town's own name where the gazetteer knows it.

    Its key is looked up as it is, without "city" behind it, with it, and last as initials that one town alone has.
    """
    plain = F.trim(F.regexp_replace(blank("city"), r"\s+", " "))
    rows = cities.select("city", "state").distinct().withColumn("text", F.regexp_replace(plain, _NOTES, ""))
    none = F.lower("text").isin(["", *(s.lower() for s in STATES), *STATES.values()])
    rows = rows.withColumn("key", town_key(F.col("text")))
    key = F.col("key")
    forms = F.array(key, F.regexp_replace(key, " city$", ""), F.concat(key, F.lit(" city")), F.when(~key.contains(" ") & (F.length(key) >= 3), F.concat(F.lit("."), key)))
    named = towns.select("state", "name", "place", town_key(F.col("name")).alias("k"))
    by_key = named.groupBy("state", F.col("k").alias("form")).agg(F.max_by("name", "place").alias("known"))
    several = named.filter(F.trim("name").contains(" ")).select("state", F.concat(F.lit("."), _initials(F.col("k"))).alias("form"), "name").distinct()
    alone = several.groupBy("state", "form").agg(F.min("name").alias("known"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    asked = rows.filter(~none).select("city", "state", F.posexplode(forms).alias("rank", "form")).filter("form is not null")
    met = asked.join(by_key.union(alone), ["state", "form"]).groupBy("city", "state").agg(F.min_by("known", "rank").alias("known"))
    found = rows.join(met, ["city", "state"], "left")
    name = F.when(none, "").otherwise(F.coalesce("known", readable(F.col("text"))))
    return found.select("city", "state", name.alias("name"), F.col("known").isNotNull().alias("known"), F.replace("key", F.lit(" "), F.lit("")).alias("short"))


def near(points: DataFrame, towns: DataFrame, zips: DataFrame, key: str) -> DataFrame:
    """(key, near_town, near_state, near_zip) of points (lat, lon): the areas that are nearest; none beyond 15 miles of every town."""
    ok = ~F.isnan("lat") & ~F.isnan("lon") & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    own = points.filter("lat is not null and lon is not null").filter(ok).select(key, exact_round(F.col("lat"), 4).alias("lat"), exact_round(F.col("lon"), 4).alias("lon"))
    town = nearest_area(own, towns.select(F.concat_ws("|", "name", "state").alias("name"), "lat", "lon", "radius_miles"), key).select(key, F.col("name").alias("_t"))
    area = nearest_area(own, zips.select(F.col("zip").alias("name"), "lat", "lon", "radius_miles"), key).select(key, F.col("name").alias("near_zip"))
    return town.join(area, key, "left").select(key, F.substring_index("_t", "|", 1).alias("near_town"), F.substring_index("_t", "|", -1).alias("near_state"), F.coalesce("near_zip", F.lit("")).alias("near_zip"))


def with_towns(listings: DataFrame, towns: DataFrame, zips: DataFrame, key: str = "uid") -> DataFrame:
    """listings (key, city, state, zip, lat, lon, ...) with listed_town, town, near_text, near_town, near_state and near_zip.

    listed_town is the city's own name. A text that names nothing the gazetteer knows, of up to four letters, is the town
    the listing is near (by its place, else its ZIP area's) where that town begins so or has those initials; else it stays,
    made readable, or says nothing where it has one or two letters. town is the listed one, else the one it is near.
    near_text says where a listing without a town or ZIP is: "near West Jordan, UT 84088"; the near columns are blank for others.

    Cities are looked up once for each different text, so a city that a third of all rows have is one row there.
    """
    spark, folder = listings.sparkSession, shared_folder(listings.sparkSession, "towns")
    names = listings.columns
    rows = listings.withColumn("_state", table_state("state")).withColumn("_city", blank("city"))
    found = written(tidied(rows.select(F.col("_city").alias("city"), F.col("_state").alias("state")), towns), f"{folder}/cities").withColumnsRenamed({"city": "_city", "state": "_state", "name": "_name"})
    rows = rows.join(found, ["_city", "_state"], "left")
    unsure = ~F.col("known") & (F.col("_name") != "") & F.col("short").rlike("^[a-z]{1,4}$")
    lacks = F.col("known") & (stripped("zip") != "")
    rows = written(rows.withColumn("_unsure", unsure).withColumn("_asks", ~F.coalesce(lacks, F.lit(False))), f"{folder}/rows")
    own = near(rows.filter("_asks").select(key, "lat", "lon"), towns, zips, key)
    place = rows.filter("_unsure").select(key, F.substring(stripped("zip"), 1, 5).alias("zip")).join(zips.select("zip", "lat", "lon").dropDuplicates(["zip"]), "zip")
    by_zip = near(place, towns, zips.limit(0), key).select(key, F.col("near_town").alias("_zt"), F.col("near_state").alias("_zs"))
    rows = rows.join(written(own, f"{folder}/near"), key, "left").join(by_zip, key, "left")
    here = F.when(F.col("near_town").isNotNull(), F.when(F.col("near_state") == F.col("_state"), F.col("near_town"))).otherwise(F.when(F.col("_zs") == F.col("_state"), F.col("_zt")))
    there = town_key(here)
    fits = F.replace(there, F.lit(" "), F.lit("")).startswith(F.col("short")) | (there.contains(" ") & (_initials(there) == F.col("short")))
    listed = F.when(F.col("known") | (F.col("_name") == ""), F.col("_name")).when(F.col("_unsure") & here.isNotNull() & fits, here).when(F.length("short") > 2, F.col("_name")).otherwise("")
    rows = rows.withColumn("listed_town", listed)
    away = (F.col("listed_town") == "") | (stripped("zip") == "")
    words = F.concat(F.lit("near "), F.col("near_town"), F.lit(", "), F.col("near_state"), F.when(F.col("near_zip") != "", F.concat(F.lit(" "), F.col("near_zip"))).otherwise(""))
    town = F.when(F.col("listed_town") != "", F.col("listed_town")).otherwise(F.coalesce("near_town", F.lit("")))
    of = lambda c: F.when(away, F.coalesce(c, F.lit(""))).otherwise("")
    return rows.select(*names, "listed_town", town.alias("town"), of(words).alias("near_text"), *(of(F.col(c)).alias(c) for c in ("near_town", "near_state", "near_zip")))


def place_columns(listings: DataFrame) -> DataFrame:
    """listings (of with_towns) with shown_city, shown_state and shown_zip, as downloads have them: what is listed, else "near" and where it is."""
    near = lambda c: F.when(F.col(c) != "", F.concat(F.lit("near "), F.col(c))).otherwise("")
    return listings.withColumns({
        "shown_city": F.when(F.col("listed_town") != "", F.col("listed_town")).otherwise(near("near_town")),
        "shown_state": F.when(stripped("state") != "", state_code("state")).otherwise(F.col("near_state")),
        "shown_zip": F.when(stripped("zip") != "", F.col("zip")).otherwise(near("near_zip")),
    })


# ---------------------------------------------------------------- addresses

# Street words written short.
STREET_SHORT = {
    "north": "n", "south": "s", "east": "e", "west": "w", "road": "rd", "street": "st", "avenue": "ave", "av": "ave", "drive": "dr", "boulevard": "blvd", "lane": "ln", "court": "ct",
    "circle": "cir", "highway": "hwy", "parkway": "pkwy", "place": "pl",
}


def street_words(address: Column) -> Column:
    from plotmere.functions.text import normalize

    short = F.create_map(*(F.lit(x) for pair in STREET_SHORT.items() for x in pair))
    return F.transform(F.filter(F.split(normalize(address), " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(short, w), w))


def at_facilities(listings: DataFrame, facilities: DataFrame, key: str = "uid") -> DataFrame:
    """(key) of listings whose address begins with the street of a facility (street, town), in that town or without a listed one.

    Street words are compared whole, so a suite may follow; listings have address and listed_town. Facilities are looked
    up by every beginning of a street that is as long as one of theirs and starts with one of their house numbers: an equi-join whatever the numbers.
    """
    known = facilities.select(street_words(F.col("street")).alias("w"), blank("town").alias("town")).filter(F.size("w") > 0)
    known = known.select(F.array_join("w", " ").alias("street"), F.size("w").alias("n"), F.element_at("w", 1).alias("first"), "town").distinct()
    lengths = known.groupBy("first").agg(F.collect_set("n").alias("lengths"))  # few different lengths
    rows = listings.select(key, "listed_town", street_words(blank("address")).alias("w")).withColumn("first", F.try_element_at("w", F.lit(1)))
    asked = rows.join(lengths, "first").select(key, "listed_town", "w", F.explode("lengths").alias("n")).filter(F.size("w") >= F.col("n"))
    asked = asked.select(key, "listed_town", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("street"))
    met = asked.join(known.select("street", "town"), "street")
    return met.filter((blank("listed_town") == "") | (F.col("town") == "") | (F.col("town") == F.col("listed_town"))).select(key).distinct()
