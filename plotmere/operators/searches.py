"""The record of searches: what ran, earlier searches of a place, budgets, settings, and who may search.

A search has day, at (timestamp), place, lat, lon, radius, miles, source, leads (null until it has found some), partial (a
part is missing) and fill (a struct with until, or null). Records are appended; readers take the latest of each key, combined before the shuffle.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window as W

from plotmere.functions.geo import haversine
from plotmere.functions.text import normalize


def place_key(place: Column | str) -> Column:
    """Places that are written alike but for capitals, punctuation and spaces are one."""
    return normalize(place)


#: Miles within which two centres are one; sources whose searches ask the map; searches that are looked back through.
SAME_CENTRE, MAP_SOURCES, LOOK_BACK = 0.1, ["auto", "osm", "both"], 60


def renamed_place(place: Column, old_names: list[str], name: str) -> Column:
    """A label that begins with one of a company's old names and a comma, with the name that it has now."""
    found = F.coalesce(*(F.when(place.startswith(o + ","), F.concat(F.lit(name), F.substring(place, len(o) + 1, 1_000_000))) for o in old_names), F.lit(None).cast("string"))
    return F.coalesce(found, place)


def earlier(searches: DataFrame, day: Column, since: Column, place: str = "place", *same: str) -> DataFrame:
    """For each place (label, as written, and each value of the other columns) the latest search of an earlier day that found leads.

    Searches have day (a date), at, and leads (how many were found; null until they are known). Those at since or before, and
    those without a place, don't count.
    """
    rows = searches.filter((F.col("day") < day) & (F.col("at") > since) & F.col("leads").isNotNull() & (F.coalesce(F.col(place), F.lit("")) != ""))
    return rows.groupBy(place, *same).agg(F.max_by(F.struct(*rows.columns), F.struct("at", "id")).alias("_r")).select("_r.*")


def latest_of_area(searches: DataFrame, lat: float, lon: float, miles: float, limit: int = LOOK_BACK) -> DataFrame:
    """The latest search of a company's own area, of the last so many: it found leads, asked the map, had the area's radius,
    and its centre (lat, lon; where they are null, miles from the company's place) is the area's. One row or none.
    """
    recent = searches.orderBy(F.desc("at"), F.desc("id")).limit(limit)
    away = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).otherwise(F.col("miles"))
    own = F.col("leads").isNotNull() & F.coalesce(F.col("source"), F.lit("auto")).isin(MAP_SOURCES) & (F.coalesce(F.col("radius"), F.lit(0.0)) == miles) & (away <= SAME_CENTRE)
    return recent.filter(own).orderBy(F.desc("at"), F.desc("id")).limit(1)


def history(*logs: DataFrame, limit: int = 50) -> DataFrame:
    """Rows (kind, at, id, text) of several logs, the newest first."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.orderBy(F.desc("at"), "kind", F.desc("id")).limit(limit)


def in_label_order(details: DataFrame, labels: list[str], column: str = "label") -> DataFrame:
    """Rows of known labels, in the labels' fixed order."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(column))
    return details.withColumn("place", place).filter("place > 0").orderBy("place")


def within_budget(requests: DataFrame, budget: int, order: list[str], key: str | None = None) -> DataFrame:
    """Requests in order, as many (for each key) as the budget allows."""
    turn = F.row_number().over((W.partitionBy(key) if key else W.partitionBy(F.lit(1))).orderBy(*order))
    return requests.withColumn("turn", turn.cast("long")).filter(F.col("turn") <= budget) if key else requests.orderBy(*order).limit(budget)


def rate_limited(tries: DataFrame, keys: list[str], at: str, most: int, seconds: int, tie: str, noted: str | None = None, clears: str | None = None) -> DataFrame:
    """tries with allowed: fewer than most tries that were noted before it lie less than so many seconds before each.

    A refused try is not noted, nor is one where noted is false; one that is allowed and has clears (a right password)
    makes those before it count no more. So a key's tries are read in order, a batch at a time, with the last most noted
    times of one key kept. Tries without a time are not allowed and not noted.
    """
    names = tries.columns
    micros = F.unix_micros(F.col(at).cast("timestamp")).alias("__us")
    rows = tries.select("*", micros, F.to_json(F.struct(*keys)).alias("__key"), (F.col(noted) if noted else F.lit(True)).alias("__noted"), (F.col(clears) if clears else F.lit(False)).alias("__clears"))
    span = seconds * 1_000_000

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times = None, deque(maxlen=most)
        for batch in batches:
            allowed = []
            for who, us, note, clear in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("__key", "__us", "__noted", "__clears")), strict=True):
                if who != key:
                    key, times = who, deque(maxlen=most)
                ok = us is not None and not (len(times) == most and us - times[0] < span)
                allowed.append(ok)
                if ok and clear:
                    times.clear()
                elif ok and note:
                    times.append(us)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(allowed, pa.bool_())], [*names, "allowed"])

    kind = StructType([*tries.schema.fields, StructField("allowed", BooleanType())])
    return rows.repartition("__key").sortWithinPartitions("__key", "__us", tie).mapInArrow(decided, kind)


def next_reset(log: DataFrame, key: str, at: str, now: Column, seconds: int = 86_490) -> DataFrame:
    """(key, used, resets_at): uses in the last so many seconds, and when all of them are back: so long after the newest."""
    recent = log.filter((F.col(at) <= now) & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) < seconds * 1_000_000))
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("used"), (F.max(at) + F.expr(f"interval {seconds} seconds")).alias("resets_at"))


def unexpired(entries: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Cache entries that are younger than so many seconds."""
    return entries.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) < seconds * 1_000_000)


def claims(tries: DataFrame, day: Column, at: str, found: str, tie: str, seconds: int = 1800) -> DataFrame:
    """Tries that hold their day's claim, with day: the first, and each later one that takes over from a holder that has
    found nothing that is recorded (found is false) and is more than so many seconds old.

    A day's tries are read in order, a batch at a time; a task keeps the holder of one day. Tries without a time hold none.
    """
    names, span = tries.columns, seconds * 1_000_000
    rows = tries.select("*", day.alias("day"), F.unix_micros(F.col(at).cast("timestamp")).alias("__us")).filter("day is not null and __us is not null")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder = (None, 0, False)
        for batch in batches:
            keep = []
            for when, us, done in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("day", "__us", found)), strict=True):
                keep.append(when != holder[0] or (not holder[2] and us - holder[1] > span))
                if keep[-1]:
                    holder = when, us, bool(done)
            yield batch.select([*names, "day"]).filter(pa.array(keep, pa.bool_()))

    return rows.repartition("day").sortWithinPartitions("day", "__us", tie).mapInArrow(held, StructType([*tries.schema.fields, rows.schema["day"]]))


def failures(answers: DataFrame, source: str = "source", found: str = "found", failed: str = "failed") -> DataFrame:
    """(source, verdict) of each source's answers: nothing found and a failure is an error, some failures a warning, else ok."""
    told = answers.groupBy(source).agg(F.sum(found).alias("_n"), F.count_if(F.col(failed)).alias("_f"))
    return told.select(source, F.when((F.col("_f") > 0) & (F.col("_n") == 0), "error").when(F.col("_f") > 0, "warning").otherwise("ok").alias("verdict"))


def resolved_settings(defaults: DataFrame, own: DataFrame, companies: DataFrame, company: str = "company", name: str = "name", value: str = "value") -> DataFrame:
    """(company, name, value): a company's own setting where it has one that is not blank, else the default."""
    every = companies.select(company).join(F.broadcast(defaults.select(name, F.col(value).alias("_default"))))  # the settings that the program knows
    rows = every.join(own.select(company, name, F.nullif(value, F.lit("")).alias("_own")), [company, name], "left")
    return rows.select(company, name, F.coalesce("_own", "_default").alias(value))


#: Seconds after a trial's end in which a subscriber's first payment may still be on its way.
TRIAL_GRACE = 24 * 3600


def eligible(company: DataFrame, now: Column) -> DataFrame:
    """company with why (blank: it may search) and allowed, by the first rule that applies.

    A company has demo, status, trial_ends_at, subscription (blank: none), used and searches (a month's, used and
    allowed; null: no plan, so none). Rules: the demo; a canceled plan; a payment past due; a trial that ended, with a
    day's grace for subscribers; the month's searches used up.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ends = F.unix_micros(F.col("trial_ends_at").cast("timestamp")) + F.when(text("subscription") != "", TRIAL_GRACE * 1_000_000).otherwise(0)
    over = (text("status") == "trialing") & (F.unix_micros(now.cast("timestamp")) > ends)
    spent = F.coalesce(F.col("searches"), F.lit(0)) - F.coalesce(F.col("used"), F.lit(0)) <= 0
    why = F.when(F.col("demo"), "demo").when(text("status") == "canceled", "canceled").when(text("status") == "past_due", "past due").when(over, "trial ended").when(spent, "used up").otherwise("")
    return company.withColumn("why", why).withColumn("allowed", F.col("why") == "")


def recent_problems(log: DataFrame, now: Column, days: int = 7, shown: int = 5) -> DataFrame:
    """One row: n problems in so many days, and the latest few texts (newest first). The few are kept while counting."""
    rows = log.filter((F.col("at") <= now) & (F.col("at") > now - F.expr(f"interval {days} days")))
    latest = rows.orderBy(F.desc("at"), F.desc("id")).limit(shown).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id", "text")), asc=False), lambda r: r["text"]).alias("latest"))
    return rows.agg(F.count(F.lit(1)).alias("n")).join(latest)  # rows of one


def usage_by_prefix(log: DataFrame, month: Column, prefixes: list[str], column: str = "text") -> DataFrame:
    """(month, prefix, n): how many texts begin with each prefix, month by month."""
    pick = F.coalesce(*(F.when(F.col(column).startswith(p), F.lit(p)) for p in prefixes))
    return log.select(month.alias("month"), pick.alias("prefix")).filter("prefix is not null").groupBy("month", "prefix").agg(F.count(F.lit(1)).alias("n"))


def progress(steps: DataFrame, weights: dict[str, float], key: str, at: str, tie: str) -> DataFrame:
    """steps (stage, done 0 to 1) with progress: the weighted share of finished and running stages, which never goes back."""
    total, before, shares = sum(weights.values()), 0.0, F.lit(0.0)
    for stage, weight in weights.items():
        shares = F.when(F.col("stage") == stage, (F.lit(before) + F.col("done") * weight) / total).otherwise(shares)
        before += weight
    return steps.withColumn("progress", F.max(shares).over(W.partitionBy(key).orderBy(at, tie)))
