"""Plans that chain operators: a search from answers to a ranked list, and the list query over saved rows."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotmere.operators import activity, listing
from plotmere.operators.resolve import resolve
from plotmere.operators.score import flagged, keyword_hits, score
from plotmere.operators.shared import shared_folder, written
from plotmere.plans import categories as K
from plotmere.sources.listings import together, within

#: Miles around the circle in which listings are still merged, least score, and the circle of a search.
MARGIN, LEAST_SCORE, MILES = 0.5, 20, 30.0


class Search(NamedTuple):
    lat: float
    lon: float
    miles: float = MILES
    keywords: tuple[str, ...] = ()
    least_score: int = LEAST_SCORE
    only_hits: bool = False
    limit: int | None = None


def search(found: list[DataFrame], asked: Search, towns: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Listings of all sources in the circle: merged, scored, the kept ones, the best first.

    Scores count the fixed words; the words that were typed only tell which listings match (matched_keywords, only_hits).
    Companies that are known (alias, company, kind, ord) are no prospects: competitors, and one's own. The margin lets a listing outside merge with one inside; closed listings are merged before they are left out.
    """
    if not 0 < asked.miles <= 100:
        raise ValueError("a search has a radius of up to 100 miles")
    near = within(together(*found).filter("lat is not null and lon is not null"), asked.lat, asked.lon, asked.miles, MARGIN).drop("distance_miles")
    # Each step is written: a filter on a score would be pushed through all rules, and the plan would be too large to optimize.
    folder = shared_folder(near.sparkSession, "search")
    own = F.xxhash64("source", "source_id", F.when(F.coalesce(F.col("source_id"), F.lit("")) == "", F.to_json(F.struct(*(F.col(f"`{c}`") for c in near.columns)))))
    near = written(near.withColumn("rid", own), f"{folder}/near")
    merged = written(resolve(near, towns), f"{folder}/merged")
    scored = written(score(within(merged, asked.lat, asked.lon, asked.miles), K.DEFAULT_KEYWORDS), f"{folder}/scored")
    typed = keyword_hits(asked.keywords) if asked.keywords else F.array().cast("array<string>")
    scored = scored.withColumn("_raw", F.coalesce("raw_categories", F.array().cast("array<string>"))).withColumn("matched_keywords", typed).drop("_raw")
    scored = flagged(scored, known) if known is not None else scored
    scored = listing.dispositions(scored, asked.least_score, asked.only_hits)
    kept = scored.filter("disposition = 'kept'")
    kept = listing.top_prospects(kept, asked.limit, "grp") if asked.limit is not None else kept
    return listing.best_first(kept, "grp")


def saved_list(leads: DataFrame, marks: DataFrame, calls: DataFrame, key: str = "uid") -> DataFrame:
    """leads with their latest mark and calls, and the tabs that they are under; logs have (uid, at, id, ...)."""
    out = activity.with_latest(leads, marks.filter("undone_at is null"), key, "at", "value", tie="id", prefix="mark_")
    out = activity.with_latest(out, calls, key, "at", "outcome", "at", tie="id", prefix="call_")
    closed = F.coalesce(F.col("business_status"), F.lit("")) == "CLOSED_PERMANENTLY"
    return out.withColumn("tabs", listing.tabs(F.col("mark_value"), F.col("call_n"), closed, F.col("lead_type")))


def list_page(rows: DataFrame, tab: str = "all", query: str = "", tier: str = "", sort: str = "score", descending: bool = True, offset: int = 0, limit: int = 100, texts: Iterable[str] = ("name", "city", "zip", "category", "address")) -> DataFrame:
    """A page of a tab: rows with all words of the query somewhere in their texts, in the asked order."""
    found = rows.filter(F.array_contains("tabs", tab)).filter(listing.has_words(F.concat_ws(" ", *texts), query))
    found = found.filter(F.col("tier") == tier) if tier else found
    return listing.page(listing.ordered(found, sort, descending, "uid"), offset, limit)
