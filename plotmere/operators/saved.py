"""The saved list over time: parts of listings, offers to saved rows, merges with lineage, conflicts between marks.

A saved row is a group of parts (uid, source, source_id, ...), each as its source sent it. A search brings new parts; what
it knows of a part replaces the part's earlier self, older parts stay, and the row is built again from its parts.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmere.functions.text import blank
from plotmere.operators.dense import dense_regions, linked_regions
from plotmere.operators.resolve import TOLD, duplicates, likely_pairs, linkage, merge_groups, merge_parts, prepared, ranked_duplicates, site_groups, site_pairs
from plotmere.operators.score import score
from plotmere.operators.shared import connected, shared_folder, written
from plotmere.plans import categories as K



def part_id(source: Column | str = "source", source_id: Column | str = "source_id", name: Column | str | None = None) -> Column:
    """What tells parts apart: the source and its id (or, where a name is given, that for parts without an id)."""
    told = blank(source_id) if name is None else F.when(blank(source_id) != "", blank(source_id)).otherwise(blank(name))
    return F.concat(blank(source), F.lit(":"), told)


def offers(leads: DataFrame, saved: DataFrame, lead_parts: DataFrame | None = None, saved_parts: DataFrame | None = None, towns: list[str] | None = None) -> DataFrame:
    """(rid, uid, priority, miles, first_seen): the saved rows that a lead may join.

    Those that have one of its listings come first (0; the row saved first before others, so they have no miles), then its
    duplicates by all the rules of a search (1, the nearest first), then rows of its site (2, the nearest first). leads are
    listings with rid, saved has uid and first_seen too; lead_parts (rid, source, source_id) and saved_parts (uid, source,
    source_id) are the listings that they are made of, by default one each.
    """
    folder = shared_folder(leads.sparkSession, "offers")
    one = lambda df, key: df.select(key, part_id().alias("part"))
    seen = saved.select("uid", "first_seen")
    by_id = one(leads if lead_parts is None else lead_parts, "rid").join(one(saved if saved_parts is None else saved_parts, "uid"), "part").join(seen, "uid")
    by_id = by_id.select("rid", "uid", F.lit(0).alias("priority"), F.lit(0.0).alias("miles"))
    columns = [c for c in leads.columns if c in saved.columns and c not in ("rid", "uid", "first_seen")]
    both = leads.select(F.col("rid").alias("_lead"), F.lit(None).cast("string").alias("_uid"), *columns).union(saved.select(F.lit(None).cast("long"), "uid", *columns))
    both = written(prepared(both.withColumn("rid", F.monotonically_increasing_id() * 2 + F.col("_lead").isNull().cast("long"))), f"{folder}/both")  # leads are even

    def across(pairs: DataFrame, priority: int) -> DataFrame:
        pairs = pairs.select(F.col("a.rid").alias("x"), F.col("b.rid").alias("y"), "miles")
        who = lambda name: both.select(F.col("rid").alias(name), F.col("_lead").alias(f"{name}_lead"), F.col("_uid").alias(f"{name}_uid"))
        found = pairs.hint("merge").join(who("x"), "x").hint("merge").join(who("y"), "y")
        return found.select(F.coalesce("x_lead", "y_lead").alias("rid"), F.coalesce("x_uid", "y_uid").alias("uid"), F.lit(priority).alias("priority"), "miles")

    found = by_id.union(across(duplicates(likely_pairs(both.select(*(c for c in TOLD if c in both.columns)), apart=True), towns), 1)).union(across(site_pairs(both, towns, apart=True), 2))
    return found.groupBy("rid", "uid").agg(F.min(F.struct("priority", "miles")).alias("o")).join(seen, "uid").select("rid", "uid", "o.priority", "o.miles", "first_seen")


def saved_again(old_parts: DataFrame, new_parts: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(uid, n_parts, sources, first_seen, last_seen, is_new) of every saved row after a search's parts were put in.

    closed has the uids of leads that the search found closed for good: of those, one that isn't saved yet is not added.
    """
    known = old_parts.select("uid").distinct().withColumn("_known", F.lit(True))
    if closed is not None:
        new_parts = new_parts.join(closed.select("uid").distinct().join(known, "uid", "left_anti"), "uid", "left_anti")
    every = merge_parts(old_parts, new_parts)
    first = old_parts.union(new_parts.select(*old_parts.columns)).groupBy("uid").agg(F.min("at").alias("first_seen"))
    rows = every.groupBy("uid").agg(F.count(F.lit(1)).alias("n_parts"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("at").alias("last_seen"))
    return rows.join(first, "uid").join(known, "uid", "left").select("uid", "n_parts", "sources", "first_seen", "last_seen", F.col("_known").isNull().alias("is_new"))


def rebuilt(parts: DataFrame, closed: DataFrame | None = None, keywords: tuple[str, ...] = K.DEFAULT_KEYWORDS) -> DataFrame:
    """Saved rows made anew from their parts (listings with uid and at) by the rules of a merge, scored with the fixed words.

    Of parts that a merge doesn't tell apart the newer comes first. Rows of closed (uid) are closed for good, whatever older parts say.
    """
    folder = shared_folder(parts.sparkSession, "rebuilt")
    dealt = parts.repartition("uid").sortWithinPartitions("uid", F.desc("at"), part_id())
    numbered = written(dealt.withColumn("rid", F.monotonically_increasing_id()), f"{folder}/parts")
    merged = merge_groups(numbered.drop("uid", "at"), numbered.select("rid", F.col("uid").alias("grp"))).withColumnRenamed("grp", "uid")
    if closed is not None:
        merged = merged.join(closed.select("uid").distinct().withColumn("_shut", F.lit(True)), "uid", "left").withColumn("business_status", F.when(F.col("_shut"), "CLOSED_PERMANENTLY").otherwise(F.col("business_status"))).drop("_shut")
    return score(written(merged, f"{folder}/merged"), keywords)


def save_counts(rows: DataFrame, new_parts: DataFrame) -> DataFrame:
    """One row: how many saved rows a search brought new, and how many it found again."""
    touched = rows.join(new_parts.select("uid").distinct(), "uid", "left_semi")
    return touched.agg(F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("updated"))


def kept_rows(groups: DataFrame) -> DataFrame:
    """(other_uid, keep_uid) of saved rows (grp, uid, first_seen) that turned out to be one: the first seen is kept."""
    keep = groups.groupBy("grp").agg(F.min(F.struct("first_seen", "uid")).alias("_k")).select("grp", F.col("_k.uid").alias("keep_uid"))
    return groups.join(keep, "grp").filter("uid <> keep_uid").select(F.col("uid").alias("other_uid"), "keep_uid")


def same_business(rows: DataFrame, parts: DataFrame, ids: DataFrame | None = None, towns: list[str] | None = None) -> DataFrame:
    """(keep_uid, other_uid): saved rows that are one business by the rules a search merges with; the row saved first is kept.

    rows has uid and first_seen, parts the listings (with uid) that they are made of; rows without parts are left alone. A
    row's listings are together from the start, and so are those of rows that share a record. Such groups join when every
    listing of one is a duplicate of every listing of the other, the strongest pair first; then merged rows that are parts
    of one site; then rows that share an id of ids (uid, source, source_id; the parts' where there is none).

    A pair of groups counts only if it has as many duplicate pairs as pairs, so linkage looks at groups, not listings.
    """
    folder = shared_folder(parts.sparkSession, "same")
    listings = written(prepared(parts.repartition("uid").withColumn("rid", F.monotonically_increasing_id())), f"{folder}/listings")
    first = listings.groupBy("uid").agg(F.min("rid").alias("a"))
    by_record = listings.select("uid", part_id().alias("part")).join(first, "uid")
    meet = lambda df: df.join(df.groupBy("part").agg(F.min("a").alias("b")), "part").select("a", "b")
    start = connected(meet(by_record))
    own = written(first.join(start.withColumnRenamed("node", "a"), "a", "left").select("uid", F.coalesce("component", "a").alias("start")), f"{folder}/start")
    listings = listings.join(own, "uid")
    # Pairs are made outside dense regions only.
    dense = dense_regions(listings, towns)
    alone = None if dense is None else written(linked_regions(dense), f"{folder}/alone")
    others = listings if dense is None else written(listings.join(alone, "start", "left_anti"), f"{folder}/others")
    of = lambda side, name: others.select(F.col("rid").alias(side), F.col("start").alias(name))
    pairs = ranked_duplicates(others.drop("uid", "start"), towns).join(of("i", "g"), "i").join(of("j", "h"), "j").filter("g <> h")
    rank = F.struct("strength", "reviews", "miles", "i", "j")
    size = others.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    met = pairs.groupBy(F.least("g", "h").alias("x"), F.greatest("g", "h").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("r"))
    whole = met.join(size.select(F.col("start").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("start").alias("y"), F.col("n").alias("ny")), "y").filter("n = nx * ny")
    edges = written(whole.select("x", "y", "r.*"), f"{folder}/edges")
    spots = listings.select(F.col("rid").alias("node"), "lat", "lon")
    linked = linkage(edges, spots=spots).filter("grp is not null").select(F.col("x").alias("start"), "grp")
    linked = linked if alone is None else linked.union(alone)
    groups = written(own.select("start").distinct().join(linked, "start", "left").select("start", F.coalesce("grp", "start").alias("grp")), f"{folder}/groups")
    merged = merge_groups(listings.drop("uid", "start"), listings.select("rid", "start").join(groups, "start").select("rid", "grp"))
    sites = site_groups(written(merged.withColumnRenamed("grp", "rid"), f"{folder}/merged"), towns)
    more = own if ids is None else ids.select("uid", part_id().alias("part")).join(own, "uid").select("part", F.col("start").alias("a"))
    links = groups.select(F.col("start").alias("a"), F.col("grp").alias("b")).union(sites.select(F.col("rid").alias("a"), F.col("site").alias("b")))
    links = links if ids is None else links.union(meet(more))
    found = connected(links)
    rows = rows.join(own.join(found.withColumnRenamed("node", "start"), "start"), "uid").select("uid", "first_seen", "component")
    keep = rows.groupBy("component").agg(F.min(F.struct("first_seen", "uid")).alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(keep, "component").filter("uid <> k.uid").select(F.col("k.uid").alias("keep_uid"), F.col("uid").alias("other_uid"))


def merged_marks(groups: DataFrame, marks: DataFrame) -> DataFrame:
    """(grp, keep_uid, value, at, given_to, disagreed) of groups (grp, uid, first_seen) of saved rows that become one.

    The row saved first takes the group's latest mark of marks (uid, value, at), or, where some rows are marked yes and some no,
    the latest yes, and is known to be in disagreement. Groups without a mark are left out.
    """
    keep = groups.groupBy("grp").agg(F.min(F.struct("first_seen", "uid")).alias("_k")).select("grp", F.col("_k.uid").alias("keep_uid"))
    own = groups.select("grp", "uid").join(marks.select("uid", "value", "at"), "uid")
    last = lambda test: F.max(F.when(test, F.struct("at", "value", "uid")))
    value = F.col("value")
    told = own.groupBy("grp").agg((F.bool_or(value == "yes") & F.bool_or(value == "no")).alias("disagreed"), last(value == "yes").alias("yes"), last(F.lit(True)).alias("any"))
    told = told.withColumn("m", F.when(F.col("disagreed"), F.col("yes")).otherwise(F.col("any")))
    return told.join(keep, "grp").select("grp", "keep_uid", "m.value", "m.at", F.col("m.uid").alias("given_to"), "disagreed")


def with_lineage(rows: DataFrame, plan: DataFrame, at: Column, key: str = "uid", marks: DataFrame | None = None, disagreed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows without those that the plan (other_uid, keep_uid) merges away, and what they were: (uid, into_uid, at, row, mark, disagreed).

    marks (uid, value) are the marks they had; disagreed (keep_uid) the kept rows whose group was marked both yes and no.
    """
    gone = plan.select(F.col("other_uid").alias(key), F.col("keep_uid").alias("into_uid"))
    lineage = rows.join(gone, key).select(key, "into_uid", at.alias("at"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("row"))
    mark = marks.select(key, F.col("value").alias("mark")) if marks is not None else lineage.select(key).limit(0).withColumn("mark", F.lit(""))
    apart = disagreed.select(F.col("keep_uid").alias("into_uid")).distinct().withColumn("disagreed", F.lit(True)) if disagreed is not None else lineage.select("into_uid").limit(0).withColumn("disagreed", F.lit(True))
    lineage = lineage.join(mark, key, "left").join(apart, "into_uid", "left").fillna({"mark": "", "disagreed": False})
    return rows.join(gone, key, "left_anti"), lineage.select(key, "into_uid", "at", "row", "mark", "disagreed")


def disagreements(lineage: DataFrame, clicks: DataFrame) -> DataFrame:
    """(uid, since): rows joined from rows marked yes and no (lineage with disagreed), the last time at since, that nobody
    has marked from then on by a click (uid, at, undone_at) that wasn't undone. They wait for someone to confirm their mark.
    """
    merged = lineage.filter("disagreed").groupBy(F.col("into_uid").alias("uid")).agg(F.max("at").alias("since"))
    clicked = clicks.filter("undone_at is null").groupBy("uid").agg(F.max("at").alias("_last"))
    return merged.join(clicked, "uid", "left").filter("_last is null or _last < since").select("uid", "since")


def added_all(current: DataFrame, batch: DataFrame, key: str = "uid") -> DataFrame:
    """current with a batch's rows, all of them or (where a key of the batch is null, repeated or known) none."""
    once = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bad = once.filter(F.col(key).isNull() | (F.col("_n") > 1)).select(key).union(batch.select(key).join(current.select(key), key, "left_semi"))
    if not bad.isEmpty():
        raise ValueError("the batch has rows that can't be added; none is")
    return current.unionByName(batch.select(*current.columns))
