"""The list kept between requests: built once, then changed by the clicks that come in.

A kept list is a folder of versions. A version's manifest names, for each bucket of uids, where its rows and its part of the
activity log are, and the counts of rows by tab and bin. A bin is what the list's order begins with: score, phone (on the
unchecked tab), whole miles. So ranks and pages come from the counts and from the rows of a bin or a few, and no request
sorts the list. A batch of clicks reads the log of the buckets that it touches, makes the touched rows anew, writes those
buckets, and adds the difference to the counts.

Rows (listings) have uid, name, phone, score, distance_miles, lead_type, business_status and more. The log has id, uid, at,
kind and value: "mark" (yes or no), "undo" (the id of a mark), "call" (its outcome), "contact" (a phone). An event counts
once by its id, however often it comes. Events of a uid that is not on the list change nothing. Rows or events without a uid
belong to no listing and are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmere.functions.text import blank
from plotmere.operators.listing import tabs
from plotmere.operators.shared import names_in, publish, read_file, removed

LOG = "id string, uid string, at timestamp, kind string, value string"
#: What rows get from the log.
FIELDS = {"mark": "", "mark_clicks": 0, "calls": 0, "call_outcome": "", "contacts": 0, "verified_phone": ""}
#: Log files of a bucket that are put together; versions that stay.
COMPACT, VERSIONS = 16, 3
BIN = ["score", "no_phone", "miles"]


def folded(log: DataFrame) -> DataFrame:
    """(uid, FIELDS) from a log."""
    log = log.filter("uid is not null").dropDuplicates(["id"])
    undone = log.filter("kind = 'undo'").select(F.col("value").alias("id")).distinct()
    live = log.filter("kind <> 'undo'").join(undone, "id", "left_anti")
    last = lambda kind: F.coalesce(F.max_by("value", F.when(F.col("kind") == kind, F.struct("at", "id"))), F.lit(""))
    many = lambda kind: F.count_if(F.col("kind") == kind)
    made = {"mark": last("mark"), "mark_clicks": many("mark"), "calls": many("call"), "call_outcome": last("call"), "contacts": many("contact"), "verified_phone": last("contact")}
    return live.groupBy("uid").agg(*(c.alias(n) for n, c in made.items()))


def with_fields(listings: DataFrame, log: DataFrame) -> DataFrame:
    """listings with FIELDS, tabs (also "called:" and an outcome), and what their order begins with."""
    own = [c for c in listings.columns if c not in FIELDS and c not in ("tabs", "no_phone", "miles")]
    rows = listings.select(own).join(folded(log), "uid", "left").fillna(FIELDS)
    shown = tabs(F.col("mark"), F.col("calls"), blank("business_status") == "CLOSED_PERMANENTLY", F.col("lead_type"))
    shown = F.when(F.col("calls") > 0, F.array_append(shown, F.concat(F.lit("called:"), "call_outcome"))).otherwise(shown)
    phone = (F.trim(blank("phone")) != "") | (F.trim("verified_phone") != "")
    miles = F.coalesce(F.floor("distance_miles").cast("int"), F.lit(1 << 30))
    return rows.withColumns({"tabs": shown, "no_phone": (~phone).cast("int"), "miles": miles})


def order_of(tab: str) -> list[Column]:
    """The list's own order, best first; among equal scores of the unchecked tab, those with a phone."""
    phone = [F.asc("no_phone")] if tab == "unchecked" else []
    return [F.desc("score"), *phone, F.asc_nulls_last("distance_miles"), F.asc(F.lower(blank("name"))), F.asc("uid")]


def binned(rows: DataFrame, times: int = 1) -> DataFrame:
    """(tab, bin, n) of rows, each counted so many times."""
    phone = F.when(F.col("tab") == "unchecked", F.col("no_phone")).otherwise(0)
    each = rows.select(F.explode("tabs").alias("tab"), "score", "no_phone", "miles").withColumn("no_phone", phone)
    return each.groupBy("tab", *BIN).agg((F.count(F.lit(1)) * times).alias("n"))


def accounted(rows: DataFrame) -> dict[str, int]:
    """What rows account for in the log: clicks that weren't undone, calls, contacts."""
    one = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("mark_clicks", "calls", "contacts"))).first()
    return {c: int(one[c]) for c in ("mark_clicks", "calls", "contacts")}


class KeptList:
    """A kept list in a folder that driver and executors share.

    listings and log return the saved rows and the whole activity log as they are now; they are read when the list is
    built. figures (optional) returns how many clicks not undone, calls and contacts the source's tables hold. Where those
    that no row accounts for changed by more than a batch's own, rows came in some other way, and the list is built anew.
    """

    def __init__(self, spark: SparkSession, folder: str, listings: Callable[[], DataFrame], log: Callable[[], DataFrame], buckets: int = 64, figures: Callable[[], dict[str, int]] | None = None):
        self.spark, self.folder, self.listings, self.log, self.figures, self._buckets = spark, folder.rstrip("/"), listings, log, figures, buckets

    # ------------------------------------------------ versions

    def current(self) -> dict | None:
        """The latest version's manifest."""
        names = [n for n in names_in(self.spark, f"{self.folder}/versions") if n.endswith(".json") and n.count(".") == 1]
        return json.loads(read_file(self.spark, f"{self.folder}/versions/{names[-1]}")) if names else None

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int")

    def _put(self, df: DataFrame, place: str, buckets: int) -> dict[str, str]:
        """Write df by bucket; where each is."""
        df.withColumn("bucket", self._bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", *(c for c in ("score", "at") if c in df.columns)).write.mode("overwrite").partitionBy("bucket").parquet(place)
        return {n.removeprefix("bucket="): f"{place}/{n}" for n in names_in(self.spark, place) if n.startswith("bucket=")}

    def _read(self, paths: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)

    def _publish(self, manifest: dict) -> dict:
        name = f"{self.folder}/versions/{manifest['version']:012d}.json"
        if not publish(self.spark, name, json.dumps(manifest)):
            raise RuntimeError(f"another writer has made version {manifest['version']}")
        return manifest

    def _empty(self) -> tuple[DataFrame, DataFrame]:
        log = self.spark.createDataFrame([], LOG)
        return with_fields(self.listings().limit(0), log), log

    # ------------------------------------------------ changes

    def build(self, batch: int = -1) -> dict:
        """A version from all saved rows and the whole log."""
        now = self.current()
        version = now["version"] + 1 if now else 0
        place = lambda what: f"{self.folder}/{what}/{version}"
        log = self.log().select("id", "uid", F.col("at").cast("timestamp").alias("at"), "kind", "value").filter("uid is not null").dropDuplicates(["id"])
        logs = self._put(log, place("log"), self._buckets)
        kept_log = self._read(list(logs.values()), self.spark.createDataFrame([], LOG))
        rows = self._put(with_fields(self.listings().filter("uid is not null"), kept_log), place("rows"), self._buckets)
        kept = self._read(list(rows.values()), self._empty()[0])
        binned(kept).coalesce(1).write.mode("overwrite").parquet(place("counts"))
        sums = accounted(kept)
        manifest = {
            "version": version, "batch": batch, "buckets": self._buckets, "rows": rows, "log": {k: [v] for k, v in logs.items()},
            "counts": place("counts"), "sums": sums, "lost": self._lost(sums), "built": True,
        }
        return self._publish(manifest)

    def _lost(self, sums: dict[str, int]) -> dict[str, int] | None:
        """Rows of the source's tables that no listing accounts for."""
        return {k: n - sums[k] for k, n in self.figures().items()} if self.figures else None

    def apply(self, batch: DataFrame, number: int) -> dict:
        """The version after a batch of log rows. A batch that is in it already (by number) changes nothing."""
        now = self.current()
        if now is None:
            return self.build(number)
        if number <= now["batch"]:
            return now
        no_rows, no_log = self._empty()
        buckets, version = now["buckets"], now["version"] + 1
        place = lambda what: f"{self.folder}/{what}/{version}"
        batch = batch.select("id", "uid", F.col("at").cast("timestamp").alias("at"), "kind", "value").filter("uid is not null")
        new_logs = self._put(batch, place("log"), buckets)
        if not new_logs:
            return self._publish(now | {"version": version, "batch": number, "built": False})
        fresh = self._read(list(new_logs.values()), no_log)
        logs = dict(now["log"]) | {k: [*now["log"].get(k, []), new_logs[k]] for k in new_logs}
        uids = fresh.select("uid").distinct()
        was = self._read([now["rows"][k] for k in new_logs if k in now["rows"]], no_rows)
        before = was.join(uids, "uid", "left_semi")
        after = with_fields(before, self._read([p for k in new_logs for p in logs[k]], no_log).join(uids, "uid", "left_semi"))
        rows = dict(now["rows"]) | self._put(was.join(uids, "uid", "left_anti").unionByName(after.select(was.columns)), place("rows"), buckets)
        changed = self._read([rows[k] for k in new_logs if k in rows], no_rows).join(uids, "uid", "left_semi")
        counts = self._counts(now).unionByName(binned(before, -1)).unionByName(binned(changed))
        counts.groupBy("tab", *BIN).agg(F.sum("n").alias("n")).filter("n <> 0").coalesce(1).write.mode("overwrite").parquet(place("counts"))
        a, b = accounted(before), accounted(changed)
        sums = {k: now["sums"][k] - a[k] + b[k] for k in a}
        lost = self._lost(sums)
        if lost is not None:
            strange = fresh.dropDuplicates(["id"]).join(self._read(list(rows.values()), no_rows).select("uid"), "uid", "left_anti").groupBy("kind").count()
            own = {r["kind"]: r["count"] for r in strange.collect()}  # four kinds
            if lost != {"mark_clicks": now["lost"]["mark_clicks"] + own.get("mark", 0) - own.get("undo", 0), "calls": now["lost"]["calls"] + own.get("call", 0), "contacts": now["lost"]["contacts"] + own.get("contact", 0)}:
                return self.build(number)
        for k in new_logs:
            if len(logs[k]) >= COMPACT:
                whole = self._read(logs[k], no_log).dropDuplicates(["id"])
                logs[k] = [f"{place('compact')}/bucket={k}"]
                whole.coalesce(1).write.mode("overwrite").parquet(logs[k][0])
        manifest = self._publish({"version": version, "batch": number, "buckets": buckets, "rows": rows, "log": logs, "counts": place("counts"), "sums": sums, "lost": lost, "built": False})
        self.tidy()
        return manifest

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch over a stream of log rows."""
        return lambda batch, number: self.apply(batch, number) and None

    def tidy(self) -> None:
        """Remove what none of the last versions names."""
        names = [n for n in names_in(self.spark, f"{self.folder}/versions") if n.endswith(".json") and n.count(".") == 1]
        kept = [json.loads(read_file(self.spark, f"{self.folder}/versions/{n}")) for n in names[-VERSIONS:]]
        used = {p.rpartition("/bucket=")[0] for m in kept for p in [*m["rows"].values(), *(x for v in m["log"].values() for x in v)]} | {m["counts"] for m in kept}
        for what in ("rows", "log", "counts", "compact"):
            for n in names_in(self.spark, f"{self.folder}/{what}"):
                if n.isdigit() and int(n) <= kept[-1]["version"] and f"{self.folder}/{what}/{n}" not in used:
                    removed(self.spark, f"{self.folder}/{what}/{n}")
        for n in names[:-VERSIONS]:
            removed(self.spark, f"{self.folder}/versions/{n}")

    # ------------------------------------------------ requests

    def _counts(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema("tab string, score long, no_phone int, miles int, n long").parquet(manifest["counts"])

    def rows(self, manifest: dict | None = None) -> DataFrame:
        """All rows of a version (the current one)."""
        manifest = manifest or self.current()
        return self.spark.read.parquet(*manifest["rows"].values())

    def counts(self) -> dict[str, int]:
        """Rows of every tab, and of every outcome of the latest call ("called:" and it)."""
        return {r["tab"]: r["n"] for r in self._counts(self.current()).groupBy("tab").agg(F.sum("n").alias("n")).collect()}  # a few tabs and outcomes

    def _bins(self, manifest: dict, tab: str) -> list[tuple[tuple[int, int, int], int]]:
        """A tab's bins in order, with their rows: as many as different scores, times two, times miles of the list's circle."""
        found = self._counts(manifest).filter(F.col("tab") == tab).orderBy(F.desc("score"), "no_phone", "miles")
        return [((r["score"], r["no_phone"], r["miles"]), r["n"]) for r in found.collect()]

    def page(self, tab: str = "all", offset: int = 0, limit: int = 100) -> DataFrame:
        """Rows offset to offset + limit - 1 of a tab, in order, with rank. Only rows of the bins that hold them are sorted."""
        manifest = self.current()
        before, wanted, first = 0, [], 0
        for key, n in self._bins(manifest, tab):
            if before + n > offset and before < offset + limit:
                first = first if wanted else before
                wanted.append(key)
            before += n
        rows = self.rows(manifest)
        if not wanted:
            return rows.limit(0).withColumn("rank", F.lit(0))
        phone = F.col("no_phone") if tab == "unchecked" else F.lit(0)
        place = lambda *values: F.struct(*(v.cast("long").alias(n) for v, n in zip(values, BIN, strict=True)))
        at, edge = place(-F.col("score"), phone, F.col("miles")), lambda k: place(F.lit(-k[0]), F.lit(k[1]), F.lit(k[2]))
        ranged = rows.filter(F.col("score").between(wanted[-1][0], wanted[0][0]) & F.array_contains("tabs", tab) & (at >= edge(wanted[0])) & (at <= edge(wanted[-1])))
        shown = ranged.orderBy(*order_of(tab)).offset(offset - first).limit(limit)
        return _numbered(shown, tab, offset)

    def rank(self, uid: str, tab: str) -> int | None:
        """A row's place in a tab, from 1."""
        manifest = self.current()
        bucket = self.spark.range(1).select(F.lit(uid).alias("uid")).select(self._bucket(manifest["buckets"]).alias("b")).first()["b"]
        path = manifest["rows"].get(str(bucket))
        own = self.spark.read.parquet(path).filter((F.col("uid") == uid) & F.array_contains("tabs", tab)).first() if path else None
        if own is None:
            return None
        key = (own["score"], own["no_phone"] if tab == "unchecked" else 0, own["miles"])
        before = 0
        for other, n in self._bins(manifest, tab):
            if (-other[0], *other[1:]) >= (-key[0], *key[1:]):
                break
            before += n
        same = (F.col("score") == key[0]) & (F.col("miles") == key[2]) & F.array_contains("tabs", tab)
        rows = self.rows(manifest).filter(same & (F.col("no_phone") == key[1]) if tab == "unchecked" else same)
        place = lambda d, n, u: F.struct(F.coalesce(d, F.lit(float("inf"))).alias("d"), F.lower(F.coalesce(n, F.lit(""))).alias("n"), u.alias("u"))
        mine = place(F.lit(own["distance_miles"]).cast("double"), F.lit(own["name"]), F.lit(uid))
        return before + rows.filter(place(F.col("distance_miles").cast("double"), F.col("name"), F.col("uid")) < mine).count() + 1


def _numbered(shown: DataFrame, tab: str, offset: int) -> DataFrame:
    from pyspark.sql.window import Window

    return shown.withColumn("rank", (F.row_number().over(Window.orderBy(*order_of(tab))) + offset).cast("long"))  # a page's rows
