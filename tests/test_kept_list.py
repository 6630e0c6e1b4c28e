"""The kept list against one made anew from all rows and the whole log after every batch."""

import random

import pytest

from plotmere.streaming.kept_list import LOG, KeptList

TABS = ["unchecked", "yes", "no", "competitors", "closed", "all", "called", "called:no answer"]


def made(rng, n, uids, at, ids):
    events, marks = [], []
    for k in range(n):
        kind = rng.choice(["mark", "mark", "call", "contact", "undo"])
        if kind == "undo" and not marks:
            kind = "mark"
        number = f"e{next(ids)}"
        uid = rng.choice(uids)
        if kind == "undo":
            number_of, uid = rng.choice(marks)
            value = number_of
        else:
            value = {"mark": rng.choice(["yes", "no"]), "call": rng.choice(["no answer", "talked"]), "contact": rng.choice(["", "801 555 0100"])}[kind]
        if kind == "mark":
            marks.append((number, uid))
        events.append((number, uid, at + k, kind, value))
    return events


def by_hand(listings, log):
    """Rows with fields, in the list's order for each tab."""
    log = list({e[0]: e for e in log}.values())
    undone = {e[4] for e in log if e[3] == "undo"}
    rows = []
    for uid, name, phone, score, miles, kind, status in listings:
        own = sorted((e for e in log if e[1] == uid and e[0] not in undone), key=lambda e: (e[2], e[0]))
        last = lambda k: next((e[4] for e in reversed(own) if e[3] == k), "")  # noqa: B023, E731
        mark, calls = last("mark"), sum(e[3] == "call" for e in own)
        tabs = ["all"] + ["called", "called:" + last("call")] * (calls > 0) + ["closed"] * (status == "CLOSED_PERMANENTLY")
        tabs += ["competitors"] if kind == "Competitor" else [mark] if mark else ["unchecked"] if status != "CLOSED_PERMANENTLY" else []
        rows.append({"uid": uid, "tabs": tabs, "phone": bool(phone.strip() or last("contact").strip()), "key": (-score, float("inf") if miles is None else miles, name.lower(), uid)})
    order = lambda tab: sorted((r for r in rows if tab in r["tabs"]), key=lambda r: (r["key"][0], tab == "unchecked" and not r["phone"], *r["key"][1:]))
    return {tab: [r["uid"] for r in order(tab)] for tab in TABS}


@pytest.fixture
def world(spark, tmp_path):
    rng = random.Random(4)
    listings = [
        (f"u{i}", rng.choice("Ab") + f" shop {i % 7}", rng.choice(["", " ", "801"]), rng.randrange(3) * 20, rng.choice([None, round(rng.random() * 5, 3)]), rng.choice(["Prospect", "Prospect", "Competitor"]), rng.choice(["", "", "CLOSED_PERMANENTLY"]))
        for i in range(60)
    ]
    state = {"log": [], "listings": listings, "ids": iter(range(10_000)), "rng": rng, "uids": [r[0] for r in listings]}
    frame = lambda: spark.createDataFrame([(*e[:2], e[2], *e[3:]) for e in state["log"]], "id string, uid string, at long, kind string, value string").selectExpr("id", "uid", "timestamp_seconds(at) at", "kind", "value")

    def figures():
        log = {e[0]: e for e in state["log"]}.values()
        undone = {e[4] for e in log if e[3] == "undo"}
        return {"mark_clicks": sum(e[3] == "mark" and e[0] not in undone for e in log), "calls": sum(e[3] == "call" for e in log), "contacts": sum(e[3] == "contact" for e in log)}

    rows = lambda: spark.createDataFrame(listings, "uid string, name string, phone string, score long, distance_miles double, lead_type string, business_status string")
    state["batch"] = lambda events: spark.createDataFrame(events, "id string, uid string, at long, kind string, value string").selectExpr("id", "uid", "timestamp_seconds(at) at", "kind", "value")
    state["list"] = lambda: KeptList(spark, str(tmp_path / "kept"), rows, frame, buckets=8, figures=figures)
    return state


def same(kept, listings, log, rng):
    expected = by_hand(listings, log)
    counts = kept.counts()
    assert {t: counts.get(t, 0) for t in TABS} == {t: len(v) for t, v in expected.items()}
    for tab in ("unchecked", "all", "called"):
        offset, limit = rng.randrange(20), rng.randrange(1, 30)
        got = [(r["uid"], r["rank"]) for r in sorted(kept.page(tab, offset, limit).collect(), key=lambda r: r["rank"])]
        assert got == [(u, offset + 1 + i) for i, u in enumerate(expected[tab][offset : offset + limit])]
    some = rng.choice(expected["unchecked"])
    assert kept.rank(some, "unchecked") == expected["unchecked"].index(some) + 1
    assert kept.rank(some, "closed") is None


def test_batches_give_what_the_whole_list_gives(spark, world):
    rng = world["rng"]
    world["log"] = made(rng, 40, world["uids"], 1000, world["ids"])
    kept = world["list"]()
    kept.build()
    same(kept, world["listings"], world["log"], rng)
    for number in range(3):
        touched = rng.sample(world["uids"], 2)
        batch = made(rng, 6, touched, 2000 + 100 * number, world["ids"])
        world["log"] += batch
        before = kept.current()
        kept = world["list"]()  # as after a restart
        after = kept.apply(world["batch"](batch + batch[:2]), number)  # some events come twice
        assert not after["built"]
        changed = {k for k in after["rows"] if after["rows"][k] != before["rows"].get(k)}
        assert 0 < len(changed) <= 2
        same(kept, world["listings"], world["log"], rng)
        assert kept.apply(world["batch"](batch), number) == after  # run again


def test_rows_that_came_otherwise_build_the_list_anew(spark, world):
    rng = world["rng"]
    world["log"] = made(rng, 20, world["uids"], 1000, world["ids"])
    kept = world["list"]()
    kept.build()
    world["log"] += [("restored", "u3", 1500, "call", "talked")]  # not in any batch
    batch = [("x1", "u5", 1600, "mark", "yes")]
    world["log"] += batch
    assert kept.apply(world["batch"](batch), 0)["built"]
    same(kept, world["listings"], world["log"], rng)
    # a click on what is not on the list changes no tally
    batch = [("x2", "gone", 1700, "call", "talked"), ("x3", None, 1700, "call", "talked")]
    world["log"] += [batch[0]]
    assert not kept.apply(world["batch"](batch), 1)["built"]
    same(kept, world["listings"], world["log"], rng)
    assert not kept.apply(world["batch"]([("x4", None, 1, "call", "")]), 2)["built"]


def test_logs_are_put_together_and_old_versions_go(spark, world, tmp_path, monkeypatch):
    from plotmere.streaming import kept_list

    monkeypatch.setattr(kept_list, "COMPACT", 3)
    kept = world["list"]()
    kept.build()
    for number in range(6):
        batch = [(f"c{number}", "u1", 3000 + number, "call", "no answer")]
        world["log"] += batch
        kept.apply(world["batch"](batch), number)
    same(kept, world["listings"], world["log"], world["rng"])
    manifest = kept.current()
    assert max(len(v) for v in manifest["log"].values()) < 3
    assert len(list((tmp_path / "kept" / "versions").glob("*.json"))) == kept_list.VERSIONS
    assert len(list((tmp_path / "kept" / "counts").iterdir())) == kept_list.VERSIONS


def test_a_stream_of_clicks(spark, world, tmp_path):
    kept = world["list"]()
    kept.build()
    batch = made(world["rng"], 12, world["uids"], 5000, world["ids"])
    for k in range(3):
        world["batch"](batch[4 * k : 4 * k + 4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "clicks"))
    world["log"] += batch
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "clicks"))
    stream.writeStream.foreachBatch(kept.sink()).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    same(kept, world["listings"], world["log"], world["rng"])
