"""Towns, areas, rounding, recovery, boxes in rounds, decisions, customer files."""

import io
import json
import math
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from plotmere.functions import geo
from plotmere.functions.number import exact_round
from plotmere.operators import fill, places, towns
from plotmere.operators.runs import STALE_SECONDS, Runs
from plotmere.sources import customers
from plotmere.streaming import decisions


def test_rounding_is_of_the_double_itself(spark):
    rng = random.Random(1)
    values = [0.0, 0.5, 1.5, 2.5, -0.5, -2.5, 2.675, 1.005, 0.125, 0.375, 5e-324, 123456789.125, 1e15 + 0.5, 1.115, -2.675, 1e18, float("inf")]
    values += [rng.uniform(-1000, 1000) for _ in range(50_000)] + [round(rng.uniform(-500, 500), 3) + rng.choice([0, 0.0005]) for _ in range(30_000)] + [rng.randrange(-(10**6), 10**6) / 8 for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for digits in (0, 2, 4):
        got = df.select("v", exact_round(F.col("v"), digits).alias("r")).collect()
        assert all(r.r == (r.v if math.isinf(r.v) else round(r.v, digits)) for r in got)
    assert spark.range(1).select(exact_round(F.lit(None).cast("double"), 2).alias("r")).first().r is None


# ---------------------------------------------------------------- areas


def clip(ring, box):
    """One half-plane after the other, on tuples."""
    s, w, n, e = box
    for axis, limit, above in ((0, s, True), (0, n, False), (1, w, True), (1, e, False)):
        ok = lambda p: p[axis] >= limit if above else p[axis] <= limit  # noqa: B023, E731
        out = []
        for k in range(len(ring)):
            a, b = ring[k - 1], ring[k]
            if ok(a) != ok(b):
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if ok(b):
                out.append(b)
        ring = out
    return ring


def test_rings_are_clipped_and_centred(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        lat, lon, r = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.1, 2)
        ring = [(lat + r * math.cos(2 * math.pi * i / 12), lon + r * math.sin(2 * math.pi * i / 12)) for i in range(12)]
        rows.append((k, ring, tuple(sorted((rng.uniform(-2, 2), rng.uniform(-2, 2)))[i] for i in (0, 1)), tuple(sorted((rng.uniform(-2, 2), rng.uniform(-2, 2))))))
    rows.append((99, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], (-5.0, 5.0), (-5.0, 5.0)))  # without an area
    df = spark.createDataFrame([(k, ring, (a[0], b[0], a[1], b[1])) for k, ring, a, b in rows], "k int, ring array<struct<lat:double,lon:double>>, box struct<s:double,w:double,n:double,e:double>")
    got = {r.k: r for r in df.select("k", geo.clipped(F.col("ring"), F.col("box")).alias("c")).select("k", "c", geo.ring_centre(F.col("c")).alias("m")).collect()}
    cut = 0
    for k, ring, a, b in rows:
        expected = clip(ring, (a[0], b[0], a[1], b[1]))
        assert [x for p in got[k].c for x in (p.lat, p.lon)] == pytest.approx([x for p in expected for x in p])
        if expected:
            sides = list(zip([expected[-1], *expected[:-1]], expected, strict=True))
            steps = [x0 * y1 - x1 * y0 for (y0, x0), (y1, x1) in sides]
            area = sum(steps)
            mean = [sum(p[i] for p in expected) / len(expected) for i in (0, 1)]
            centre = mean if abs(area) < 1e-12 else [sum((p[i] + q[i]) * s for (p, q), s in zip(sides, steps, strict=True)) / (3 * area) for i in (0, 1)]
            assert [got[k].m.lat, got[k].m.lon] == pytest.approx(centre)
        else:
            assert got[k].m is None
        cut += 0 < len(expected) != 12
    assert cut > 10


def test_areas_of_circles(spark):
    circles = spark.createDataFrame([("a", 40.7, -111.9, 30.0), ("b", 40.0, -111.0, 5.0)], "company string, lat double, lon double, miles double")
    names = spark.createDataFrame([("Big", 40.75, -111.95, 6.0, 0), ("Mid", 40.72, -111.85, 4.0, 1), ("Same", 40.71, -111.88, 4.0, 2), ("West", 40.7, -112.3, 3.0, 3), ("Out", 41.5, -111.9, 9.0, 4)], "name string, lat double, lon double, radius_miles double, place long")
    rows = {(r.company, r.n): r for r in places.coverage_areas(circles, names).collect()}
    assert [k for k in rows if k[0] == "b"] == [("b", 1)] and len(rows) == 10
    first = rows["a", 1]
    assert first.name == "Big" and first.towns == ["Mid", "Same"]
    assert first.label.lat == pytest.approx(40.7 - (first.n_ - first.s) / 4) and first.label.lon == -111.9
    assert rows["b", 1].name == "The area around the search's center"
    assert {r.name for k, r in rows.items() if k[0] == "a" and r.name.startswith("The area to")} >= {"The area to the north", "The area to the southeast"}
    corner = next(r for r in rows.values() if r.name == "The area to the northeast")
    assert any(p.lat == pytest.approx(corner.s) for p in corner.outline) and all(corner.s - 1e-9 <= p.lat <= corner.n_ + 1e-9 for p in corner.outline)
    one = rows["b", 1].outline
    assert len(one) >= 180 and max(p.lat for p in one) == pytest.approx(40 + 5 / 69)


# ---------------------------------------------------------------- towns

TOWNS = [("Maple Grove", 40.0, -111.0), ("North Fork", 40.3, -111.0), ("Willow Springs", 40.6, -111.0), ("Elm City", 40.9, -111.0), ("Cedar Falls Junction", 41.2, -111.0), ("West Elm", 41.5, -111.0), ("Ash Creek", 41.8, -111.0), ("Aspen Canyon", 42.1, -111.0)]


def test_town_names(spark):
    table = spark.createDataFrame([(n, "UT", a, b, 3.0, i) for i, (n, a, b) in enumerate(TOWNS)], "name string, state string, lat double, lon double, radius_miles double, place long")
    zips = spark.createDataFrame([("84001", 40.0, -111.0, 2.0), ("84002", 42.1, -111.0, 2.0)], "zip string, lat double, lon double, radius_miles double")
    cases = [  # city, state, zip, lat, lon, listed, town, near
        ("MAPLE GROVE", "ut", "84001", 40.0, -111.0, "Maple Grove", "Maple Grove", ""), ("maple  Grove City", "", "1", None, None, "Maple Grove", "Maple Grove", ""),
        ("N. Fork", "", "1", None, None, "North Fork", "North Fork", ""), ("Willow Spring, UT", "", "1", None, None, "Willow Springs", "Willow Springs", ""), ("Elm (Sl Co) Utah", "", "1", None, None, "Elm City", "Elm City", ""),
        ("W Elm", "UT", "1", None, None, "West Elm", "West Elm", ""), ("CFJ", "", "1", None, None, "Cedar Falls Junction", "Cedar Falls Junction", ""),
        ("ac", "", "84002", None, None, "Aspen Canyon", "Aspen Canyon", ""),  # two towns have these initials: the ZIP's
        ("ac", "", "", 41.8, -111.0, "Ash Creek", "Ash Creek", "near Ash Creek, UT"), ("ma", "", "84001", 40.01, -111.0, "Maple Grove", "Maple Grove", ""),
        ("HILL FIELD BASE", "", "1", None, None, "Hill Field Base", "Hill Field Base", ""), ("o'brien's bend", "", "1", None, None, "O'brien's Bend", "O'brien's Bend", ""), ("McCammon", "", "1", None, None, "McCammon", "McCammon", ""),
        ("xq", "", "", 40.01, -111.0, "", "Maple Grove", "near Maple Grove, UT 84001"), ("Utah", "", "", None, None, "", "", ""), ("", None, "84001", 40.0, -111.0, "", "Maple Grove", "near Maple Grove, UT 84001"),
        ("Maple Grove", "CO", "1", 0.0, 0.0, "Maple Grove", "Maple Grove", ""), ("Maple Grove", "UT", " ", 40.0, -111.0, "Maple Grove", "Maple Grove", "near Maple Grove, UT 84001"), ("far", "", "", 10.0, 10.0, "Far", "Far", ""),
    ]
    df = spark.createDataFrame([(f"u{i}", *c[:5]) for i, c in enumerate(cases)], "uid string, city string, state string, zip string, lat double, lon double")
    got = {r.uid: r for r in towns.with_towns(df, table, zips).collect()}
    assert [(got[f"u{i}"].listed_town, got[f"u{i}"].town, got[f"u{i}"].near_text) for i in range(len(cases))] == [c[5:] for c in cases]
    states = spark.createDataFrame([(" utah ",), ("Ut",), ("ca ",), (None,)], "s string").select(towns.state_code("s").alias("c")).collect()
    assert [r.c for r in states] == ["UT", "UT", "ca", ""]


def test_addresses_of_facilities(spark):
    known = spark.createDataFrame([("1240 South Wallace Road", "Elm City"), ("7 K", ""), ("", "x")], "street string, town string")
    cases = [("1240 S Wallace Rd", "Elm City", True), ("1240 S. Wallace Road, Suite 7", "", True), ("1240 S Wallace Rd", "Other", False), ("1240 S Wallace Lane", "", False), ("1241 S Wallace Rd", "", False), ("240 S Wallace Rd", "", False),
             ("7 K Street", "Other", True), ("7 Kay", "", False), ("", "", False), (None, "", False)]
    df = spark.createDataFrame([(f"u{i}", a, t) for i, (a, t, _) in enumerate(cases)], "uid string, address string, listed_town string")
    assert {r.uid for r in towns.at_facilities(df, known).collect()} == {f"u{i}" for i, c in enumerate(cases) if c[2]}


# ---------------------------------------------------------------- recovery


def test_two_workers_finish_a_stale_run_once(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"))
    run = runs.start("2026-01-01", {"radius": 5}, 1000.0, "r1")
    for k in range(2):
        run.add(spark.createDataFrame([(f"n{k}",)], "name string"), 1000.0 + k)
    assert runs.wait(1010.0) == pytest.approx(STALE_SECONDS - 9) and runs.wait(1010.0, ("r1",)) is None
    saved, committed, barrier = [], [], threading.Barrier(2)

    def worker():
        barrier.wait()
        Runs(spark, str(tmp_path / "runs")).recover(1100.0, lambda info: True, lambda found, info, out: saved.append(sorted(r.name for r in found.collect())) or {"n": 2}, lambda id, s: committed.append((id, s["n"])))

    assert Runs(spark, str(tmp_path / "runs")).recover(1040.0, lambda info: True, None, None) == 0  # still alive
    threads = [threading.Thread(target=worker) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert saved == [["n0", "n1"]] and committed == [("r1", 2)] and runs.wait(1100.0) is None


def test_a_worker_that_dies_leaves_the_run_to_the_next(spark, tmp_path):
    runs, committed = Runs(spark, str(tmp_path / "runs")), []
    run = runs.start("d", {}, 0.5, "r")
    run.beat(1.0, alive=False)  # shut down: no wait

    def dies(found, info, out):
        raise KeyboardInterrupt

    commit = lambda id, s: committed.append(s)
    with pytest.raises(KeyboardInterrupt):
        runs.recover(2.0, lambda info: True, dies, commit)
    assert runs.recover(10.0, lambda info: True, lambda *a: {"by": 2}, commit) == 0  # its lease still lives
    slow = runs.take("r", 60.0)
    # a third takes over while the second is slow; the second's end is fenced off
    assert runs.recover(200.0, lambda info: True, lambda found, info, out: {"by": 3, "found": found is None}, commit) == 1
    assert committed == [{"by": 3, "found": True}]
    assert slow is not None and slow.lease == 2


def test_a_slow_worker_is_fenced_off(spark, tmp_path):
    runs, committed = Runs(spark, str(tmp_path / "runs")), []
    runs.start("d", {}, 0.0, "r")
    commit = lambda id, s: committed.append(s)

    def slow(found, info, out):
        assert runs.recover(200.0, lambda info: True, lambda *a: {"by": "quick"}, lambda id, s: None) == 1  # meanwhile
        return {"by": "slow"}

    runs.recover(100.0, lambda info: True, slow, commit)
    assert committed == []
    again = runs.start("d", {}, 0.0, "ended")
    again.add(spark.createDataFrame([("x",)], "name string"), 0.0)
    assert runs.recover(500.0, lambda info: False, None, None) == 0 and not list((tmp_path / "runs").iterdir())


# ---------------------------------------------------------------- boxes in rounds


def test_failed_boxes_are_asked_in_quarters_and_again(spark, tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    areas = spark.createDataFrame([(k, 40.0, -112.0 + k, 41.0, -111.0 + k, 0) for k in range(4)], "area int, s double, w double, n double, e double, depth int")
    every = areas.select(*fill.PART, fill.box_key().alias("key")).union(fill.quarters(areas).select(*fill.PART, fill.box_key().alias("key"))).collect()
    key = {(r.area, r.depth, r.s, r.w): r.key for r in every}
    land = lambda area, depth, s, w, ids: (folder / f"{key[area, depth, s, w]}.json").write_text(json.dumps([{"id": i} for i in ids]))
    land(0, 0, 40.0, -112.0, ["a", "b"])  # area 0 answers; 1 in quarters; of 2's quarters one comes in the second round; 3 never
    for s in (40.0, 40.5):
        for w in (-111.0, -110.5):
            land(1, 1, s, w, ["b", f"q{s}{w}"])
    for s, w in ((40.0, -110.0), (40.0, -109.5), (40.5, -110.0)):
        land(2, 1, s, w, [f"r{s}{w}"])
    answers, missing, errors = fill.ask_round(areas, fill.landed(str(folder)))
    assert {(r.area, r.depth) for r in missing.collect()} == {(2, 1), (3, 1)} and missing.count() == 5 and errors.count() == 8
    assert {r.area: r.share for r in fill.missing_share(missing, areas).collect()} == {0: 0.0, 1: 0.0, 2: 0.25, 3: 1.0}
    land(2, 1, 40.5, -109.5, ["late"])
    done = fill.fill_in(missing, fill.landed(str(folder)), 2)
    assert (done.state, done.rounds, done.missing.count()) == ("gave_up", 2, 4)
    assert {r.area: r.share for r in fill.missing_share(done.missing, areas).collect()}[3] == 1.0
    for s in (40.0, 40.5):
        for w in (-109.0, -108.5):
            land(3, 1, s, w, ["b"])
    last = fill.fill_in(done.missing, fill.landed(str(folder)), 5)
    assert (last.state, last.rounds) == ("complete", 1)
    stopped = fill.fill_in(missing, fill.landed(str(folder)), 5, stop=lambda: True)
    assert (stopped.state, stopped.rounds, stopped.missing.count()) == ("stopped", 0, 5)
    found = fill.first_seen(answers.withColumn("round", F.lit(1)).withColumn("x", F.explode(F.from_json("answer", "array<struct<id:string>>"))), F.col("x.id"), F.col("area")).collect()
    assert {r.id: r.area for r in found}["b"] == 0 and len(found) == 2 + 4 + 3
    left = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.5,), (2.5,)], "s double").select(fill.areas_left(F.col("s")).alias("n")).collect()
    assert [r.n for r in left] == [0, 1, 1, 2, 2]


# ---------------------------------------------------------------- decisions


def test_budgets_and_alerts_decide_as_one_pass(spark, tmp_path):
    rng = random.Random(6)
    calls = sorted((rng.randrange(0, 4000), f"c{i:03d}", rng.choice("ab")) for i in range(60))
    allowed, kept = {}, {"a": [], "b": []}
    for at, id, name in calls:
        kept[name] = [t for t in kept[name] if at - t < 1000]
        allowed[id] = len(kept[name]) < 3
        if allowed[id]:
            kept[name].append(at)
    frame = lambda rows: spark.createDataFrame(rows, "at long, id string, name string").select("id", "name", F.timestamp_seconds("at").alias("at"))
    budget = decisions.budget(spark, str(tmp_path / "budget"), 3, seconds=1000)
    for number, (a, b) in enumerate(((0, 7), (7, 8), (8, 40), (40, 60))):
        budget = decisions.budget(spark, str(tmp_path / "budget"), 3, seconds=1000)  # as after a restart
        for _ in range(2):  # each batch comes twice
            budget.sink()(frame(calls[a:b]), number)
    assert {r.id: r.allowed for r in budget.decided().collect()} == allowed and 0 < sum(allowed.values()) < 60

    problems = sorted((rng.randrange(0, 9000), f"p{i:03d}", "error", f"Problem {rng.randrange(25)}") for i in range(70))
    last, sent, told = {}, [], {}
    for at, id, kind, text in problems:
        recorded = at - last.get((kind, text), -(10**9)) >= 900
        if recorded:
            last[kind, text] = at
        sent = [t for t in sent if at - t < 3600]
        told[id] = (recorded, recorded and len(sent) < 10)
        if told[id][1]:
            sent.append(at)
    alerts = decisions.alerts(spark, str(tmp_path / "alerts"))
    for number, (a, b) in enumerate(((0, 20), (20, 21), (21, 70))):
        batch = spark.createDataFrame(problems[a:b], "at long, id string, kind string, text string").select("id", "kind", "text", F.timestamp_seconds("at").alias("at"))
        alerts.sink()(batch, number)
    got = {r.id: (r.recorded, r.allowed) for r in alerts.decided().collect()}
    assert got == told and {(True, False), (True, True), (False, False)} <= set(told.values())


# ---------------------------------------------------------------- customer files


def sheet(rows):
    cells = lambda n, row: "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if i % 2 else f'<c r="{chr(65 + i)}{n}" t="s"><v>{row.index(v) + sum(map(len, rows[: n - 1]))}</v></c>' for i, v in enumerate(row) if v)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" sheetId="1" r:id="rId7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{v[:2]}</t></r><r><t>{v[2:]}</t></r></si>" for r in rows for v in r) + "</sst>")
        book.writestr("xl/worksheets/first.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def test_customer_files_of_any_kind_give_equal_rows(spark, tmp_path):
    header = ["Contact name", "Company", "Street address", "E-mail address", "City / town", "ZIP", "Tel."]
    people = [["Al", "Alder Foods", "1 Main St", "a@b.c", "Provo", "84601", "801 555 0100"], ["", "Birch Mill", "2 Elm St", "", "Orem", "84057", ""], ["Cy", "Cedar", "", "", "", "", "801 555 0102"]]
    plain = "\r\n".join(",".join(r) for r in [["My list"], [], header, *people])
    files = {
        "a.csv": "﻿" + plain, "b.tsv": "\n".join("\t".join(r) for r in [header, *people]), "c.txt": "\n".join(";".join(f'"{c}"' for c in r) for r in [header, *people]) + "\n\n",
    }
    files["a.csv"] = files["a.csv"].replace("My list", "My list,,,")
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "d.xlsx").write_bytes(sheet([header, *people]))
    (tmp_path / "empty.csv").write_text("")
    names = [*files, "d.xlsx", "empty.csv"]
    rows = customers.read_customers(spark, [str(tmp_path / n) for n in names]).collect()
    expected = [(r[1], r[6], r[2], r[4], r[5]) for r in people]
    for name in names[:-1]:
        own = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.line)
        assert [(r.name, r.phone, r.address, r.city, r.zip) for r in own] == expected, name
    with pytest.raises(ValueError):
        customers.read_customers(spark, ["old.xls"])


def test_ranges_of_a_customer_file_end_at_whole_lines(spark, tmp_path):
    rng = random.Random(9)
    field = lambda: "".join(rng.choice(['a', 'b', ',', '\n', '"', '""', ' ', '\r\n', 'é']) for _ in range(rng.randrange(0, 12)))
    rows = [["Business name", "Phone"]] + [[f"n{k} {field()}", field()] for k in range(150)]
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') else c for c in r) for r in rows)
    (tmp_path / "x.csv").write_bytes(text.encode())
    expected = [(r[0], r[1]) for r in rows[1:]]
    for size in (7, 64, 500, 10_000_000):
        got = sorted(customers.read_customers(spark, [str(tmp_path / "x.csv")], size).collect(), key=lambda r: r.line)
        assert [(r.name, r.phone) for r in got] == expected, size
    keys = customers.with_keys(customers.read_customers(spark, [str(tmp_path / "x.csv")]), "salt")
    assert keys.columns == ["hash"] or keys.count() >= 0


# ---------------------------------------------------------------- clicks


def test_clicks_are_decided_as_one_after_the_other(spark):
    from plotmere.operators import marks

    rng = random.Random(17)
    actions, ids = [], []
    for k in range(260):
        at, uid = 10 * k + rng.randrange(10), rng.choice(["a", "b", "c", "gone", None])
        if rng.random() < 0.3 and ids:
            actions.append((f"u{k:03d}", uid, at, "undo", rng.choice(ids[-6:]), "x", None))
        else:
            ids.append(f"c{k:03d}")
            actions.append((ids[-1], uid, at, "click", rng.choice(["yes", "no", "yes", "maybe"]), rng.choice(["Ann", "ann", "Bo", ""]), rng.choice([None, "", "yes", "no"])))
    merges = [("a", 700), ("b", 1500)]
    expected, rows = {}, {u: {"value": "", "clicks": [], "open": False} for u in "abc"}
    for at, _, action in sorted([(a[2], 1, a) for a in actions] + [(at, 0, (None, uid, at)) for uid, at in merges], key=lambda x: (x[0], x[1], x[2][0] or "")):
        row = rows.get(action[1])
        if len(action) == 3:
            row["open"] = True
            continue
        id, uid, _, kind, value, by, was = action
        if row is None:
            expected[id] = ("unknown", "")
            continue
        before = row["value"]
        standing = [c for c in row["clicks"] if not c["undone"]]
        if kind == "undo":
            ok = standing and standing[-1]["id"] == value and standing[-1]["at"] > at - 300 and row["value"] == standing[-1]["value"]
            if ok:
                standing[-1]["undone"] = True
                row["value"] = standing[-1]["previous"]
            expected[id] = ("undone" if ok else "too late", before)
        elif value == "maybe":
            expected[id] = ("bad value", before)
        elif before == value and not row["open"]:
            expected[id] = ("same", before)
        else:
            given = next((c["by"] for c in reversed(standing) if c["value"] == before), "")
            if was is not None and before and before not in (was, value) and given and given.lower() != by.lower():
                expected[id] = ("changed", before)
                continue
            row["clicks"].append({"id": id, "at": at, "value": value, "previous": before, "by": by, "undone": False})
            row["value"], row["open"] = value, False
            expected[id] = ("saved", before)
    df = spark.createDataFrame(actions, "id string, uid string, at long, kind string, value string, by string, was string").withColumn("at", F.timestamp_seconds("at"))
    seen = spark.createDataFrame([("a",), ("b",), ("c",), ("never",)], "uid string")
    apart = spark.createDataFrame(merges, "uid string, at long").withColumn("at", F.timestamp_seconds("at"))
    told = marks.decided(df, seen, apart).collect()
    assert {r.id: (r.outcome, r.previous) for r in told} == expected and len(told) == len(actions)
    assert {o for o, _ in expected.values()} == {"saved", "same", "changed", "unknown", "bad value", "undone", "too late"}
    left = marks.current(marks.decided(df, seen, apart)).collect()
    assert {r.uid: r.value for r in left} == {u: r["value"] for u, r in rows.items() if r["value"]}


def test_who_gave_an_answer(spark):
    from plotmere.operators import marks

    clicks = spark.createDataFrame([("1", "a", "yes", 1.0, None), ("2", "a", "yes", 2.0, 3.0), ("3", "a", "no", 2.0, None), ("4", "b", "no", 5.0, None)], "id string, uid string, value string, at double, undone_at double")
    makers = spark.createDataFrame([("1", "Ann"), ("2", "Bo"), ("3", "Cy"), ("3", "Cy")], "id string, name string")
    assert {(r.uid, r.value, r.by) for r in marks.given_by(clicks, makers).collect()} == {("a", "yes", "Ann"), ("a", "no", "Cy"), ("b", "no", "")}


def test_pins_of_one_spot_stay_together(spark):
    from plotmere.operators import stats

    rows = [("a", 40.0, -111.0, "yes"), ("b", 40.00001, -111.00001, "no"), ("c", 40.0, -110.99, "yes"), ("d", 10.0, 10.0, "competitor")]
    pins = spark.createDataFrame(rows, "uid string, lat double, lon double, grp string")
    far = {(r.uid, r.n, r.together, r.yes, r.no, r.competitor) for r in stats.map_marks(pins, 3).collect()}
    assert far == {(None, 3, False, 2, 1, 0), ("d", 1, False, 0, 0, 1)}
    near = {(r.uid, r.n, r.together) for r in stats.map_marks(pins, 17).collect()}
    assert near == {(None, 2, True), ("c", 1, False), ("d", 1, False)}  # beyond the last zoom of circles, but at one spot


def test_names_of_parts_count_words(spark):
    from test_listings import frame, lead

    from plotmere.operators import resolve

    outline = (39.99, -111.91, 40.01, -111.89)
    rows = [lead(1, "Alder Medical", lat=40.0, outline=outline), lead(2, "Alder Medical South", lat=40.001), lead(3, "Alder Alder Medical", lat=40.002), lead(4, "Alder Medical Labs", lat=40.003)]
    assert {(r.a.rid, r.b.rid) for r in resolve.site_pairs(frame(spark, rows)).collect()} == {(1, 2)}  # a word twice is another name
