"""Running searches in a shared folder, finished by another worker when theirs is gone.

A run's folder holds info.json, its batches of found listings (Parquet folders, each named by a small file once it is
whole), signs of life, leases and done.json. Small files are made once, by whoever comes first (shared.publish), so of
several workers that find a run stale one gets the next lease, whose number fences off those before: what a run found is
written to the lease's own folder, and only the first done.json, which names that folder, counts.

A worker that dies halfway leaves a lease that goes stale in its turn. One that dies after done.json leaves a run that is
only committed again and tidied; commit gets the run's id, so it can be made idempotent by it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plotmere.operators.shared import names_in, publish, read_file, removed

#: Seconds without a sign of life after which a run has lost its worker.
STALE_SECONDS = 45.0


class Run:
    """A worker's hold on a run: the run's own (lease 0) or one that was taken over."""

    def __init__(self, runs: Runs, id: str, lease: int):
        self.runs, self.id, self.lease, self._n = runs, id, lease, 0
        self.folder = f"{runs.folder}/{id}"

    def _note(self, what: str, body: dict[str, Any]) -> None:
        self._n += 1
        publish(self.runs.spark, f"{self.folder}/{what}/{self.lease:06d}-{self._n:08d}.json", json.dumps(body))

    def beat(self, now: float, alive: bool = True) -> None:
        """A sign of life; with alive false, that the worker is shutting down."""
        self._note("alive", {"at": now if alive else 0.0})

    def add(self, listings: DataFrame, now: float) -> None:
        """What a source returned: readers see a batch once all of it is written."""
        place = f"{self.folder}/found/{uuid.uuid4().hex}"
        listings.write.parquet(place)
        self._note("batches", {"at": now, "place": place})
        self.beat(now)

    def end(self) -> None:
        """The search ended and saved what it found itself."""
        removed(self.runs.spark, self.folder)


class Runs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def start(self, day: str, info: dict[str, Any], now: float, id: str | None = None) -> Run:
        run = Run(self, id or uuid.uuid4().hex, 0)
        publish(self.spark, f"{run.folder}/info.json", json.dumps(info | {"day": day, "started": now}))
        run.beat(now)
        return run

    def _all(self, id: str, what: str) -> list[dict[str, Any]]:
        folder = f"{self.folder}/{id}/{what}"
        return [json.loads(read_file(self.spark, f"{folder}/{n}")) | {"file": n} for n in names_in(self.spark, folder) if n.endswith(".json") and n.count(".") == 1]

    def alive(self, id: str) -> float:
        """When the run's last holder was alive (0: it shut down)."""
        beats = self._all(id, "alive")
        return float(beats[-1]["at"]) if beats else 0.0

    def stale(self, id: str, now: float) -> bool:
        at = self.alive(id)
        return at <= 0 or now - at > STALE_SECONDS

    def wait(self, now: float, own: tuple[str, ...] = ()) -> float | None:
        """Seconds until the last run of another worker can be finished; None where there is none."""
        waits = [0.0 if (at := self.alive(id)) <= 0 else max(0.0, at + STALE_SECONDS - now) for id in names_in(self.spark, self.folder) if id not in own]
        return max(waits) if waits else None

    def take(self, id: str, now: float) -> Run | None:
        """The next lease of a stale run, or None where another worker got it."""
        leases = self._all(id, "leases")
        lease = int(leases[-1]["file"][:6]) + 1 if leases else 1
        if not publish(self.spark, f"{self.folder}/{id}/leases/{lease:06d}.json", json.dumps({"at": now})):
            return None
        run = Run(self, id, lease)
        run.beat(now)
        return run

    def recover(
        self, now: float, unfinished: Callable[[dict[str, Any]], bool], save: Callable[[DataFrame | None, dict[str, Any], str], dict[str, Any]],
        commit: Callable[[str, dict[str, Any]], None], own: tuple[str, ...] = (),
    ) -> int:
        """Finish the runs whose worker is gone; how many.

        unfinished tells by a run's info whether its day is still waiting for it. save gets what was found (None: nothing), the
        info and a folder of its own to write to, and returns a summary; commit gets the run's id and the summary that counts.
        """
        done = 0
        for id in names_in(self.spark, self.folder):
            if id in own or not self.stale(id, now):
                continue
            run = self.take(id, now)
            if run is not None:
                done += self._finish(run, unfinished, save, commit)
        return done

    def _finish(self, run: Run, unfinished, save, commit) -> int:
        info = json.loads(read_file(self.spark, f"{run.folder}/info.json"))
        if "done.json" not in names_in(self.spark, run.folder):
            if not unfinished(info):  # it had ended just before its worker did
                run.end()
                return 0
            places = [b["place"] for b in sorted(self._all(run.id, "batches"), key=lambda b: (b["at"], b["file"]))]
            found = None
            for place in places:  # in the order in which they came; batches may differ in their columns
                part = self.spark.read.parquet(place)
                found = part if found is None else found.unionByName(part, allowMissingColumns=True)
            summary = save(found, info, f"{run.folder}/out-{run.lease:06d}")
            if "info.json" not in names_in(self.spark, run.folder):  # a later lease has finished and tidied the run
                run.end()
                return 0
            if not publish(self.spark, f"{run.folder}/done.json", json.dumps({"lease": run.lease, "summary": summary})):
                return 0  # fenced off: a later lease was quicker
        commit(run.id, json.loads(read_file(self.spark, f"{run.folder}/done.json"))["summary"])
        run.end()
        return 1
