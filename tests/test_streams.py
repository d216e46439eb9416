"""Stateful families against the batch operator, and a ledger that is stopped in the middle of a merge."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hindcast.operators import intervals
from hindcast.streaming import families, ledger

T0 = datetime(2024, 1, 1)
FAMILIES = {
    "state": (["a", "b"], ["a", "b"]),
    "membership": (["add"], ["remove"]),
    "comment": (["created", "edited"], ["edited", "deleted"]),
}


@pytest.mark.parametrize("family", FAMILIES)
def test_families_equal_the_batch(spark, tmp_path, family):
    opens, closes = FAMILIES[family]
    dice = random.Random(family)
    kinds = sorted({*opens, *closes, "other"})
    rows = [(dice.choice([1, 1, 1, 2, 3]), dice.choice([None, 7, 8]), i, T0 + timedelta(hours=dice.randint(0, 300)), dice.choice(kinds)) for i in range(150)]
    rows.append((9, None, 999, T0 + timedelta(days=60), "other"))
    rows += [(9, 9, 1000, T0 + timedelta(days=60), k) for k in opens[:1]]  # moves the watermark past all others
    schema = "subject_id long, object_id long, event_id long, ts timestamp, kind string"
    rows.sort(key=lambda r: r[3] + timedelta(hours=dice.randint(0, 20)))  # out of order by less than the delay
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    is_open, is_close = F.col("kind").isin(opens), F.col("kind").isin(closes)
    found = families.closed_intervals(families.keyed(stream, is_open, is_close, F.col("kind"), F.col("object_id")), "1 day")
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    names = ["subject_id", "object_id", "value", "start_id", "end_id", "start_ts", "end_ts"]
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(names).collect()), key=str)
    batch = intervals.build_intervals(spark.createDataFrame(rows, schema), ["subject_id", "object_id"], is_open, is_close, {"value": F.col("kind")}, ts="ts")
    want = batch.filter("end_ts is not null").selectExpr("subject_id", "object_id", "value", "start_event_id", "end_event_id", "start_ts", "end_ts").collect()
    want = sorted((tuple(r) for r in want), key=str)
    assert sorted(set(got) - set(want), key=str) == sorted(set(want) - set(got), key=str) == []
    assert got == want and got


def _batches(spark, folder, n=7):
    rows = [(k, i * 10 + k, T0 + timedelta(hours=i) - timedelta(days=2 * (k == 4 and i > 0))) for i in range(n) for k in range(i % 3, 5)] + [(9, 999, None)]
    for i in range(n):
        own = [r for r in rows if r[1] // 10 == i or (i == n - 1 and r[1] == 999)]
        spark.createDataFrame(own, "k long, v long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return rows, spark.readStream.schema("k long, v long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_ledger_survives_a_crash_in_a_merge(spark, tmp_path, monkeypatch):
    rows, stream = _batches(spark, tmp_path)
    own = ledger.Ledger(spark, str(tmp_path / "table"), ["k"], ["v"], "k long, v long, ts timestamp", merge_every=3)
    assert own.table().count() == 0
    switch, crashes = ledger.Ledger._switch, []

    def failing(self, state):
        if state["snapshot"] and not state["deltas"] and len(crashes) < 2:
            crashes.append(state["snapshot"])
            raise RuntimeError("executor lost")  # after the snapshot is written, before it is named
        return switch(self, state)

    monkeypatch.setattr(ledger.Ledger, "_switch", failing)
    for _ in range(3):
        try:
            ledger.ingest(stream, own, "ts", 3600, str(tmp_path / "state")).awaitTermination()
        except Exception as exc:
            assert "executor lost" in str(exc)
            assert len(own.manifest()["deltas"]) == 3  # readers still see the state before the merge
            own.table().collect()
    assert len(crashes) == 2
    newest, want, late = None, {}, 0
    for i in range(7):
        own_rows = [r for r in rows if r[1] // 10 == i or (i == 6 and r[1] == 999)]
        for k, v, at in sorted(own_rows, key=lambda r: r[1]):
            if at is None or (newest and at < newest - timedelta(hours=1)):
                late += 1
            else:
                want[k] = v
        newest = max([x for x in [newest, *[r[2] for r in own_rows]] if x])
    assert {r["k"]: r["v"] for r in own.table().collect()} == want
    assert spark.read.parquet(f"{own.path}/late").count() == late == sum(r["n_late"] for r in spark.read.parquet(f"{own.path}/progress").collect())
    state = own.manifest()
    assert state["batch"] == 6 and len(state["deltas"]) < 3 and own.vacuum()
    assert {r["k"]: r["v"] for r in own.table().collect()} == want and own.manifest() == state
    own.add(spark.createDataFrame([(0, -1, T0)], "k long, v long, ts timestamp"), 6)  # a batch that was taken already
    assert {r["k"]: r["v"] for r in own.table().collect()} == want


def test_state_of_a_key_is_touched_once_per_trigger():
    """F31, F32: timers and state calls do not grow with the events of a key."""
    calls = []

    class Listed(list):
        def get(self):
            return iter(list(self))

        def appendList(self, rows):
            calls.append("append")
            self.extend(rows)

    class Handle:
        def getListState(self, name, schema):
            return Listed()

        def registerTimer(self, at):
            calls.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 60

    machine = families.Families()
    machine.init(Handle())
    events = [Row(micros=i * 1000, event_id=i, opens=i % 4 != 3, closes=i % 4 == 3, value=None if i % 2 else "v") for i in range(99, -1, -1)]
    assert list(machine.handleInputRows((1, ""), iter(events), Times())) == []
    assert calls == ["append", 1]
    found = list(machine.handleExpiredTimer((1, ""), Times(), None))
    assert [(r.start_id, r.end_id) for r in found] == [(i, i - i % 4 + 3) for i in range(60) if i % 4 != 3]
    assert calls == ["append", 1, "append", 61]  # what waits goes back at once, behind one timer
    assert len(machine.waiting) == 40 and not machine.open
    assert list(machine.handleExpiredTimer((1, ""), Times(), None)) == []
