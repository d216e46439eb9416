"""A keyed table kept by a stream: snapshot and deltas, merged now and then, with late rows and progress beside it.

Every micro-batch writes its rows as a delta and then a manifest that names it; the manifest with the highest number
is the table.  After ``merge_every`` deltas the batch also merges snapshot and deltas into a new snapshot
and switches to it with the next manifest.  A manifest appears by one rename, so readers see the table
before or after, never between; a batch that is retried after a crash finds whether its manifest exists
and either stops or overwrites what it had begun.  Readers meet one snapshot and at most ``merge_every`` deltas, whatever the
stream's age.  Files of older states stay until ``vacuum``.

Rows older than the watermark (the newest event time of earlier batches less the delay) go to a table
of late rows, null times with them; each batch leaves one row of progress.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hindcast.operators.upsert import keep_latest


class Ledger:
    """The files of one table below ``path``, in any store Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], schema: str, merge_every: int = 8):
        self.spark, self.path, self.keys, self.order, self.schema, self.merge_every = spark, path.rstrip("/"), keys, order, schema, merge_every

    def _file(self, name: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def manifest(self) -> dict:
        """The current state: number, batch, snapshot (or null), deltas and newest event time in microseconds."""
        fs, place = self._file("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        last = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        if last is None:
            return {"number": 0, "batch": -1, "snapshot": None, "deltas": [], "newest": None}
        text = self.spark.read.text(f"{self.path}/manifest/{last}", wholetext=True).first()[0]
        return json.loads(text)

    def _switch(self, state: dict) -> dict:
        state = state | {"number": state["number"] + 1}
        fs, hidden = self._file(f"manifest/.{state['number']:012d}.tmp")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, shown = self._file(f"manifest/{state['number']:012d}.json")
        if not fs.rename(hidden, shown):
            raise RuntimeError(f"manifest {state['number']} of {self.path} exists: two writers?")
        return state

    def _parts(self, state: dict) -> DataFrame:
        """Rows of snapshot and deltas with the batch they came from."""
        folders = ([state["snapshot"]] if state["snapshot"] else []) + state["deltas"]
        schema = f"{self.schema}, __batch bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def table(self) -> DataFrame:
        """Last write wins: the row of the latest batch, then of the greatest order, per key."""
        return keep_latest(self._parts(self.manifest()), self.keys, ["__batch", *self.order]).drop("__batch")

    def add(self, rows: DataFrame, batch: int, newest: int | None = None) -> None:
        """Take the rows of a micro-batch, once; merge if it is time."""
        state = self.manifest()
        if batch <= state["batch"]:
            state = state | {"deltas": state["deltas"]}
        else:
            delta = f"delta-{batch}"
            rows.withColumn("__batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/{delta}")
            state = self._switch(state | {"batch": batch, "deltas": [*state["deltas"], delta], "newest": newest if newest is not None else state["newest"]})
        if len(state["deltas"]) >= self.merge_every:
            self.merge(state)

    def merge(self, state: dict) -> None:
        snapshot = f"snapshot-{state['batch']}"
        keep_latest(self._parts(state), self.keys, ["__batch", *self.order]).write.mode("overwrite").parquet(f"{self.path}/{snapshot}")
        self._switch(state | {"snapshot": snapshot, "deltas": []})

    def vacuum(self) -> list[str]:
        """Delete the folders and manifests that the current state does not name; for times without readers of older states."""
        state = self.manifest()
        fs, root = self._file("")
        keep = {state["snapshot"], *state["deltas"]}
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(("delta-", "snapshot-")) and s.getPath().getName() not in keep]
        _, place = self._file("manifest")
        gone += [s.getPath() for s in fs.listStatus(place) if s.getPath().getName() != f"{state['number']:012d}.json"]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)


def split_late(rows: DataFrame, mark: int | None, ts: str) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows against a watermark in microseconds; rows without a time are late."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    late = micros.isNull() if mark is None else micros.isNull() | (micros < mark)
    return rows.filter(~late), rows.filter(late)


def ingest(stream: DataFrame, ledger: Ledger, ts: str, delay_seconds: int, checkpoint: str) -> StreamingQuery:
    """Keep the ledger from a stream; late rows go to ``late``, a row per batch to ``progress``, both below the ledger's path."""

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # read for the counts, the delta and the late rows
        try:
            before = ledger.manifest()
            if number > before["batch"]:
                mark = None if before["newest"] is None else before["newest"] - delay_seconds * 1_000_000
                good, late = split_late(rows, mark, ts)
                counts = rows.agg(F.count("*"), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
                late.write.mode("overwrite").parquet(f"{ledger.path}/late/batch={number}")
                line = [(counts[0], late.count(), mark, counts[1])]
                ledger.spark.createDataFrame(line, "n_rows bigint, n_late bigint, watermark bigint, newest bigint").coalesce(1).write.mode("overwrite").parquet(f"{ledger.path}/progress/batch={number}")
                newest = max((x for x in (before["newest"], counts[1]) if x is not None), default=None)
                ledger.add(good, number, newest)
            else:
                ledger.add(rows, number)  # only a merge can be left to do
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
