"""Streaming queries: each runs its stream to the end of the input and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.catalog.common import sql_ts, ts
from hindcast.catalog.registry import query
from hindcast.operators.normalize import normalize_timeline
from hindcast.session import scratch_folder
from hindcast.sources.binding import ACTED_AT, CREATED_AT, DriverTables
from hindcast.streaming import families, ingest, intervals, ledger, windows


def _stream(t: DriverTables, name: str) -> DataFrame:
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def _folder(t: DriverTables) -> str:
    return f"{scratch_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _drain(t: DriverTables, stream: DataFrame) -> DataFrame:
    """Run an append stream over everything that is there and read its sink."""
    folder = _folder(t)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_dedup", "select event_type, user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as occurred_at from events group by all")
def stream_dedup(t: DriverTables) -> DataFrame:
    events = _stream(t, "events").select(
        F.date_trunc("MINUTE", "ts").cast("timestamp").alias("occurred_at"), "event_type", F.lit("user").alias("subject_type"), F.col("user_id").alias("subject_id"),
        F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("bigint").alias("object_id"), F.lit(None).cast("string").alias("commit_sha"))
    return _drain(t, ingest.deduplicate(events, "1 hour")).select("event_type", F.col("subject_id").alias("user_id"), ts("occurred_at"))


@query("stream_upsert", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) where rn = 1")
def stream_upsert(t: DriverTables) -> DataFrame:
    folder = _folder(t)
    ingest.upsert_log(_stream(t, "events").select("user_id", "event_type", "event_id"), f"{folder}/log", f"{folder}/state").awaitTermination()
    return ingest.latest(t.spark, f"{folder}/log", ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("stream_intervals", """select user_id as subject_id, state, start_id, end_id from (select user_id, case event_type when 'signup' then 'open' else 'closed' end as state, event_id as start_id,
    lead(event_id) over (partition by user_id order by ts, event_id) as end_id from events where event_type in ('signup', 'error')) where end_id is not null""")
def stream_intervals(t: DriverTables) -> DataFrame:
    events = _stream(t, "events").filter("event_type in ('signup', 'error')").select(
        F.col("user_id").alias("subject_id"), F.when(F.col("event_type") == "signup", "open").otherwise("closed").alias("state"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drain(t, intervals.state_intervals(events)).select("subject_id", "state", "start_id", "end_id")


@query("stream_window_counts", """select event_type, strftime(d - interval '7' day, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n from events e join (select unnest(generate_series(timestamp '2023-12-20', timestamp '2024-02-15', interval '1' day)) as d) w
    on e.ts < w.d and e.ts >= w.d - interval '7' day where d <= (select max(ts) - interval '1' day from events) group by event_type, d""")
def stream_window_counts(t: DriverTables) -> DataFrame:
    events = _stream(t, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _drain(t, windows.trailing_counts(events, ["event_type"], "ts")).select("event_type", ts("window_start"), "n")


@query("stream_day_counts", """with d as (select event_type, user_id % 50 as grp, cast(ts as date) as day, count(*) as n from events
    where date_trunc('day', ts) + interval '1' day <= (select date_trunc('millisecond', max(ts)) - interval '1' day from events) group by all),
    c as (select distinct event_type, grp, cast(day + w.w as date) as day from d, (values (0), (30), (90), (180)) w(w))
    select event_type, grp, strftime(c.day, '%Y-%m-%d') as day, cast(coalesce(sum(d.n) filter (d.day > c.day - 30), 0) as bigint) as n_30,
    cast(coalesce(sum(d.n) filter (d.day > c.day - 90), 0) as bigint) as n_90, cast(coalesce(sum(d.n) filter (d.day > c.day - 180), 0) as bigint) as n_180
    from c left join d using (event_type, grp) where d.day <= c.day group by event_type, grp, c.day""")
def stream_day_counts(t: DriverTables) -> DataFrame:
    """Counts of 30, 90 and 180 days from the day totals of a stream."""
    events = _stream(t, "events").select("event_type", (F.col("user_id") % 50).alias("grp"), F.col("ts").cast("timestamp").alias("ts"))
    days = _drain(t, windows.day_totals(events, ["event_type", "grp"], "ts"))
    counts = windows.counts_from_days(days, ["event_type", "grp"], [30, 90, 180])
    return counts.select("event_type", "grp", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_30", "n_90", "n_180")


@query("stream_first_response", f"""select pr_id, {sql_ts('min(submitted_at)')} as first_response from (select o_orderkey as pr_id, {CREATED_AT} as created_at from orders) p
    join (select l_orderkey as pr_id, {ACTED_AT} as submitted_at from lineitem where l_linenumber <= 4) r using (pr_id) where submitted_at > created_at and submitted_at <= created_at + interval '60' day group by pr_id""")
def stream_first_response(t: DriverTables) -> DataFrame:
    prs = _stream(t, "orders").selectExpr("o_orderkey as pr_id", "o_custkey * 2 as author_id", f"cast({CREATED_AT} as timestamp) as created_at")
    reviews = _stream(t, "lineitem").filter("l_linenumber <= 4").selectExpr(
        "l_orderkey as pr_id", "l_suppkey * 2 + 1 as user_id", f"cast({ACTED_AT} as timestamp) as submitted_at")
    found = _drain(t, windows.responses_in_window(prs, reviews))
    return found.groupBy("pr_id").agg(F.date_format(F.min("submitted_at"), "yyyy-MM-dd HH:mm:ss").alias("first_response"))


@query("stream_normalize", "select event_type as kind, count(*) as n from events group by 1")
def stream_normalize(t: DriverTables) -> DataFrame:
    """Normalisation is row-local, so the batch operator runs on a stream as it is."""
    rows = _stream(t, "events").selectExpr(
        "event_id", "user_id % 5 as repo_id", "user_id as issue_id", "cast(null as bigint) as pull_request_id",
        """to_json(named_struct('event', event_type, 'created_at', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))) as payload""")
    out = _drain(t, normalize_timeline(rows).select("event_id", "event_type"))
    return out.groupBy(F.regexp_replace("event_type", "^issue[.]event[.]", "").alias("kind")).agg(F.count("*").alias("n"))


# --- families as state machines ---------------------------------------------------------
_OBJECT = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 3"


def _family_sql(opens: str, closes: str, key: str) -> str:
    """Closed intervals whose end lies before the last watermark."""
    return f"""with e as (select *, {key} as object_id, {opens} as o, {closes} as c from events where {opens} or {closes}),
        mark as (select date_trunc('millisecond', max(ts)) - interval '1' day as m from e),
        ends as (select a.event_id, arg_min(b.event_id, (b.ts, b.event_id)) as end_id, min(b.ts) as end_ts from e a join e b on b.c and b.user_id = a.user_id
            and b.object_id is not distinct from a.object_id and (b.ts > a.ts or (b.ts = a.ts and b.event_id > a.event_id)) where a.o group by 1)
        select a.user_id as subject_id, a.object_id, a.event_type as value, a.event_id as start_id, n.end_id, {sql_ts('a.ts')} as start_ts, {sql_ts('n.end_ts')} as end_ts
        from ends n join e a using (event_id), mark where n.end_ts < mark.m"""


def _family(t: DriverTables, opens: str, closes: str, key: str | None) -> DataFrame:
    events = _stream(t, "events").withColumnRenamed("user_id", "subject_id")
    rows = families.keyed(events, F.expr(opens), F.expr(closes), F.col("event_type"), F.expr(key) if key else None)
    return _drain(t, families.closed_intervals(rows)).select("subject_id", "object_id", "value", "start_id", "end_id", ts("start_ts"), ts("end_ts"))


_ADDS, _REMOVES = "event_type in ('click', 'view')", "event_type = 'error'"


@query("stream_memberships", _family_sql(_ADDS, _REMOVES, _OBJECT))
def stream_memberships(t: DriverTables) -> DataFrame:
    """Adds open, a removal closes all that its subject and object have open."""
    return _family(t, _ADDS, _REMOVES, _OBJECT)


_SHOWN, _HIDDEN = "event_type in ('signup', 'view')", "event_type in ('view', 'error')"


@query("stream_comments", _family_sql(_SHOWN, _HIDDEN, "null::bigint"))
def stream_comments(t: DriverTables) -> DataFrame:
    """Created and edited texts open, edits and deletions close."""
    return _family(t, _SHOWN, _HIDDEN, None)


# --- a merged table with late rows --------------------------------------------------------
SLICES = 5
_LEDGER_SQL = f"""with s as (select *, least(event_id * {SLICES} // (select max(event_id) + 1 from events) + (event_id % 7 = 0)::int, {SLICES - 1}) as batch from events),
    newest as (select batch, max(max(ts)) over (order by batch rows between unbounded preceding and 1 preceding) as newest from s group by batch),
    r as (select s.*, coalesce(ts < newest - interval '1' hour, false) as late from s join newest using (batch))"""


def _sliced(t: DriverTables, folder: str) -> DataFrame:
    """Events as a stream of several files; every seventh row comes one file too late."""
    events = t.raw("events")
    most = events.agg(F.max("event_id")).first()[0] or 0
    batch = F.least(F.expr(f"event_id * {SLICES} div {most + 1}") + (F.col("event_id") % 7 == 0).cast("int"), F.lit(SLICES - 1))
    for i in range(SLICES):
        events.filter(batch == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _kept(t: DriverTables) -> ledger.Ledger:
    folder = _folder(t)
    rows = _sliced(t, folder).select("event_id", "user_id", "event_type", "ts")
    schema = "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz"
    own = ledger.Ledger(t.spark, f"{folder}/table", ["user_id", "event_type"], ["event_id"], schema, merge_every=2)
    ledger.ingest(rows, own, "ts", 3600, f"{folder}/state").awaitTermination()
    return own


@query("stream_ledger", f"""{_LEDGER_SQL} select user_id, event_type, event_id, {sql_ts('ts')} as ts from r where not late
    qualify row_number() over (partition by user_id, event_type order by batch desc, event_id desc) = 1""")
def stream_ledger(t: DriverTables) -> DataFrame:
    """The merged table: of the rows in time, the last one per key."""
    return _kept(t).table().select("user_id", "event_type", "event_id", ts("ts"))


@query("stream_late_rows", f"""{_LEDGER_SQL} select batch::bigint as batch, count(*) as n_rows, count(*) filter (late) as n_late, sum(case when late then event_id end)::bigint as late_ids from r group by batch""")
def stream_late_rows(t: DriverTables) -> DataFrame:
    """Progress of each batch beside the rows that came too late for it."""
    own = _kept(t)
    done = t.spark.read.parquet(f"{own.path}/progress").select(F.col("batch").cast("bigint").alias("batch"), "n_rows", "n_late")
    late = t.spark.read.parquet(f"{own.path}/late").groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.sum("event_id").alias("late_ids"))
    return done.join(late, "batch", "left")
