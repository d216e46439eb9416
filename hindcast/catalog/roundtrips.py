"""Queries that write through a sink and read the result back, and small functions on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.catalog.boundaries import MODEL_SQL, VIEWS, sets
from hindcast.catalog.common import num
from hindcast.catalog.registry import query
from hindcast.functions import stats
from hindcast.operators import boundary as bd
from hindcast.operators import ownership
from hindcast.sources import files
from hindcast.sources.binding import DriverTables, with_views
from hindcast.session import scratch_folder


def _folder(t: DriverTables) -> str:
    return f"{scratch_folder(t.spark)}/roundtrip-{uuid.uuid4().hex}"


@query("time_functions", """select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') as key,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as from_iso, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as from_epoch from orders""")
def time_functions(t: DriverTables) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    iso, epoch = stats.iso_z(at), F.unix_seconds(at).cast("string")
    text = lambda c: F.date_format(stats.parse_time(c), "yyyy-MM-dd HH:mm:ss")
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"), iso.alias("iso"), stats.cutoff_key(at).alias("key"), text(iso).alias("from_iso"), text(epoch).alias("from_epoch"))


@query("set_similarity", with_views(["pull_requests", "pr_files"], """select pr_id, other, round(met / (n + m - met), 8) as jaccard, round(met / n, 8) as overlap_ratio,
    round(case when greatest(c, d) <= 0 then 1.0 else 1.0 - abs(c - d) / greatest(c, d) end, 8) as churn_similarity
    from (select *, len(list_intersect(p, q))::double as met, len(p)::double as n, len(q)::double as m from (
      select pr_id, paths as p, churn::double as c, lead(pr_id) over w as other, lead(paths) over w as q, lead(churn)  over w::double as d from s window w as (partition by author_id order by pr_id)) where other is not null)""",
    {"s": "select p.author_id, f.pr_id, list(distinct f.path) as paths, sum(f.changes) as churn from pr_files f join pull_requests p using (pr_id) group by all"}))
def set_similarity(t: DriverTables) -> DataFrame:
    """Each pull request's files against those of the author's next one."""
    own = t.pr_files.join(t.pull_requests.select("pr_id", "author_id"), "pr_id").groupBy("author_id", "pr_id").agg(
        F.collect_set("path").alias("p"), F.sum("changes").cast("double").alias("c"))  # files of one pull request
    next_ = Window.partitionBy("author_id").orderBy("pr_id")
    rows = own.select("pr_id", "p", "c", F.lead("pr_id").over(next_).alias("other"), F.lead("p").over(next_).alias("q"), F.lead("c").over(next_).alias("d"))
    p, q = F.col("p"), F.col("q")
    return rows.filter("other is not null").select(
        "pr_id", "other", num(stats.jaccard(p, q)).alias("jaccard"), num(stats.overlap_ratio(p, q)).alias("overlap_ratio"),
        num(stats.churn_similarity(F.col("c"), F.col("d"))).alias("churn_similarity"))


@query("jsonl_roundtrip", "select conv_id, turn, role, length(text) as n_chars from conversations union all select conv_id, turn, role, length(text) from conversations where role = 'user'")
def jsonl_roundtrip(t: DriverTables) -> DataFrame:
    """Two appends of JSON lines, read with their schema."""
    rows, path = t.raw("conversations"), _folder(t)
    files.append_jsonl(rows, path)
    files.append_jsonl(rows.filter("role = 'user'"), path)
    return files.read_jsonl(t.spark, path, rows.schema).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


@query("csv_sample", "select o_orderkey as id, o_orderpriority as priority from orders order by o_totalprice desc, o_orderkey limit 25")
def csv_sample(t: DriverTables) -> DataFrame:
    """The audit sample: the 25 first rows of a total order."""
    path = _folder(t)
    rows = t.raw("orders").selectExpr("o_orderkey as id", "o_orderpriority as priority", "o_totalprice as price")
    files.write_csv_sample(rows, [F.desc("price"), "id"], path, 25)
    return t.spark.read.csv(path, header=True, schema="id long, priority string, price double").select("id", "priority")


@query("boundary_model_roundtrip", with_views(VIEWS, "select boundary_id, count(*) as units, cast(floor(sum(round(weight, 6)) + 0.5) as bigint) as total from mem group by boundary_id", MODEL_SQL))
def boundary_model_roundtrip(t: DriverTables) -> DataFrame:
    """Memberships written as a model and read back with the fixed schema."""
    path = _folder(t)
    rows = bd.memberships(sets(t)).select(F.concat_ws("/", F.col("repo_id").cast("string"), "path").alias("unit_id"), "boundary_id", "weight")
    signals = rows.select("unit_id", F.lit("path").alias("signal"), "boundary_id", F.col("weight").alias("value"))
    files.write_boundary_model(rows, signals, path)
    back, again = files.read_boundary_model(t.spark, path)
    # Every membership has its signal: the join loses nothing.
    both = back.join(again.filter("signal = 'path'"), ["unit_id", "boundary_id"])
    return both.groupBy("boundary_id").agg(F.count("*").alias("units"), F.floor(F.sum(F.round("weight", 6)) + 0.5).cast("bigint").alias("total"))


@query("guide_vocabulary", with_views(["pr_text"], """select pr_id, unnest(list_filter([case when contains(g, 'issue') then 'link_issue' end,
    case when contains(g, 'ai') and contains(g, 'disclosure') then 'disclose_ai_usage' end, case when contains(g, 'provenance') then 'supply_provenance' end], lambda x: x is not null)) as canonical_intent
    from (select pr_id, lower(body) as g from pr_text)"""))
def guide_vocabulary(t: DriverTables) -> DataFrame:
    """Terms that texts share with the gates; bodies of pull requests stand for guides."""
    guides = t.pr_text.selectExpr("pr_id as repo_id", "'pinned' as base_sha", "'CONTRIBUTING.md' as path", "body as text")
    return ownership.vocabulary(ownership.policy_signals(guides)).select(F.col("repo_id").alias("pr_id"), "canonical_intent")
