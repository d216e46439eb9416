"""Queries over evaluation runs that lie on disk as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.catalog.registry import query
from hindcast.session import scratch_folder
from hindcast.sources import runs
from hindcast.sources.binding import DriverTables


def _folder(t: DriverTables) -> str:
    return f"{scratch_folder(t.spark)}/runs-{uuid.uuid4().hex}"


def _put(t: DriverTables, path: str, **doc: str) -> None:
    t.spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in doc.items()])).alias("value")).coalesce(1).write.text(path)


@query("run_file_index", """select 'shop/orders' as repo, concat('r', o_orderkey % 3) as run_id, o_orderkey as pr_number,
    case when o_orderstatus = 'F' then 'observed' end as truth_status, cast(o_orderstatus = 'O' as int) as merged,
    case when o_orderkey % 3 = 0 then '["mentions"]' else '["mentions","popularity"]' end as routers_json, '2024-01-0' || (o_orderkey % 3 + 1) as indexed_at
    from orders where o_orderkey % 3 < 2""")
def run_file_index(t: DriverTables) -> DataFrame:
    """Every order is a line in one of three runs; the third has no report, so the index leaves it out."""
    root = _folder(t)
    orders = t.raw("orders")
    routers = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.create_map(F.lit("mrr"), F.col("o_totalprice")))])
    for i in range(3):
        run = f"{root}/shop/orders/eval/r{i}"
        line = F.struct(
            F.col("o_orderkey").alias("pr_number"), F.when(F.col("o_orderstatus") == "F", "observed").otherwise("").alias("truth_status"),
            F.struct((F.col("o_orderstatus") == "O").alias("merged")).alias("gates"), (routers("mentions") if i == 0 else routers("popularity", "mentions")).alias("routers"))
        orders.filter(F.col("o_orderkey") % 3 == i).select(F.to_json(line).alias("value")).write.text(f"{run}/per_pr.jsonl")
        _put(t, f"{run}/manifest.json", generated_at=f"2024-01-0{i + 1}")
        if i < 2:
            _put(t, f"{run}/report.json", generated_at="1999-01-01")
    _, found = runs.index_runs(t.spark, root)
    return found.select("repo", "run_id", "pr_number", "truth_status", "merged", "routers_json", "indexed_at")


@query("run_rebuild", """select 'shop/parts' as repo, concat('r', s_suppkey % 2) as run_id, s_suppkey + 1 as pr_number, n as routers, case when n = 2 then s_acctbal else null end as balance
    from (select *, case when s_suppkey % 5 = 0 then 2 else 1 end as n from supplier)""")
def run_rebuild(t: DriverTables) -> DataFrame:
    """Every supplier has one or two artefact files in one of two runs; the rows come back from the index of artefacts."""
    root = _folder(t)
    supplier = t.raw("supplier")
    for i in range(2):
        run = f"{root}/shop/parts/eval/r{i}"
        mine = supplier.filter(F.col("s_suppkey") % 2 == i)
        both = mine.select("*", F.lit("mentions").alias("router")).unionByName(mine.filter("s_suppkey % 5 = 0").select("*", F.lit("union").alias("router")))
        result = F.struct((F.col("s_suppkey") + 1).alias("pr_number"), F.col("s_acctbal").alias("balance"))
        payload = F.struct(F.col("router").alias("router_id"), result.alias("result"))
        # A file per artefact, all in one folder: a folder each would be listed, moved and looked up one by one.
        both.repartition(t.spark.sparkContext.defaultParallelism).select(payload.alias("payload")).write.option("maxRecordsPerFile", 1).json(f"{run}/artifacts")
        written = runs.run_tree(t.spark, root, "/artifacts").filter(F.col("run_id") == f"r{i}")
        written.select(F.to_json(F.struct(F.lit("route_result").alias("artifact_type"), F.col("file").alias("relative_path"))).alias("value")).write.text(f"{run}/artifact_index.jsonl")
    rows = runs.rebuilt_rows(t.spark, root)
    return rows.select("repo", "run_id", "pr_number", F.size("routers").cast("bigint").alias("routers"),
                       F.get_json_object(F.col("routers")["union"], "$.balance").cast("double").alias("balance"))
