"""Evaluation runs on disk: an index over the files of many runs, and rows rebuilt from single artefacts.

A run is the folder ``<root>/<owner>/<name>/eval/<run_id>`` with ``run_summary.json``,
``manifest.json``, ``report.json``, ``experiment_manifest.json``, ``per_pr.jsonl``,
``artifact_index.jsonl`` and artefacts below it.  Each may be a folder as Spark writes it: documents
with one part, lines with many.  Folders whose
name starts with an underscore are no runs.  Texts that are no JSON objects, and objects that name
a key twice, count as absent.  All functions read the files of all runs in one scan each.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators.upsert import keep_latest, upsert

# The documents of a run, and the columns of its index row taken from them (first document that has a text wins).
DOCUMENTS = ["run_summary", "manifest", "report", "experiment_manifest"]
RUN_FIELDS = {
    "generated_at": [("run_summary", "$.generated_at"), ("manifest", "$.generated_at"), ("report", "$.generated_at")],
    "cohort_hash": [("run_summary", "$.inputs.cohort_hash"), ("experiment_manifest", "$.cohort_hash")],
    "experiment_spec_hash": [("run_summary", "$.inputs.experiment_spec_hash"), ("experiment_manifest", "$.experiment_spec_hash")],
    "db_max_event_occurred_at": [("run_summary", "$.watermark.db_max_event_occurred_at"), ("manifest", "$.db_max_event_occurred_at"), ("report", "$.db_max_event_occurred_at")],
    "db_max_watermark_updated_at": [("run_summary", "$.watermark.db_max_watermark_updated_at"), ("manifest", "$.db_max_watermark_updated_at"), ("report", "$.db_max_watermark_updated_at")],
    "manifest_json_sha256": [("run_summary", "$.hashes.manifest_json_sha256")],
    "report_json_sha256": [("run_summary", "$.hashes.report_json_sha256")],
    "per_pr_jsonl_sha256": [("run_summary", "$.hashes.per_pr_jsonl_sha256")],
}
GATES = ["missing_issue", "missing_ai_disclosure", "missing_provenance", "merged"]
RUN = ["repo", "run_id"]
_PLACE = r"([^/]+/[^/]+)/eval/([^/_][^/]*)/(.+)$"


def _load(spark: SparkSession, format_: str, path: str, schema: str) -> DataFrame:
    """Files below a pattern; none at all is an empty table."""
    try:
        return spark.read.format(format_).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _placed(path: Column) -> list[Column]:
    return [F.regexp_extract(path, _PLACE, 1).alias("repo"), F.regexp_extract(path, _PLACE, 2).alias("run_id"), F.regexp_extract(path, _PLACE, 3).alias("file")]


def run_files(spark: SparkSession, root: str, pattern: str, content: bool = False) -> DataFrame:
    """(repo, run_id, file[, text]) of the files of all runs below a pattern; the contents are read only if asked for."""
    found = _load(spark, "binaryFile", f"{root}/*/*/eval/*/{pattern}", "path string, content binary")
    text = [F.decode("content", "UTF-8").alias("text")] if content else []
    return found.select(*_placed(F.col("path")), *text).filter("run_id <> ''")


def run_tree(spark: SparkSession, root: str, below: str = "", content: bool = False) -> DataFrame:
    """``run_files`` of every ``.json`` file at any depth of a folder of all runs: the folders are listed, no path is looked up by itself."""
    try:
        every = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{root}/*/*/eval/*{below}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        every = spark.createDataFrame([], "path string, content binary")
    text = [F.decode("content", "UTF-8").alias("text")] if content else []
    return every.select(*_placed(F.col("path")), *text).filter("run_id <> ''")


def run_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(repo, run_id, at, v) of the lines of one JSON-lines file of all runs; ``at`` grows along a file."""
    meta = "struct<file_path: string, file_block_start: bigint>"
    found = _load(spark, "text", f"{root}/*/*/eval/*/{name}", f"value string, _metadata {meta}")
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = found.select(*_placed(path), F.struct(path.alias("path"), start.alias("start"), F.monotonically_increasing_id().alias("n")).alias("at"),
                         F.try_parse_json("value").alias("v"))
    return lines.filter((F.col("run_id") != "") & F.schema_of_variant("v").startswith("OBJECT")).select(*RUN, "at", "v")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    """The text at a path; other kinds and blank texts are null."""
    s = F.try_variant_get(v, path, "string")
    return F.when((_kind(v, path) == "STRING") & s.rlike(r"\S"), s)


def flag_at(v: Column, path: str) -> Column:
    """1 or 0 for booleans, numbers and the usual words, else null."""
    kind, s = _kind(v, path), F.lower(F.trim(F.try_variant_get(v, path, "string")))
    number = F.try_variant_get(v, path, "double")
    return (
        F.when(kind.isin("BOOLEAN", "STRING"), F.when(s.isin("true", "yes", "1"), 1).when(s.isin("false", "no", "0"), 0))
        .when(number.isNotNull(), (number != 0).cast("int"))
    )


def runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run: index columns, and ``complete`` and ``skipped`` (why a run is left out of the index, else null).

    A run needs ``per_pr.jsonl``; without a report or a manifest it is incomplete.
    """
    docs = run_files(spark, root, "{" + ",".join(f"{d}.json" for d in DOCUMENTS) + "}", content=True)
    lines = run_files(spark, root, "per_pr.jsonl").select(*RUN, F.lit("per_pr").alias("doc"), F.lit(None).cast("string").alias("text"))
    every = docs.select(*RUN, F.regexp_extract("file", "^([a-z_]+)[.]json", 1).alias("doc"), "text").unionByName(lines)
    one = every.groupBy(*RUN).agg(*[F.max(F.when(F.col("doc") == d, F.col("text"))).alias(d) for d in DOCUMENTS],
                                  *[F.max(F.col("doc") == d).alias(f"has_{d}") for d in ["per_pr", "report", "manifest"]])
    parsed = one.select("*", *[F.try_parse_json(d).alias(f"v_{d}") for d in DOCUMENTS])
    fields = [F.coalesce(*[text_at(F.col(f"v_{d}"), p) for d, p in places]).alias(name) for name, places in RUN_FIELDS.items()]
    skipped = F.when(~F.col("has_per_pr"), "missing per_pr.jsonl").when(~(F.col("has_report") & F.col("has_manifest")), "missing report.json or manifest.json")
    return parsed.select(*RUN, F.concat_ws("/", F.lit("github"), "repo", F.lit("eval"), "run_id").alias("run_dir_rel"), *fields,
                         skipped.isNull().alias("complete"), skipped.alias("skipped"))


def examples(spark: SparkSession, root: str, include_incomplete: bool = False) -> DataFrame:
    """One row per (repo, run, pull request) of the lines of all complete runs; the last line of a pull request wins.

    Lines that are no object or have no whole ``pr_number`` are left out.
    """
    v = F.col("v")
    known = runs(spark, root)
    known = known if include_incomplete else known.filter("complete")
    ids = F.coalesce(F.map_keys(F.try_variant_get(v, "$.routers", "map<string, variant>")), F.array().cast("array<string>"))
    rows = run_lines(spark, root, "per_pr.jsonl").filter(_kind(v, "$.pr_number") == "BIGINT").select(
        *RUN, F.try_variant_get(v, "$.pr_number", "bigint").alias("pr_number"), "at",
        text_at(v, "$.cutoff").alias("cutoff"), text_at(v, "$.truth_status").alias("truth_status"),
        *[flag_at(v, f"$.gates.{g}").alias(g) for g in GATES],
        F.trim(text_at(v, "$.truth.primary_policy")).alias("primary_policy"), F.array_sort(ids).alias("ids"),
        *[text_at(v, f"$.repo_profile.{k}_path").alias(k) for k in ["profile", "qa"]])
    last = keep_latest(rows, [*RUN, "pr_number"], ["at"]).drop("at")
    # Profiles that no line names are found by their place.
    place = r"^prs/([0-9]+)/repo_profile/(profile|qa)[.]json$"
    lying = run_files(spark, root, "prs/*/repo_profile/{profile,qa}.json").select(
        *RUN, F.regexp_extract("file", place, 1).cast("bigint").alias("pr_number"), F.regexp_extract("file", place, 2).alias("k"), "file")
    lying = lying.groupBy(*RUN, "pr_number").agg(*[F.max(F.when(F.col("k") == k, F.col("file"))).alias(f"{k}_file") for k in ["profile", "qa"]])
    both = last.join(lying, [*RUN, "pr_number"], "left").join(known.select(*RUN, F.col("generated_at").alias("indexed_at")), RUN)
    folder = F.concat(F.lit("prs/"), F.col("pr_number").cast("string"))
    by_name = F.array_sort(F.transform("ids", lambda r: F.struct(F.lower(r).alias("l"), r.alias("r"))))
    paths = F.struct(
        F.concat(folder, F.lit("/inputs.json")).alias("inputs_json"), folder.alias("pr_dir"),
        F.coalesce("profile", "profile_file").alias("repo_profile_profile_json"), F.coalesce("qa", "qa_file").alias("repo_profile_qa_json"),
        F.map_from_arrays("ids", F.transform("ids", lambda r: F.concat(folder, F.lit("/routes/"), r, F.lit(".json")))).alias("routes_by_router"),
        F.concat(folder, F.lit("/snapshot.json")).alias("snapshot_json"))
    return both.select(*RUN, "pr_number", "cutoff", "truth_status", *GATES, "primary_policy", F.to_json(F.transform(by_name, lambda e: e["r"])).alias("routers_json"),
                       F.to_json(paths).alias("artifact_paths_json"), "indexed_at")


def index_runs(spark: SparkSession, root: str, runs_before: DataFrame | None = None, examples_before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, examples) after an upsert of all complete runs on disk; indexing the same files again changes nothing."""
    now = runs(spark, root).filter("complete").drop("complete", "skipped"), examples(spark, root)
    if runs_before is None or examples_before is None:
        return now
    return upsert(runs_before, now[0], RUN, ["generated_at"]), upsert(examples_before, now[1], [*RUN, "pr_number"], ["indexed_at"])


def route_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(repo, run_id, at, pr_number, router_id, result) of the route results that the artefact indexes of all runs list.

    Listed files that are missing or hold no object are left out; ``router_id`` is null where the artefact names none.
    """
    v = F.col("v")
    listed = run_lines(spark, root, "artifact_index.jsonl").filter(text_at(v, "$.artifact_type") == "route_result").select(
        *RUN, "at", text_at(v, "$.relative_path").alias("file"))
    payload = run_tree(spark, root, content=True).select(*RUN, "file", F.try_parse_json("text").alias("p"))
    p = F.col("p")
    result = F.when(_kind(p, "$.payload.result").startswith("OBJECT"), F.try_variant_get(p, "$.payload.result", "variant"))
    number = F.try_variant_get(p, "$.payload.result.pr_number", "string").try_cast("bigint")
    return listed.join(payload, [*RUN, "file"]).select(
        *RUN, "at", number.alias("pr_number"), text_at(p, "$.payload.router_id").alias("router_id"), F.to_json(result).alias("result"))


def rebuilt_rows(spark: SparkSession, root: str) -> DataFrame:
    """(repo, run_id, pr_number, routers) for runs without ``per_pr.jsonl``: router to its route result as JSON.

    The last listed result of a router wins; a pull request whose artefacts name no router has an empty map.
    """
    present = run_files(spark, root, "per_pr.jsonl").select(*RUN).distinct()
    rows = route_artifacts(spark, root).filter("pr_number is not null and pr_number <> 0").join(present, RUN, "left_anti")
    last = keep_latest(rows, [*RUN, "pr_number", "router_id"], ["at"])
    entry = F.when(F.col("router_id").isNotNull(), F.struct("router_id", "result"))
    return last.groupBy(*RUN, "pr_number").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("routers"))  # routers of one pull request


def rebuilt_lines(rows: DataFrame) -> DataFrame:
    """(repo, run_id, value): the lines of ``per_pr.jsonl`` for rebuilt rows, keys in order."""
    inner = F.transform_values("routers", lambda _, r: F.struct(F.try_parse_json(r).alias("route_result")))
    return rows.select(*RUN, F.to_json(F.struct("pr_number", inner.alias("routers"))).alias("value"))


def derived_report(spark: SparkSession, root: str) -> DataFrame:
    """(repo, run_id, router_id, n): listed route results by router, for runs without ``report.json``."""
    present = run_files(spark, root, "report.json").select(*RUN).distinct()
    return route_artifacts(spark, root).filter("router_id is not null").join(present, RUN, "left_anti").groupBy(*RUN, "router_id").agg(F.count("*").alias("n"))
