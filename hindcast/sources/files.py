"""Table, JSON-lines, CSV and pinned-file readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the exported tables.
EXPORT_COLUMNS = {
    "prs": ["repo", "pr_number", "cutoff", "cutoff_policy", "export_version", "author_login", "created_at", "base_sha",
            "head_sha", "n_changed_files", "missing_issue", "missing_ai_disclosure", "missing_provenance"],
    "prs_text": ["repo", "pr_number", "cutoff", "export_version", "title", "body"],
    "pr_files": ["repo", "pr_number", "cutoff", "head_sha", "path", "status", "additions", "deletions", "changes", "default_boundary"],
    "pr_activity": ["repo", "pr_number", "occurred_at", "actor_login", "actor_type", "kind", "path", "review_state"],
    "truth_behavior": ["repo", "pr_number", "cutoff", "export_version", "truth_behavior_first_reviewer"],
    "truth_intent": ["repo", "pr_number", "cutoff", "export_version", "requested_at", "target_type", "target_name"],
}
MEMBERSHIP_SCHEMA = T.StructType([
    T.StructField("unit_id", T.StringType(), False),
    T.StructField("boundary_id", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
])
SIGNAL_SCHEMA = T.StructType([
    T.StructField("unit_id", T.StringType(), False),
    T.StructField("signal", T.StringType(), False),
    T.StructField("boundary_id", T.StringType(), False),
    T.StructField("value", T.DoubleType(), False),
])
# Where an ownership file may sit, best place first.
OWNERSHIP_PATHS = [".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"]


def write_export(rows: DataFrame, name: str, path: str, partition_by: list[str] | None = None) -> None:
    """Write one exported table with its fixed columns; an empty one keeps its schema."""
    writer = rows.select(*EXPORT_COLUMNS[name]).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_boundary_model(memberships: DataFrame, signals: DataFrame, path: str) -> None:
    memberships.select("unit_id", "boundary_id", "weight").write.mode("overwrite").parquet(f"{path}/memberships")
    signals.select("unit_id", "signal", "boundary_id", "value").write.mode("overwrite").parquet(f"{path}/signals")


def read_boundary_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(MEMBERSHIP_SCHEMA).parquet(f"{path}/memberships"),
            spark.read.schema(SIGNAL_SCHEMA).parquet(f"{path}/signals"))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Tolerant reader: lines that are not objects of the schema are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv_sample(rows: DataFrame, order: list, path: str, limit: int = 25) -> None:
    """The audit sample: the first ``limit`` rows of a total order, with a header."""
    rows.orderBy(*order).limit(limit).write.mode("overwrite").csv(path, header=True)


def pinned_texts(spark: SparkSession, root: str) -> DataFrame:
    """(repo, base_sha, path, text) from ``root/<owner>/<name>/pinned/<sha>/<path…>``."""
    rx = r"/([^/]+/[^/]+)/pinned/([^/]+)/(.+)$"
    name = F.input_file_name()
    return spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(
        F.regexp_extract(name, rx, 1).alias("repo"), F.regexp_extract(name, rx, 2).alias("base_sha"),
        F.regexp_extract(name, rx, 3).alias("path"), F.col("value").alias("text"))


def first_existing(texts: DataFrame, keys: list[str], preference: list[str]) -> DataFrame:
    """Per key the text at the best of the preferred paths."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("path"))
    return (
        texts.withColumn("_rank", rank).filter("_rank > 0")
        .groupBy(*keys).agg(F.min_by(F.struct("path", "text"), "_rank").alias("f")).select(*keys, "f.*")
    )


def browse(table: DataFrame, text: str | None = None, sort: str | None = None, descending: bool = False,
           page: int = 1, page_size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(page of rows, total count) of a table filtered over all columns as text.

    The match ignores ASCII case.  Paging without a sort column follows scan
    order; with one, ties are broken by the remaining columns.
    """
    size = min(500, max(1, page_size))
    rows = table
    if text:
        needle = text.lower()
        hit = F.lit(False)
        for name in table.columns:
            hit = hit | F.lower(F.col(name).cast("string")).contains(needle)
        rows = rows.filter(hit)
    total = rows.agg(F.count("*").alias("total_rows"))
    if sort:
        if sort not in table.columns:
            raise ValueError(f"Unknown sort column: {sort}")
        first = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
        rows = rows.orderBy(first, *[F.col(c) for c in table.columns if c != sort])
    return rows.offset((max(1, page) - 1) * size).limit(size), total


def adhoc_select(spark: SparkSession, sql: str, row_limit: int = 200, **tables: DataFrame) -> DataFrame:
    """Read-only SELECT over named tables with a row cap and a ``truncated`` flag."""
    text = sql.strip().rstrip(";").strip()
    if ";" in text or not text.lower().startswith(("select", "with")):
        raise ValueError("Only SELECT queries are allowed")
    cap = min(1000, max(1, row_limit))
    fetched = spark.sql(text, **tables).limit(cap + 1)
    fetched = fetched.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return fetched.withColumn("truncated", F.col("_n") > cap).drop("_n").limit(cap)
