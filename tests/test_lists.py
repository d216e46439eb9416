"""Routes as lists on the row of the pull request against the same routes as rows."""

from pyspark.sql import functions as F

from hindcast.operators import gates, metrics, ownership
from hindcast.plans import rankers

SOURCES = ["mentions", "popularity", "codeowners"]


def _rows(spark):
    members = []
    for pr in range(60):
        members += [("mentions", pr, i + 1, "user", f"{'Sup' if (pr + i) % 2 else 'sup'}-{(pr * 5 + i) % 7}", 1 / (i + 1)) for i in range(pr % 3)]
        members += [("popularity", pr, i + 1, "user", f"sup-{(pr + i) % 9}", (8 - i) / 8) for i in range(pr % 9)]
        members += [("codeowners", pr, i + 1, "team" if i % 2 else "user", f"sup-{(pr * 3 + i) % 8}", float(4 - i)) for i in range(pr % 4)]
    return spark.createDataFrame(members, "router_id string, pr_id long, rank int, target_type string, target_name string, score double")


def _lists(spark, rows):
    entry = F.struct("rank", F.struct("target_type", "target_name", "score", F.lit(2).cast("bigint").alias("hits")).alias("m"))
    one = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("router_id") == s, entry))), lambda e: e.m).alias(s)
    lists = rows.groupBy("pr_id").agg(*[one(s) for s in SOURCES])
    return spark.range(60).withColumnRenamed("id", "pr_id").join(lists, "pr_id", "left")


def _canon(df):
    return sorted((r.pr_id, r.rank, r.target_type, r.target_name, round(r.score, 9)) for r in df.collect())


def test_merged_lists_equal_merged_rows(spark):
    rows = _rows(spark)
    evidenced = rows.withColumn("evidence", rankers.evidence("x", a=F.lit("1")))
    union = rankers.union([evidenced], 10)
    got = rankers.merged_lists(_lists(spark, rows), SOURCES, 10)
    flat = lambda c: got.select("pr_id", F.posexplode(c).alias("i", "m")).select("pr_id", (F.col("i") + 1).alias("rank"), "m.*")
    assert got.count() == 60  # the row stays where nobody is named
    assert _canon(flat("union")) == _canon(union)
    assert _canon(flat("hybrid_ranker")) == _canon(rankers.hybrid(union, k=10))
    hits = {(r.pr_id, r.target_type, r.target_name): (r.sources, r.hits) for r in flat("union").collect()}
    for r in union.collect():
        by = sorted({e.source_router for e in r.evidence})
        assert hits[r.pr_id, r.target_type, r.target_name] == (by, len(r.evidence) + by.count("codeowners"))  # two hits each


def test_halves_round_as_in_sql(spark):
    score = 0.00390625  # with its hundredth: 10.0039453125, a half in the ninth digit
    member = "target_type string, target_name string, score double, hits bigint"
    rows = spark.createDataFrame([(1, [], [("user", "b", score, 1), ("user", "a", score - 1e-10, 1)], None)],
                                 ", ".join(["pr_id long", *[f"{s} array<struct<{', '.join(f.replace(' ', ': ') for f in member.split(', '))}>>" for s in SOURCES]]))
    # 10.0039453125 goes up, the other stays a digit lower although both lie within one unit.
    assert [m.target_name for m in rankers.merged_lists(rows, SOURCES, 5).collect()[0].union] == ["b", "a"]


def test_places_and_deltas_equal_rows(spark):
    rows = _rows(spark)
    truths = F.array(F.struct(F.lit("p").alias("policy_id"), F.lit("observed").alias("status"), F.concat(F.lit("sup-"), (F.col("pr_id") % 9).cast("string")).alias("selected_login"),
                              F.lit(None).cast("timestamp_ntz").alias("window_end")))
    lists = _lists(spark, rows).select(F.lit(1).alias("repo_id"), "pr_id", F.expr("timestamp_ntz '2020-01-01 00:00:00'").alias("cutoff"), truths.alias("truths"),
                                       *[F.slice(F.col(s).getField("target_name"), 1, 5).alias(s) for s in SOURCES])
    packed = metrics.places(lists, {s: s for s in SOURCES})
    labels = lists.select("repo_id", "pr_id", "cutoff", F.inline("truths"))
    flat = metrics.agreement(labels, rows.filter("rank <= 5"), SOURCES)
    assert sorted(metrics.by_router(packed).collect()) == sorted(flat.select(metrics.by_router(packed).columns).collect())
    got = gates.deltas_in_place(packed, "popularity", "codeowners", "p").collect()
    assert got and sorted(got) == sorted(gates.paired_deltas(flat, "popularity", "codeowners", "p").select("repo_id", "pr_id", "delta_mrr", "delta_hit1").collect())


def test_owner_lists_equal_owner_hits(spark):
    files = spark.createDataFrame([(pr, 1, "s", f"{d}/{f}.md") for pr in range(4) for d in ("a", "b") for f in range(pr)], "pr_id long, repo_id long, base_sha string, path string")
    t = lambda *names: [("team" if "/" in n else "user", n) for n in names]
    rules = spark.createDataFrame([(1, "s", 1, "a/", t("ann", "o/x")), (1, "s", 2, "*.md", t("ann")), (1, "s", 3, "1.md", t("Ann", "bo"))],
                                  "repo_id long, base_sha string, line long, pattern string, targets array<struct<type: string, name: string>>")
    rows = rankers.codeowners(ownership.file_owner_hits(files, rules), 3)
    lists = rankers.codeowner_lists(ownership.path_owners(files, rules), 3)
    flat = lists.select("pr_id", F.posexplode("codeowners").alias("i", "m")).select("pr_id", (F.col("i") + 1).alias("rank"), "m.*")
    assert _canon(flat) == _canon(rows) and len(_canon(rows)) == 8


def test_only_asked_sources_are_read(spark, sf_dir):
    from hindcast.catalog import frames as fr
    from hindcast.sources.binding import DriverTables

    t = DriverTables(spark, sf_dir)
    only = fr.reached(t, ["popularity"], ["first_response_v1"], 60 * 86400)
    assert not any("/part.parquet" in f or "/documents.parquet" in f for f in only.inputFiles())
    first = only.collect()[0]
    assert [p.router_id for p in first.places] == ["popularity"]
