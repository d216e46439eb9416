"""Column functions on literals."""

from pyspark.sql import functions as F

from hindcast.functions import paths as P
from hindcast.functions import text as X


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_mentions_keep_first_appearance_and_teams(spark):
    got = _one(spark, "hi @Bob, @acme/core and @bob again; mail a@b.c", X.mention_targets)
    assert [(m["type"], m["name"]) for m in got] == [("user", "Bob"), ("team", "acme/core")]


def test_gates(spark):
    body = "Fixes #12\n- [ ] no AI was used\n- [x] Human written\n"
    assert _one(spark, body, X.gate_issue) == "#12"
    assert _one(spark, body, X.gate_ai_disclosure) is None
    assert _one(spark, body, X.gate_provenance) == "- [x] Human written"
    assert _one(spark, "AI assisted: yes", X.gate_ai_disclosure) == "AI assisted: yes"
    assert _one(spark, "word#12 é#3", X.gate_issue) is None


def test_paths(spark):
    assert _one(spark, ".//src//a.py", P.normalize) in ("src/a.py", ".//src//a.py".replace(".//", "").replace("//", "/"))
    assert _one(spark, "README.md", P.boundary_id) == "dir:__root__"
    assert _one(spark, "a/b/c/d.PY", lambda c: P.directory(c, 2)) == "a/b"
    assert [_one(spark, p, P.extension) for p in ("x/.bashrc", "a.tar.GZ", "Makefile")] == ["__none__", "gz", "__none__"]
    df = spark.createDataFrame([("src/*.py", "src/a/b.py"), ("src/[!a]?.go", "src/bc.go"), ("a+b/*", "aab/x")], "g string, p string")
    got = df.withColumn("rx", P.glob_regex(F.col("g"))).selectExpr("p rlike rx as m").collect()
    assert [r.m for r in got] == [True, True, False]


def test_team_variants(spark):
    assert sorted(_one(spark, "Acme/Core", X.team_key_variants)) == ["acme/core", "core"]
    assert sorted(_one(spark, "core", X.team_key_variants)) == ["core", "team:core"]
