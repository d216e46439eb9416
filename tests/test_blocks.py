"""Time-blocked joins, role models and the registry."""

import datetime
import random

from pyspark.sql import functions as F

from hindcast.operators import asof, membership
from hindcast.plans import registry


def test_within_days_equals_the_plain_join(spark):
    rng = random.Random(3)
    day0 = datetime.datetime(1969, 11, 1)
    at = lambda: day0 + datetime.timedelta(minutes=rng.randrange(0, 400 * 1440))
    asks = [(rng.randrange(3), at()) for _ in range(60)] + [(0, day0), (None, day0)]
    rows = [(rng.randrange(3), at(), i) for i in range(300)] + [(0, day0, 900), (0, day0 - datetime.timedelta(days=30), 901), (None, day0, 902), (0, None, 903)]
    a = spark.createDataFrame(asks, "k int, cutoff timestamp_ntz")
    b = spark.createDataFrame(rows, "k int, ts timestamp_ntz, n int")
    got = sorted((r.k, r.cutoff, r.n) for r in asof.within_days(a, b, ["k"], "cutoff", "ts", 30).collect())
    want = sorted((k, c, n) for k, c in asks for j, t, n in rows if k is not None and k == j and t is not None and t <= c <= t + datetime.timedelta(days=30))
    assert got == want


def test_roles_recover_blocks(spark):
    rows = [(1, f"u{i}", f"dir:{b}", 1.0 + (i * 7 + b) % 5) for i in range(12) for b in range(6) if i % 3 == b // 2]
    rows += [(2, "solo", "dir:a", 2.0)]
    x = spark.createDataFrame(rows, "repo_id long, login string, boundary_id string, weight double")
    w, h = membership.fit_roles(x, k=6, lot_users=5)
    error = {r.repo_id: r.error for r in membership.reconstruction_error(x, w, h).collect()}
    norm = {r.repo_id: r.n for r in x.groupBy("repo_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n")).collect()}
    assert error[1] < 0.25 * norm[1] and error[2] < 0.01 * norm[2]
    assert w.count() == 13 and h.count() == 7
    solo = h.filter("repo_id = 2").first().v
    assert sum(v > 0 for v in solo) == 1  # min(k, users, boundaries) roles


def test_roles_of_nothing(spark):
    x = spark.createDataFrame([], "repo_id long, login string, boundary_id string, weight double")
    w, h = membership.fit_roles(x)
    assert w.count() == 0 and h.count() == 0


def test_registry_is_plain(spark):
    specs = registry.feature_specs(spark)
    assert specs.count() == len(registry.FEATURES) and specs.filter("deprecated").count() == 8
