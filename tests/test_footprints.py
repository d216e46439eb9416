"""Footprints at their steps against footprints at every asked time."""

import random

from pyspark.sql import functions as F

from hindcast.plans import features as ft

AT = "timestamp_ntz '2020-01-01 00:00:00' + h * interval 1 hour"


def test_last_step_says_what_the_cutoff_would(spark):
    dice = random.Random(5)
    hour = lambda: dice.randrange(24 * 500)
    table = lambda rows, names, at: spark.createDataFrame(rows, f"{names}, h int").select("*", F.expr(AT).alias(at)).drop("h")
    acted = table([(0, dice.randrange(3), dice.randrange(12), hour()) for _ in range(60)], "repo_id long, user_id long, pr_id long", "ts")
    authored = table([(0, i % 3, i, hour()) for i in range(12)], "repo_id long, user_id long, pr_id long", "ts")
    heads = table([(i, f"s{n}", f"e{i}{n}", hour()) for i in range(12) for n in range(dice.randrange(3))], "pr_id long, head_sha string, start_event_id string", "start_ts")
    files = spark.createDataFrame(sorted({(i, f"s{n}", f"d{dice.randrange(4)}/f{k}") for i in range(12) for n in range(2) for k in range(3)}), "pr_id long, head_sha string, path string")
    asked = [(0, i, f"u{u}", u, h) for u in range(4) for i, h in enumerate(range(0, 24 * 700, 31))]  # the fourth never acts
    pairs = table(asked, "repo_id long, pr_id long, login string, user_id long", "cutoff")
    key, values = F.split_part(F.col("path"), F.lit("/"), F.lit(1)), ["distinct_keys", "scores"]
    steps = ft.footprint_steps(acted, authored, heads)
    assert steps.count() < len(asked) / 4
    facts = ft.footprint(ft.touched_files(steps, acted, authored, heads, files), key).select("repo_id", "user_id", "cutoff", *values)
    got = {(r.user_id, r.pr_id): (r.distinct_keys, r.scores) for r in ft.at_last_step(pairs, steps, facts, values).collect()}
    plain = ft.footprint(ft.touched_files(pairs, acted, authored, heads, files), key)
    want = {(r.user_id, r.pr_id): (r.distinct_keys, r.scores) for r in pairs.join(plain, ["repo_id", "user_id", "cutoff"], "left").collect()}
    assert got == want and any(v[0] for v in want.values()) and any(v[0] is None for v in want.values())


def test_affinity_reads_both_lists_on_the_row(spark):
    rows = spark.sql("""select * from values (1L, 'a', array(struct('x' as key, 0.5D as share), struct('y' as key, 0.5D as share)), map('x', 0.4D, 'z', 0.6D)),
        (1L, 'b', array(struct('x' as key, 0.5D as share), struct('y' as key, 0.5D as share)), cast(null as map<string, double>)), (2L, 'a', null, map('x', 1.0D)) as t(pr_id, login, shares, scores)""")
    assert sorted(map(tuple, ft.pair_affinity(rows).collect())) == [(1, "a", 1, 0.5, 0.2), (1, "b", 0, 0.0, 0.0), (2, "a", 0, 0.0, 0.0)]
