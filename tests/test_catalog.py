"""Registered queries against their SQL on the smallest tables."""

import pytest

from hindcast.catalog import load

QUERIES, ORACLE = load()
# One query per module keeps the suite short; tools/check.py runs them all.
SAMPLE = ["pr_file_upsert", "normalize_timeline", "membership_intervals", "asof_snapshot", "export_prs", "codeowners_rank", "popularity_rank",
          "truth_multi_policy", "pr_surface", "hybrid_membership", "stream_intervals"]


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    from check import canon, duck

    df = QUERIES[name](spark, sf_dir)
    cur = duck(sf_dir).execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, cur.fetchall())
