"""Truth policies with selectors against a plain evaluation of small evidence."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from hindcast.operators import policies as P
from hindcast.operators.truth import TruthPolicy

T0 = datetime(2024, 1, 1)
ROWS = "pr_id int, source string, target string, user_id int, login string, type string, ts timestamp, row_id string, label string"
EXTRA = [
    TruthPolicy("all_v1", 3600, P.SOURCES, selector="union"),
    TruthPolicy("last_v1", 1800, ("reviews", "review_comments"), selector="last"),
    TruthPolicy("nested_v1", 600, ("review_requests",), selector="priority_chain", fallback_chain=("last_v1", "hybrid_owner_v1")),
    TruthPolicy("union_first_v1", 900, ("events",), selector="priority_chain", fallback_chain=("first_approval_v1", "all_v1")),
]


def plain(rows, author, policy, known, width=None):
    """(branch, targets) by trying the branches one after the other."""
    def tried(p):
        if p.selector != "priority_chain":
            return [(p, p.sources, p.selector)]
        return [b for name in p.fallback_chain for b in tried(known[name])] + [(p, (s,), "first") for s in p.sources]

    for i, (p, sources, selector) in enumerate(tried(policy)):
        ok = []
        for _, source, target, user, login, kind, at, row_id, label in rows:
            seconds = (at - T0).total_seconds()
            wanted = p.review_states if source == "reviews" else p.params.get("event_types", ()) if source == "events" else ()
            bot = kind == "Bot" or (login or "").lower().endswith("[bot]")
            if source in sources and 0 < seconds <= (width or p.window_seconds) and (not wanted or label in wanted) \
                    and not (p.exclude_bots and bot) and not (p.exclude_author and user is not None and user == author):
                ok.append((at, row_id, target))
        if ok:
            return i, {x[2] for x in ok} if selector == "union" else {max(ok)[2] if selector == "last" else min(ok)[2]}
    return None, set()


def _evidence(seed, prs):
    rng = random.Random(seed)
    people = [(1, "ann", "User"), (2, "bob", None), (3, "fix[bot]", None), (4, "rob", "Bot"), (5, "Eve", "User")]
    out = []
    for pr in range(prs):
        for n in range(rng.randrange(7)):
            source = rng.choice(P.SOURCES)
            user, login, kind = rng.choice(people)
            label = {"reviews": rng.choice(["APPROVED", "COMMENTED"]), "events": rng.choice([P.MERGED, "pull_request.closed"])}.get(source, "")
            at = T0 + timedelta(seconds=rng.choice([-5, 0, 1, 60, 600, 601, 1800, 3600, 3601, 48 * 3600]))
            if source == "review_requests" and rng.random() < 0.4:
                out.append((pr, source, "team:core", None, None, None, at, "team:core", ""))
            else:
                out.append((pr, source, f"user:{login}", user, login, kind, at, f"{n}", label))
    return out + out[:3]  # repeated rows change nothing


@pytest.mark.parametrize("width", [None, 1200])
def test_selectors_equal_a_plain_evaluation(spark, width):
    prs, rows = 60, _evidence(3, 60)
    chosen = [*P.POLICIES, *EXTRA]
    known = {p.id: p for p in chosen}
    authors = {pr: [1, 5, None][pr % 3] for pr in range(prs)}
    cohort = spark.createDataFrame([(1, pr, T0, a) for pr, a in authors.items()], "repo_id int, pr_id int, cutoff timestamp, author_id int")
    got = {}
    for r in P.selected(cohort, spark.createDataFrame(rows, ROWS), chosen, width).collect():
        branch, targets = got.setdefault((r.pr_id, r.policy_id), (r.branch, set()))
        assert branch == r.branch and r.target not in targets
        targets.add(r.target)
    for pr in range(prs):
        own = [r for r in rows if r[0] == pr]
        for p in chosen:
            assert got.get((pr, p.id), (None, set())) == plain(own, authors[pr], p, known, width), (pr, p.id)


def test_statuses_and_missing_sources(spark):
    m = lambda n: T0 + timedelta(minutes=n)
    cohort = spark.createDataFrame([(1, 7, T0, 1), (2, 8, T0, 1)], "repo_id int, pr_id int, cutoff timestamp, author_id int")
    rows = spark.createDataFrame([(7, "events", "user:ann", 1, "ann", "User", m(5), "m", P.MERGED)], ROWS)
    horizons = spark.createDataFrame([(1, T0 + timedelta(days=9))], "repo_id int, horizon_max timestamp")
    gaps = spark.createDataFrame([], "repo_id int, resource string")
    got = {(r.pr_id, r.policy_id): (r.branch, r.target, r.status) for r in P.answers(cohort, rows, horizons, gaps, P.POLICIES).collect()}
    assert got[7, "merger_v1"] == (0, "user:ann", "observed")
    assert got[7, "hybrid_owner_v1"] == (1, "user:ann", "observed")
    assert got[7, "first_response_v1"] == (None, None, "no_post_cutoff_response")
    assert got[8, "first_response_v1"] == (None, None, "unknown_due_to_ingestion_gap")
    assert got[8, "merger_v1"] == (None, None, "no_post_cutoff_response")
    less = {(r.pr_id, r.policy_id): r.status for r in P.answers(cohort, rows, horizons, gaps, P.POLICIES, {"reviews", "review_comments"}).collect()}
    assert {p for (pr, p), s in less.items() if s == "policy_unavailable"} == {"merger_v1", "hybrid_owner_v1"}
    assert P.selected(cohort, rows.limit(0), P.POLICIES).count() == 0


def test_policies_that_cannot_be_resolved():
    a = TruthPolicy("a", selector="priority_chain", fallback_chain=("b",))
    b = replace(a, id="b", fallback_chain=("a",))
    with pytest.raises(ValueError, match="fall back on each other"):
        P.branches(a, {"a": a, "b": b})
    with pytest.raises(ValueError, match="unknown policy"):
        P.branches(a, {"a": a})
    with pytest.raises(ValueError, match="unknown source"):
        P.branches(TruthPolicy("c", sources=("votes",)), {})
