"""Reviewer rankers.  Each returns one row per (pull request, candidate) in rank order.

Schema: router_id, pr_id, rank, target_type, target_name, score, evidence, where
evidence is ``array<struct<kind, source_router, data map>>``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import text as X
from hindcast.functions.stats import decayed
from hindcast.operators.asof import within_days
from hindcast.operators.toplist import windowed_top, windowed_totals
from hindcast.session import stored

# --- fixed values -----------------------------------------------------------------
POPULARITY_DAYS = 180
UNION_DEPTH = 10
HYBRID_WEIGHTS = {"mentions": 1.0, "popularity": 0.8, "codeowners": 1.2, "stewards": 1.1}
EVENT_WEIGHTS = {"review_submitted": 1.0, "review_comment_created": 0.4, "comment_created": 0.2}
SCORE_WEIGHTS = {"boundary_overlap_activity": 1.0, "activity_total": 0.2}
HALF_LIFE_DAYS = 30.0
DECAY_DAYS = 180
MIN_ACTIVITY_TOTAL = 0.0
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.15, 0.05
_DAY = 86400
_ORIGIN = "timestamp_ntz '2000-01-01 00:00:00'"
SCORE_DIGITS = 9

_EVIDENCE = "array<struct<kind: string, source_router: string, data: map<string, string>>>"


def evidence(kind: str, **data: Column) -> Column:
    pairs = [c for k, v in data.items() for c in (F.lit(k), v.cast("string"))]
    return F.array(F.struct(
        F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("source_router"), F.create_map(*pairs).alias("data")
    )).cast(_EVIDENCE)


def _top(df: DataFrame, router_id: str, k: int, order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("pr_id").orderBy(*order))
    return (
        df.withColumn("rank", rank).filter(F.col("rank") <= k)
        .select(F.lit(router_id).alias("router_id"), "pr_id", "rank", "target_type", "target_name", "score", "evidence")
    )


def _by_score() -> list[Column]:
    return [F.round("score", SCORE_DIGITS).desc(), F.lower("target_name"), F.col("target_name"), F.col("target_type")]


def mentions(texts: DataFrame, k: int = 5) -> DataFrame:
    """``texts``: (pr_id, body as of the cutoff).  Score 1/(1+i) by order of appearance."""
    found = texts.select("pr_id", F.posexplode(F.slice(X.mention_targets(F.col("body")), 1, k)).alias("i", "t"))
    return found.select(
        F.lit("mentions").alias("router_id"), "pr_id", (F.col("i") + 1).alias("rank"), F.col("t.type").alias("target_type"),
        F.col("t.name").alias("target_name"), (1.0 / (1.0 + F.col("i"))).alias("score"),
        evidence("mention", source=F.lit("pr_body")).alias("evidence"))


def participation(reviews: DataFrame, comments: DataFrame, users: DataFrame) -> DataFrame:
    """Review and comment activity with the acting user: (repo_id, pr_id, login, type, ts, kind)."""
    acted = reviews.filter(F.col("submitted_at").isNotNull()).select(
        "repo_id", "pr_id", "user_id", F.col("submitted_at").alias("ts"), F.lit("review_submitted").alias("kind"),
        F.col("review_id").alias("row_id"),
    ).unionByName(
        comments.filter(F.col("pr_id").isNotNull() & F.col("created_at").isNotNull()).select(
            "repo_id", "pr_id", "user_id", F.col("created_at").alias("ts"),
            X.activity_kind(F.col("comment_type"), F.col("review_id")).alias("kind"), F.col("comment_id").alias("row_id"))
    )
    people = users.filter(F.col("login").isNotNull()).select("user_id", "login", "type")
    return acted.join(people, "user_id")


def popularity(cohort: DataFrame, activity: DataFrame, k: int = 5, days: int = POPULARITY_DAYS,
               bucket_seconds: int = 3600) -> DataFrame:
    """Most active participants of the repository in the window; the author steps aside.

    ``cohort``: (repo_id, pr_id, cutoff, author_login).  One more than k members
    are kept per cutoff because the author may be among them.
    """
    rows = cohort.select("repo_id", "pr_id", "cutoff", "author_login")
    listed = with_popular(rows, rows, activity, k, days, bucket_seconds)
    rows = listed.select("pr_id", F.posexplode("popularity")).toDF("pr_id", "i", "m")
    return rows.select(
        F.lit("popularity").alias("router_id"), "pr_id", (F.col("i") + 1).alias("rank"), F.lit("user").alias("target_type"),
        F.col("m.target_name").alias("target_name"), F.col("m.score").alias("score"),
        evidence("popularity", count=F.col("m.hits"), lookback_days=F.lit(days)).alias("evidence"))


def with_popular(rows: DataFrame, cutoffs: DataFrame, activity: DataFrame, k: int, days: int = POPULARITY_DAYS,
                 bucket_seconds: int = 3600) -> DataFrame:
    """``rows`` (repo_id, cutoff, author_login and whatever else) with the array ``popularity`` of the k most active.

    The rows come to the best of their cutoff, one of ``cutoffs``; the names move no further.
    """
    counted = activity.filter(F.col("type").isNull() | (F.col("type") != "Bot")).select(
        "repo_id", "login", "ts", F.lit(1).cast("bigint").alias("value"))
    best = windowed_top(cutoffs, counted, ["repo_id"], "login", k + 1, days * _DAY, bucket_seconds)
    # At most k + 1 members a cutoff, in rank order: each pull request only skips its author.
    ranked = best.groupBy("repo_id", "cutoff").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("down"), F.col("login").alias("login")))).alias("_best"))
    author = F.lower(F.coalesce("author_login", F.lit("")))
    met = rows.withColumn("_author", author).join(ranked, ["repo_id", "cutoff"], "left")
    others = met.withColumn("_best", F.slice(F.filter("_best", lambda m: F.lower(m.login) != F.col("_author")), 1, k))
    entry = lambda m: listed_target(F.lit("user"), m.login, m.down / F.col("_best")[0].down, -m.down)
    return others.withColumn("popularity", F.transform("_best", entry)).drop("_best", "_author")


def listed_target(target_type: Column, target_name: Column, score: Column, hits: Column) -> Column:
    """A member of a source's list; ``hits`` is what the score counts (1 for a mention)."""
    return F.struct(target_type.alias("target_type"), target_name.alias("target_name"), score.cast("double").alias("score"), hits.cast("bigint").alias("hits"))


def mention_lists(texts: DataFrame, k: int) -> DataFrame:
    """(pr_id, mentions): what ``mentions`` ranks, as one list."""
    found = F.slice(X.mention_targets(F.col("body")), 1, k)
    return texts.select("pr_id", F.transform(found, lambda t, i: listed_target(
        t["type"], t["name"], F.lit(1.0) / (F.lit(1.0) + i), F.lit(1))).alias("mentions"))


def codeowner_lists(owned: DataFrame, k: int) -> DataFrame:
    """(pr_id, codeowners) from (pr_id, targets), one row per file: what ``codeowners`` ranks, as one list."""
    all_targets = owned.groupBy("pr_id").agg(F.flatten(F.collect_list("targets")).alias("all"))
    tuples = all_targets.withColumn("who", F.array_distinct(F.transform("all", lambda t: F.struct(t.type.alias("type"), t["name"].alias("name")))))

    def counted(who: Column) -> Column:
        same = F.filter("all", lambda t: (t.type == who.type) & (t["name"] == who["name"]))
        return F.struct((-F.aggregate(same, F.lit(0).cast("bigint"), lambda a, t: a + t.n)).alias("down"), F.lower(who["name"]).alias("l"),
                        who["name"].alias("name"), who.type.alias("type"))

    best = tuples.select("pr_id", F.slice(F.sort_array(F.transform("who", counted)), 1, k).alias("best"))
    return best.select("pr_id", F.transform("best", lambda b: listed_target(b.type, b["name"], -b.down, -b.down)).alias("codeowners"))


_MEMBERS = "array<struct<target_type: string, target_name: string, score: double, sources: array<string>, hits: bigint>>"


def merged_lists(rows: DataFrame, sources: list[str], k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """``union`` and ``hybrid`` on the row of the pull request, from the list columns named ``sources``.

    Adds ``union`` and, cut out of it, ``hybrid_ranker``, both with k members (target_type, target_name, score, sources,
    hits: pieces of evidence) in rank order.
    """
    lowered = [F.transform(s, lambda m: F.lower(m.target_name)).alias(f"_{s}") for s in sources]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in sources)
    lists = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in sources)
    kernel = _merge(sorted(sources), max(k, UNION_DEPTH), k, weights or HYBRID_WEIGHTS)
    named = rows.select(*[c for c in rows.columns if c not in sources], *[c for c in rows.columns if c in sources], *lowered)
    return named.mapInArrow(kernel, f"{schema}, {lists}, union {_MEMBERS}, hybrid_ranker {_MEMBERS}")


def _merge(sources: list[str], depth: int, k: int, weights: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge the lists of all rows of a batch at once; what ``union`` and ``hybrid`` do with rows."""
    scale = 10**SCORE_DIGITS
    sets = [[s for i, s in enumerate(sources) if mask >> i & 1] for mask in range(1 << len(sources))]
    weight = np.array([sum([weights.get(s, 0.0) for s in by]) for by in sets])
    count = np.array([float(len(by)) for by in sets])

    def rounded(x: np.ndarray) -> np.ndarray:
        """Scores in units of the last digit; halves go away from zero, as in SQL."""
        units = x * scale
        near = np.flatnonzero(np.abs(units - np.floor(units) - 0.5) < 1e-3)
        whole = np.rint(units).astype(np.int64)
        whole[near] = [int((Decimal(repr(float(v))) * scale).to_integral_value(ROUND_HALF_UP)) for v in x[near]]
        return whole

    def places(names: pa.Array) -> np.ndarray:
        """The place of each text in the order of all."""
        coded = names.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows, source, rank = [], [], [], []
            for i, s in enumerate(sources):
                long = np.asarray(pc.fill_null(pc.list_value_length(batch.column(s)), 0)).astype(np.int64)
                at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                taken = np.flatnonzero(at < depth)
                members, lowered = batch.column(s).flatten().take(pa.array(taken)), batch.column(f"_{s}").flatten().take(pa.array(taken))
                parts.append([*[members.field(f) for f in ("target_type", "target_name", "score", "hits")], lowered])
                rows.append(np.repeat(np.arange(batch.num_rows), long)[taken])
                source.append(np.full(len(taken), i))
                rank.append(at[taken])
            kind, name, score, hits, low = (pa.concat_arrays(p) for p in zip(*parts))
            row, source, rank, score = np.concatenate(rows), np.concatenate(source), np.concatenate(rank), score.to_numpy(zero_copy_only=False)
            hits = np.where(source == (sources.index("codeowners") if "codeowners" in sources else -1), hits.to_numpy(zero_copy_only=False), 1).astype(np.int64)
            kinds, lows, names = places(kind), places(low), places(name)
            order = np.lexsort((rank, source, kinds, lows, row))
            starts = np.flatnonzero(np.concatenate([[True], np.any([np.diff(c[order]) != 0 for c in (row, lows, kinds)], axis=0)]))[: len(order)]
            if len(order):
                # The first source in name order, and its best rank, give the name.
                first, ordered = order[starts], score[order]
                mask = np.bitwise_or.reduceat(1 << source[order], starts)
                total = count[mask] * 10.0 + np.maximum.reduceat(ordered, starts) + np.add.reduceat(ordered, starts) * 0.01
                pieces = np.add.reduceat(hits[order], starts)
            else:
                first, mask, total, pieces = order, order, score, hits
            fields = {"target_type": kind.take(pa.array(first)), "target_name": name.take(pa.array(first))}
            tie = (kinds[first], names[first], lows[first])

            def best(chosen: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, pa.Array]:
                """The k best of each row among the ``chosen`` members, and the list column they make."""
                by = chosen[np.lexsort((*[t[chosen] for t in tie], -rounded(total[chosen]), row[first][chosen]))]  # noqa: B023
                many = np.bincount(row[first][by], minlength=batch.num_rows)  # noqa: B023
                by = by[np.arange(len(by)) - np.repeat(np.cumsum(many) - many, many) < k]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.minimum(many, k))]).astype(np.int32))
                taken = pa.array(by)
                listed = [fields["target_type"].take(taken), fields["target_name"].take(taken), pa.array(total[by]),  # noqa: B023
                          pa.array(sets, pa.list_(pa.string())).take(pa.array(mask[by])), pa.array(pieces[by])]  # noqa: B023
                return by, pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(listed, ["target_type", "target_name", "score", "sources", "hits"]))

            top, union = best(np.arange(len(first)), total)
            _, hybrid = best(top, weight[mask] * 10.0 + total)
            kept = [n for n in batch.schema.names if n not in {f"_{s}" for s in sources}]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], union, hybrid], [*kept, "union", "hybrid_ranker"])

    return run


def codeowners(hits: DataFrame, k: int = 5) -> DataFrame:
    """``hits``: (pr_id, path, pattern, target_type, target_name).  Score: number of (file, rule) hits."""
    rows = hits.groupBy("pr_id", "target_type", "target_name").agg(
        F.count("*").cast("double").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "pattern"))), lambda h: F.struct(
            F.lit("codeowners").alias("kind"), F.lit(None).cast("string").alias("source_router"),
            F.create_map(F.lit("pattern"), h.pattern, F.lit("path"), h.path).alias("data"))).cast(_EVIDENCE).alias("evidence"))
    return _top(rows, "codeowners", k, _by_score())


def stewards(cohort: DataFrame, activity: DataFrame, event_paths: DataFrame, cohort_paths: DataFrame, k: int = 5,
             bucket_seconds: int = 3600) -> DataFrame:
    """Decayed recent activity plus decayed activity on pull requests that share a file.

    ``event_paths``: activity rows with the ids ``paths`` of the files at the head of
    their own time; ``cohort_paths``: (repo_id, pr_id, cutoff, paths).  A pull request and an
    act meet at every path they share and count at the smallest one, so pairs are added up
    where they meet and never move.

    The decay of all activity at a cutoff has one common factor, so totals are
    sums of undecayed growth weights and the windowed top list applies.  A user
    without shared-file activity can only rank by the total, hence the k+1 best
    totals and everybody with shared-file activity are all that can matter.
    """
    human = ~X.is_bot(F.col("type"), F.col("login"))
    weight = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(w)) for kind, w in EVENT_WEIGHTS.items()])
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days_from = lambda c: (micros(c) - micros(F.expr(_ORIGIN))) / (_DAY * 1e6)
    growth = lambda c: F.pow(F.lit(2.0), days_from(c) / HALF_LIFE_DAYS)

    grown = activity.filter(human).select("repo_id", "login", "ts", (weight * growth(F.col("ts"))).alias("value"))
    best = windowed_top(cohort, grown, ["repo_id"], "login", k + 1, DECAY_DAYS * _DAY, bucket_seconds).withColumnRenamed("total", "grown")

    met = within_days(
        cohort_paths.select("repo_id", "pr_id", "cutoff", F.col("paths").alias("_mine"), F.explode("paths").alias("_path")),
        event_paths.filter(human).select("repo_id", "login", "ts", weight.alias("_weight"), F.col("paths").alias("_theirs"), F.explode("paths").alias("_path")),
        ["repo_id", "_path"], "cutoff", "ts", DECAY_DAYS)
    age = (micros(F.col("cutoff")) - micros(F.col("ts"))) / (_DAY * 1e6)
    # Read by the totals and by the scores.
    shared = stored(
        met.filter(F.col("_path") == F.array_min(F.array_intersect("_mine", "_theirs")))
        .groupBy("repo_id", "pr_id", "cutoff", "login").agg(F.sum(decayed(F.col("_weight"), age, HALF_LIFE_DAYS)).alias("overlap")))
    totals = windowed_totals(shared.select("repo_id", "login", "cutoff"), grown, ["repo_id", "login"], DECAY_DAYS * _DAY, out="grown")
    with_overlap = shared.join(totals, ["repo_id", "login", "cutoff"])
    without = cohort.select("repo_id", "pr_id", "cutoff").join(best, ["repo_id", "cutoff"]).withColumn("overlap", F.lit(0.0))
    merged = (
        with_overlap.select("repo_id", "pr_id", "cutoff", "login", "grown", "overlap")
        .unionByName(without.select("repo_id", "pr_id", "cutoff", "login", "grown", "overlap"))
        .groupBy("repo_id", "pr_id", "cutoff", "login").agg(F.max("grown").alias("grown"), F.max("overlap").alias("overlap"))
        .join(cohort.select("pr_id", "author_login"), "pr_id")
        .filter(F.lower("login") != F.lower(F.coalesce("author_login", F.lit(""))))
        .withColumn("activity_total", F.col("grown") / growth(F.col("cutoff")))
        .filter(F.col("activity_total") >= MIN_ACTIVITY_TOTAL)
        .withColumn("score", SCORE_WEIGHTS["boundary_overlap_activity"] * F.col("overlap")
                    + SCORE_WEIGHTS["activity_total"] * F.col("activity_total"))
        .withColumn("target_type", F.lit("user")).withColumnRenamed("login", "target_name")
        .withColumn("evidence", evidence("activity_totals", activity_total=F.col("activity_total"),
                                         boundary_overlap_activity=F.col("overlap"), half_life_days=F.lit(HALF_LIFE_DAYS)))
    )
    return _top(merged, "stewards", k, _by_score())


def confidence(routes: DataFrame) -> DataFrame:
    """(pr_id, confidence) from the margin between the two best scores."""
    score = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    margin = score(1) - F.coalesce(score(2), F.lit(0.0))
    return routes.groupBy("pr_id").agg(
        F.when(margin >= CONFIDENCE_HIGH, "high").when(margin >= CONFIDENCE_MEDIUM, "medium").otherwise("low").alias("confidence"))


def risk(missing_any_gate: Column, has_boundaries: Column, has_candidates: Column) -> Column:
    return F.when(missing_any_gate | ~has_boundaries | ~has_candidates, "high").otherwise("medium")


def suggest_labels(missing_issue: Column, missing_ai: Column, missing_provenance: Column, risk_level: Column,
                   has_candidates: Column, boundaries: Column | None = None) -> Column:
    """Labels a bot would put on the pull request, in a fixed order."""
    base = F.array_compact(F.array(
        F.when(missing_issue, "needs-issue-link"),
        F.when(missing_ai, "needs-ai-disclosure"),
        F.when(missing_provenance, "needs-provenance"),
        F.when(risk_level == "high", "routed-high-risk"),
        F.when(has_candidates, "suggested-steward-review"),
    ))
    if boundaries is None:
        return base
    ordered = F.transform(
        F.array_sort(F.transform(F.array_distinct(boundaries), lambda b: F.struct(F.lower(b).alias("l"), b.alias("b")))),
        lambda s: F.concat(F.lit("routed-boundary:"), s.b))
    return F.concat(base, ordered)


def union(sources: list[DataFrame], k: int = 5, router_id: str = "union") -> DataFrame:
    """Merge rankers: 10 per source, plus the best score, plus a hundredth of the sum.

    Sources must be ranked to a depth of ``max(k, 10)``; the result depends on it.
    """
    merged = sources[0]
    for s in sources[1:]:
        merged = merged.unionByName(s)
    depth = max(k, UNION_DEPTH)
    tagged = F.transform("evidence", lambda e: F.struct(
        e.kind.alias("kind"), F.coalesce(e.source_router, F.col("router_id")).alias("source_router"), e.data.alias("data")))
    rows = (
        merged.filter(F.col("rank") <= depth)
        .groupBy("pr_id", "target_type", F.lower("target_name").alias("_key"))
        .agg(
            F.min_by("target_name", F.struct("router_id", "rank")).alias("target_name"),
            (F.count_distinct("router_id") * 10.0 + F.max("score") + F.sum("score") * 0.01).alias("score"),
            F.flatten(F.transform(
                F.collect_list(F.struct("router_id", tagged.cast(_EVIDENCE).alias("e"))), lambda s: s.e)).alias("evidence"),
        )
    )
    return _top(rows, router_id, k, _by_score())


def hybrid(union_routes: DataFrame, weights: dict[str, float] | None = None, k: int = 5) -> DataFrame:
    """Union candidates re-scored by the summed weight of the rankers that named them."""
    weights = weights or HYBRID_WEIGHTS
    table = F.create_map(*[c for n, w in weights.items() for c in (F.lit(n), F.lit(w))])
    sources = F.array_distinct(F.transform("evidence", lambda e: e.source_router))
    total = F.aggregate(sources, F.lit(0.0), lambda a, s: a + F.coalesce(F.try_element_at(table, s), F.lit(0.0)))
    rows = union_routes.withColumn("score", total * 10.0 + F.col("score")).withColumn(
        "evidence", F.concat("evidence", evidence("hybrid_ranker", sources=F.array_join(F.array_sort(sources), ","))))
    return _top(rows, "hybrid_ranker", k, _by_score())


def rerank(union_routes: DataFrame, scores: DataFrame, k: int = 5, router_id: str = "external_rerank") -> DataFrame:
    """Re-rank union candidates by scores from outside.

    ``scores``: (pr_id, target_type, target_name, score).  Targets outside the
    union are dropped, candidates without a score too; a pull request that got
    no usable score keeps its union order.
    """
    given = scores.select("pr_id", "target_type", F.lower("target_name").alias("_key"), F.col("score").alias("_given"))
    joined = union_routes.withColumn("_key", F.lower("target_name")).join(given, ["pr_id", "target_type", "_key"], "left")
    return _top(_usable(joined), router_id, k, _by_score())


def reranked(rows: DataFrame, k: int = 5) -> DataFrame:
    """``rerank`` of union rows that carry their score from outside as ``_given``."""
    order = Window.partitionBy("pr_id").orderBy(*_by_score())
    return _usable(rows).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with a score from outside, or all of them where a pull request got none."""
    return (
        rows.withColumn("_any", F.max(F.col("_given").isNotNull()).over(Window.partitionBy("pr_id")))
        .filter(~F.col("_any") | F.col("_given").isNotNull())
        .withColumn("score", F.coalesce("_given", "score"))
    )
