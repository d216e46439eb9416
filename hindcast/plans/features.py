"""Feature families at the cutoff: one row per pull request, or per (pull request, candidate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import paths as P
from hindcast.functions import text as X
from hindcast.functions.stats import grouped_entropy, response_bucket, safe_ratio, seconds_between, zscore
from hindcast.operators import activity as act
from hindcast.operators.asof import within_days
from hindcast.session import stored

FOOTPRINT_N = 12
WINDOWS = [7, 30, 90, 180]


# --- pull request surface -----------------------------------------------------------
def surface_files(files: DataFrame) -> DataFrame:
    """Churn, structure and hints from the files at the cutoff (pr_id, path, status, additions, deletions, changes).

    Entropies come from counts per (pull request, dimension, key): every level
    combines before the shuffle, however many files one pull request touches.
    """
    p = F.col("path")
    sized = files.withColumn(
        "churn", F.when(F.coalesce("changes", F.lit(0)) != 0, F.col("changes"))
        .otherwise(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0)))
    ).withColumn("bucket", P.status_bucket(F.col("status")))
    share = lambda s: safe_ratio(F.count(F.when(F.col("bucket") == s, 1)), F.count("*"))
    base = sized.groupBy("pr_id").agg(
        F.count("*").alias("file_count"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.sum("churn").alias("churn"), F.max("churn").alias("max_file_churn"),
        F.percentile("churn", 0.5).alias("median_file_churn"), F.percentile("churn", 0.9).alias("churn_p90"),
        *[share(s).alias(f"ratio_{s}") for s in ("added", "modified", "deleted", "renamed")],
        F.max(P.touches_tests(p)).alias("touches_tests"), F.max(P.touches_docs(p)).alias("touches_docs"),
        F.max(P.touches_ci(p)).alias("touches_ci_build"), F.max(P.is_generated(p)).alias("includes_generated"),
        F.count(F.when(P.is_binary(p), 1)).alias("binary_files"),
        F.count(F.when(F.col("churn") >= P.LARGE_FILE_CHURN, 1)).alias("large_files"),
    )
    dims = {"depth2": P.directory(p, 2), "depth3": P.directory(p, 3), "depth4": P.directory(p, 4),
            "extension": P.extension(p), "boundary": P.boundary_id(p)}
    keyed = files.select("pr_id", F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("key")) for d, c in dims.items()])))
    counts = keyed.groupBy("pr_id", "dim", "key").agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("pr_id", "dim")))
    stats = shares.groupBy("pr_id", "dim").agg(
        F.count("*").alias("k"), grouped_entropy(F.col("p")).alias("h"), F.max("p").alias("top"), F.max("n").alias("largest"))
    pick = lambda d, c: F.max(F.when(F.col("dim") == d, F.col(c)))
    wide = stats.groupBy("pr_id").agg(
        *[pick(d, "k").alias(f"distinct_{d}") for d in dims], *[pick(d, "h").alias(f"entropy_{d}") for d in dims],
        pick("extension", "top").alias("top_extension_share"), pick("boundary", "top").alias("boundary_top_share"),
        pick("boundary", "largest").alias("max_files_in_boundary"))
    return base.join(wide, "pr_id").withColumn("is_multi_boundary", F.col("distinct_boundary") > 1)


def surface_text(texts: DataFrame) -> DataFrame:
    """Length, hints, mentions, links and gates of the title and the whole body."""
    title, body = X.text_or_empty(F.col("title")), X.text_or_empty(F.col("body"))
    both = F.concat_ws("\n", title, body)
    stripped = X.strip(body)
    ids = X.mention_ids(both)
    missing = [X.gate_issue(body).isNull(), X.gate_ai_disclosure(body).isNull(), X.gate_provenance(body).isNull()]
    n_missing = sum((m.cast("bigint") for m in missing[1:]), missing[0].cast("bigint"))
    return texts.select(
        "pr_id", F.length(X.strip(title)).cast("bigint").alias("title_chars"), F.length(stripped).cast("bigint").alias("body_chars"),
        (F.length(stripped) <= 20).alias("body_is_emptyish"), X.title_is_wip(title).alias("wip_signal"),
        X.title_is_hotfix(title).alias("hotfix_signal"), F.size(ids).cast("bigint").alias("mentions"),
        F.size(F.array_distinct(F.filter(ids, lambda m: ~m.contains("/")))).cast("bigint").alias("mentioned_users"),
        F.size(F.array_distinct(F.filter(ids, lambda m: m.contains("/")))).cast("bigint").alias("mentioned_teams"),
        X.count_urls(stripped).alias("urls"), X.count_issue_refs(both).alias("issue_refs"),
        ((3 - n_missing) / 3.0).alias("gate_completeness"), n_missing.alias("gates_missing"),
        (~missing[1]).alias("has_ai_disclosure"), (~missing[2]).alias("has_provenance"),
        stripped.rlike(X.CHECKLIST).alias("has_checklist"), stripped.rlike(X.RISK_SECTION).alias("has_risk_section"))


def pr_surface(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Text features for every pull request; file features are zero where no file is known."""
    f = surface_files(files)
    joined = surface_text(texts).join(f, "pr_id", "left")
    kinds = {n: t for n, t in f.dtypes if n not in ("pr_id",)}
    return joined.select(*[
        F.coalesce(c, F.lit(False if kinds[c] == "boolean" else 0).cast(kinds[c])).alias(c) if c in kinds else F.col(c)
        for c in joined.columns])


# --- timeline and attention -----------------------------------------------------------
def pr_timeline(cohort: DataFrame, heads: DataFrame, comments: DataFrame, reviews: DataFrame, requests: DataFrame,
                drafts: DataFrame, users: DataFrame) -> DataFrame:
    """Trajectory, attention and request features before the cutoff.

    Each source is joined by pull request, cut at the cutoff and aggregated once.
    ``heads``/``requests``/``drafts`` are interval tables.
    """
    ids = cohort.select("pr_id", "cutoff", "author_id", "created_at")
    at = F.col("cutoff")
    within = lambda c, n, unit: F.count(F.when(F.col(c) >= at - F.expr(f"interval '{n}' {unit}"), 1))
    head = ids.join(heads.select("pr_id", "start_ts"), "pr_id").filter(F.col("start_ts") <= at).groupBy("pr_id", "cutoff").agg(
        F.count("*").alias("head_updates"), within("start_ts", 1, "day").alias("head_updates_1d"),
        within("start_ts", 7, "day").alias("head_updates_7d"), within("start_ts", 30, "day").alias("head_updates_30d"),
        within("start_ts", 6, "hour").alias("head_updates_6h"), F.max("start_ts").alias("last_head"),
    ).withColumn("seconds_since_head_update", seconds_between(at, F.col("last_head"))).drop("cutoff", "last_head")
    is_author = F.col("author_id").isNotNull() & (F.col("user_id") == F.col("author_id"))
    kinds = users.select("user_id", "login", F.lower(F.coalesce("type", F.lit("User"))).alias("utype"))
    said = ids.join(comments.select("pr_id", "user_id", F.col("created_at").alias("ts")), "pr_id").filter(F.col("ts") <= at)
    talk = said.join(kinds, "user_id", "left").groupBy("pr_id").agg(
        F.count(F.when(is_author, 1)).alias("author_comments"), F.count(F.when(~is_author, 1)).alias("non_author_comments"),
        F.count(F.when(F.col("utype") == "bot", 1)).alias("bot_comments"),
        F.count(F.when(F.col("utype").isNotNull() & (F.col("utype") != "bot"), 1)).alias("human_comments"))
    looked = ids.join(reviews.select("pr_id", "user_id", "state", F.col("submitted_at").alias("ts")), "pr_id").filter(F.col("ts") <= at)
    bucket = X.review_bucket(F.col("state"))
    judged = looked.groupBy("pr_id").agg(
        F.count("*").alias("reviews"), *[F.count(F.when(bucket == b, 1)).alias(f"reviews_{b}") for b in ("approve", "comment", "changes_requested")])
    people = (
        said.select("pr_id", "user_id").unionByName(looked.select("pr_id", "user_id")).distinct()
        .join(kinds.filter(F.col("login").isNotNull()).select("user_id", F.lower("login").alias("l")), "user_id")
        .groupBy("pr_id").agg(F.count_distinct("l").alias("participants")))
    asked = ids.join(requests.select("pr_id", "reviewer_type", "start_ts", "end_ts"), "pr_id").groupBy("pr_id").agg(
        F.count(F.when(F.col("start_ts") <= at, 1)).alias("request_adds"), F.count(F.when(F.col("end_ts") <= at, 1)).alias("request_removes"),
        *[F.count(F.when((F.col("start_ts") <= at) & (F.col("end_ts").isNull() | (at < F.col("end_ts"))) & (F.lower("reviewer_type") == k), 1)).alias(f"requested_{k}s")
          for k in ("user", "team")])
    from hindcast.operators.asof import state_at

    draft = state_at(ids.select("pr_id", "cutoff"), drafts, ["pr_id"], ["is_draft"], ["pr_id"]).select("pr_id", "is_draft")
    out = ids
    for part in (head, talk, judged, people, asked, draft):
        out = out.join(part, "pr_id", "left")
    zero = [c for c in out.columns if c not in ("pr_id", "cutoff", "author_id", "created_at", "seconds_since_head_update", "is_draft")]
    out = out.select("pr_id", "cutoff", "author_id", "created_at", "seconds_since_head_update", F.coalesce("is_draft", F.lit(False)).alias("is_draft"),
                     *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])
    total = F.col("non_author_comments") + F.col("reviews")
    term = lambda c: F.when(F.col(c) > 0, -(F.col(c) / total) * F.log(F.col(c) / total)).otherwise(0.0)
    others = F.greatest(F.col("participants") - F.when(F.col("author_id").isNotNull(), 1).otherwise(0), F.lit(0))
    return out.select(
        *[c for c in out.columns if c not in ("author_id", "created_at", "head_updates_6h")],
        seconds_between(at, F.col("created_at")).alias("age_seconds"),
        safe_ratio(F.col("head_updates_6h"), F.col("head_updates")).alias("update_burstiness"),
        others.alias("non_author_participants"),
        F.when(total > 0, (term("non_author_comments") + term("reviews")) / F.log(F.lit(2.0))).otherwise(0.0).alias("attention_entropy"),
        (others == 0).alias("no_attention"), (F.col("requested_users") + F.col("requested_teams") == 0).alias("no_active_requests"),
        ((F.col("author_comments") == 0) & (F.col("head_updates_1d") == 0)).alias("no_recent_author_followup"))


# --- ownership ------------------------------------------------------------------------
def pr_ownership(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Coverage and concentration of owners over the changed files."""
    total = files.groupBy("pr_id").agg(F.count_distinct("path").alias("files"), F.count_distinct(P.boundary_id(F.col("path"))).alias("boundaries"))
    owners = hits.select("pr_id", "path", "target_name").distinct()
    per_file = owners.groupBy("pr_id", "path").agg(F.count("*").alias("n")).groupBy("pr_id").agg(
        F.count("*").alias("owned_files"), F.max("n").alias("max_owners_on_file"))
    per_owner = owners.groupBy("pr_id", "target_name").agg(F.count("*").alias("n")).groupBy("pr_id").agg(
        F.count("*").alias("owner_set_size"), F.max("n").alias("top_files"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = total.join(per_file, "pr_id", "left").join(per_owner, "pr_id", "left")
    coverage = safe_ratio(z("owned_files"), F.col("files"))
    return joined.select(
        "pr_id", z("owner_set_size").alias("owner_set_size"), coverage.alias("owner_coverage"), (z("owned_files") == 0).alias("zero_owner"),
        z("max_owners_on_file").alias("max_owners_on_file"), safe_ratio(z("top_files"), z("owned_files")).alias("top_owner_share"),
        ((F.col("boundaries") > 1) & (((z("owner_set_size") >= 5) & (coverage < 0.5)) | (z("max_owners_on_file") >= 3))).alias("conflicting_ownership"))


# --- automation -------------------------------------------------------------------------
def automation(cohort: DataFrame, comments: DataFrame, users: DataFrame) -> DataFrame:
    """Bot comments before the cutoff and what they were about."""
    rows = (
        cohort.select("pr_id", "cutoff").join(comments.select("pr_id", "user_id", "body", F.col("created_at").alias("ts")), "pr_id")
        .filter(F.col("ts") <= F.col("cutoff")).join(users.select("user_id", "login"), "user_id", "left")
        .withColumn("l", F.lower(F.coalesce("login", F.lit(""))))
    )
    bot, text = F.col("l").rlike(X.BOT_AUTHOR), F.concat_ws("\n", F.col("l"), F.coalesce("body", F.lit("")))
    counted = rows.groupBy("pr_id").agg(
        F.count(F.when(bot, 1)).alias("bot_comments"), F.count_distinct(F.when(bot & (F.col("l") != ""), F.col("l"))).alias("bot_authors"),
        *[F.count(F.when(text.rlike(rx), 1)).alias(f"category_{k}") for k, rx in X.BOT_CATEGORIES.items()])
    out = cohort.select("pr_id").join(counted, "pr_id", "left")
    return out.select("pr_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "pr_id"])


# --- repository priors --------------------------------------------------------------------
def repo_priors(cohort: DataFrame, prs: DataFrame, heads: DataFrame, files: DataFrame, requests: DataFrame,
                acted: DataFrame, days: int = 180) -> DataFrame:
    """What is usual in the repository: means, spread and rates over its recent pull requests.

    A pull request counts from its creation for ``days``; its file count is that
    of the head at the asked time.  Everything is a sum over spans of time, so
    the cost is linear in pull requests and cutoffs.  ``request_rate`` looks at
    requests of any time, as the history this reproduces does.
    """
    window = F.expr(f"interval '{days}' day")
    life = prs.select("repo_id", "pr_id", F.col("created_at").alias("born"), (F.col("created_at") + window).alias("dies"))
    sizes = files.groupBy("pr_id", "head_sha").agg(F.count("*").alias("n"), F.sum(F.coalesce("changes", F.lit(0))).alias("c"))
    zero = {v: F.lit(0).cast("bigint").alias(v) for v in ("prs", "files", "files2", "churn", "churn2", "requested", "events", "bots")}

    def span(df: DataFrame, start: Column, end: Column, closed: Column, **values: Column) -> DataFrame:
        cols = [values[v].cast("bigint").alias(v) if v in values else zero[v] for v in zero]
        return df.select("repo_id", start.alias("_from"), end.alias("_to"), closed.alias("_closed"), *cols).filter("_from < _to or (_closed and _from = _to)")

    one = F.lit(1)
    spans = span(life, F.col("born"), F.col("dies"), F.lit(True), prs=one)
    asked = life.join(requests.select("pr_id").distinct(), "pr_id", "left_semi")
    spans = spans.unionByName(span(asked, F.col("born"), F.col("dies"), F.lit(True), requested=one))
    shaped = life.join(heads.select("pr_id", "head_sha", "start_ts", "end_ts"), "pr_id").join(sizes, ["pr_id", "head_sha"])
    until = F.least(F.coalesce("end_ts", "dies"), F.col("dies"))
    spans = spans.unionByName(span(
        shaped, F.greatest("start_ts", "born"), until, F.col("end_ts").isNull() | (F.col("end_ts") > F.col("dies")),
        files=F.col("n"), files2=F.col("n") * F.col("n"), churn=F.col("c"), churn2=F.col("c") * F.col("c")))
    seen = life.join(acted.select("pr_id", "ts", (F.lower(F.coalesce("type", F.lit("User"))) == "bot").alias("bot")), "pr_id")
    spans = spans.unionByName(span(seen, F.greatest("ts", "born"), F.col("dies"), F.lit(True), events=one, bots=F.col("bot").cast("bigint")))
    sums = act.span_sums(cohort.select("repo_id", "cutoff"), spans, ["repo_id"], "_from", "_to", "_closed", list(zero))
    mean = lambda v: safe_ratio(F.col(v), F.col("prs"))
    sd = lambda v: F.sqrt(F.greatest(F.col("prs") * F.col(f"{v}2") - F.col(v) * F.col(v), F.lit(0)).cast("double")) / F.col("prs")
    return sums.select(
        "repo_id", "cutoff", F.col("prs").alias("recent_prs"), mean("files").alias("mean_files"), mean("churn").alias("mean_churn"),
        F.when(F.col("prs") > 0, sd("files")).otherwise(0.0).alias("sd_files"), F.when(F.col("prs") > 0, sd("churn")).otherwise(0.0).alias("sd_churn"),
        safe_ratio(F.col("requested"), F.col("prs")).alias("request_rate"), safe_ratio(F.col("bots"), F.col("events")).alias("bot_activity_rate"))


def repo_medians(cohort: DataFrame, prs: DataFrame, heads: DataFrame, files: DataFrame, reviews: DataFrame, owned: DataFrame,
                 days: int = 180) -> DataFrame:
    """Medians of files, churn and seconds to the first review of the recent pull requests, and their mean owner coverage.

    ``owned``: (pr_id, head_sha, n, hits), the paths of a head whose repository has ownership rules, and how many of them have an owner.
    Pull requests without files count as 0, those without a review do not count; a repository
    without a reviewed pull request has no median time.
    """
    from hindcast.operators.quantiles import open_medians

    window = F.expr(f"interval '{days}' day")
    life = prs.select("repo_id", "pr_id", F.col("created_at").alias("born"), (F.col("created_at") + window).alias("dies"))
    sizes = files.groupBy("pr_id", "head_sha").agg(F.count("*").alias("files"), F.sum(F.coalesce("changes", F.lit(0))).alias("churn"))
    shaped = life.join(heads.select("pr_id", "head_sha", "start_ts", "end_ts"), "pr_id")
    until = F.least(F.coalesce("end_ts", "dies"), F.col("dies")).alias("until")
    open_end = (F.col("end_ts").isNull() | (F.col("end_ts") > F.col("dies"))).alias("closed")
    shaped = shaped.select("repo_id", "pr_id", "head_sha", F.greatest("start_ts", "born").alias("from"), until, open_end).filter("from < until or (closed and from = until)")
    sized = shaped.join(sizes, ["pr_id", "head_sha"])
    span = ["repo_id", "from", "until", "closed"]
    values = [sized.select(*span, F.lit(k).alias("measure"), F.col(k).alias("value")) for k in ("files", "churn")]
    first = reviews.groupBy("pr_id").agg(F.min("submitted_at").alias("first"))
    wait = F.floor(seconds_between(F.col("first"), F.col("born")))
    values.append(life.join(first, "pr_id").filter(F.col("first") <= F.col("dies")).select(
        "repo_id", F.greatest("first", "born").alias("from"), F.col("dies").alias("until"), F.lit(True).alias("closed"), F.lit("wait").alias("measure"), wait.alias("value")))
    asks = cohort.select("repo_id", "cutoff").distinct()
    lives = life.select("repo_id", "born", "dies", F.lit(True).alias("closed"), F.lit(1).alias("prs"))
    members = stored(act.span_sums(asks, lives, ["repo_id"], "born", "dies", "closed", ["prs"]))
    sized_asks = members.select("repo_id", "cutoff", "prs", F.explode(F.array(F.lit("files"), F.lit("churn"))).alias("measure"))
    keys = ["repo_id", "measure"]
    size = open_medians(sized_asks, values[0].unionByName(values[1]), keys, "from", "until", "closed", "value", "prs")
    late = open_medians(asks.withColumn("measure", F.lit("wait")), values[2], keys, "from", "until", "closed", "value")
    pick = lambda k: F.max(F.when(F.col("measure") == k, F.col("median")))
    medians = size.unionByName(late).groupBy("repo_id", "cutoff").agg(
        F.coalesce(pick("files"), F.lit(0.0)).alias("median_files"), F.coalesce(pick("churn"), F.lit(0.0)).alias("median_churn"), pick("wait").alias("median_ttfr"))
    # Shares as whole billionths, so that sums do not depend on their order.
    covered = shaped.join(owned.filter("n > 0"), ["pr_id", "head_sha"]).select(*span, F.round(F.col("hits") * 1_000_000_000 / F.col("n")).cast("bigint").alias("share"), F.lit(1).alias("heads"))
    cover = act.span_sums(asks, covered, ["repo_id"], "from", "until", "closed", ["share", "heads"])
    rate = safe_ratio(F.col("share") / F.lit(1e9), F.col("heads"))
    return medians.join(cover, ["repo_id", "cutoff"]).select("repo_id", "cutoff", "median_files", "median_churn", "median_ttfr", rate.alias("owner_coverage_rate"))


def size_zscores(cohort: DataFrame, files: DataFrame, priors: DataFrame) -> DataFrame:
    """How unusual a pull request's size is for its repository."""
    size = files.groupBy("pr_id").agg(F.count("*").alias("f"), F.sum(F.coalesce("changes", F.lit(0))).alias("c"))
    rows = cohort.select("repo_id", "pr_id", "cutoff").join(size, "pr_id", "left").join(priors, ["repo_id", "cutoff"])
    return rows.select("pr_id", zscore(F.coalesce("f", F.lit(0)), F.col("mean_files"), F.col("sd_files")).alias("files_zscore"),
                       zscore(F.coalesce("c", F.lit(0)), F.col("mean_churn"), F.col("sd_churn")).alias("churn_zscore"))


# --- candidates ------------------------------------------------------------------------------
#: Copies of the roster, so that one large team is not one task.
TEAM_LOTS = 32


def named_candidates(requests: DataFrame, mentions: DataFrame, owners: DataFrame, cohort: DataFrame) -> DataFrame:
    """The cohort with ``logins`` (requested, owning and mentioned users) and ``team_keys`` (spellings of asked or owning teams).

    ``requests``/``owners``: (pr_id, target_type, target_name); ``mentions``: (pr_id, login).
    """
    named = requests.unionByName(owners)
    is_team = F.col("target_type") == "team"
    keys = F.explode(X.team_key_variants(F.when(is_team, F.col("target_name"))))
    rows = named.filter("target_type = 'user'").select("pr_id", F.col("target_name").alias("login"), F.lit(None).cast("string").alias("key")).unionByName(
        named.filter(is_team).select("pr_id", F.lit(None).cast("string").alias("login"), keys.alias("key"))).unionByName(
        mentions.select("pr_id", "login", F.lit(None).cast("string").alias("key")))
    sets = rows.distinct().groupBy("pr_id").agg(F.collect_set("login").alias("logins"), F.collect_set("key").alias("team_keys"))
    none = F.array().cast("array<string>")
    return cohort.join(sets, "pr_id", "left").select(*cohort.columns, F.coalesce("logins", none).alias("logins"), F.coalesce("team_keys", none).alias("team_keys"))


def rostered(roster: DataFrame) -> DataFrame:
    """(member, keys): the spellings of all teams of a member."""
    return roster.select("member", F.lower(F.trim("team_key")).alias("key")).groupBy("member").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def candidate_pool(named: DataFrame, listed: DataFrame | None, roster: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``…, login): named and recently active users and members of asked or owning teams, without the author.

    ``named``: rows of ``named_candidates`` with ``author_login``; ``listed``: these rows with ``recent``, a list of
    (login, keys), the keys being those of ``rostered``.  Each candidate is told from the others on the row of its pull request:
    named users come first, recent ones only if they are not named and not in one of the teams, members
    through the first of their teams.  So the pairs, a product of pull requests and members, never move.
    """
    own = F.col("author_login")
    other = own.isNull() | (F.col("login") != own)
    told = named.select(*keep, "author_login", F.explode("logins").alias("login"))
    lot = F.pmod(F.xxhash64(*keep), F.lit(TEAM_LOTS))
    asked = named.select(*keep, "author_login", "logins", "team_keys", lot.alias("_lot"), F.explode("team_keys").alias("_key"))
    known = rostered(roster).select("member", F.explode("keys").alias("_key"), "keys").select(
        "_key", F.col("member").alias("login"), F.filter("keys", lambda k: k < F.col("_key")).alias("_before"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(TEAM_LOTS - 1).cast("bigint"))).alias("_lot"))
    once = ((F.size("_before") == 0) | ~F.arrays_overlap("_before", "team_keys")) & ~F.array_contains("logins", F.col("login"))
    members = asked.join(known, ["_key", "_lot"]).filter(once)
    pool = told.unionByName(members.select(*keep, "author_login", "login"))
    if listed is not None:
        fresh = F.filter("recent", lambda r: ~F.array_contains("logins", r["login"]) & (r["keys"].isNull() | ~F.arrays_overlap(r["keys"], "team_keys")))
        pool = pool.unionByName(listed.select(*keep, "author_login", F.explode(F.array_distinct(F.transform(fresh, lambda r: r["login"]))).alias("login")))
    return pool.filter(other).select(*keep, "login")


def resolve_logins(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """Attach the user a login means, without case: the smallest id where several match."""
    known = users.groupBy(F.lower("login").alias("_l")).agg(F.min_by(F.struct("user_id", "type"), "user_id").alias("u"))
    return pairs.withColumn("_l", F.lower("login")).join(known, "_l", "left").select(
        *pairs.columns, F.col("u.user_id").alias("user_id"), F.col("u.type").alias("type"))


def candidate_activity(pairs: DataFrame, acted: DataFrame, authored: DataFrame, open_requests: DataFrame) -> DataFrame:
    """Activity windows, load and tenure per (repo_id, pr_id, cutoff, login, user_id, type).

    ``acted``: (repo_id, user_id, ts, kind); ``authored``: (repo_id, user_id, ts);
    ``open_requests``: merged spans (repo_id, user_id, pr_id, start_ts, end_ts).
    """
    # An act enters every window at its time and leaves it behind its last day; the pairs themselves pass among these
    # moves, so they go through one ordered pass and meet no table afterwards.  Logins without a user have a key of their own.
    keys = ["repo_id", "_who"]
    is_review = F.col("kind") == "review_submitted"
    acts = acted.select("repo_id", "user_id", "ts", is_review.cast("bigint").alias("r"), (~is_review).cast("bigint").alias("c"), F.lit(0).alias("a")).unionByName(
        authored.select("repo_id", "user_id", "ts", F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1).alias("a")))
    e, zero, no_time = F.col("r") + F.col("c"), F.lit(0).cast("bigint"), F.lit(None).cast("timestamp_ntz")
    long = {"r_180d": F.col("r"), "c_180d": F.col("c"), "a_180d": F.col("a")}
    sums = ["e_7d", "e_30d", "e_90d", *long, "open"]

    def move(ts: Column, order: int, sign: int, parts: dict[str, Column], seen: Column = no_time, first: Column = no_time) -> Column:
        return F.struct(ts.alias("_ts"), F.lit(order).alias("_o"), *[(parts[v] * sign).cast("bigint").alias(v) if v in parts else zero.alias(v) for v in sums],
                        seen.alias("_seen"), first.alias("_first"))

    ts = F.col("ts").cast("timestamp_ntz")
    short = {f"e_{d}d": e for d in WINDOWS[:3]}
    steps = [move(ts, 0, 1, short | long, F.when(F.col("a") == 0, ts), ts), move(ts + F.expr(f"interval '{WINDOWS[3]}' day"), 2, -1, long)]
    steps += [F.when(e > 0, move(ts + F.expr(f"interval '{d}' day"), 2, -1, {f"e_{d}d": e})) for d in WINDOWS[:3]]
    moves = acts.select("repo_id", F.col("user_id").alias("_who"), F.inline(F.array_compact(F.array(*steps))))
    one = {"open": F.lit(1)}
    ends = F.when(F.col("end_ts").isNotNull(), move(F.col("end_ts").cast("timestamp_ntz"), 0, -1, one))
    held = open_requests.select("repo_id", F.col("user_id").alias("_who"), F.inline(F.array_compact(F.array(move(F.col("start_ts").cast("timestamp_ntz"), 0, 1, one), ends))))
    row = F.struct("pr_id", "cutoff", "login", "user_id", "type")
    who = F.coalesce("user_id", -1 - F.pmod(F.xxhash64("login"), F.lit(1 << 40)))
    asks = pairs.select("repo_id", who.alias("_who"), F.inline(F.array(move(F.col("cutoff").cast("timestamp_ntz"), 1, 1, {}))), row.alias("_row"))
    none = F.lit(None).cast(asks.schema["_row"].dataType).alias("_row")
    stream = moves.unionByName(held).select("*", none).unionByName(asks)
    found = act.running_total(stream, keys, "_ts", "_o", {v: f"n_{v}" for v in sums}, highest={"_seen": "last_ts"}, lowest={"_first": "first_ts"}).filter("_o = 1")
    found = found.select("repo_id", "_row.*", *[f"n_{v}" for v in sums], "last_ts", "first_ts").withColumn("n_e_180d", F.col("n_r_180d") + F.col("n_c_180d"))
    at = F.col("cutoff").cast("timestamp_ntz")
    return found.select(
        "repo_id", "pr_id", "cutoff", "login", "user_id", X.is_bot(F.col("type"), F.col("login")).alias("is_bot"),
        *[F.col(f"n_e_{d}d").alias(f"events_{d}d") for d in WINDOWS],
        F.col("n_r_180d").alias("reviews_180d"), F.col("n_c_180d").alias("comments_180d"), F.col("n_a_180d").alias("authored_180d"),
        seconds_between(at, F.col("last_ts")).alias("last_seen_seconds"), (seconds_between(at, F.col("first_ts")) / 86400.0).alias("account_age_days"),
        F.col("n_open").alias("open_reviews"), response_bucket(F.col("n_e_30d"), F.col("n_e_180d")).alias("response_bucket"))


def _touches(acted: DataFrame, authored: DataFrame) -> DataFrame:
    """(repo_id, user_id, pr_id, ts): the first and the last touch of each day; they say whether the day's touches reach into a window."""
    keys = ["repo_id", "user_id", "pr_id"]
    every = acted.select(*keys, "ts").unionByName(authored.select(*keys, "ts"))
    return every.groupBy(*keys, F.date_trunc("DAY", "ts")).agg(F.min("ts").alias("ts"), F.max("ts").alias("late")).select(
        *keys, F.explode(F.array_distinct(F.array("ts", "late"))).alias("ts"))


def footprint_steps(acted: DataFrame, authored: DataFrame, heads: DataFrame, days: int = 180) -> DataFrame:
    """(repo_id, user_id, cutoff): the times at which the files a user touched in the window may change; between two of them they do not.

    A touch comes, leaves just behind its last day, or its pull request gets another head in between.  So there are
    a few rows per touch, however many cutoffs ask for the user.
    """
    keys = ["repo_id", "user_id"]
    window = F.expr(f"interval '{days}' day")
    touches = _touches(acted, authored)
    ends = touches.select(*keys, F.explode(F.array(F.col("ts"), F.col("ts") + window + F.expr("interval '0.000001' second"))).alias("cutoff"))
    moved = touches.join(heads.select("pr_id", "start_ts"), "pr_id").filter((F.col("start_ts") > F.col("ts")) & (F.col("start_ts") <= F.col("ts") + window))
    return ends.unionByName(moved.select(*keys, F.col("start_ts").alias("cutoff"))).distinct()


def at_last_step(pairs: DataFrame, steps: DataFrame, facts: DataFrame, values: list[str]) -> DataFrame:
    """The pairs with the ``values`` of the last step up to their cutoff, null where there are none.

    ``facts``: (repo_id, user_id, cutoff, values…) at some of the steps.  Pairs pass once among the steps and meet no table.
    """
    from hindcast.operators.ordered import last_value_before

    keys = ["repo_id", "user_id"]
    known = steps.join(facts, [*keys, "cutoff"], "left").select(*keys, F.col("cutoff").alias("_ts"), F.lit(0).alias("_o"), F.struct(*values).alias("_fact"))
    row = F.struct(*[c for c in pairs.columns if c not in keys])
    asked = pairs.select(*keys, F.col("cutoff").alias("_ts"), F.lit(1).alias("_o"), row.alias("_row"))
    stream = known.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked.withColumn("_fact", F.lit(None).cast(known.schema["_fact"].dataType)))
    return last_value_before(stream, keys, "_ts", "_o", F.col("_fact"), "_found").filter("_o = 1").select(*keys, "_row.*", "_found.*")


def touched_files(asks: DataFrame, acted: DataFrame, authored: DataFrame, heads: DataFrame, files: DataFrame, days: int = 180) -> DataFrame:
    """Files (at the head of the cutoff) of every pull request a user touched in the window."""
    keys = ["repo_id", "user_id"]
    touches = _touches(acted, authored)
    touched = within_days(asks.select(*keys, "cutoff").distinct(), touches, keys, "cutoff", "ts", days).select(*keys, "cutoff", "pr_id").distinct()
    head = touched.join(heads.select("pr_id", "head_sha", "start_ts", "start_event_id"), "pr_id").filter(F.col("start_ts") <= F.col("cutoff")).groupBy(
        *keys, "cutoff", "pr_id").agg(F.max_by("head_sha", F.struct("start_ts", "start_event_id")).alias("head_sha"))
    return head.join(files.select("pr_id", "head_sha", "path"), ["pr_id", "head_sha"]).select(*keys, "cutoff", "path")


def footprint(touched: DataFrame, key: Column, n: int = FOOTPRINT_N) -> DataFrame:
    """Share of each key among the touched files: the n largest with entropy and number of keys."""
    keys = ["repo_id", "user_id", "cutoff"]
    counts = touched.groupBy(*keys, key.alias("key")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn(
        "rn", F.row_number().over(whole.orderBy(F.col("n").desc(), F.lower("key"), F.col("key"))))
    return shares.groupBy(*keys).agg(
        F.count("*").alias("distinct_keys"), grouped_entropy(F.col("share")).alias("entropy"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("rn") <= n, F.struct("key", "share"))))).alias("scores"))


def touched_prs(asks: DataFrame, acted: DataFrame, authored: DataFrame, days: int = 180) -> DataFrame:
    """Number of pull requests a user touched in the window: (repo_id, user_id, cutoff, touched).

    A touch counts for ``days``; the touches of one pull request merge to spans, and the
    answer is the number of spans open at the cutoff.  Linear in touches and cutoffs.
    """
    keys = ["repo_id", "user_id"]
    window = F.expr(f"interval '{days}' day")
    touches = acted.select(*keys, "pr_id", "ts").unionByName(authored.select(*keys, "pr_id", "ts"))
    daily = touches.groupBy(*keys, "pr_id", F.date_trunc("DAY", "ts")).agg(F.min("ts").alias("ts"), F.max("ts").alias("late"))
    spans = act.merge_spans(daily.select(*keys, "pr_id", "ts", (F.col("late") + window).alias("until")), [*keys, "pr_id"], "ts", "until")
    spans = spans.select(*keys, "ts", "until", F.lit(True).alias("closed"), F.lit(1).alias("touched"))
    return act.span_sums(asks.select(*keys, "cutoff"), spans, keys, "ts", "until", "closed", ["touched"])


def social_facts(cohort: DataFrame, acted: DataFrame, prs: DataFrame, users: DataFrame, days: int = 180) -> DataFrame:
    """(repo_id, author_id, cutoff, social): who reviewed or commented on the author's pull requests, as a list of (l, r, c, latency).

    ``cohort``: (repo_id, author_id, cutoff); ``l`` is the login in lower case of the user it means, see ``resolve_logins``.
    An action counts from its time until the window has left its pull request, so counts are sums over spans;
    only the median latency looks at pull requests one by one, at one row per user and pull request.
    """
    keys = ["repo_id", "author_id", "user_id"]
    ask = ["repo_id", "author_id", "cutoff"]
    owned = acted.select("repo_id", "user_id", "ts", "kind", F.col("pr_id").alias("on_pr")).join(
        prs.select(F.col("pr_id").alias("on_pr"), "author_id", F.col("created_at").alias("born")), "on_pr")
    first = owned.groupBy(*keys, "on_pr", "born").agg(F.min("ts").alias("first_ts"))
    # Only who was there in the window has a count: the other pairs are never made here.
    met = stored(within_days(cohort.select(*ask).distinct(), first, ["repo_id", "author_id"], "cutoff", "born", days).filter(F.col("first_ts") <= F.col("cutoff")))
    review = (F.col("kind") == "review_submitted").cast("int")
    spans = owned.select(*keys, F.greatest("ts", "born").alias("from"), (F.col("born") + F.expr(f"interval '{days}' day")).alias("until"),
                         F.lit(True).alias("closed"), review.alias("r"), (1 - review).alias("c")).filter("from <= until")
    sums = act.span_sums(met.select(*keys, "cutoff"), spans, keys, "from", "until", "closed", ["r", "c"])
    waits = met.groupBy(*keys, "cutoff").agg(F.percentile(seconds_between(F.col("first_ts"), F.col("born")), 0.5).alias("latency"))
    named = users.filter("login is not null").groupBy(F.lower("login").alias("l")).agg(F.min("user_id").alias("user_id"))
    found = waits.join(sums, [*keys, "cutoff"]).join(named, "user_id")
    return found.groupBy(*ask).agg(F.collect_list(F.struct("l", "r", "c", "latency")).alias("social"))


def pair_social(pool: DataFrame) -> DataFrame:
    """Earlier reviews and comments of the candidate on the author's pull requests, read from the list ``social`` on the row of the pair."""
    own = F.get(F.filter("social", lambda s: s["l"] == F.lower("login")), F.lit(0))
    z = lambda c: F.coalesce(F.col("_own")[c], F.lit(0).cast("bigint"))
    return pool.select("pr_id", "login", own.alias("_own")).select(
        "pr_id", "login", (z("r") + z("c")).alias("prior_interactions"), z("r").alias("prior_reviews"), z("c").alias("prior_comments"), F.col("_own.latency").alias("latency_median"))


def pair_affinity(pairs: DataFrame) -> DataFrame:
    """Overlap and dot product of a pull request's shares with the candidate's footprint.

    ``pairs``: (pr_id, login, shares, scores), the list of (key, share) of the pull request and the map of the candidate; either may be null.
    """
    cand = lambda s: F.try_element_at("scores", s["key"])
    met = F.coalesce(F.filter("shares", lambda s: cand(s).isNotNull()), F.slice("shares", 1, 0))
    overlap = F.when(F.col("shares").isNull() | F.col("scores").isNull(), 0).otherwise(F.size(met)).cast("bigint")
    dot = F.aggregate(met, F.lit(0.0), lambda total, s: total + s["share"] * cand(s))
    keys = F.when(F.col("shares").isNull(), 0).otherwise(F.size("shares"))
    return pairs.select("pr_id", "login", overlap.alias("overlap"), safe_ratio(overlap, keys).alias("overlap_share"), F.coalesce(dot, F.lit(0.0)).alias("dot"))
