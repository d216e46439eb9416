"""Queries over the feature families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.catalog import frames as fr
from hindcast.catalog.common import num
from hindcast.catalog.evaluation import GATES_CTE, MENTIONS_SQL, OWNER_HITS_SQL, PR_HEAD_FILES_SQL, REQUEST_SQL, RULES_SQL, _TARGET_JOIN, _USER_RX
from hindcast.catalog.frames import ACTIVITY_SQL, COHORT_SQL
from hindcast.catalog.registry import query
from hindcast.catalog.snapshots import RECENT_SQL, recent_acts, recent_lists
from hindcast.functions import paths as P
from hindcast.functions import text as X
from hindcast.operators import activity as act
from hindcast.operators import asof, intervals
from hindcast.plans import features as ft
from hindcast.plans import registry as reg
from hindcast.session import stored
from hindcast.sources.binding import COMMENT_BODIES, DriverTables, with_views

_CH = "case when changes <> 0 then changes else additions + deletions end"
_DEPTH = lambda d: f"case when len(string_split(path, '/')) <= 1 then '__root__' else array_to_string(string_split(path, '/')[1:least({d}, len(string_split(path, '/')) - 1)], '/') end"
_EXT = "case when regexp_matches(path, '\\.[a-z]+$') then regexp_extract(path, '\\.([a-z]+)$', 1) else '__none__' end"
_BND = "concat('dir:', case when contains(path, '/') then split_part(path, '/', 1) else '__root__' end)"
_ENT = "case when count(*) <= 1 then 0 else -sum(p * ln(p)) / ln(count(*)) end"
SURFACE_SQL = {
    "cohort": COHORT_SQL, "hf": PR_HEAD_FILES_SQL,
    "base": f"""select pr_id, count(*) as file_count, sum({_CH})::bigint as churn, max({_CH}) as max_file_churn, quantile_cont({_CH}, 0.5) as median_file_churn, quantile_cont({_CH}, 0.9) as churn_p90,
        avg((status = 'added')::int) as ratio_added, avg((status = 'removed')::int) as ratio_deleted, bool_or(contains(path, 'tests/')) as touches_tests, bool_or(suffix(path, '.md')) as touches_docs,
        count(*) filter ({_CH} >= 500) as large_files from hf group by pr_id""",
    "dims": f"""select pr_id, 'depth2' as dim, {_DEPTH(2)} as key from hf union all select pr_id, 'depth3', {_DEPTH(3)} from hf union all select pr_id, 'extension', {_EXT} from hf union all select pr_id, 'boundary', {_BND} from hf""",
    "st": f"select pr_id, dim, count(*) as k, {_ENT} as h, max(p) as top, max(n) as largest from (select *, n / sum(n) over (partition by pr_id, dim) as p from (select pr_id, dim, key, count(*) as n from dims group by all)) group by all",
}


@query("pr_surface", with_views(["pull_requests", "users", "head_events", "pr_files", "pr_text"], """select x.pr_id, length(x.title) as title_chars, contains(lower(x.title), 'wip') as wip_signal,
    contains(lower(x.title), 'urgent') as hotfix_signal, g.missing_issue::int + g.missing_ai_disclosure::int + g.missing_provenance::int as gates_missing,
    coalesce(b.file_count, 0) as file_count, coalesce(b.churn, 0) as churn, coalesce(b.max_file_churn, 0) as max_file_churn, round(coalesce(b.median_file_churn, 0), 8) as median_file_churn,
    round(coalesce(b.churn_p90, 0), 8) as churn_p90, round(coalesce(b.ratio_added, 0), 8) as ratio_added, round(coalesce(b.ratio_deleted, 0), 8) as ratio_deleted, coalesce(b.touches_tests, false) as touches_tests,
    coalesce(b.touches_docs, false) as touches_docs, coalesce(b.large_files, 0) as large_files, coalesce(d3.k, 0) as distinct_depth3, round(coalesce(d3.h, 0), 8) as entropy_depth3, round(coalesce(d2.h, 0), 8) as entropy_depth2,
    round(coalesce(e.h, 0), 8) as entropy_extension, round(coalesce(e.top, 0), 8) as top_extension_share, coalesce(a.k, 0) as distinct_boundary, round(coalesce(a.h, 0), 8) as entropy_boundary, coalesce(a.largest, 0) as max_files_in_boundary
    from pr_text x join gates g using (pr_id) left join base b using (pr_id) left join st d2 on d2.pr_id = x.pr_id and d2.dim = 'depth2' left join st d3 on d3.pr_id = x.pr_id and d3.dim = 'depth3'
    left join st e on e.pr_id = x.pr_id and e.dim = 'extension' left join st a on a.pr_id = x.pr_id and a.dim = 'boundary'""", {**SURFACE_SQL, "gates": GATES_CTE}))
def pr_surface(t: DriverTables) -> DataFrame:
    s = ft.pr_surface(fr.head_files(t), t.pr_text)
    return s.select("pr_id", "title_chars", "wip_signal", "hotfix_signal", F.col("gates_missing").cast("int").alias("gates_missing"), "file_count", "churn", "max_file_churn",
                    num("median_file_churn"), num("churn_p90"), num("ratio_added"), num("ratio_deleted"), "touches_tests", "touches_docs", "large_files", "distinct_depth3",
                    num("entropy_depth3"), num("entropy_depth2"), num("entropy_extension"), num("top_extension_share"), "distinct_boundary", num("entropy_boundary"), "max_files_in_boundary")


TIMELINE_SQL = {
    "cohort": COHORT_SQL, "req": REQUEST_SQL,
    "hd": "select c.pr_id, count(*) as n, count(*) filter (h.occurred_at >= c.cutoff - interval '1' day) as n1, count(*) filter (h.occurred_at >= c.cutoff - interval '6' hour) as n6, epoch(any_value(c.cutoff) - max(h.occurred_at)) as since from cohort c join head_events h on h.pr_id = c.pr_id and h.occurred_at <= c.cutoff group by 1",
    "cm": "select c.pr_id, count(*) filter (m.user_id = c.author_id) as a, count(*) filter (m.user_id <> c.author_id) as o, count(*) filter (u.type = 'Bot') as b, count(*) filter (u.type <> 'Bot') as h from cohort c join comments m on m.pr_id = c.pr_id and m.created_at <= c.cutoff join users u on u.user_id = m.user_id group by 1",
    "rv": "select c.pr_id, count(*) as n, count(*) filter (state = 'APPROVED') as ap, count(*) filter (state = 'COMMENTED') as co, count(*) filter (state = 'CHANGES_REQUESTED') as ch from cohort c join reviews r on r.pr_id = c.pr_id and r.submitted_at <= c.cutoff group by 1",
    "pp": "select c.pr_id, count(distinct x.user_id) as n from cohort c join (select pr_id, user_id, created_at as ts from comments union all select pr_id, user_id, submitted_at from reviews) x on x.pr_id = c.pr_id and x.ts <= c.cutoff group by 1",
    "rq": "select c.pr_id, count(*) filter (r.occurred_at <= c.cutoff) as adds, count(*) filter (r.end_ts <= c.cutoff) as removes, count(*) filter (r.occurred_at <= c.cutoff and (r.end_ts is null or c.cutoff < r.end_ts) and reviewer_type = 'user') as us, count(*) filter (r.occurred_at <= c.cutoff and (r.end_ts is null or c.cutoff < r.end_ts) and reviewer_type = 'team') as ts from cohort c join req r on r.pr_id = c.pr_id and r.op = 'add' group by 1",
    "df": "select c.pr_id, arg_max(d.is_draft, (d.occurred_at, d.event_id)) as is_draft from cohort c join draft_events d on d.pr_id = c.pr_id and d.occurred_at <= c.cutoff group by 1",
}


@query("pr_timeline", with_views(["reviews", "comments", "users", "head_events", "draft_events", "request_events"], """select c.pr_id, hd.n as head_updates, hd.n1 as head_updates_1d, round(hd.n6 / hd.n, 8) as update_burstiness,
    hd.since::double as seconds_since_head_update, df.is_draft, coalesce(cm.a, 0) as author_comments, coalesce(cm.o, 0) as non_author_comments, coalesce(cm.b, 0) as bot_comments, coalesce(cm.h, 0) as human_comments,
    coalesce(rv.n, 0) as reviews, coalesce(rv.ap, 0) as reviews_approve, coalesce(rv.co, 0) as reviews_comment, coalesce(rv.ch, 0) as reviews_changes_requested, coalesce(pp.n, 0) as participants,
    greatest(coalesce(pp.n, 0) - 1, 0) as non_author_participants, coalesce(rq.adds, 0) as request_adds, coalesce(rq.removes, 0) as request_removes, coalesce(rq.us, 0) as requested_users, coalesce(rq.ts, 0) as requested_teams,
    round(case when coalesce(cm.o, 0) > 0 and coalesce(rv.n, 0) > 0 then -((cm.o / (cm.o + rv.n)) * ln(cm.o / (cm.o + rv.n)) + (rv.n / (cm.o + rv.n)) * ln(rv.n / (cm.o + rv.n))) / ln(2) else 0 end, 8) as attention_entropy,
    coalesce(cm.a, 0) = 0 and hd.n1 = 0 as no_recent_author_followup
    from cohort c join hd using (pr_id) left join cm using (pr_id) left join rv using (pr_id) left join pp using (pr_id) left join rq using (pr_id) join df using (pr_id)""", TIMELINE_SQL))
def pr_timeline(t: DriverTables) -> DataFrame:
    f = ft.pr_timeline(fr.bare_cohort(t), fr.heads(t), t.comments, t.reviews, fr.requests(t), intervals.drafts(t.draft_events), t.users)
    return f.select("pr_id", "head_updates", "head_updates_1d", num("update_burstiness"), "seconds_since_head_update", "is_draft", "author_comments", "non_author_comments", "bot_comments",
                    "human_comments", "reviews", "reviews_approve", "reviews_comment", "reviews_changes_requested", "participants", "non_author_participants", "request_adds", "request_removes",
                    "requested_users", "requested_teams", num("attention_entropy"), "no_recent_author_followup")


OWN_VIEWS = ["pull_requests", "users", "head_events", "pr_files", "ownership_lines"]
OWN_SQL = {"cohort": COHORT_SQL, "head_files": PR_HEAD_FILES_SQL, "rules": RULES_SQL, "oh": OWNER_HITS_SQL}


@query("pr_ownership", with_views(OWN_VIEWS, f"""select f.pr_id, coalesce(o.k, 0) as owner_set_size, round(coalesce(p.n, 0) / f.n, 8) as owner_coverage, coalesce(p.mx, 0) as max_owners_on_file,
    round(coalesce(o.top / p.n, 0), 8) as top_owner_share, f.b > 1 and ((coalesce(o.k, 0) >= 5 and coalesce(p.n, 0) / f.n < 0.5) or coalesce(p.mx, 0) >= 3) as conflicting_ownership
    from (select pr_id, count(*) as n, count(distinct {_BND}) as b from head_files group by 1) f
    left join (select pr_id, count(*) as n, max(k) as mx from (select pr_id, path, count(distinct target) as k from oh group by all) group by 1) p using (pr_id)
    left join (select pr_id, count(*) as k, max(n) as top from (select pr_id, target, count(distinct path) as n from oh group by all) group by 1) o using (pr_id)""", OWN_SQL))
def pr_ownership(t: DriverTables) -> DataFrame:
    o = ft.pr_ownership(fr.head_files(t), fr.owner_hits(t))
    return o.select("pr_id", "owner_set_size", num("owner_coverage"), "max_owners_on_file", num("top_owner_share"), "conflicting_ownership")


_CAT = {"lint": "0", "test": "1", "security": "2", "cla": "3", "dep_update": "4"}


@query("automation", with_views(["comments", "users"], f"""select c.pr_id, coalesce(x.b, 0) as bot_comments, coalesce(x.d, 0) as bot_authors, {', '.join(f"coalesce(x.k{v}, 0) as category_{k}" for k, v in _CAT.items())} from cohort c left join (
    select c.pr_id, count(*) filter (suffix(u.login, '[bot]')) as b, count(distinct u.login) filter (suffix(u.login, '[bot]')) as d, {', '.join(f"count(*) filter (m.body = '{COMMENT_BODIES[int(v)]}') as k{v}" for v in _CAT.values())}
    from cohort c join comments m on m.pr_id = c.pr_id and m.created_at <= c.cutoff join users u on u.user_id = m.user_id group by 1) x using (pr_id)""", {"cohort": COHORT_SQL}))
def automation(t: DriverTables) -> DataFrame:
    return ft.automation(fr.bare_cohort(t), t.comments, t.users)


PRIORS_SQL = {
    "cohort": COHORT_SQL, "activity": ACTIVITY_SQL,
    "cuts": "select distinct repo_id, cutoff from cohort",
    "win": "select c.repo_id, c.cutoff, p.pr_id, p.created_at from cuts c join pull_requests p on p.repo_id = c.repo_id and p.created_at >= c.cutoff - interval '180' day and p.created_at <= c.cutoff",
    "sz": "select pr_id, head_sha, count(*) as n, sum(changes)::bigint as ch from pr_files group by all",
    "hi": "select *, lead(occurred_at) over (partition by pr_id order by occurred_at, event_id) as end_ts from head_events",
    "hs": "select h.pr_id, h.occurred_at, h.end_ts, s.n, s.ch from hi h join sz s using (pr_id, head_sha)",
    "wf": "select w.repo_id, w.cutoff, count(*) as prs, sum(coalesce(h.n, 0)) as f, sum(coalesce(h.n, 0) * coalesce(h.n, 0)) as f2, sum(coalesce(h.ch, 0)) as c, sum(coalesce(h.ch, 0) * coalesce(h.ch, 0)) as c2 from win w left join hs h on h.pr_id = w.pr_id and h.occurred_at <= w.cutoff and (h.end_ts is null or w.cutoff < h.end_ts) group by all",
    "wr": "select w.repo_id, w.cutoff, count(*) as n from win w where pr_id in (select pr_id from request_events) group by all",
    "we": "select w.repo_id, w.cutoff, count(*) as n, count(*) filter (a.type = 'Bot') as b from win w join activity a on a.pr_id = w.pr_id and a.ts <= w.cutoff group by all",
}


@query("repo_priors", with_views(["reviews", "comments", "users", "head_events", "pr_files", "request_events"], """select w.repo_id, strftime(w.cutoff, '%Y-%m-%d %H:%M:%S') as cutoff, w.prs as recent_prs, round(w.f / w.prs, 8) as mean_files,
    round(w.c / w.prs, 8) as mean_churn, round(sqrt((w.prs * w.f2 - w.f * w.f)::double) / w.prs, 8) as sd_files, round(coalesce(r.n, 0) / w.prs, 8) as request_rate, round(coalesce(e.b / e.n, 0), 8) as bot_activity_rate
    from wf w left join wr r on r.repo_id = w.repo_id and r.cutoff = w.cutoff left join we e on e.repo_id = w.repo_id and e.cutoff = w.cutoff""", PRIORS_SQL))
def repo_priors(t: DriverTables) -> DataFrame:
    p = _priors(t)
    return p.select("repo_id", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss").alias("cutoff"), "recent_prs", num("mean_files"), num("mean_churn"), num("sd_files"), num("request_rate"), num("bot_activity_rate"))


def _priors(t: DriverTables) -> DataFrame:
    return ft.repo_priors(fr.bare_cohort(t), t.pull_requests, fr.heads(t), t.pr_files, t.request_events, fr.activity(t))


MEDIANS_SQL = {
    **{k: PRIORS_SQL[k] for k in ("cohort", "cuts", "win", "sz", "hi", "hs")},
    "head_files": "select p.pr_id, p.repo_id, p.base_sha, f.head_sha, f.path from pull_requests p join pr_files f using (pr_id)",
    "rules": RULES_SQL, "oh": OWNER_HITS_SQL,
    "own": "select f.pr_id, f.head_sha, count(distinct f.path) as n, count(distinct o.path) as hits from head_files f left join oh o on o.pr_id = f.pr_id and o.path = f.path where (f.repo_id, f.base_sha) in (select (repo_id, base_sha) from rules) group by all",
    "fr": "select pr_id, min(submitted_at) as first from reviews group by 1",
    "ms": """select w.repo_id, w.cutoff, quantile_cont(coalesce(h.n, 0), 0.5) as f, quantile_cont(coalesce(h.ch, 0), 0.5) as c from win w
        left join hs h on h.pr_id = w.pr_id and h.occurred_at <= w.cutoff and (h.end_ts is null or w.cutoff < h.end_ts) group by all""",
    "mw": "select w.repo_id, w.cutoff, median(floor(greatest(epoch(r.first - w.created_at), 0))) as m from win w join fr r on r.pr_id = w.pr_id and r.first <= w.cutoff group by all",
    "oc": """select w.repo_id, w.cutoff, avg(o.hits / o.n) as r from win w join hi h on h.pr_id = w.pr_id and h.occurred_at <= w.cutoff and (h.end_ts is null or w.cutoff < h.end_ts)
        join own o on o.pr_id = h.pr_id and o.head_sha = h.head_sha group by all""",
}


@query("repo_medians", with_views(["reviews", "pull_requests", "users", "head_events", "pr_files", "ownership_lines"], """select c.repo_id, strftime(c.cutoff, '%Y-%m-%d %H:%M:%S') as cutoff, coalesce(s.f, 0)::double as median_files, coalesce(s.c, 0)::double as median_churn,
    w.m::double as median_ttfr, round(coalesce(o.r, 0) + 1e-8, 6) as owner_coverage_rate from cuts c left join ms s on s.repo_id = c.repo_id and s.cutoff = c.cutoff left join mw w on w.repo_id = c.repo_id and w.cutoff = c.cutoff
    left join oc o on o.repo_id = c.repo_id and o.cutoff = c.cutoff""", MEDIANS_SQL))
def repo_medians(t: DriverTables) -> DataFrame:
    from hindcast.operators.ownership import file_owner_hits

    paths = t.pr_files.join(t.pull_requests.select("pr_id", "repo_id", "base_sha"), "pr_id")
    rules = fr.owner_rules(t)
    hits = file_owner_hits(paths.select("pr_id", "repo_id", "base_sha", "path").distinct(), rules).select("pr_id", "path", F.lit(1).alias("hit")).distinct()
    ruled = paths.join(rules.select("repo_id", "base_sha").distinct(), ["repo_id", "base_sha"], "left_semi")
    owned = ruled.join(hits, ["pr_id", "path"], "left").groupBy("pr_id", "head_sha").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    m = ft.repo_medians(fr.bare_cohort(t), t.pull_requests, fr.heads(t), t.pr_files, t.reviews, owned)
    return m.select("repo_id", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss").alias("cutoff"), "median_files", "median_churn", "median_ttfr", num(F.col("owner_coverage_rate") + 1e-8, 6).alias("owner_coverage_rate"))


@query("size_zscores", with_views(["reviews", "comments", "users", "head_events", "pr_files", "request_events"], """select c.pr_id, round(case when (w.prs * w.f2 - w.f * w.f) > 0 then (coalesce(h.n, 0) - w.f / w.prs) / (sqrt((w.prs * w.f2 - w.f * w.f)::double) / w.prs) else 0 end, 6) as files_zscore
    from cohort c join wf w on w.repo_id = c.repo_id and w.cutoff = c.cutoff left join hs h on h.pr_id = c.pr_id and h.occurred_at <= c.cutoff and (h.end_ts is null or c.cutoff < h.end_ts)""", PRIORS_SQL))
def size_zscores(t: DriverTables) -> DataFrame:
    return ft.size_zscores(fr.bare_cohort(t), fr.head_files(t), _priors(t)).select("pr_id", num("files_zscore", 6))


# --- candidates -----------------------------------------------------------------------
POOL_SQL = {
    "cohort": COHORT_SQL, "head_files": PR_HEAD_FILES_SQL, "rules": RULES_SQL, "oh": OWNER_HITS_SQL, "req": REQUEST_SQL,
    "named": f"""select distinct c.pr_id, reviewer_type as ttype, coalesce(u.login, tm.slug) as name from cohort c join req r on r.pr_id = c.pr_id and r.op = 'add' and r.occurred_at <= c.cutoff and (r.end_ts is null or c.cutoff < r.end_ts)
        {_TARGET_JOIN} where coalesce(u.login, tm.slug) is not null union select distinct pr_id, ttype, target from oh""",
    "ment": f"select distinct pr_id, unnest(regexp_extract_all(concat(title, chr(10), body), '(?:^|[^A-Za-z0-9_])@({_USER_RX})', 1)) as login from pr_text",
    "memb": "select distinct n.pr_id, m.member as login from (select distinct pr_id, lower(name) as k from named where ttype = 'team') n join team_roster m on lower(m.team_key) in (n.k, case when contains(n.k, '/') then split_part(n.k, '/', 2) else concat('team:', n.k) end)",
    "activity": ACTIVITY_SQL, "recent": f"select distinct pr_id, login from ({RECENT_SQL})",
    "pool": "select x.pr_id, x.login from (select pr_id, name as login from named where ttype = 'user' union select pr_id, login from ment union select pr_id, login from memb union select pr_id, login from recent) x join cohort c using (pr_id) where x.login <> c.author_login",
}
POOL_VIEWS = ["reviews", "comments", "pull_requests", "users", "head_events", "pr_files", "ownership_lines", "request_events", "teams", "pr_text", "team_roster"]


POOL_KEYS = ["pr_id", "repo_id", "cutoff", "author_id"]


def pool(t: DriverTables, facts: DataFrame | None = None) -> DataFrame:
    """(pr_id, repo_id, cutoff, author_id, login), and the columns of ``facts`` by (repo_id, author_id, cutoff): they ride on the rows of the pull requests."""
    active = asof.active_at(fr.bare_cohort(t).select("pr_id", "cutoff"), fr.requests(t), ["pr_id"])
    asked = asof.request_targets(active, t.users, t.teams).select("pr_id", "target_type", "target_name")
    owners = fr.owner_hits(t).select("pr_id", "target_type", "target_name")
    mentioned = t.pr_text.select("pr_id", F.explode(X.mentioned_users(F.concat_ws("\n", "title", "body"))).alias("login"))
    base = fr.cohort(t).select(*POOL_KEYS, "author_login")
    base = base if facts is None else base.join(facts, ["repo_id", "author_id", "cutoff"], "left")
    keep = [c for c in base.columns if c != "author_login"]
    named = stored(ft.named_candidates(asked, mentioned, owners, base))
    acts = recent_acts(t).join(ft.rostered(t.team_roster).withColumnRenamed("member", "login"), "login", "left")
    return ft.candidate_pool(named, recent_lists(named, acts, ["keys"]), t.team_roster, keep)


@query("candidate_pool", with_views(POOL_VIEWS, "select pr_id, login from pool", POOL_SQL))
def candidate_pool(t: DriverTables) -> DataFrame:
    return pool(t).select("pr_id", "login")


def candidate_pairs(t: DriverTables) -> DataFrame:
    """Pairs for the candidate features: the whole pool.  Several features read it, so it is stored once."""
    return stored(ft.resolve_logins(pool(t), t.users))


PAIRS_SQL = {**POOL_SQL, "pairs": "select p.pr_id, p.login, c.repo_id, c.cutoff, c.author_id, u.user_id, u.type from pool p join cohort c using (pr_id) left join (select lower(login) as l, min(user_id) as user_id, arg_min(type, user_id) as type from users group by 1) u on u.l = lower(p.login)"}
PAIR_VIEWS = POOL_VIEWS


def _authored(t: DriverTables) -> DataFrame:
    return t.pull_requests.select("repo_id", F.col("author_id").alias("user_id"), "pr_id", F.col("created_at").alias("ts"))


@query("candidate_activity", with_views(PAIR_VIEWS, """select p.pr_id, p.login, coalesce(p.type = 'Bot', false) or suffix(lower(p.login), '[bot]') as is_bot,
    count(a.ts) filter (a.ts >= p.cutoff - interval '7' day) as events_7d, count(a.ts) filter (a.ts >= p.cutoff - interval '30' day) as events_30d,
    count(a.ts) filter (a.ts >= p.cutoff - interval '180' day and a.kind = 'review_submitted') as reviews_180d, count(a.ts) filter (a.ts >= p.cutoff - interval '180' day and a.kind <> 'review_submitted') as comments_180d,
    epoch(p.cutoff - max(a.ts))::double as last_seen_seconds, round(epoch(p.cutoff - any_value(o.first_ts)) / 86400.0::double, 8) as account_age_days, coalesce(any_value(l.n), 0) as open_reviews
    from pairs p left join activity a on a.repo_id = p.repo_id and a.user_id = p.user_id and a.ts <= p.cutoff
    left join (select repo_id, user_id, min(ts) as first_ts from (select repo_id, user_id, ts from activity union all select repo_id, author_id, created_at from pull_requests) group by all) o
      on o.repo_id = p.repo_id and o.user_id = p.user_id and o.first_ts <= p.cutoff
    left join (select p.pr_id, p.login, count(distinct r.pr_id) as n from pairs p join req r on r.repo_id = p.repo_id and r.reviewer_id = p.user_id and r.reviewer_type = 'user' and r.op = 'add' and r.occurred_at <= p.cutoff and (r.end_ts is null or p.cutoff < r.end_ts) group by all) l
      on l.pr_id = p.pr_id and l.login = p.login group by p.pr_id, p.login, p.type, p.cutoff""", PAIRS_SQL))
def candidate_activity(t: DriverTables) -> DataFrame:
    acted = fr.activity(t)
    spans = fr.requests(t).filter("reviewer_type = 'user'").join(t.pull_requests.select("pr_id", "repo_id"), "pr_id").select(
        "repo_id", F.col("reviewer_id").alias("user_id"), "pr_id", "start_ts", "end_ts")
    merged = act.merge_spans(spans, ["repo_id", "user_id", "pr_id"], "start_ts", "end_ts")
    f = ft.candidate_activity(candidate_pairs(t), acted, _authored(t), merged)
    return f.select("pr_id", "login", "is_bot", "events_7d", "events_30d", "reviews_180d", "comments_180d", "last_seen_seconds", num("account_age_days"), "open_reviews")


@query("multi_window_counts", with_views(["reviews", "comments", "users"], """select c.pr_id, count(a.ts) filter (a.ts >= c.cutoff - interval '7' day) as n_7d, count(a.ts) filter (a.ts >= c.cutoff - interval '30' day) as n_30d,
    count(a.ts) filter (a.ts >= c.cutoff - interval '90' day) as n_90d, count(a.ts) filter (a.ts >= c.cutoff - interval '180' day) as n_180d from cohort c left join activity a on a.repo_id = c.repo_id and a.user_id = c.author_id and a.ts <= c.cutoff group by c.pr_id""", {"cohort": COHORT_SQL, "activity": ACTIVITY_SQL}))
def multi_window_counts(t: DriverTables) -> DataFrame:
    asked = fr.bare_cohort(t).select("pr_id", "repo_id", F.col("author_id").alias("user_id"), "cutoff")
    counts = act.trailing_counts(asked, fr.activity(t), ["repo_id", "user_id"], ft.WINDOWS, {"n": F.lit(1)})
    return asked.join(counts, ["repo_id", "user_id", "cutoff"]).select("pr_id", *[f"n_{d}d" for d in ft.WINDOWS])


@query("load_proxy", with_views(["request_events"], """select r0.pr_id, count(distinct r.pr_id) as open_reviews from (select pr_id, repo_id, reviewer_id, min(occurred_at) as cutoff from req where op = 'add' and reviewer_type = 'user' group by all) r0
    join req r on r.repo_id = r0.repo_id and r.reviewer_id = r0.reviewer_id and r.reviewer_type = 'user' and r.op = 'add' and r.occurred_at <= r0.cutoff and (r.end_ts is null or r0.cutoff < r.end_ts) group by r0.pr_id, r0.reviewer_id""", {"req": REQUEST_SQL}))
def load_proxy(t: DriverTables) -> DataFrame:
    spans = fr.requests(t).filter("reviewer_type = 'user'").join(t.pull_requests.select("pr_id", "repo_id"), "pr_id")
    asked = spans.groupBy("pr_id", "repo_id", "reviewer_id").agg(F.min("start_ts").alias("cutoff"))
    merged = act.merge_spans(spans.select("repo_id", "reviewer_id", "pr_id", "start_ts", "end_ts"), ["repo_id", "reviewer_id", "pr_id"], "start_ts", "end_ts")
    n = act.open_at(asked, merged, ["repo_id", "reviewer_id"], "start_ts", "end_ts", "open_reviews")
    return asked.join(n, ["repo_id", "reviewer_id", "cutoff"]).select("pr_id", "open_reviews")


TOUCH_SQL = {**PAIRS_SQL, "touch": """select distinct p.repo_id, p.user_id, p.cutoff, a.pr_id from (select distinct repo_id, user_id, cutoff from pairs) p join (select repo_id, user_id, pr_id, ts from activity union all select repo_id, author_id, pr_id, created_at from pull_requests) a
    on a.repo_id = p.repo_id and a.user_id = p.user_id and a.ts <= p.cutoff and a.ts >= p.cutoff - interval '180' day""",
    "th": "select t.repo_id, t.user_id, t.cutoff, t.pr_id, arg_max(h.head_sha, (h.occurred_at, h.event_id)) as head_sha from touch t join head_events h on h.pr_id = t.pr_id and h.occurred_at <= t.cutoff group by all",
    "tf": f"select t.repo_id, t.user_id, t.cutoff, {_BND} as b, {_DEPTH(3)} as d from th t join pr_files f on f.pr_id = t.pr_id and f.head_sha = t.head_sha",
    "fb": f"select repo_id, user_id, cutoff, count(*) as k, {_ENT} as h, max(p) as top from (select *, n / sum(n) over (partition by repo_id, user_id, cutoff) as p from (select repo_id, user_id, cutoff, b, count(*) as n from tf group by all)) group by all",
    "fd": "select * from (select *, n / sum(n) over (partition by repo_id, user_id, cutoff) as share, row_number() over (partition by repo_id, user_id, cutoff order by n desc, lower(d), d) as rn from (select repo_id, user_id, cutoff, d, count(*) as n from tf group by all)) where rn <= 12"}
TOUCH_VIEWS = PAIR_VIEWS


def _with_footprint(t: DriverTables, pairs: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
    """Pairs of known users with ``values`` of the footprint at their cutoff."""
    touches = (fr.activity(t), _authored(t), fr.heads(t))
    steps = stored(ft.footprint_steps(*touches))
    facts = ft.footprint(ft.touched_files(steps, *touches, t.pr_files), key).select("repo_id", "user_id", "cutoff", *[c.alias(n) for n, c in values.items()])
    return ft.at_last_step(pairs.filter("user_id is not null"), steps, facts, list(values))


@query("footprint_topn", with_views(TOUCH_VIEWS, "select p.pr_id, p.login, f.k as distinct_keys, round(f.h, 8) as entropy, round(f.top, 8) as top_share from pairs p join fb f on f.repo_id = p.repo_id and f.user_id = p.user_id and f.cutoff = p.cutoff", TOUCH_SQL))
def footprint_topn(t: DriverTables) -> DataFrame:
    pairs = candidate_pairs(t)
    values = {"distinct_keys": F.col("distinct_keys"), "entropy": num("entropy"), "top_share": num(F.array_max(F.map_values("scores")))}
    f = _with_footprint(t, pairs.select("repo_id", "pr_id", "login", "user_id", "cutoff"), P.boundary_id(F.col("path")), values)
    return f.filter("distinct_keys is not null").select("pr_id", "login", *values)


@query("touched_prs", with_views(PAIR_VIEWS, "select p.pr_id, p.login, count(t.pr_id) as touched from pairs p join touch t on t.repo_id = p.repo_id and t.user_id = p.user_id and t.cutoff = p.cutoff group by all", {k: v for k, v in TOUCH_SQL.items() if k not in ("th", "tf", "fb", "fd")}))
def touched_prs(t: DriverTables) -> DataFrame:
    pairs = candidate_pairs(t).filter("user_id is not null")
    sums = ft.touched_prs(pairs, fr.activity(t), _authored(t))
    return pairs.join(sums, ["repo_id", "user_id", "cutoff"]).filter("touched > 0").select("pr_id", "login", "touched")


@query("pair_affinity", with_views(TOUCH_VIEWS, """select p.pr_id, p.login, coalesce(m.n, 0) as dir_overlap, round(coalesce(m.n / k.n, 0), 8) as dir_overlap_share, round(coalesce(m.dot, 0), 8) as dir_dot from pairs p
    left join (select pr_id, count(distinct d) as n from prd group by 1) k on k.pr_id = p.pr_id
    left join (select p.pr_id, p.login, count(*) as n, sum(x.share * f.share) as dot from pairs p join fd f on f.repo_id = p.repo_id and f.user_id = p.user_id and f.cutoff = p.cutoff join prd x on x.pr_id = p.pr_id and x.d = f.d group by all) m on m.pr_id = p.pr_id and m.login = p.login""",
    {**TOUCH_SQL, "hf": PR_HEAD_FILES_SQL, "prd": f"select pr_id, d, n / sum(n) over (partition by pr_id) as share from (select pr_id, {_DEPTH(3)} as d, count(*) as n from hf group by all)"}))
def pair_affinity(t: DriverTables) -> DataFrame:
    from pyspark.sql import Window

    key = P.directory(F.col("path"), 3)
    counts = fr.head_files(t).groupBy("pr_id", key.alias("key")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("pr_id"))).groupBy("pr_id").agg(F.collect_list(F.struct("key", "share")).alias("shares"))
    pairs = candidate_pairs(t).select("repo_id", "pr_id", "login", "user_id", "cutoff").join(shares, "pr_id", "left")
    met = _with_footprint(t, pairs, key, {"scores": F.col("scores")}).select("pr_id", "login", "shares", "scores")
    strangers = pairs.filter("user_id is null").select("pr_id", "login", "shares", F.lit(None).cast(met.schema["scores"].dataType).alias("scores"))
    f = ft.pair_affinity(met.unionByName(strangers))
    return f.select("pr_id", "login", F.col("overlap").alias("dir_overlap"), num("overlap_share").alias("dir_overlap_share"), num("dot").alias("dir_dot"))


@query("pair_social", with_views(PAIR_VIEWS, """select p.pr_id, p.login, coalesce(sum(x.r), 0)::bigint as prior_reviews, coalesce(sum(x.c), 0)::bigint as prior_comments, round(median(x.lat), 6) as latency_median from pairs p left join (
    select p.pr_id as for_pr, p.login, q.pr_id, count(*) filter (a.kind = 'review_submitted') as r, count(*) filter (a.kind <> 'review_submitted') as c, greatest(epoch(min(a.ts) - any_value(q.created_at)), 0)::double as lat
    from pairs p join pull_requests q on q.repo_id = p.repo_id and q.author_id = p.author_id and q.created_at <= p.cutoff and q.created_at >= p.cutoff - interval '180' day
    join activity a on a.pr_id = q.pr_id and a.user_id = p.user_id and a.ts <= p.cutoff group by all) x on x.for_pr = p.pr_id and x.login = p.login group by p.pr_id, p.login""", PAIRS_SQL))
def pair_social(t: DriverTables) -> DataFrame:
    f = ft.pair_social(pool(t, ft.social_facts(fr.bare_cohort(t), fr.activity(t), t.pull_requests, t.users)))
    return f.select("pr_id", "login", "prior_reviews", "prior_comments", num("latency_median", 6))


# --- registry -------------------------------------------------------------------------
_KEYS_SQL = """select distinct key from (select concat('pr.surface.status_ratio.', status) as key from landed_files union all select concat('pr.surface.touches_', split_part(path, '/', 1)) from landed_files
    union all select concat('candidate.activity.reviews_', additions::varchar, '_180d') from landed_files union all select concat('strange.', head_sha) from landed_files union all select 'pr.gates.completeness_score' from landed_files
    union all select concat('pair.affinity.k', deletions::varchar) from landed_files union all select concat('automation.has_', status) from landed_files)"""
_SPEC_VALUES = ", ".join("('{}', '{}', '{}')".format(*(spec[i] for i in (0, 3, 4))) for spec in reg.FEATURES)
_CLASS_SQL = {
    "keys": _KEYS_SQL, "specs": f"select * from (values {_SPEC_VALUES}) s(name, granularity, role)",
    "cls": """select k.key, coalesce(e.name, p.name) as spec, coalesce(e.granularity, p.granularity) as granularity, coalesce(e.role, p.role) as role from keys k left join (select * from specs where not contains(name, '*')) e on e.name = k.key
        left join (select k.key, arg_min(s.name, s.name) as name, arg_min(s.granularity, s.name) as granularity, arg_min(s.role, s.name) as role from keys k join specs s on contains(s.name, '*') and regexp_full_match(k.key, replace(replace(s.name, '.', '\\.'), '*', '.*')) group by 1) p on p.key = k.key""",
}


def feature_keys(t: DriverTables) -> DataFrame:
    f = t.landed_files
    return f.select(F.explode(F.array(
        F.concat(F.lit("pr.surface.status_ratio."), "status"), F.concat(F.lit("pr.surface.touches_"), F.split_part("path", F.lit("/"), F.lit(1))),
        F.concat(F.lit("candidate.activity.reviews_"), F.col("additions").cast("string"), F.lit("_180d")), F.concat(F.lit("strange."), "head_sha"),
        F.lit("pr.gates.completeness_score"), F.concat(F.lit("pair.affinity.k"), F.col("deletions").cast("string")), F.concat(F.lit("automation.has_"), "status"))).alias("key"))


@query("feature_registry_coverage", with_views(["landed_files"], "select key, spec, granularity, role from cls", _CLASS_SQL))
def feature_registry_coverage(t: DriverTables) -> DataFrame:
    return reg.classify(feature_keys(t), reg.feature_specs(t.spark))


def _task_case() -> str:
    arms = []
    for task, roles, grans, prefixes in reg.TASKS:
        pre = " or ".join(f"starts_with(key, '{p}')" for p in prefixes)
        quoted = lambda s: ", ".join(f"'{x}'" for x in s)
        arms.append(f"select '{task}' as task_id, key, case when not ({pre}) then 'prefix_not_allowed' when role not in ({quoted(roles)}) then 'role_not_allowed' "
                    f"when granularity not in ({quoted(grans)}) then 'granularity_not_allowed' end as reason from cls where spec is not null")
    return " union all ".join(arms)


@query("task_policy_violations", with_views(["landed_files"], f"select * from ({_task_case()}) where reason is not null", _CLASS_SQL))
def task_policy_violations(t: DriverTables) -> DataFrame:
    return reg.violations(reg.classify(feature_keys(t), reg.feature_specs(t.spark)), reg.task_policies(t.spark))


@query("feature_quality", with_views(["landed_files"], f"select task_id, count(*) as n from ({_task_case()}) where reason is not null group by 1 union all select 'unresolved', count(*) from cls where spec is null", _CLASS_SQL))
def feature_quality(t: DriverTables) -> DataFrame:
    classified = reg.classify(feature_keys(t), reg.feature_specs(t.spark))
    return reg.quality_rollup(classified, reg.violations(classified, reg.task_policies(t.spark)))
