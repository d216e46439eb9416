"""Nearest pull requests with their SQL: all pairs of a repository's year, counted token by token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.catalog import frames as fr
from hindcast.catalog.common import num
from hindcast.catalog.evaluation import OWNER_HITS_SQL, RULES_SQL
from hindcast.catalog.features import _BND, _DEPTH
from hindcast.catalog.frames import COHORT_SQL
from hindcast.catalog.registry import query
from hindcast.operators import nearest as nr
from hindcast.sources.binding import DriverTables, with_views

NEAREST_SQL = {
    "cohort": COHORT_SQL,
    "hi": "select pr_id, head_sha, occurred_at as from_ts, lead(occurred_at) over (partition by pr_id order by occurred_at, event_id) as until_ts from head_events",
    "ver": "select p.repo_id, h.pr_id, p.created_at as born, p.base_sha, h.head_sha, h.from_ts, h.until_ts from hi h join pull_requests p using (pr_id) where h.until_ts is null or h.until_ts > h.from_ts",
    "tok": f"""select distinct v.repo_id, v.pr_id, v.from_ts, k.kind, case k.kind when 'p' then path when 'd' then {_DEPTH(3)} else {_BND} end as token
        from ver v join pr_files f using (pr_id, head_sha), (select unnest(['p', 'd', 'b']) as kind) k""",
    "cnt": "select pr_id, from_ts, kind, count(*) as n from tok group by all",
    "chn": "select v.pr_id, v.from_ts, coalesce(sum(f.changes), 0)::bigint as churn from ver v left join pr_files f using (pr_id, head_sha) group by all",
    "ask": "select c.pr_id, c.cutoff, v.repo_id, v.from_ts from cohort c join ver v on v.pr_id = c.pr_id and v.from_ts <= c.cutoff and (v.until_ts is null or c.cutoff < v.until_ts)",
    "cand": """select a.pr_id, a.cutoff, a.from_ts as a_from, v.pr_id as other, v.from_ts from ask a join ver v on v.repo_id = a.repo_id and v.pr_id <> a.pr_id
        and v.born <= a.cutoff and v.born >= a.cutoff - interval '365' day and v.from_ts <= a.cutoff and (v.until_ts is null or a.cutoff < v.until_ts)""",
    "met": """select a.pr_id, y.pr_id as other, y.from_ts, count(*) filter (x.kind = 'p') as p, count(*) filter (x.kind = 'd') as d, count(*) filter (x.kind = 'b') as b
        from ask a join tok x on x.pr_id = a.pr_id and x.from_ts = a.from_ts join tok y on y.repo_id = x.repo_id and y.kind = x.kind and y.token = x.token and y.pr_id <> x.pr_id
        join ver v on v.pr_id = y.pr_id and v.from_ts = y.from_ts and v.born <= a.cutoff and v.born >= a.cutoff - interval '365' day group by all""",
    "wide": "select pr_id, from_ts, coalesce(max(n) filter (kind = 'p'), 0) as p, coalesce(max(n) filter (kind = 'd'), 0) as d, coalesce(max(n) filter (kind = 'b'), 0) as b from cnt group by all",
    "sc": """select c.pr_id, c.cutoff, c.other, c.from_ts, c.a_from, round(0.45::double * coalesce(m.p::double / nullif(x.p + y.p - m.p, 0), 0) + 0.30::double * coalesce(m.d::double / nullif(x.d + y.d - m.d, 0), 0)
        + 0.15::double * coalesce(m.b::double / nullif(x.b + y.b - m.b, 0), 0) + 0.10::double * (case when greatest(g.churn, h.churn) <= 0 then 1.0 else 1.0 - abs(g.churn - h.churn)::double / greatest(g.churn, h.churn) end), 12) as score
        from cand c left join met m on m.pr_id = c.pr_id and m.other = c.other and m.from_ts = c.from_ts left join wide x on x.pr_id = c.pr_id and x.from_ts = c.a_from
        left join wide y on y.pr_id = c.other and y.from_ts = c.from_ts join chn g on g.pr_id = c.pr_id and g.from_ts = c.a_from join chn h on h.pr_id = c.other and h.from_ts = c.from_ts""",
    "top": "select *, row_number() over (partition by pr_id order by score desc, other) as r from sc qualify r <= 5",
}
FACTS_SQL = {
    "head_files": "select v.pr_id, v.repo_id, v.base_sha, v.from_ts, f.path from ver v join pr_files f using (pr_id, head_sha)",
    "rules": RULES_SQL, "oh": OWNER_HITS_SQL,
    "ow": "select v.pr_id, v.from_ts, list(distinct lower(o.target)) as owners from head_files v join oh o on o.pr_id = v.pr_id and o.path = v.path group by all",
    "see": "select t.pr_id, t.other, r.user_id, r.submitted_at from top t join reviews r on r.pr_id = t.other and r.submitted_at <= t.cutoff",
    "wait": "select pr_id, avg(s) as s from (select s.pr_id, greatest(epoch(min(s.submitted_at) - any_value(p.created_at)), 0)::double as s from see s join pull_requests p on p.pr_id = s.other group by s.pr_id, s.other) group by 1",
    "who": "select pr_id, string_agg(l, ',' order by n desc, l) as l from (select s.pr_id, lower(u.login) as l, count(*) as n from see s join users u using (user_id) group by s.pr_id, lower(u.login) qualify row_number() over (partition by s.pr_id order by n desc, l) <= 10) group by 1",
    "bnd": "select pr_id, string_agg(b, ',' order by n desc, lower(b), b) as l from (select t.pr_id, k.token as b, count(*) as n from top t join tok k on k.pr_id = t.other and k.from_ts = t.from_ts and k.kind = 'b' group by t.pr_id, k.token qualify row_number() over (partition by t.pr_id order by n desc, lower(b), b) <= 10) group by 1",
    "ovl": "select t.pr_id, avg(case when len(coalesce(m.owners, [])) + len(coalesce(o.owners, [])) = 0 then 0.0 else len(list_intersect(coalesce(m.owners, []), coalesce(o.owners, [])))::double / len(list_distinct(list_concat(coalesce(m.owners, []), coalesce(o.owners, [])))) end) as j from top t left join ow m on m.pr_id = t.pr_id and m.from_ts = t.a_from left join ow o on o.pr_id = t.other and o.from_ts = t.from_ts group by 1",
}
VIEWS = ["pull_requests", "users", "reviews", "head_events", "pr_files", "ownership_lines"]


@query("nearest_prs", with_views(VIEWS, "select pr_id, other, r as rank, round(score + 1e-10, 6) as score from top", NEAREST_SQL))
def nearest_prs(t: DriverTables) -> DataFrame:
    rows = nr.stored(nr.versions(t.pull_requests, fr.heads(t), t.pr_files))
    return nr.nearest(nr.stored(nr.asking(fr.bare_cohort(t), rows)), rows).select("pr_id", "other", F.col("rank").cast("bigint").alias("rank"), num(F.col("score") + 1e-10, 6).alias("score"))  # the offset keeps halves from falling either way


@query("nearest_features", with_views(VIEWS, """select c.pr_id, coalesce(i.l, '') as topk_ids, round(w.s, 6) as mean_ttfr, round(coalesce(o.j, 0), 8) as owner_overlap, coalesce(h.l, '') as common_reviewers, coalesce(b.l, '') as common_boundaries
    from cohort c left join (select pr_id, string_agg(other::varchar, ',' order by r) as l from top group by 1) i using (pr_id) left join wait w using (pr_id) left join ovl o using (pr_id) left join who h using (pr_id) left join bnd b using (pr_id)""",
    {**NEAREST_SQL, **FACTS_SQL}))
def nearest_features(t: DriverTables) -> DataFrame:
    f = nr.nearest_features(fr.bare_cohort(t), t.pull_requests, fr.heads(t), t.pr_files, t.reviews, t.users, fr.owner_rules(t))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return f.select("pr_id", listed("topk_ids"), num("mean_ttfr", 6), num("owner_overlap"), listed("common_reviewers"), listed("common_boundaries"))
