"""Queries over landed objects: upserts, events, watermarks and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.catalog.common import sql_ts, ts
from hindcast.catalog.registry import query
from hindcast.operators import incremental, intervals, normalize, upsert
from hindcast.sources import files, landed
from hindcast.sources.binding import DriverTables, with_views


@query(
    "upsert_latest",
    with_views([], """select l_orderkey as pr_id, status, changes, seq from (
        select l_orderkey, l_returnflag as status, cast(l_quantity as bigint) as changes, {seq} as seq,
        row_number() over (partition by l_orderkey order by {seq} desc) as rn from lineitem) where rn = 1""".format(
        seq="concat(cast(cast(l_shipdate as date) as string), '-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', "
            "cast(l_partkey as string), '-', cast(l_suppkey as string))")),
)
def upsert_latest(t: DriverTables) -> DataFrame:
    rows = t.raw("lineitem").selectExpr(
        "l_orderkey as pr_id", "l_returnflag as status", "cast(l_quantity as bigint) as changes",
        "concat(cast(cast(l_shipdate as date) as string), '-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', "
        "cast(l_partkey as string), '-', cast(l_suppkey as string)) as seq")
    return upsert.keep_latest(rows, ["pr_id"], ["seq"])


@query("pr_file_upsert", with_views(["pr_files"], "select pr_id, head_sha, path, status, additions, deletions, changes from pr_files"))
def pr_file_upsert(t: DriverTables) -> DataFrame:
    return upsert.upsert_files(t.landed_files, ["pr_id", "head_sha", "path"], ["seq"]).select(
        "pr_id", "head_sha", "path", "status", "additions", "deletions", "changes")


_LANDED_PULLS = """to_json(named_struct(
    'id', pr_id, 'number', number, 'user', named_struct('id', author_id), 'title', title, 'state', state, 'draft', draft,
    'head', named_struct('sha', 'F', 'ref', concat('feature-', pr_id)), 'base', named_struct('sha', base_sha, 'ref', base_ref),
    'merge_commit_sha', merge_commit_sha,
    'created_at', date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    'closed_at', date_format(closed_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    'merged_at', date_format(merged_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))) as object"""


def landed_pulls(t: DriverTables) -> DataFrame:
    """Pull requests as the nested JSON objects an API would have returned."""
    return t.pull_requests.selectExpr(
        "*", "case when closed_at is null then 'open' else 'closed' end as state",
        "case when merged_at is not null then concat('m', pr_id) end as merge_commit_sha",
    ).selectExpr("repo_id", _LANDED_PULLS)


def flat_pulls(t: DriverTables) -> DataFrame:
    return landed.flatten_objects(landed_pulls(t), "pulls", "object", ["repo_id"])


@query(
    "flatten_pulls",
    with_views(["pull_requests"], f"""select repo_id, pr_id, number, author_id, title,
        case when closed_at is null then 'open' else 'closed' end as state, draft, 'F' as head_sha,
        concat('feature-', pr_id) as head_ref, base_sha, base_ref, {sql_ts('created_at')} as created_at,
        {sql_ts('closed_at')} as closed_at, {sql_ts('merged_at')} as merged_at from pull_requests"""),
)
def flatten_pulls(t: DriverTables) -> DataFrame:
    return flat_pulls(t).select(
        "repo_id", "pr_id", "number", "author_id", "title", "state", "draft", "head_sha", "head_ref", "base_sha", "base_ref",
        ts("created_at"), ts("closed_at"), ts("merged_at"))


_PR_EVENTS_SQL = """
    select repo_id, created_at as occurred_at, author_id as actor_id, 'pull_request' as subject_type, cast(pr_id as string) as subject_id,
      'pull_request.opened' as event_type, cast(null as string) as commit_sha, cast(null as boolean) as p_is_draft, cast(null as string) as p_head_ref
      from pull_requests
    union all select repo_id, created_at, author_id, 'pull_request', cast(pr_id as string), 'pull_request.head.set', 'F', null, concat('feature-', pr_id) from pull_requests
    union all select repo_id, created_at, author_id, 'pull_request', cast(pr_id as string), 'pull_request.draft.set', null, draft, null from pull_requests
    union all select repo_id, merged_at, author_id, 'pull_request', cast(pr_id as string), 'pull_request.merged', concat('m', pr_id), null, null from pull_requests where merged_at is not null
    union all select repo_id, closed_at, author_id, 'pull_request', cast(pr_id as string), 'pull_request.closed', null, null, null from pull_requests where merged_at is null and closed_at is not null"""


@query("pr_to_events", with_views(["pull_requests"], f"""select repo_id, {sql_ts('occurred_at')} as occurred_at, actor_id, subject_type,
    subject_id, event_type, commit_sha, p_is_draft, p_head_ref from ({_PR_EVENTS_SQL})"""))
def pr_to_events(t: DriverTables) -> DataFrame:
    return normalize.pull_request_events(flat_pulls(t)).select(
        "repo_id", ts("occurred_at"), "actor_id", "subject_type", "subject_id", "event_type", "commit_sha", "p_is_draft", "p_head_ref")


@query("issue_to_events", with_views(["pull_requests", "pr_text"], f"""select repo_id, {sql_ts('at_ts')} as occurred_at, actor_id, subject_id,
    event_type, p_title, md5(p_body) as p_body_md5 from (
      select repo_id, created_at as at_ts, author_id as actor_id, cast(issue_id as string) as subject_id, 'issue.opened' as event_type,
        cast(null as string) as p_title, cast(null as string) as p_body from pull_requests
      union all select repo_id, created_at, author_id, cast(issue_id as string), 'issue.content.set', x.title, x.body
        from pull_requests p join pr_text x using (pr_id)
      union all select repo_id, closed_at, author_id, cast(issue_id as string), 'issue.closed', null, null from pull_requests where closed_at is not null)"""))
def issue_to_events(t: DriverTables) -> DataFrame:
    issues = t.pull_requests.select("repo_id", "pr_id", "issue_id", "author_id", "created_at", "closed_at").join(t.pr_text, "pr_id")
    return normalize.issue_events(issues).select(
        "repo_id", ts("occurred_at"), "actor_id", "subject_id", "event_type", "p_title", F.md5("p_body").alias("p_body_md5"))


@query("comment_to_events", with_views(["comments"], f"""select repo_id, {sql_ts('at_ts')} as occurred_at, actor_id, subject_id, event_type, object_id, p_body from (
      select repo_id, created_at as at_ts, user_id as actor_id, comment_id as subject_id, 'comment.created' as event_type, cast(pr_id as string) as object_id, body as p_body from comments
      union all select repo_id, updated_at, user_id, comment_id, 'comment.edited', cast(pr_id as string), body from comments where updated_at > created_at)"""))
def comment_to_events(t: DriverTables) -> DataFrame:
    return normalize.comment_events(t.comments.withColumn("parent_id", F.col("pr_id"))).select(
        "repo_id", ts("occurred_at"), "actor_id", "subject_id", "event_type", "object_id", "p_body")


@query("review_to_events", with_views(["reviews"], f"""select repo_id, {sql_ts('submitted_at')} as occurred_at, user_id as actor_id,
    review_id as subject_id, 'review.submitted' as event_type, cast(pr_id as string) as object_id, state as p_state from reviews"""))
def review_to_events(t: DriverTables) -> DataFrame:
    return normalize.review_events(t.reviews.withColumn("body", F.lit(None).cast("string"))).select(
        "repo_id", ts("occurred_at"), "actor_id", "subject_id", "event_type", "object_id", "p_state")


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_IO = normalize.ISSUE_OBJECT_EVENTS
_HAS_PR = "(pull_request_id is not null and pull_request_id <> 0)"
_REQ = f"(event in ({_in(list(normalize.REQUEST_EVENTS))}) and {_HAS_PR})"
_ONPULL = (f"(event in ({_in(list(normalize.REQUEST_EVENTS) + list(normalize.DRAFT_EVENTS) + list(normalize.COMMIT_EVENTS) + ['review_dismissed'] + normalize.PULL_RAW_EVENTS)}) and {_HAS_PR})")
_KNOWN = f"(event in ({_in(list(_IO) + normalize.ISSUE_PLAIN_EVENTS + normalize.ISSUE_RAW_EVENTS + normalize.REFERENCE_EVENTS + ['edited', 'renamed', 'commented'])}))"
_EDIT = "(event = 'edited' and coalesce(title, issue_title, body, issue_body) is not null)"
TIMELINE_EVENTS_SQL = f"""
  select * from (
    select event_id, repo_id, created_at as occurred_at, actor_id,
      case when {_ONPULL} or (not {_KNOWN} and pull_request_id is not null) then 'pull_request' else 'issue' end as subject_type,
      case when {_ONPULL} or (not {_KNOWN} and pull_request_id is not null) then pull_request_id else issue_id end as subject_id,
      case {' '.join(f"when event = '{k}' then '{v[0]}'" for k, v in _IO.items())}
        when {_EDIT} or event = 'renamed' then 'issue.content.edit'
        when {_REQ} and event = 'review_requested' then 'pull_request.review_request.add'
        when {_REQ} then 'pull_request.review_request.remove'
        when {_HAS_PR} and event in ('ready_for_review', 'converted_to_draft') then 'pull_request.draft.set'
        when {_HAS_PR} and event = 'synchronize' then 'pull_request.head.set'
        when {_HAS_PR} and event = 'merged' then 'pull_request.merged'
        when {_HAS_PR} and event = 'review_dismissed' then 'review.dismissed'
        when {_ONPULL} then concat('pull_request.', event)
        when {_KNOWN} then concat('issue.', event)
        when pull_request_id is not null then concat('pull_request.event.', event)
        else concat('issue.event.', event) end as event_type,
      case {' '.join(f"when event = '{k}' then '{v[1]}'" for k, v in _IO.items())}
        when event = 'commented' then 'comment'
        when {_REQ} then case when reviewer_id is not null then 'user' else 'team' end
        when {_HAS_PR} and event = 'review_dismissed' then 'review'
        when event in ('referenced', 'cross-referenced') and source_issue_id <> 0 then 'issue' end as object_type,
      case when event in ('labeled', 'unlabeled') then label_id
        when event in ('assigned', 'unassigned') then assignee_id
        when event in ('milestoned', 'demilestoned') then milestone_id
        when event = 'commented' then coalesce(nullif(nested_comment_id, 0), comment_id)
        when {_REQ} then coalesce(reviewer_id, team_id)
        when {_HAS_PR} and event = 'review_dismissed' then coalesce(nullif(dismissed_review_id, 0), nullif(dismissed_id, 0), review_id)
        when event in ('referenced', 'cross-referenced') then nullif(source_issue_id, 0) end as object_id,
      case when ({_HAS_PR} and event in ('synchronize', 'merged')) or event in ('referenced', 'cross-referenced') then commit_id end as commit_sha,
      case when event = 'edited' then coalesce(title, issue_title) when event = 'renamed' then rename_to end as p_title,
      case when event = 'edited' then coalesce(body, issue_body) when event = 'commented' then comment_body end as p_body,
      case when {_HAS_PR} and event in ('ready_for_review', 'converted_to_draft') then event = 'converted_to_draft' end as p_is_draft
    from timeline where event <> '')
  where not (event_type in ('issue.label.add', 'issue.label.remove', 'issue.milestone.set', 'issue.milestone.clear',
    'pull_request.review_request.add', 'pull_request.review_request.remove') and object_id is null)"""


@query("normalize_timeline", with_views(["timeline"], f"""select event_id, repo_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') as occurred_at, actor_id, subject_type, subject_id,
    event_type, object_type, object_id, commit_sha, p_title, p_body, p_is_draft from ({TIMELINE_EVENTS_SQL})"""))
def normalize_timeline(t: DriverTables) -> DataFrame:
    return normalize.normalize_timeline(t.timeline_payloads).select(
        "event_id", "repo_id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("occurred_at"), "actor_id",
        "subject_type", "subject_id", "event_type", "object_type", "object_id", "commit_sha", "p_title", "p_body", "p_is_draft")


@query("event_dedup", with_views(["timeline"], """select event_key, event_id, event_type, subject_id from (
    select *, row_number() over (partition by event_key order by event_id) as rn from (
      select *, concat_ws('|', event_type, subject_type, cast(subject_id as string), strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f+00:00'),
        coalesce(object_type, ''), coalesce(cast(nullif(object_id, 0) as string), ''), coalesce(commit_sha, '')) as event_key
      from (select * replace (date_trunc('day', occurred_at) as occurred_at) from log))) where rn = 1""", {"log": TIMELINE_EVENTS_SQL}))
def event_dedup(t: DriverTables) -> DataFrame:
    # Times are cut to the day so that the natural key really repeats.
    log = normalize.normalize_timeline(t.timeline_payloads).withColumn("occurred_at", F.date_trunc("DAY", "occurred_at"))
    return upsert.append_events(log, "event_id").select("event_key", "event_id", "event_type", "subject_id")


@query("issue_pr_link", with_views(["pull_requests"], """select p.repo_id, p.pr_id, i.issue_id from pull_requests p
    left join (select repo_id, number, issue_id + 1000000 as issue_id from pull_requests where number % 2 = 0) i
    on i.repo_id = p.repo_id and i.number = p.number"""))
def issue_pr_link(t: DriverTables) -> DataFrame:
    issues = t.pull_requests.filter("number % 2 = 0").selectExpr("repo_id", "number", "issue_id + 1000000 as issue_id")
    prs = t.pull_requests.select("repo_id", "number", "pr_id", F.lit(None).cast("bigint").alias("issue_id"))
    return incremental.link_pull_requests(prs, issues).select("repo_id", "pr_id", "issue_id")


def _seen(t: DriverTables) -> DataFrame:
    pulls = t.pull_requests.selectExpr("repo_id", "pr_id", "'pulls' as resource", "coalesce(closed_at, created_at) as updated_at")
    reviews = t.reviews.selectExpr("repo_id", "pr_id", "'reviews' as resource", "submitted_at as updated_at")
    comments = t.comments.selectExpr("repo_id", "pr_id", "'issue_comments' as resource", "updated_at")
    return pulls.unionByName(reviews).unionByName(comments)


def _watermarks(t: DriverTables) -> DataFrame:
    return t.repos.selectExpr(
        "repo_id", "explode(array('pulls', 'reviews', 'releases')) as resource",
        "timestamp_ntz '2000-01-01 00:00:00' + repo_id * interval '100' day as updated_at")


_SEEN_SQL = {
    "seen": "select repo_id, pr_id, 'pulls' as resource, coalesce(closed_at, created_at) as updated_at from pull_requests union all "
            "select repo_id, pr_id, 'reviews', submitted_at from reviews union all select repo_id, pr_id, 'issue_comments', updated_at from comments",
    "marks": "select repo_id, unnest(['pulls', 'reviews', 'releases']) as resource, timestamp '2000-01-01' + repo_id * interval '100' day as updated_at from repos",
}


@query("watermark_advance", with_views(["repos", "reviews", "comments"], f"""select coalesce(m.repo_id, s.repo_id) as repo_id,
    coalesce(m.resource, s.resource) as resource, {sql_ts('coalesce(s.u, m.updated_at)')} as updated_at from marks m full join
    (select s.repo_id, s.resource, max(s.updated_at) as u from seen s left join marks m2 on m2.repo_id = s.repo_id and m2.resource = s.resource
     where m2.updated_at is null or s.updated_at >= m2.updated_at group by all) s on s.repo_id = m.repo_id and s.resource = m.resource""", _SEEN_SQL))
def watermark_advance(t: DriverTables) -> DataFrame:
    marks = _watermarks(t)
    seen, fresh = _seen(t), None
    for resource in ("pulls", "reviews", "issue_comments"):
        part = incremental.newer_than_watermark(seen.filter(F.col("resource") == resource), marks, resource)
        fresh = part if fresh is None else fresh.unionByName(part)
    return incremental.advance_watermarks(marks, fresh).select("repo_id", "resource", ts("updated_at"))


@query("incremental_changes", with_views(["repos", "reviews", "comments", "head_events"], f"""select pr_id, head_sha, {sql_ts('occurred_at')} as start_at, {sql_ts('end_ts')} as end_at from (
    select *, lead(occurred_at) over (partition by pr_id order by occurred_at, event_id) as end_ts from head_events
    where pr_id in (select s.pr_id from seen s join marks m on m.repo_id = s.repo_id and m.resource = s.resource where s.resource = 'pulls' and s.updated_at >= m.updated_at))""", _SEEN_SQL))
def incremental_changes(t: DriverTables) -> DataFrame:
    changed = incremental.newer_than_watermark(_seen(t).filter("resource = 'pulls'"), _watermarks(t), "pulls")
    rebuilt = intervals.heads(incremental.touched_only(t.head_events, changed, "pr_id"))
    return rebuilt.select("pr_id", "head_sha", ts("start_ts", "start_at"), ts("end_ts", "end_at"))


_PAGES = ("page_id % 5 as repo_id", "case page_id % 3 when 0 then 'pulls' when 1 then 'reviews' else 'releases' end as resource",
          "page_id as page", "length(html) % 4 as items",
          "case when page_id % 50 <> 49 then page_id + 1 + (case when page_id % 7 = 3 then 1 else 0 end) end as next_page")
_GAPS_SQL = f"""select repo_id, resource, page, page as expected_page, 'empty page with next link' as detail from (select {', '.join(_PAGES)} from pages) where items = 0 and next_page is not null
    union all select repo_id, resource, next_page, page + 1, 'non-sequential page' from (select {', '.join(_PAGES)} from pages) where next_page <> page + 1"""


def page_log(t: DriverTables) -> DataFrame:
    return t.raw("pages").selectExpr(*_PAGES)


@query("page_gaps", _GAPS_SQL)
def page_gaps(t: DriverTables) -> DataFrame:
    return incremental.page_gaps(page_log(t))


@query("qa_gap_report", f"select repo_id, resource, count(*) as n from ({_GAPS_SQL}) group by repo_id, resource union all select repo_id, null, count(*) from ({_GAPS_SQL}) group by repo_id")
def qa_gap_report(t: DriverTables) -> DataFrame:
    return incremental.gap_report(incremental.page_gaps(page_log(t)))


@query("ingest_window", with_views(["pull_requests"], """select repo_id, count(*) as n, min(pr_id) as first_pr, max(pr_id) as last_pr from pull_requests
    where coalesce(closed_at, created_at) >= timestamp '1998-01-01' and created_at <= timestamp '1998-06-30' group by repo_id"""))
def ingest_window(t: DriverTables) -> DataFrame:
    keep = incremental.in_time_window(
        F.col("created_at"), F.col("closed_at"), F.expr("timestamp_ntz '1998-01-01'"), F.expr("timestamp_ntz '1998-06-30'"))
    return t.pull_requests.filter(keep).groupBy("repo_id").agg(
        F.count("*").alias("n"), F.min("pr_id").alias("first_pr"), F.max("pr_id").alias("last_pr"))


# --- intervals -------------------------------------------------------------------
def timeline_events(t: DriverTables) -> DataFrame:
    return normalize.normalize_timeline(t.timeline_payloads)


@query("state_intervals", with_views(["timeline"], """select subject_id as issue_id, case when event_type = 'issue.closed' then 'closed' else 'open' end as state,
    event_id as start_event_id, lead(event_id) over (partition by subject_id order by occurred_at, event_id) as end_event_id
    from log where event_type in ('issue.opened', 'issue.reopened', 'issue.closed')""", {"log": TIMELINE_EVENTS_SQL}))
def state_intervals(t: DriverTables) -> DataFrame:
    return intervals.issue_state(timeline_events(t)).select("issue_id", "state", "start_event_id", "end_event_id")


@query("content_intervals", with_views(["timeline"], """select subject_id as issue_id, p_title as title, p_body as body,
    event_id as start_event_id, lead(event_id) over (partition by subject_id order by occurred_at, event_id) as end_event_id
    from log where event_type in ('issue.content.set', 'issue.content.edit')""", {"log": TIMELINE_EVENTS_SQL}))
def content_intervals(t: DriverTables) -> DataFrame:
    return intervals.issue_content(timeline_events(t)).select("issue_id", "title", "body", "start_event_id", "end_event_id")


def _membership_sql(family: str, add: str, remove: str, subject: str = "issue_id", obj: str = "object_id") -> str:
    return f"""select '{family}' as family, {subject} as subject_id, {obj} as object_id, event_id as start_event_id, end_event_id from (
      select *, first(case when event_type = '{remove}' then event_id end ignore nulls) over (partition by {subject}, {obj}
        order by occurred_at, event_id rows between 1 following and unbounded following) as end_event_id
      from (select *, subject_id as issue_id from log) where event_type in ('{add}', '{remove}')) where event_type = '{add}'"""


@query("membership_intervals", with_views(["timeline"], " union all ".join([
    _membership_sql("label", "issue.label.add", "issue.label.remove"),
    _membership_sql("assignee", "issue.assignee.add", "issue.assignee.remove"),
    _membership_sql("milestone", "issue.milestone.set", "issue.milestone.clear"),
    _membership_sql("review_request", "pull_request.review_request.add", "pull_request.review_request.remove"),
]), {"log": TIMELINE_EVENTS_SQL}))
def membership_intervals(t: DriverTables) -> DataFrame:
    # One pass for all four families: the family is part of the key.
    kind = F.col("event_type")
    adds = {"issue.label.add": "label", "issue.assignee.add": "assignee", "issue.milestone.set": "milestone",
            "pull_request.review_request.add": "review_request"}
    removes = {"issue.label.remove": "label", "issue.assignee.remove": "assignee", "issue.milestone.clear": "milestone",
               "pull_request.review_request.remove": "review_request"}
    family = F.coalesce(*[F.when(kind == k, v) for k, v in {**adds, **removes}.items()])
    log = timeline_events(t).filter(kind.isin(*adds, *removes)).withColumn("family", family)
    return intervals.membership_intervals(
        log, ["family", "subject_id", "object_id"], kind.isin(*adds), kind.isin(*removes)
    ).select("family", "subject_id", "object_id", "start_event_id", "end_event_id")


@query("comment_intervals", with_views(["comments"], f"""select comment_id, event_type, {sql_ts('at_ts')} as start_at, {sql_ts('end_at')} as end_at from (
    select *, first(case when event_type <> 'comment.created' then at_ts end ignore nulls) over (partition by comment_id order by at_ts, event_type
      rows between 1 following and unbounded following) as end_at from (
      select comment_id, 'comment.created' as event_type, created_at as at_ts from comments
      union all select comment_id, 'comment.edited', updated_at from comments where updated_at > created_at
      union all select comment_id, 'comment.deleted', created_at + interval '5' hour from comments where additions_mod = 0))
    where event_type <> 'comment.deleted'""".replace("additions_mod", "length(comment_id) % 3")))
def comment_intervals(t: DriverTables) -> DataFrame:
    log = normalize.comment_events(t.comments.withColumn("parent_id", F.col("pr_id")))
    gone = t.comments.filter("length(comment_id) % 3 = 0").selectExpr(
        "repo_id", "created_at + interval '5' hour as occurred_at", "comment_id as subject_id", "'comment.deleted' as event_type")
    log = log.unionByName(gone, allowMissingColumns=True).withColumn("event_id", F.col("event_type"))
    return intervals.comment_content(log).select(
        "comment_id", F.col("start_event_id").alias("event_type"), ts("start_ts", "start_at"), ts("end_ts", "end_at"))


@query("review_intervals", with_views(["reviews"], f"""select review_id, state, {sql_ts('submitted_at')} as start_at, cast(null as string) as end_at from reviews"""))
def review_intervals(t: DriverTables) -> DataFrame:
    log = normalize.review_events(t.reviews.withColumn("body", F.lit(None).cast("string"))).withColumn("event_id", F.col("subject_id"))
    return intervals.review_content(log).select("review_id", "state", ts("start_ts", "start_at"), ts("end_ts", "end_at"))


# --- table browser ----------------------------------------------------------------
@query("browse_table", """select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, cast((select count(*) from customer where
    lower(c_name) like '%mach%' or lower(c_mktsegment) like '%mach%') as bigint) as total_rows from customer
    where lower(c_name) like '%mach%' or lower(c_mktsegment) like '%mach%' order by c_acctbal desc, c_custkey limit 50 offset 50""")
def browse_table(t: DriverTables) -> DataFrame:
    page, total = files.browse(t.raw("customer"), "MACH", "c_acctbal", True, page=2, page_size=50)
    # The total is one row: a broadcast of fixed size.
    return page.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


@query("adhoc_select", """select o_orderstatus, o_orderpriority, count(*) as n, false as truncated from orders group by all""")
def adhoc_select(t: DriverTables) -> DataFrame:
    return files.adhoc_select(
        t.spark, "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by o_orderstatus, o_orderpriority",
        orders=t.raw("orders"))
