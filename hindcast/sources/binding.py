"""Binding of the driver's parquet tables to code-review history tables.

Every expression below is plain SQL that Spark and DuckDB read alike, so the
binding is stated once and the SQL checks see the same history as Spark does.
Nothing here is an operator: it only renames and derives columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.session import configure


def _case_list(selector: str, names: list[str]) -> str:
    arms = " ".join(f"when {i} then '{name}'" for i, name in enumerate(names))
    return f"case {selector} {arms} end"


def _case_kind(by_type: dict[str, list[str]], k: str) -> str:
    arms = " ".join(
        f"when '{etype}' then {_case_list(f'{k} % {len(names)}', names)}"
        for etype, names in by_type.items()
    )
    return f"case event_type {arms} end"


# --- fixed values of the binding -------------------------------------------------
TIMELINE_KINDS = {
    "signup": ["opened", "reopened", "review_requested", "ready_for_review",
               "synchronize", "subscribed", "pinned", "transferred"],
    "error": ["closed", "merged", "review_dismissed", "converted_to_draft",
              "head_ref_deleted", "locked", "milestoned", "demilestoned"],
    "view": ["labeled", "assigned", "mentioned", "referenced",
             "cross-referenced", "added_to_project", "commented", "base_ref_force_pushed"],
    "click": ["unlabeled", "unassigned", "review_request_removed", "unsubscribed",
              "unlocked", "unpinned", "renamed", "custom_kind"],
    "purchase": ["edited", "edited", "head_ref_restored", "head_ref_force_pushed",
                 "removed_from_project", "labeled", "unlabeled", ""],
}
COMMENT_BODIES = [
    "eslint: 2 problems in this file",
    "CI failed: coverage dropped below the limit",
    "secret scan found CVE-2024-1",
    "Please sign the CLA first",
    "Bump left-pad from 1.0 to 2.0",
    "looks fine to me",
]
FILE_EXTENSIONS = [".py", ".ts", ".md", ".go", ""]
PART_TYPES = ["economy", "small", "medium", "promo", "large", "standard"]

# --- shared expressions ----------------------------------------------------------
LI_KEY = (
    "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', "
    "cast(l_partkey as string), '-', cast(l_suppkey as string), '-', "
    "cast(cast(l_shipdate as date) as string))"
)
ACTED_AT = "l_shipdate + (l_linenumber * 60 + l_suppkey % 60) * interval '1' minute"
CREATED_AT = "o_orderdate + (o_orderkey % 1440) * interval '1' minute"
SUPPLIER_LOGIN = (
    "concat(lower(replace(s_name, '#', '-')), "
    "case when s_suppkey % 15 = 0 then '[bot]' else '' end)"
)
PATH = (
    "case when p_size = 50 then concat(replace(p_name, ' ', '_'), '.md') "
    "else concat(lower(p_type), '/', case when p_size % 6 = 0 then 'tests/' else '' end, "
    "lower(replace(p_brand, '#', '-')), '/', replace(p_name, ' ', '_'), "
    f"{_case_list('p_size % 5', FILE_EXTENSIONS)}) end"
)
TITLE = (
    "concat(case when o_orderkey % 11 = 0 then 'WIP: ' else '' end, "
    "lower(substr(o_orderpriority, 3)), ' change ', cast(o_orderkey as string))"
)
BODY_TAIL = (
    "concat(case when o_orderkey % 3 = 0 then concat('Fixes #', cast(o_orderkey % 97 as string), chr(10)) "
    "when o_orderkey % 13 = 1 then concat('See REV-', cast(o_orderkey as string), chr(10)) else '' end, "
    "case when o_orderkey % 5 = 1 then concat('AI assisted: no', chr(10)) "
    "when o_orderkey % 5 = 2 then concat('- [x] no AI was used', chr(10)) "
    "when o_orderkey % 5 = 3 then concat('- [ ] no AI was used', chr(10)) else '' end, "
    "case when o_orderkey % 7 = 3 then concat('* [X] written by a human', chr(10)) "
    "when o_orderkey % 7 = 4 then concat('Provenance: mixed', chr(10)) else '' end, "
    "case when o_orderkey % 4 = 1 then concat('Rollback: https://example.com/', cast(o_orderkey as string), chr(10)) else '' end, "
    "'cc @supplier-', lpad(cast(o_custkey % 100 as string), 9, '0'), "
    "case when o_orderkey % 6 = 0 then concat(' @acme/nation-', cast(o_custkey % 25 as string)) else '' end)"
)
PR_COLUMNS = {
    "repo_id": "cast(n_regionkey as bigint)",
    "pr_id": "o_orderkey",
    "number": "o_orderkey",
    "issue_id": "o_orderkey",
    "author_id": "o_custkey * 2",
    "created_at": CREATED_AT,
    "merged_at": f"case when o_orderstatus = 'F' then {CREATED_AT} + (o_orderkey % 20 + 1) * interval '1' day end",
    "closed_at": f"case when o_orderstatus = 'F' then {CREATED_AT} + (o_orderkey % 20 + 1) * interval '1' day "
                 f"when o_orderstatus = 'P' then {CREATED_AT} + (o_orderkey % 45 + 1) * interval '1' day end",
    "title": TITLE,
    "base_sha": "concat('base-', o_orderstatus)",
    "base_ref": "'main'",
    "draft": "o_orderkey % 4 = 0",
}
FILE_COLUMNS = {
    "pr_id": "l_orderkey",
    "head_sha": "l_linestatus",
    "path": PATH,
    "status": "case l_returnflag when 'A' then 'added' when 'R' then 'removed' else 'modified' end",
    "additions": "cast(l_quantity as bigint)",
    "deletions": "cast(l_linenumber as bigint)",
    "changes": "cast(l_quantity as bigint) * l_linenumber",
    "seq": f"concat(cast(cast(l_shipdate as date) as string), '-', {LI_KEY})",
}
REVIEW_COLUMNS = {
    "review_id": LI_KEY,
    "pr_id": "l_orderkey",
    "user_id": "l_suppkey * 2 + 1",
    "state": "case l_returnflag when 'A' then 'APPROVED' when 'R' then 'CHANGES_REQUESTED' else 'COMMENTED' end",
    "submitted_at": ACTED_AT,
}
COMMENT_COLUMNS = {
    "comment_id": LI_KEY,
    "pr_id": "l_orderkey",
    "supplier_user_id": "l_suppkey * 2 + 1",
    "by_author": "l_linenumber = 5",
    "review_id": f"case when l_linestatus = 'F' then {LI_KEY} end",
    "comment_type": "case when l_linestatus = 'F' then 'review' else 'issue' end",
    "created_at": ACTED_AT,
    "updated_at": f"{ACTED_AT} + (l_partkey % 3) * interval '1' hour",
    "body": _case_list("l_partkey % 6", COMMENT_BODIES),
}
REQUEST_COLUMNS = {
    "request_id": LI_KEY,
    "pr_id": "l_orderkey",
    "reviewer_type": "case when l_linenumber = 1 then 'user' else 'team' end",
    "reviewer_id": "case when l_linenumber = 1 then l_suppkey * 2 + 1 else l_suppkey % 25 end",
    "add_hours": "l_partkey % 96",
    "keep_hours": "case when l_returnflag = 'R' then cast(l_quantity as bigint) end",
}
_K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"
TIMELINE_COLUMNS = {
    "event_id": "event_id",
    "repo_id": "user_id % 5",
    "issue_id": "user_id",
    "pull_request_id": "case when user_id % 2 = 0 then user_id end",
    "created_at": "ts",
    "k": _K,
    "event": _case_kind(TIMELINE_KINDS, _K),
}
TIMELINE_PAYLOAD = {
    "actor_id": "event_id % 97",
    "label_id": "case when k % 10 <> 9 then k % 5 end",
    "assignee_id": "k % 7",
    "milestone_id": "case when k % 4 <> 3 then k % 3 end",
    "reviewer_id": "case when k % 3 <> 0 then k % 11 end",
    "team_id": "case when k % 3 = 0 then k % 4 end",
    "title": "case when k % 2 = 0 then concat('t', cast(k as string)) end",
    "body": "case when k % 3 = 0 then concat('b', cast(k as string)) end",
    "issue_title": "case when k % 5 = 0 then concat('it', cast(k as string)) end",
    "issue_body": "case when k % 5 = 0 then concat('ib', cast(k as string)) end",
    "rename_to": "concat('r', cast(k as string))",
    "nested_comment_id": "case when k % 2 = 0 then k end",
    "comment_body": "concat('c', cast(k as string))",
    "comment_id": "1000 + k",
    "commit_id": "concat('sha', cast(k as string))",
    "source_issue_id": "k",
    "dismissed_review_id": "case when k % 3 = 0 then k end",
    "dismissed_id": "case when k % 3 = 1 then 500 + k end",
    "review_id": "900 + k",
}
# Ownership file lines, three per nation; at most 75 lines in all.
OWNER_LINES = [
    "concat(case n_nationkey % 5 when 0 then '*.md' when 1 then 'economy/' when 2 then 'small/brand-1?/*' "
    "when 3 then 'promo/tests/' else 'ring.py' end, ' @acme/nation-', cast(n_nationkey as string))",
    f"concat({_case_list('n_nationkey % 6', PART_TYPES)}, '/brand-', cast(n_nationkey as string), "
    "'/  @supplier-', lpad(cast(n_nationkey as string), 9, '0'), ' @acme/nation-', cast(n_nationkey as string))",
    "concat(case when n_nationkey % 2 = 0 then '# no owner for ' else '' end, "
    f"{_case_list('n_nationkey % 6', PART_TYPES)}, '/*_[rw]*.go @supplier-', lpad(cast((n_nationkey * 3) % 25 as string), 9, '0'))",
]


def _sel(columns: dict[str, str]) -> list[str]:
    return [f"{expr} as {name}" for name, expr in columns.items()]


def _sql_sel(columns: dict[str, str]) -> str:
    return ", ".join(_sel(columns))


class DriverTables:
    """History tables derived from the driver's parquet files.

    Attributes are lazy DataFrames; only the columns a query touches are read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def repos(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "cast(r_regionkey as bigint) as repo_id", "concat('acme/', lower(r_name)) as full_name"
        )

    @cached_property
    def users(self) -> DataFrame:
        people = self.raw("customer").selectExpr(
            "c_custkey * 2 as user_id", "lower(replace(c_name, '#', '-')) as login", "'User' as type"
        )
        reviewers = self.raw("supplier").selectExpr(
            "s_suppkey * 2 + 1 as user_id",
            f"{SUPPLIER_LOGIN} as login",
            "case when s_suppkey % 10 = 0 then 'Bot' else 'User' end as type",
        )
        return people.unionByName(reviewers)

    @cached_property
    def teams(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "cast(n_nationkey as bigint) as team_id",
            "lower(replace(n_name, '_', '-')) as slug",
            "cast(n_regionkey as bigint) as repo_id",
        )

    @cached_property
    def team_roster(self) -> DataFrame:
        """(team_key, member): keys appear in the three spellings a roster may use."""
        return self.raw("supplier").selectExpr(
            "case s_nationkey % 3 when 0 then concat('acme/nation-', cast(s_nationkey as string)) "
            "when 1 then concat('team:nation-', cast(s_nationkey as string)) "
            "else concat('nation-', cast(s_nationkey as string)) end as team_key",
            f"{SUPPLIER_LOGIN} as member",
        )

    @cached_property
    def _orders_in_repo(self) -> DataFrame:
        customers = self.raw("customer").select("c_custkey", "c_nationkey")
        nations = self.raw("nation").select("n_nationkey", "n_regionkey")
        return (
            self.raw("orders")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        )

    @cached_property
    def pull_requests(self) -> DataFrame:
        return self._orders_in_repo.selectExpr(*_sel(PR_COLUMNS))

    @cached_property
    def pr_text(self) -> DataFrame:
        """(pr_id, title, body): the body starts with a whole document where one exists."""
        docs = self.raw("documents").select("doc_id", F.col("text").alias("doc_text"))
        return (
            self.raw("orders")
            .select("o_orderkey", "o_custkey", "o_orderpriority")
            .join(docs, F.col("o_orderkey") == F.col("doc_id"), "left")
            .selectExpr(
                "o_orderkey as pr_id",
                f"{TITLE} as title",
                f"concat(coalesce(concat(doc_text, chr(10)), ''), {BODY_TAIL}) as body",
            )
        )

    @cached_property
    def _pr_repo(self) -> DataFrame:
        return self.pull_requests.select("pr_id", "repo_id", "author_id", F.col("created_at").alias("pr_created_at"))

    @cached_property
    def landed_files(self) -> DataFrame:
        """File rows as they land: the same file of a head may arrive more than once."""
        parts = self.raw("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        return (
            self.raw("lineitem")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .selectExpr(*_sel(FILE_COLUMNS))
        )

    @cached_property
    def pr_files(self) -> DataFrame:
        from hindcast.operators.upsert import keep_latest

        return keep_latest(self.landed_files, ["pr_id", "head_sha", "path"], ["seq"]).drop("seq")

    @cached_property
    def reviews(self) -> DataFrame:
        rows = self.raw("lineitem").filter("l_linenumber <= 4").selectExpr(*_sel(REVIEW_COLUMNS))
        return rows.join(self._pr_repo.select("pr_id", "repo_id"), "pr_id")

    @cached_property
    def comments(self) -> DataFrame:
        rows = self.raw("lineitem").filter("l_linenumber > 4").selectExpr(*_sel(COMMENT_COLUMNS))
        return (
            rows.join(self._pr_repo.select("pr_id", "repo_id", "author_id"), "pr_id")
            .withColumn("user_id", F.expr("case when by_author then author_id else supplier_user_id end"))
            .drop("by_author", "author_id", "supplier_user_id")
        )

    @cached_property
    def head_events(self) -> DataFrame:
        """``head.set`` events: (pr_id, head_sha, occurred_at, event_id)."""
        prs = self.raw("orders").selectExpr("o_orderkey as pr_id", f"{CREATED_AT} as created_at")
        first = prs.selectExpr(
            "pr_id", "'F' as head_sha", "created_at as occurred_at", "concat('head-', cast(pr_id as string), '-0') as event_id"
        )
        second = prs.filter("pr_id % 3 <> 0").selectExpr(
            "pr_id",
            "'O' as head_sha",
            "created_at + (pr_id % 6 + 1) * interval '1' day as occurred_at",
            "concat('head-', cast(pr_id as string), '-1') as event_id",
        )
        return first.unionByName(second)

    @cached_property
    def draft_events(self) -> DataFrame:
        """``draft.set`` events: (pr_id, is_draft, occurred_at, event_id)."""
        prs = self.raw("orders").selectExpr("o_orderkey as pr_id", f"{CREATED_AT} as created_at")
        first = prs.selectExpr(
            "pr_id", "pr_id % 4 = 0 as is_draft", "created_at as occurred_at",
            "concat('draft-', cast(pr_id as string), '-0') as event_id",
        )
        ready = prs.filter("pr_id % 4 = 0").selectExpr(
            "pr_id", "false as is_draft",
            "created_at + (pr_id % 100) * interval '1' hour as occurred_at",
            "concat('draft-', cast(pr_id as string), '-1') as event_id",
        )
        return first.unionByName(ready)

    @cached_property
    def request_events(self) -> DataFrame:
        """``review_request`` add/remove events with the reviewer they concern."""
        rows = (
            self.raw("lineitem").filter("l_linenumber <= 2").selectExpr(*_sel(REQUEST_COLUMNS))
            .join(self._pr_repo.select("pr_id", "repo_id", "pr_created_at"), "pr_id")
            .withColumn("add_at", F.expr("pr_created_at + add_hours * interval '1' hour"))
        )
        keep = ["pr_id", "repo_id", "reviewer_type", "reviewer_id"]
        added = rows.selectExpr(*keep, "'add' as op", "add_at as occurred_at", "concat('req-', request_id, '-0') as event_id")
        removed = rows.filter("keep_hours is not null").selectExpr(
            *keep, "'remove' as op", "add_at + keep_hours * interval '1' hour as occurred_at",
            "concat('req-', request_id, '-1') as event_id",
        )
        return added.unionByName(removed)

    @cached_property
    def timeline_payloads(self) -> DataFrame:
        """Landed timeline objects: keys plus the payload as JSON text."""
        rows = self.raw("events").selectExpr(*_sel(TIMELINE_COLUMNS)).selectExpr("*", *_sel(TIMELINE_PAYLOAD))
        payload = """to_json(named_struct(
            'event', event,
            'created_at', date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
            'actor', named_struct('id', actor_id),
            'label', named_struct('id', label_id),
            'assignee', named_struct('id', assignee_id),
            'milestone', named_struct('id', milestone_id),
            'requested_reviewer', case when reviewer_id is not null then named_struct('id', reviewer_id) end,
            'requested_team', case when team_id is not null then named_struct('id', team_id) end,
            'title', title, 'body', body,
            'issue', named_struct('title', issue_title, 'body', issue_body),
            'rename', named_struct('to', rename_to),
            'comment', named_struct('id', nested_comment_id, 'body', comment_body),
            'comment_id', comment_id, 'commit_id', commit_id,
            'source', named_struct('issue', named_struct('id', source_issue_id)),
            'dismissed_review', named_struct('review_id', dismissed_review_id, 'id', dismissed_id),
            'review_id', review_id))"""
        return rows.selectExpr("event_id", "repo_id", "issue_id", "pull_request_id", f"{payload} as payload")

    @cached_property
    def ownership_files(self) -> DataFrame:
        """(repo_id, base_sha, path, text): one ownership file per repo and pinned sha."""
        lines = self.raw("nation").selectExpr(
            "cast(n_regionkey as bigint) as repo_id", "n_nationkey",
            "explode(array('F', 'O')) as status", *[f"{e} as line{i}" for i, e in enumerate(OWNER_LINES)],
        )
        return (
            lines.groupBy("repo_id", "status")
            .agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("n_nationkey", "line0", "line1", "line2"))),
                lambda s: F.concat_ws("\n", s.line0, s.line1, s.line2)), "\n\n").alias("text"))
            .selectExpr(
                "repo_id", "concat('base-', status) as base_sha",
                "case status when 'F' then '.github/CODEOWNERS' else 'CODEOWNERS' end as path", "text")
        )


# --- the same tables as SQL views for the checks ----------------------------------
VIEWS: dict[str, tuple[list[str], str]] = {
    "repos": ([], "select cast(r_regionkey as bigint) as repo_id, concat('acme/', lower(r_name)) as full_name from region"),
    "users": ([], "select c_custkey * 2 as user_id, lower(replace(c_name, '#', '-')) as login, 'User' as type from customer "
                  f"union all select s_suppkey * 2 + 1, {SUPPLIER_LOGIN}, case when s_suppkey % 10 = 0 then 'Bot' else 'User' end from supplier"),
    "teams": ([], "select cast(n_nationkey as bigint) as team_id, lower(replace(n_name, '_', '-')) as slug, "
                  "cast(n_regionkey as bigint) as repo_id from nation"),
    "team_roster": ([], "select case s_nationkey % 3 when 0 then concat('acme/nation-', cast(s_nationkey as string)) "
                        "when 1 then concat('team:nation-', cast(s_nationkey as string)) "
                        f"else concat('nation-', cast(s_nationkey as string)) end as team_key, {SUPPLIER_LOGIN} as member from supplier"),
    "pull_requests": ([], f"select {_sql_sel(PR_COLUMNS)} from orders join customer on o_custkey = c_custkey "
                          "join nation on c_nationkey = n_nationkey"),
    "pr_text": ([], f"select o_orderkey as pr_id, {TITLE} as title, "
                    f"concat(coalesce(d.text || chr(10), ''), {BODY_TAIL}) as body "
                    "from orders left join documents d on o_orderkey = d.doc_id"),
    "landed_files": ([], f"select {_sql_sel(FILE_COLUMNS)} from lineitem join part on l_partkey = p_partkey"),
    "pr_files": (["landed_files"],
                 "select * exclude (rn, seq) from (select *, row_number() over (partition by pr_id, head_sha, path "
                 "order by seq desc) as rn from landed_files) where rn = 1"),
    "reviews": (["pull_requests"],
                f"select r.*, p.repo_id from (select {_sql_sel(REVIEW_COLUMNS)} from lineitem where l_linenumber <= 4) r "
                "join pull_requests p using (pr_id)"),
    "comments": (["pull_requests"],
                 "select c.* exclude (supplier_user_id, by_author), p.repo_id, "
                 "case when by_author then p.author_id else supplier_user_id end as user_id "
                 f"from (select {_sql_sel(COMMENT_COLUMNS)} from lineitem where l_linenumber > 4) c "
                 "join pull_requests p using (pr_id)"),
    "head_events": ([], f"select o_orderkey as pr_id, 'F' as head_sha, {CREATED_AT} as occurred_at, "
                        "concat('head-', cast(o_orderkey as string), '-0') as event_id from orders union all "
                        f"select o_orderkey, 'O', {CREATED_AT} + (o_orderkey % 6 + 1) * interval '1' day, "
                        "concat('head-', cast(o_orderkey as string), '-1') from orders where o_orderkey % 3 <> 0"),
    "draft_events": ([], f"select o_orderkey as pr_id, o_orderkey % 4 = 0 as is_draft, {CREATED_AT} as occurred_at, "
                         "concat('draft-', cast(o_orderkey as string), '-0') as event_id from orders union all "
                         f"select o_orderkey, false, {CREATED_AT} + (o_orderkey % 100) * interval '1' hour, "
                         "concat('draft-', cast(o_orderkey as string), '-1') from orders where o_orderkey % 4 = 0"),
    "request_rows": (["pull_requests"],
                     "select q.*, p.repo_id, p.created_at + add_hours * interval '1' hour as add_at from "
                     f"(select {_sql_sel(REQUEST_COLUMNS)} from lineitem where l_linenumber <= 2) q "
                     "join pull_requests p using (pr_id)"),
    "request_events": (["request_rows"],
                       "select pr_id, repo_id, reviewer_type, reviewer_id, 'add' as op, add_at as occurred_at, "
                       "concat('req-', request_id, '-0') as event_id from request_rows union all "
                       "select pr_id, repo_id, reviewer_type, reviewer_id, 'remove', add_at + keep_hours * interval '1' hour, "
                       "concat('req-', request_id, '-1') from request_rows where keep_hours is not null"),
    "timeline": ([], f"select *, {_sql_sel(TIMELINE_PAYLOAD)} from (select {_sql_sel(TIMELINE_COLUMNS)} from events)"),
    "ownership_lines": ([], "select cast(n_regionkey as bigint) as repo_id, concat('base-', status) as base_sha, "
                            "n_nationkey * 4 + li as line_no, line from nation, "
                            "(select unnest(['F', 'O']) as status), "
                            f"lateral (select unnest([0, 1, 2]) as li, unnest([{', '.join(OWNER_LINES)}]) as line)"),
}


def with_views(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named views (and what they need), then ``body``.

    ``extra`` adds common table expressions after the views, in order.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} as ({VIEWS[n][1]})" for n in ordered]
    parts += [f"{n} as materialized ({sql})" for n, sql in (extra or {}).items()]
    return f"with {', '.join(parts)} {body}" if parts else body
