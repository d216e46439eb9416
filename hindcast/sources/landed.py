"""Readers for landed API pages and the flattening of nested objects.

A page is one JSON line ``{"repo_id":…, "resource":…, "seq":…, "items":[…]}``;
schemas are explicit, so nothing is inferred and only the named fields are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_USER = "struct<id: bigint, login: string, type: string, site_admin: boolean, avatar_url: string>"

# The fields of each API object that history keeps.
ITEM_SCHEMAS = {
    "users": "id bigint, login string, type string, site_admin boolean, avatar_url string",
    "teams": "id bigint, slug string, name string",
    "repos": (f"id bigint, owner {_USER}, name string, full_name string, private boolean, description string, "
              "default_branch string, created_at string, updated_at string, pushed_at string, archived boolean, disabled boolean"),
    "labels": "id bigint, name string, color string, description string, default boolean",
    "milestones": ("id bigint, number bigint, title string, state string, description string, due_on string, "
                   "closed_at string, created_at string, updated_at string"),
    "issues": (f"id bigint, number bigint, user {_USER}, title string, body string, state string, created_at string, "
               "updated_at string, closed_at string, pull_request struct<url: string>, locked boolean"),
    "pulls": (f"id bigint, number bigint, user {_USER}, title string, body string, state string, draft boolean, merged boolean, "
              "merge_commit_sha string, head struct<sha: string, ref: string>, base struct<sha: string, ref: string>, "
              "created_at string, updated_at string, closed_at string, merged_at string"),
    "pull_files": "filename string, path string, status string, additions bigint, deletions bigint, changes bigint",
    "reviews": f"id bigint, user {_USER}, state string, body string, submitted_at string, commit_id string",
    "comments": (f"id bigint, user {_USER}, body string, created_at string, updated_at string, path string, position bigint, "
                 "commit_id string, in_reply_to_id bigint, pull_request_review_id bigint"),
    "commits": ("sha string, author struct<id: bigint>, committer struct<id: bigint>, commit struct<message: string, "
                "author: struct<name: string, email: string, date: string>, committer: struct<name: string, email: string, date: string>>"),
    "branches": "name string, commit struct<sha: string>, protected boolean",
    "tags": "name string, commit struct<sha: string>",
    "releases": ("id bigint, tag_name string, name string, draft boolean, prerelease boolean, created_at string, "
                 "published_at string, author struct<id: bigint>, body string, target_commitish string"),
}

_T = "to_timestamp({0}) as {1}"
FLATTEN = {
    "users": ["id as user_id", "login", "type", "site_admin", "avatar_url"],
    "teams": ["id as team_id", "slug", "name"],
    "repos": ["id as repo_id", "owner.id as owner_id", "coalesce(owner.login, '') as owner_login", "name", "full_name",
              "private as is_private", "description", "default_branch", _T.format("created_at", "created_at"),
              _T.format("updated_at", "updated_at"), _T.format("pushed_at", "pushed_at"), "archived", "disabled"],
    "labels": ["id as label_id", "name", "color", "description", "default as is_default"],
    "milestones": ["id as milestone_id", "number", "title", "state", "description", _T.format("due_on", "due_on"),
                   _T.format("closed_at", "closed_at"), _T.format("created_at", "created_at"), _T.format("updated_at", "updated_at")],
    "issues": ["id as issue_id", "number", "user.id as author_id", "title", "body", "state", _T.format("created_at", "created_at"),
               _T.format("updated_at", "updated_at"), _T.format("closed_at", "closed_at"),
               "pull_request is not null as is_pull_request", "locked"],
    "pulls": ["id as pr_id", "number", "user.id as author_id", "title", "body", "state", "draft", "merged", "merge_commit_sha",
              "head.sha as head_sha", "head.ref as head_ref", "base.sha as base_sha", "base.ref as base_ref",
              _T.format("created_at", "created_at"), _T.format("updated_at", "updated_at"),
              _T.format("closed_at", "closed_at"), _T.format("merged_at", "merged_at")],
    "pull_files": ["coalesce(nullif(filename, ''), path) as path", "status", "additions", "deletions", "changes"],
    "reviews": ["id as review_id", "user.id as user_id", "state", "body", _T.format("submitted_at", "submitted_at"), "commit_id"],
    "comments": ["id as comment_id", "user.id as user_id", "body", _T.format("created_at", "created_at"),
                 _T.format("updated_at", "updated_at"), "path", "position", "commit_id", "in_reply_to_id",
                 "pull_request_review_id as review_id",
                 "case when pull_request_review_id is not null then 'review' else 'issue' end as comment_type"],
    "commits": ["sha", "author.id as author_id", "committer.id as committer_id", "commit.author.name as author_name",
                "commit.author.email as author_email", "commit.committer.name as committer_name",
                "commit.committer.email as committer_email", "commit.message as message",
                _T.format("commit.author.date", "authored_at"), _T.format("commit.committer.date", "committed_at")],
    "branches": ["'branch' as ref_type", "name", "commit.sha as sha", "protected as is_protected"],
    "tags": ["'tag' as ref_type", "name", "commit.sha as sha", "cast(null as boolean) as is_protected"],
    "releases": ["id as release_id", "tag_name", "name", "draft", "prerelease", _T.format("created_at", "created_at"),
                 _T.format("published_at", "published_at"), "author.id as author_id", "body", "target_commitish"],
}
# Primary keys of the entity tables; a row without its key is not stored.
ENTITY_KEYS = {
    "users": ["user_id"], "teams": ["team_id"], "repos": ["repo_id"], "labels": ["label_id"],
    "milestones": ["milestone_id"], "issues": ["issue_id"], "pulls": ["pr_id"], "reviews": ["review_id"],
    "pull_files": ["repo_id", "pr_id", "head_sha", "path"],
    "comments": ["comment_id"], "commits": ["repo_id", "sha"], "branches": ["repo_id", "ref_type", "name"],
    "tags": ["repo_id", "ref_type", "name"], "releases": ["release_id"],
}


def page_schema(resource: str) -> str:
    return (f"repo_id bigint, resource string, seq bigint, page bigint, next_page bigint, pr_id bigint, issue_id bigint, "
            f"head_sha string, items array<struct<{_colon(ITEM_SCHEMAS[resource])}>>")


def _colon(fields: str) -> str:
    """``a bigint, b struct<…>`` as struct members ``a: bigint, b: struct<…>``."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = fields[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


def read_pages(spark: SparkSession, path: str, resource: str) -> DataFrame:
    return spark.read.schema(page_schema(resource)).option("mode", "DROPMALFORMED").json(path)


def stream_pages(spark: SparkSession, path: str, resource: str) -> DataFrame:
    return spark.readStream.schema(page_schema(resource)).json(path)


def flatten_items(pages: DataFrame, resource: str, keep: list[str] | None = None) -> DataFrame:
    """One row per object of the pages, with the columns history keeps."""
    keep = keep or ["repo_id", "seq"]
    items = pages.select(*keep, F.explode("items").alias("item")).select(*keep, "item.*")
    return _flat(items, resource, keep)


def flatten_objects(rows: DataFrame, resource: str, json_column: str, keep: list[str]) -> DataFrame:
    """The same for rows that carry one object as JSON text."""
    parsed = rows.select(*keep, F.from_json(json_column, ITEM_SCHEMAS[resource]).alias("item")).select(*keep, "item.*")
    return _flat(parsed, resource, keep)


def _flat(items: DataFrame, resource: str, keep: list[str]) -> DataFrame:
    wanted = FLATTEN[resource]
    if resource == "repos":
        keep = [c for c in keep if c != "repo_id"]
    flat = items.selectExpr(*[f"`{c}`" for c in keep], *wanted)
    for key in ENTITY_KEYS[resource]:
        if key in flat.columns:
            flat = flat.filter(F.col(key).isNotNull())
    return flat
