"""Ownership files: rules, matching of paths, the ownership graph and its coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import paths as P
from hindcast.functions import text as X
from hindcast.sources.files import OWNERSHIP_PATHS, first_existing

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CONTRIBUTING_PATHS = ["CONTRIBUTING.md", ".github/CONTRIBUTING.md"]


def ownership_rules(texts: DataFrame) -> DataFrame:
    """(repo_id, base_sha, line, pattern, targets) from the preferred ownership file.

    Comments, blank lines and lines naming no owner are not rules.
    """
    chosen = first_existing(texts, ["repo_id", "base_sha"], OWNERSHIP_PATHS)
    lines = chosen.select("repo_id", "base_sha", "path", F.posexplode(F.split("text", LINE_BREAK)).alias("n", "raw"))
    parts = F.split(F.col("s"), f"{X.S}+")
    return (
        lines.withColumn("s", X.strip(F.col("raw")))
        .filter((F.col("s") != "") & ~F.col("s").startswith("#"))
        .withColumn("parts", parts)
        .filter(F.size("parts") >= 2)
        .select(
            "repo_id", "base_sha", F.col("path").alias("file"), (F.col("n") + 1).cast("bigint").alias("line"),
            F.col("parts")[0].alias("pattern"),
            X.mention_targets(F.array_join(F.slice("parts", F.lit(2), F.size("parts")), " ")).alias("targets"),
        )
        .filter(F.size("targets") > 0)
    )


def match_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (path, rule) hit for the paths of each (repo, base_sha).

    All matching rules count, not only the last.  A pattern ending in ``/`` is a
    prefix; one without wildcards matches as a suffix: both become equi-joins on
    the prefixes and suffixes of the distinct paths.  Only true globs are tested
    one by one, inside their (repo, base_sha).
    """
    keys = ["repo_id", "base_sha"]
    distinct = paths.select(*keys, "path").distinct()
    is_dir = F.col("pattern").endswith("/")
    is_glob = ~is_dir & F.col("pattern").rlike(r"[*?\[]")
    columns = [*keys, "line", "pattern", "targets"]

    tokens = F.concat(
        F.transform(
            F.sequence(F.lit(1), F.size(F.split("path", "/"))),
            lambda i: F.concat(F.lit("p:"), F.array_join(F.slice(F.split("path", "/"), F.lit(1), i - 1), "/"), F.lit("/")),
        ),
        F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.concat(F.lit("s:"), F.substr(F.col("path"), i))),
    )
    plain = rules.filter(~is_glob).select(
        *columns,
        F.when(is_dir, F.concat(F.lit("p:"), F.col("pattern")))
        .otherwise(F.concat(F.lit("s:"), F.regexp_replace("pattern", "^/+", ""))).alias("token"),
    )
    by_token = distinct.withColumn("token", F.explode(F.array_distinct(tokens))).join(plain, [*keys, "token"]).drop("token")
    globs = rules.filter(is_glob).select(*columns, P.glob_regex(F.col("pattern")).alias("rx"))
    by_glob = distinct.join(globs, keys).filter(F.expr("path rlike rx")).drop("rx")
    return by_token.select(*keys, "path", "line", "pattern", "targets").unionByName(
        by_glob.select(*keys, "path", "line", "pattern", "targets"))


def file_owner_hits(pr_files: DataFrame, rules: DataFrame) -> DataFrame:
    """(pr_id, path, line, pattern, target_type, target_name) for PR files with repo_id and base_sha."""
    hits = match_paths(pr_files, rules)
    return pr_files.select("pr_id", "repo_id", "base_sha", "path").join(hits, ["repo_id", "base_sha", "path"]).select(
        "pr_id", "path", "line", "pattern", F.explode("targets").alias("t")
    ).select("pr_id", "path", "line", "pattern", F.col("t.type").alias("target_type"), F.col("t.name").alias("target_name"))


def path_owners(pr_files: DataFrame, rules: DataFrame) -> DataFrame:
    """(pr_id, targets): for each file that has owners, its targets (type, name, n) with the number of rules that name them.

    Rules are counted per distinct path, so a file meets one row and no rule moves with it.
    """
    keys = ["repo_id", "base_sha", "path"]
    hits = match_paths(pr_files, rules).select(*keys, F.explode("targets").alias("t"))
    per_path = hits.groupBy(*keys, "t.type", "t.name").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.collect_list(F.struct("type", "name", "n")).alias("targets"))
    return pr_files.select("pr_id", *keys).join(per_path, keys).select("pr_id", "targets")


def graph(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): owners and the path patterns they own."""
    flat = rules.select("repo_id", "base_sha", "file", "line", "pattern", F.explode("targets").alias("t")).select(
        "repo_id", "base_sha", "file", "line", "pattern",
        F.when(F.col("t.type") == "team", "team").otherwise("person").alias("kind"), F.col("t.name").alias("name"),
    ).withColumn("node_id", F.concat(F.col("kind"), F.lit(":"), F.lower("name")))
    nodes = flat.groupBy("repo_id", "base_sha", "node_id", "kind").agg(
        F.min_by("name", "line").alias("name"), F.min("line").alias("line"))
    edges = flat.select(
        "repo_id", "base_sha", F.lit("OWNS").alias("relation"), F.col("node_id").alias("source_node_id"),
        F.col("pattern").alias("path_glob"), P.rule_boundary(F.col("pattern")).alias("boundary"), "line")
    return nodes, edges


def boundary_globs(edges: DataFrame) -> DataFrame:
    """The distinct patterns of each ownership boundary."""
    return edges.select("repo_id", "base_sha", "boundary", "path_glob").distinct()


def rules_from_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rules rebuilt from a stored graph: owners grouped by pattern."""
    owners = nodes.select("repo_id", "base_sha", F.col("node_id").alias("source_node_id"), F.struct(
        F.when(F.col("kind") == "team", "team").otherwise("user").alias("type"), F.col("name").alias("name")).alias("target"))
    return (
        edges.filter((F.upper("relation") == "OWNS") & (F.trim("path_glob") != ""))
        .join(owners, ["repo_id", "base_sha", "source_node_id"])
        .groupBy("repo_id", "base_sha", F.trim("path_glob").alias("pattern"))
        .agg(F.min("line").alias("line"), F.array_sort(F.collect_set("target")).alias("targets"))
    )


def policy_signals(texts: DataFrame) -> DataFrame:
    """(repo_id, base_sha, key, value): what the contribution guide talks about."""
    keys = ["repo_id", "base_sha"]
    owned = texts.filter(F.col("path").isin(*OWNERSHIP_PATHS)).select(*keys).distinct().withColumn("has_owners", F.lit(True))
    guide = first_existing(texts, keys, CONTRIBUTING_PATHS).select(*keys, F.lower("text").alias("g"))
    rows = texts.select(*keys).distinct().join(owned, keys, "left").join(guide, keys, "left")
    g = F.coalesce(F.col("g"), F.lit(""))
    said = lambda cond: F.when(cond, "mentioned").otherwise("unknown")
    pairs = F.array(
        F.struct(F.lit("codeowners_present").alias("key"),
                 F.when(F.col("has_owners"), "yes").otherwise("no").alias("value")),
        F.struct(F.lit("issue_reference_policy").alias("key"), said(g.contains("issue")).alias("value")),
        F.struct(F.lit("ai_disclosure_policy").alias("key"), said(g.contains("ai") & g.contains("disclosure")).alias("value")),
        F.struct(F.lit("provenance_policy").alias("key"), said(g.contains("provenance")).alias("value")),
    )
    return rows.select(*keys, F.inline(pairs))


def vocabulary(signals: DataFrame) -> DataFrame:
    """Terms of the guide and the gate each speaks to."""
    term = {"issue_reference_policy": ("issue", "link_issue", "issue"),
            "ai_disclosure_policy": ("ai disclosure", "disclose_ai_usage", "ai_disclosure"),
            "provenance_policy": ("provenance", "supply_provenance", "provenance")}
    pick = lambda i: F.coalesce(*[F.when(F.col("key") == k, v[i]) for k, v in term.items()])
    return signals.filter((F.col("value") == "mentioned") & F.col("key").isin(*term)).select(
        "repo_id", "base_sha", pick(0).alias("token"), pick(1).alias("canonical_intent"), pick(2).alias("gate"))


def artifact_coverage(prs: DataFrame, texts: DataFrame, requested: list[str]) -> DataFrame:
    """PR-weighted presence rate of each requested path.

    Pull requests are counted per (repo, base_sha) first, so the requested list
    is spread over shas, never over pull requests.
    """
    per_sha = prs.filter(F.col("base_sha").isNotNull() & (F.col("base_sha") != "")).groupBy("repo_id", "base_sha").agg(
        F.count("*").alias("prs"))
    wanted = per_sha.withColumn("path", F.explode(F.array(*[F.lit(p) for p in sorted(set(requested), key=str.lower)])))
    present = texts.select("repo_id", "base_sha", "path").distinct().withColumn("there", F.lit(1))
    counted = wanted.join(present, ["repo_id", "base_sha", "path"], "left").groupBy("repo_id", "path").agg(
        F.sum(F.when(F.col("there") == 1, F.col("prs")).otherwise(0)).alias("present_pr_count"),
        F.sum(F.when(F.col("there").isNull(), F.col("prs")).otherwise(0)).alias("missing_pr_count"))
    total = F.col("present_pr_count") + F.col("missing_pr_count")
    return counted.withColumn("present_rate", F.col("present_pr_count") / total)


def profile_warnings(prs: DataFrame, texts: DataFrame, rules: DataFrame, critical: list[str]) -> DataFrame:
    """(repo_id, base_sha, warning): missing ownership file, empty graph, missing critical files."""
    keys = ["repo_id", "base_sha"]
    shas = prs.select(*keys).distinct()
    owned = texts.filter(F.col("path").isin(*OWNERSHIP_PATHS)).select(*keys).distinct()
    no_file = shas.join(owned, keys, "left_anti").withColumn("warning", F.lit("CODEOWNERS not found in pinned artifacts"))
    no_rule = shas.join(rules.select(*keys).distinct(), keys, "left_anti").withColumn("warning", F.lit("ownership graph is empty"))
    wanted = shas.withColumn("path", F.explode(F.array(*[F.lit(c) for c in critical])))
    missing = (
        wanted.join(texts.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")
        .groupBy(*keys).agg(F.array_sort(F.collect_set("path")).alias("m"))
        .select(*keys, F.concat(F.lit("missing critical artifacts: "), F.array_join("m", ", ")).alias("warning"))
    )
    return no_file.unionByName(no_rule).unionByName(missing)


def expand_teams(teams: DataFrame, roster: DataFrame, team: str = "team") -> DataFrame:
    """Members of each team row through every spelling of its key."""
    known = roster.select(F.lower(F.trim("team_key")).alias("_key"), "member").distinct()
    return (
        teams.withColumn("_key", F.explode(X.team_key_variants(F.col(team)))).join(known, "_key").drop("_key").distinct()
    )


def first_rule_override(paths: DataFrame, overrides: DataFrame) -> DataFrame:
    """Boundary of each path: the first matching override, else its top segment.

    ``overrides``: (repo_id, position, pattern, boundary) in file order.
    """
    globs = overrides.withColumn("rx", P.glob_regex(F.col("pattern")))
    distinct = paths.select("repo_id", "path").distinct()
    first = (
        distinct.join(globs, "repo_id").filter(F.expr("path rlike rx"))
        .groupBy("repo_id", "path").agg(F.min_by("boundary", "position").alias("_b"))
    )
    return paths.join(first, ["repo_id", "path"], "left").withColumn(
        "boundary", F.coalesce("_b", P.default_boundary(F.col("path")))).drop("_b")


def ranked(df: DataFrame, partition: list[str], order: list, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
