"""Path keys: normal form, boundaries, directories, extensions and hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.functions.text import contains_any

# --- fixed values -----------------------------------------------------------------
ROOT = "__root__"
NO_EXTENSION = "__none__"
TEST_HINTS = ["test/", "tests/", "__tests__/", "spec/"]
DOC_HINTS = ["docs/", "doc/"]
DOC_SUFFIXES = [".md", ".rst", ".txt"]
CI_HINTS = [".github/", "ci/", "build/", ".circleci/"]
GENERATED_HINTS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "Pipfile.lock",
                   "vendor/", "dist/", "generated/"]
BINARY_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp", "pdf", "zip", "gz", "jar", "mp4", "mov", "ico",
                     "woff", "woff2", "ttf", "otf", "eot"]
LARGE_FILE_CHURN = 500


def normalize(path: Column) -> Column:
    p = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.when(p.startswith("./"), F.regexp_replace(p, r"^\./", "")).otherwise(p)


def boundary_name(path: Column) -> Column:
    """Top directory of the path, or the root name for files at the top."""
    p = normalize(path)
    top = F.trim(F.split_part(p, F.lit("/"), F.lit(1)))
    return F.when(~p.contains("/") | (top == ""), ROOT).otherwise(top)


def boundary_id(path: Column) -> Column:
    return F.concat(F.lit("dir:"), boundary_name(path))


def default_boundary(path: Column) -> Column:
    """First non-empty path segment, or the root name for files at the top."""
    first = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(1))
    return F.when(~path.contains("/") | first.isNull(), ROOT).otherwise(first)


def directory(path: Column, depth: int) -> Column:
    """Directory cut to ``depth`` segments, or the root name."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    dirs = F.slice(parts, F.lit(1), F.greatest(F.least(F.lit(depth), F.size(parts) - 1), F.lit(0)))
    return F.when(F.size(dirs) <= 0, ROOT).otherwise(F.array_join(dirs, "/"))


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; hidden files and bare dots have none."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    # The last dot splits the name unless it is its first or its last character.
    ext = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    return F.when(ext == "", NO_EXTENSION).otherwise(ext)


def parent(path: Column) -> Column:
    dirs = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(dirs == "", ROOT).otherwise(dirs)


def status_bucket(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("unknown")))
    return (F.when(s.isin("removed", "deleted"), "deleted").when(s.isin("renamed", "added"), s).otherwise("modified"))


def touches_tests(path: Column) -> Column:
    return contains_any(F.lower(path), TEST_HINTS)


def touches_docs(path: Column) -> Column:
    p = F.lower(path)
    return contains_any(p, DOC_HINTS) | p.endswith(".md") | p.endswith(".rst") | p.endswith(".txt")


def touches_ci(path: Column) -> Column:
    p = F.lower(path)
    return contains_any(p, CI_HINTS) | p.endswith("makefile")


def is_generated(path: Column) -> Column:
    """Lock, vendored or generated files; hints with capitals never match a lowered path."""
    return contains_any(F.lower(path), GENERATED_HINTS)


def is_binary(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def glob_regex(glob: Column) -> Column:
    """Shell pattern as an anchored regular expression: ``*`` and ``?`` cross slashes.

    A ``[`` without its ``]`` stands for itself, as does every other sign.
    """
    r = F.regexp_replace(glob, r"([\\.+^$(){}|])", r"\\$1")
    r = F.regexp_replace(r, r"\*", ".*")
    r = F.regexp_replace(r, r"\?", ".")
    r = F.regexp_replace(r, r"\[!([^\]]+)\]", "[^$1]")
    r = F.regexp_replace(r, r"\[(?![^\]]+\])", r"\\[")
    return F.concat(F.lit(r"(?s)\A"), r, F.lit(r"\z"))


def rule_boundary(pattern: Column) -> Column:
    """Boundary an ownership pattern speaks about."""
    p = F.regexp_replace(F.trim(pattern), "^/+", "")
    first = F.split_part(p, F.lit("/"), F.lit(1))
    return (
        F.when(p == "", "__unknown__")
        .when(p.startswith("*.") | p.startswith("**."), ROOT)
        .when(first.rlike(r"[*?\[]"), ROOT)
        .when(first == "", "__unknown__")
        .otherwise(first)
    )
