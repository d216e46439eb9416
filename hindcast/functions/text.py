"""Text signals of titles and bodies: mentions, gates, hints and bot categories.

Patterns are Unicode-aware where the history's own rules are: words are letters,
digits and underscore of any script, digits are of any script.  Every function
works on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
W = r"\p{L}\p{N}_"                       # word characters
S = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"        # white space
NS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
WB_END = rf"(?![{W}])"
WB_START = rf"(?<![{W}])"

TEAM_NAME = r"[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9][A-Za-z0-9-]*"
USER_NAME = r"[A-Za-z0-9][A-Za-z0-9-]{0,38}"
MENTION_TARGET = rf"(?<![A-Za-z0-9_])@({TEAM_NAME}|{USER_NAME})"
MENTION_USER = rf"(?<![A-Za-z0-9_])@({USER_NAME})"
MENTION_ANY = r"(?<![A-Za-z0-9_])@([A-Za-z0-9][A-Za-z0-9-]*(?:/[A-Za-z0-9][A-Za-z0-9-]*)?)"

URL = rf"https?://(?:(?![)\]]){NS})+"
ISSUE_HASH = rf"{WB_START}#\p{{Nd}}+{WB_END}"
TICKET = rf"{WB_START}[A-Z][A-Z0-9]+-\p{{Nd}}+{WB_END}"
ISSUE_URL = rf"(?iu)https?://github\.com/(?:(?!/){NS})+/(?:(?!/){NS})+/(?:issues|pull)/\p{{Nd}}+{WB_END}"
AI_LINE = (rf"(?idmu)^{S}*(?:ai(?:{S}+assist(?:ed|ance)?)?|genai|llm)(?:{S}+used)?{S}*:{S}*(?:yes|no|true|false){WB_END}")
PROVENANCE_LINE = rf"(?idmu)^{S}*(?:provenance|origin|source){S}*:{S}*(?:human|ai|mixed|unknown){WB_END}"
CHECKBOX = rf"(?dm)^{S}*[-*]{S}*\[([ xX])\]{S}*(.+?){S}*$"
CHECKED = rf"(?d)^{S}*[-*]{S}*\[[xX]\]"
CHECKBOX_HEAD = rf"(?d)^{S}*[-*]{S}*\[[ xX]\]{S}*"
AI_LABEL = rf"(?iu){WB_START}(?:ai|genai|llm|copilot|chatgpt|claude){WB_END}|{WB_START}no{WB_END}.*{WB_START}ai{WB_END}"
PROVENANCE_LABEL = (rf"(?iu){WB_START}(?:provenance|origin|source){WB_END}|"
                    rf"{WB_START}(?:human|manual|generated|assisted|mixed){WB_END}")
CHECKLIST = rf"(?dm)^{S}*[-*]{S}*\[(?: |x|X)\]{S}+.+$"
RISK_SECTION = rf"(?iu){WB_START}(?:risk|blast{S}*radius|rollback|mitigation){WB_END}"

WIP_HINTS = ["wip", "do not review", "dnr"]
HOTFIX_HINTS = ["hotfix", "urgent", "sev", "security fix", "quick fix"]
BOT_AUTHOR = r"(?i)(\[bot\]|dependabot|renovate|copilot|claude|github-actions)"
BOT_CATEGORIES = {
    "lint": rf"(?iu){WB_START}(?:lint|ruff|flake8|eslint|prettier){WB_END}",
    "test": rf"(?iu){WB_START}(?:test|pytest|junit|coverage|ci failed){WB_END}",
    "security": rf"(?iu){WB_START}(?:security|vuln|cve|sast|secret scan){WB_END}",
    "cla": rf"(?iu){WB_START}cla{WB_END}|contributor license",
    "dep_update": rf"(?idu){WB_START}(?:dependabot|renovate|dependency update|bump .* from .* to){WB_END}",
}


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"^{S}+", ""), rf"{S}+\z", "")


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(pattern), F.lit(group))


def mention_targets(text: Column) -> Column:
    """Array of (type, name): users and teams in order of first appearance, once each."""
    names = _matches(text, MENTION_TARGET, 1)
    lowered = F.transform(names, lambda n: F.lower(n))
    first = F.filter(names, lambda n, i: F.array_position(lowered, F.lower(n)) == i + 1)
    return F.transform(
        first, lambda n: F.struct(F.when(n.contains("/"), "team").otherwise("user").alias("type"), n.alias("name"))
    )


def mentioned_users(text: Column) -> Column:
    """Distinct user names after an ``@`` (a team mention yields its organisation)."""
    return F.array_distinct(_matches(text, MENTION_USER, 1))


def mention_ids(text: Column) -> Column:
    return _matches(text, MENTION_ANY, 1)


def _first(text: Column, pattern: str) -> Column:
    return strip(F.regexp_substr(text_or_empty(text), F.lit(pattern)))


def first_checked(text: Column, label: str) -> Column:
    """The first ticked checkbox line whose label matches."""
    lines = F.filter(
        _matches(text, CHECKBOX),
        lambda m: m.rlike(CHECKED) & F.regexp_replace(m, CHECKBOX_HEAD, "").rlike(label),
    )
    return strip(F.try_element_at(lines, F.lit(1)))


def gate_issue(body: Column) -> Column:
    return F.coalesce(_first(body, ISSUE_URL), _first(body, ISSUE_HASH), _first(body, TICKET))


def gate_ai_disclosure(body: Column) -> Column:
    return F.coalesce(_first(body, AI_LINE), first_checked(body, AI_LABEL))


def gate_provenance(body: Column) -> Column:
    return F.coalesce(_first(body, PROVENANCE_LINE), first_checked(body, PROVENANCE_LABEL))


def count_urls(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(URL)).cast("bigint")


def count_issue_refs(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(f"{ISSUE_HASH}|{TICKET}")).cast("bigint")


def contains_any(text: Column, hints: list[str]) -> Column:
    cond = F.lit(False)
    for h in hints:
        cond = cond | F.contains(text, F.lit(h))
    return cond


def title_is_wip(title: Column) -> Column:
    return contains_any(F.lower(text_or_empty(title)), WIP_HINTS)


def title_is_hotfix(title: Column) -> Column:
    return contains_any(F.lower(text_or_empty(title)), HOTFIX_HINTS)


def is_bot_login(login: Column) -> Column:
    return F.coalesce(F.lower(login).endswith("[bot]"), F.lit(False))


def is_bot(user_type: Column, login: Column) -> Column:
    """Bot by account type or by the login's suffix."""
    return F.coalesce(user_type == "Bot", F.lit(False)) | is_bot_login(login)


def login_features(login: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.lower(login).endswith("[bot]"), "bot_suffix"),
        F.when(login.contains("-"), "has_dash"),
        F.when(login.rlike(r"\p{Nd}"), "has_digit"),
    ))


def activity_kind(comment_type: Column, review_id: Column) -> Column:
    """Kind of a comment: part of a review or free-standing."""
    in_review = F.coalesce(comment_type == "review", F.lit(False)) | review_id.isNotNull()
    return F.when(in_review, "review_comment_created").otherwise("comment_created")


def review_bucket(state: Column) -> Column:
    s = F.lower(F.coalesce(state, F.lit("commented")))
    return (F.when(s.contains("approv"), "approve")
            .when(s.contains("request") | s.contains("changes"), "changes_requested").otherwise("comment"))


def team_key_variants(team: Column) -> Column:
    """Spellings under which a team may appear in a roster."""
    t = F.lower(strip(team))
    return F.array_distinct(F.array_compact(F.array(
        t,
        F.when(t.startswith("team:"), F.regexp_replace(t, "^team:", "")),
        F.when(t.contains("/"), F.regexp_replace(t, "^[^/]*/", "")).otherwise(F.concat(F.lit("team:"), t)),
    )))
