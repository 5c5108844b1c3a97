"""Scalar functions of the event log: ids, tool kinds, repository names, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BROWSERS = ("playwright", "browser", "chrome", "webfetch", "puppeteer")
SHELLS = ("bash", "shell", "exec")


def event_id(host: Column, source: Column, kind: Column, key: Column) -> Column:
    """32 hex digits of SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("|", host, source, kind, key), 256), 1, 32)


def content_id(host: Column, source: Column, kind: Column, record: Column) -> Column:
    """An id of a record's content, for records whose ordinals can't be trusted. Nulls within the record don't count."""
    return event_id(host, source, kind, F.concat(F.lit("content:"), F.to_json(record)))


def folder_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def token_estimate(text: Column) -> Column:
    """A quarter token per ASCII character and one per other character, rounded up; null for null."""
    ascii_ = F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil((ascii_ + 4 * (F.char_length(text) - ascii_)) / 4).cast("long")


def _mcp_part(tool: Column, k: int) -> Column:
    return F.when(tool.rlike("(?s)^mcp__.*?__"), F.regexp_extract(tool, "(?s)^mcp__(.*?)__(.*)$", k))


def mcp_server(tool: Column) -> Column:
    return _mcp_part(tool, 1)


def mcp_tool(tool: Column) -> Column:
    return _mcp_part(tool, 2)


def _browses(name: Column) -> Column:
    return F.lower(name).rlike("|".join(BROWSERS))


def tool_kind(tool: Column, shells: bool = False) -> Column:
    """mcp, browser, bash, skill or builtin. shells: names of shells count as bash, and browsers and skills aren't told apart."""
    server = mcp_server(tool)
    if shells:
        kind = F.when(server.isNotNull(), "mcp").when(F.lower(tool).isin(*SHELLS), "bash")
    else:
        kind = F.when(server.isNotNull(), F.when(_browses(server), "browser").otherwise("mcp")).when(tool == "Bash", "bash").when(tool == "Skill", "skill").when(_browses(tool), "browser")
    return F.when(tool.isNotNull(), kind.otherwise("builtin"))


def skill_of_command(command: Column) -> Column:
    """NAME of .../NAME/SKILL.md in a command."""
    return F.nullif(F.regexp_extract(command, r"([^/\s'\"]+)/SKILL\.md", 1), F.lit(""))


def repository(raw: Column) -> Column:
    """A remote without user information, query and fragment; null for what isn't one.

    URLs keep scheme, host and path. `user@host:path` loses its user, but for the public user git.
    """
    text = F.trim(raw)
    url = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", 0)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.regexp_extract(url, r"://([^/]*)", 1), "^.*@", "")
    rest = F.regexp_replace(url, r"^[^:]*://[^/]*", "")
    rest = F.when((rest == "") & (host != ""), "/").otherwise(rest)
    as_url = F.when(scheme.isin("http", "https", "ssh", "git", "file"), F.concat(scheme, F.lit("://"), F.lower(host), rest))
    path = F.regexp_extract(text, r"^[^?#]*", 0)
    user, remote = F.regexp_extract(path, r"^(.*)@([^@]*)$", 1), F.regexp_extract(path, r"^(.*)@([^@]*)$", 2)
    as_remote = F.when(remote.rlike("^[^:/]+:.+$"), F.when(user == "git", path).otherwise(remote))
    plain = F.when(path != "", path)
    out = F.when(text.contains("://"), as_url).when(path.contains("::"), F.lit(None)).when(path.contains("@"), as_remote).otherwise(plain)
    return F.when((text != "") & ~text.rlike(r"\p{Cntrl}"), out)


def glob_matches(repo: Column, patterns: list[str]) -> Column:
    """Case-sensitive: * stands for any run, ? for one character. No patterns allow all; a null never matches any."""
    if not patterns:
        return F.lit(True)
    import re

    parts = ["".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) for p in patterns]
    return F.coalesce(repo.rlike("(?s)^(?:" + "|".join(parts) + ")$"), F.lit(False))


def refined_clients(label: Column, observed: Column) -> Column:
    """A comma list with codex_desktop replaced by what was observed; null takes the observed."""
    have = F.split(label, ",")
    merged = F.array_distinct(F.concat(F.array_remove(have, "codex_desktop"), F.split(observed, ",")))
    return F.when(label.isNull(), observed).when(observed.isNotNull() & F.array_contains(have, "codex_desktop"), F.array_join(F.array_sort(merged), ",")).otherwise(label)
