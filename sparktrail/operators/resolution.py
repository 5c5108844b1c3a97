"""Which session, client and device an event belongs to: links, scopes, and records of one activity on two devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.session import stored

FACTS = ("message.usage.link", "message.usage.link.rejected", "session.client")


def resolve_links(raw: DataFrame) -> DataFrame:
    """Events without facts; desktop requests moved to the chat and turn that a content link names.

    A link counts if it is the only one of its host, session and key and none was rejected: links that disagree cancel
    each other, also later ones, so links are always computed from all facts. Sessions whose originator was observed
    take that client where theirs is unknown or just the desktop's.
    """
    facts = raw.filter("event_type = 'message.usage.link' and correlation_confidence = 'content_match' and session_id is not null and turn_id is not null")
    rejected = raw.filter("event_type = 'message.usage.link.rejected'").select("host_id", F.col("session_id").alias("parent_session_id"), "correlation_key").distinct()
    key = ["host_id", "parent_session_id", "correlation_key"]
    links = facts.join(rejected, key, "left_anti").groupBy(*key).agg(F.min(F.struct("session_id", "turn_id")).alias("to"), F.count_distinct("session_id", "turn_id").alias("n")).filter("n = 1")
    links = links.select(F.col("host_id").alias("_h"), F.col("parent_session_id").alias("_p"), F.col("correlation_key").alias("_k"), "to")
    observed = raw.filter("event_type = 'session.client' and agent = 'codex' and source = 'log' and correlation_confidence = 'observed_originator' and client = 'chatgpt_desktop_cowork'")
    clients = observed.groupBy(F.col("host_id").alias("_ch"), F.col("session_id").alias("_cs")).agg(F.min("client").alias("_client"))
    linked = (F.col("event_type") == "api.request") & (F.col("client") == "claude_desktop") & (F.col("host_id") == F.col("_h")) & (F.col("session_id") == F.col("_p")) & (F.col("correlation_key") == F.col("_k"))
    out = raw.filter(~F.col("event_type").isin(*FACTS)).join(links, linked, "left").join(clients, (F.col("host_id") == F.col("_ch")) & (F.col("session_id") == F.col("_cs")), "left")
    vague = (F.col("agent") == "codex") & (F.col("client").isNull() | (F.col("client") == "codex_desktop"))
    new = {
        "session_id": F.coalesce("to.session_id", "session_id"), "turn_id": F.coalesce("to.turn_id", "turn_id"),
        "client": F.when(vague, F.coalesce("_client", "client")).otherwise(F.col("client")), "correlation_confidence": F.when(F.col("to").isNotNull(), "content_match").otherwise(F.col("correlation_confidence")),
    }
    return out.withColumns(new).select(*raw.columns)


def resolve_scopes(ledger: DataFrame, scope: str, tombstones: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows of the local and one remote scope, once per event id, the local one first.

    Deleted ids are gone; a local row known under another id in the remote scope gives way to it, or to its deletion.
    aliases: (scope, local_id, remote_id).
    """
    rows = ledger.filter(F.col("scope").isin("local", scope))
    dead = tombstones.filter(F.col("scope") == scope).select("event_id").distinct()
    there = rows.filter(F.col("scope") == scope).select(F.col("event_id").alias("remote_id")).union(dead).distinct()
    replaced = aliases.filter(F.col("scope") == scope).join(there, "remote_id", "left_semi").select(F.col("local_id").alias("event_id")).distinct()
    local = rows.filter("scope = 'local'").join(replaced, "event_id", "left_anti").select(*rows.columns)
    kept = rows.filter("scope <> 'local'").unionByName(local).join(dead, "event_id", "left_anti").select(*rows.columns)
    order = Window.partitionBy("event_id").orderBy(F.desc(F.col("scope") == "local"))
    return kept.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def covered_deliveries(outbox: DataFrame, aliases: DataFrame, ledger: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(destination, event_id) of what needn't be sent: its counterpart in a remote scope has come down, or was deleted there.

    outbox: (destination, event_id); aliases: (scope, destination, local_id, remote_id); ledger and tombstones: (scope, event_id).
    """
    there = ledger.select("scope", "event_id").union(tombstones.select("scope", "event_id")).select("scope", F.col("event_id").alias("remote_id"))
    proven = aliases.join(there, ["scope", "remote_id"], "left_semi").select("destination", F.col("local_id").alias("event_id"))
    return outbox.select("destination", "event_id").join(proven, ["destination", "event_id"], "left_semi").distinct()


def origins(local: DataFrame, remote: DataFrame, aliases: DataFrame) -> DataFrame:
    """`origins` of `billing.observed_routes`: what this device knows of requests that a remote scope has under other ids.

    local and remote: events. A pair counts if both are of the same agent and session, the remote id isn't a local one as well,
    and the remote id has no other counterpart.
    """
    here = local.filter("event_type = 'api.request'").select(F.col("event_id").alias("local_id"), "agent", "session_id", "host_id", "provider", F.col("billing_route").alias("route"))
    far = remote.select(F.col("event_id").alias("remote_id"), "agent", "session_id").join(local.select(F.col("event_id").alias("remote_id")), "remote_id", "left_anti")
    pairs = aliases.select("local_id", "remote_id").distinct().join(here, "local_id").join(far, ["remote_id", "agent", "session_id"])
    only = F.count("*").over(Window.partitionBy("remote_id"))
    return pairs.withColumn("n", only).filter("n = 1").select("remote_id", "local_id", "host_id", "provider", "route")


def match_fingerprints(responses: DataFrame, messages: DataFrame, within_ms: int = 120_000) -> DataFrame:
    """(response_id, message_id, verdict): responses and messages of one fingerprint within two minutes.

    linked if each has only the other; rejected where a side has several.
    """
    # times meet in spans of that length and their neighbours, so that a common text isn't paired with all its copies
    span = lambda ts: F.floor(ts / within_ms)
    r = responses.withColumn("span", span(F.col("ts"))).alias("r")
    m = messages.withColumn("span", F.explode(F.sequence(span(F.col("ts")) - 1, span(F.col("ts")) + 1))).alias("m")
    near = (F.col("r.fingerprint") == F.col("m.fingerprint")) & (F.col("r.span") == F.col("m.span")) & (F.abs(F.col("r.ts") - F.col("m.ts")) <= within_ms)
    pairs = r.join(m, near).select("r.response_id", "m.message_id")
    many = lambda c: F.count("*").over(Window.partitionBy(c))
    pairs = pairs.withColumns({"a": many("response_id"), "b": many("message_id")})
    return pairs.select("response_id", "message_id", F.when((F.col("a") == 1) & (F.col("b") == 1), "linked").otherwise("rejected").alias("verdict"))


def fingerprints(texts: DataFrame, secret: bytes) -> DataFrame:
    """Add `fingerprint`: HMAC-SHA256 of `text` with line ends made equal. Spark has no HMAC, so batches go to Python."""

    @F.pandas_udf("string")
    def digest(text):
        import hashlib
        import hmac

        return text.map(lambda t: None if t is None else hmac.new(secret, t.replace("\r\n", "\n").encode(), hashlib.sha256).hexdigest())

    return texts.withColumn("fingerprint", digest("text"))


Rule = tuple[str, list[Column] | tuple[list[Column], list[Column]], bool]


def _keyed(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(k, event_id, ts, reasoning_tokens) of the rows whose key is known. k digests the key: whole rows as text would fill the sorts."""
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    key = F.unhex(F.sha2(F.to_json(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(columns)))), 256))
    return df.filter(known).select(key.alias("k"), "event_id", "ts", "reasoning_tokens")


def _pairs(left: DataFrame, right: DataFrame, rule: Rule, strict: bool) -> DataFrame:
    """Pairs of one rule. left and right: `_keyed` rows; both go by key in one shuffle, and meet by their numbers without a join."""
    name, _, unique = rule
    rows = left.withColumn("side", F.lit("a")).unionByName(right.withColumn("side", F.lit("b")))
    whole = Window.partitionBy("k", "side")
    rows = rows.withColumns({"n": F.row_number().over(whole.orderBy("ts", "event_id")), "of": F.count("*").over(whole)})
    of_side = lambda s: F.max(F.when(F.col("side") == s, F.struct("event_id", "reasoning_tokens", "of"))).alias(s)
    both = rows.groupBy("k", "n").agg(of_side("a"), of_side("b")).filter("a is not null and b is not null")
    once = (F.col("a.of") == 1) & (F.col("b.of") == 1)
    left_id = F.col("a.event_id")
    if unique and strict:
        left_id = F.when(~once, F.raise_error(F.concat(F.lit(f"ambiguous {name}: "), "a.event_id")).cast("string")).otherwise(left_id)
    elif unique:
        both = both.filter(once)
    other = F.col("a.reasoning_tokens") != F.col("b.reasoning_tokens")
    left_id = F.when(other, F.raise_error(F.concat(F.lit("conflicting reasoning tokens: "), "a.event_id")).cast("string")).otherwise(left_id)
    return both.select(left_id.alias("left_id"), F.col("b.event_id").alias("right_id"), F.lit(name).alias("rule"))


def unmatched(df: DataFrame, found: DataFrame | None, id_: str) -> DataFrame:
    """df without the rows of pairs. Pairs grow with the log, so they are merged and never sent whole by the driver."""
    return df if found is None else df.join(found.select(F.col(id_).alias("event_id")).hint("merge"), "event_id", "left_anti").select(*df.columns)


def link_devices(left: DataFrame, right: DataFrame, rules: list[Rule], strict: bool = True) -> DataFrame:
    """(left_id, right_id, rule): the same observations under the ids of two devices.

    Rules apply in order, each to what is still unmatched: (name, key columns, unique); the key may be a pair, of the left
    and of the right side. Rows of equal keys are paired in the order of ts and id, so that repeated observations keep
    their number. A key of a unique rule that both sides have, and one of them several times, is an error, or without
    `strict` matches nothing. Matched rows whose known reasoning tokens differ are an error. A null in a key matches nothing.
    """
    found = None
    for rule in rules:
        key = rule[1] if isinstance(rule[1], tuple) else (rule[1], rule[1])
        part = _pairs(unmatched(_keyed(left, key[0]), found, "left_id"), unmatched(_keyed(right, key[1]), found, "right_id"), rule, strict)
        # each rule looks at all pairs so far on both sides: stored, they are worked out once
        part = stored(part)
        found = part if found is None else found.unionByName(part)
    return found


#: What one observation may have differently on two devices (fixed values).
OWN_COLUMNS = ("event_id", "host_id", "client", "user_id", "org_id", "team_id", "user_id_source", "redaction_applied")


def device_rules(columns: list[str]) -> list[Rule]:
    """The rules by which one person's history on an older device is found again in imported files, the surest first.

    Left: rows of imported logs; right: rows observed before. All columns but a device's own; then records of the second
    agent whose model and effort weren't known at the time; then the first agent's calls by their ids, hooks before the log
    export; then its requests by model and counters, where a session has them once.
    """

    def observed(*excluded: str) -> Column:
        # null fields are left out of the text, so that unknown columns don't count
        same = F.to_json(F.struct(*(F.col(c) for c in sorted(columns) if c not in (*OWN_COLUMNS, *excluded))))
        return F.when(F.col("session_id").isNotNull(), same)

    def of(source: str, kinds: list[str], *key: str) -> list[Column]:
        meant = (F.col("agent") == "claude-code") & (F.col("source") == source) & F.col("event_type").isin(kinds) & F.col("session_id").isNotNull()
        return [F.when(meant, F.col("session_id")), *(F.col(c) for c in key)]

    codex = (F.col("agent") == "codex") & (F.col("source") == "log") & F.col("event_type").isin("turn", "api.request")
    calls = ["tool.call", "tool.result", "subagent.stop"]
    by_id = lambda source: of(source, calls, "event_type", "correlation_key")
    cached = [F.coalesce(c, F.lit(-1)) for c in ("cache_read_tokens", "cache_write_tokens")]
    by_usage = lambda source: [*of(source, ["api.request"], "model", "input_tokens", "output_tokens"), *cached]
    return [
        ("same observation", [observed()], False),
        ("same record, other context", [F.when(codex, observed("model", "effort"))], False),
        *((f"same operation id, {source}", (by_id("log"), by_id(source)), True) for source in ("hook", "otel")),
        ("unique model and usage", (by_usage("log"), by_usage("otel")), True),
    ]


def client_registry(files: DataFrame) -> DataFrame:
    """(host_id, session_id, client) from (host_id, session_id, file, line_no, client): each file's first known client, joined in order."""
    first = files.filter("client is not null").groupBy("host_id", "session_id", "file").agg(F.min_by("client", "line_no").alias("client"))
    return first.groupBy("host_id", "session_id").agg(F.array_join(F.array_sort(F.collect_set("client")), ",").alias("client"))


def request_authorisation(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(session_id, response_id, subscription): a response is covered if every request record of its id says so."""
    covered = requests.groupBy("session_id", "request_id").agg(F.bool_and("subscription").alias("subscription"))
    return responses.join(covered, ["session_id", "request_id"]).select("session_id", "response_id", "subscription")


def display_filter(device: str | None = None, repo: str | None = None, without_repo: bool = False, this_device: str | None = None) -> Column:
    """Predicate of the dashboard's filter. `this-mac` is the device of the engine, `all` any; a repository or none at all."""
    if repo and without_repo:
        raise ValueError("a repository and no repository exclude each other")
    if len(device or "") > 256 or len((repo or "").encode()) > 2048:
        raise ValueError("filter too long")
    out = F.lit(True)
    if device and device != "all":
        out = out & (F.col("host_id") == (this_device if device == "this-mac" else device))
    if repo:
        out = out & (F.col("repo") == repo)
    if without_repo:
        out = out & (F.col("repo").isNull() | (F.col("repo") == ""))
    return out


class Marks:
    """Dates of changes made to improve a pattern: a small table of (id, pattern_id, subject, dt, note, host_id)."""

    SCHEMA = "id string, pattern_id string, subject string, dt string, note string, host_id string"

    @staticmethod
    def create(marks: DataFrame, pattern_id: str, subject: str, dt: str, note: str, host_id: str, today: str) -> DataFrame:
        from datetime import date

        if date.fromisoformat(dt) > date.fromisoformat(today):
            raise ValueError("a mark can't lie in the future")
        if not pattern_id or not subject or not 1 <= len(note) <= 500:
            raise ValueError("pattern, subject and a note of 1 to 500 characters are required")
        key = F.substring(F.sha2(F.concat_ws("|", F.lit(pattern_id), F.lit(subject), F.lit(dt), F.lit(note), F.lit(host_id)), 256), 1, 32)
        one = marks.sparkSession.createDataFrame([(pattern_id, subject, dt, note, host_id)], "pattern_id string, subject string, dt string, note string, host_id string").withColumn("id", key)
        return marks.unionByName(one).dropDuplicates(["id"])

    @staticmethod
    def added(marks: DataFrame, rows: DataFrame, today: str) -> DataFrame:
        """marks and the rows (pattern_id, subject, dt, note, host_id), each once; a row that `create` would refuse is an error."""
        key = F.substring(F.sha2(F.concat_ws("|", "pattern_id", "subject", "dt", "note", "host_id"), 256), 1, 32)
        fine = (F.try_to_date(F.col("dt")) <= F.lit(today).cast("date")) & (F.col("pattern_id") != "") & (F.col("subject") != "") & F.char_length("note").between(1, 500)
        checked = F.when(F.coalesce(fine, F.lit(False)), key).otherwise(F.raise_error(F.concat_ws("|", F.lit("not a mark"), "pattern_id", "subject", "dt")).cast("string"))
        return marks.unionByName(rows.withColumn("id", checked)).dropDuplicates(["id"])

    @staticmethod
    def listed(marks: DataFrame, pattern_id: str, subject: str, where: Column) -> DataFrame:
        return marks.filter((F.col("pattern_id") == pattern_id) & (F.col("subject") == subject)).withColumn("repo", F.lit(None).cast("string")).filter(where).drop("repo").orderBy(F.desc("dt"), "id")

    @staticmethod
    def delete(marks: DataFrame, id_: str) -> DataFrame:
        return marks.filter(F.col("id") != id_)
