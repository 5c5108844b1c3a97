"""Conversations of the desktop application and completed responses of a stop hook, both as decoded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.schema import conform

from .columns import day_of
from .normalize import millis
from .scalars import event_id, token_estimate

#: The form of the ids that are taken over.
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MODEL = "^claude-[A-Za-z0-9._-]{0,121}$"
#: Where a response's model was seen to come from (fixed values).
MODEL_SOURCES = ("active_turn_selection", "server_model_change", "server_model_fallback", "server_turn_fallback")
FOLDER = "conversation.folder.attached"

_BLOCKS = "array<struct<type: string, text: string>>"
_TREE = (
    "product string, conversationUuid string, tree struct<kind: string, conversationUuid: string, messages: array<struct<uuid: string, sender: string, stop_reason: string, created_at: string, "
    f"parent_message_uuid: string, attachedFolders: array<string>, content: {_BLOCKS}>>>"
)


def _text(blocks: Column) -> Column:
    """The visible text of a message, null where it has none."""
    shown = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull())
    return F.when(F.size(shown) > 0, F.array_join(F.transform(shown, lambda b: b["text"]), ""))


def _messages(raw: DataFrame) -> DataFrame:
    """(session_id, place, kind, ts, m) of the messages that are a turn or a finished answer."""
    c = raw.select(F.from_json("body", _TREE).alias("c")).select("c.*").filter("product = 'hub' and tree.kind = 'hub_transcript' and tree.conversationUuid = conversationUuid")
    c = c.filter(F.col("conversationUuid").rlike(UUID)).select(F.col("conversationUuid").alias("session_id"), F.posexplode("tree.messages").alias("place", "m"))
    kind = F.when(F.col("m.sender") == "human", "turn").when((F.col("m.sender") == "assistant") & F.col("m.stop_reason").isNotNull(), "message.received")
    return c.withColumns({"kind": kind, "ts": millis(F.col("m.created_at"))}).filter(F.col("m.uuid").rlike(UUID) & F.col("kind").isNotNull() & F.col("ts").isNotNull())


def conversations(raw: DataFrame, host: str, grants: DataFrame | None = None) -> DataFrame:
    """Events of conversation trees (column body): turns, received messages, estimated tokens, and one event where a folder was attached.

    An estimate is an event of its own, so that it can come later than its message. grants: (session_id) of conversations
    that were given a folder without a message that shows it; their event is dated at the first turn. Repeated records give
    one event each.
    """
    m = _messages(raw)
    key = F.concat_ws(":", F.lit("claude-desktop"), "session_id", "m.uuid")
    parent = F.when(F.col("m.parent_message_uuid").rlike(UUID), F.col("m.parent_message_uuid"))
    base = {
        "host_id": F.lit(host), "agent": F.lit("claude"), "client": F.lit("claude_desktop"), "source": F.lit("log"), "session_id": F.col("session_id"), "ts": F.col("ts"), "dt": day_of(F.col("ts")),
        "turn_id": F.when(F.col("kind") == "turn", F.col("m.uuid")).otherwise(parent), "correlation_key": F.col("m.uuid"), "correlation_confidence": F.lit("exact"), "provider": F.lit("anthropic"), "query_source": F.lit("main"), "redaction_applied": F.lit(True),
    }

    def events(rows: DataFrame, kind: Column, id_key: Column, **more: Column) -> DataFrame:
        return conform(rows, **(base | {"event_type": kind, "event_id": event_id(F.lit(host), F.lit("log"), kind, id_key)} | more))

    tokens = token_estimate(_text(F.col("m.content")))
    told = m.withColumn("tokens", tokens).filter("tokens is not null")
    is_turn = F.col("kind") == "turn"
    estimates = events(told, F.lit("message.tokens.estimated"), key, token_estimation_method=F.lit("visible_text_chars_v1"), usage_source=F.lit("estimate"), estimated_input_tokens=F.when(is_turn, F.col("tokens")), estimated_output_tokens=F.when(~is_turn, F.col("tokens")))
    turns = m.filter(is_turn)
    shown = turns.filter(F.size("m.attachedFolders") > 0).groupBy("session_id").agg(F.min_by(F.struct("kind", "ts", "m"), "place").alias("x"))
    folders = shown
    if grants is not None:
        given = turns.join(grants.select("session_id").distinct(), "session_id", "left_semi").join(shown.select("session_id"), "session_id", "left_anti")
        folders = shown.unionByName(given.groupBy("session_id").agg(F.min_by(F.struct("kind", "ts", "m"), F.struct("ts", "place")).alias("x")))
    attached = events(folders.select("session_id", "x.*"), F.lit(FOLDER), F.concat_ws(":", F.lit("claude-desktop"), "session_id", F.lit("folder")))
    return events(m, F.col("kind"), key).unionByName(estimates).unionByName(attached).dropDuplicates(["event_id"])


def response_models(raw: DataFrame, conversations_: DataFrame, received: DataFrame, host: str) -> DataFrame:
    """Observed models of received messages: records (column body) whose conversation belongs to the organisation that they name.

    conversations_: (session_id, org_id). The event is the message's own, under a kind that tells where the model came from.
    """
    kind = "version long, conversationUuid string, messageUuid string, orgUuid string, model string, modelSource string"
    r = raw.select(F.from_json("body", kind).alias("r")).select("r.*").filter(F.col("model").rlike(MODEL) & F.col("modelSource").isin(*MODEL_SOURCES) & (F.col("version") == 1))
    known = r.join(conversations_.select(F.col("session_id").alias("conversationUuid"), F.col("org_id").alias("orgUuid")), ["conversationUuid", "orgUuid"], "left_semi")
    seen = known.select(F.col("conversationUuid").alias("_s"), F.col("messageUuid").alias("_m"), F.col("model").alias("_model"), F.concat(F.lit("message.model."), "modelSource").alias("_kind"))
    rows = received.filter("event_type = 'message.received'").join(seen, (F.col("session_id") == F.col("_s")) & (F.col("correlation_key") == F.col("_m")))
    key = F.concat_ws(":", "session_id", "correlation_key", "_model")
    return conform(rows, event_type=F.col("_kind"), model=F.col("_model"), event_id=event_id(F.lit(host), F.lit("log"), F.col("_kind"), key)).dropDuplicates(["event_id"])


_COUNTERS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_input_tokens": "cache_read_tokens", "cache_creation_input_tokens": "cache_write_tokens"}
_STOP = "uuid string, parentUuid string, timestamp string, message struct<id: string, role: string, model: string, stop_reason: string, content: string, usage: struct<" + ", ".join(f"{c}: long" for c in _COUNTERS) + ">>"


def completed_responses(lines: DataFrame, most: int = 100_000_000) -> DataFrame:
    """Finished responses of transcripts: rows (file, session_id, line_no, line), the last record of each message id in a file.

    Each has the message of the user that it follows, its counters (null out of 0..most) and its text, which
    `resolution.fingerprints` turns into a fingerprint. Input and output must be known and something must have been used.
    """
    x = lines.withColumn("j", F.from_json("line", _STOP)).select("file", "session_id", "line_no", "j.*")
    blocks = F.from_json("message.content", _BLOCKS)
    plain = ~F.col("message.content").startswith("[")  # a text and not a list of blocks
    asks = (F.col("message.role") == "user") & (plain | F.exists(blocks, lambda b: b["type"] == "text"))
    uuid = lambda c: F.when(F.col(c).rlike(UUID), F.lower(c))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # the last message of a user counts even if its id isn't one
    asked = F.last(F.when(F.coalesce(asks, F.lit(False)), F.struct(uuid("uuid").alias("id"))), ignorenulls=True).over(order)
    x = x.withColumn("user_message_uuid", asked["id"])
    bounded = {new: F.when(F.col(f"message.usage.{old}").between(0, most), F.col(f"message.usage.{old}")) for old, new in _COUNTERS.items()}
    name = "^[A-Za-z0-9_-]{1,160}$"
    done = x.filter(F.col("session_id").rlike(name) & (F.col("message.role") == "assistant") & F.col("message.stop_reason").isNotNull() & F.col("message.id").rlike(name) & F.col("message.model").rlike(name) & F.col("message.model").startswith("claude-"))
    done = done.withColumns(bounded | {"timestamp_ms": millis(F.col("timestamp")), "text": F.coalesce(_text(blocks), F.lit(""))})
    done = done.filter("input_tokens is not null and output_tokens is not null and timestamp_ms is not null").filter(F.greatest(*(F.col(c) for c in bounded)) > 0)
    last = Window.partitionBy("file", "message.id").orderBy(F.desc("line_no"))
    out = done.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return out.select("session_id", F.col("message.id").alias("response_id"), F.col("message.model").alias("model"), "timestamp_ms", uuid("uuid").alias("message_uuid"), uuid("parentUuid").alias("parent_message_uuid"), "user_message_uuid", *bounded, F.nullif("text", F.lit("")).alias("text"))
