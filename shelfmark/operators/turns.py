"""Conversation turns: fold event logs, pair tool calls, trace, complete and replay turns.

A turn's events are keyed by (turn, sequence) or cut into ranges, so a turn that holds a large
share of all events is worked on by many tasks.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators.ordered import (
    number_rows, previous_row, running_max,
)
from shelfmark.session import materialise

# Event types, phases, tool categories, capabilities and bounds.
TERMINAL = {"turn.completed": "completed", "turn.failed": "failed", "turn.cancelled": "cancelled"}
EVENT_TYPES = ("turn.started", "phase.changed", "tool.started", "tool.completed",
               "message.delta", "turn.completed", "turn.failed", "turn.cancelled")
PHASES = {"thinking": "Thinking", "searching": "Searching personal data",
          "reviewing": "Reviewing result", "computing": "Computing", "composing": "Composing"}
CAPABILITIES = {
    "search_personal_resources": "Search personal resources",
    "read_personal_resource": "Read resource",
    "review_personal_resources": "Review personal resources",
    "run_python": "Run Python",
    "write_workspace": "Write workspace file",
    "read_workspace": "Read workspace file",
    "manage_workspace": "Manage workspace",
    "use_tool": "Use tool",
}
CATEGORIES = ("catalog", "exec", "web", "action", "other")
MAX_REFS = 8
MAX_OPERATIONS = 32
MAX_DURATION_MS = 600_000
MAX_TRACE_STEPS = 96
REPLAY_LIMIT = 128
MAX_RESULT_BYTES = 1_048_576
CHUNK_CHARACTERS = 16_384
# Tool -> category, capability, phase; any other tool gets the last entry.
TOOLS = {
    "list_recent_resources": ("catalog", "search_personal_resources", "searching"),
    "search_resources": ("catalog", "search_personal_resources", "searching"),
    "retrieve_resources": ("catalog", "search_personal_resources", "searching"),
    "rich_retrieve_resources": ("catalog", "search_personal_resources", "searching"),
    "get_resource": ("catalog", "read_personal_resource", "reviewing"),
    "get_resource_observations": ("catalog", "read_personal_resource", "reviewing"),
    "aggregate_resources": ("catalog", "review_personal_resources", "reviewing"),
    "exec_python": ("exec", "run_python", "computing"),
    "workspace_write_text": ("exec", "write_workspace", "computing"),
    "workspace_read_text": ("exec", "read_workspace", "computing"),
    "workspace_list": ("exec", "manage_workspace", "computing"),
    "workspace_delete": ("exec", "manage_workspace", "computing"),
}
UNKNOWN_TOOL = ("other", "use_tool", "thinking")
# Where a tool's result holds its rows, and each row its reference.
RESULT_PATHS = {
    "list_recent_resources": ("resources", "$.resource_ref"),
    "search_resources": ("resources", "$.resource_ref"),
    "retrieve_resources": ("hits", "$.resource.resource_ref"),
    "rich_retrieve_resources": ("hits", "$.resource.resource_ref"),
}
TEXT_RANGE = 4096


# --- event rules ----------------------------------------------------------------------------

def event_violation() -> Column:
    """What is wrong with one event by itself, or null."""
    kind = F.col("type")
    refs = F.coalesce("resource_refs", F.array().cast("array<string>"))
    tool = kind.isin("tool.started", "tool.completed")
    any_tool_field = (F.col("operation_id").isNotNull() | F.col("category").isNotNull()
                      | F.col("capability").isNotNull() | F.col("duration_ms").isNotNull())
    bad_payload = (
        ~F.coalesce(F.col("operation_id").between(1, MAX_OPERATIONS), F.lit(False))
        | ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
        | ~F.coalesce(F.col("capability").isin(*CAPABILITIES), F.lit(False))
        | F.col("phase").isNotNull() | F.col("delta").isNotNull()
        | F.col("error_code").isNotNull()
    )
    bad_duration = ~F.coalesce(F.col("duration_ms").between(0, MAX_DURATION_MS), F.lit(False))
    return (
        F.when(~kind.isin(*EVENT_TYPES), "unknown_type")
        .when((kind == "turn.completed") & (
            (F.size(refs) > MAX_REFS) | (F.size(F.array_distinct(refs)) != F.size(refs))
            | F.exists(refs, lambda r: ~fn.is_resource_ref(r))), "bad_refs")
        .when((kind != "turn.completed") & (F.size(refs) > 0),
              "refs_without_completion")
        .when(~tool & any_tool_field, "tool_fields_without_tool")
        .when(tool & bad_payload, "bad_tool_fields")
        .when(F.col("phase").isNotNull() & ~F.col("phase").isin(*PHASES), "unknown_phase")
        .when((kind == "tool.started") & F.col("duration_ms").isNotNull(),
              "duration_at_start")
        .when((kind == "tool.completed") & bad_duration, "bad_duration")
    )


# --- fold -----------------------------------------------------------------------------------

class Fold(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def _drop_early_copies(copies: DataFrame) -> DataFrame:
    """First acceptable arrival of every (turn_id, sequence).

    An event counts only if it arrives after every earlier sequence number was in place. A copy
    that came too early is dropped and a later copy of the same number takes its place; that can
    delay what follows, so the rounds go on until nothing is dropped. A log in which every
    number was sent once needs no second round.
    """
    while True:
        firsts = copies.groupBy("turn_id", "sequence").agg(
            F.min("arrival").alias("arrival"), F.count(F.lit(1)).alias("n"))
        bounds = materialise(
            running_max(firsts, ["turn_id"], "sequence", "arrival", "bound"), "turn-bounds")
        late = F.coalesce(F.col("arrival") <= F.col("bound"), F.lit(False))
        if bounds.filter(late & (F.col("n") > 1)).select("n").first() is None:
            return bounds
        copies = materialise(
            copies.join(bounds.select("turn_id", "sequence", "bound", "n"),
                        ["turn_id", "sequence"])
            .filter((F.col("n") == 1) | F.col("bound").isNull()
                    | (F.col("arrival") > F.col("bound")))
            .select("turn_id", "sequence", "arrival"), "turn-copies")


def fold_events(events: DataFrame) -> Fold:
    """Split TURN_EVENTS rows into those a turn accepts and those it refuses.

    In arrival order a turn takes sequence 1, 2, 3, ... and nothing after its terminal event.
    An event without a positive number is refused and holds up nothing.
    """
    bounds = _drop_early_copies(
        events.filter("sequence >= 1").select("turn_id", "sequence", "arrival"))
    before = bounds.select("turn_id", (F.col("sequence") + 1).alias("sequence"),
                           F.lit(True).alias("has_before"))
    broken = (
        bounds.join(before, ["turn_id", "sequence"], "left")
        .filter(((F.col("sequence") != 1) & F.col("has_before").isNull())
                | F.coalesce(F.col("arrival") <= F.col("bound"), F.lit(False)))
        .groupBy("turn_id").agg(F.min("sequence").alias("break_at"))
    )
    # Every turn has one summary row, so events of a hot turn join a single row per turn.
    chained = events.join(bounds.select("turn_id", "sequence", "arrival", F.lit(True).alias("first")),
                          ["turn_id", "sequence", "arrival"], "left")
    candidates = events.filter(F.col("type").isin(*TERMINAL)).join(
        bounds.select("turn_id", "sequence", "arrival"), ["turn_id", "sequence", "arrival"],
        "left_semi")
    ends = (
        candidates.join(broken, "turn_id", "left")
        .filter(F.col("break_at").isNull() | (F.col("sequence") < F.col("break_at")))
        .groupBy("turn_id").agg(F.min("sequence").alias("end_at"),
                                F.min_by("arrival", "sequence").alias("ended"))
    )
    limits = broken.join(ends, "turn_id", "full_outer")
    judged = chained.join(limits, "turn_id", "left")
    accepted = (
        F.coalesce("first", F.lit(False))
        & (F.col("break_at").isNull() | (F.col("sequence") < F.col("break_at")))
        & (F.col("end_at").isNull() | (F.col("sequence") <= F.col("end_at")))
    )
    # Written once: the fold's consumers read the accepted events many times.
    judged = materialise(judged.withColumn("accepted", accepted), "judged-events")
    reason = F.when(F.coalesce(F.col("arrival") > F.col("ended"), F.lit(False)),
                    "turn_has_ended").otherwise("out_of_sequence")
    return Fold(
        judged.filter("accepted").select(*events.columns),
        judged.filter("not accepted").select(*events.columns, reason.alias("reason")))


def snapshots(accepted: DataFrame) -> DataFrame:
    """One row per turn: last sequence, phase, length of its text and terminal event."""
    return accepted.groupBy("turn_id").agg(
        F.max("sequence").alias("sequence"),
        F.max_by("phase", F.when(F.col("phase").isNotNull(), F.col("sequence"))).alias("phase"),
        F.coalesce(F.sum(F.char_length("delta")), F.lit(0)).alias("text_chars"),
        F.max_by("type", "sequence").alias("last_type")).select(
        "turn_id", "sequence", "phase", "text_chars",
        F.when(F.col("last_type").isin(*TERMINAL), F.col("last_type")).alias("terminal"))


def text_parts(accepted: DataFrame, width: int = TEXT_RANGE) -> DataFrame:
    """(turn_id, part, text): the text of a turn in order, in parts of a fixed sequence range.

    One part collects at most `width` deltas, however long its turn is.
    """
    deltas = accepted.filter(F.col("delta").isNotNull()).select(
        "turn_id", F.floor((F.col("sequence") - 1) / F.lit(width)).alias("part"),
        F.struct("sequence", "delta").alias("d"))
    return deltas.groupBy("turn_id", "part").agg(
        F.array_sort(F.collect_list("d")).alias("ds")).select(
        "turn_id", "part", F.array_join(F.transform("ds", lambda d: d["delta"]), "").alias("text"))


def replay(accepted: DataFrame, after: int = 0, limit: int = REPLAY_LIMIT) -> DataFrame:
    """The last `limit` accepted events of every turn that come after a sequence number.

    Accepted numbers have no gaps, so the distance to the last one replaces a ranking.
    """
    last = accepted.groupBy("turn_id").agg(F.max("sequence").alias("last"))
    rows = accepted.join(last, "turn_id", "left")
    return rows.filter((F.col("sequence") > F.col("last") - limit)
                       & (F.col("sequence") > after)).drop("last")


def phase_changes(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose phase differs from the row before them; the first phase always counts."""
    rows = previous_row(events.filter(F.col("phase").isNotNull()), keys, order, ["phase"])
    return rows.filter(~F.col("phase").eqNullSafe(F.col("previous.phase"))).drop("previous")


# --- trace ----------------------------------------------------------------------------------

def trace(accepted: DataFrame, max_steps: int = MAX_TRACE_STEPS) -> DataFrame:
    """Execution steps of every turn: (turn_id, step_no, step_id, label, detail, state).

    Tool completions update their start; a repeated phase adds nothing; the newest `max_steps`
    steps are kept.
    """
    tools = accepted.filter((F.col("type") == "tool.started") & F.col("operation_id").isNotNull()
                            & F.col("capability").isNotNull())
    starts = tools.groupBy("turn_id", "operation_id").agg(
        F.min(F.struct("sequence", "capability")).alias("s"))
    starts = materialise(
        number_rows(starts.select("turn_id", "operation_id", "s.*"), ["turn_id"], "sequence",
                    "start_no").filter(F.col("start_no") <= MAX_OPERATIONS), "trace-starts")
    ends = (
        accepted.filter(F.col("type") == "tool.completed")
        .select("turn_id", "operation_id", F.col("sequence").alias("end_seq"), "duration_ms")
        .join(starts.select("turn_id", "operation_id", F.col("sequence").alias("start_seq")),
              ["turn_id", "operation_id"])
        .filter(F.col("end_seq") > F.col("start_seq"))
        .groupBy("turn_id", "operation_id").agg(
            F.max_by(F.struct("duration_ms"), "end_seq").alias("end"))
    )
    label = F.create_map(*[F.lit(x) for pair in CAPABILITIES.items() for x in pair])
    tool_steps = starts.join(ends, ["turn_id", "operation_id"], "left").select(
        "turn_id", "sequence",
        F.concat(F.lit("tool:"), F.col("operation_id").cast("string")).alias("step_id"),
        F.coalesce(label[F.col("capability")], F.col("capability")).alias("label"),
        F.when(F.col("end").isNull(), "Running")
        .when(F.col("end.duration_ms").isNull(), "Finished")
        .otherwise(F.concat(F.lit("Finished · "), F.col("end.duration_ms").cast("string"),
                            F.lit(" ms"))).alias("detail"),
        F.col("end").isNotNull().alias("finished"), F.lit(None).cast("string").alias("phase"))
    first = accepted.filter(F.col("type") == "turn.started").groupBy("turn_id").agg(
        F.min("sequence").alias("sequence")).select(
        "turn_id", "sequence", F.lit("turn:started").alias("step_id"),
        F.lit("Started").alias("label"), F.lit("Turn started").alias("detail"),
        F.lit(False).alias("finished"), F.lit(None).cast("string").alias("phase"))
    phase_label = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    phases = accepted.filter((F.col("type") == "phase.changed") & F.col("phase").isNotNull()).select(
        "turn_id", "sequence",
        F.concat_ws(":", F.lit("phase"), "phase", F.col("sequence").cast("string"))
        .alias("step_id"),
        F.coalesce(phase_label[F.col("phase")], F.col("phase")).alias("label"),
        F.lit("In progress").alias("detail"), F.lit(False).alias("finished"), "phase")
    steps = materialise(first.unionByName(phases).unionByName(tool_steps), "trace-candidates")
    steps = previous_row(steps, ["turn_id"], "sequence", ["phase"])
    repeated = F.col("phase").isNotNull() & (F.col("phase") == F.col("previous.phase"))
    steps = steps.filter(~F.coalesce(repeated, F.lit(False))).drop("previous")
    outcome = F.create_map(*[F.lit(x) for pair in TERMINAL.items() for x in pair])
    ending = accepted.filter(F.col("type").isin(*TERMINAL)).select(
        "turn_id", F.col("sequence"), outcome[F.col("type")].alias("status"))
    final = ending.select(
        "turn_id", "sequence", F.concat(F.lit("terminal:"), F.col("status")).alias("step_id"),
        F.initcap("status").alias("label"),
        F.when(F.col("status") == "completed", "Finished").otherwise(F.initcap("status"))
        .alias("detail"), F.lit(True).alias("finished"), F.lit(None).cast("string").alias("phase"))
    # Written in between: each ordered operator reads its input twice.
    steps = materialise(steps.unionByName(final), "trace-steps")
    numbered = number_rows(steps, ["turn_id"], "sequence", "step_no")
    heads = numbered.groupBy("turn_id").agg(
        F.max("step_no").alias("n_steps"),
        F.max(F.when(~F.col("step_id").startswith("terminal:"), F.col("step_no")))
        .alias("last_step")).join(ending.select("turn_id", "status"), "turn_id", "left")
    rows = numbered.join(heads, "turn_id", "left")
    state = (
        F.when(F.col("step_id").startswith("terminal:"), F.col("status"))
        .when(F.col("finished") | (F.col("step_no") < F.col("last_step")), "completed")
        .otherwise(F.coalesce("status", F.lit("current")))
    )
    return rows.filter(F.col("step_no") > F.col("n_steps") - max_steps).select(
        "turn_id", "step_no", "step_id", "label", "detail", state.alias("state"))


# --- tool calls -----------------------------------------------------------------------------

def tool_table(spark, tools=TOOLS) -> DataFrame:
    return spark.createDataFrame(
        [(n, *v) for n, v in tools.items()],
        "tool STRING, category STRING, capability STRING, tool_phase STRING")


def pair_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Operations from call rows (turn_id, seq, at, event start|complete, call_id, tool).

    A start counts unless its call is still open; the n-th counted start of a turn is operation
    n, up to the bound; a completion without an open call is dropped.
    """
    keyed = calls.filter(F.col("call_id").isNotNull() & F.char_length("call_id").between(1, 256))
    seen = previous_row(keyed, ["turn_id", "call_id"], "seq", ["event"])
    opens = (F.col("event") == "start") & ~F.coalesce(
        F.col("previous.event") == "start", F.lit(False))
    closes = (F.col("event") == "complete") & F.coalesce(
        F.col("previous.event") == "start", F.lit(False))
    seen = seen.withColumn("opens", opens).withColumn("closes", closes).drop("previous")
    runs = number_rows(seen, ["turn_id", "call_id"], "seq", "run_no", where=F.col("opens"))
    starts = number_rows(
        runs.filter("opens").select("turn_id", "call_id", "run_no", "seq", "tool",
                                    F.col("at").alias("started_at")),
        ["turn_id"], "seq", "operation_id").filter(F.col("operation_id") <= MAX_OPERATIONS)
    ends = runs.filter("closes").select("turn_id", "call_id", "run_no",
                                        F.col("at").alias("completed_at"))
    elapsed = F.floor(
        (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1000))
    return (
        starts.join(ends, ["turn_id", "call_id", "run_no"], "left").join(tools, "tool", "left")
        .select("turn_id", "operation_id", "call_id", "tool", "seq",
                F.coalesce("category", F.lit(UNKNOWN_TOOL[0])).alias("category"),
                F.coalesce("capability", F.lit(UNKNOWN_TOOL[1])).alias("capability"),
                F.coalesce("tool_phase", F.lit(UNKNOWN_TOOL[2])).alias("tool_phase"),
                F.when(elapsed.isNotNull(), F.greatest(F.lit(0), F.least(
                    F.lit(MAX_DURATION_MS), elapsed))).cast("bigint").alias("duration_ms"))
    )


def result_refs(results: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, refs): the first distinct well-formed references of tool results (tool, result).

    A result that is too large, malformed or not ok gives no row; an ok result without usable
    references gives an empty list.
    """
    doc = F.try_parse_json("result")
    # The flag itself, not a text or number that reads like it.
    flag = F.try_variant_get(doc, "$.structuredContent.ok", "variant")
    ok = F.when(F.schema_of_variant(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean"))
    rows, value = F.lit(None).cast("array<variant>"), {}
    for tool, (path, leaf) in RESULT_PATHS.items():
        rows = F.when(F.col("tool") == tool, F.try_variant_get(
            doc, f"$.structuredContent.{path}", "array<variant>")).otherwise(rows)
        value[tool] = leaf
    nested = F.col("tool").isin(*[t for t, leaf in value.items() if ".resource." in leaf])
    usable = (results.filter(F.octet_length("result") <= MAX_RESULT_BYTES)
              .withColumn("_ok", ok).withColumn("_rows", rows)
              .filter(F.coalesce("_ok", F.lit(False)) & F.col("_rows").isNotNull())
              .withColumn("_nested", nested))
    found = F.transform("_rows", lambda v: F.when(
        F.col("_nested"), F.try_variant_get(v, "$.resource.resource_ref", "string"))
        .otherwise(F.try_variant_get(v, "$.resource_ref", "string")))
    good = F.array_distinct(F.filter(found, lambda r: fn.is_resource_ref(r)))
    return usable.select(*keys, F.slice(good, 1, MAX_REFS).alias("refs"))


def call_results(calls: DataFrame) -> DataFrame:
    """(turn_id, start_no, tool, result) of retrieval calls that ended under the tool name they
    began with, from rows (turn_id, seq, event start|complete, call_id, tool, result).

    A start counts unless its call is still open; any completion closes its call.
    """
    known = F.col("tool").isin(*RESULT_PATHS)
    keyed = calls.filter(F.col("call_id").isNotNull() & F.char_length("call_id").between(1, 256)
                         & ((F.col("event") == "complete") | known))
    seen = materialise(previous_row(keyed, ["turn_id", "call_id"], "seq", ["event"]), "seen-calls")
    was_open = F.coalesce(F.col("previous.event") == "start", F.lit(False))
    opens = (F.col("event") == "start") & ~was_open
    runs = number_rows(
        seen.withColumn("opens", opens).withColumn("closes", (F.col("event") == "complete")
                                                   & was_open).drop("previous"),
        ["turn_id", "call_id"], "seq", "run_no", where=F.col("opens"))
    keys = ["turn_id", "call_id", "run_no", "tool"]
    starts = runs.filter("opens").select(*keys, F.col("seq").alias("start_no"))
    ends = runs.filter("closes").select(*keys, "result")
    return starts.join(ends, keys).select("turn_id", "start_no", "tool", "result")


def final_refs(results: DataFrame) -> DataFrame:
    """References a turn presents: those of its latest-started retrieval call that parsed.

    `results` has (turn_id, start_no, tool, result).
    """
    refs = result_refs(results.filter(F.col("tool").isin(*RESULT_PATHS)), ["turn_id", "start_no"])
    return refs.groupBy("turn_id").agg(F.max_by("refs", "start_no").alias("refs"))


# --- texts ----------------------------------------------------------------------------------

def visible_text(text: Column) -> Column:
    """Text without hidden spans; a span that is never closed runs to the end."""
    return F.regexp_replace(text, r"(?is)<think>.*?(?:</think>|\z)", "")


def judge_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """Final responses with `visible` text, `outcome` and `error_code`: a response without visible
    text fails its turn."""
    rows = responses.withColumn("visible", visible_text(F.coalesce(F.col(text), F.lit(""))))
    empty = F.col("visible") == ""
    return rows.withColumn("outcome", F.when(empty, "failed").otherwise("completed")).withColumn(
        "error_code", F.when(empty, "empty_response"))


def chunks(rows: DataFrame, keys: list[str], text: str, size: int = CHUNK_CHARACTERS) -> DataFrame:
    """(*keys, chunk_no, chunk): a text cut every `size` characters; an empty one gives no row."""
    count = F.ceil(F.char_length(text) / F.lit(size)).cast("int")
    return rows.filter(F.char_length(text) > 0).select(
        *keys, F.col(text), F.explode(F.sequence(F.lit(1), count)).alias("chunk_no")).select(
        *keys, "chunk_no",
        F.substr(F.col(text), (F.col("chunk_no") - 1) * size + 1, F.lit(size)).alias("chunk"))


# --- turn state -----------------------------------------------------------------------------

class Opened(NamedTuple):
    messages: DataFrame
    turns: DataFrame
    refused: DataFrame


def open_turns(requests: DataFrame, conversations: DataFrame, turns: DataFrame, now: datetime
               ) -> Opened:
    """New turns from requests (request_id, conversation_id, ordinal BIGINT, body).

    A request is refused if its body is blank, its conversation is unknown or already has a
    running turn; of several requests for one conversation only the first opens a turn.
    """
    at = F.lit(now).cast("timestamp")
    running = turns.filter(F.col("status") == "running").select("conversation_id").distinct()
    known = conversations.select(F.col("id").alias("conversation_id"), F.lit(True).alias("known"))
    rows = requests.withColumn("body", fn.strip(F.coalesce("body", F.lit(""))))
    firsts = (rows.filter(F.col("body") != "").groupBy("conversation_id")
              .agg(F.min("ordinal").alias("first")))
    facts = (
        firsts.join(known, "conversation_id", "left")
        .join(running.withColumn("busy", F.lit(True)), "conversation_id", "left")
    )
    judged = rows.join(facts, "conversation_id", "left")
    reason = (
        F.when(F.col("body") == "", "message body must not be empty")
        .when(F.col("known").isNull(), "conversation_not_found")
        .when(F.coalesce("busy", F.lit(False)) | (F.col("ordinal") != F.col("first")),
              "conversation_has_active_turn")
    )
    judged = judged.withColumn("reason", reason)
    good = judged.filter("reason is null").select(
        "conversation_id", "body", fn.uuid_text(F.lit("message"), "request_id").alias("message_id"),
        fn.uuid_text(F.lit("turn"), "request_id").alias("turn_id"))
    none = F.lit(None).cast("string")
    return Opened(
        good.select(F.col("message_id").alias("id"), "conversation_id",
                    F.lit("user").alias("role"), F.lit(0).cast("bigint").alias("part"), "body",
                    at.alias("created_at")),
        good.select(F.col("turn_id").alias("id"), "conversation_id",
                    F.col("message_id").alias("user_message_id"),
                    none.alias("assistant_message_id"), F.lit("running").alias("status"),
                    at.alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"),
                    none.alias("error_code")),
        judged.filter("reason is not null").select("request_id", "conversation_id", "reason"))


def history(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages a turn starts from: same conversation, no later than its start, not its own.

    `turns` has at most one row per conversation (its running turn).
    """
    heads = turns.select("conversation_id", F.col("id").alias("turn_id"), "user_message_id",
                         "started_at")
    rows = messages.join(heads, "conversation_id")
    return rows.filter((F.col("created_at") <= F.col("started_at"))
                       & (F.col("id") != F.col("user_message_id"))).select(
        "turn_id", "conversation_id", F.col("id").alias("message_id"), "role", "created_at")


class Completed(NamedTuple):
    turns: DataFrame
    messages: DataFrame
    refs: DataFrame


def complete_turns(turns: DataFrame, accepted: DataFrame, now: datetime) -> Completed:
    """Turns after their terminal events: completed ones gain an assistant message (its body in
    parts) with ordered references; failed and cancelled ones keep no message."""
    at = F.lit(now).cast("timestamp")
    ends = accepted.filter(F.col("type").isin(*TERMINAL)).select(
        F.col("turn_id").alias("id"), "type", F.col("error_code").alias("e"), "resource_refs")
    message_id = fn.uuid_text(F.lit("assistant"), "id")
    hit = F.col("type").isNotNull() & (F.col("status") == "running")
    outcome = F.create_map(*[F.lit(x) for pair in TERMINAL.items() for x in pair])
    joined = turns.join(ends, "id", "left").withColumn("hit", hit)
    done = joined.filter(F.col("hit") & (F.col("type") == "turn.completed"))
    next_turns = joined.select(
        "id", "conversation_id", "user_message_id",
        F.when(F.col("hit") & (F.col("type") == "turn.completed"), message_id)
        .otherwise(F.col("assistant_message_id")).alias("assistant_message_id"),
        F.when(F.col("hit"), outcome[F.col("type")]).otherwise(F.col("status")).alias("status"),
        "started_at", F.when(F.col("hit"), at).otherwise(F.col("completed_at"))
        .alias("completed_at"),
        F.when(F.col("hit") & (F.col("type") == "turn.failed"),
               F.coalesce("e", F.lit("runtime_failed"))).otherwise(F.col("error_code"))
        .alias("error_code"))
    parts = text_parts(accepted).withColumnRenamed("turn_id", "id")
    messages = done.select("id", "conversation_id").join(parts, "id", "left").select(
        message_id.alias("id"), "conversation_id", F.lit("assistant").alias("role"),
        F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
        F.coalesce("text", F.lit("")).alias("body"), at.alias("created_at"))
    refs = done.select(message_id.alias("message_id"), F.posexplode(F.array_distinct(
        "resource_refs")).alias("ordinal", "resource_ref"))
    return Completed(next_turns, messages, refs.select("message_id", "resource_ref", "ordinal"))


def interrupt_orphans(turns: DataFrame, now: datetime) -> DataFrame:
    """Turns left running by a stopped process."""
    hit = F.col("status") == "running"
    return turns.select(
        "id", "conversation_id", "user_message_id", "assistant_message_id",
        F.when(hit, "interrupted").otherwise(F.col("status")).alias("status"), "started_at",
        F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("completed_at"))
        .alias("completed_at"),
        F.when(hit, "process_restarted").otherwise(F.col("error_code")).alias("error_code"))


def ordered_refs(asked: DataFrame, resources: DataFrame, cap: int = MAX_REFS) -> DataFrame:
    """First `cap` distinct references of each list (list_id, position, resource_ref) that name
    an existing resource: (list_id, place, resource_ref, title)."""
    firsts = asked.groupBy("list_id", "resource_ref").agg(F.min("position").alias("position"))
    place = F.row_number().over(Window.partitionBy("list_id").orderBy("position"))
    top = firsts.withColumn("place", place).filter(F.col("place") <= cap)
    return top.withColumn("id", fn.parse_ref("resource_ref")).join(
        resources.select("id", "title"), "id").select("list_id", "place", "resource_ref", "title")


def conversation_list(conversations: DataFrame) -> DataFrame:
    return conversations.filter("archived_at is null").orderBy(F.col("updated_at").desc(), "id")


def transcript(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """Messages in time order, one row per reference they carry (or one without)."""
    return (
        messages.join(refs.withColumnRenamed("message_id", "id"), "id", "left")
        .orderBy("conversation_id", "created_at", "id", "ordinal")
    )
