"""Registered queries over conversations, turn events and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import turns as tn
from shelfmark.plans import bind
from shelfmark.plans import oracle as o
from shelfmark.plans.workload import register

EVENTS = """placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place,
      count(*) OVER (PARTITION BY user_id) AS last FROM events),
    typed AS (SELECT *, CASE
        WHEN place = last THEN CASE event_type WHEN 'error' THEN 'turn.failed'
          WHEN 'signup' THEN 'turn.cancelled' ELSE 'turn.completed' END
        WHEN place = 1 THEN 'turn.started'
        WHEN event_type IN ('click', 'purchase') THEN 'phase.changed'
        WHEN event_type = 'view' THEN 'message.delta'
        WHEN event_type = 'signup' THEN 'tool.started' ELSE 'tool.completed' END AS type
      FROM placed),
    te AS (SELECT CAST(user_id AS VARCHAR) AS turn_id, event_id AS arrival,
        place + CASE WHEN value >= 200 AND place < last AND place > 1 THEN 1 ELSE 0 END AS sequence,
        type, CASE WHEN type = 'phase.changed' THEN CASE WHEN value < 10 THEN 'thinking'
          WHEN value < 25 THEN 'searching' WHEN value < 50 THEN 'reviewing'
          WHEN value < 100 THEN 'computing' ELSE 'composing' END END AS phase,
        CASE WHEN type = 'message.delta' THEN props END AS delta,
        CASE WHEN type IN ('tool.started', 'tool.completed')
          THEN CAST(floor(value / 4) AS INTEGER) END AS operation_id,
        CASE WHEN type = 'tool.completed' THEN CAST(round(value * 1000) AS BIGINT) END
          AS duration_ms FROM typed)"""
# Numbers are taken in arrival order while they follow each other, then up to the first end.
CHAIN = """firsts AS (SELECT turn_id, sequence, min(arrival) AS arrival FROM te
      GROUP BY turn_id, sequence),
    bounded AS (SELECT *, max(arrival) OVER (PARTITION BY turn_id ORDER BY sequence
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound,
        lag(sequence) OVER (PARTITION BY turn_id ORDER BY sequence) AS before FROM firsts),
    breaks AS (SELECT turn_id, min(sequence) AS break_at FROM bounded
      WHERE coalesce(before, 0) <> sequence - 1 OR coalesce(arrival <= bound, FALSE)
      GROUP BY turn_id),
    chained AS (SELECT te.* FROM te JOIN firsts USING (turn_id, sequence, arrival)
        LEFT JOIN breaks USING (turn_id) WHERE break_at IS NULL OR sequence < break_at),
    ends AS (SELECT turn_id, min(sequence) AS end_at, min(arrival) AS ended FROM chained
      WHERE type IN ('turn.completed', 'turn.failed', 'turn.cancelled') GROUP BY turn_id),
    accepted AS (SELECT c.* FROM chained c LEFT JOIN ends USING (turn_id)
      WHERE end_at IS NULL OR sequence <= end_at)"""
FOLD = f"{EVENTS}, {CHAIN}"


def _accepted(spark, sf_dir):
    return tn.fold_events(bind.turn_events(spark, sf_dir)).accepted


@register("turn_fold", f"""WITH {FOLD}
    SELECT turn_id, max(sequence) AS sequence,
      arg_max(phase, sequence) FILTER (WHERE phase IS NOT NULL) AS phase,
      CAST(coalesce(sum(length(delta)), 0) AS BIGINT) AS text_chars,
      max(CASE WHEN type IN ('turn.completed', 'turn.failed', 'turn.cancelled') THEN type END)
        AS terminal
    FROM accepted GROUP BY turn_id""")
def turn_fold(spark, sf_dir):
    return tn.snapshots(_accepted(spark, sf_dir))


@register("turn_rejections", f"""WITH {FOLD}
    SELECT t.turn_id, t.arrival, t.sequence, CASE WHEN coalesce(t.arrival > e.ended, FALSE)
      THEN 'turn_has_ended' ELSE 'out_of_sequence' END AS reason
    FROM te t LEFT JOIN ends e USING (turn_id) WHERE NOT EXISTS (
      SELECT 1 FROM accepted a WHERE a.turn_id = t.turn_id AND a.arrival = t.arrival)""")
def turn_rejections(spark, sf_dir):
    return tn.fold_events(bind.turn_events(spark, sf_dir)).rejected.select(
        "turn_id", "arrival", "sequence", "reason")


@register("turn_text", f"""WITH {FOLD}
    SELECT turn_id, CAST((sequence - 1) // 4096 AS BIGINT) AS part,
      string_agg(delta, '' ORDER BY sequence) AS text
    FROM accepted WHERE delta IS NOT NULL GROUP BY ALL""")
def turn_text(spark, sf_dir):
    return tn.text_parts(_accepted(spark, sf_dir))


@register("turn_replay", f"""WITH {FOLD}
    SELECT turn_id, sequence, type FROM (SELECT *, max(sequence) OVER (PARTITION BY turn_id) AS m
      FROM accepted) WHERE sequence > m - 128 AND sequence > 3""")
def turn_replay(spark, sf_dir):
    return tn.replay(_accepted(spark, sf_dir), after=3).select("turn_id", "sequence", "type")


@register("event_violations", f"""WITH {EVENTS}
    SELECT turn_id, arrival, CASE WHEN operation_id NOT BETWEEN 1 AND 32
        THEN 'bad_tool_fields' ELSE 'bad_duration' END AS violation
    FROM te WHERE operation_id NOT BETWEEN 1 AND 32 OR duration_ms NOT BETWEEN 0 AND 600000""")
def event_violations(spark, sf_dir):
    return bind.turn_events(spark, sf_dir).select(
        "turn_id", "arrival", tn.event_violation().alias("violation")).filter(
        "violation is not null")


@register("turn_trace", f"""WITH {FOLD},
    starts AS (SELECT turn_id, operation_id, min(sequence) AS sequence FROM accepted
      WHERE type = 'tool.started' GROUP BY turn_id, operation_id
      QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY min(sequence)) <= 32),
    done AS (SELECT a.turn_id, a.operation_id, arg_max(a.duration_ms, a.sequence) AS ms
      FROM accepted a JOIN starts s USING (turn_id, operation_id)
      WHERE a.type = 'tool.completed' AND a.sequence > s.sequence GROUP BY ALL),
    raw AS (
      SELECT turn_id, min(sequence) AS sequence, 'turn:started' AS step_id, 'Started' AS label,
        'Turn started' AS detail, FALSE AS finished, NULL AS phase FROM accepted
        WHERE type = 'turn.started' GROUP BY turn_id
      UNION ALL SELECT turn_id, sequence, 'phase:' || phase || ':' || sequence,
        CASE phase WHEN 'searching' THEN 'Searching personal data'
          WHEN 'reviewing' THEN 'Reviewing result'
          ELSE upper(phase[1:1]) || phase[2:] END, 'In progress', FALSE, phase FROM accepted
        WHERE type = 'phase.changed'
      UNION ALL SELECT turn_id, sequence, 'tool:' || operation_id, 'Use tool',
        CASE WHEN d.turn_id IS NULL THEN 'Running' ELSE 'Finished · ' || ms || ' ms' END,
        d.turn_id IS NOT NULL, NULL FROM starts LEFT JOIN done d USING (turn_id, operation_id)),
    kept AS (SELECT * FROM (SELECT *, lag(phase) OVER (PARTITION BY turn_id ORDER BY sequence) AS p
      FROM raw) WHERE phase IS NULL OR phase IS DISTINCT FROM p),
    status AS (SELECT turn_id, sequence, split_part(type, '.', 2) AS status FROM accepted
      WHERE type IN ('turn.completed', 'turn.failed', 'turn.cancelled')),
    steps AS (SELECT turn_id, sequence, step_id, label, detail, finished FROM kept
      UNION ALL SELECT turn_id, sequence, 'terminal:' || status,
        upper(status[1:1]) || status[2:], CASE WHEN status = 'completed' THEN 'Finished'
        ELSE upper(status[1:1]) || status[2:] END, TRUE FROM status),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY sequence) AS step_no,
        count(*) OVER (PARTITION BY turn_id) AS n FROM steps),
    tails AS (SELECT turn_id, max(step_no) AS last FROM numbered
      WHERE NOT starts_with(step_id, 'terminal:') GROUP BY turn_id)
    SELECT n.turn_id, step_no, step_id, label, detail, CASE
        WHEN starts_with(step_id, 'terminal:') THEN status
        WHEN finished OR step_no < last THEN 'completed' ELSE coalesce(status, 'current') END AS state
    FROM numbered n LEFT JOIN tails USING (turn_id)
      LEFT JOIN (SELECT turn_id, status FROM status) s USING (turn_id) WHERE step_no > n.n - 96""")
def turn_trace(spark, sf_dir):
    # A trace shows no texts and references, so none go through the shuffles of the fold.
    events = bind.turn_events(spark, sf_dir).drop(
        "delta", "error_code", "resource_refs", "category")
    return tn.trace(tn.fold_events(events).accepted)


@register("phase_changes", f"""WITH {EVENTS}
    SELECT turn_id, arrival, phase FROM (SELECT *, lag(phase) OVER (
      PARTITION BY turn_id ORDER BY arrival) AS p FROM te WHERE phase IS NOT NULL)
    WHERE phase IS DISTINCT FROM p""")
def phase_changes(spark, sf_dir):
    return tn.phase_changes(bind.turn_events(spark, sf_dir), ["turn_id"], "arrival").select(
        "turn_id", "arrival", "phase")


@register("tool_pairs", """WITH calls AS (SELECT CAST(user_id AS VARCHAR) AS turn_id,
        event_id AS seq, ts, event_type IN ('error', 'purchase') AS ends,
        CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS call_id,
        CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'search_resources'
          WHEN 1 THEN 'get_resource' WHEN 2 THEN 'exec_python' ELSE 'unlisted_tool' END AS tool
      FROM events),
    seen AS (SELECT *, lag(ends) OVER w AS p FROM calls WINDOW w AS
      (PARTITION BY turn_id, call_id ORDER BY seq)),
    runs AS (SELECT *, NOT ends AND coalesce(p, TRUE) AS opens, ends AND NOT coalesce(p, TRUE) AS closes,
        sum(CASE WHEN NOT ends AND coalesce(p, TRUE) THEN 1 ELSE 0 END) OVER (
          PARTITION BY turn_id, call_id ORDER BY seq) AS run_no FROM seen),
    starts AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY seq) AS operation_id
      FROM runs WHERE opens QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY seq) <= 32)
    SELECT s.turn_id, s.operation_id, s.call_id, s.tool, s.seq,
      CASE s.tool WHEN 'search_resources' THEN 'catalog' WHEN 'get_resource' THEN 'catalog'
        WHEN 'exec_python' THEN 'exec' ELSE 'other' END AS category,
      CASE s.tool WHEN 'search_resources' THEN 'search_personal_resources'
        WHEN 'get_resource' THEN 'read_personal_resource' WHEN 'exec_python' THEN 'run_python'
        ELSE 'use_tool' END AS capability,
      CASE s.tool WHEN 'search_resources' THEN 'searching' WHEN 'get_resource' THEN 'reviewing'
        WHEN 'exec_python' THEN 'computing' ELSE 'thinking' END AS tool_phase,
      CASE WHEN e.ts IS NOT NULL THEN greatest(0, least(600000,
        (epoch_us(e.ts) - epoch_us(s.ts)) // 1000)) END AS duration_ms
    FROM starts s LEFT JOIN (SELECT * FROM runs WHERE closes) e
      ON e.turn_id = s.turn_id AND e.call_id = s.call_id AND e.run_no = s.run_no""")
def tool_pairs(spark, sf_dir):
    return tn.pair_calls(bind.tool_calls(spark, sf_dir), tn.tool_table(spark))


LINES = """lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations
      WHERE role = 'assistant'),"""


@register("turn_final_refs", f"""WITH {LINES}
    picked AS (SELECT conv_id, max(turn) AS turn FROM conversations
      WHERE role = 'assistant' AND length(text) % 5 <> 0 GROUP BY conv_id),
    firsts AS (SELECT conv_id, line, min(pos) AS pos FROM lines JOIN picked USING (conv_id, turn)
      GROUP BY conv_id, line QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min(pos)) <= 8)
    SELECT CAST(conv_id AS VARCHAR) AS turn_id,
      string_agg({o.ref(o.uid("'line|' || line"))}, ',' ORDER BY pos) AS refs
    FROM firsts GROUP BY conv_id""")
def turn_final_refs(spark, sf_dir):
    return tn.final_refs(bind.tool_results(spark, sf_dir)).select(
        "turn_id", F.array_join("refs", ",").alias("refs"))


@register("visible_text", """WITH t AS (SELECT conv_id, turn, '<Think>' || role || chr(10) || '</THINK>'
        || text || '<think>' || role AS raw, text FROM conversations),
    n AS (SELECT conv_id, turn, text, unnest(range(1, 2 + CAST(length(text) // 256 AS BIGINT))) AS k FROM t)
    SELECT conv_id, turn, CAST(k AS INTEGER) AS chunk_no,
      substring(text, (k - 1) * 256 + 1, 256) AS chunk
    FROM n WHERE substring(text, (k - 1) * 256 + 1, 256) <> ''""")
def visible_text(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tn.visible_text(F.concat(
            F.lit("<Think>"), F.col("role"), F.lit("\n</THINK>"), F.col("text"),
            F.lit("<think>"), F.col("role"))).alias("text"))
    return tn.chunks(rows, ["conv_id", "turn"], "text", size=256)


@register("turn_history", f"""WITH m AS (SELECT conv_id, turn, role FROM conversations),
    own AS (SELECT conv_id, max(turn) AS turn FROM m WHERE role = 'user' GROUP BY conv_id)
    SELECT {o.uid("'turn|' || m.conv_id")} AS turn_id, CAST(m.conv_id AS VARCHAR) AS conversation_id,
      m.conv_id || '-' || m.turn AS message_id, role,
      make_timestamp((1700000000 + m.conv_id * 10000 + m.turn) * 1000000) AS created_at
    FROM m JOIN own ON own.conv_id = m.conv_id AND m.turn < own.turn""")
def turn_history(spark, sf_dir):
    return tn.history(bind.last_turns(spark, sf_dir), bind.messages(spark, sf_dir))


@register("ordered_refs", f"""WITH {o.CATALOG},
    asked AS (SELECT lang, source, {o.uid("'resource|file|' || sha256(text)")} AS id,
        min(doc_id) AS pos FROM documents GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY pos) AS place FROM asked)
    SELECT lang || source AS list_id, CAST(place AS INTEGER) AS place, {o.ref('id')} AS resource_ref,
      title FROM top JOIN resources USING (id) WHERE place <= 8""")
def ordered_refs(spark, sf_dir):
    asked = bind.table(spark, sf_dir, "documents").select(
        F.concat("lang", "source").alias("list_id"), F.col("doc_id").alias("position"),
        fn.resource_ref(fn.uuid_text(F.lit("resource"), F.lit("file"), F.sha2("text", 256)))
        .alias("resource_ref"))
    return tn.ordered_refs(asked, bind.catalog(spark, sf_dir).resources)


def _turn_rows(spark, sf_dir):
    """One running turn per user, each in the conversation of its nation-less id."""
    none = F.lit(None).cast("string")
    return bind.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").cast("timestamp").alias("started_at")).select(
        F.col("user_id").cast("string").alias("id"),
        F.concat(F.lit("c-"), F.col("user_id").cast("string")).alias("conversation_id"),
        F.lit("m").alias("user_message_id"), none.alias("assistant_message_id"),
        F.lit("running").alias("status"), "started_at",
        F.lit(None).cast("timestamp").alias("completed_at"), none.alias("error_code"))


@register("turn_completion", f"""WITH {FOLD}
    SELECT u.id, CASE type WHEN 'turn.completed' THEN 'completed' WHEN 'turn.failed' THEN 'failed'
        WHEN 'turn.cancelled' THEN 'cancelled' ELSE 'interrupted' END AS status,
      CASE WHEN type = 'turn.failed' THEN 'runtime_failed'
        WHEN type IS NULL THEN 'process_restarted' END AS error_code,
      CASE WHEN type = 'turn.completed' THEN {o.uid("'assistant|' || u.id")} END
        AS assistant_message_id, TIMESTAMP '2025-07-01' AS completed_at
    FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events) u
      LEFT JOIN (SELECT turn_id, type FROM accepted
        WHERE type IN ('turn.completed', 'turn.failed', 'turn.cancelled')) a ON a.turn_id = u.id""")
def turn_completion(spark, sf_dir):
    """Turns after their events, those without an end then taken as orphaned."""
    done = tn.complete_turns(_turn_rows(spark, sf_dir), _accepted(spark, sf_dir), bind.SECOND_RUN)
    return tn.interrupt_orphans(done.turns, bind.SECOND_RUN).select(
        "id", "status", "error_code", "assistant_message_id", "completed_at")


@register("turn_requests", """WITH r AS (SELECT conv_id, turn, role, text FROM conversations),
    firsts AS (SELECT conv_id, min(turn) AS turn FROM r WHERE trim(text) <> '' GROUP BY conv_id),
    busy AS (SELECT DISTINCT conv_id FROM r WHERE role = 'system')
    SELECT r.conv_id || '-' || r.turn AS request_id, CASE
      WHEN r.conv_id IN (SELECT conv_id FROM busy) OR r.turn <> f.turn
        THEN 'conversation_has_active_turn' ELSE 'opened' END AS outcome
    FROM r JOIN firsts f USING (conv_id)""")
def turn_requests(spark, sf_dir):
    """Every message asks for a turn; conversations with a system message have one running."""
    rows = bind.messages(spark, sf_dir)
    requests = rows.select(
        F.col("id").alias("request_id"), "conversation_id",
        F.split_part("id", F.lit("-"), F.lit(2)).cast("bigint").alias("ordinal"), "body")
    running = rows.filter(F.col("role") == "system").select(
        "conversation_id", F.lit("running").alias("status"))
    conversations = rows.select(F.col("conversation_id").alias("id")).distinct()
    opened = tn.open_turns(requests, conversations, running, bind.SECOND_RUN)
    by_id = requests.select("request_id", fn.uuid_text(F.lit("message"), "request_id").alias("id"))
    return opened.refused.select("request_id", F.col("reason").alias("outcome")).unionByName(
        opened.messages.join(by_id, "id").select("request_id", F.lit("opened").alias("outcome")))
