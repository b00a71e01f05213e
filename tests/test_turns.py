"""Turn folds against an event-by-event simulation, in batch and as a stream."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import turns as tn
from shelfmark.schemas import TURN_EVENTS
from shelfmark.streaming import turns as stream


def event(turn, arrival, sequence, kind="message.delta", **fields):
    row = dict.fromkeys(TURN_EVENTS.fieldNames())
    row.update(turn_id=turn, arrival=arrival, sequence=sequence, type=kind, resource_refs=[])
    row.update(fields)
    return tuple(row[c] for c in TURN_EVENTS.fieldNames())


def random_log(turns=120):
    """Logs with resent, early, missing and late events."""
    pick, rows, arrival = random.Random(3), [], 0
    for t in range(turns):
        numbers = list(range(1, pick.randint(2, 9)))
        for _ in range(pick.randint(0, 5)):
            numbers.insert(pick.randint(0, len(numbers)), pick.randint(1, 8))
        if pick.random() < .3:
            pick.shuffle(numbers)
        for n in numbers:
            arrival += 1
            kind = pick.choice(["message.delta"] * 6 + ["phase.changed", "turn.failed"])
            rows.append(event(f"t{t}", arrival, n, kind, delta=f"{n}," if "delta" in kind else None,
                              phase="thinking" if "phase" in kind else None))
    return rows


def simulate(rows):
    state, accepted, reasons = {}, set(), {}
    for r in sorted(rows, key=lambda r: r[1]):
        last, ended = state.get(r[0], (0, False))
        if ended:
            reasons[r[1]] = "turn_has_ended"
        elif r[2] != last + 1:
            reasons[r[1]] = "out_of_sequence"
        else:
            accepted.add(r[1])
            state[r[0]] = (r[2], r[3] in tn.TERMINAL)
    return accepted, reasons


@pytest.fixture(scope="module")
def log(spark):
    rows = random_log()
    return rows, spark.createDataFrame(rows, TURN_EVENTS)


def test_batch_fold(spark, log):
    rows, events = log
    accepted, reasons = simulate(rows)
    fold = tn.fold_events(events)
    assert {r["arrival"] for r in fold.accepted.collect()} == accepted
    assert {r["arrival"]: r["reason"] for r in fold.rejected.collect()} == reasons
    texts = {r["turn_id"]: r["text"] for r in tn.text_parts(fold.accepted).collect()}
    heads = {r["turn_id"]: r for r in tn.snapshots(fold.accepted).collect()}
    for turn, text in texts.items():
        want = "".join(r[5] for r in sorted(rows, key=lambda r: r[2])
                       if r[0] == turn and r[1] in accepted and r[5])
        assert text == want and heads[turn]["text_chars"] == len(want)
    parts = tn.text_parts(fold.accepted, width=2).groupBy("turn_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("t"))
    assert {r["turn_id"]: r["t"] for r in parts.collect()} == texts


def test_streaming_fold_equals_its_batch_twin(spark, log):
    rows, events = log
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cut = len(rows) // 2
    events.filter(F.col("arrival") <= cut).write.parquet(f"{folder}/in/a")
    query_of = lambda: (
        stream.fold_stream(spark.readStream.schema(TURN_EVENTS).parquet(f"{folder}/in/*"))
        .writeStream.option("checkpointLocation", f"{folder}/check").trigger(availableNow=True)
        .outputMode("append").format("parquet").start(f"{folder}/out"))
    query_of().awaitTermination(120)
    events.filter(F.col("arrival") > cut).write.parquet(f"{folder}/in/b")
    query_of().awaitTermination(120)
    accepted, reasons = simulate(rows)
    out = spark.read.schema(stream.OUTPUT).parquet(f"{folder}/out").collect()
    assert len(out) == len(rows)
    assert {r["arrival"] for r in out if r["accepted"]} == accepted
    assert {r["arrival"]: r["reason"] for r in out if not r["accepted"]} == reasons


def drained(spark, rows, folder, name):
    query = (rows.writeStream.option("checkpointLocation", f"{folder}/{name}-check")
             .trigger(availableNow=True).outputMode("append").format("parquet")
             .start(f"{folder}/{name}"))
    query.awaitTermination(200)


def test_streaming_trace_equals_its_batch_twin(spark):
    """Tools started twice, ended without a start, ended twice; a log in three batches."""
    pick, rows, arrival = random.Random(9), [], 0
    for t in range(40):
        for n in range(1, pick.randint(2, 120 if t < 3 else 12)):
            arrival += 1
            kind = pick.choice(["phase.changed", "tool.started", "tool.completed",
                                "message.delta", "turn.started" if n == 1 else "phase.changed"])
            tool = kind.startswith("tool")
            rows.append(event(
                f"t{t}", arrival, n, kind,
                phase=pick.choice(list(tn.PHASES)) if kind == "phase.changed" else None,
                operation_id=pick.randint(1, 40) if tool else None,
                capability=pick.choice([None, *tn.CAPABILITIES]) if tool else None,
                duration_ms=pick.choice([None, 5]) if kind == "tool.completed" else None))
        if pick.random() < .7:
            arrival += 1
            rows.append(event(f"t{t}", arrival, n + 1, pick.choice(list(tn.TERMINAL))))
    events = spark.createDataFrame(rows, TURN_EVENTS)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, arrival]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        events.filter((F.col("arrival") > a) & (F.col("arrival") <= b)).write.parquet(
            f"{folder}/in/{k}")
        drained(spark, stream.fold_stream(
            spark.readStream.schema(TURN_EVENTS).parquet(f"{folder}/in/*")), folder, "verdicts")
        drained(spark, stream.trace_stream(
            spark.readStream.schema(stream.OUTPUT).parquet(f"{folder}/verdicts")), folder, "steps")
    got = stream.current_steps(spark.read.schema(stream.STEPS).parquet(f"{folder}/steps"))
    want = tn.trace(tn.fold_events(events).accepted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.filter("step_id LIKE 'tool%'").count() > 30


def test_registry_keeps_running_turns_and_evicts_what_ended_first(spark):
    """200 turns of which every third goes on: 128 are kept."""
    rows, arrival = [], 0
    for t in range(200):
        arrival += 1
        rows.append(event(f"t{t}", arrival, 1, "turn.started"))
    order = list(range(200))
    random.Random(4).shuffle(order)
    ended = {}
    for t in order:
        arrival += 1
        if t % 3:
            rows.append(event(f"t{t}", arrival, 2, "turn.completed"))
            ended[f"t{t}"] = arrival
    # A turn that ends with its first event.
    rows.append(event("short", arrival + 1, 1, "turn.failed"))
    ended["short"] = arrival + 1
    events = spark.createDataFrame(rows, TURN_EVENTS)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for k, part in enumerate((events.filter("arrival <= 250"), events.filter("arrival > 250"))):
        part.write.parquet(f"{folder}/in/{k}")
        drained(spark, stream.fold_stream(
            spark.readStream.schema(TURN_EVENTS).parquet(f"{folder}/in/*")), folder, "verdicts")
        drained(spark, stream.registry_stream(
            spark.readStream.schema(stream.OUTPUT).parquet(f"{folder}/verdicts"),
            F.lit("one")), folder, "evicted")
    gone = {r["turn_id"] for r in spark.read.schema(stream.EVICTED).parquet(
        f"{folder}/evicted").collect()}
    assert gone == set(sorted(ended, key=ended.get)[:201 - 128])


@pytest.mark.parametrize("processor", ["fold", "trace"])
def test_turns_share_groups_of_a_stream(spark, monkeypatch, processor):
    """state is called per turn, but frames are handed over per bucket of turns."""
    import pandas as pd
    calls = []

    class Turns(dict):
        exists = dict.__len__
        containsKey = dict.__contains__  # noqa: N815
        getValue = dict.get  # noqa: N815

        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            self[key] = value

    def rows(turn, kinds, start):
        return [{"turn_id": turn, "arrival": start + k, "sequence": start + k, "type": kind,
                 "phase": None, "operation_id": 7 if "tool" in kind else None,
                 "capability": "use_tool" if "tool" in kind else None,
                 "duration_ms": 3 if kind == "tool.completed" else None}
                for k, kind in enumerate(kinds)]

    worker = stream.TurnFolds() if processor == "fold" else stream.TurnTrace()
    worker._turns = Turns()
    first = [r for t in range(50) for r in rows(f"t{t}", ["turn.started", "tool.started"], 1)]
    random.Random(3).shuffle(first)
    second = [r for t in range(0, 50, 2) for r in rows(
        f"t{t}", ["tool.completed", "turn.completed", "message.delta"], 3)]
    out = [list(worker.handleInputRows((0,), iter([pd.DataFrame(part)]), None))
           for part in (first, second)]
    assert [len(frames) for frames in out] == [1, 1] and len(calls) == 75
    got = pd.concat([frame for frames in out for frame in frames])
    if processor == "fold":
        assert got["accepted"].sum() == 150 and len(got) == 175
        assert set(got[~got["accepted"].astype(bool)]["reason"]) == {"turn_has_ended"}
        assert worker._turns[("t0",)][3] == ["turn.started", "tool.started", "tool.completed",
                                             "turn.completed"]
    else:
        last = got.sort_values("version").groupby(["turn_id", "step_no"]).last()
        assert last.loc[("t0", 2)]["detail"] == "Finished · 3 ms"
        assert last.loc[("t1", 2)]["state"] == "current"
        assert last.loc[("t0", 3)]["step_id"] == "terminal:completed"


class Held:
    """State handles that live in memory."""

    def __init__(self):
        self.value, self.rows = None, []

    def exists(self):
        return self.value is not None or bool(self.rows)

    def get(self):
        return self.value if self.value is not None else iter(self.rows)

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows


def test_a_turn_of_a_million_rows_in_bounded_memory():
    import tracemalloc

    import pandas as pd
    fold, head, recent = stream.TurnFold(), Held(), Held()
    fold._head, fold._recent = head, recent
    n, width = 1_000_000, 10_000

    def batches():
        for a in range(n - width, -1, -width):  # the newest come first
            yield pd.DataFrame({
                "turn_id": "t", "arrival": range(a, a + width), "sequence": range(a + 1, a + width + 1),
                "type": "message.delta", "phase": None, "operation_id": None, "capability": None,
                "duration_ms": None})

    tracemalloc.start()
    out = [(len(part), part["accepted"].all()) for part in fold.handleInputRows(
        ("t",), batches(), None)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(k for k, _ in out) == n and all(ok for _, ok in out)
    assert head.value[0] == n and len(recent.rows) == tn.REPLAY_LIMIT
    assert peak < 300 << 20 and max(k for k, _ in out) <= stream.ROWS
    for start in range(n, n + 400, 100):  # appended to, then cut back
        more = pd.DataFrame({"turn_id": "t", "arrival": range(start, start + 100),
                             "sequence": range(start + 1, start + 101), "type": "message.delta",
                             "phase": None, "operation_id": None, "capability": None,
                             "duration_ms": None})
        list(fold.handleInputRows(("t",), iter([more]), None))
        assert tn.REPLAY_LIMIT <= len(recent.rows) <= 2 * tn.REPLAY_LIMIT
    assert recent.rows[-1] == (n + 400, "message.delta")


def test_trace(spark):
    rows = [
        event("t", 1, 1, "turn.started"), event("t", 2, 2, "phase.changed", phase="thinking"),
        event("t", 3, 3, "phase.changed", phase="thinking"),
        event("t", 4, 4, "tool.started", operation_id=1, category="exec", capability="run_python"),
        event("t", 5, 5, "phase.changed", phase="thinking"),
        event("t", 6, 6, "tool.completed", operation_id=1, category="exec",
              capability="run_python", duration_ms=25),
        event("t", 7, 7, "tool.completed", operation_id=9, category="exec",
              capability="run_python", duration_ms=1),
        event("t", 8, 8, "turn.cancelled"), event("u", 9, 1, "turn.started")]
    events = spark.createDataFrame(rows, TURN_EVENTS)
    steps = [tuple(r) for r in tn.trace(events).orderBy("turn_id", "step_no").collect()]
    assert steps == [
        ("t", 1, "turn:started", "Started", "Turn started", "completed"),
        ("t", 2, "phase:thinking:2", "Thinking", "In progress", "completed"),
        ("t", 3, "tool:1", "Run Python", "Finished · 25 ms", "completed"),
        ("t", 4, "phase:thinking:5", "Thinking", "In progress", "cancelled"),
        ("t", 5, "terminal:cancelled", "Cancelled", "Cancelled", "cancelled"),
        ("u", 1, "turn:started", "Started", "Turn started", "current")]
    kept = tn.trace(events, max_steps=2).filter("turn_id = 't'")
    assert sorted(r["step_no"] for r in kept.collect()) == [4, 5]


def test_event_rules(spark):
    good = "catalog:resource:0b0f3a3e-0000-4000-8000-000000000001"
    tool = dict(operation_id=1, category="exec", capability="run_python")
    cases = [
        (event("t", 1, 1, "turn.completed", resource_refs=[good]), None),
        (event("t", 2, 1, "turn.completed", resource_refs=[good, good]),
         "bad_refs"),
        (event("t", 3, 1, "turn.completed", resource_refs=["x"]),
         "bad_refs"),
        (event("t", 4, 1, "turn.failed", resource_refs=[good]),
         "refs_without_completion"),
        (event("t", 5, 1, "message.delta", operation_id=1), "tool_fields_without_tool"),
        (event("t", 6, 1, "tool.started", **tool), None),
        (event("t", 7, 1, "tool.started", **{**tool, "operation_id": 33}),
         "bad_tool_fields"),
        (event("t", 8, 1, "tool.started", **tool, duration_ms=1),
         "duration_at_start"),
        (event("t", 9, 1, "tool.completed", **tool), "bad_duration"),
        (event("t", 10, 1, "tool.completed", **tool, duration_ms=600_000), None)]
    rows = spark.createDataFrame([c[0] for c in cases], TURN_EVENTS).select(
        "arrival", tn.event_violation().alias("v")).orderBy("arrival").collect()
    assert [r["v"] for r in rows] == [c[1] for c in cases]


def test_calls_refs_and_texts(spark):
    calls = spark.createDataFrame([
        ("t", 1, "2026-01-01 00:00:00", "start", "a", "exec_python"),
        ("t", 2, "2026-01-01 00:00:01", "start", "a", "exec_python"),
        ("t", 3, "2026-01-01 00:00:02", "complete", "a", "exec_python"),
        ("t", 4, "2026-01-01 00:00:03", "complete", "a", "exec_python"),
        ("t", 5, "2026-01-01 00:00:04", "start", "a", "nobody_knows"),
        ("t", 6, "2026-01-01 01:00:00", "complete", "a", "nobody_knows")],
        "turn_id STRING, seq BIGINT, at STRING, event STRING, call_id STRING, tool STRING"
    ).withColumn("at", F.col("at").cast("timestamp"))
    got = tn.pair_calls(calls, tn.tool_table(spark)).orderBy("operation_id").collect()
    assert [(r["operation_id"], r["capability"], r["duration_ms"]) for r in got] == [
        (1, "run_python", 2000), (2, "use_tool", 600_000)]
    ref = "catalog:resource:0b0f3a3e-0000-4000-8000-00000000000"
    rows = ",".join(f'{{"resource_ref":"{ref}{n}"}}' for n in (1, 2, 1)) + ',{"resource_ref":"x"}'
    ok = f'{{"structuredContent":{{"ok":true,"resources":[{rows}]}}}}'
    results = spark.createDataFrame([
        ("t", 1, "search_resources", ok), ("t", 2, "search_resources", "broken"),
        ("t", 3, "get_resource", ok), ("u", 1, "search_resources",
                                       '{"structuredContent":{"ok":true,"resources":[]}}'),
        ("u", 0, "search_resources", ok), ("v", 1, "search_resources",
                                           '{"structuredContent":{"ok":false,"resources":[]}}')],
        "turn_id STRING, start_no BIGINT, tool STRING, result STRING")
    refs = {r["turn_id"]: r["refs"] for r in tn.final_refs(results).collect()}
    assert refs == {"t": [ref + "1", ref + "2"], "u": []}
    texts = spark.createDataFrame([("a<THINK>x\ny</think>b<think>c", 1), ("<think>all", 2)],
                                  "t STRING, n INT").withColumn("v", tn.visible_text(F.col("t")))
    assert [r["v"] for r in texts.orderBy("n").collect()] == ["ab", ""]
    cut = tn.chunks(texts, ["n"], "v", size=1).orderBy("chunk_no").collect()
    assert [(r["chunk_no"], r["chunk"]) for r in cut] == [(1, "a"), (2, "b")]


def test_traced_events_carry_no_texts(spark, monkeypatch):
    """the texts of all events went through the fold's joins, and none is in a trace."""
    from shelfmark.plans import workload_turns

    folded, fold = [], tn.fold_events

    def seen(events):
        folded.append(events.columns)
        return fold(events)

    monkeypatch.setattr(workload_turns.tn, "fold_events", seen)
    assert workload_turns.turn_trace(spark, "/root/testdata/sf0.001").count() > 0
    assert not {"delta", "resource_refs", "error_code"} & set(folded[0])
