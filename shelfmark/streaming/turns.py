"""Streaming folds of turn events: acceptance and replay per turn, execution trace, eviction.

Events are reduced to narrow rows before they reach any state: numbers and names from fixed
sets, never text. Texts are joined to the verdicts afterwards (`with_texts`).
"""

from __future__ import annotations

import heapq
import sys
from collections import deque
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators.turns import (
    CAPABILITIES, MAX_OPERATIONS, MAX_TRACE_STEPS, PHASES, REPLAY_LIMIT, TERMINAL,
)

#: Turns that a registry keeps.
TURN_LIMIT = 128
#: Rows that a task gives back at once.
ROWS = 10_000
#: Groups that the turns of a stream are dealt to.
BUCKETS = 4096


def _schema(text: str) -> T.StructType:
    kinds = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(),
             "BOOLEAN": T.BooleanType(), "STRINGS": T.ArrayType(T.StringType()),
             "BIGINTS": T.ArrayType(T.LongType())}
    pairs = [part.split() for part in text.split(", ")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


OUTPUT = _schema("turn_id STRING, arrival BIGINT, sequence BIGINT, type STRING, phase STRING, "
                 "operation_id INT, capability STRING, duration_ms BIGINT, accepted BOOLEAN, "
                 "reason STRING, turn_phase STRING")
HEAD = _schema("sequence BIGINT, phase STRING, terminal STRING, kept INT")
FOLDED = _schema("sequence BIGINT, phase STRING, terminal STRING, recent STRINGS")
KEPT = _schema("sequence BIGINT, type STRING")
STEPS = _schema("turn_id STRING, version BIGINT, step_no BIGINT, step_id STRING, label STRING, "
                "detail STRING, state STRING")
TRACE = _schema("last_no BIGINT, last_id STRING, last_label STRING, last_detail STRING, "
                "last_finished BOOLEAN, last_phase STRING, status STRING, steps BIGINT, "
                "operations BIGINTS, numbers BIGINTS, labels STRINGS")
EVICTED = _schema("registry STRING, turn_id STRING, ended BIGINT, evicted_at BIGINT")
ENDED = _schema("ended BIGINT")
NAMES = ("turn_id", "type", "phase", "capability")
EVENT = ("turn_id", "arrival", "sequence", "type", "phase", "operation_id", "capability",
         "duration_ms")
ACCEPTED = ("turn_id", "sequence", "type", "phase", "operation_id", "capability", "duration_ms")


def _gather(batches: Iterator[pd.DataFrame], fields: tuple[str, ...], *order: str
            ) -> Iterator[tuple]:
    """A key's rows of a micro-batch by `order` as tuples of `fields`; names are held as codes, so
    that a row costs some tens of bytes however many there are."""
    held: dict[str, list] = {name: [] for name in fields}
    codes: dict[str, dict] = {name: {} for name in NAMES if name in fields}
    for batch in batches:
        for name in fields:
            values = batch[name]
            if name in codes:
                known = codes[name]
                column = np.array([known.setdefault(v, len(known)) if isinstance(v, str) else -1
                                   for v in values.to_list()],
                                  np.int32 if name == "turn_id" else np.int16)
            else:
                column = values.to_numpy()
                if column.dtype.kind != "i":
                    column = values.to_numpy(np.float64 if values.isna().any() else np.int64)
            held[name].append(column)
    if not held[fields[0]]:
        return
    columns = {name: np.concatenate(held.pop(name)) for name in fields}
    # A code of -1 finds the null at the end.
    names = {name: [*known, None] for name, known in codes.items()}
    by = np.lexsort([columns[name] for name in reversed(order)])
    for start in range(0, len(by), ROWS):
        part = []
        for name in fields:
            values = columns[name][by[start:start + ROWS]]
            if name in names:
                found = names[name]
                part.append([found[v] for v in values.tolist()])
            elif values.dtype.kind == "f":
                part.append([None if v != v else int(v) for v in values.tolist()])
            else:
                part.append(values.tolist())
        yield from zip(*part)


def _by_turn(batches: Iterator[pd.DataFrame], fields: tuple[str, ...], order: str
             ) -> Iterator[tuple[str, Iterator[tuple]]]:
    """The rows of a bucket, turn by turn; the first of `fields` is the turn."""
    return groupby(_gather(batches, fields, fields[0], order), itemgetter(0))


def _bucketed(rows: DataFrame) -> GroupedData:
    """Rows by buckets of turns: state is called and rows are handed over per group, which costs
    more than the some dozens of events of a turn."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("turn_id"), F.lit(BUCKETS))).groupBy("bucket")


def _stored(state, turn: str, any_stored: bool) -> tuple | None:
    return state.getValue((turn,)) if any_stored and state.containsKey((turn,)) else None


def _give(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.fieldNames(), dtype=object)


def _judge(head: list, rows: Iterator[tuple], fresh: deque) -> Iterator[tuple]:
    """OUTPUT rows of one turn's EVENT rows; `head` (sequence, phase, terminal) moves on and
    accepted events join `fresh`."""
    last, phase, terminal = head
    for turn, arrival, number, kind, own_phase, operation, capability, took in rows:
        reason = None
        if terminal is not None:
            reason = "turn_has_ended"
        elif number != last + 1:
            reason = "out_of_sequence"
        else:
            last = number
            phase = own_phase or phase
            terminal = kind if kind in TERMINAL else None
            fresh.append((last, kind))
            head[:] = last, phase, terminal
        yield (turn, arrival, number, kind, own_phase, operation, capability, took,
               reason is None, reason, phase)


class TurnFold(StatefulProcessor):
    """Accept sequence 1, 2, 3, ... of a turn until its terminal event; refuse everything else.

    State per turn is one head row and the newest events for replay: a list that accepted events
    are appended to and that is cut back when it holds twice the limit. With `forget_after_ms` a
    turn without events for that long is forgotten.
    """

    def __init__(self, forget_after_ms: int | None = None) -> None:
        self._forget = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._head = handle.getValueState("head", HEAD, self._forget)
        self._recent = handle.getListState("recent", KEPT, self._forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        known = self._head.get() if self._head.exists() else None
        *head, kept = known if known is not None else (0, None, None, 0)
        fresh = deque(maxlen=REPLAY_LIMIT)
        verdicts = _judge(head, _gather(rows, EVENT, "arrival"), fresh)
        while out := list(islice(verdicts, ROWS)):
            yield _give(out, OUTPUT)
        if kept + len(fresh) > 2 * REPLAY_LIMIT:
            newest = ([tuple(r) for r in self._recent.get()] + list(fresh))[-REPLAY_LIMIT:]
            self._recent.put(newest)
            kept = len(newest)
        elif fresh:
            self._recent.appendList(list(fresh))
            kept += len(fresh)
        self._head.update((*head, kept))

    def close(self) -> None:
        pass


class TurnFolds(StatefulProcessor):
    """TurnFold for the turns of a bucket: one row per turn, which holds the newest types for replay;
    their numbers run up to the head's without gaps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._turns = handle.getMapState("turns", _schema("turn_id STRING"), FOLDED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        verdicts = self._verdicts(rows)
        while out := list(islice(verdicts, ROWS)):
            yield _give(out, OUTPUT)

    def _verdicts(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        any_stored = self._turns.exists()
        for turn, events in _by_turn(rows, EVENT, "arrival"):
            *head, recent = _stored(self._turns, turn, any_stored) or (0, None, None, [])
            fresh = deque(maxlen=REPLAY_LIMIT)
            yield from _judge(head, events, fresh)
            newest = [*recent, *(kind for _, kind in fresh)][-REPLAY_LIMIT:]
            self._turns.updateValue((turn,), (*head, newest))

    def close(self) -> None:
        pass


class TurnTrace(StatefulProcessor):
    """Execution steps of the turns of a bucket from their accepted events, as changes of steps.

    State is one row per turn: its last step and the step of every operation it has started, which
    pairs tool starts with their ends as they come. Each change carries the sequence number it came
    with as `version`.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._turns = handle.getMapState("traces", _schema("turn_id STRING"), TRACE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        any_stored, out = self._turns.exists(), []
        for turn, events in _by_turn(rows, ACCEPTED, "sequence"):
            stored = _stored(self._turns, turn, any_stored) or (
                0, None, None, None, False, None, None, 0, [], [], [])
            *last, phase, status, steps, operations, numbers, labels = stored
            # Number, id, label, detail and end of the last step; number and label by operation.
            last, tools = tuple(last), dict(zip(operations, zip(numbers, labels)))

            def change(version, no, step_id, label, detail, state):
                out.append((turn, version, no, step_id, label, detail, state))

            def add(version, step_id, label, detail, own_phase=None):
                nonlocal steps, last, phase
                if last[0] and not last[4]:
                    change(version, *last[:4], "completed")
                steps += 1
                last, phase = (steps, step_id, label, detail, False), own_phase
                change(version, *last[:4], "current")

            for _, at, kind, own_phase, op, capability, took in events:
                if kind == "turn.started" and steps == 0:
                    add(at, "turn:started", "Started", "Turn started")
                elif kind == "phase.changed" and own_phase and own_phase != phase:
                    add(at, f"phase:{own_phase}:{at}", PHASES.get(own_phase, own_phase),
                        "In progress", own_phase)
                elif (kind == "tool.started" and op is not None and capability
                      and len(tools) < MAX_OPERATIONS and op not in tools):
                    add(at, f"tool:{op}", CAPABILITIES.get(capability, capability), "Running")
                    tools[op] = (steps, last[2])
                elif kind == "tool.completed" and op in tools:
                    no, label = tools[op]
                    detail = "Finished" if took is None else f"Finished · {took} ms"
                    if no == last[0]:
                        last = (no, f"tool:{op}", label, detail, True)
                    change(at, no, f"tool:{op}", label, detail, "completed")
                elif kind in TERMINAL:
                    status = TERMINAL[kind]
                    if last[0] and not last[4]:
                        change(at, *last[:4], status)
                    steps += 1
                    word = status.capitalize()
                    change(at, steps, f"terminal:{status}", word,
                           "Finished" if status == "completed" else word, status)
                if len(out) >= ROWS:
                    yield _give(out, STEPS)
                    out = []
            self._turns.updateValue((turn,), (
                *last, phase, status, steps, list(tools), [no for no, _ in tools.values()],
                [label for _, label in tools.values()]))
        if out:
            yield _give(out, STEPS)

    def close(self) -> None:
        pass


class TurnRegistry(StatefulProcessor):
    """Keep at most `limit` turns of a registry: the finished turn that ended first goes first, a
    running one never does. State is one row per kept turn; a turn that comes and goes within a
    micro-batch never reaches it."""

    def __init__(self, limit: int = TURN_LIMIT) -> None:
        self._limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._turns = handle.getMapState("turns", _schema("turn_id STRING"), ENDED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        stored = {turn[0]: value[0] for turn, value in self._turns.iterator()} \
            if self._turns.exists() else {}
        kept, out = dict(stored), []
        finished = [(ended, turn) for turn, ended in kept.items() if ended is not None]
        heapq.heapify(finished)
        for turn, at, starts, ends in _gather(rows, ("turn_id", "at", "starts", "ends"), "at"):
            if starts:
                kept.setdefault(turn, None)
            if ends and turn in kept:
                kept[turn] = at
                heapq.heappush(finished, (at, turn))
            while len(kept) > self._limit and finished:
                ended, oldest = heapq.heappop(finished)
                if kept.get(oldest) == ended:
                    del kept[oldest]
                    out.append((key[0], oldest, ended, at))
            if len(out) >= ROWS:
                yield _give(out, EVICTED)
                out = []
        if out:
            yield _give(out, EVICTED)
        for turn in stored.keys() - kept.keys():
            self._turns.removeKey((turn,))
        for turn, ended in kept.items():
            if turn not in stored or stored[turn] != ended:
                self._turns.updateValue((turn,), (ended,))

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """Accepted and refused events of a stream of TURN_EVENTS rows (refused ones carry why).

    Within a micro-batch a turn's rows are taken in arrival order; they are held as numbers, some
    tens of bytes each. Forgetting needs the clock, which keeps a query going without new data;
    leave it out for runs that should end.
    """
    slim = events.select(*EVENT)
    if forget_after_ms is not None:
        return slim.groupBy("turn_id").transformWithStateInPandas(
            TurnFold(forget_after_ms), OUTPUT, "append", "processingTime")
    return _bucketed(slim).transformWithStateInPandas(
        TurnFolds(), OUTPUT, "append", "none")


def with_texts(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """Landed verdicts with the texts of their events."""
    return verdicts.join(events.select("turn_id", "arrival", "delta"), ["turn_id", "arrival"],
                         "left")


def trace_stream(verdicts: DataFrame) -> DataFrame:
    """Changes of execution steps from the accepted events of a stream of verdicts."""
    return _bucketed(verdicts.filter("accepted").select(*ACCEPTED)).transformWithStateInPandas(
        TurnTrace(), STEPS, "append", "none")


def current_steps(changes: DataFrame, max_steps: int = MAX_TRACE_STEPS) -> DataFrame:
    """The steps as the changes so far left them; the newest `max_steps` of a turn."""
    steps = changes.groupBy("turn_id", "step_no").agg(F.max_by(
        F.struct("step_id", "label", "detail", "state"), "version").alias("s"))
    newest = changes.groupBy("turn_id").agg(F.max("step_no").alias("n"))
    return steps.join(newest, "turn_id").filter(F.col("step_no") > F.col("n") - max_steps).select(
        "turn_id", "step_no", "s.*")


def registry_stream(verdicts: DataFrame, registry, limit: int = TURN_LIMIT) -> DataFrame:
    """Turns that leave their registry (a column of the verdicts), with what made them leave."""
    ends = F.col("type").isin(*TERMINAL)
    starts = F.col("sequence") == 1
    slim = verdicts.filter(F.col("accepted") & (starts | ends)).select(
        registry.alias("registry"), "turn_id", F.col("arrival").alias("at"),
        starts.cast("int").alias("starts"), ends.cast("int").alias("ends"))
    return slim.groupBy("registry").transformWithStateInPandas(
        TurnRegistry(limit), EVICTED, "append", "none")


# Executors get the processors themselves, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
