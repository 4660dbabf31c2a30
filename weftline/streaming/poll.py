"""The merging of a plan batch by batch as a stream: polled states come in, what became of each group goes out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "change_id string, group_id string, level int, outcome string, polls int"
#: Outcomes after which later batches aren't begun.
STOPS = ("timeout", "closed", "fetch error")


def terminal_states(states: DataFrame, key: str, state: str, time: str, terminal: list[str], timeout: str = "10 minutes") -> DataFrame:
    """From a stream of states one row for each key: its first terminal state to arrive. What is
    remembered of a key is dropped when the watermark has passed the timeout."""
    rows = states.withWatermark(time, timeout).filter(F.col(state).isin(terminal))
    return rows.dropDuplicatesWithinWatermark([key])


def reason(state: str | None, review: str | None, draft: bool | None) -> str:
    """What operators/status.py's merge_outcome() says of a group with a pull request."""
    if state is None:
        return "skip: state unknown"
    if state == "MERGED":
        return "merged"
    if state != "OPEN":
        return f"skip: {state.lower()}"
    if draft:
        return "skip: draft"
    return f"skip: {review.lower().replace('_', ' ')}" if review in ("CHANGES_REQUESTED", "REVIEW_REQUIRED") else "merge"


class _Batches(StatefulProcessor):
    """Of one change: the batch that is being merged, which of its groups wait, and until when."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        for r in sorted(rows, key=lambda r: (r["ms"], r["group_id"])):
            if s is None:
                s = {"batches": [list(b) for b in r["batches"]], "level": 0, "said": {}, "polls": {}, "wait": [], "done": [], "broken": False, "timer": 0, "since": r["ms"]}
            s["said"][r["group_id"]] = [r["state"], r["review_decision"], r["is_draft"]]
            s["polls"][r["group_id"]] = s["polls"].get(r["group_id"], 0) + 1
            yield from self._advance(key[0], s, r["ms"])
        self._keep(s)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        s, at = json.loads(self.kept.get()[0]), expiredTimerInfo.getExpiryTimeInMs()
        if at == s["timer"] and s["level"] < len(s["batches"]):
            s["timer"] = 0
            for g in s["batches"][s["level"]]:
                if g not in s["done"]:
                    yield self._end(key[0], s, g, "timeout" if g in s["wait"] else "skip: state unknown")
            yield from self._advance(key[0], s, at)
        self._keep(s)

    def close(self) -> None:
        pass

    def _end(self, change: str, s: dict, group: str, outcome: str) -> Row:
        s["done"].append(group)
        s["broken"] |= outcome in STOPS
        return Row(change_id=change, group_id=group, level=s["level"], outcome=outcome, polls=s["polls"].get(group, 0))

    def _advance(self, change: str, s: dict, now: int) -> Iterator[Row]:
        """Settles what the states so far settle. A group that may be merged waits until it is, or is closed."""
        while s["level"] < len(s["batches"]):
            batch = s["batches"][s["level"]]
            for g in (g for g in batch if g not in s["done"] and g in s["said"]):
                state, review, draft = s["said"][g]
                outcome = reason(state, review, draft)
                if g in s["wait"] and outcome != "merged":
                    outcome = "closed" if state == "CLOSED" else "fetch error" if not state else "merge"
                if outcome != "merge":
                    yield self._end(change, s, g, outcome)
                elif g not in s["wait"]:
                    s["wait"].append(g)
            if any(g not in s["done"] for g in batch):
                return
            s["level"] += 1
            s["wait"], s["since"] = [], now
            if s["broken"]:
                for s["level"] in range(s["level"], len(s["batches"])):
                    for g in s["batches"][s["level"]]:
                        yield self._end(change, s, g, "not reached")
                s["level"] = len(s["batches"])

    def _keep(self, s: dict) -> None:
        """A timer for the batch that is waited for, none when all are done."""
        until = s["since"] + self.timeout_ms if s["level"] < len(s["batches"]) else 0
        if until != s["timer"]:
            if s["timer"]:
                self.handle.deleteTimer(s["timer"])
            if until:
                self.handle.registerTimer(until)
            s["timer"] = until
        self.kept.update((json.dumps(s),))


def merge_stream(states: DataFrame, levels: DataFrame, time: str = "ts", delay: str = "0 seconds", timeout_seconds: int = 600) -> DataFrame:
    """OUTCOMES of each group, once: what status.merge_walk() says of the final states, as they arrive.

    states: a stream of polled states (change_id, group_id, state, review_decision, is_draft, time). levels: change_id,
    group_id, level of the groups with a pull request (graph.levels()). Batches are merged in order: a group that can't be
    merged is skipped, one that can is waited for until it is merged, closed, can't be fetched, or the batch has
    waited `timeout_seconds` of event time; after any of those but the first the walk ends, and what comes after isn't reached. State
    and timers are kept for each change, so a query goes on from its checkpoint. Wants the RocksDB state store."""
    by_level = levels.filter("level is not null").groupBy("change_id", "level").agg(F.array_sort(F.collect_list(F.col("group_id").cast("string"))).alias("groups"))
    plans = by_level.groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "groups"))), lambda x: x["groups"]).alias("batches"))
    plans = plans.select(F.col("change_id").cast("string"), "batches")
    rows = states.withWatermark(time, delay).select(F.col("change_id").cast("string"), F.col("group_id").cast("string"), "state", "review_decision", "is_draft", F.unix_millis(time).alias("ms"), time)
    return rows.join(plans, "change_id").groupBy("change_id").transformWithState(_Batches(timeout_seconds * 1000), OUTCOMES, "Append", "EventTime")
