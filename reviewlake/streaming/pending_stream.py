"""Findings that wait: keyed state holds a pending finding until its data, its retest or its verification arrives.

A change is a row (finding_id, at, kind, action, reason, resume_events, event): a ``check`` tells what a checklist's overall action is now, an
``event`` that something has come in. The state of a finding is what it waits for, or events that came before it was held, which
count once it is. Rows of a finding are taken in the order of ``at``, checks before events of the same time; a change that comes late, in
a later batch than newer ones, counts when it comes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "finding_id string, at timestamp, kind string, action string, reason string, resume_events array<string>, event string"
OUTCOMES = "finding_id string, change string, reason string, event string, at timestamp"
_STATE = "held boolean, reason string, events array<string>, early array<string>"


def as_changes(checked: DataFrame, at) -> DataFrame:
    """Rows of ``spec_checklist`` as changes at a given time."""
    none = F.lit(None).cast("string")
    return checked.select("finding_id", at.cast("timestamp").alias("at"), F.lit("check").alias("kind"), F.col("overall_action").alias("action"), F.col("pending.reason").alias("reason"), F.col("pending.resume_events").alias("resume_events"), none.alias("event"))


def next_state(state: tuple, change) -> tuple[tuple, tuple[str, str | None, str | None] | None]:
    """State after a change, and what it makes known: (held, resumed or closed; reason; event)."""
    held, reason, events, early = state
    if change.kind == "event":
        if held and change.event in events:
            return (False, None, [], []), ("resumed", reason, change.event)
        return (held, reason, events, early if held or change.event in early else [*early, change.event]), None
    if change.action == "pending":
        wanted = list(change.resume_events) if change.resume_events is not None else []
        met = next((e for e in early if e in wanted), None)
        if met is not None:
            return (False, None, [], []), ("resumed", change.reason, met)
        told = None if held and (reason, events) == (change.reason, wanted) else ("held", change.reason, None)
        return (True, change.reason, wanted, []), told
    return (False, None, [], early), ("closed", reason, None) if held else None


class _Change(NamedTuple):
    at: pd.Timestamp
    kind: str
    action: str | None
    reason: str | None
    resume_events: Sequence[str] | None
    event: str | None


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (False, None, [], [])
    now = (bool(now[0]), now[1], list(now[2]), list(now[3]))
    out = []
    # a finding has a row or two: plain tuples, since pandas' own sorting and joining would cost more than all the rest
    changes = [_Change(*row) for frame in frames for row in zip(*[frame[name].array for name in _Change._fields])]
    for row in sorted(changes, key=lambda x: (x.at, x.kind, x.event is None, x.event or "")):
        now, told = next_state(now, row)
        if told:
            out.append((key[0], *told, row.at))
    if now == (False, None, [], []):
        if state.exists:
            state.remove()
    else:
        state.update(now)
    if out:
        yield pd.DataFrame(out, columns=["finding_id", "change", "reason", "event", "at"])


def pending_stream(changes: DataFrame) -> DataFrame:
    """(finding_id, change, reason, event, at) of a stream of changes: ``held``, ``resumed`` by an event, ``closed`` by a later check."""
    rows = changes.where("finding_id is not null and at is not null and kind in ('check', 'event')")
    return rows.groupBy("finding_id").applyInPandasWithState(_advance, OUTCOMES, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_pending(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once, to Parquet; a later run with the same checkpoint goes on where this one ended."""
    return pending_stream(changes).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
