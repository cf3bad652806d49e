"""Learning jobs followed in event time.

A job begins with its document's start event and ends with what comes first: a
finish, a failure, another start (it was interrupted and begun again), or
``TIMEOUT`` without any of them, which a timer tells. Events may come late and
more than once: a job keeps those that the watermark has not reached yet and
takes them in the order of their time, each once; events older than the
watermark are too late. State is what is open and what waits, so it is bounded
by the watermark's delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "10 minutes"
TIMEOUT_MS = 6 * 3600 * 1000
#: How an open job ends, by the event that ends it.
ENDS = {"finished": "finished", "failed": "failed", "started": "interrupted"}
JOBS = "document_id long, started_at timestamp, status string, ended_at timestamp"


def _time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def follow(held: dict, events: list[tuple[int, int, str]], watermark_ms: int, timeout_ms: int = TIMEOUT_MS) -> list[tuple[int, str, int]]:
    """Take events (time in microseconds, id, kind) into the state and return the jobs that ended: start, status, end.

    ``held``: open (the start of the open job, or None) and waiting events.
    """
    now, limit = watermark_ms * 1000, timeout_ms * 1000
    waiting = {(t, i): k for t, i, k in held["waiting"]} | {(t, i): k for t, i, k in events if t > now or watermark_ms == 0}
    ended = []
    for t, i in sorted(waiting):
        if t > now:
            break
        kind = waiting.pop((t, i))
        if held["open"] is not None and t > held["open"] + limit:
            ended.append((held["open"], "timed_out", held["open"] + limit))
            held["open"] = None
        if held["open"] is not None and kind in ENDS:
            ended.append((held["open"], ENDS[kind], t))
            held["open"] = None
        if kind == "started":
            held["open"] = t
    if held["open"] is not None and held["open"] + limit <= now:
        ended.append((held["open"], "timed_out", held["open"] + limit))
        held["open"] = None
    held["waiting"] = [(t, i, k) for (t, i), k in sorted(waiting.items())]
    return ended


def job_states(events: DataFrame, delay: str = DELAY, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """A stream of (document_id, event_id, at, kind) to one row per ended job, in append mode."""

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"open": None, "waiting": []}
        new = [] if state.hasTimedOut else [(int(t.value) // 1000 if t.unit == "ns" else int(t.as_unit("us").value), int(i), k) for p in parts for t, i, k in zip(p["at"], p["event_id"], p["kind"], strict=True)]
        watermark = state.getCurrentWatermarkMs()
        ended = follow(held, new, watermark, timeout_ms)
        if held["open"] is None and not held["waiting"]:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            times = [held["waiting"][0][0] // 1000 + 1] if held["waiting"] else []
            times += [held["open"] // 1000 + timeout_ms + 1] if held["open"] is not None else []
            state.setTimeoutTimestamp(max(min(times), watermark + 1))
        if ended:
            yield pd.DataFrame({"document_id": [key[0]] * len(ended), "started_at": [_time(s) for s, _, _ in ended], "status": [w for _, w, _ in ended], "ended_at": [_time(e) for _, _, e in ended]})

    rows = events.filter("document_id is not null and at is not null and event_id is not null").select("document_id", "event_id", "at", "kind").withWatermark("at", delay)
    return rows.groupBy("document_id").applyInPandasWithState(each, JOBS, "held string", "append", GroupStateTimeout.EventTimeTimeout)
