"""Alert episodes as keyed state of a stream of window records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tramline.functions.status import ALERTABLE, SEVERITY

LINGER_MS = 180_000


@dataclass
class Group:
    """State of a group: the newest window taken, and the open episode if there is one (started is not 0)."""

    top: int = -1
    started: int = 0
    last_seen: int = 0
    windows: int = 0
    worst: str = ""
    worst_ratio: float | None = None


def worse(status: str, ratio: float | None, than: str, than_ratio: float | None) -> bool:
    a, b = SEVERITY.get(status, 0), SEVERITY.get(than, 0)
    if a != b:
        return a > b
    return ratio is not None and than_ratio is not None and abs(ratio - 1) > abs(than_ratio - 1)


def observe(g: Group, end: int, status: str | None, ratio: float | None) -> str:
    """Take one record (window end in micros); what it changed, or REFUSED for one older than the newest taken."""
    if end < g.top:
        return "REFUSED"
    g.top = end
    if status not in ALERTABLE:
        was, g.started = g.started, 0
        return "CLEARED" if was else "NONE"
    if not g.started:
        g.started, g.last_seen, g.windows, g.worst, g.worst_ratio = end, end, 1, status, ratio
        return "OPENED"
    g.windows, g.last_seen = g.windows + 1, max(g.last_seen, end)
    before = g.worst
    if worse(status, ratio, g.worst, g.worst_ratio):
        g.worst, g.worst_ratio = status, ratio
    return "ESCALATED" if g.worst != before else "CONTINUED"


STATE = "top long, started long, last_seen long, windows long, worst string, worst_ratio double"
#: Times are micros, which mean the same on every worker.
OUT = "headwayGroup string, recordId long, windowEnd long, change string, startedAt long, lastSeenAt long, windowsObserved long, worstStatus string, worstRatio double"


def _row(group: str, record: int | None, end: int | None, change: str, started: int, g: Group) -> dict:
    return {"headwayGroup": group, "recordId": record, "windowEnd": end, "change": change, "startedAt": started or None, "lastSeenAt": g.last_seen or None, "windowsObserved": g.windows, "worstStatus": g.worst or None, "worstRatio": g.worst_ratio}


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One group's new records in order of arrival; silence beyond the linger closes its episode."""
    group = key[0]
    g = Group(*state.get) if state.exists else Group()
    out = []
    if state.hasTimedOut:
        if g.started:
            started, g.started = g.started, 0
            out.append(_row(group, None, g.last_seen, "SWEPT", started, g))
    else:
        # a group's records of one micro-batch; the source's rate limit bounds them
        new = pd.concat(list(frames)).sort_values(["emitted", "recordId"])
        for r in new.itertuples(index=False):
            started = g.started
            ratio = None if pd.isna(r.headwayRatio) else float(r.headwayRatio)
            change = observe(g, int(r.ends), r.status, ratio)
            if change != "REFUSED":
                out.append(_row(group, int(r.recordId), int(r.ends), change, g.started or started, g))
    state.update(tuple(asdict(g).values()))
    if g.started:
        state.setTimeoutDuration(LINGER_MS)
    if out:
        yield pd.DataFrame(out).astype({c: "Int64" for c in ("recordId", "windowEnd", "startedAt", "lastSeenAt")})


def changes(records: DataFrame) -> DataFrame:
    """A stream of records (headwayGroup, recordId, windowEnd, emittedAt, status, headwayRatio) to a stream of changes. Records without group or end are dropped."""
    rows = records.filter("headwayGroup is not null and windowEnd is not null").selectExpr(
        "headwayGroup", "recordId", "unix_micros(cast(windowEnd as timestamp)) as ends", "unix_micros(cast(emittedAt as timestamp)) as emitted", "status", "headwayRatio"
    )
    told = rows.groupBy("headwayGroup").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return told.withColumns({c: F.timestamp_micros(c) for c in ("windowEnd", "startedAt", "lastSeenAt")})
