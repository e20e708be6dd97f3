"""Late and out-of-order events: K-slack buffering with provisional, corrected and final hourly figures.

A part of a period (`Part`) takes its events in order of arrival; the arrival time is its clock. It holds them until
`slack` after the period's end, then sorts what it holds by event time and releases it into the figures, which
are provisional from there. Later events correct them until `cutoff` after the end, when the figures become
final; what comes after that is dropped and named. The figures are order sensitive: they have the first and
last value by event time.

`k_slack` runs parts over a table: events are spread by (period, part), each part of at most PART_ROWS events on
average, however many rows a period has, and reach it in order of arrival. `tramline.streaming.kslack` runs the same
parts over a stream, with timers. Parts of a period hold disjoint events and are put together by `combined`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.ids import floor_div, micros
from tramline.session import small_side

SECOND = 1_000_000
PART_ROWS = 100_000
#: Most periods whose number of parts is broadcast; more are joined by a shuffle.
MAX_PERIODS = 300_000
VERDICTS = ("in_time", "corrects", "dropped")


@dataclass(frozen=True)
class Slack:
    period_s: int = 3600
    slack_s: int = 120
    cutoff_s: int = 6 * 3600


class Figures:
    """What is kept of released events: count, sum of values, first and last value by (event time, record)."""

    __slots__ = ("first", "last", "m", "n", "total")

    def __init__(self) -> None:
        self.n, self.m, self.total, self.first, self.last = 0, 0, 0.0, None, None

    def fold(self, event: np.ndarray, record: np.ndarray, value: np.ndarray) -> None:
        """Take events in order of arrival: sort them, then take them in order; a NaN value is none. The sum alone is in order of arrival."""
        self.n += len(event)
        known = ~np.isnan(value)
        if not known.any():
            return
        self.m += int(known.sum())
        self.total = float(np.cumsum(np.concatenate([[self.total], value[known]]))[-1])
        order = np.lexsort((record, event))
        some = order[known[order]]
        at = lambda k: (int(event[k]), int(record[k]), float(value[k]))
        a, b = at(some[0]), at(some[-1])
        self.first = a if self.first is None else min(self.first, a)
        self.last = b if self.last is None else max(self.last, b)

    def copy(self) -> Figures:
        f = Figures()
        f.n, f.m, f.total, f.first, f.last = self.n, self.m, self.total, self.first, self.last
        return f


class Part:
    """The buffer of a part of a period and its figures."""

    def __init__(self, period: int, slack: Slack):
        end = period + slack.period_s * SECOND
        self.release_at, self.close_at = end + slack.slack_s * SECOND, end + slack.cutoff_s * SECOND
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.figures = Figures()
        self.provisional: Figures | None = None  # as they were at the release
        self.corrects = self.dropped = 0

    def take(self, arrival: np.ndarray, event: np.ndarray, record: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Take events in order of arrival; the index in VERDICTS of each."""
        a, b = np.searchsorted(arrival, [self.release_at, self.close_at])
        if a and self.provisional is None:
            self.held.append((event[:a], record[:a], value[:a]))
        elif a:
            self.figures.fold(event[:a], record[:a], value[:a])
        if a < len(arrival):
            self.release()
        if b > a:
            self.figures.fold(event[a:b], record[a:b], value[a:b])
        self.corrects += int(b - a)
        self.dropped += int(len(arrival) - b)
        verdict = np.zeros(len(arrival), np.int8)
        verdict[a:b], verdict[b:] = 1, 2
        return verdict

    def release(self) -> None:
        """Sort what is held into the figures, once."""
        if self.provisional is None:
            if self.held:
                self.figures.fold(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
            self.held = []
            self.provisional = self.figures.copy()

    def so_far(self) -> Figures:
        """The figures with what is still held, as they would be if it were released now."""
        if not self.held:
            return self.figures
        now = self.figures.copy()
        now.fold(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        return now

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @staticmethod
    def load(state: bytes) -> Part:
        p = Part.__new__(Part)
        p.__dict__.update(pickle.loads(state))
        return p


def events(rows: DataFrame, src: str, record: str, event: str, arrival: str, value: str | None = None, slack: Slack = Slack()) -> DataFrame:
    """(src, record_id, period, event, arrival, value) of the rows with both times; period is its start, times are micros.

    An event on the edge of two periods belongs to the one it begins.
    """
    x = F.lit(None).cast("double") if value is None else F.when(~F.isnan(value), F.col(value)).cast("double")
    e = rows.select(F.lit(src).alias("src"), F.col(record).cast("long").alias("record_id"), micros(event).alias("event"), micros(arrival).alias("arrival"), x.alias("value"))
    p = slack.period_s * SECOND
    return e.filter("event is not null and arrival is not null").withColumn("period", floor_div(F.col("event"), p) * p)


def in_parts(held: DataFrame) -> DataFrame:
    """held with the part of its period that an event belongs to, by its hash; the number of parts goes by the period's rows."""
    sizes = held.groupBy("src", "period").agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
    return held.join(small_side(sizes, MAX_PERIODS), ["src", "period"]).withColumn("part", F.pmod(F.xxhash64("record_id", "event"), F.col("_parts")).cast("int")).drop("_parts")


_OUT = "src string, period long, part int, record_id long, verdict string, corrects long, dropped long"
for _name in ("provisional", "final"):
    _OUT += "".join(f", {_name}_{c}" for c in ("n long", "m long", "total double", "first_at long", "first_id long", "first double", "last_at long", "last_id long", "last double"))


def figure_row(name: str, f: Figures) -> dict:
    first, last = f.first or (None,) * 3, f.last or (None,) * 3
    return {f"{name}_{c}": v for c, v in zip(("n", "m", "total", "first_at", "first_id", "first", "last_at", "last_id", "last"), (f.n, f.m, f.total, *first, *last), strict=True)}


def run_parts(slack: Slack, schema: pa.Schema):
    """Arrow batches of events, each part's together and in order of arrival, to late rows and a row of figures per part. Held is what one part holds."""

    def closed(key: tuple, part: Part) -> dict:
        part.release()
        return {"src": key[0], "period": key[1], "part": key[2], "corrects": part.corrects, "dropped": part.dropped, **figure_row("provisional", part.provisional), **figure_row("final", part.figures)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None
        for b in batches:
            if not b.num_rows:
                continue
            src = b.column("src").dictionary_encode()
            names, code = src.dictionary.to_pylist(), src.indices.to_numpy(zero_copy_only=False)
            period, number, arrival, event, record = (b.column(c).to_numpy(zero_copy_only=False) for c in ("period", "part", "arrival", "event", "record_id"))
            value = b.column("value").cast(pa.float64()).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((period[1:] != period[:-1]) | (number[1:] != number[:-1]) | (code[1:] != code[:-1])) + 1
            verdicts = np.empty(b.num_rows, np.int8)
            done = []
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                k = (names[code[x]], int(period[x]), int(number[x]))
                if k != key:
                    if part is not None:
                        done.append(closed(key, part))
                    key, part = k, Part(k[1], slack)
                verdicts[x:y] = part.take(arrival[x:y], event[x:y], record[x:y], value[x:y])
            late = np.flatnonzero(verdicts)
            if len(late):
                n = len(late)
                told = {"src": b.column("src").take(pa.array(late)), "period": pa.array(period[late]), "part": pa.array(number[late], pa.int32()), "record_id": b.column("record_id").take(pa.array(late)), "verdict": pa.array([VERDICTS[v] for v in verdicts[late].tolist()])}
                yield pa.RecordBatch.from_arrays([told[f.name].cast(f.type) if f.name in told else pa.nulls(n, f.type) for f in schema], schema=schema)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if part is not None:
            yield pa.RecordBatch.from_pylist([closed(key, part)], schema=schema)

    return run


def k_slack(held: DataFrame, slack: Slack = Slack()) -> DataFrame:
    """Run `events` through the buffers: rows with a verdict are late events, rows without one the figures of a part."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    keys = ["src", "period", "part"]
    ordered = in_parts(held).repartition(*keys).sortWithinPartitions(*keys, "arrival", "record_id")
    return ordered.mapInArrow(run_parts(slack, to_arrow_schema(_parse_datatype_string(_OUT))), _OUT)


def late_events(held: DataFrame, slack: Slack = Slack()) -> DataFrame:
    """(src, record_id, verdict) of every event that came after its period's release: `corrects`, or `dropped` after the cut-off."""
    return k_slack(held, slack).filter("verdict is not null").select("src", "record_id", "verdict")


def late_rows(rows: DataFrame, src: str, record: str, event: str, arrival: str, slack: Slack = Slack()) -> DataFrame:
    """(src, record_id, verdict) of every late row of a table.

    Rows without an event time or an arrival time are no events. Clocks that run ahead are in time. record must
    be a whole number; repeated rows count each. No rows, no result. Extra columns are ignored.
    """
    return late_events(events(rows, src, record, event, arrival, slack=slack), slack)


def combined(parts: DataFrame, names: list[str]) -> list:
    """Aggregates that put the parts of a period together."""
    out = []
    for p in names:
        order = lambda side, p=p: F.struct(f"{p}_{side}_at", f"{p}_{side}_id")
        some = lambda side, p=p: F.when(F.col(f"{p}_{side}_at").isNotNull(), order(side, p))
        out += [
            F.sum(f"{p}_n").alias(f"{p}_n"),
            F.try_divide(F.sum(f"{p}_total"), F.sum(f"{p}_m")).alias(f"{p}_avg"),
            F.min_by(f"{p}_first", some("first")).alias(f"{p}_first"),
            F.max_by(f"{p}_last", some("last")).alias(f"{p}_last"),
        ]
    return out


def released(rows: DataFrame, src: str, record: str, event: str, arrival: str, value: str, slack: Slack = Slack()) -> DataFrame:
    """Figures per period: provisional (in time) and final (with corrections), and the late rows by verdict.

    n counts rows; avg, first and last are of non-null values that are numbers, first and last in order
    of (event time, record).
    """
    parts = k_slack(events(rows, src, record, event, arrival, value, slack), slack).filter("verdict is null")
    late = [F.sum(k).alias(k) for k in ("corrects", "dropped")]
    return parts.groupBy("src", F.timestamp_micros("period").alias("period")).agg(*combined(parts, ["provisional", "final"]), *late)
