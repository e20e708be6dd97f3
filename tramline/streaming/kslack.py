"""K-slack over a stream: figures per period, provisional from the buffer, final after the cut-off.

The key is the period and a part of it, so that one busy hour is spread. The state of a key is the `Part` of
the batch form: its buffer and its figures. The watermark runs over the arrival times and is the clock: its
timers release a period that nothing more comes for, and at the cut-off send its figures as final, once, and
remove the state. Until then every batch sends what the figures are so far. Events that come after the cut-off
are counted as dropped and make no new state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tramline.operators.late import Part, Slack, combined, events, figure_row

STATE = "part binary"
OUT = "period long, part int, state string, sent long, corrects long, dropped long, final_n long, final_m long, final_total double, final_first_at long, final_first_id long, final_first double, final_last_at long, final_last_id long, final_last double"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
RANK = {"provisional": 0, "corrected": 1, "final": 2}


def _fold(slack: Slack):
    def row(key: tuple, part: Part, state: str) -> pd.DataFrame:
        f = part.so_far()
        seen = f.n + part.dropped
        return pd.DataFrame([{"period": key[0], "part": key[1], "state": state, "sent": seen, "corrects": part.corrects, "dropped": part.dropped, **figure_row("final", f)}], columns=COLUMNS)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = Part.load(state.get[0]) if state.exists else Part(int(key[0]), slack)
        if state.hasTimedOut:
            part.release()
            if state.getCurrentWatermarkMs() * 1000 >= part.close_at:
                state.remove()
                yield row(key, part, "final")
            else:
                state.update((part.dump(),))
                state.setTimeoutTimestamp(part.close_at // 1000)
                yield row(key, part, "corrected" if part.corrects else "provisional")
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["_at", "record_id"], kind="stable")
        arrival = rows["_at"].to_numpy(np.int64)
        known = state.exists
        part.take(arrival, rows["event"].to_numpy(np.int64), rows["record_id"].to_numpy(np.int64), rows["value"].to_numpy(np.float64))
        clock = state.getCurrentWatermarkMs()
        if not known and clock * 1000 >= part.close_at:
            # closed before: what comes now is dropped, and is all there is to say
            yield row(key, part, "dropped")
            return
        state.update((part.dump(),))
        next_at = part.close_at if part.provisional is not None else part.release_at
        state.setTimeoutTimestamp(max(next_at // 1000, clock + 1))
        yield row(key, part, "corrected" if part.corrects else "provisional")

    return fold


def figures(rows: DataFrame, record: str, event: str, arrival: str, value: str, slack: Slack = Slack(), parts: int = 8, disorder: str = "1 minute") -> DataFrame:
    """A stream of updates per (period, part). disorder: how far arrival times may be out of order between batches; older ones are left out by the watermark."""
    e = events(rows, "", record, event, arrival, value, slack).drop("src")
    timed = e.withColumn("_clock", F.timestamp_micros("arrival")).withWatermark("_clock", disorder).withColumnRenamed("arrival", "_at")
    k = timed.withColumn("part", F.pmod(F.xxhash64("record_id", "event"), F.lit(parts)).cast("int"))
    return k.groupBy("period", "part").applyInPandasWithState(_fold(slack), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def combine(updates: DataFrame) -> DataFrame:
    """Figures per period of the newest update of every part, with what was dropped after the part was final; `state` is
    final if every part is."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("state")]
    live = updates.filter("state <> 'dropped'").groupBy("period", "part").agg(F.max_by(F.struct("*"), F.struct(rank, "sent")).alias("u")).select("u.*")
    after = updates.filter("state = 'dropped'").groupBy("period").agg(F.sum("dropped").alias("_after"))
    one = live.groupBy("period").agg(*combined(live, ["final"]), F.min(rank).alias("_rank"), F.sum("corrects").alias("corrects"), F.sum("dropped").alias("_dropped"))
    word = F.element_at(F.array(*[F.lit(w) for w in RANK]), F.col("_rank") + 1)
    both = one.join(after, "period", "full").withColumn("dropped", F.coalesce("_dropped", F.lit(0)) + F.coalesce("_after", F.lit(0)))
    return both.select("period", F.coalesce("final_n", F.lit(0)).alias("n"), F.col("final_avg").alias("avg"), F.col("final_first").alias("first"), F.col("final_last").alias("last"), F.coalesce("corrects", F.lit(0)).alias("corrects"), "dropped", F.coalesce(word, F.lit("final")).alias("state"))


