"""Repeated messages over a stream: the seen ranges of a block of numbers are its state.

A micro-batch reads and writes the state of the blocks that it has rows of, and of no others. Copies may come at any
time, so state is kept; ranges merge, so that a block without gaps is one of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tramline.operators.dedup import RANGE, Keys, Ranges, ping_deliveries


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = Ranges() if key[0] == RANGE else Keys()
    if state.exists:
        for lo, hi in pickle.loads(state.get[0]):
            seen.add(lo, hi)
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["received", "delivery_id"], na_position="first", kind="stable")
    number = [None if missing else int(x) for x, missing in zip(rows["number"], rows["number"] == "", strict=True)]
    new = [seen.accept(x) for x in number]
    state.update((pickle.dumps(list(zip(seen.lo, seen.hi, strict=True))),))
    yield pd.DataFrame({"delivery_id": rows["delivery_id"][new].astype("int64")})


def accepted(pings: DataFrame) -> DataFrame:
    """A stream of the delivery_id of every new message of a stream of pings, once."""
    # numbers go as text: a null among them would make pandas turn all into floats
    d = ping_deliveries(pings).select("kind", "producer", "block", "received", "delivery_id", F.coalesce(F.col("lo").cast("string"), F.lit("")).alias("number"))
    return d.groupBy("kind", "producer", "block").applyInPandasWithState(_fold, "delivery_id long", "seen binary", "append", GroupStateTimeout.NoTimeout)
