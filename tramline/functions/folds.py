"""What comes before a row in its key's order, for keys of any size.

A key's rows are cut into chunks of time. What a chunk hands on (its greatest value, its sum, its last row) is one
row, put in order with those of the key's other chunks and given to the next chunk as a row before all of its own; so
no task orders more than one chunk of a key's rows, or one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.ids import floor_div, micros

CHUNK = 3_600_000_000
_FIRST = -(1 << 62)


def before(rows: DataFrame, keys: list[str], order: list[str], max_of: dict[str, Column] | None = None, lag_of: dict[str, Column] | None = None, sum_of: dict[str, Column] | None = None) -> DataFrame:
    """rows with one more column per name: for max_of the greatest value of the rows before, for lag_of the value of the row just
    before, for sum_of the sum up to and with the row.

    order: the first column is a time (null sorts first), the others settle ties. Null keys are a key of their own.
    """
    parts = [(f"_{kind}{i}", name, kind, c) for kind, some in (("max", max_of), ("lag", lag_of), ("sum", sum_of)) for i, (name, c) in enumerate((some or {}).items())]
    of = lambda kind: [p for p in parts if p[2] == kind]
    r = rows.withColumns({**{p: c for p, _, _, c in parts}, "_chunk": F.coalesce(floor_div(micros(order[0]), CHUNK), F.lit(_FIRST)), "_own": F.lit(1)})
    last = F.max_by(F.struct(*[p for p, *_ in of("lag")], F.lit(1).alias("_some")), F.struct(*order)).alias("_last")
    per = r.groupBy(*keys, "_chunk").agg(last, *[(F.max(p) if kind == "max" else F.sum(p)).alias(p) for p, _, kind, _ in parts if kind != "lag"])
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = per.select(
        *keys, "_chunk", F.lit(0).alias("_own"), F.last("_last").over(w).alias("_last"), *[(F.max(p) if kind == "max" else F.sum(p)).over(w).alias(p) for p, _, kind, _ in parts if kind != "lag"]
    ).select("*", *[F.col("_last")[p].alias(p) for p, *_ in of("lag")]).drop("_last")
    v = Window.partitionBy(*keys, "_chunk").orderBy("_own", *order)
    upto = v.rowsBetween(Window.unboundedPreceding, 0)
    new = {"max": lambda p: F.max(p).over(v.rowsBetween(Window.unboundedPreceding, -1)), "lag": lambda p: F.lag(p).over(v), "sum": lambda p: F.sum(p).over(upto)}
    told = r.unionByName(heads, allowMissingColumns=True).withColumns({name: new[kind](p) for p, name, kind, _ in parts})
    return told.filter("_own = 1").drop("_chunk", "_own", *[p for p, *_ in parts])
