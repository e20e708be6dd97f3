"""Messages delivered more than once: exactly one row per identifier, by disjoint seen ranges per producer.

An identifier is (producer, number). What has been seen of a producer is a set of disjoint ranges of
numbers (`Ranges`). Deliveries are taken in order of arrival: a number that a range covers is refused, any other is
accepted once and merged into the ranges. Ranges never cross a block of BLOCK numbers, so that a producer, however
large, is spread over many tasks, and no group of ranges holds more than BLOCK of them.

Rows whose producer is null or blank or whose number is null carry a malformed identifier. They have no
place in a range; they are looked up by their exact raw key (nulls equal nulls).

`decide` is one scan and one shuffle: copies that lie in one Arrow batch are refused before the shuffle, which
bounds what any number of copies of one identifier sends, and the rest meets its block in order of arrival. What was seen
before the batch comes first in its block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.ids import floor_div, micros, normal_id, seconds
from tramline.session import keep

BLOCK = 3600
#: Kinds of rows: by range, by exact raw key, and refused before the shuffle.
RANGE, EXACT, REFUSED = 0, 1, 2
ROW = "kind int, producer string, block long, old boolean, received long, delivery_id long, lo long, hi long"
TOLD = "refused boolean, delivery_id long, kind int, producer string, block long, lo long, hi long"


class Ranges:
    """Disjoint ranges of whole numbers that don't touch, in order."""

    __slots__ = ("hi", "lo")

    def __init__(self, lo: list[int] | None = None, hi: list[int] | None = None):
        self.lo, self.hi = lo or [], hi or []

    def accept(self, x: int) -> bool:
        """Whether x was not covered; it is then."""
        k = bisect_right(self.lo, x)
        if k and self.hi[k - 1] >= x:
            return False
        after_left, before_right = k > 0 and self.hi[k - 1] == x - 1, k < len(self.lo) and self.lo[k] == x + 1
        if after_left and before_right:
            self.hi[k - 1] = self.hi.pop(k)
            self.lo.pop(k)
        elif after_left:
            self.hi[k - 1] = x
        elif before_right:
            self.lo[k] = x
        else:
            self.lo.insert(k, x)
            self.hi.insert(k, x)
        return True

    def add(self, lo: int, hi: int) -> None:
        """Cover all of lo..hi, merging what it meets."""
        a = bisect_right(self.hi, lo - 2)
        b = bisect_right(self.lo, hi + 1)
        if a < b:
            lo, hi = min(lo, self.lo[a]), max(hi, self.hi[b - 1])
        self.lo[a:b], self.hi[a:b] = [lo], [hi]


class Keys:
    """Exact keys seen, in the form of Ranges that never merge."""

    def __init__(self) -> None:
        self.lo: list[int] = []
        self._seen: set = set()

    def accept(self, x: int | None) -> bool:
        if x in self._seen:
            return False
        self._seen.add(x)
        self.lo.append(x)
        return True

    def add(self, lo: int | None, hi: int | None) -> None:
        self.accept(lo)

    @property
    def hi(self) -> list:
        return self.lo


def identified(rows: DataFrame, producer: Column, number: Column, raw_producer: Column, raw_number: Column, received: Column, delivery: Column) -> DataFrame:
    """Deliveries as `decide` takes them, from their normal and raw identifiers."""
    fine = F.coalesce(raw_producer.isNotNull() & (producer != "") & number.isNotNull(), F.lit(False))
    n = F.when(fine, number).otherwise(raw_number)
    return rows.select(
        F.when(fine, RANGE).otherwise(EXACT).cast("int").alias("kind"),
        F.when(fine, producer).otherwise(raw_producer).alias("producer"),
        F.when(fine, floor_div(number, BLOCK)).otherwise(F.xxhash64(raw_producer, raw_number)).alias("block"),
        F.lit(False).alias("old"), received.cast("long").alias("received"), delivery.cast("long").alias("delivery_id"), n.alias("lo"), n.alias("hi"),
    )


def within_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark copies of an identifier that lie in one Arrow batch as refused, but for the first to arrive."""
    for b in batches:
        if b.num_rows > 1:
            low = np.int64(np.iinfo(np.int64).min)
            whole = lambda c, b=b: b.column(c).fill_null(low).to_numpy(zero_copy_only=False)
            code = b.column("producer").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            kind, lo, received, delivery = (whole(c) if c != "kind" else b.column(c).to_numpy() for c in ("kind", "lo", "received", "delivery_id"))
            order = np.lexsort((delivery, received, lo, code, kind))
            k, p, x = kind[order], code[order], lo[order]
            again = np.zeros(b.num_rows, bool)
            again[order[1:]] = (k[1:] == k[:-1]) & (p[1:] == p[:-1]) & (x[1:] == x[:-1])
            if again.any():
                sent = np.where(again, REFUSED, kind).astype(np.int32)
                block = np.where(again, delivery % 4096, b.column("block").to_numpy())  # they go anywhere
                b = b.set_column(0, "kind", pa.array(sent)).set_column(2, "block", pa.array(block))
        yield b


def by_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of deliveries, each block's together and in order of arrival, to refused deliveries and the ranges of the block."""
    schema = pa.schema([("refused", pa.bool_()), ("delivery_id", pa.int64()), ("kind", pa.int32()), ("producer", pa.string()), ("block", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
    key, seen = None, None

    def ranges_of(key: tuple, seen) -> tuple[list, ...]:
        n = len(seen.lo)
        return [None] * n, [None] * n, [key[0]] * n, [key[1]] * n, [key[2]] * n, list(seen.lo), list(seen.hi)

    for b in batches:
        out: tuple[list, ...] = tuple([] for _ in schema)
        rows = zip(*(b.column(c).to_pylist() for c in ("kind", "producer", "block", "old", "delivery_id", "lo", "hi")), strict=True)
        for kind, producer, block, old, delivery, lo, hi in rows:
            if kind == REFUSED:
                refused = True
            else:
                if key is None or block != key[2] or producer != key[1] or kind != key[0]:
                    if key is not None:
                        for c, v in zip(out, ranges_of(key, seen), strict=True):
                            c.extend(v)
                    key, seen = (kind, producer, block), Ranges() if kind == RANGE else Keys()
                if old:
                    seen.add(lo, hi)
                    continue
                refused = not seen.accept(lo)
            for c, v in zip(out, (refused, delivery, kind, producer, block, lo, hi), strict=True):
                c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(ranges_of(key, seen), schema, strict=True)], schema=schema)


def decide(deliveries: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """deliveries with `refused`, and the ranges and exact keys seen after them as rows whose `refused` is null.

    deliveries: `identified`. seen: such rows of the batches before (kind, producer, block, lo, hi).
    """
    rows = deliveries.mapInArrow(within_batch, ROW)
    if seen is not None:
        none = F.lit(None).cast("long")
        rows = rows.unionByName(seen.select("kind", "producer", "block", F.lit(True).alias("old"), none.alias("received"), none.alias("delivery_id"), "lo", "hi"))
    keys = ["kind", "producer", "block"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("old"), "received", "delivery_id").mapInArrow(by_ranges, TOLD)


def first_deliveries(rows: DataFrame, producer: Column, number: Column, raw_producer: Column, raw_number: Column, order: list[Column], carry: list[str]) -> DataFrame:
    """One row per identifier with its columns `carry`: the one that comes first by `order`. Copies meet as partial aggregates, so
    an identifier with any number of copies costs its tasks one row per map task."""
    fine = raw_producer.isNotNull() & (producer != "") & number.isNotNull()
    return (
        rows.select(
            fine.alias("_fine"),
            F.when(fine, producer).otherwise(raw_producer).alias("_producer"),
            F.when(fine, number).alias("_number"),
            F.when(~fine, raw_number).alias("_raw"),
            F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *carry).alias("_row"),
        )
        .groupBy("_fine", "_producer", "_number", "_raw")
        .agg(F.min("_row").alias("_row"))
    )


def first_pings(pings: DataFrame, *carry: str) -> DataFrame:
    """The kept row of every ping identifier (normal vehicle id, whole second): smallest receivedAt, then
    smallest deliveryId, as the columns vehicle, second and `carry`."""
    f = first_deliveries(
        pings, normal_id("vehicleId"), seconds("timestamp"), F.col("vehicleId"), micros("timestamp"), [micros("receivedAt"), F.col("deliveryId")], list(carry)
    )
    return f.select(F.when(F.col("_fine"), F.col("_producer")).alias("vehicle"), F.col("_number").alias("second"), *[F.col(f"_row.{c}").alias(c) for c in carry])


def ping_deliveries(pings: DataFrame) -> DataFrame:
    return identified(pings, normal_id("vehicleId"), seconds("timestamp"), F.col("vehicleId"), micros("timestamp"), micros("receivedAt"), F.col("deliveryId"))


def arrival_batches(pings: DataFrame, batches: int) -> list[DataFrame]:
    """The log cut into slices of arrival time of equal length; rows without one come in the first."""
    if batches < 2:
        return [pings]
    lo, hi = pings.agg(F.min("receivedAt"), F.max("receivedAt")).first()
    if lo is None:
        return [pings]
    at = F.col("receivedAt")  # compared as it is, so that the slices reach the scan
    edges = [F.lit(lo + (hi - lo) * k / batches) for k in range(1, batches)]
    first = [at.isNull() | (at < edges[0])]
    return [pings.filter(c) for c in first + [(at >= a) & (at < b) for a, b in zip(edges[:-1], edges[1:], strict=True)] + [at >= edges[-1]]]


def replay(pings: DataFrame, batches: int = 1) -> tuple[DataFrame, DataFrame]:
    """(refused delivery_id, what was seen in the end) of the delivery log, taken as so many batches in order of arrival, each against
    what was seen in those before."""
    seen, refused = None, None
    slices = arrival_batches(pings, batches)
    for batch in slices:
        told = decide(ping_deliveries(batch), seen)
        told = keep(told) if len(slices) > 1 else told  # its two results are read apart
        seen = told.filter("refused is null").select("kind", "producer", "block", "lo", "hi")
        some = told.filter("refused").select("delivery_id")
        refused = some if refused is None else refused.unionByName(some)
    return refused, seen


def repeated_deliveries(pings: DataFrame, batches: int = 1) -> DataFrame:
    """delivery_id of every row that is not the kept row of its identifier.

    Empty table: no rows. Null receivedAt sorts first. Null or blank vehicle ids and null timestamps are
    malformed identifiers: repeats only of rows with the very same raw vehicleId and timestamp. deliveryId
    must be unique; rows with equal receivedAt are told apart by it. Extra columns are ignored.
    """
    return replay(pings, batches)[0]


def ping_ranges(pings: DataFrame, batches: int = 1) -> DataFrame:
    """(producer, block, lo, hi): the seen ranges after the whole log."""
    return replay(pings, batches)[1].filter(F.col("kind") == RANGE).select("producer", "block", "lo", "hi")
