"""Streams drained over files against the batch forms."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import tramline.plans.flows as flows
from tramline.operators import episodes, late, spacing
from tramline.operators.dedup import repeated_deliveries
from tramline.sources.tables import table
from tramline.streaming import dedup, kslack
from tramline.streaming import episodes as folded
from tramline.streaming import spacing as job
from tramline.streaming.sinks import fan_out, folder_sink

SF = "/root/testdata/sf0.001"


def slices(df, folder, order, n=2):
    """df written as n parquet files in order, so that a stream takes them one by one."""
    edges = df.approxQuantile("_o", [k / n for k in range(n + 1)], 0.0) if df.count() else []
    for k in range(n):
        part = df.filter((F.col("_o") >= edges[k]) & ((F.col("_o") < edges[k + 1]) if k < n - 1 else F.lit(True)))
        tmp = f"{folder}-{k}"
        part.drop("_o").coalesce(1).write.parquet(tmp)
        os.makedirs(folder, exist_ok=True)
        (name,) = [x for x in os.listdir(tmp) if x.endswith(".parquet")]
        os.rename(f"{tmp}/{name}", f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    return df.sparkSession.readStream.schema(df.drop("_o").schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(q):
    q.awaitTermination(240)
    assert q.exception() is None


def test_window_records(spark, tmp_path):
    now = flows.stamped(spark, SF)
    pings = slices(now.withColumn("_o", F.col("ts").cast("double")), str(tmp_path / "in"), "ts")  # in order of event time: nothing is late
    rows = job.records(pings, table(spark, SF, "gtfs_trips"), table(spark, SF, "gtfs_shapes"), table(spark, SF, "gtfs_routes"), flows.timetable_rows(spark, SF), flows.active(spark))
    got = []
    shown = []
    both = lambda b, n: got.extend(b.collect())
    out = fan_out(folder_sink(str(tmp_path / "alerts")), folder_sink(str(tmp_path / "records")), shown.append)
    drain(job.start(rows, str(tmp_path / "cp"), lambda b, n: (out(b, n), both(b, n)), once=True))
    last = {(r.windowStart, r.headwayGroup): r for r in got}  # a window may be emitted again: the last counts
    want = {(r.windowStart, r.headwayGroup): r for r in spacing.batch_records(flows.projected(spark, SF), flows.timetable_rows(spark, SF), flows.active(spark)).filter("vehicleCount >= 2").collect()}
    assert last.keys() == want.keys() and len(want) > 5
    for k, w in want.items():
        assert last[k].orderedVehicles == w.orderedVehicles and last[k].status == w.status and last[k].scheduledHeadwaySeconds == w.scheduledHeadwaySeconds
        assert last[k].gapsMetres == pytest.approx(w.gapsMetres)
    assert spark.read.text(str(tmp_path / "records")).count() == len(got)


def test_episode_fold(spark, tmp_path):
    r = table(spark, SF, "route_headways")
    stream = slices(r.withColumn("_o", F.col("emittedAt").cast("timestamp").cast("double")), str(tmp_path / "in"), "emittedAt")
    q = folded.changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    want = {(x.recordId, x.change, x.windowEnd) for x in episodes.changes(r).collect()}
    taken = lambda: {(x.recordId, x.change, x.windowEnd) for x in spark.table("changes").selectExpr("* except (windowEnd)", "cast(windowEnd as timestamp_ntz) as windowEnd").collect() if x.change != "SWEPT"}
    for _ in range(40):  # open episodes keep their timers, so the query itself doesn't end
        if q.awaitTermination(3) or len(taken()) >= len(want):
            break
    q.stop()
    assert q.exception() is None
    got = taken()
    assert got == want and {c for _, c, _ in want} >= {"OPENED", "CONTINUED", "CLEARED"}


def test_episode_times_on_any_worker(monkeypatch):
    """Times are counts of micros: where the worker's clock is set to doesn't matter."""
    import time

    g, at = folded.Group(), 1_786_804_260_000_000
    folded.observe(g, at, "BUNCHING", 0.4)
    rows = []
    for zone in ("UTC", "Asia/Tokyo"):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
        rows.append(folded._row("15:0", 1, at, "OPENED", at, g))
    monkeypatch.undo()
    time.tzset()
    assert rows[0] == rows[1] and rows[0]["windowEnd"] == rows[0]["startedAt"] == rows[0]["lastSeenAt"] == at


def test_kslack(spark, tmp_path):
    v = table(spark, SF, "vehicle_positions")
    end = v.selectExpr("max(receivedAt) + interval 9 hours as receivedAt", "max(receivedAt) + interval 9 hours as timestamp")  # moves the clock past every cut-off
    v2 = v.unionByName(end.selectExpr("-1L as deliveryId", "receivedAt", "timestamp"), allowMissingColumns=True)
    for n in (3, 6):  # whatever the batches
        stream = slices(v2.withColumn("_o", F.col("receivedAt").cast("timestamp").cast("double")), str(tmp_path / f"in{n}"), "receivedAt", n)
        q = kslack.figures(stream, "deliveryId", "timestamp", "receivedAt", "speedMetersPerSecond").writeStream.outputMode("append").foreachBatch(lambda b, k, n=n: b.write.mode("overwrite").parquet(f"{tmp_path}/out{n}/b={k}")).option("checkpointLocation", str(tmp_path / f"cp{n}")).trigger(availableNow=True).start()
        drain(q)
        sent = spark.read.parquet(f"{tmp_path}/out{n}").collect()
        finals = [(x.period, x.part) for x in sent if x.state == "final"]
        assert len(finals) == len(set(finals))  # once
        last = {}
        for x in sorted(sent, key=lambda x: x.b):
            assert last.get((x.period, x.part)) != "final" or x.state == "dropped"  # never taken back
            last[x.period, x.part] = x.state
        got = {x.period: x for x in kslack.combine(spark.read.parquet(f"{tmp_path}/out{n}").drop("b")).collect()}
        for w in late.released(v, "v", "deliveryId", "timestamp", "receivedAt", "speedMetersPerSecond").collect():
            g = got[int(w.period.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)]
            assert (g.n, g.corrects, g.dropped, g.first, g.last) == (w.final_n, w.corrects, w.dropped, w.final_first, w.final_last)
            assert g.avg == pytest.approx(w.final_avg) if w.final_avg is not None else g.avg is None
        assert {g.state for g in got.values()} == {"final", "provisional"}  # the clock's own period goes on
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8  # all other state is gone


def test_dedup_stream(spark, tmp_path):
    v = table(spark, SF, "vehicle_positions")
    stream = slices(v.withColumn("_o", F.col("receivedAt").cast("timestamp").cast("double")), str(tmp_path / "in"), "receivedAt")
    q = dedup.accepted(stream).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(q)
    kept = [x.delivery_id for x in spark.table("accepted").collect()]
    dropped = {x.delivery_id for x in repeated_deliveries(v).collect()}
    assert len(kept) == len(set(kept)) and set(kept) == {x.deliveryId for x in v.select("deliveryId").collect()} - dropped
