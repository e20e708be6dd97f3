"""Implausible readings per source: plausibility limits, peaks over a threshold, stuck values.

Readings are rows (src, source, record_id, t, x). A reading is named if

  a. it is no number or outside its limits (plausibility),
  b. it lies far above what its source normally shows,
  c. it is one of `stuck` or more successive readings of its source with the very same value, not 0.

For b, peaks over a threshold: a reading less the level of its source and hour of day (`levels`) is its residual;
residuals above 1.5 times their median distance from 0 are the source's peaks; a generalised Pareto tail is
fitted to the peaks' excesses (`tail_cutoffs`) and gives the residual that the source exceeds at a fixed risk. Spikes
are peaks themselves, so the fit goes by the quartiles of the excesses, which a share of spikes doesn't move, and
not by their moments, which it does. With `confirm` a reading above the cut-off must also exceed M + 8 D, M being
the median of its source's ordinary readings and D the median of their distances from it.

A source may hold any share of the rows: medians come from histograms, runs are found within (source, UTC
day) and joined across days by the first and last run of each day.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.ids import floor_div, micros
from tramline.functions.medians import bin_edge, bin_of, grouped_median, histogram, read_off
from tramline.operators.dedup import first_pings
from tramline.session import keep, small_side

DAY = 86_400_000_000
KEYS = ["src", "source"]
#: Most sources whose limits (24 levels and four figures each) are broadcast; more are joined by a shuffle.
MAX_SOURCES = 200_000


@dataclass(frozen=True)
class Rules:
    """risk: chance of a normal reading to exceed its source's cut-off; proposal_risk: the same where M + 8 D must confirm."""

    peak_spreads: float = 1.5
    far_spreads: float = 8.0
    least_readings: int = 30
    stuck: int = 8
    risk: float = 1e-4
    proposal_risk: float = 2e-2
    shape_weight: float = 100.0  # peaks that a src's common shape counts for beside a source's own
    most_excess: float = 1.5  # spreads; a median excess above it is spikes rather than a tail


#: Highest possible readings by src (fixed values): metres a second, metres.
LIMITS = {"vehicle_positions": 60.0, "shape_projections": 20_000.0}


def sound_pings(pings: DataFrame, *carry: str) -> DataFrame:
    """Kept rows (vehicle, second, _t, carry) whose clock is at most 2 minutes ahead of their arrival; rows without either time are not sound."""
    first = first_pings(pings, "timestamp", "receivedAt", *carry)
    return first.filter(micros("timestamp") <= micros("receivedAt") + 120_000_000).select("vehicle", "second", micros("timestamp").alias("_t"), *carry)


def transit_readings(pings: DataFrame, projections: DataFrame) -> DataFrame:
    """Speeds of sound pings and cross-track distances of projections; nulls are no readings."""
    speeds = sound_pings(pings, "deliveryId", "speedMetersPerSecond").select(
        F.lit("vehicle_positions").alias("src"), F.col("vehicle").alias("source"), F.col("deliveryId").alias("record_id"), F.col("_t").alias("t"), F.col("speedMetersPerSecond").alias("x")
    )
    offsets = projections.select(
        F.lit("shape_projections").alias("src"), F.col("vehicleId").alias("source"), F.col("projectionId").alias("record_id"), micros("timestamp").alias("t"), F.col("crossTrackMetres").alias("x")
    )
    return speeds.unionByName(offsets).filter("x is not null")


def impossible():
    top = F.create_map(*[F.lit(v) for kv in LIMITS.items() for v in kv])[F.col("src")]
    return F.isnan("x") | (F.col("x") < 0) | (F.col("x") > top)


def ordinary(readings: DataFrame) -> DataFrame:
    return readings.filter(~impossible() & (F.col("x") != 0) & F.col("source").isNotNull())


def centres(counts: DataFrame, rules: Rules) -> DataFrame:
    """(src, source, m, n_readings): the median of the readings of every source that has enough of them."""
    return grouped_median(counts, KEYS, "x", "m", "n_readings").filter(F.col("n_readings") >= rules.least_readings)


def spreads(counts: DataFrame, m: DataFrame) -> DataFrame:
    """m with d: the median distance of a source's readings from m."""
    away = counts.join(small_side(m, MAX_SOURCES), KEYS).select(*KEYS, F.abs(F.col("x") - F.col("m")).alias("y"), "n")
    return m.join(grouped_median(away, KEYS, "y", "d", "_n").drop("_n"), KEYS)


def stuck_rows(readings: DataFrame, rules: Rules) -> DataFrame:
    """(src, record_id) of the readings in a long run of one value.

    One shuffle by (source, day); what goes on from it are long runs and the first and last run of every day,
    which are joined to the neighbouring days' where the value goes on.
    """
    chunk = [*KEYS, "_day"]
    w = Window.partitionBy(*chunk).orderBy("t", "record_id")
    turn = F.when(F.lag("x").over(w).eqNullSafe(F.col("x")), 0).otherwise(1)
    runs = (
        readings.filter("source is not null")
        .withColumn("_day", floor_div(F.col("t"), DAY))
        .withColumn("_turn", turn)
        .withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_last", F.max("_run").over(Window.partitionBy(*chunk)))
        .withColumn("_size", F.count("*").over(Window.partitionBy(*chunk, "_run")))
    )
    some = keep(runs.filter((F.col("_run") == 1) | (F.col("_run") == F.col("_last")) | (F.col("_size") >= rules.stuck)).drop("t"))
    # a day's two edge runs, whatever their size, are one row each before they are put in order of days
    edge = some.filter("_run = 1 or _run = _last").groupBy(*chunk, "_run", "_last").agg(F.first("x").alias("x"), F.first("_size").alias("_size"))
    v = Window.partitionBy(*KEYS).orderBy("_day", "_run")
    goes_on = (F.col("_run") == 1) & F.lag("x").over(v).eqNullSafe(F.col("x")) & (F.lag("_run").over(v) == F.lag("_last").over(v))
    joined = (
        edge.withColumn("_new", F.when(goes_on, 0).otherwise(1))
        .withColumn("_chain", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*KEYS, "_chain")))
        .filter((F.col("_total") >= rules.stuck) & (F.col("_size") < rules.stuck))
        .select(*chunk, "_run")
    )
    long = some.filter(F.col("_size") >= rules.stuck).unionByName(some.join(joined, [*chunk, "_run"], "left_semi"))
    return long.filter("x <> 0").select("src", "record_id")


def hour_of_day():
    return F.pmod(floor_div(F.col("t"), 3_600_000_000), F.lit(24))


def levels(counts: DataFrame, m: DataFrame, rules: Rules) -> DataFrame:
    """(src, source, level): what a source with enough readings normally shows, an array over the hours of day.

    counts: (src, source, hour, x, n); m: `centres`. The level of an hour is the median of the source's own readings
    in it, read off their histogram, if there are `least_readings` of them; else its median over all hours and the
    season of the hour, which is the mean of what it adds to the medians of the other sources of the src, one vote
    a source. No level is below 0.
    """
    at_hour = read_off(histogram(counts, [*KEYS, "hour"], "x"), [*KEYS, "hour"], {"_at": (F.col("_all") - 1) / 2}, "_n").filter(F.col("_n") >= rules.least_readings)
    own = at_hour.join(m, KEYS).select(*KEYS, "hour", (F.col("_at") - F.col("m")).alias("_season"))
    pooled = own.groupBy("src", "hour").agg(F.avg("_season").alias("_pooled"))
    season = lambda d, c: d.groupBy(*[k for k in KEYS if k in d.columns]).agg(F.map_from_entries(F.collect_list(F.struct("hour", c))).alias(c))
    # at most 24 entries a source, and 24 a src
    both = m.join(season(own, "_season"), KEYS, "left").join(F.broadcast(season(pooled, "_pooled")), "src", "left")
    at = lambda h: F.greatest(F.lit(0.0), F.col("m") + F.coalesce(F.try_element_at("_season", h), F.try_element_at("_pooled", h), F.lit(0.0)))
    return both.select(*KEYS, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: at(h.cast("long"))).alias("level"))


def residual():
    return F.col("x") - F.get("level", F.col("hour").cast("int"))


def tail_cutoffs(counts: DataFrame, facts: DataFrame, rules: Rules, risk: float) -> DataFrame:
    """facts with peak_at, peaks, shape, scale and cutoff; peak_at and cutoff are residuals.

    facts: (src, source, d, n_readings, level, ...). Threshold, number of peaks and quartiles of the excesses are read off one
    histogram of a source's residuals, in units of its D. With q50 and q75 the quartiles, the Pareto tail that has
    them has the shape log2(q75 / q50 - 1) and the scale q50 * shape / (2 ** shape - 1). Shapes of single sources are
    uncertain: they are averaged with the median shape of their src, which counts for `shape_weight` peaks. Where the
    median excess is above `most_excess` spreads, more than half of the peaks are spikes; it is cut to that and the
    shape is the src's. A source without peaks has no cut-off.
    """
    unit = F.greatest(F.col("d"), F.lit(1e-6))
    y = counts.join(small_side(facts, MAX_SOURCES), KEYS).select(*KEYS, (residual() / unit).alias("_y"), "n")
    both = keep(y.groupBy(*KEYS, (F.col("_y") > 0).alias("_up"), bin_of(F.abs("_y")).alias("_bin")).agg(F.sum("n").alias("_c")))
    away = read_off(both.groupBy(*KEYS, "_bin").agg(F.sum("_c").alias("_c")), KEYS, {"_spread": (F.col("_all") - 1) / 2}, "_n").drop("_n")
    # the histogram above the threshold; the bin that it falls into counts in part
    lo, hi, at = bin_edge(F.col("_bin")), bin_edge(F.col("_bin") + 1), rules.peak_spreads * F.col("_spread")
    above = both.filter("_up").join(away, KEYS).withColumn("_c", F.col("_c") * F.least(F.lit(1.0), (hi - at) / (hi - lo))).filter("_c > 0")
    ranks = {"_q50": F.col("_all") * 0.5, "_q75": F.col("_all") * 0.75}
    q = read_off(above, KEYS, ranks, "peaks").join(away, KEYS)
    excess = lambda c: F.greatest(F.col(c) - rules.peak_spreads * F.col("_spread"), F.lit(1e-9))
    most = rules.most_excess * F.col("_spread")
    raw = F.log2(F.greatest(F.lit(1e-3), excess("_q75") / excess("_q50") - 1))
    fit = q.withColumns({"_raw": F.least(F.lit(1.0), F.greatest(F.lit(-1.0), raw)), "_w": F.when(excess("_q50") > most, 0.0).otherwise(F.col("peaks"))})
    common = fit.groupBy("src").agg(F.expr("percentile(round(_raw, 2), 0.5, cast(ceil(least(peaks, 1000)) as int))").alias("_common"))  # of at most 1,101 different values
    shape = (F.col("_w") * F.col("_raw") + rules.shape_weight * F.col("_common")) / (F.col("_w") + rules.shape_weight)
    found = fit.join(F.broadcast(common), "src").withColumn("shape", F.least(F.lit(0.5), F.greatest(F.lit(-0.5), shape)))
    flat = F.abs("shape") < 1e-6
    median = F.least(excess("_q50"), most)
    scale = F.when(flat, median / math.log(2)).otherwise(median * F.col("shape") / (F.pow(F.lit(2.0), F.col("shape")) - 1))
    told = found.select(*KEYS, "peaks", "shape", scale.alias("_scale"), (rules.peak_spreads * F.col("_spread")).alias("_at")).join(facts, KEYS)
    rate = F.least(F.lit(1.0), F.col("n_readings") * risk / F.col("peaks"))
    z = F.when(flat, -F.log(rate)).otherwise((F.pow(rate, -F.col("shape")) - 1) / F.col("shape"))
    return told.withColumns({"peak_at": F.col("_at") * unit, "scale": F.col("_scale") * unit, "cutoff": (F.col("_at") + F.col("_scale") * z) * unit}).drop("_at", "_scale")


def anomalies(readings: DataFrame, rules: Rules = Rules(), confirm: bool = True) -> DataFrame:
    """(src, record_id, impossible, far, stuck) of every reading that one of the rules names, once.

    Null readings must be filtered before (transit_readings does); NaN and infinite ones are impossible.
    Readings without a source are judged by rule a alone. Equal times are ordered by record_id. Sources
    with fewer than `least_readings` ordinary readings have no rule b. An empty table gives no rows.
    """
    rows = keep(readings)
    counts = ordinary(rows).select(*KEYS, hour_of_day().alias("hour"), "x", F.lit(1).cast("long").alias("n"))
    m = keep(centres(counts, rules))
    facts = keep(spreads(counts, m).join(levels(counts, m, rules), KEYS))
    limits = keep(tail_cutoffs(counts, facts, rules, rules.proposal_risk if confirm else rules.risk).select(*KEYS, "m", "d", "level", "cutoff"))
    judged = rows.withColumns({"hour": hour_of_day(), "impossible": impossible()}).join(small_side(limits, MAX_SOURCES), KEYS, "left")
    far = residual() > F.col("cutoff")
    if confirm:
        # a source that mostly shows one value (D is 0) has no spread to fit a tail in: all its readings are proposed
        far = (far | (F.col("d") == 0)) & (F.col("x") > F.col("m") + rules.far_spreads * F.col("d"))
    flags = judged.select("src", "record_id", "impossible", F.coalesce(~F.col("impossible") & far, F.lit(False)).alias("far"), F.lit(False).alias("stuck")).filter("impossible or far")
    no = F.lit(False)
    both = flags.unionByName(stuck_rows(rows, rules).select("src", "record_id", no.alias("impossible"), no.alias("far"), F.lit(True).alias("stuck")))
    return both.groupBy("src", "record_id").agg(*[F.max(c).alias(c) for c in ("impossible", "far", "stuck")])
