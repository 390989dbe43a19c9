"""Logged anomaly intervals: durations, labels for samples, detector quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.times import interval_seconds
from driftgrid.session import store
from driftgrid.spread import lookup


def duration_by_type(log: DataFrame) -> DataFrame:
    """Number and length of the logged intervals of each anomaly type."""
    seconds = interval_seconds(F.col("start_ts"), F.col("end_ts"))
    return (
        log.withColumn("_s", seconds)
        .groupBy("anomaly_type")
        .agg(
            F.count("*").alias("n_intervals"),
            F.min("_s").alias("min_seconds"),
            F.avg("_s").alias("mean_seconds"),
            F.max("_s").alias("max_seconds"),
        )
    )


def intervals_by_hour(log: DataFrame) -> DataFrame:
    """The union of all intervals, cut at full hours: one row per hour with its disjoint parts.

    Overlapping intervals are merged, so a sample lies in at most one part.
    """
    hour_step = F.expr("interval 1 hour")
    span = F.sequence(
        F.date_trunc("hour", "start_ts"), F.date_trunc("hour", "end_ts"), hour_step
    )
    parts = (
        log.filter(F.col("start_ts") <= F.col("end_ts"))
        .select("start_ts", "end_ts", F.explode(span).alias("_hour"))
        .withColumn("_hour", F.col("_hour").cast("timestamp_ntz"))
        .select(
            "_hour",
            F.greatest("start_ts", "_hour").alias("_s"),
            F.least(F.col("end_ts"), F.col("_hour") + hour_step).alias("_e"),
        )
        .distinct()
    )
    order = Window.partitionBy("_hour").orderBy("_s", "_e")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = (F.col("_s") > F.max("_e").over(before)).cast("int")
    islands = parts.withColumn("_new", F.coalesce(starts, F.lit(0))).withColumn("_island", F.sum("_new").over(order))
    return (
        islands.groupBy("_hour", "_island")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        .groupBy("_hour")
        .agg(F.collect_list(F.struct("_s", "_e")).alias("_parts"))
    )


def label_intervals(samples: DataFrame, log: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``is_anomaly``: whether the sample's time lies in a logged interval, ends included.

    An equi-join by hour against the merged intervals; no range join and no repeated samples.
    """
    hours = intervals_by_hour(log)
    keyed = samples.withColumn("_hour", F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz"))
    inside = F.exists("_parts", lambda p: F.col(ts).between(p["_s"], p["_e"]))
    return (
        lookup(keyed, hours, "_hour", "left")
        .withColumn("is_anomaly", F.coalesce(inside, F.lit(False)))
        .drop("_hour", "_parts")
    )


def evaluate(df: DataFrame, keys: Sequence[str] = ("detector",), flag: str = "flagged", truth: str = "is_anomaly") -> DataFrame:
    """Confusion counts, precision, recall and F1 of each detector."""
    f, t = F.col(flag), F.col(truth)
    counts = df.groupBy(*keys).agg(
        F.count_if(f & t).alias("tp"),
        F.count_if(f & ~t).alias("fp"),
        F.count_if(~f & t).alias("fn"),
        F.count_if(~f & ~t).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys, "tp", "fp", "fn", "tn",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def compare_detectors(results: Mapping[str, DataFrame], log: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Confusion counts, precision, recall and F1 of each named result (ts, flag) against the logged intervals.

    A row that a detector could not judge (null flag) counts as not flagged.
    """
    calls = [
        found.select(F.lit(name).alias("detector"), "ts", F.coalesce(F.col(flag), F.lit(False)).alias("flagged"))
        for name, found in results.items()
    ]
    return evaluate(label_intervals(reduce(DataFrame.unionByName, calls), log))


# --- alarms against logged intervals, as events ----------------------------------------------


def alarms(flags: DataFrame, max_gap: str = "1 hour", keys: Sequence[str] = ("detector",), flag: str = "flagged", bin_: str = "hour") -> DataFrame:
    """(keys, start_ts, end_ts, n): runs of flagged times that lie no further apart than ``max_gap``.

    Runs are found within bins of time (``bin_``, a unit of ``date_trunc``, no shorter than the gap) and joined across them by the first
    and last run of each bin, so no task orders all times of a detector.  Rows of one time count once each in ``n``.
    """
    keys = list(keys)
    gap = F.expr(f"interval {max_gap}")
    times = flags.filter(F.col(flag) & F.col("ts").isNotNull()).groupBy(*keys, "ts").agg(F.count("*").alias("n"))
    times = times.withColumn("_bin", F.date_trunc(bin_, "ts").cast("timestamp_ntz"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("ts")
    new = F.coalesce(F.col("ts") > F.lag("ts").over(inside) + gap, F.lit(True)).cast("int")
    runs = times.withColumn("_new", new).withColumn("_run", F.sum("_new").over(inside))
    runs = store(runs.groupBy(*keys, "_bin", "_run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sum("n").alias("n")))
    ends = runs.groupBy(*keys, "_bin").agg(F.max("_run").alias("_last"))
    marked = runs.join(ends, [*keys, "_bin"])
    outer = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    # At most two runs of each bin.
    order = Window.partitionBy(*keys).orderBy("start_ts")
    apart = F.coalesce(F.col("start_ts") > F.lag("end_ts").over(order) + gap, F.lit(True)) | (F.col("_run") > 1)
    border = marked.filter(outer).withColumn("_chain", F.sum(apart.cast("int")).over(order))
    joined = border.groupBy(*keys, "_chain").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n"))
    columns = [*keys, "start_ts", "end_ts", "n"]
    return marked.filter(~outer).select(*columns).union(joined.select(*columns))


def _length_class(start: Column, end: Column) -> Column:
    """The power of two that the length of an interval in microseconds does not exceed."""
    return F.ceil(F.log2(F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp")) + F.lit(1.0))).cast("int")


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (both with start_ts, end_ts and ``keys``) whose closed intervals meet; columns of ``b`` get the prefix ``b_``.

    An interval lies in at most two bins as long as itself.  A pair meets in the bins of its longer interval, so each interval is
    repeated at most twice per length that occurs (a power of two), however long it or its partner is.  Intervals that end before they
    start meet nothing.
    """
    keys = list(keys)
    tagged = []
    for df in (a, b):
        right = df.filter(F.col("start_ts") <= F.col("end_ts"))
        tagged.append(right.withColumn("_own", _length_class(F.col("start_ts"), F.col("end_ts"))))
    classes = sorted({r["_own"] for df in tagged for r in df.select("_own").distinct().collect()})  # 64 at most
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sides = []
    for df in tagged:
        size = F.pow(F.lit(2.0), F.col("_class")).cast("bigint")
        placed = df.withColumn("_class", F.explode(F.filter(F.array(*[F.lit(c) for c in classes]).cast("array<int>"), lambda c: c >= F.col("_own"))))
        sides.append(placed.withColumn("_bin", F.explode(F.sequence(F.floor(micros("start_ts") / size), F.floor(micros("end_ts") / size)))))
    names = {c: f"b_{c}" for c in sides[1].columns if c not in (*keys, "_class", "_bin")}
    both = sides[0].join(sides[1].withColumnsRenamed(names), [*keys, "_class", "_bin"])
    size = F.pow(F.lit(2.0), F.col("_class")).cast("bigint")
    first = F.greatest(micros("start_ts"), micros("b_start_ts"))
    meet = (F.col("start_ts") <= F.col("b_end_ts")) & (F.col("b_start_ts") <= F.col("end_ts"))
    once = (F.floor(first / size) == F.col("_bin")) & (F.greatest("_own", "b__own") == F.col("_class"))
    return both.filter(meet & once).drop("_class", "_bin", "_own", "b__own")


def found_intervals(found: DataFrame, log: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Every logged interval for every detector, with ``found``, the alarms that meet it, and the seconds until the first of them begins.

    ``found`` are ``alarms`` by detector.  An alarm that runs already when the interval begins has a delay of 0.
    """
    each = store(log.withColumn("_id", F.monotonically_increasing_id()))
    met = overlaps(found.select("detector", "start_ts", "end_ts"), each.select("_id", "start_ts", "end_ts"))
    delay = interval_seconds(F.col("b_start_ts"), F.greatest("start_ts", "b_start_ts"))
    per = met.groupBy("detector", F.col("b__id").alias("_id")).agg(F.count("*").alias("alarms"), F.min(delay).alias("delay_seconds"))
    names = F.explode(F.array(*[F.lit(d) for d in detectors])).alias("detector")
    every = each.select("*", names).join(per, ["detector", "_id"], "left")
    return every.withColumn("found", F.col("alarms").isNotNull()).withColumn("alarms", F.coalesce("alarms", F.lit(0))).drop("_id")


def judged_alarms(found: DataFrame, log: DataFrame) -> DataFrame:
    """The alarms with ``is_true``: whether they meet a logged interval."""
    each = store(found.withColumn("_id", F.monotonically_increasing_id()))
    met = overlaps(each, log.select("start_ts", "end_ts")).select("_id").distinct().withColumn("_met", F.lit(True))
    return each.join(met, "_id", "left").withColumn("is_true", F.coalesce("_met", F.lit(False))).drop("_id", "_met")
