"""Exact and mergeable percentiles per group (problem 2).

Exact: one distributed sort of all values by (metric, group, value) with
per-partition counts; offsets locate the target positions of each group, and the
two neighbouring order statistics are interpolated.  The error bound is 0 beyond
the rounding of one double operation; longs beyond 2^53 keep their exact order
statistics.

Mergeable: per partition, day and tool a table of counts by logarithmic bucket.
Summaries of any parts are merged by adding counts, and a percentile read from
the merged table is within ``ALPHA`` (relative) of the exact order statistic.

Defined results: rows delivered twice, unchanged, count once; null and NaN values
are left out and counted; zero, negative and infinite values are values; a null
tool is a group of its own; a null timestamp belongs to day null; a group without
values has no rows; position of percentile p among n values is (n - 1) * p,
interpolated linearly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import rank_within, sort_once

PERCENTILES = (0.5, 0.9, 0.95, 0.99, 0.999)
ALPHA = 0.01


def values(call_log: DataFrame) -> DataFrame:
    """Long form: ``metric, tool, day, v, exact, tie``; ``exact`` is the long value of result_size."""
    day = F.to_date(F.timestamp_seconds("timestamp"))
    c = call_log.select("id", "tool", "timestamp", "latency_ms", "result_size").distinct()
    rows = F.array(
        F.struct(F.lit("latency_ms").alias("metric"), F.col("latency_ms").alias("v"), F.lit(None).cast("long").alias("exact")),
        F.struct(F.lit("result_size").alias("metric"), F.col("result_size").cast("double").alias("v"), F.col("result_size").alias("exact")),
    )
    x = c.select("tool", day.alias("day"), F.xxhash64("id", "timestamp").alias("tie"), F.explode(rows).alias("r")).select("r.metric", "tool", "day", "r.v", "r.exact", "tie")
    return x.where(F.col("v").isNotNull() & ~F.isnan("v"))


def exact(vals: DataFrame, by: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``metric, *by, p, n, lower_stat, upper_stat, lower_exact, upper_exact, value`` of every group."""
    group = ["metric", *by]
    s = sort_once(vals.select(*group, "v", "exact", "tie"), group, ["v", "exact", "tie"], "percentiles")
    # the table of counts gives every row its rank as it is read; the few at a wanted position go on, the sorted rows are never shuffled again
    r = rank_within(s, group).withColumnRenamed("n_group", "n")
    at = F.transform(F.array(*[F.lit(float(p)) for p in percentiles]), lambda p: F.struct(p.alias("p"), ((F.col("n") - 1) * p).alias("pos")))
    hit = F.filter(at, lambda x: (F.col("rank") == F.floor(x["pos"])) | (F.col("rank") == F.ceil(x["pos"])))
    got = r.withColumn("_hit", hit).where(F.size("_hit") > 0).select(*group, "n", "rank", "v", "exact", F.explode("_hit").alias("h")).select(*group, "n", "rank", "v", "exact", "h.p", "h.pos", F.floor("h.pos").alias("lo"))
    # one or two rows per (group, p)
    out = got.groupBy(*group, "n", "p", "pos", "lo").agg(
        F.min(F.struct("rank", "v", "exact")).alias("a"),
        F.max(F.struct("rank", "v", "exact")).alias("b"),
    )
    frac = F.col("pos") - F.col("lo")
    spread = F.coalesce((F.col("b.exact") - F.col("a.exact")).cast("double"), F.col("b.v") - F.col("a.v"))
    value = F.when(F.col("a.v") == F.col("b.v"), F.col("a.v")).otherwise(F.col("a.v") + spread * frac)
    return out.select(*group, "p", "n", F.col("a.v").alias("lower_stat"), F.col("b.v").alias("upper_stat"), F.col("a.exact").alias("lower_exact"), F.col("b.exact").alias("upper_exact"), value.alias("value"))


def report(call_log: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Exact percentiles per tool (``level`` = 'tool', day null) and per tool and day (``level`` = 'day')."""
    v = values(call_log)
    per_tool = exact(v, ["tool"], percentiles).withColumn("level", F.lit("tool")).withColumn("day", F.lit(None).cast("date"))
    per_day = exact(v, ["tool", "day"], percentiles).withColumn("level", F.lit("day"))
    return per_tool.unionByName(per_day)


def _bucket(v: Column, alpha: float) -> Column:
    """Signed logarithmic bucket: zero is 0, |v| < 1e-9 counts as zero."""
    gamma = (1 + alpha) / (1 - alpha)
    k = F.ceil(F.log(F.abs(v)) / F.lit(math.log(gamma))).cast("long") + F.lit(100_000)
    return F.when(F.abs(v) < 1e-9, F.lit(0).cast("long")).when(v > 0, k).otherwise(-k)


def summary(vals: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """Mergeable counts per (metric, group, bucket); infinite values sit in the outermost buckets."""
    return vals.groupBy("metric", *by, _bucket(F.when(F.abs("v") == float("inf"), F.signum("v") * 1.7e308).otherwise(F.col("v")), alpha).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of several parts or days as one of the coarser group ``by``."""
    return summaries.groupBy("metric", *by, "bucket").agg(F.sum("n").alias("n"))


def estimate(merged: DataFrame, by: list[str], percentiles: tuple[float, ...] = PERCENTILES, alpha: float = ALPHA) -> DataFrame:
    """Percentiles of a merged summary: ``value`` within ``alpha`` of the order statistic at floor((n - 1) * p).

    The window runs over buckets (some thousand per group at most), not values.
    """
    group = ["metric", *by]
    gamma = (1 + alpha) / (1 - alpha)
    w = Window.partitionBy(*group)
    c = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    t = c.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    pos = F.floor((F.col("total") - 1) * F.col("p"))
    mid = F.pow(F.lit(gamma), F.abs("bucket") - 100_000) * F.lit(2 / (gamma + 1))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.signum(F.col("bucket").cast("double")) * mid)
    return t.where((pos >= F.col("upto") - F.col("n")) & (pos < F.col("upto"))).select(*group, "p", F.col("total").alias("n"), value.alias("value"), F.lit(alpha).alias("relative_error"))
