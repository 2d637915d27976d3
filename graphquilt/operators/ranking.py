"""Ranks within groups by one distributed sort and per-partition counts.

No group is ever collected into one task: rows are range-partitioned by (group,
order, tie), sorted inside their partitions and written once to the shared
folder; a running row number per partition (``_mid``) then turns, with one small
table of counts per (partition, group), into the exact rank within the group.
That table has at most partitions + groups rows, since a sorted group spans
neighbouring partitions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def sort_once(df: DataFrame, group: list[str], order: list[str], label: str, partitions: int | None = None) -> DataFrame:
    """``df`` sorted by group and order, with ``_mid`` (partition and row number within), computed exactly once."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    return materialise(s.withColumn("_mid", F.monotonically_increasing_id()), label)


def offsets(ordered: DataFrame, group: list[str]) -> DataFrame:
    """Per (group, partition): first ``_mid``, ``n_here``, ``before`` (rows of the group in earlier partitions), ``n_group``."""
    pid = F.shiftright(F.col("_mid"), _SHIFT).alias("_pid")
    c = ordered.groupBy(*group, pid).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("n_here"))
    w = Window.partitionBy(*group)
    run = w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("before", F.sum("n_here").over(run) - F.col("n_here")).withColumn("n_group", F.sum("n_here").over(w))


#: Counts (rows of groups and partitions) sent to every task up to this many; beyond, they are joined.
MOST_COUNTS = 500_000


def rank_within(ordered: DataFrame, group: list[str]) -> DataFrame:
    """``ordered`` with ``rank`` (from 0) and ``n_group``; one hash join with the small table of counts.

    The counts are written and counted first: while few they go to every task, so the
    sorted rows stay where they are; beyond ``MOST_COUNTS`` both sides are shuffled.
    """
    o = materialise(offsets(ordered, group), "counts")
    o = F.broadcast(o) if o.count() <= MOST_COUNTS else o
    d = ordered.withColumn("_pid", F.shiftright(F.col("_mid"), _SHIFT))
    j = d.join(o, _same(d, o, [*group, "_pid"]))
    return j.select(*[d[c] for c in ordered.columns if c != "_mid"], (d["_mid"] - o["_first"] + o["before"]).alias("rank"), o["n_group"])


def at_ranks(ordered: DataFrame, group: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of ``ordered`` at given ranks.

    ``wanted`` has the group columns, a ``rank`` and whatever shall be carried
    along; only its rows' ``_mid`` meet the sorted data (a join Spark broadcasts
    while it is small).
    """
    o = offsets(ordered, group)
    hit = wanted.join(o, _same(wanted, o, group) & (wanted["rank"] >= o["before"]) & (wanted["rank"] < o["before"] + o["n_here"]))
    target = hit.select(*[wanted[c] for c in wanted.columns], (o["_first"] + wanted["rank"] - o["before"]).alias("_mid"))
    return target.join(ordered.drop(*group), "_mid").drop("_mid")
