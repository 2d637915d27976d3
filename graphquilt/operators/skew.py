"""Hot keys: find them with a pre-aggregate, then spread only those over salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one SHARE-th of all rows, so there are fewer than SHARE hot keys whatever the size.
SHARE = 64
SALTS = 32


def hot_keys(df: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Keys of more than ``1/share`` of the non-null rows: fewer than ``share`` rows by pigeonhole.

    The count is combined map-side; a hot key shuffles one row per partition.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") * F.lit(share) > counts.agg(F.sum("_n")).scalar()).select(key)


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = SALTS, how: str = "left", hot: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """``left`` joined with ``right`` (unique by ``key``), hot keys of ``left`` spread by ``spread``.

    Only the fewer than ``SHARE`` hot keys are broadcast (a proven bound) and
    only their rows in ``right`` are replicated ``salts`` times.  Null keys match
    nothing and are spread as well.  ``right`` must not share other column names.
    ``hot`` passes hot keys that are known already.  ``merge`` asks for both sides
    sorted and merged; else the join is left to adaptive execution, which takes a
    small ``right`` by broadcast.
    """
    keys = hot_keys(left, key) if hot is None else hot.select(F.col(hot.columns[0]).alias(key))
    marked = F.broadcast(keys.withColumn("_hot", F.lit(1)))
    lo = left.join(marked, key, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    ro = right.join(marked, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return lo.join(ro.hint("merge") if merge else ro, [key, "_salt"], how).drop("_salt")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: DataFrame | None = None) -> DataFrame:
    """The inner join, hot keys of ``left`` spread; ``right`` need not be unique, its rows of hot keys are replicated."""
    return salted_left_join(left, right, key, spread, how="inner", hot=hot)


def salted_semi_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: DataFrame | None = None) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``, hot keys spread."""
    return salted_left_join(left, right.select(key).distinct(), key, spread, how="left_semi", hot=hot)
