"""Drawing sources to target weights (problem 9).

Budgets go down a tree (``domain/language/source`` paths; a plain source is a
leaf under the root): a node shares its amount among its children by weight, a
child that can take less than its share leaves the shortage to its siblings, and
only what they cannot take goes up to its ancestors.  Each leaf then takes whole
epochs of all its documents and, of one more epoch, the longest prefix in a
seeded order that fits its rest.

The prefix needs no sort: tokens are summed by the leading bits of the seeded
hash, the bucket in which the budget ends is found on that small table, and only
that bucket's documents are ordered.

Defined results: documents of a null or unlisted source and those without tokens
are not drawn; a listed source without documents gives its weight to its
siblings; repeated target rows add their weights and take the larger repeat; null
or non-positive weights and repeats below 1 draw nothing; rows with the same
doc_id and text count once.  Without ``total`` the largest amount is drawn at
which every source with documents reaches its weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import importable, materialise
from .tokens import VOCABULARY, counted

SEED = 17
BITS = 14
#: The target table is refused beyond this; it lists sources, not documents.
MOST_SOURCES = 100_000


class Node:
    """A node of the budget tree; leaves have a capacity."""

    def __init__(self, name: str) -> None:
        self.name, self.weight, self.capacity, self.children, self.given = name, 0.0, 0.0, {}, 0.0

    def room(self) -> float:
        return sum(c.room() for c in self.children.values()) if self.children else self.capacity - self.given

    def give(self, amount: float) -> float:
        """Shares ``amount`` among the children; returns what could not be placed."""
        if not self.children:
            take = min(amount, self.capacity - self.given)
            self.given += take
            return amount - take
        left = amount
        live = [c for c in self.children.values() if c.weight > 0]
        while left > 1e-9 and (live := [c for c in live if c.room() > 1e-9]):
            total, back = sum(c.weight for c in live), 0.0
            for c in live:
                back += c.give(left * c.weight / total)
            if back >= left - 1e-9:
                break
            left = back
        return left

    def leaves(self):
        if not self.children:
            yield self
        for c in self.children.values():
            yield from c.leaves()


def tree(targets: list[tuple[str, float]], capacity: dict[str, float]) -> Node:
    """The tree of ``a/b/c`` source paths; an inner weight is the sum of its leaves'."""
    root = Node("")
    for source, weight in targets:
        if not weight or weight <= 0 or math.isnan(weight):
            continue
        at = root
        at.weight += weight
        parts = source.split("/")
        for i, part in enumerate(parts):
            at = at.children.setdefault(part, Node("/".join(parts[: i + 1])))
            at.weight += weight
        at.capacity = capacity.get(source, 0.0)
    return root


def budgets(targets: list[tuple[str, float]], capacity: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Tokens of each source."""
    root = tree(targets, capacity)
    if total is None:
        live = {s: w for s, w in targets if w and w > 0 and capacity.get(s, 0) > 0}
        if not live:
            return {}
        # each live leaf's share once empty leaves have given theirs away
        probe = tree(targets, {s: (1e18 if s in live else 0.0) for s, _ in targets})
        probe.give(1.0)
        total = min(capacity[x.name] / x.given for x in probe.leaves() if x.given > 0)
    root.give(total)
    return {x.name: x.given for x in root.leaves()}


def draw(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, vocabulary: str = VOCABULARY, size: Column | None = None, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(drawn documents with ``repeats``, shares per source).

    Sizes are tokens, or ``size`` of the text; ``order`` (a long column over doc_id and
    n_tokens, spread over all longs) replaces the seeded order of the last epoch.
    """
    spark = documents.sparkSession
    importable(spark)
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("the table of targets is too long to be one")
    listed = spark.createDataFrame([(r["source"],) for r in rows], "source string")
    d = documents.select("doc_id", "source", "text").join(F.broadcast(listed), "source").distinct()
    # counted once: a filter ahead of the write would be pushed below and count again
    n = counted(d, ["doc_id", "source"], vocabulary) if size is None else d.select("doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("n_tokens"))
    d = materialise(n, "mixing").where("n_tokens > 0")
    have = {r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per listed source
    cap = {r["source"]: float(have.get(r["source"], 0) * max(0, r["max_repeat"] or 0)) for r in rows}
    want = budgets([(r["source"], r["weight"]) for r in rows], cap, total)
    plan = []
    for r in rows:
        s, n = r["source"], have.get(r["source"], 0)
        b = want.get(s, 0.0)
        full = min(int((b + 1e-6) // n), r["max_repeat"] or 0) if n else 0
        plan.append((s, float(r["weight"] or 0.0), r["max_repeat"], int(n), float(b), full, int(b + 1e-6) - full * n if n else 0))
    p = F.broadcast(spark.createDataFrame(plan, "source string, weight double, max_repeat int, available long, budget double, full int, rest long"))
    h = F.xxhash64(F.lit(seed), F.col("full"), "doc_id", "n_tokens") if order is None else order
    x = d.join(p, "source").withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - BITS))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = x.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")).withColumn("upto", F.sum("n").over(w))
    # one row per source: the first bucket that no longer fits whole
    edge = sums.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select("source", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))
    x = x.join(F.broadcast(edge), "source", "left")
    within = Window.partitionBy("source").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = x.where(F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))).withColumn("extra", F.when(F.col("rest") > 0, 1).otherwise(0))
    on_edge = x.where(F.col("bucket") == F.col("edge")).withColumn("_run", F.sum("n_tokens").over(within)).withColumn("extra", (F.col("before") + F.col("_run") <= F.col("rest")).cast("int")).drop("_run")
    beyond = x.where(F.col("bucket") > F.col("edge")).withColumn("extra", F.lit(0))
    y = inside.unionByName(on_edge).unionByName(beyond)
    drawn = y.select("doc_id", "source", "n_tokens", (F.col("full") + F.col("extra")).alias("repeats")).where("repeats > 0")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    all_w = sum(r[1] for r in plan if r[1] > 0) or 1.0
    shares = p.join(got, "source", "left").select("source", (F.col("weight") / all_w).alias("target_share"), "max_repeat", "available", "budget", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    shares = shares.withColumn("_t", shares.agg(F.sum("drawn_tokens")).scalar()).withColumn("share", F.when(F.col("_t") > 0, F.col("drawn_tokens") / F.col("_t")).otherwise(0.0)).drop("_t")
    return drawn, shares
