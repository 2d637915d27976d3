"""Filling containers of fixed capacity with texts (problem 8).

Variable-capacity best-fit, solved on the histogram of sizes: a size is an
integer up to the capacity, so the histogram, the open bins by remaining space
and the resulting plan are bounded by the capacity whatever the number of
documents.  Sizes are placed from the largest down into the tightest open bins;
where none fits, a bin of the permitted capacity of least cost is opened, and at
the end every bin shrinks to the smallest permitted capacity that holds its
contents.

The cost of a capacity is what a bin of it is expected to leave unused, which
hangs on what the other capacities do with the sizes still to come.  So all of them
are optimised jointly: a plan is computed for every choice of capacities that may
be opened (``joint``), with the cost rule among those of the choice, and the plan
with the least total of unused space after shrinking stands.  With one permitted
capacity (the project's case) there is one choice and it is plain best-fit
decreasing, item by item.  Documents take their place by their rank within their
size, found by a distributed sort.

Defined results: a text beyond the largest capacity is cut into full containers
and a rest; nothing else is cut; a null or empty text has size 0 and stands at
the end of a container; rows with the same doc_id and text count once; a null
doc_id is a document; no documents give no containers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import rank_within, sort_once
from ..session import importable, materialise
from .tokens import VOCABULARY, counted

CAPACITY = 2048

_PLAN = T.StructType(
    [
        T.StructField("size", T.LongType()),
        T.StructField("rank_from", T.LongType()),
        T.StructField("rank_to", T.LongType()),
        T.StructField("bin_from", T.LongType()),
        T.StructField("per_bin", T.LongType()),
        T.StructField("slot", T.LongType()),
        T.StructField("used", T.LongType()),
        T.StructField("capacity", T.LongType()),
    ]
)


def open_size(size: int, capacities: list[int], smaller: list[int]) -> int:
    """The permitted capacity of least unavoidable waste for bins opened with ``size``: what is left after as many of it as fit and the best smaller size still to come."""
    best, cost = capacities[-1], None
    for c in capacities:
        if c < size:
            continue
        rest = c % size
        i = bisect_left(smaller, rest + 1)
        fill = smaller[i - 1] if i else 0
        k = ((rest - fill) / c, -c)
        if cost is None or k < cost:
            best, cost = c, k
    return best


#: All choices of capacities are tried up to this many permitted ones; beyond, choices grow one capacity at a time.
MOST_JOINT = 6


def joint(histogram: dict[int, int], capacities: list[int]) -> tuple[list[tuple], list[tuple]]:
    """The plan of least unused space over the choices of capacities that may be opened; the largest is always among them."""
    caps = sorted(set(capacities))
    most, rest = caps[-1], caps[:-1]

    def cost(choice: tuple[int, ...]) -> tuple:
        placed, bins = plan(histogram, [*choice, most], caps)
        return sum((hi - lo) * (cap - used) for lo, hi, cap, used, _ in bins), sum(hi - lo for lo, hi, *_ in bins), choice, placed, bins

    if len(rest) <= MOST_JOINT:
        best = min((cost(c) for k in range(len(rest) + 1) for c in combinations(rest, k)), key=lambda x: x[:3])
    else:
        best = cost(())
        while True:
            more = [cost(tuple(sorted({*best[2], c}))) for c in rest if c not in best[2]]
            nxt = min(more, key=lambda x: x[:3], default=best)
            if nxt[:2] >= best[:2]:
                break
            best = nxt
    return best[3], best[4]


def plan(histogram: dict[int, int], capacities: list[int], shrink_to: list[int] | None = None) -> tuple[list[tuple], list[tuple]]:
    """(placements, bins): rows of ``_PLAN`` and (bin_from, bin_to, capacity, used, slots).

    Bins of ``capacities`` are opened, and shrink to the least of ``shrink_to`` at the
    end.  Bins with the same contents are one range, so this runs over distinct sizes.
    """
    caps = sorted(capacities)
    ends = sorted(shrink_to or capacities)
    sizes = sorted(s for s in histogram if s > 0)
    placed: list[tuple] = []
    # remaining space -> stack of (bin_from, bin_to, slots, used, capacity)
    open_bins: dict[int, list[tuple[int, int, int, int, int]]] = {}
    spaces: list[int] = []
    made = 0

    def put(space: int, group: tuple[int, int, int, int, int]) -> None:
        if group[0] >= group[1]:
            return
        if space not in open_bins:
            open_bins[space] = []
            insort(spaces, space)
        open_bins[space].append(group)

    for k in range(len(sizes) - 1, -1, -1):
        s, n, rank = sizes[k], histogram[sizes[k]], 0
        while n:
            i = bisect_left(spaces, s)
            if i < len(spaces):
                space = spaces[i]
                lo, hi, slots, used, cap = open_bins[space].pop()
                if not open_bins[space]:
                    del open_bins[space]
                    spaces.pop(i)
            else:
                cap = open_size(s, caps, sizes[:k])
                fit = cap // s
                need = -(-n // fit)
                lo, hi, slots, used, space = made, made + need, 0, 0, cap
                made += need
            fit = space // s
            full = min(hi - lo, n // fit)
            if full:
                placed.append((s, rank, rank + full * fit, lo, fit, slots, used))
                put(space - fit * s, (lo, lo + full, slots + fit, used + fit * s, cap))
                rank, n, lo = rank + full * fit, n - full * fit, lo + full
            if n and lo < hi and n < fit:
                placed.append((s, rank, rank + n, lo, n, slots, used))
                put(space - n * s, (lo, lo + 1, slots + n, used + n * s, cap))
                rank, n, lo = rank + n, 0, lo + 1
            put(space, (lo, hi, slots, used, cap))
    bins = [(lo, hi, next(c for c in ends if c >= used), used, slots) for groups in open_bins.values() for lo, hi, slots, used, _ in groups]
    return placed, sorted(bins)


def with_capacity(placed: list[tuple], bins: list[tuple]) -> list[tuple]:
    """Placements cut at the borders of the final bin ranges, each with the capacity its bins end up with."""
    starts = [b[0] for b in bins]
    out = []
    for size, r0, r1, b0, per, slot, used in placed:
        at = b0
        while r0 < r1:
            lo, hi, cap, _, _ = bins[bisect_right(starts, at) - 1]
            take = min(r1 - r0, (hi - at) * per)
            out.append((size, r0, r0 + take, at, per, slot, used, cap))
            r0, at = r0 + take, hi
    return out


def items(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """``doc_id, piece, size``: whole documents, or full pieces and a rest of the oversized; sizes are tokens, or ``size`` of the text."""
    d = documents.select("doc_id", "text").distinct()
    # written once: the sampling of the sort below would count every text a second time
    c = materialise(counted(d, ["doc_id"], vocabulary) if size is None else d.select("doc_id", F.coalesce(size, F.lit(0)).cast("long").alias("n_tokens")), "counted")
    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity)
    x = c.withColumn("_full", full)
    return x.select("doc_id", F.col("n_tokens"), F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_full")), lambda i: F.when(i < F.col("_full"), F.lit(capacity).cast("long")).otherwise(F.col("n_tokens") - F.col("_full") * capacity))).alias("piece", "size"))


def pack(documents: DataFrame, capacities: list[int] | int = CAPACITY, vocabulary: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """One row per document piece: ``doc_id, piece, n_tokens, container, capacity, position, token_offset``."""
    spark = documents.sparkSession
    importable(spark)
    caps = sorted([capacities] if isinstance(capacities, int) else set(capacities))
    it = items(documents, caps[-1], vocabulary, size)
    s = sort_once(it.select("size", "doc_id", "piece", F.xxhash64("doc_id", "piece").alias("tie")), ["size"], ["doc_id", "piece", "tie"], "packing")
    histogram = {r["size"]: r["n"] for r in s.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    placed, bins = joint(histogram, caps)
    r = rank_within(s, ["size"])
    # the plan is bounded by the capacity (distinct sizes and remainders), not by the documents
    p = F.broadcast(spark.createDataFrame(with_capacity(placed, bins), _PLAN))
    sized = r.where("size > 0").join(p, (r["size"] == p["size"]) & (r["rank"] >= p["rank_from"]) & (r["rank"] < p["rank_to"])).select(
        r["doc_id"],
        r["piece"],
        r["size"].alias("n_tokens"),
        (p["bin_from"] + F.floor((r["rank"] - p["rank_from"]) / p["per_bin"])).alias("container"),
        p["capacity"],
        (p["slot"] + (r["rank"] - p["rank_from"]) % p["per_bin"]).alias("position"),
        (p["used"] + ((r["rank"] - p["rank_from"]) % p["per_bin"]) * r["size"]).alias("token_offset"),
    )
    # texts without tokens are dealt over the largest range of equal bins
    lo, hi, cap, used, slots = max(bins, key=lambda x: x[1] - x[0], default=(0, 1, caps[0], 0, 0))
    none = r.where("size = 0").select(
        "doc_id",
        "piece",
        F.col("size").alias("n_tokens"),
        (F.lit(lo) + F.col("rank") % (hi - lo)).alias("container"),
        F.lit(cap).cast("long").alias("capacity"),
        (F.lit(slots) + F.floor(F.col("rank") / (hi - lo))).alias("position"),
        F.lit(used).cast("long").alias("token_offset"),
    )
    return sized.unionByName(none)


def fill(packed: DataFrame) -> DataFrame:
    """Containers, tokens and unused space by capacity."""
    per = packed.groupBy("container", "capacity").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_docs"))
    return per.groupBy("capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.sum(F.col("capacity") - F.col("used")).alias("unused"), F.max("n_docs").alias("most_docs"))
