"""Dangling references (problem 7): which keys of an edge lead to no live record.

References and parent keys are shuffled by the same key and sorted, then one
linear merge of both streams (a sort-merge join) puts each reference beside the
validity interval of its parent.  The interval tells the cases apart:

* ``missing``  no parent row has exactly this key;
* ``deleted``  every parent row was purged after it was last indexed;
* ``late``     the parent is live at the end, but was not yet (or not again) when the edge
  was first seen;
* ``live``     otherwise.

A parent that was purged and indexed again has several intervals; each begins with
an indexing and ends with the next purge, and an edge seen between two is late.

Defined results: a null or empty key is no reference and yields no row; a null
``to`` end is written ``''``; repeated edges count once per distinct pair in
``found`` and once per stored row in ``report``; a null ``seen_at`` reports under
month ``None`` and is never late; extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import salted_left_join

#: (edge table, field, from column, to column, node table, key column of the node)
FIELDS = (
    ("edge_calls", "from_id", "from_id", "to_id", "function_node", "id"),
    ("edge_calls", "to_id", "from_id", "to_id", "function_node", "id"),
    ("edge_imports", "to_path", "from_path", "to_path", "file_node", "path"),
)


def parent_intervals(nodes: DataFrame, key: str, purges: DataFrame, node_table: str) -> DataFrame:
    """One row per parent key with the times at which it was indexed and purged; there are as many as it has rows, distinct."""
    seen = nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("ref_key")).agg(F.collect_set("indexed_at").alias("indexed"))
    gone = purges.where((F.col("node_table") == node_table) & F.col("node_key").isNotNull()).groupBy(F.col("node_key").alias("ref_key")).agg(F.collect_set("purged_at").alias("purged"))
    return seen.join(gone, "ref_key", "left").withColumn("known", F.lit(True))


def references(edges: DataFrame, edge_table: str) -> DataFrame:
    """Edges as references, repeated ones already folded: one row per field, pair and month."""
    mine = [f for f in FIELDS if f[0] == edge_table]
    a, b = mine[0][2], mine[0][3]
    base = edges.groupBy(F.col(a).alias("from_key"), F.coalesce(F.col(b), F.lit("")).alias("to_key"), F.date_format("seen_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("seen_at").alias("first_seen"))
    fields = F.array(*[F.struct(F.lit(f[1]).alias("field"), F.lit(f[4]).alias("node_table"), F.col("from_key" if f[1] == f[2] else "to_key").alias("ref_key")) for f in mine])
    return base.withColumn("r", F.explode(fields)).select(F.lit(edge_table).alias("edge_table"), "r.field", "r.node_table", "r.ref_key", "from_key", "to_key", "month", "n_rows", "first_seen").where(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))


def resolve(edge_calls: DataFrame, edge_imports: DataFrame, function_node: DataFrame, file_node: DataFrame, purge_log: DataFrame) -> DataFrame:
    """Every reference with its ``status``; both edge tables go through one merge per node table."""
    out = []
    for edges, name, nodes, node_table, key in ((edge_calls, "edge_calls", function_node, "function_node", "id"), (edge_imports, "edge_imports", file_node, "file_node", "path")):
        refs = references(edges, name).drop("node_table")
        parents = parent_intervals(nodes, key, purge_log, node_table)
        out.append(salted_left_join(refs, parents, "ref_key", F.concat_ws("\x00", "from_key", "to_key"), merge=True))
    last = lambda c, upto=None: F.array_max(F.col(c) if upto is None else F.filter(c, lambda t: t <= F.col(upto)))
    purged = last("purged").isNotNull() & (last("indexed").isNull() | (last("purged") > last("indexed")))
    # alive when first seen: an indexing up to then, and no purge after the last of them
    begun, ended = last("indexed", "first_seen"), last("purged", "first_seen")
    alive = F.coalesce(begun >= ended, begun.isNotNull())
    late = F.col("first_seen").isNotNull() & last("indexed").isNotNull() & ~alive
    status = F.when(F.col("known").isNull(), "missing").when(purged, "deleted").when(late, "late").otherwise("live")
    return out[0].unionByName(out[1]).withColumn("status", status).drop("indexed", "purged", "known")


def found(resolved: DataFrame) -> DataFrame:
    """Distinct dangling references at the end of the data."""
    return resolved.where(F.col("status").isin("missing", "deleted")).select("edge_table", "field", F.coalesce("from_key", F.lit("")).alias("from_key"), "to_key").distinct()


def report(resolved: DataFrame) -> DataFrame:
    """References per edge table, field, month and status, with distinct pairs and stored rows."""
    return resolved.groupBy("edge_table", "field", "month", "status").agg(F.count(F.lit(1)).alias("n_refs"), F.sum("n_rows").alias("n_rows"))
