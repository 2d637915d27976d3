"""Query and SQL of the dangling references (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import references as R
from ..sources.tables import table

_TABLES = ("edge_calls", "edge_imports", "function_node", "file_node", "purge_log")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(*[table(s, d, t) for t in _TABLES])


QUERIES = {"p7_found": lambda s, d: R.found(_resolved(s, d)), "p7_report": lambda s, d: R.report(_resolved(s, d))}

_REFS = """
with refs as (
  select 'edge_calls' as edge_table, 'from_id' as field, from_id as ref_key, from_id as from_key, coalesce(to_id, '') as to_key, seen_at, 'function_node' as node_table from edge_calls
  union all select 'edge_calls', 'to_id', to_id, from_id, coalesce(to_id, ''), seen_at, 'function_node' from edge_calls
  union all select 'edge_imports', 'to_path', to_path, from_path, coalesce(to_path, ''), seen_at, 'file_node' from edge_imports
),
folded as (
  select edge_table, field, ref_key, from_key, to_key, node_table, strftime(seen_at at time zone 'UTC', '%Y-%m') as month, count(*) as n_rows, min(seen_at) as first_seen
  from refs where ref_key is not null and ref_key <> '' group by all
),
nodes as (
  select 'function_node' as node_table, id as node_key, list(distinct indexed_at) as indexed, max(indexed_at) as last_indexed from function_node group by id
  union all select 'file_node', path, list(distinct indexed_at), max(indexed_at) from file_node group by path
),
gone as (select node_table, node_key, list(distinct purged_at) as purged, max(purged_at) as last_purged from purge_log group by all),
judged as (
  select f.*, case when n.node_key is null then 'missing'
                   when g.last_purged is not null and (n.last_indexed is null or g.last_purged > n.last_indexed) then 'deleted'
                   when f.first_seen is not null and n.last_indexed is not null and not coalesce(
                     list_max(list_filter(n.indexed, lambda t: t <= f.first_seen)) >= list_max(list_filter(g.purged, lambda t: t <= f.first_seen)),
                     list_max(list_filter(n.indexed, lambda t: t <= f.first_seen)) is not null) then 'late' else 'live' end as status
  from folded f left join nodes n on n.node_table = f.node_table and n.node_key = f.ref_key
  left join gone g on g.node_table = f.node_table and g.node_key = f.ref_key
)
"""

SQL = {
    "p7_found": _REFS + "select distinct edge_table, field, coalesce(from_key, '') as from_key, to_key from judged where status in ('missing', 'deleted')",
    "p7_report": _REFS + "select edge_table, field, month, status, count(*) as n_refs, cast(sum(n_rows) as bigint) as n_rows from judged group by all",
}
