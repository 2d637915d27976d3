"""All queries of the core with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import roles
from ..functions import text as X
from ..operators import communities, context, graph, insight, rationale, report, scanning, search
from ..operators.store import GraphStore
from ..session import materialise, shared_dir
from ..sources import code
from ..sources import text as S
from ..sources.tables import table
from ..streaming import ingest
from . import references, wider

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {**references.QUERIES}
SQL: dict[str, str] = {**references.SQL}


def _q(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_PAIRS = "select distinct from_path as src, to_path as dst from edge_imports where from_path is not null and to_path is not null and from_path <> '' and to_path <> ''"
_CPAIRS = "select distinct from_id as src, to_id as dst from edge_calls where from_id is not null and to_id is not null and from_id <> '' and to_id <> ''"
_LIVE = f"live as (select p.src, p.dst from ({_PAIRS}) p where p.src in (select path from file_node) and p.dst in (select path from file_node))"
_CLIVE = f"clive as (select p.src, p.dst from ({_CPAIRS}) p where p.src in (select id from function_node) and p.dst in (select id from function_node))"


def _imports(s: SparkSession, d: str) -> DataFrame:
    return graph.live(graph.pairs(table(s, d, "edge_imports"), "from_path", "to_path"), table(s, d, "file_node"), "path")


def _calls(s: SparkSession, d: str) -> DataFrame:
    return graph.live(graph.pairs(table(s, d, "edge_calls"), "from_id", "to_id"), table(s, d, "function_node"), "id")


def _store(s: SparkSession, d: str) -> GraphStore:
    return GraphStore.open(s, d, ["file", "function", "edge_calls", "edge_imports"])


# ---------------------------------------------------------------- storage primitives

_q("q_find_nodes", "select path, lang, role from file_node where layer = 'application' and (path like '%service%' or lang like '%script%')")(
    lambda s, d: _store(s, d).find_nodes("File", {"layer": "application"}, {"path": "service", "lang": "script"}, ["path", "lang", "role"])
)
_q("q_node_keys_matching", "select path as key, role as value from file_node where role in ('router', 'schema', 'model')")(lambda s, d: _store(s, d).node_keys_matching("File", "role", ["router", "schema", "model"]))
_q("q_find_neighbors", "select a.path as src_path, a.role as src_role, b.path as dst_path, b.layer as dst_layer, e.symbol as edge_symbol, e.kind as edge_kind from edge_imports e join file_node a on a.path = e.from_path join file_node b on b.path = e.to_path where b.layer = 'infra'")(
    lambda s, d: _store(s, d).find_neighbors("IMPORTS", None, {"layer": "infra"}, ["path", "role"], ["path", "layer"], ["symbol", "kind"])
)
_q("q_without_incoming", "select id, name, file_path from function_node n where not exists (select 1 from edge_calls e where e.to_id = n.id) and substr(name, 1, 4) <> 'load' and file_path like '%src/%'")(
    lambda s, d: _store(s, d).find_nodes_without_incoming("Function", "CALLS", {"file_path": "src/"}, "load", ["id", "name", "file_path"])
)

_q("q_purge_files", "select id, name, file_path from function_node where file_path not in (select node_key from purge_log where node_table = 'file_node' and node_key is not null)")(
    lambda s, d: _store(s, d).purge_file_data(table(s, d, "purge_log").where("node_table = 'file_node'").select(F.col("node_key").alias("path")).where("path is not null")).node("Function").select("id", "name", "file_path")
)
_q("q_graph_stats", "select 'file_node' as \"table\", count(*) as n from file_node union all select 'function_node', count(*) from function_node union all select 'edge_calls', count(*) from edge_calls union all select 'edge_imports', count(*) from edge_imports union all select 'findings', count(*) from findings")(
    lambda s, d: insight.graph_stats({t: table(s, d, t) for t in ("file_node", "function_node", "edge_calls", "edge_imports", "findings")})
)

# ---------------------------------------------------------------- graph

_q(
    "q_reach_imports",
    f"with {_LIVE}, h1 as (select f.path as start, l.dst as node from file_node f join live l on l.src = f.path where f.role = 'router'), h2 as (select distinct h.start, l.dst as node from h1 h join live l on l.src = h.node), h3 as (select distinct h.start, l.dst as node from h2 h join live l on l.src = h.node) select start, node, min(depth)::int as depth from (select start, node, 1 as depth from h1 union all select start, node, 2 from h2 union all select start, node, 3 from h3) group by all",
)(lambda s, d: graph.reach(_imports(s, d), table(s, d, "file_node").where("role = 'router'").select("path"), 3))
_q(
    "q_import_distance",
    f"with {_LIVE}, a0 as (select path as node, 0 as depth, path as origin from file_node where role = 'job'), b1 as (select dst as node, 1 as depth, min(origin) as origin from a0 join live on src = node group by dst), a1 as (select * from a0 union all select * from b1 where node not in (select node from a0)), b2 as (select dst as node, 2 as depth, min(origin) as origin from a1 join live on src = node where depth = 1 group by dst), a2 as (select * from a1 union all select * from b2 where node not in (select node from a1)), b3 as (select dst as node, 3 as depth, min(origin) as origin from a2 join live on src = node where depth = 2 group by dst) select * from a2 union all select * from b3 where node not in (select node from a2)",
)(lambda s, d: graph.distances(_imports(s, d), table(s, d, "file_node").where("role = 'job'").select("path"), 3))
_q(
    "q_importers",
    "select from_path as src, to_path as dst, case min(case coalesce(kind, '') when 'reexport' then 0 when 'dynamic' then 2 else 1 end) when 0 then 'reexport' when 2 then 'dynamic' else '' end as kind, false as local from edge_imports where from_path is not null and to_path is not null and from_path <> '' and to_path <> '' group by 1, 2",
)(lambda s, d: graph.importers(table(s, d, "edge_imports")))
_q("q_import_cycles", f"with recursive {_LIVE}, r(a, b) as (select src, dst from live union select r.a, l.dst from r join live l on l.src = r.b), c as (select x.a as node, min(x.b) as component from r x join r y on y.a = x.b and y.b = x.a group by x.a) select component, count(*) as n_files, list(node order by node) as members from c group by component")(lambda s, d: graph.cycles(_imports(s, d)))
_q("q_components", f"with recursive {_LIVE}, e as (select src as a, dst as b from live union select dst, src from live union select path, path from file_node), r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b) select a as node, min(b) as component from r group by a")(
    lambda s, d: graph.components(_imports(s, d), table(s, d, "file_node").select("path"))
)
_ENTRY = ", ".join(f"'{n}'" for n in graph.ENTRY_NAMES)
_q("q_dead_code", f"select id, name, file_path, start_line, end_line from function_node f where coalesce(name, '') not in ({_ENTRY}) and not starts_with(coalesce(name, ''), '_') and not exists (select 1 from edge_calls e where e.to_id = f.id)")(
    lambda s, d: graph.dead_code(table(s, d, "function_node"), table(s, d, "edge_calls")).select("id", "name", "file_path", "start_line", "end_line")
)
_q("q_degrees", f"with {_LIVE}, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from live where src <> dst) select node, count(*) as degree from (select a as node from u union all select b from u) group by node")(lambda s, d: graph.degrees(_imports(s, d)))
_q(
    "q_hubs",
    f"with {_LIVE}, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from live where src <> dst), g as (select node, count(*) as degree from (select a as node from u union all select b from u) group by node), r as (select degree, row_number() over (order by degree) - 1 as i, count(*) over () as n from g), t as (select min(degree) as at from r where i >= least(n - 1, floor(0.99 * n))) select g.node, g.degree from g, t where g.degree >= greatest(10, t.at)",
)(lambda s, d: graph.hubs(graph.degrees(_imports(s, d))))


def _file_graph(s: SparkSession, d: str) -> DataFrame:
    return graph.file_graph(table(s, d, "file_node"), table(s, d, "edge_imports"), table(s, d, "function_node"), table(s, d, "edge_calls"))


_FG = """keep as (select distinct path from file_node where coalesce(role, 'other') <> 'test'),
i as (select least(from_path, to_path) as a, greatest(from_path, to_path) as b, count(*) as n_imports from edge_imports where from_path <> to_path and from_path in (select path from keep) and to_path in (select path from keep) group by 1, 2),
c as (select least(x.file_path, y.file_path) as a, greatest(x.file_path, y.file_path) as b, count(*) as n_calls from edge_calls e join function_node x on x.id = e.from_id join function_node y on y.id = e.to_id where x.file_path <> y.file_path and x.file_path in (select path from keep) and y.file_path in (select path from keep) group by 1, 2),
fg as (select coalesce(i.a, c.a) as a, coalesce(i.b, c.b) as b, coalesce(n_imports, 0) as n_imports, coalesce(n_calls, 0) as n_calls from i full join c on i.a = c.a and i.b = c.b)"""
_q("q_file_graph", f"with {_FG} select a, b, n_imports, n_calls, round(case when n_imports > 0 then 1.0 else 0.0 end + case when n_calls > 0 then 0.5 * log2(n_calls + 1) else 0.0 end, 6) as weight from fg")(_file_graph)


def _detected(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Names of files, and by their numbers the links without hubs, members and hubs, each computed once."""
    names, links = graph.numbered_links(table(s, d, "file_node"), table(s, d, "edge_imports"), table(s, d, "function_node"), table(s, d, "edge_calls"))
    return names, *communities.detect_numbered(materialise(links, "links"))


@_q("q_communities")
def _communities(s: SparkSession, d: str) -> DataFrame:
    """Communities of files."""
    names, links, m, _ = _detected(s, d)
    found = communities.describe(links, m, names.select(F.col("id").alias("node"), F.col("node").alias("path")))
    return found.join(communities.labels(names, m), "community").select(F.col("least").alias("community"), *[c for c in found.columns if c != "community"])


@_q("q_community_members")
def _members(s: SparkSession, d: str) -> DataFrame:
    """The community of every file, hubs without one."""
    names, _, m, hub = _detected(s, d)
    out = names.join(m.withColumnRenamed("node", "id"), "id").join(communities.labels(names, m), "community").select("node", F.col("least").alias("community"), "is_hub")
    return out.unionByName(names.join(hub.withColumnRenamed("node", "id"), "id").select("node", F.lit(None).cast("string").alias("community"), F.lit(True).alias("is_hub")))


_q("q_callers", f"with {_CLIVE} select c.dst as id, f.name, f.file_path, count(*) as n_callers, count(distinct g.file_path) as n_files from clive c join function_node f on f.id = c.dst join function_node g on g.id = c.src group by 1, 2, 3")(lambda s, d: insight.callers(table(s, d, "function_node"), table(s, d, "edge_calls")))
_q(
    "q_call_resolution",
    f"with {_CLIVE}, n as (select name, count(*) as same_name from function_node group by name) select c.src as from_id, c.dst as to_id, n.same_name, case when n.same_name = 1 or f.file_path = g.file_path then 'resolved' when n.same_name <= 3 then 'name' else 'ambiguous' end as resolution from clive c join function_node f on f.id = c.dst join n on n.name = f.name join function_node g on g.id = c.src",
)(lambda s, d: insight.resolution(table(s, d, "function_node"), table(s, d, "edge_calls")))

# ---------------------------------------------------------------- overviews

_q(
    "q_hotspots",
    """with ch as (select file_path as path, count(*) as commits, max(created_at) as last_modified from (select distinct id, file_path, created_at from findings) group by 1),
de as (select to_path as path, count(*) as importers from edge_imports where to_path is not null and to_path <> '' group by 1),
t as (select ln(1 + (select max(commits) from ch)) as mc, ln(1 + (select max(importers) from de)) as mi)
select ch.path, ch.commits, ch.last_modified, coalesce(de.importers, 0) as importers,
  round((100.0 * (0.45 * case when t.mc > 0 then ln(1 + ch.commits) / t.mc else 0 end + 0.35 * case when t.mi > 0 and de.importers > 0 then ln(1 + de.importers) / t.mi else 0 end
  + 0.20 * case when coalesce(ch.last_modified, 0) > 0 then 1.0 / (1.0 + greatest(0.0, (1751328000.0 - ch.last_modified) / 86400.0) / 30.0) else 0 end))::decimal(28,9), 2)::double as score
from ch left join de on de.path = ch.path cross join t""",
)(lambda s, d: _hotspots(s, d))


def _hotspots(s: SparkSession, d: str) -> DataFrame:
    """Change risk with findings as the change events of this data, at a fixed clock."""
    ch = table(s, d, "findings").select("id", "file_path", "created_at").distinct().groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("commits"), F.max("created_at").alias("last_modified"))
    return insight.hotspots(ch, insight.in_degree(table(s, d, "edge_imports")), 1751328000.0)


_q("q_import_in_degree", "select to_path as path, count(*) as importers from edge_imports where to_path is not null and to_path <> '' group by 1")(lambda s, d: insight.in_degree(table(s, d, "edge_imports")))
_BAD = "success = 0"
_q("q_call_stats", f"select tool, count(*) as calls, count(case when {_BAD} then 1 end) as errors, round(avg(latency_ms)::decimal(28,9), 2)::double as avg_ms, round(min(latency_ms)::decimal(28,9), 2)::double as min_ms, round(max(latency_ms)::decimal(28,9), 2)::double as max_ms, sum(result_size)::double as bytes from (select distinct id, tool, success, case when not isnan(latency_ms) then latency_ms end as latency_ms, result_size from call_log) group by tool")(
    lambda s, d: insight.call_stats(table(s, d, "call_log")).withColumn("bytes", F.col("bytes").cast("double"))
)
_q("q_calls_by_origin", "select tool, coalesce(origin, 'unknown') as origin, count(*) as calls from (select distinct id, tool, origin from call_log) group by 1, 2")(lambda s, d: insight.calls_by_origin(table(s, d, "call_log")))
_q("q_error_rate", f"select count(*) as calls, count(case when {_BAD} then 1 end) as errors, printf('%.1f%%', 100.0 * count(case when {_BAD} then 1 end) / count(*)) as rate from (select distinct id, success from call_log)")(lambda s, d: insight.error_rate(table(s, d, "call_log")))
_DAY = "cast(make_timestamp(cast(floor(\"timestamp\") * 1000000 as bigint)) as date)"
_q("q_call_history", f"select {_DAY} as day, count(*) as calls, count(case when {_BAD} then 1 end) as errors from (select distinct id, \"timestamp\", success from call_log) group by 1")(lambda s, d: insight.call_history(table(s, d, "call_log")))
_q("q_top_tools", f"select day, tool, calls, rank::int as rank from (select *, row_number() over (partition by day order by calls desc, tool nulls last) as rank from (select {_DAY} as day, tool, count(*) as calls from (select distinct id, \"timestamp\", tool from call_log) group by 1, 2)) where rank <= 3")(lambda s, d: insight.top_tools(table(s, d, "call_log")))
_q("q_architecture", "with f as (select coalesce(layer, 'other') as layer, coalesce(role, 'other') as role, path from file_node), r as (select *, row_number() over (partition by layer, role order by path) as rn, count(*) over (partition by layer, role) as n_files from f) select layer, role, n_files, list(path order by path) as files from r where rn <= 10 group by 1, 2, 3")(lambda s, d: insight.architecture(table(s, d, "file_node")))
_q("q_domain_map", "with f as (select coalesce(layer, 'other') as layer, coalesce(role, 'other') as role, path from file_node where contains(lower(path), 'session')), r as (select *, row_number() over (partition by layer, role order by path) as rn, count(*) over (partition by layer, role) as n_files from f) select layer, role, n_files, list(path order by path) as files from r where rn <= 8 group by 1, 2, 3")(lambda s, d: insight.domain_map(table(s, d, "file_node"), "session"))
_q("q_layer_matrix", f"with p as ({_PAIRS}) select coalesce(a.layer, 'other') as src_layer, coalesce(b.layer, 'other') as dst_layer, count(*) as n_links from p join file_node a on a.path = p.src join file_node b on b.path = p.dst group by 1, 2")(lambda s, d: insight.layer_matrix(table(s, d, "file_node"), table(s, d, "edge_imports")))
_q("q_language_counts", "select coalesce(lang, 'unknown') as lang, count(*) as n_files from file_node group by 1")(lambda s, d: insight.language_counts(table(s, d, "file_node")))
_q(
    "q_file_summary",
    f"""with {_LIVE}, {_CLIVE},
fn as (select file_path as path, count(*) as n_functions, count(case when trim(coalesce(docstring, ''), ' ') <> '' then 1 end) as n_documented from function_node group by 1),
o as (select src as path, count(*) as n from live group by 1), i as (select dst as path, count(*) as n from live group by 1),
c as (select a.file_path as x, b.file_path as y from clive join function_node a on a.id = src join function_node b on b.id = dst where a.file_path <> b.file_path),
co as (select x as path, count(*) as n from c group by 1), ci as (select y as path, count(*) as n from c group by 1)
select f.path, f.lang, f.role, f.layer, coalesce(n_functions, 0) as n_functions, coalesce(n_documented, 0) as n_documented, coalesce(o.n, 0) as n_imports, coalesce(i.n, 0) as n_importers, coalesce(co.n, 0) as n_calls_out, coalesce(ci.n, 0) as n_calls_in
from file_node f left join fn using (path) left join o using (path) left join i using (path) left join co using (path) left join ci using (path)""",
)(lambda s, d: insight.file_summary(table(s, d, "file_node"), table(s, d, "function_node"), table(s, d, "edge_imports"), table(s, d, "edge_calls")))
_q("q_untested", "select path, role, layer from file_node f where coalesce(role, '') not in ('test', 'doc') and not exists (select 1 from edge_imports e join file_node t on t.path = e.from_path and t.role = 'test' where e.to_path = f.path and e.to_path <> '')")(lambda s, d: insight.untested(table(s, d, "file_node"), table(s, d, "edge_imports")))
_q(
    "q_tests_of",
    f"""with {_CLIVE}, t as (select path from file_node where role = 'test'),
i as (select distinct to_path as path, from_path as test, 'import' as how from edge_imports where from_path in (select path from t) and to_path is not null and to_path <> ''),
c as (select distinct b.file_path as path, a.file_path as test, 'call' as how from clive join function_node a on a.id = src join function_node b on b.id = dst where a.file_path in (select path from t) and a.file_path <> b.file_path)
select path, test, max(how) as how from (select * from i union all select * from c) group by 1, 2""",
)(lambda s, d: insight.tests_of(table(s, d, "file_node"), table(s, d, "edge_imports"), table(s, d, "function_node"), table(s, d, "edge_calls")))

# ---------------------------------------------------------------- search and ranking

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_BM25 = (
    "with w as (select id as doc, list_concat("
    + _WORDS.format("trim(regexp_replace(regexp_replace(coalesce(name, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_.]', ' ', 'g'))")
    + ", "
    + _WORDS.format("coalesce(docstring, '')")
    + ") as ws from function_node), x as (select doc, len(ws) as doc_len, unnest(ws) as term from w), p as (select doc, doc_len, term, count(*) as tf from x group by all), st as (select count(*) as n, avg(doc_len) as al from (select distinct doc, doc_len from p)), "
    "q as (select distinct role as query, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) as term from (values ('q1', 'merge session'), ('q2', 'oldest lease'), ('q3', 'temporary row readers'), ('q4', 'batch')) as v(role, t)), "
    "d as (select term, count(*) as df from p group by 1), "
    "s as (select q.query, p.doc, sum(greatest(ln((st.n - d.df + 0.5) / (d.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.doc_len / st.al))) as score, count(*) as n_terms from q join p using (term) join d using (term) cross join st group by 1, 2) "
    "select query, doc, round(score, 6) as score from s join (select query, count(*) as need from q group by 1) using (query) where n_terms = need"
)


def _text_queries(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("q1", "merge session"), ("q2", "oldest lease"), ("q3", "temporary row readers"), ("q4", "batch")], "query string, text string")


def _bm25(s: SparkSession, d: str) -> DataFrame:
    posts = search.postings(table(s, d, "function_node"), "id", X.tokenize_identifier("name"), F.col("docstring"))
    q = _text_queries(s).select("query", F.explode(X.words("text")).alias("term"))
    return search.bm25(posts, q).select("query", "doc", F.round("score", 6).alias("score"))


_q("q_bm25_symbols", _BM25)(_bm25)

_q(
    "q_substring",
    "select v.q as query, m.path as doc, length(v.w) / length(m.t)::double as score from (select path, lower(concat_ws(' ', title, body)) as t from memory_entries) m, (values ('s1', 'until somebody'), ('s2', 'resolver')) as v(q, w) where contains(m.t, v.w)",
)(lambda s, d: search.substring_hits(table(s, d, "memory_entries"), "path", F.concat_ws(" ", "title", "body"), s.createDataFrame([("s1", "until somebody"), ("s2", "resolver")], "query string, text string")))
_q(
    "q_nearest",
    "with q as (select vec_id as query, embedding as a from embeddings where vec_id % 50 = 0), s as (select q.query, e.vec_id as doc, round(list_cosine_similarity(q.a::double[], e.embedding::double[]), 9) as score from q, embeddings e where e.vec_id <> q.query), r as (select *, row_number() over (partition by query order by score desc, doc) - 1 as rank from s) select query, doc, round(score, 6) as score, rank::int as rank from r where rank < 10",
)(lambda s, d: search.nearest(table(s, d, "embeddings"), "vec_id", "embedding", table(s, d, "embeddings").where("vec_id % 50 = 0")).select("query", "doc", F.round("score", 6).alias("score"), "rank"))
_q("q_semantic_symbols")(lambda s, d: _semantic(s, d))


def _semantic(s: SparkSession, d: str) -> DataFrame:
    """Hashed vectors of symbols, the four text queries against all of them."""
    f = table(s, d, "function_node").select("id", F.concat_ws(" ", "name", "docstring").alias("t"))
    q = _text_queries(s).select(F.col("query").alias("id"), F.col("text").alias("t"))
    v = f.unionByName(q).select("id", search.embed(X.embed_tokens("t"), X.char_ngrams("t")).alias("v"))
    return search.nearest(v, "id", "v", v.where(F.col("id").isin("q1", "q2", "q3", "q4")), 15)



# ---------------------------------------------------------------- documents and code

_MD = "select doc_id::varchar as path, replace(text, chr(13), '') as body from documents"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", "\r", "").alias("body"))


_q(
    "q_md_sections",
    f"""with l as (select path, unnest(string_split(body, chr(10))) as t, unnest(generate_series(1, len(string_split(body, chr(10))))) as line from ({_MD})),
o as (select *, sum(case when regexp_matches(t, '^ {{0,3}}(```|~~~)') then 1 else 0 end) over (partition by path order by line) % 2 as op, max(line) over (partition by path) as last from l),
h as (select path, line as start_line, last, length(regexp_extract(t, '^ {{0,3}}(#{{1,6}})', 1)) as level, trim(regexp_replace(t, '^ {{0,3}}#{{1,6}}[ \\t]+|[ \\t]+#+[ \\t]*$', '', 'g')) as title from o where op = 0 and not regexp_matches(t, '^ {{0,3}}(```|~~~)') and regexp_matches(t, '^ {{0,3}}#{{1,6}}[ \\t]+\\S'))
select a.path, a.start_line, coalesce((select min(b.start_line) - 1 from h b where b.path = a.path and b.start_line > a.start_line and b.level <= a.level), a.last) as end_line, a.level::int as level, a.title from h a""",
)(lambda s, d: S.sections(_docs(s, d)).select("path", "start_line", "end_line", "level", "title"))
_q("q_code_mentions", "select distinct doc_id::varchar as path, unnest(regexp_extract_all(text, '`([A-Za-z_][\\w.]*)(?:\\([^`\\n]*\\))?`', 1)) as name from documents")(lambda s, d: S.code_mentions(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))))
_q(
    "q_pattern_search",
    "with l as (select path, unnest(string_split(replace(body, chr(13), ''), chr(10))) as text, unnest(generate_series(1, len(string_split(replace(body, chr(13), ''), chr(10))))) as line from memory_entries) select path, line, text from l where regexp_matches(text, 'port \\d+', 'i')",
)(lambda s, d: scanning.line_matches(table(s, d, "memory_entries").select("path", F.regexp_replace("body", "\r", "").alias("body")), r"port \d+"))


def _files(s: SparkSession, d: str) -> DataFrame:
    """Paths with their content."""
    return table(s, d, "file_node").select("path", "git_blob_sha").join(table(s, d, "source_blob").select("git_blob_sha", "body"), "git_blob_sha").select("path", "body")


def _defs(s: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Definitions of all files, or of those a condition names; each blob is parsed once."""
    return code.definitions(table(s, d, "file_node").where(where).select("path", "git_blob_sha"), table(s, d, "source_blob"))


# The graph names the first function of a one-line bundle only.  The SQL reads the others of such a line from the text itself.
_q(
    "q_parse_functions",
    r"""with l as (select f.path, unnest(string_split(b.body, 'function')) as t, unnest(generate_series(1, len(string_split(b.body, 'function')))) as i from file_node f join source_blob b using (git_blob_sha) where regexp_matches(f.path, '\.(js|ts)$')),
n as (select *, sum(length(t) - length(replace(t, chr(10), ''))) over (partition by path order by i rows between unbounded preceding and 1 preceding) + 1 as line, regexp_extract(t, '^\s+[A-Za-z_$][\w$]*\s*\([^)]*\)\s*\{[^{}]*\}') as m from l),
m as (select path, line, regexp_extract(m, '^\s+([A-Za-z_$][\w$]*)', 1) as name, length(m) - length(replace(m, chr(10), '')) as more from n where i > 1 and m <> '')
select id, name, file_path, start_line, end_line from function_node where start_line < end_line
union select path || '::' || name, name, path, line::bigint, (line + more)::bigint from m""",
)(lambda s, d: code.functions(_defs(s, d)).select("id", "name", "file_path", "start_line", "end_line"))
_q("q_parse_definitions")(lambda s, d: _defs(s, d).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")))
_q("q_sql_tables", "select f.path, regexp_extract(b.body, 'create table (\\w+)', 1) as name from file_node f join source_blob b using (git_blob_sha) where f.path like '%.sql' and regexp_matches(b.body, 'create table \\w+')")(
    lambda s, d: _defs(s, d, "path like '%.sql'").where("kind = 'sql_table'").select("path", "name")
)
_q("q_tf_variables", "select f.path, regexp_extract(b.body, 'variable \"(\\w+)\"', 1) as name from file_node f join source_blob b using (git_blob_sha) where f.path like '%.tf' and regexp_matches(b.body, 'variable \"\\w+\"')")(
    lambda s, d: _defs(s, d, "path like '%.tf'").where("kind = 'tf_variable'").select("path", "name")
)
_q("q_config_sections")(lambda s, d: S.config_sections(_files(s, d)))
_q("q_html_text")(lambda s, d: S.pages(table(s, d, "documents").where("source = 'fetched_page'").select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("html"))))

# ---------------------------------------------------------------- findings

_LAST = "f as (select distinct id, file_path, scanner, key, severity, created_at from findings), m as (select file_path, scanner, max(created_at) as created_at from f group by 1, 2), cur as (select f.* from f join m using (file_path, scanner, created_at))"
_q("q_latest_findings", f"with {_LAST} select id, file_path, scanner, key from cur")(lambda s, d: scanning.latest_findings(table(s, d, "findings")).select("id", "file_path", "scanner", "key"))
_q(
    "q_egress",
    "select file_path, reason = '' as allowed, reason from (select file_path, case when max((lower(severity) = 'block')::int) = 1 then 'block' when max(starts_with(coalesce(key, ''), 'classification.confidential')::int) = 1 then 'confidential' when max(starts_with(coalesce(key, ''), 'pii.')::int) = 1 then 'pii' else '' end as reason from findings group by 1)",
)(lambda s, d: scanning.egress(table(s, d, "findings")))
_q("q_scan_texts")(lambda s, d: scanning.scan(table(s, d, "memory_entries").unionByName(table(s, d, "plan_entries"), allowMissingColumns=True).select("path", "body"), "path", "body"))
_q("q_redact_texts")(lambda s, d: scanning.redact(table(s, d, "plan_entries").select("path", "body"), "body"))

# ---------------------------------------------------------------- streaming


def _stream_counters(s: SparkSession, d: str) -> DataFrame:
    import uuid

    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    path = f"{d}/call_log.parquet"
    schema = s.read.parquet(path).schema
    return ingest.to_table(ingest.daily_counters(ingest.call_stream(s, path, schema)), f"{base}/out", f"{base}/state")


_q("q_stream_counters", f"select {_DAY} as day, tool, count(*) as calls, count(case when {_BAD} then 1 end) as errors from (select distinct id, \"timestamp\", tool, success from call_log) group by 1, 2")(_stream_counters)

# ---------------------------------------------------------------- compositions

_q("q_context_for_task")(lambda s, d: context.for_task(_text_queries(s), table(s, d, "function_node"), table(s, d, "edge_calls"), table(s, d, "memory_entries"), table(s, d, "plan_entries")))
_q(
    "q_callees",
    f"with {_CLIVE}, a as (select id from function_node where file_path in (select path from file_node where role = 'router')), h1 as (select a.id as start, c.dst as node from a join clive c on c.src = a.id), h2 as (select distinct h.start, c.dst as node from h1 h join clive c on c.src = h.node) select start, node, min(depth)::int as depth from (select start, node, 1 as depth from h1 union all select start, node, 2 from h2) group by 1, 2",
)(lambda s, d: graph.reach(_calls(s, d), table(s, d, "function_node").join(table(s, d, "file_node").where("role = 'router'").select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id"), 2))
_q(
    "q_calls_without_import",
    f"""with {_CLIVE}, c as (select a.file_path as src, b.file_path as dst, count(*) as n_calls from clive join function_node a on a.id = src join function_node b on b.id = dst where a.file_path <> b.file_path group by 1, 2)
select src, dst, n_calls from c where not exists (select 1 from edge_imports e where e.from_path = c.src and e.to_path = c.dst)""",
)(lambda s, d: insight.calls_without_import(table(s, d, "function_node"), table(s, d, "edge_calls"), table(s, d, "edge_imports")))
_q(
    "q_layer_inversions",
    f"with p as ({_PAIRS}), m as (select coalesce(a.layer, 'other') as src_layer, coalesce(b.layer, 'other') as dst_layer, count(*) as n_links from p join file_node a on a.path = p.src join file_node b on b.path = p.dst group by 1, 2) select * from m where (src_layer = 'domain' and dst_layer in ('application', 'presentation')) or (src_layer = 'application' and dst_layer = 'presentation') or (src_layer = 'infra' and dst_layer = 'presentation')",
)(lambda s, d: insight.layer_inversions(table(s, d, "file_node"), table(s, d, "edge_imports")))
_q("q_rationale")(lambda s, d: rationale.with_symbol(rationale.comment_blocks(_files(s, d)), table(s, d, "function_node")))
@_q("q_bridges")
def _bridges(s: SparkSession, d: str) -> DataFrame:
    """Files that link several communities."""
    names, links, m, _ = _detected(s, d)
    return names.join(communities.bridges(links, m).withColumnRenamed("node", "id"), "id").select("node", "n_communities")


_q(
    "q_usefulness",
    "select f.path, (exists (select 1 from function_node n where n.file_path = f.path))::int as defines, coalesce(f.role, '') = 'test' as is_test, case when coalesce(d.n, 0) > 0 then length(ltrim(bin(d.n), '0')) else 0 end::int as bits, f.mtime from file_node f left join (select to_path, count(*) as n from edge_imports where to_path is not null and to_path <> '' group by 1) d on d.to_path = f.path",
)(lambda s, d: insight.usefulness(table(s, d, "file_node"), table(s, d, "function_node"), table(s, d, "edge_imports")))
_q("q_fresh_chunks", "select url, chunk_no, fetched_at from fetched_chunks where fetched_at > 1748736000.0 - 720 * 3600.0")(lambda s, d: context.fresh(table(s, d, "fetched_chunks"), 1748736000.0, 720.0).select("url", "chunk_no", "fetched_at"))
_q("q_architecture_report")(lambda s, d: report.architecture_report(table(s, d, "file_node"), table(s, d, "edge_imports"), table(s, d, "function_node"), table(s, d, "edge_calls")))

QUERIES.update(wider.QUERIES)
SQL.update(wider.SQL)
