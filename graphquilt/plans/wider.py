"""More queries with their SQL: search cascades, change impact, linking, endpoints, notes, histories.

Where the given tables lack an input of an operator (verdicts, commits, call
sites), the query derives one from them, in Spark and in SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import roles
from ..functions import text as X
from ..operators import endpoints, graph, insight, knowledge, linking, report, search, upkeep
from ..operators import terraform as TF
from ..operators.store import GraphStore
from ..sources import code
from ..sources import text as S
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = 1751328000.0


def _q(name: str, sql: str | None, f: Query) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


# ---------------------------------------------------------------- search cascades

ASKED = [("q1", "merge session"), ("q2", "oldest lease"), ("q3", "temporary row readers"), ("q4", "batch"), ("q5", "kwzqx lease")]
_ASKED = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in ASKED) + ") as v(query, t)"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_SPLIT = "trim(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_.]', ' ', 'g'))"


def asked(s: SparkSession) -> DataFrame:
    return s.createDataFrame(ASKED, "query string, text string")


def cascade_sql(docs: str, limit: int = 15) -> str:
    """The search cascade over ``docs`` (doc, nm, bd): ranks of words and substrings fused, then word by word, then by key."""
    pool = max(4 * limit, 40)
    empty = "[]::varchar[]"
    return f"""with d as ({docs}), w as (select doc, list_concat(coalesce({_WORDS.format('nm')}, {empty}), coalesce({_WORDS.format('bd')}, {empty})) as ws from d),
x as (select doc, len(ws) as doc_len, unnest(ws) as term from w), p as (select doc, doc_len, term, count(*) as tf from x group by all),
st as (select count(*) as n, avg(doc_len) as al from (select distinct doc, doc_len from p)), asked as (select query, t from {_ASKED}),
q as (select distinct query, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) as term from asked),
df as (select term, count(*) as df from p group by 1),
sc as (select q.query, p.doc, round(sum(greatest(ln((st.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.doc_len / st.al))), 9) as score, count(*) as n_terms from q join p using (term) join df using (term) cross join st group by 1, 2),
strict as (select query, doc, row_number() over (partition by query order by score desc, doc) - 1 as rank from sc join (select query, count(*) as need from q group by 1) using (query) where n_terms = need),
full_text as (select doc, lower(concat_ws(' ', nm, bd)) as t from d),
sub as (select a.query, f.doc, row_number() over (partition by a.query order by length(a.t)::double / length(f.t) desc, f.doc) - 1 as rank from full_text f, asked a where length(a.t) >= 3 and contains(f.t, lower(a.t))),
fused as (select query, doc, round(sum(1.0 / (60 + rank)), 12) as score, 1 as tier from (select * from strict where rank < {pool} union all select * from sub where rank < {pool}) group by 1, 2),
loose as (select query, doc, score, 2 as tier from sc where query not in (select query from fused)),
keyed as (select a.query, d.doc, length(a.t)::double / length(d.doc) as score, 3 as tier from d, asked a where length(a.t) >= 3 and contains(lower(d.doc), lower(a.t)) and a.query not in (select query from fused) and a.query not in (select query from loose)),
r as (select *, row_number() over (partition by query order by score desc, doc) - 1 as rank from (select * from fused union all select * from loose union all select * from keyed))
select query, doc, tier::int as tier, rank::int as rank, round(score, 6) as score from r where rank < {limit}"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query", "doc", F.col("tier").cast("int").alias("tier"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


_q("q_search_symbols", cascade_sql(f"select id as doc, {_SPLIT.format('name')} as nm, docstring as bd from function_node"), lambda s, d: _shown(search.search(table(s, d, "function_node").select("id", "name", "docstring"), "id", X.tokenize_identifier("name"), F.col("docstring"), asked(s))))
_q("q_memory_search", cascade_sql("select path as doc, title as nm, body as bd from memory_entries"), lambda s, d: _shown(search.search(table(s, d, "memory_entries").select("path", "title", "body"), "path", F.col("title"), F.col("body"), asked(s))))
_q("q_plan_search", cascade_sql("select path as doc, title as nm, body as bd from plan_entries"), lambda s, d: _shown(search.search(table(s, d, "plan_entries").select("path", "title", "body"), "path", F.col("title"), F.col("body"), asked(s))))


def fetched(s: SparkSession, d: str) -> DataFrame:
    """Every distinct text stored under a (url, chunk_no), the digest of its title and text in the key."""
    variant = F.md5(F.concat_ws("\x01", F.coalesce("title", F.lit("\x02")), F.coalesce("text", F.lit("\x02"))))
    return table(s, d, "fetched_chunks").select(F.concat_ws("#", "url", "chunk_no", variant).alias("key"), "title", "text").distinct()


_q(
    "q_search_fetched",
    cascade_sql("select distinct concat_ws('#', url, chunk_no, md5(concat_ws(chr(1), coalesce(title, chr(2)), coalesce(text, chr(2))))) as doc, title as nm, text as bd from fetched_chunks"),
    lambda s, d: _shown(search.search(fetched(s, d), "key", F.col("title"), F.col("text"), asked(s))),
)


def _headings(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", "\r", "").alias("body"))
    return S.sections(x).select(F.concat_ws("#", "path", "start_line").alias("key"), "title").distinct()


_HEADINGS = """with l as (select path, unnest(string_split(body, chr(10))) as t, unnest(generate_series(1, len(string_split(body, chr(10))))) as line from (select doc_id::varchar as path, replace(text, chr(13), '') as body from documents)),
o as (select *, sum(case when regexp_matches(t, '^ {0,3}(```|~~~)') then 1 else 0 end) over (partition by path order by line) % 2 as op from l)
select distinct concat_ws('#', path, line) as doc, trim(regexp_replace(t, '^ {0,3}#{1,6}[ \\t]+|[ \\t]+#+[ \\t]*$', '', 'g')) as nm, null::varchar as bd from o where op = 0 and not regexp_matches(t, '^ {0,3}(```|~~~)') and regexp_matches(t, '^ {0,3}#{1,6}[ \\t]+\\S')"""
_q("q_search_docs", cascade_sql(_HEADINGS), lambda s, d: _shown(search.search(_headings(s, d), "key", F.col("title"), F.lit(None).cast("string"), asked(s))))

# ---------------------------------------------------------------- change impact

_CPAIRS = "select distinct from_id as src, to_id as dst from edge_calls where from_id is not null and to_id is not null and from_id <> '' and to_id <> ''"
_CLIVE = f"clive as (select p.src, p.dst from ({_CPAIRS}) p where p.src in (select id from function_node) and p.dst in (select id from function_node))"


def impact_ctes(starts: str, depth: int, inner: int = 6) -> str:
    """Hops over importers, each with ``inner`` steps through files that re-export; the last CTE is ``impact``."""
    out = [
        f"starts as ({starts})",
        "imp as (select from_path as by_file, to_path as file, min(case coalesce(kind, '') when 'reexport' then 0 when 'dynamic' then 2 else 1 end) as r from edge_imports where from_path is not null and to_path is not null and from_path <> '' and to_path <> '' group by 1, 2)",
        "seen0 as (select distinct start, start as file, 0 as depth, '' as via from starts)",
        "front1 as (select start, file from seen0)",
    ]
    seen = "seen0"
    for k in range(1, depth + 1):
        hop, steps = f"front{k}", []
        for i in range(1, inner + 1):
            n = f"s{k}_{i}"
            out.append(f"{n} as (select h.start, e.by_file as file, {k} as depth, case min(e.r) when 0 then 'reexport' when 1 then 'import' else 'dynamic' end as via from {hop} h join imp e on e.file = h.file where not exists (select 1 from {seen} z where z.start = h.start and z.file = e.by_file) group by 1, 2)")
            out.append(f"seen{k}_{i} as (select * from {seen} union all select * from {n})")
            out.append(f"h{k}_{i} as (select start, file from {n} where via = 'reexport')")
            hop, seen = f"h{k}_{i}", f"seen{k}_{i}"
            steps.append(n)
        out.append(f"front{k + 1} as (" + " union all ".join(f"select start, file from {n} where via <> 'reexport'" for n in steps) + ")")
    out.append(f"impact as (select * from {seen} where depth > 0)")
    return ", ".join(out)


_SCHEMAS = "select path as start from file_node where role = 'schema' and path is not null"
_ADAPTERS = "select path as start from file_node where role = 'adapter' and path is not null"
_q("q_impact_of_files", f"with {impact_ctes(_SCHEMAS, 2)} select start, file, depth::int as depth, via from impact", lambda s, d: graph.impact_of_files(graph.importers(table(s, d, "edge_imports")), table(s, d, "file_node").where("role = 'schema'").select("path"), 2))


def callers_ctes(starts: str) -> str:
    """Callers of files over two hops; the last CTE is ``callers``."""
    return f"""{_CLIVE}, cst as ({starts}), c0 as (select distinct c.start, f.id as node from cst c join function_node f on f.file_path = c.start),
c1 as (select distinct h.start, e.src as node from c0 h join clive e on e.dst = h.node where not exists (select 1 from c0 z where z.start = h.start and z.node = e.src)),
c2 as (select distinct h.start, e.src as node from c1 h join clive e on e.dst = h.node where not exists (select 1 from c0 z where z.start = h.start and z.node = e.src) and not exists (select 1 from c1 z where z.start = h.start and z.node = e.src)),
callers as (select start, f.file_path as file, min(depth) as depth from (select *, 1 as depth from c1 union all select *, 2 from c2) x join function_node f on f.id = x.node where f.file_path <> start group by 1, 2)"""


_q("q_callers_of_files", f"with {callers_ctes(_ADAPTERS)} select start, file, depth::int as depth from callers", lambda s, d: graph.callers_of_files(table(s, d, "edge_calls"), table(s, d, "function_node"), table(s, d, "file_node").where("role = 'adapter'").select("path"), 2))


def _mentions(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))
    return S.symbol_mentions(docs, table(s, d, "function_node"))


_q(
    "q_impact_report",
    f"""with {impact_ctes(_SCHEMAS, 2)}, {callers_ctes(_SCHEMAS)},
near as (select start, 'importer' as section, file, depth from impact union all select start, 'caller', file, depth from callers),
known as (select path as file, max(role) as role, max(layer) as layer from file_node group by 1), reached as (select distinct n.start, n.file, k.role, k.layer from near n join known k using (file)),
men as (select distinct m.path, f.id, f.file_path from (select distinct doc_id::varchar as path, split_part(nm, '.', -1) as name from (select doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_][\\w.]*)(?:\\([^`\\n]*\\))?`', 1)) as nm from documents)) m join function_node f using (name))
select start, section, file as key, min(depth)::bigint as n from near group by 1, 2, 3
union all select start, 'test', file, 1 from reached where role = 'test'
union all select start, 'role', coalesce(role, 'other'), count(*) from reached group by 1, 2, 3
union all select start, 'layer', coalesce(layer, 'other'), count(*) from reached group by 1, 2, 3
union all select s.start, 'mention', m.path, count(distinct m.id) from men m join (select distinct start from starts) s on s.start = m.file_path group by 1, 2, 3""",
    lambda s, d: report.impact_report(table(s, d, "file_node").where("role = 'schema'").select("path"), table(s, d, "file_node"), table(s, d, "edge_imports"), table(s, d, "function_node"), table(s, d, "edge_calls"), _mentions(s, d), 2),
)


def _path(s: SparkSession, d: str) -> DataFrame:
    """The shortest way from the shared sink's file to the first test over importers; the two ends are one small aggregate each."""
    e = graph.reverse(graph.live(graph.pairs(table(s, d, "edge_imports"), "from_path", "to_path"), table(s, d, "file_node"), "path"))
    end = table(s, d, "file_node").where("role = 'test'").agg(F.min("path")).first()[0]
    return graph.path_between(e, "libs/corelog/emit.py", end or "", 6)


_q(
    "q_path_between",
    """with recursive live as (select distinct from_path as dst, to_path as src from edge_imports where from_path in (select path from file_node) and to_path in (select path from file_node)),
t as (select coalesce(min(path), '') as goal from file_node where role = 'test'),
r as (select 'libs/corelog/emit.py' as node, ['libs/corelog/emit.py'] as path, 0 as hops
      union all select l.dst, list_append(r.path, l.dst), r.hops + 1 from r join live l on l.src = r.node where r.hops < 6 and not list_contains(r.path, l.dst) and r.node <> (select goal from t))
select path, hops::int as hops from r where node = (select goal from t) order by hops, path limit 1""",
    _path,
)

# ---------------------------------------------------------------- overviews

_q(
    "q_top_directories",
    """with x as (select depth, array_to_string(list_slice(list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda p: p <> ''), 1, depth), '/') as directory from file_node, (values (1), (2), (3)) as v(depth)),
c as (select depth, directory, count(*) as n_files from x group by 1, 2), w as (select depth, max(n_files) / sum(n_files)::double as worst from c group by 1), pick as (select coalesce(min(case when worst <= 0.7 then depth end), 3) as d from w)
select depth::int as depth, directory, n_files from c where depth = (select d from pick)""",
    lambda s, d: insight.top_directories(table(s, d, "file_node")),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def role_sql() -> str:
    """The role rules as one CASE over path; the order is the operator's."""
    low, name = "lower('/' || ltrim(path, '/'))", "regexp_extract(path, '([^/]*)$', 1)"
    whens = [f"when regexp_matches(path, {_quoted(roles.TEST_PATH)}) then 'test|test'"]
    whens += [f"when contains({low}, {_quoted(f)}) then '{r}|{y}'" for f, r, y in sorted(roles.FOLDERS, key=lambda x: -len(x[0]))]
    whens += [f"when regexp_matches({name}, {_quoted(rx)}) then '{r}|{y}'" for rx, r, y in roles.FILE_NAMES]
    return "case " + " ".join(whens) + " else 'other|other' end"


_q("q_roles", f"select path, split_part(r, '|', 1) as role, split_part(r, '|', 2) as layer from (select path, {role_sql()} as r from file_node)", lambda s, d: table(s, d, "file_node").select("path", roles.classify("path").alias("r")).select("path", "r.role", "r.layer"))
_q(
    "q_fingerprint",
    """select sha256(concat_ws('|', (select count(*) from file_node)::varchar, (select sum(('0x' || substr(md5(concat_ws('|', coalesce(path, ''), coalesce(git_blob_sha, ''), coalesce(floor(mtime * 1000)::bigint, 0)::varchar)), 1, 12))::bigint) from file_node)::varchar, (select count(*) from edge_calls)::varchar, (select count(*) from edge_imports)::varchar)) as fingerprint""",
    lambda s, d: insight.fingerprint(table(s, d, "file_node"), [table(s, d, "edge_calls"), table(s, d, "edge_imports")]),
)


def _all_symbols(s: SparkSession, d: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return report.symbols(
        Function=table(s, d, "function_node"),
        File=table(s, d, "file_node").select(F.col("path").alias("id"), name.alias("name"), F.col("path").alias("file_path")),
        Memory=table(s, d, "memory_entries").select(F.col("path").alias("id"), F.col("title").alias("name"), F.col("path").alias("file_path")),
        Plan=table(s, d, "plan_entries").select(F.col("path").alias("id"), F.col("title").alias("name"), F.col("path").alias("file_path")),
    )


_LOOKUPS = [("l1", "emit"), ("l2", "merge_"), ("l3", "sessionedge"), ("l4", "shared"), ("l5", "x_")]
_q(
    "q_symbol_lookup",
    "with v(query, t) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _LOOKUPS) + "), sy as (select 'Function' as label, id, name from function_node union all select 'File', path, regexp_extract(path, '([^/]*)$', 1) from file_node union all select 'Memory', path, title from memory_entries union all select 'Plan', path, title from plan_entries), "
    "j as (select distinct v.query, sy.label, sy.id, sy.name, case when lower(sy.name) = v.t then 0 when starts_with(lower(sy.name), v.t) then 1 else 2 end as match from sy, v where contains(lower(sy.name), v.t)), r as (select *, row_number() over (partition by query order by match, length(name), name, id, label) - 1 as rank from j) select query, label, id, match::int as match, rank::int as rank from r where rank < 20",
    lambda s, d: report.symbol_lookup(_all_symbols(s, d), s.createDataFrame(_LOOKUPS, "query string, text string")),
)

# ---------------------------------------------------------------- storage operators themselves

_q(
    "q_upsert_nodes",
    "with n as (select *, row_number() over (partition by path order by mtime desc) as rn from (select distinct path, mtime, 'touched' as role from memory_entries union select distinct path, mtime + 1, 'again' from file_node where role = 'test')) select coalesce(f.path, n.path) as path, f.lang, coalesce(n.role, f.role) as role, f.layer from file_node f full join (select * from n where rn = 1) n on n.path = f.path",
    lambda s, d: GraphStore.open(s, d, ["file"]).upsert_nodes("File", table(s, d, "memory_entries").select("path", "mtime", F.lit("touched").alias("role")).union(table(s, d, "file_node").where("role = 'test'").select("path", F.col("mtime") + 1, F.lit("again"))).distinct(), "mtime").node("File").select("path", "lang", "role", "layer"),
)
_q(
    "q_ensure_edges",
    "with old as (select from_path, to_path, symbol, kind from edge_imports where symbol = 'Edge' or symbol is null), new as (select distinct from_path, to_path, symbol from edge_imports where from_path is not null and to_path is not null and symbol is not null) select from_path, to_path, symbol from old union all select from_path, to_path, symbol from new n where not exists (select 1 from old o where o.from_path = n.from_path and o.to_path = n.to_path and o.symbol = n.symbol)",
    lambda s, d: GraphStore(s, {"edge_imports": table(s, d, "edge_imports").where("symbol = 'Edge' or symbol is null")}).ensure_edges("IMPORTS", table(s, d, "edge_imports").where("from_path is not null and to_path is not null and symbol is not null")).edge("IMPORTS").select("from_path", "to_path", "symbol"),
)
_q("q_blob_sha", "select git_blob_sha, sha1(('blob ' || octet_length(encode(body))::varchar)::blob || '\\x00'::blob || encode(body)) as computed from source_blob where body is not null", lambda s, d: table(s, d, "source_blob").where("body is not null").select("git_blob_sha", S.blob_sha(F.encode("body", "UTF-8")).alias("computed")))
_q("q_memory_list", "select path, kind, title, mtime from memory_entries where kind = 'project'", lambda s, d: knowledge.entry_list(table(s, d, "memory_entries"), kind="project").select("path", "kind", "title", "mtime"))
_q("q_plan_list", "select path, slug, title, mtime from plan_entries where coalesce(agent_id, '') <> '' order by mtime desc, path limit 50", lambda s, d: knowledge.entry_list(table(s, d, "plan_entries"), 50, agent_id="*").select("path", "slug", "title", "mtime"))

# ---------------------------------------------------------------- symptoms

_QUOTED = "\"[^\"]*\"|''[^'']*''|`[^`]*`|«[^»]*»"
_KEPT = "|".join(X.SYMPTOM_PHRASES)


def symptom_sql(col: str) -> str:
    """The normal form of an error; numbers go before short hex words here, as a word of digits only is never one."""
    parts = f"regexp_extract_all(coalesce({col}, ''), '(?s)(?:{_QUOTED}|[^\"''`«]+|.)')"
    inner = "trim(substr(x, 2, length(x) - 2))"
    x = f"array_to_string(list_transform({parts}, lambda x: case when not regexp_full_match(x, '(?s)(?:{_QUOTED})') then x when regexp_full_match({inner}, '[A-Z][A-Z0-9_]{{2,}}') or regexp_matches(lower(x), '{_KEPT}') then {inner} else '<q>' end), '')"
    for rx, to in (
        (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
        (r"/(?:[\w.\-]+/)+[\w.\-]+", "<path>"),
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<hex>"),
        (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
        (r"\b\d{13}\b|\b\d{10}\b", "<ts>"),
        (r"\b\d+\b", "<n>"),
        (r"\b[0-9a-fA-F]{7,}\b", "<hex>"),
        (r"\s+", " "),
    ):
        x = f"regexp_replace({x}, '{rx}', '{to}', 'g')"
    return f"trim({x})"


# Errors of the log, and lines made of them that differ in what is volatile.
_DRESSED = "error || ' at /srv/' || tool || '/run.py:' || id || ' in ''' || tool || ''' 2025-01-02T03:04:05Z 0x' || lpad(id::varchar, 8, '0')"
_q(
    "q_symptoms",
    f"select symptom, count(*) as n, min(id) as first_id, max(id) as last_id from (select distinct id, {symptom_sql('error')} as symptom from call_log where error <> '' union all select distinct id, {symptom_sql(_DRESSED)} from call_log where error <> '' and tool is not null) group by 1",
    lambda s, d: _symptoms(s, d),
)


def _symptoms(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "call_log").where("error <> ''")
    dressed = F.concat("error", F.lit(" at /srv/"), "tool", F.lit("/run.py:"), F.col("id").cast("string"), F.lit(" in '"), "tool", F.lit("' 2025-01-02T03:04:05Z 0x"), F.lpad(F.col("id").cast("string"), 8, "0"))
    rows = e.select("id", F.col("error").alias("e")).distinct().unionByName(e.where("tool is not null").select("id", dressed.alias("e")).distinct())
    return rows.groupBy(X.normalize_symptom("e").alias("symptom")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_SIGNS = [("d1", "KeyError: 'other'"), ("d2", "timeout after 90s in worker"), ("d3", "database is locked (pid 7)"), ("d4", "no such table")]
_TOKS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_]+'), lambda w: length(w) >= 2 and w not in ('ts', 'path', 'hex', 'n', 'q')))"
_q(
    "q_diagnose",
    f"""with n0 as (select min(id) as doc, error from call_log where error <> '' group by error), n as (select doc, {symptom_sql('error')} as norm from n0), nt as (select *, {_TOKS.format('norm')} as toks from n),
q0(query, t) as (values {", ".join(f"('{a}', {_quoted(b)})" for a, b in _SIGNS)}), q as (select query, {symptom_sql('t')} as qnorm from q0), qt as (select *, {_TOKS.format('qnorm')} as qtoks from q),
j as (select query, doc, case when qnorm = norm then 1.0::double else len(list_intersect(toks, qtoks))::double / (len(toks) + len(qtoks) - len(list_intersect(toks, qtoks))) end as score from qt, nt where qnorm = norm or len(list_intersect(toks, qtoks)) > 0),
r as (select *, row_number() over (partition by query order by score desc, doc) - 1 as rank from j where score >= 0.34)
select query, doc, round(score, 6) as score, rank::int as rank from r where rank < 8""",
    lambda s, d: knowledge.diagnose(table(s, d, "call_log").where("error <> ''").groupBy(F.col("error").alias("symptom")).agg(F.min("id").alias("id")), s.createDataFrame(_SIGNS, "query string, text string")).select("query", "doc", F.round("score", 6).alias("score"), "rank"),
)

# ---------------------------------------------------------------- notes: findings stand in for verdicts on files

_VERDICT = "case lower(severity) when 'info' then 'useful' when 'warn' then 'dead_end' when 'block' then 'corrected' end"


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "findings").select("id", "file_path", "severity", "created_at", "key").distinct()
    v = F.when(F.lower("severity") == "info", "useful").when(F.lower("severity") == "warn", "dead_end").when(F.lower("severity") == "block", "corrected")
    return f.select(F.col("file_path").alias("entry_id"), v.alias("verdict"), F.col("created_at").alias("ts"), F.col("key").alias("note"), F.lit(None).cast("string").alias("corrected_by"), F.col("file_path").alias("file_refs"))


_STANDING = f"""with v as (select entry_id, verdict, ts, pow(0.5, greatest({NOW} - ts, 0) / (86400.0 * 30)) as w from (select distinct id, file_path as entry_id, {_VERDICT} as verdict, coalesce(created_at, 0) as ts from (select distinct id, file_path, severity, created_at, key from findings)) where verdict is not null),
a as (select entry_id, count(*) filter (verdict = 'useful') as useful, count(*) filter (verdict = 'dead_end') as dead_end, count(*) filter (verdict = 'corrected') as corrected, coalesce(sum(w) filter (verdict = 'useful'), 0) as uw, coalesce(sum(w) filter (verdict <> 'useful'), 0) as nw, max(ts) filter (verdict = 'useful') as lu, max(ts) filter (verdict = 'corrected') as lc from v group by 1),
st as (select *, uw - nw as score, case when lc is not null and (lu is null or lu <= lc) then 'corrected' when uw + nw < 0.125 then 'faded' when uw / (uw + nw) >= 0.75 and useful >= 2 then 'preferred' when uw / (uw + nw) >= 0.75 then 'useful' when uw / (uw + nw) <= 0.25 then 'dead_end' else 'contested' end as status from a)"""
_q("q_outcomes", f"{_STANDING} select entry_id, useful, dead_end, corrected, status, round(score, 6) as score from st", lambda s, d: knowledge.outcomes(_verdicts(s, d), NOW, ["entry_id"]).select("entry_id", "useful", "dead_end", "corrected", "status", F.round("score", 6).alias("score")))
_q("q_outcomes_by_file", f"{_STANDING} select entry_id as file, status, round(score, 6) as score from st where trim(entry_id) <> ''", lambda s, d: knowledge.outcomes_by_file(_verdicts(s, d), NOW).select("file", "status", F.round("score", 6).alias("score")))


def _notes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "plan_entries")
    return p.select(F.col("path").alias("id"), F.lit("plan").alias("kind"), "title", "body", F.regexp_replace("slug", "-", ",").alias("tags"), F.col("mtime").alias("ts"))


_q("q_knowledge_terms", "select term, count(*) as n from (select trim(lower(unnest(string_split(replace(slug, '-', ','), ',')))) as term from plan_entries) where term <> '' group by 1 having count(*) >= 2", lambda s, d: knowledge.terms(_notes(s, d), 2))
_q(
    "q_knowledge_promote",
    "select min(sha256(concat_ws(chr(0), lower(trim(title, ' ')), trim(body, ' ')))) as k from plan_entries p where not exists (select 1 from memory_entries m where concat_ws(chr(0), lower(trim(m.title, ' ')), trim(m.body, ' ')) = concat_ws(chr(0), lower(trim(p.title, ' ')), trim(p.body, ' '))) group by sha256(concat_ws(chr(0), lower(trim(title, ' ')), trim(body, ' ')))",
    lambda s, d: knowledge.promote(table(s, d, "plan_entries").select("title", "body"), table(s, d, "memory_entries").select("title", "body")).select(F.sha2(F.concat_ws("\x00", F.lower(F.trim("title")), F.trim("body")), 256).alias("k")),
)
_q(
    "q_knowledge_list",
    f"{_STANDING} select p.path as id, case when st.status in ('preferred', 'useful') then 0 when st.status = 'dead_end' then 2 when st.status = 'corrected' then 3 else 1 end::int as tier, st.status from (select path, mtime from file_node where role = 'service') p left join st on st.entry_id = p.path order by tier, p.mtime desc nulls last, id limit 40 offset 5",
    lambda s, d: knowledge.tiered_list(table(s, d, "file_node").where("role = 'service'").select(F.col("path").alias("id"), F.lit("file").alias("kind"), F.lit("").alias("tags"), F.col("mtime").alias("ts")), knowledge.outcomes(_verdicts(s, d), NOW, ["entry_id"]), 40, 5).select("id", F.col("tier").cast("int").alias("tier"), "status"),
)
_q(
    "q_supersede",
    "with t as (select path as id, mtime as ts, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) as w from plan_entries where len(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+')) > 0), p as (select a.id as x, b.id as y, a.ts as ta, b.ts as tb, len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))) as score from t a join t b on a.id < b.id) select case when ta > tb or (ta = tb and x > y) then x else y end as newer, case when ta > tb or (ta = tb and x > y) then y else x end as older, round(score, 6) as score from p where score >= 0.5",
    lambda s, d: knowledge.supersede_candidates(_notes(s, d), 0.5).select("newer", "older", F.round("score", 6).alias("score")),
)

# ---------------------------------------------------------------- histories: findings stand in for commits, the scanner for the author


def _commits(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "findings").select("id", "file_path", "scanner", "created_at", "line").distinct()
    return f.select(F.col("id").cast("string").alias("sha"), F.col("scanner").alias("author"), F.floor("created_at").cast("long").alias("author_time"), F.col("file_path").alias("path"), F.col("line").alias("added"), F.lit(None).cast("long").alias("deleted"))


_COMMITS = "c as (select distinct id, scanner as author, floor(created_at)::bigint as author_time, file_path as path, line as added from findings)"
_q("q_churn", f"with {_COMMITS} select path, count(*) as commits, max(author_time) as last_modified, coalesce(sum(added), 0)::bigint as lines_added, 0::bigint as lines_deleted, count(distinct author) as n_authors from c group by 1", lambda s, d: insight.churn(_commits(s, d)).select("path", "commits", "last_modified", "lines_added", "lines_deleted", F.size("authors").cast("long").alias("n_authors")))
_q("q_ownership", f"with {_COMMITS}, o as (select path, author, count(*) as commits, max(author_time) as last_commit from c where coalesce(author, '') <> '' group by 1, 2) select *, row_number() over (partition by path order by commits desc, last_commit desc, author)::int as rank from o", lambda s, d: insight.ownership(_commits(s, d)).select("path", "author", "commits", "last_commit", "rank"))
_q(
    "q_changed_symbols",
    "select distinct f.id, 'function' as kind, f.file_path from function_node f join (select distinct file_path, line - 1 as lo, line + 1 as hi from findings where scanner = 'diff-hook' and line is not null) r on r.file_path = f.file_path where f.start_line <= r.hi and coalesce(f.end_line, f.start_line) >= r.lo",
    lambda s, d: insight.changed_symbols(table(s, d, "function_node").select("id", F.lit("function").alias("kind"), "file_path", "start_line", "end_line"), table(s, d, "findings").where("scanner = 'diff-hook' and line is not null").select("file_path", (F.col("line") - 1).alias("lo"), (F.col("line") + 1).alias("hi")).distinct()),
)
_PR = "concat_ws('/', scanner, lower(severity))"
_q(
    "q_pr_overlap",
    f"""with ch as (select distinct {_PR} as pr, file_path as path, line from findings where scanner is not null and file_path is not null and line is not null), sy as (select id, file_path, start_line, end_line from function_node),
s as (select distinct c.pr, sy.id from ch c join sy on sy.file_path = c.path where sy.start_line <= c.line + 2 and sy.end_line >= c.line - 2), via as (select distinct s.pr, e.to_id as id from s join (select distinct from_id, to_id from edge_calls where to_id is not null) e on e.from_id = s.id),
strong as (select a.pr as a, b.pr as b, count(distinct a.id) as n from s a join s b on a.id = b.id and a.pr < b.pr group by 1, 2),
ind as (select least(v.pr, s.pr) as a, greatest(v.pr, s.pr) as b, count(distinct v.id) as n from via v join s on s.id = v.id and s.pr <> v.pr group by 1, 2),
weak as (select a.pr as a, b.pr as b, count(*) as n from (select distinct pr, path from ch) a join (select distinct pr, path from ch) b on a.path = b.path and a.pr < b.pr group by 1, 2)
select coalesce(w.a, s.a, i.a) as a, coalesce(w.b, s.b, i.b) as b, coalesce(s.n, 0) as strong, coalesce(i.n, 0) as indirect, coalesce(w.n, 0) as weak from weak w full join strong s on s.a = w.a and s.b = w.b full join ind i on i.a = coalesce(w.a, s.a) and i.b = coalesce(w.b, s.b)""",
    lambda s, d: _overlap(s, d),
)


def _overlap(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "findings").where("scanner is not null and file_path is not null and line is not null").select(F.concat_ws("/", "scanner", F.lower("severity")).alias("pr"), F.col("file_path").alias("path"), "line").distinct()
    ch = f.groupBy("pr", "path").agg(F.collect_set(F.struct((F.col("line") - 2).alias("lo"), (F.col("line") + 2).alias("hi"))).alias("ranges"))
    return insight.pr_overlap(ch, table(s, d, "function_node").select("id", "file_path", "start_line", "end_line"), table(s, d, "edge_calls").where("to_id is not null"))


_TYPES = "select distinct split_part(file_path, '/', 1) as scope, name, file_path, start_line, list_distinct(list_transform(regexp_extract_all(lower(docstring), '[a-z_]{4,}'), lambda x: replace(x, '_', ''))) as f from function_node where docstring is not null"
_q(
    "q_shared_types",
    f"with t0 as ({_TYPES}), t as (select *, row_number() over (partition by scope, name order by file_path, start_line) as rn from t0), u as (select * from t where rn <= 20 and len(f) > 0), p as (select a.name, a.scope as scope_a, a.file_path as file_a, b.scope as scope_b, b.file_path as file_b, round(len(list_intersect(a.f, b.f))::double / len(list_distinct(list_concat(a.f, b.f))), 2) as score from u a join u b on a.name = b.name and a.scope < b.scope) select * from p where score >= 0.5",
    lambda s, d: insight.shared_types(table(s, d, "function_node").where("docstring is not null").select(F.split("file_path", "/")[0].alias("scope"), "name", "file_path", "start_line", F.regexp_extract_all(F.lower("docstring"), F.lit("[a-z_]{4,}"), F.lit(0)).alias("fields")).distinct()).select("name", "scope_a", "file_a", "scope_b", "file_b", "score"),
)

# ---------------------------------------------------------------- linking: call sites are the stored edges with their target forgotten


def _sites(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "function_node").select("id", "name", "file_path")
    e = graph.with_ends(graph.pairs(table(s, d, "edge_calls"), "from_id", "to_id"), f.select("id", F.struct("name", "file_path").alias("v")), "id", "v", "a", "b")
    return e.select(F.col("src").alias("from_id"), F.col("a.file_path").alias("file_path"), F.col("b.name").alias("name"), F.lit("").alias("to_id"), F.lit("attr").alias("kind"), F.lit("").alias("hint"), F.lit("").alias("ctx")).where("name is not null").distinct()


_FAM = "case when regexp_matches(lower({0}), '\\.(py|pyw|pyi)$') then 'py' when regexp_matches(lower({0}), '\\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|vue|svelte)$') then 'js' else regexp_extract(lower({0}), '(\\.[^./]+)$', 1) end"
_COMMON = ", ".join(_quoted(x) for x in linking.COMMON_METHODS)
_q(
    "q_call_edges",
    f"""with {_CLIVE}, f as (select distinct id, name, file_path, {_FAM.format('file_path')} as fam, regexp_matches(file_path, {_quoted(roles.TEST_PATH)}) as is_test from function_node),
s as (select distinct c.src as from_id, a.file_path, a.fam, a.is_test, b.name from clive c join f a on a.id = c.src join f b on b.id = c.dst where b.name is not null), n as (select name, fam, count(*) as n from f group by 1, 2),
i as (select distinct from_path, to_path from edge_imports where to_path is not null and to_path <> ''),
c as (select s.from_id, s.name, f.id as to_id, case when f.file_path = s.file_path then 1 when i.to_path is not null then 2 when n.n <= {linking.MOST_TARGETS} and s.name not in ({_COMMON}) then 3 end as rule from s join f on f.name = s.name and f.fam = s.fam join n on n.name = s.name and n.fam = s.fam left join i on i.from_path = s.file_path and i.to_path = f.file_path where (s.is_test or not f.is_test) and s.from_id <> f.id),
b as (select from_id, name, min(rule) as best from c where rule is not null group by 1, 2)
select c.from_id, c.to_id, min(c.rule)::int as rule from c join b on b.from_id = c.from_id and b.name = c.name and b.best = c.rule group by 1, 2""",
    lambda s, d: linking.call_edges(_sites(s, d), table(s, d, "function_node"), table(s, d, "edge_imports")),
)


def _modules(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "edge_imports").where("from_path like '%.py' and to_path like '%.py'").select("from_path", "to_path").distinct()
    return e.select(F.col("from_path").alias("path"), F.regexp_replace(F.regexp_replace("to_path", r"\.py$", ""), "/", ".").alias("name"), F.lit("").alias("qualified"))


_q(
    "q_import_edges",
    "select distinct from_path, to_path, '' as symbol from edge_imports where from_path like '%.py' and to_path like '%.py' and to_path in (select path from file_node) and from_path <> to_path and not contains(regexp_replace(to_path, '\\.py$', ''), '.')",
    lambda s, d: linking.import_edges(_modules(s, d).where("not contains(name, '..')"), table(s, d, "file_node")).select("from_path", "to_path", "symbol"),
)

# ---------------------------------------------------------------- endpoints: paths made of the folders of router files


def _endpoints(s: SparkSession, d: str) -> DataFrame:
    p = F.split("path", "/")
    name = F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1)
    f = table(s, d, "file_node").where("role in ('router', 'handler')")
    return f.select(F.col("path").alias("id"), F.concat(F.lit("/"), p[0], F.lit("/{item}/"), name).alias("full_path"), F.when(F.col("lang") == "python", "GET").otherwise("POST").alias("method")).distinct()


_WANTED = [("e1", "/apps/42/session_edge", ""), ("e2", "/web/{id}/row_token", ""), ("e3", "/backend/*", ""), ("e4", "/7/token_node", ""), ("e5", "/tools/x/lease_batch", "GET"), ("e6", "/packages/{item}/*_row", "POST")]
_q(
    "q_endpoints",
    """with e as (select distinct path as id, split_part(path, '/', 1) as a, regexp_extract(path, '([^/.]+)\\.[^/]*$', 1) as n, case when lang = 'python' then 'GET' else 'POST' end as m from file_node where role in ('router', 'handler'))
select query, id, how from (
select 'e1' as query, id, 'exact' as how from e where a = 'apps' or n = 'session_edge' and a = 'apps'
) where false
union all select 'e1', id, 'exact' from e where a = 'apps' and n = 'session_edge'
union all select 'e2', id, 'exact' from e where a = 'web' and n = 'row_token'
union all select 'e3', id, 'glob' from e where a = 'backend'
union all select 'e4', id, 'suffix' from e where n = 'token_node'
union all select 'e5', id, 'exact' from e where a = 'tools' and n = 'lease_batch' and m = 'GET'
union all select 'e6', id, 'glob' from e where a = 'packages' and n like '%\\_row' escape '\\' and m = 'POST'""",
    lambda s, d: endpoints.find(_endpoints(s, d), s.createDataFrame(_WANTED, "query string, path string, method string")).select("query", "id", "how"),
)

# ---------------------------------------------------------------- Terraform, documents


def _tf(s: SparkSession, d: str) -> DataFrame:
    return code.definitions(table(s, d, "file_node").where("path like '%.tf'").select("path", "git_blob_sha"), table(s, d, "source_blob"))


_q(
    "q_tf_blocks",
    "select f.path || '::var.' || n as id, n as name, 'variable' as kind, regexp_replace(f.path, '/?[^/]*$', '') as module_dir from (select path, regexp_extract(b.body, 'variable \"(\\w+)\"', 1) as n from file_node join source_blob b using (git_blob_sha) where path like '%.tf') f where n <> ''",
    lambda s, d: TF.blocks(_tf(s, d)).select("id", "name", "kind", "module_dir"),
)
_q(
    "q_doc_links",
    """with l as (select path, unnest(string_split_regex(body, '\\r\\n|\\n|\\r')) as t, unnest(generate_series(1, len(string_split_regex(body, '\\r\\n|\\n|\\r')))) as line from (select doc_id::varchar as path, text || chr(10) || '[' || source || '](docs/' || coalesce(lang, 'none') || '.md#top)' as body from documents where text is not null and source is not null)),
o as (select *, sum(case when regexp_matches(t, '^ {0,3}(```|~~~)') then 1 else 0 end) over (partition by path order by line) % 2 as op from l),
m as (select path, line, unnest(regexp_extract_all(t, '(?:^|[^!])(\\[[^\\]\\n]*\\]\\([^)\\s]+[^)]*\\))', 1)) as m from o where op = 0 and not regexp_matches(t, '^ {0,3}(```|~~~)'))
select path, line::int as line, regexp_extract(m, '^\\[([^\\]]*)\\]', 1) as label, regexp_extract(m, '\\]\\(([^)\\s]+)', 1) as target from m""",
    lambda s, d: S.links(_linked(s, d)),
)


def _linked(s: SparkSession, d: str) -> DataFrame:
    """Documents with a line of their own source appended as a link: the texts have few."""
    x = table(s, d, "documents").where("text is not null and source is not null")
    return x.select(F.col("doc_id").cast("string").alias("path"), F.concat("text", F.lit("\n["), "source", F.lit("](docs/"), F.coalesce("lang", F.lit("none")), F.lit(".md#top)")).alias("body"))


_q(
    "q_paragraph_chunks",
    """with recursive p0 as (select row_number() over () as k, doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') as ps from documents where text is not null),
r as (select k, doc_id, ps, 1 as i, ''::varchar as cur, []::varchar[] as done from p0
      union all select k, doc_id, ps, i + 1, case when cur <> '' and length(cur) + length(ps[i]) + 2 > 1500 then ps[i] when cur = '' then ps[i] else cur || chr(10) || chr(10) || ps[i] end, case when cur <> '' and length(cur) + length(ps[i]) + 2 > 1500 then list_append(done, cur) else done end from r where i <= len(ps)),
e as (select doc_id, case when cur <> '' then list_append(done, cur) else done end as cs from r where i = len(ps) + 1)
select doc_id, unnest(generate_series(0, len(cs) - 1))::int as chunk_no, unnest(cs) as chunk from e where len(cs) > 0""",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(S.paragraphs_packed("text")).alias("chunk_no", "chunk")),
)

# ---------------------------------------------------------------- upkeep

_q(
    "q_orphans",
    "select id, file_path from function_node where file_path not in (select path from file_node where role <> 'service' and path is not null union select node_key from purge_log where node_table = 'file_node' and node_key is not null)",
    lambda s, d: upkeep.orphans(table(s, d, "function_node"), "file_path", table(s, d, "file_node").where("role <> 'service'").select("path"), table(s, d, "purge_log").where("node_table = 'file_node'").select("node_key")).select("id", "file_path"),
)
_q("q_stale_edges", f"with {_CLIVE}, e as ({SQL['q_call_edges']}) select src as from_id, dst as to_id from clive except select from_id, to_id from e", lambda s, d: upkeep.stale_edges(graph.live(graph.pairs(table(s, d, "edge_calls"), "from_id", "to_id"), table(s, d, "function_node"), "id").select(F.col("src").alias("from_id"), F.col("dst").alias("to_id")), QUERIES["q_call_edges"](s, d)))
_q("q_relocate", "select case when path = 'apps' or starts_with(path, 'apps/') then 'moved/here' || substr(path, 5) else path end as path, lang from file_node", lambda s, d: upkeep.relocate(table(s, d, "file_node").select("path", "lang"), "apps/", "moved/here/", "path"))
_OUTCOME = "case when result_size = 0 then 'zero' when result_size < 500 then 'low' when result_size < 5000 then 'medium' when result_size >= 5000 then 'high' end"
_q(
    "q_recall_stats",
    f"with c as (select {_OUTCOME} as outcome, count(*) as n from (select distinct id, result_size from call_log) group by 1), t as (select coalesce(sum(n) filter (outcome = 'high'), 0)::bigint as high, coalesce(sum(n) filter (outcome = 'medium'), 0)::bigint as medium, coalesce(sum(n) filter (outcome = 'low'), 0)::bigint as low, coalesce(sum(n) filter (outcome = 'zero'), 0)::bigint as zero from c) select high + medium + low + zero as searches, high, medium, low, zero, printf('%.1f%%', 100.0 * zero / (high + medium + low + zero)) as zero_hit_rate, printf('%.1f%%', 100.0 * low / (high + medium + low + zero)) as low_confidence_rate from t",
    lambda s, d: upkeep.recall_stats(insight.calls(table(s, d, "call_log"), "result_size").groupBy(F.expr(_OUTCOME).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))),
)
_q("q_import_coverage", "with l as (select path, max(lang) as lang from file_node group by 1) select coalesce(l.lang, 'unknown') as lang, count(*) as seen, count(*) filter (e.to_path in (select path from file_node where path is not null)) as resolved from edge_imports e left join l on l.path = e.from_path group by 1", lambda s, d: upkeep.import_coverage(table(s, d, "edge_imports"), table(s, d, "file_node")))
_q(
    "q_first_call_site",
    f"with {_CLIVE}, j as (select a.file_path as a, b.file_path as b, a.start_line as line, src as from_id, dst as to_id, row_number() over (partition by a.file_path, b.file_path order by a.start_line, src, dst) as rn from clive join function_node a on a.id = src join function_node b on b.id = dst where a.file_path <> b.file_path) select a, b, line, from_id, to_id from j where rn = 1",
    lambda s, d: upkeep.first_call_site(table(s, d, "edge_calls").where("from_id <> '' and to_id <> ''"), table(s, d, "function_node")),
)
_q(
    "q_definition_order",
    "with h as (select id, file_path, case when lower(name) = 'emit' then 0 when starts_with(lower(name), 'emit') then 1 else 2 end as match, regexp_matches(file_path, '(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|\\.(md|mdx|rst|txt)$')::int as late from function_node where contains(lower(name), 'emit')) select id, match::int as match, (row_number() over (order by match, late, length(file_path), id) - 1)::int as rank from h order by rank limit 50",
    lambda s, d: upkeep.definition_order(table(s, d, "function_node"), "emit"),
)
_q(
    "q_file_tiers",
    f"""with h as ({cascade_sql(f"select id as doc, {_SPLIT.format('name')} as nm, docstring as bd from function_node", 40)}), j as (select h.query, f.file_path, h.score, coalesce(n.role, '') = 'test' as is_test from h join function_node f on f.id = h.doc left join (select path, max(role) as role from file_node group by 1) n on n.path = f.file_path),
g as (select query, file_path, max(score) as b, sum(score) as s, max(is_test::int) as t from j group by 1, 2), r as (select query, file_path, round((b + 0.3 * (s - b)) * case when t = 1 then 0.5 else 1 end, 6) as score from g), k as (select *, row_number() over (partition by query order by score desc, file_path) - 1 as rank from r)
select query, file_path, score, rank::int as rank, case when rank < 3 then 1 else 2 end::int as tier from k where rank < 8""",
    lambda s, d: _tiers(s, d),
)


def _tiers(s: SparkSession, d: str) -> DataFrame:
    h = _shown(search.search(table(s, d, "function_node").select("id", "name", "docstring"), "id", X.tokenize_identifier("name"), F.col("docstring"), asked(s), 40))
    role = table(s, d, "file_node").groupBy(F.col("path").alias("file_path")).agg(F.max("role").alias("role"))
    j = h.join(table(s, d, "function_node").select(F.col("id").alias("doc"), "file_path"), "doc").join(role, "file_path", "left")
    return upkeep.file_tiers(j.select("query", "file_path", "score", (F.coalesce("role", F.lit("")) == "test").alias("is_test"), F.lit(True).alias("has_code")))


_q("q_scoped", "select path, title, null::varchar as slug, 'memory' as scope from memory_entries union all select path, title, slug, 'plan' from plan_entries", lambda s, d: upkeep.scoped(memory=table(s, d, "memory_entries").select("path", "title"), plan=table(s, d, "plan_entries").select("path", "title", "slug")).select("path", "title", "slug", "scope"))
_q(
    "q_module_doc",
    "select f.path, substr(trim(regexp_replace(regexp_replace(case when f.path like '%.py' then coalesce(nullif(regexp_extract(b.body, '^(?:\\s|#[^\\n]*\\n)*\"\"\"((?s:.)*?)\"\"\"', 1), ''), '') else '' end, '(?is)^.*?\\bdescription:\\s*', ''), '\\s+', ' ', 'g')), 1, 240) as module_doc from (select distinct path, git_blob_sha from file_node where path like '%.py' or path like '%.go') f join source_blob b using (git_blob_sha)",
    lambda s, d: upkeep.module_doc(table(s, d, "file_node").where("path like '%.py' or path like '%.go'").select("path", "git_blob_sha").distinct().join(table(s, d, "source_blob").select("git_blob_sha", "body"), "git_blob_sha")),
)
