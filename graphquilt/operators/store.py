"""Storage primitives of the graph as functions of DataFrames.

A ``GraphStore`` is an immutable bundle of tables; every write returns a new one
with lazily rewritten tables, so a batch of changes is one plan and readers keep
their snapshot.  Values looked up are DataFrames or lists; lists become a join
when they are long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EDGES, NODES, SIDE, EdgeType, Names, edges_of
from ..sources.tables import table

#: Lists up to this long are written into the plan as literals, longer ones are joined.
MOST_LITERALS = 200


def like_any(column: str, value: str) -> Column:
    """Substring test whose ``%`` and ``_`` stay wildcards, case-sensitive."""
    return F.col(column).like(f"%{value}%")


def escape_like(value: str) -> str:
    """A literal for ``like(..., escape='!')``."""
    return value.replace("!", "!!").replace("%", "!%").replace("_", "!_")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one last in ``order``; null keys are no nodes."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return rows.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Like ``last_wins`` but by a map-side combined aggregate, so one hot key is no hot task."""
    others = [c for c in rows.columns if c != key]
    r = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order)).alias("_r"))
    return r.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


class GraphStore:
    """Tables by catalogue name."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables = spark, tables

    @classmethod
    def open(cls, spark: SparkSession, folder: str, tables: list[str], names: Names | None = None) -> GraphStore:
        names = names or Names()
        return cls(spark, {t: table(spark, folder, names(t)) for t in tables})

    def _with(self, **changed: DataFrame) -> GraphStore:
        return GraphStore(self.spark, {**self.tables, **changed})

    def node(self, label: str) -> DataFrame:
        if label not in NODES:
            raise ValueError(f"unknown label {label!r}")
        t = NODES[label].table
        return self.tables[t] if t in self.tables else self.spark.createDataFrame([], NODES[label].schema)

    def edge(self, name: str) -> DataFrame:
        if name not in EDGES:
            raise ValueError(f"unknown edge {name!r}")
        t = EDGES[name].table
        return self.tables[t] if t in self.tables else self.spark.createDataFrame([], EDGES[name].schema)

    def side(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], SIDE[name])

    def sql(self, text: str) -> DataFrame:
        """Raw SQL over the tables as views."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    # ---- writes

    def upsert_nodes(self, label: str, rows: DataFrame, order: str | None = None) -> GraphStore:
        """Inserts or replaces nodes; within ``rows`` the last of a key in ``order`` wins.

        Columns that ``rows`` lacks keep their old values.
        """
        spec, old = NODES[label], self.node(label)
        new = latest(rows, spec.key, order) if order else rows.dropDuplicates([spec.key])
        given = [c for c in new.columns if c in old.columns and c != spec.key]
        n = new.select(F.col(spec.key), *[F.col(c).alias(f"_n_{c}") for c in given], F.lit(True).alias("_new"))
        j = old.join(n, spec.key, "full_outer")
        cols = [F.col(spec.key)] + [(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in given else F.col(c)).alias(c) for c in old.columns if c != spec.key]
        return self._with(**{spec.table: j.select(*cols).select(*old.columns)})

    upsert_node = upsert_nodes

    def ensure_edges(self, name: str, rows: DataFrame) -> GraphStore:
        """Adds edges that are not there yet; null properties become empty, the stored edge wins over a new one."""
        spec, old = EDGES[name], self.edge(name)
        new = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in spec.props else F.col(c) for c in old.columns if c in rows.columns])
        fresh = new.dropDuplicates(spec.identity).join(old.select(*spec.identity).distinct(), spec.identity, "left_anti")
        return self._with(**{spec.table: old.unionByName(fresh, allowMissingColumns=True)})

    ensure_edge = ensure_edges

    def purge_file_data(self, files: DataFrame) -> GraphStore:
        """Removes everything that belongs to the files (``path``), but for their File rows and edges into them by path."""
        paths = files.select(F.col("path").alias("_p")).distinct()
        out: dict[str, DataFrame] = {}
        gone: dict[str, DataFrame] = {}
        for label, spec in NODES.items():
            if spec.of_file and spec.table in self.tables:
                gone[label] = self.node(label).join(paths, F.col("file_path") == F.col("_p"), "left_semi").select(F.col(spec.key).alias("_k"))
                out[spec.table] = self.node(label).join(paths, F.col("file_path") == F.col("_p"), "left_anti")
        for label, keys in gone.items():
            for e in edges_of(label):
                if e.table not in self.tables:
                    continue
                df = out.get(e.table, self.tables[e.table])
                if e.src == label:
                    df = df.join(keys, F.col(e.src_col) == F.col("_k"), "left_anti")
                if e.dst == label:
                    df = df.join(keys, F.col(e.dst_col) == F.col("_k"), "left_anti")
                out[e.table] = df
        for e in EDGES.values():
            if e.src == "File" and e.table in self.tables:
                out[e.table] = out.get(e.table, self.tables[e.table]).join(paths, F.col(e.src_col) == F.col("_p"), "left_anti")
        for name, column in (("call_site", "file_path"), ("name_ref", "file_path"), ("file_stamp", "path"), ("rationale", "file_path")):
            if name in self.tables:
                out[name] = self.tables[name].join(paths, F.col(column) == F.col("_p"), "left_anti")
        return self._with(**out)

    def delete_file_completely(self, files: DataFrame) -> GraphStore:
        """Purges the files, their File rows and every edge into them."""
        paths = files.select(F.col("path").alias("_p")).distinct()
        s = self.purge_file_data(files)
        out = {"file": s.node("File").join(paths, F.col("path") == F.col("_p"), "left_anti")}
        for e in EDGES.values():
            if e.dst == "File" and e.table in s.tables:
                out[e.table] = s.tables[e.table].join(paths, F.col(e.dst_col) == F.col("_p"), "left_anti")
        return s._with(**out)

    def _replace(self, name: str, column: str, files: DataFrame, rows: DataFrame) -> GraphStore:
        paths = files.select(F.col("path").alias("_p")).distinct()
        kept = self.side(name).join(paths, F.col(column) == F.col("_p"), "left_anti")
        return self._with(**{name: kept.unionByName(rows.join(paths, F.col(column) == F.col("_p"), "left_semi"), allowMissingColumns=True)})

    def replace_rationale(self, files: DataFrame, rows: DataFrame) -> GraphStore:
        return self._replace("rationale", "file_path", files, rows)

    def replace_name_refs(self, files: DataFrame, rows: DataFrame) -> GraphStore:
        return self._replace("name_ref", "file_path", files, rows)

    def replace_call_sites(self, files: DataFrame, rows: DataFrame) -> GraphStore:
        return self._replace("call_site", "file_path", files, rows.na.fill(""))

    def stamp_files(self, stamps: DataFrame) -> GraphStore:
        """Marks files as written completely (``path, mtime``)."""
        return self._replace("file_stamp", "path", stamps, stamps)

    def delete_calls(self, pairs: DataFrame) -> GraphStore:
        return self._with(edge_calls=self.edge("CALLS").join(pairs.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti"))

    # ---- reads

    def find_nodes(self, label: str, where: dict | None = None, contains: dict[str, str] | None = None, fields: list[str] | None = None, order_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Equality filters are AND-ed, substring filters OR-ed; a limit needs an order, the key breaks ties."""
        df, spec = self.node(label), NODES[label]
        for c, v in (where or {}).items():
            df = df.where(F.col(c) == F.lit(v))
        if contains:
            df = df.where(reduce(lambda a, b: a | b, [like_any(c, v) for c, v in contains.items()]))
        if order_by or limit:
            df = df.orderBy(*[F.col(c).asc_nulls_last() for c in (order_by or [])], spec.key)
        if limit:
            df = df.limit(limit)
        return df.select(*fields) if fields and fields != ["*"] else df

    def find_node_keys(self, label: str, field: str, value) -> DataFrame:
        return self.node(label).where(F.col(field) == F.lit(value)).select(NODES[label].key)

    def query_node_field(self, label: str, key, field: str):
        r = self.node(label).where(F.col(NODES[label].key) == F.lit(key)).select(field).first()
        return None if r is None else r[0]

    def list_node_fields(self, label: str, fields: list[str]) -> DataFrame:
        return self.node(label).select(*fields)

    def count_nodes(self, label: str, where: dict | None = None) -> int:
        return self.find_nodes(label, where).count()

    def count_edges(self, name: str) -> int:
        return self.edge(name).count()

    def _in(self, df: DataFrame, column: str, values) -> DataFrame:
        if isinstance(values, DataFrame):
            return df.join(values.select(F.col(values.columns[0]).alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_semi")
        vals = sorted({v for v in values if v is not None})
        if len(vals) <= MOST_LITERALS:
            return df.where(F.col(column).isin(vals))
        return self._in(df, column, self.spark.createDataFrame([(v,) for v in vals], "v string"))

    def node_keys_matching(self, label: str, field: str, values) -> DataFrame:
        return self._in(self.node(label), field, values).select(F.col(NODES[label].key).alias("key"), F.col(field).alias("value"))

    def find_nodes_without_incoming(self, label: str, edge: str, contains: dict[str, str] | None = None, exclude_prefix: str | None = None, fields: list[str] | None = None) -> DataFrame:
        """Nodes no edge points at; substring filters are AND-ed, the prefix is literal."""
        spec, e = NODES[label], EDGES[edge]
        ends = self.edge(edge).select(F.col(e.dst_col).alias("_k")).where(F.col("_k").isNotNull()).distinct()
        df = self.node(label)
        if exclude_prefix:
            df = df.where(~F.col("name").startswith(exclude_prefix))
        for c, v in (contains or {}).items():
            df = df.where(like_any(c, v))
        return df.join(ends, F.col(spec.key) == F.col("_k"), "left_anti").select(*(fields or [spec.key, "name", "file_path", "start_line", "end_line"]))

    def find_neighbors(self, edge: str, src_where: dict | None = None, dst_where: dict | None = None, src_fields: list[str] = (), dst_fields: list[str] = (), edge_fields: list[str] = ()) -> DataFrame:
        """Edges joined with both ends (dangling ones drop out), columns prefixed ``src_``, ``dst_``, ``edge_``."""
        spec = EDGES[edge]
        a, b = self._end(spec, "src", src_where, src_fields), self._end(spec, "dst", dst_where, dst_fields)
        e = self.edge(edge).select(F.col(spec.src_col).alias("_a"), F.col(spec.dst_col).alias("_b"), *[F.col(c).alias(f"edge_{c}") for c in edge_fields])
        out = [f"src_{c}" for c in src_fields] + [f"dst_{c}" for c in dst_fields] + [f"edge_{c}" for c in edge_fields]
        return e.join(a, "_a").join(b, "_b").select(*(out or [F.col("_b").alias(f"dst_{NODES[spec.dst].key}")]))

    def _end(self, spec: EdgeType, side: str, where: dict | None, fields: list[str]) -> DataFrame:
        label = spec.src if side == "src" else spec.dst
        df = self.find_nodes(label, where)
        return df.select(F.col(NODES[label].key).alias("_a" if side == "src" else "_b"), *[F.col(c).alias(f"{side}_{c}") for c in fields])

    # ---- references by name

    def name_refs_into(self, names, exclude_file: str) -> DataFrame:
        return self._in(self.side("name_ref"), "name", names).where(F.col("file_path") != exclude_file)

    def name_refs_of_kind(self, kind: str) -> DataFrame:
        return self.side("name_ref").where(F.col("kind") == kind).select("from_id", "name", "extra").orderBy("from_id", "name", "extra")

    def name_refs_from(self, kind: str, paths) -> DataFrame:
        return self._in(self.side("name_ref").where(F.col("kind") == kind), "file_path", paths).select("file_path", "name").distinct()

    def call_sites_into(self, names, ids, exclude_file: str) -> DataFrame:
        """Sites that call an unresolved name of ``names``, or resolved into ``ids``, outside the file; a site that is both comes twice."""
        s = self.side("call_site").where(F.col("file_path") != exclude_file)
        return self._in(s.where("to_id = ''"), "name", names).unionByName(self._in(s, "to_id", ids)).na.fill("")

    def call_sites_from(self, ids) -> DataFrame:
        return self._in(self.side("call_site"), "from_id", ids).na.fill("")

    def function_defs_named(self, names) -> DataFrame:
        return self._in(self.node("Function"), "name", names).select("id", "name", "file_path")

    def call_targets_named(self, names) -> DataFrame:
        """Functions of the names with their class and the names that class inherits from."""
        f = self.function_defs_named(names)
        h = self.edge("HAS_METHOD").select(F.col("from_id").alias("class_id"), F.col("to_id").alias("id"))
        r = self.side("name_ref").where("kind = 'inherits'").select(F.col("from_id").alias("class_id"), F.col("name").alias("base"))
        return f.join(h, "id", "left").join(r, "class_id", "left").groupBy("id", "name", "file_path").agg(F.coalesce(F.min("class_id"), F.lit("")).alias("class_id"), F.array_sort(F.collect_set("base")).alias("bases"))

    def class_bases_named(self, names) -> DataFrame:
        r = self.side("name_ref").where("kind = 'inherits'").select(F.col("from_id").alias("id"), F.col("name").alias("base"))
        return self._in(self.node("Class"), "name", names).select("id", "name").join(r, "id").select("name", "base").distinct()

    def class_children_named(self, names) -> DataFrame:
        """Classes that inherit from one of the names, also written with a module before it."""
        r = self.side("name_ref").where("kind = 'inherits'").select(F.col("from_id").alias("id"), F.col("name").alias("base")).withColumn("last", F.substring_index("base", ".", -1))
        return self._in(r, "last", names).join(self.node("Class").select("id", "name"), "id").select("name", "base").distinct()

    def call_site_names_on(self, classes) -> DataFrame:
        return self._in(self.side("call_site").where("to_id = '' and kind = 'cls'"), "ctx", classes).select("name").distinct()

    def function_names_in(self, file_path: str) -> DataFrame:
        return self.node("Function").where(F.col("file_path") == file_path).select("name").distinct()

    def calls_by_name(self, names, exclude_file: str) -> DataFrame:
        """Call edges that rest on a name: from a function with an unresolved site of the names, to a function so named."""
        sites = self._in(self.side("call_site").where((F.col("to_id") == "") & (F.col("file_path") != exclude_file)), "name", names).select("from_id").distinct()
        ends = self.function_defs_named(names).select(F.col("id").alias("to_id")).distinct()
        return self.edge("CALLS").select("from_id", "to_id").join(sites, "from_id", "left_semi").join(ends, "to_id", "left_semi")

    def unstamped_files(self) -> tuple[DataFrame, DataFrame]:
        """(files whose write stamp is missing or older, paths that data refers to without a file)."""
        f = self.node("File").select("path", "mtime")
        s = self.side("file_stamp").select(F.col("path").alias("_p"), F.col("mtime").alias("_m"))
        stale = f.join(s, F.col("path") == F.col("_p"), "left").where(F.col("_p").isNull() | ~F.col("_m").eqNullSafe(F.col("mtime"))).select("path")
        refs = self.side("call_site").select(F.col("file_path").alias("path")).union(self.side("name_ref").select("file_path")).union(self.side("file_stamp").select("path")).distinct()
        return stale, refs.join(f, "path", "left_anti").select("path")

    def rationale_rows(self, symbol: str = "", file_suffix: str = "", tag: str = "", symbol_ids=None, file_paths=None, limit: int = 0) -> DataFrame:
        df = self.side("rationale")
        if symbol:
            df = df.where(F.col("symbol") == symbol)
        if file_suffix:
            df = df.where(F.col("file_path").like("%" + escape_like(file_suffix), "!"))
        if tag:
            df = df.where(F.upper("tag") == tag.upper())
        if symbol_ids is not None:
            df = self._in(df, "symbol_id", symbol_ids)
        if file_paths is not None:
            df = self._in(df, "file_path", file_paths)
        df = df.orderBy("file_path", "line")
        return df.limit(limit) if limit else df
