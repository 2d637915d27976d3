"""Sinks: parquet snapshots, GraphML, Mermaid, DOT and knowledge JSONL."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Diagrams are for eyes: so many links are drawn, the heaviest first (the feature's own cap).
MOST_DRAWN = 400


def snapshot(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replaces a table, or only the partitions that ``df`` has."""
    w = df.write.mode("overwrite")
    if partition:
        w = w.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as GraphML text files in a folder: one head, node and edge elements in parallel parts, one tail.

    ``nodes`` has ``id`` and properties, ``edges`` ``src, dst`` and properties;
    concatenated in name order the parts are one document.
    """

    def attrs(df: DataFrame, skip: tuple[str, ...]) -> list[str]:
        return [c for c in df.columns if c not in skip]

    def text(c: str):
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    def data(df: DataFrame, skip: tuple[str, ...]):
        return [F.concat(F.lit(f"<data key={quoteattr(c)}>"), text(c), F.lit("</data>")) for c in attrs(df, skip)]

    n = nodes.select(F.concat(F.lit('<node id="'), text("id"), F.lit('">'), *data(nodes, ("id",)), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('">'), *data(edges, ("src", "dst")), F.lit("</edge>")).alias("value"))
    kinds = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for df, what, skip in ((nodes, "node", ("id",)), (edges, "edge", ("src", "dst"))):
        head += [f"<key id={quoteattr(c)} for=\"{what}\" attr.name={quoteattr(c)} attr.type=\"{kinds.get(t, 'string')}\"/>" for c, t in df.dtypes if c not in skip]
    head.append('<graph edgedefault="directed">')
    spark = nodes.sparkSession
    for name, df in (("a-head", spark.createDataFrame([("\n".join(head),)], "value string")), ("b-nodes", n), ("c-edges", e), ("d-tail", spark.createDataFrame([("</graph>\n</graphml>",)], "value string"))):
        df.write.mode("overwrite").text(f"{path}/{name}")


def _drawn(links: DataFrame, most: int) -> list:
    return links.orderBy(F.desc("weight"), "src", "dst").limit(most).collect()


def _short(path: str) -> str:
    return "/".join(path.split("/")[-2:])


def mermaid(links: DataFrame, most: int = MOST_DRAWN) -> str:
    """Links ``src, dst, weight`` as a Mermaid flow chart."""
    rows = _drawn(links, most)
    ids = {p: f"n{i}" for i, p in enumerate(sorted({r.src for r in rows} | {r.dst for r in rows}))}
    out = ["graph LR", *(f'  {v}["{_short(k).replace(chr(34), chr(39))}"]' for k, v in ids.items())]
    return "\n".join([*out, *(f"  {ids[r.src]} -->|{r.weight:g}| {ids[r.dst]}" for r in rows)])


def dot(links: DataFrame, most: int = MOST_DRAWN) -> str:
    """The same for Graphviz."""
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "\n".join(["digraph g {", "  rankdir=LR;", *(f"  {q(r.src)} -> {q(r.dst)} [weight={r.weight:g}];" for r in _drawn(links, most)), "}"])


def html(links: DataFrame, title: str, most: int = MOST_DRAWN) -> str:
    """A page with the chart as text, for a viewer that renders Mermaid."""
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><pre class='mermaid'>\n{escape(mermaid(links, most))}\n</pre></body></html>"


def export_notes(notes: DataFrame, path: str, since: float | None = None, tag: str = "", kind: str = "") -> None:
    """Notes as JSON lines."""
    n = notes
    if since is not None:
        n = n.where(F.col("ts") >= since)
    if kind:
        n = n.where(F.col("kind") == kind)
    if tag:
        n = n.where(F.array_contains(F.split("tags", r"[,\s]+"), tag))
    n.write.mode("overwrite").json(path)


def import_notes(spark: SparkSession, path: str, store: DataFrame) -> DataFrame:
    """The store with the notes of JSON lines it does not hold yet, told by title and body."""
    new = spark.read.schema(store.schema).json(path)
    key = F.sha2(F.concat_ws("\x00", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))), 256)
    return store.unionByName(new.withColumn("_k", key).dropDuplicates(["_k"]).join(store.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k"))
