"""Terraform blocks and what refers to what, from parsed definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def blocks(defs: DataFrame) -> DataFrame:
    """``id, name, kind, type, address, module_dir, file_path, start_line, end_line`` of every block; addresses hold within a folder."""
    d = defs.where(F.col("kind").isin("tf_resource", "tf_data", "tf_variable", "tf_output", "tf_module"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    return d.select(F.concat("path", F.lit("::"), "qualified").alias("id"), "name", F.regexp_replace("kind", "^tf_", "").alias("kind"), F.col("detail").alias("type"), F.col("qualified").alias("address"), folder.alias("module_dir"), F.col("path").alias("file_path"), "start_line", "end_line")


def references(defs: DataFrame, blks: DataFrame) -> DataFrame:
    """Edges from a block to the blocks of its folder that it names: ``src, dst``; the longest address that a reference starts with."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    r = defs.where("kind = 'tf_ref'").select(F.concat("path", F.lit("::"), "qualified").alias("src"), folder.alias("module_dir"), F.col("name").alias("ref"))
    parts = F.split("ref", r"\.")
    r = r.withColumn("address", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))))
    b = blks.select("module_dir", "address", F.col("id").alias("dst"))
    j = r.join(b, ["module_dir", "address"])
    return j.groupBy("src", "ref").agg(F.max_by("dst", F.length("address")).alias("dst")).where("src <> dst").select("src", "dst").distinct()


def users_of(edges: DataFrame, starts: DataFrame, max_depth: int = 8) -> DataFrame:
    """Blocks that depend on the starts, directly or through others."""
    return graph.reach(graph.reverse(edges), starts, max_depth)


def used_by(edges: DataFrame, starts: DataFrame, max_depth: int = 8) -> DataFrame:
    """Blocks the starts depend on."""
    return graph.reach(edges, starts, max_depth)


def impacted_files(edges: DataFrame, blks: DataFrame, ranges: DataFrame, max_depth: int = 8) -> DataFrame:
    """Files with a block that changed lines (``file_path, lo, hi``) reach: ``file_path, depth``."""
    hit = blks.join(ranges, "file_path").where("start_line <= hi and end_line >= lo").select("id").distinct()
    u = users_of(edges, hit, max_depth)
    return u.join(blks.select(F.col("id").alias("node"), "file_path"), "node").groupBy("file_path").agg(F.min("depth").alias("depth"))


def source_folder(module_dir: str, source: str) -> str | None:
    """The folder a local module source names, or None for a registry or remote one."""
    if not source.startswith("."):
        return None
    parts = [p for p in module_dir.split("/") if p]
    for step in source.split("/"):
        if step == "..":
            if not parts:
                return None
            parts.pop()
        elif step not in ("", "."):
            parts.append(step)
    return "/".join(parts)
