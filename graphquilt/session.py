"""Session helpers: local test sessions, worker imports, shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables written by ``materialise`` and not cleaned up yet.
_WRITTEN: list[str] = []
_ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = 4, name: str = "graphquilt", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; production passes its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def importable(spark: SparkSession) -> None:
    """Lets Python workers that see this checkout import the package (a no-op where it is installed)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([x for x in (have, _ROOT) if x])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process (tests), a temporary
    folder is set as the checkpoint directory and used; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return str(jsc.getCheckpointDir().get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphquilt-"))
    return str(jsc.getCheckpointDir().get()).rstrip("/")


def materialise(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Used where a plan must be computed exactly once (range bounds, iterations):
    the files outlive any executor, so a lost one re-reads instead of re-deriving
    different partitions.  Rows keep no order; order must be a column.  ``by`` names
    columns whose values become folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphquilt-{label}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    _WRITTEN.append(path)
    # the schema is known: folders' values keep their type and empty tables their columns
    names = [c for c in df.columns if c not in (by or [])] + (by or [])
    return spark.read.schema(df.select(*names).schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for costly work on few bytes.

    An explicit number is not merged again by adaptive execution, which sizes
    partitions by bytes and so hands long-running Python work to a few tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n)


def cleanup(spark: SparkSession) -> int:
    """Removes the intermediate tables this process wrote; call it when no result built on them is needed."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint (never a local one)."""
    shared_dir(df.sparkSession)
    jsc = df.sparkSession.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
