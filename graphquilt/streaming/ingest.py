"""Incremental ingestion: file changes applied batch by batch, counters and per-session dedup as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def newest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of each key within a micro-batch, combined map-side."""
    rest = [c for c in batch.columns if c != key]
    r = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_r"))
    return r.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def apply_changes(store: DataFrame, batch: DataFrame, key: str, order: str, deleted: str = "deleted") -> DataFrame:
    """The store after a batch: changed keys replaced, deleted ones gone.  Applying batches in turn equals one rebuild."""
    last = newest(batch, key, order)
    return store.join(last.select(key), key, "left_anti").unionByName(last.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted).select(*store.columns))


#: Parts of a store; a batch rewrites those that hold one of its keys.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """The version in which each part was last written, as of a version: at most as many rows as parts."""
    if version < 0:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{folder}/manifest/v={version}").collect()}


def snapshot(spark: SparkSession, folder: str, schema: T.StructType, version: int, buckets: list[int] | None = None) -> DataFrame:
    """The store as of a version, or some parts of it."""
    at = _manifest(spark, folder, version)
    paths = [f"{folder}/data/v={v}/bucket={b}" for b, v in sorted(at.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest_version(spark: SparkSession, folder: str) -> int:
    """The last version whose manifest is complete, or -1."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return -1
    done = [int(x.getPath().getName()[2:]) for x in fs.listStatus(at) if x.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return max(done, default=-1)


def ingest(changes: DataFrame, folder: str, checkpoint: str, key: str, order: str, available_now: bool = True, seconds: float = 0.3, buckets: int = BUCKETS) -> StreamingQuery:
    """Runs a stream of changes (rows with ``deleted``) into a versioned parquet store under ``folder``.

    The store is parted by a hash of the key; each batch reads and rewrites only the
    parts that hold one of its keys and writes a manifest that names the version of
    every part.  A replayed batch starts from the same manifest and rewrites the same
    version, so results are exactly once; parts no manifest names may be removed.
    """
    schema = T.StructType([f for f in changes.schema.fields if f.name != "deleted"])

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _manifest(spark, folder, batch_id - 1)
        touched = sorted(r[0] for r in batch.where(F.col(key).isNotNull()).select(_bucket(key, buckets)).distinct().collect())
        old = snapshot(spark, folder, schema, batch_id - 1, touched)
        new = apply_changes(old, batch, key, order)
        new.withColumn("bucket", _bucket(key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/v={batch_id}")
        # a part that lost its last row has no folder and leaves the manifest
        left = {r[0] for r in spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{folder}/data/v={batch_id}").select("bucket").distinct().collect()} if touched else set()
        now = {**{b: v for b, v in known.items() if b not in touched}, **{b: batch_id for b in left}}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v={batch_id}")

    w = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds} seconds")).start()


def call_stream(spark: SparkSession, path: str, schema: T.StructType, most_files: int = 100) -> DataFrame:
    """The event log as a stream of parquet files, with an event time."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # the file source takes folders: a single file is picked out of its own
        s = r.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    else:
        s = r.parquet(path)
    return s.withColumn("event_time", F.timestamp_seconds("timestamp"))


def daily_counters(events: DataFrame, late: str = "400 days") -> DataFrame:
    """Calls and errors per day and tool; deliveries of one id count once within the watermark."""
    e = events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])
    return e.groupBy(F.window("event_time", "1 day").alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("success") == 0, 1)).alias("errors")).select(F.to_date("w.start").alias("day"), "tool", "calls", "errors")


def first_mentions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Items (session_id, kind, key) the first time a session sees them."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["session_id", "kind", "key"])


def to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete", key: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its result table.

    ``complete`` keeps the last batch's table; ``update`` the last row of each key.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/b={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).option("recursiveFileLookup", True).parquet(folder)
    if mode == "complete":
        return out.where(F.col("_batch") == out.agg(F.max("_batch")).scalar()).drop("_batch")
    w = Window.partitionBy(*key).orderBy(F.desc("_batch"))
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_batch")


def scan_queue(changed: DataFrame, done: DataFrame) -> DataFrame:
    """Contents waiting for a deferred scanner, once per blob."""
    return changed.select("git_blob_sha").where("git_blob_sha is not null").distinct().join(done.select("git_blob_sha").distinct(), "git_blob_sha", "left_anti")
