"""Structured Streaming jobs: status by document, counted chunks, request limits, event windows."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.cluster import shared_dir

# Messages


def object_events(messages: DataFrame, value: str = "value", extensions: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """bucket, key, version, document_id, event_time of object-created records with a wanted extension.

    Works on batches and streams; messages that aren't JSON or have no records give no rows.
    """
    record = "struct<eventTime:string,s3:struct<bucket:struct<name:string>,object:struct<key:string,versionId:string>>>"
    rows = messages.select(F.explode(F.from_json(F.col(value), f"struct<Records:array<{record}>>")["Records"]).alias("r"))
    version = F.nullif(F.nullif(F.trim("r.s3.object.versionId"), F.lit("")), F.lit("null"))
    key = F.try_url_decode(F.col("r.s3.object.key"))
    flat = rows.select(F.col("r.s3.bucket.name").alias("bucket"), key.alias("key"), version.alias("version"), F.try_to_timestamp("r.eventTime").alias("event_time"))
    kept = flat.where(F.lower(F.substring_index("key", ".", -1)).isin(*extensions) & F.col("bucket").isNotNull())
    return kept.select("bucket", "key", "version", F.concat(F.concat_ws("/", "bucket", "key"), F.coalesce(F.concat(F.lit("#"), "version"), F.lit(""))).alias("document_id"), "event_time")


def stage_updates(messages: DataFrame, value: str = "value") -> DataFrame:
    """document_id, stage, status, at of status messages; the id is taken from the first of five places that has one."""
    v = F.col(value)
    places = ("$.document_id", "$.documentId", "$.document.id", "$.payload.document_id", "$.detail.document_id")
    doc = F.coalesce(*[F.nullif(F.trim(F.get_json_object(v, p)), F.lit("")) for p in places])
    return messages.select(doc.alias("document_id"), F.get_json_object(v, "$.stage").alias("stage"), F.get_json_object(v, "$.status").alias("status"), F.try_to_timestamp(F.get_json_object(v, "$.at")).alias("at")).where("document_id is not null and stage is not null")


def latest_stage_status(updates: DataFrame) -> DataFrame:
    """document_id, stage, status, at: the last write of each stage (stream or batch); the state is one row per stage of a document."""
    return updates.groupBy("document_id", "stage").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))


# Sinks


#: Parts into which an upserted table is divided by the digest of its keys.
PARTS = 64


def upsert_batches(spark: SparkSession, path: str, keys: list[str], order: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row per key (the last in ``order``, then all columns) in a Parquet table.

    The table is divided by the digest of the keys; a batch reads and rewrites only the parts
    it hits, as ``part=<n>/v=<batch>``, beside which the part's versions older than the one
    it was made of are removed. A batch that is delivered again starts from the versions
    before it, so the result is the same (idempotent). Gaps in batch numbers do no harm.
    """
    fs, folder = _files(spark, path)

    def versions(part: int) -> list[int]:
        place = folder(f"{path}/part={part}")
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(place) if fs.exists(folder(f"{s.getPath().toString()}/_SUCCESS"))) if fs.exists(place) else []

    def apply(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        try:
            for (part,) in marked.select("__part").distinct().collect():  # at most ``parts``
                rows = marked.where(F.col("__part") == part).drop("__part")
                before = [v for v in versions(part) if v < number]
                if before:
                    rows = spark.read.parquet(f"{path}/part={part}/v={before[-1]}").unionByName(rows, allowMissingColumns=True)
                rest = [c for c in rows.columns if c not in (*keys, order)]
                newest = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("__r")).select(*keys, "__r.*").select(*rows.columns)
                newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}/v={number}")
                for v in before[:-1]:
                    fs.delete(folder(f"{path}/part={part}/v={v}"), True)
        finally:
            marked.unpersist()

    return apply


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path
    return folder(path).getFileSystem(spark._jsc.hadoopConfiguration()), folder


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every part of a table kept by :func:`upsert_batches`."""
    fs, folder = _files(spark, path)
    paths = []
    for part in fs.listStatus(folder(path)):
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(part.getPath()) if fs.exists(folder(f"{s.getPath().toString()}/_SUCCESS"))]
        if done:
            paths.append(f"{part.getPath().toString()}/v={max(done)}")
    return spark.read.parquet(*paths)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available now and return what it wrote (of the last batch in complete mode)."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], stream.schema)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/n={number}")
        last.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return empty
    paths = [f"{base}/out/n={last[-1]}"] if mode == "complete" else [f"{base}/out/n={n}" for n in dict.fromkeys(last)]
    return spark.read.schema(stream.schema).parquet(*paths)


# Windows of events


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table as a stream (its time as a timestamp with zone, as watermarks need)."""
    whole = f"{folder}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(whole)
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(whole).schema)
    # a stream reads folders; of a table in one file, that file of its folder
    stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(whole)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Keys, hour, n, total per tumbling window; rows later than ``late`` behind the newest are dropped by a running stream."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(*keys, F.col("w.start").alias("hour"), "n", "total")


def distinct_events(stream: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


# Counted chunks


def counted_chunks(stream: DataFrame, key: str, size: int, flush_after: str = "10 minutes") -> DataFrame:
    """key, chunk_index, n, first_page, last_page for every ``size`` pages of a document, and the rest after a quiet time.

    The state of a document is the number of its chunks and the pages that wait, fewer than ``size``.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    minutes = int(flush_after.split()[0]) * 60_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, waiting = state.get if state.exists else (0, [])
        waiting, rows = list(waiting), []
        if state.hasTimedOut:
            if waiting:
                rows.append((k[0], number + 1, len(waiting), min(waiting), max(waiting)))
            state.remove()
        else:
            for pdf in batches:
                waiting += [int(x) for x in sorted(pdf["page_number"])]
            while len(waiting) >= size:
                number += 1
                head, waiting = waiting[:size], waiting[size:]
                rows.append((k[0], number, size, min(head), max(head)))
            state.update((number, waiting))
            state.setTimeoutDuration(minutes)
        yield pd.DataFrame(rows, columns=[key, "chunk_index", "n", "first_page", "last_page"])

    out = f"`{key}` string, chunk_index int, n int, first_page int, last_page int"
    return stream.groupBy(key).applyInPandasWithState(step, out, "number int, waiting array<int>", "append", GroupStateTimeout.ProcessingTimeTimeout)


# Request limits


def _decide(log: deque, now: float, most: int, window: float) -> int | None:
    while log and log[0] <= now - window:
        log.popleft()
    if len(log) >= most:
        return max(1, int(log[0] + window - now))
    log.append(now)
    return None


def limited(requests: DataFrame, keys: list[str], at: Column, ident: str, most: int, window: float) -> DataFrame:
    """keys, ident, retry_after: null where a request passes, else the seconds to wait.

    A sliding log of the requests let through per key; rejected ones aren't logged, so each
    decision depends on those before. Sorted rows are streamed through each task with a log
    of at most ``most`` times, so a busy client is never held in memory. Limits of zero or
    less let all pass.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    if most <= 0 or window <= 0:
        return requests.select(*keys, ident, F.lit(None).cast("int").alias("retry_after"))
    rows = requests.select(*keys, F.col(ident), at.cast("double").alias("__at")).where("__at is not null")
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, log = None, deque()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            waits = []
            for row in zip(*columns, strict=True):
                if row[:n] != key:
                    key, log = row[:n], deque()
                waits.append(_decide(log, row[-1], most, window))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(waits, pa.int32())], names=[*keys, ident, "retry_after"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, ident]) + ", retry_after int"
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "__at", ident).mapInArrow(run, schema)


def limit_log(times: list[float], most: int, window: float) -> list[int | None]:
    """Decisions for one client's times in order."""
    log: deque = deque()
    return [_decide(log, t, most, window) for t in times]


def chain(stages: list[Callable[[DataFrame], DataFrame]], df: DataFrame) -> DataFrame:
    """A pipeline of stages, each a function of a DataFrame."""
    for stage in stages:
        df = stage(df)
    return df


def stage_order(edges: DataFrame, source: str = "source", target: str = "target", most: int = 64) -> DataFrame:
    """stage, level of a graph of stages: the longest way from a stage without predecessors. Raises on a cycle."""
    stages = edges.select(F.col(source).alias("stage")).union(edges.select(target)).distinct()
    level = stages.join(edges.select(F.col(target).alias("stage")), "stage", "left_anti").withColumn("level", F.lit(0))
    out = level
    for n in range(1, most + 1):
        level = level.join(edges.select(F.col(source).alias("stage"), F.col(target).alias("__t")), "stage").select(F.col("__t").alias("stage")).distinct().withColumn("level", F.lit(n))
        if level.isEmpty():
            return out.groupBy("stage").agg(F.max("level").alias("level"))
        out = out.unionByName(level)
    raise ValueError("the stages form a cycle")
