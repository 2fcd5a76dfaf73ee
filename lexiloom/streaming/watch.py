"""Watching for changes with Structured Streaming: debounced sessions of change events, and incremental runs for each batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.durable import scratch
from lexiloom.operators.changes import is_supported


def source_events(events: DataFrame, path: str = "path") -> DataFrame:
    """Events of source files only."""
    return events.where(is_supported(F.col(path)))


def debounced(events: DataFrame, ts: str = "ts", path: str = "path", gap: str = "500 milliseconds", keys: list[str] | None = None, watermark: str | None = "10 seconds", paths: bool = True) -> DataFrame:
    """(keys, first_ms, last_ms, events, changed): one row for each burst of events, which a silence of gap ends; without paths their number, files, instead of changed.

    Works on batches and, with a watermark, on streams in append mode, where a burst appears once it can't grow.
    """
    keys = keys or []
    if not events.isStreaming:
        return _bursts(events, ts, path, gap, keys, paths)
    e = events.withWatermark(ts, watermark) if watermark else events
    out = e.groupBy(F.session_window(ts, gap), *keys).agg(F.min(F.unix_millis(ts)).alias("first_ms"), F.max(F.unix_millis(ts)).alias("last_ms"), F.count(F.lit(1)).alias("events"), F.collect_set(path).alias("changed"))
    return out.select(*keys, "first_ms", "last_ms", "events", "changed" if paths else F.size("changed").cast("long").alias("files"))


def _bursts(events: DataFrame, ts: str, path: str, gap: str, keys: list[str], paths: bool) -> DataFrame:
    """The bursts of a batch. Events in one slot as wide as the gap are of one burst, so only slots are put in order, and a
    burst of any size is many rows of slots and paths until its end; session windows merge the sets of one key's bursts event by event."""
    width = f"unix_micros(timestamp_micros(0L) + interval '{gap}')"
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.where(F.col(ts).isNotNull()).select(*keys, F.col(path).alias("__path"), us.alias("__us")).withColumn("__slot", F.expr(f"__us - pmod(__us, {width})"))
    each = [F.min("__us").alias("__lo"), F.max("__us").alias("__hi")]
    w = Window.partitionBy(*keys).orderBy("__slot")
    opens = F.coalesce(F.col("__lo") - F.lag("__hi").over(w) >= F.expr(width), F.lit(True)).cast("long")
    slots = e.groupBy(*keys, "__slot").agg(*each).withColumn("__opens", opens).withColumn("__burst", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slots = slots.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__slot").alias("__at"), "__burst")
    own = e.groupBy(*keys, "__slot", "__path").agg(*each, F.count(F.lit(1)).alias("__n"))
    same = F.col("__slot") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    what = F.collect_set("__path").alias("changed") if paths else F.countDistinct("__path").alias("files")
    out = own.join(slots, same).groupBy(*keys, "__burst").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum("__n").alias("events"), what)
    ms = lambda c: F.unix_millis(F.timestamp_micros(c))
    return out.select(*keys, ms("__lo").alias("first_ms"), ms("__hi").alias("last_ms"), "events", "changed" if paths else "files")


def watch(events: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "500 milliseconds"):
    """Start a query that calls reindex with the distinct changed paths of each micro-batch; a batch that is run again must give the same index."""
    changed = source_events(events).select("path")

    def each(batch: DataFrame, number: int) -> None:
        paths = batch.distinct()
        if not paths.isEmpty():
            reindex(paths, number)

    return changed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def replay(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, first_ms, last_ms, events): the debounced bursts of a table of events, run as a stream to its end and read from its sink."""
    folder, name = path.rpartition("/")[0], path.rpartition("/")[2]
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    events = source.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("path"), "event_type")
    out = scratch(spark, f"bursts-{uuid.uuid4().hex[:8]}")
    bursts = debounced(events, gap="10 minutes", keys=["event_type"], watermark=None).select("event_type", "first_ms", "last_ms", "events")

    ran: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        ran.append(number)
        batch.write.mode("overwrite").parquet(out + "/rows")

    # the end of a table closes its bursts, which a watermark would leave open; and no late event is dropped
    q = bursts.writeStream.foreachBatch(each).option("checkpointLocation", out + "/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = "event_type string, first_ms long, last_ms long, events long"
    if not ran:  # no event at all, so no batch
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out + "/rows")
