"""Polled queues as streams: captures on hold, and posts waiting for a score.

Each micro-batch is written under its batch id, so a batch that is run again after a lost
executor or a restart replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from capture_analytics.functions.urls import is_known_tracker, unwrap_url
from capture_analytics.operators.dedup import queue_age, queue_head
from capture_analytics.operators.profiles import batch_summary, with_profile
from capture_analytics.sources.sinks import append_records, append_trace
from capture_analytics.streaming.state import score_queue

# Pace of the two queues (fixed values).
HOLD_INTERVAL = "30 seconds"
SCORE_INTERVAL = "30 minutes"
SCORE_LIMIT = 5
# How long a dispatched capture is remembered, and parts of the state of posts that wait for a score.
HOLD_WITHIN = "1 day"
SCORE_PARTS = 64


def dispatch(scrapes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Captures on hold with the address to open, their profile and their next status."""
    held = scrapes.where(F.col("status") == "hold").select("scrape_id", "url")
    empty = F.coalesce("url", F.lit("")) == ""
    opened = held.withColumn("target_url", F.when(~empty, unwrap_url(F.col("url"))))
    classified = opened.withColumns({
        "from_tracker": F.coalesce(is_known_tracker(F.col("url")), F.lit(False)),
        "status": F.when(empty, F.lit("failed")).otherwise(F.lit("running")),
        "note": F.when(empty, F.lit("No URL provided")).otherwise(F.lit("Poller picked up"))})
    known = profiles.select("id", "hostname", F.col("id").alias("profile_id"))
    return with_profile(classified, known, "target_url")


def _trigger(interval: str | None) -> dict:
    return {"processingTime": interval} if interval else {"availableNow": True}


def hold_stream(scrapes: DataFrame, profiles: Callable[[], DataFrame], out: str, checkpoint: str,
                interval: str | None = HOLD_INTERVAL, within: str = HOLD_WITHIN) -> StreamingQuery:
    """Dispatch captures on hold as they arrive, each once; each written file of a batch is in id order.

    A capture that arrives on hold again `within` that time, in the same batch or a later one, is not
    dispatched again; its id is forgotten afterwards. Profiles are read anew for every batch, they
    change while the stream runs. Without an interval the stream works off what is there and stops.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        ready = dispatch(batch, profiles())
        append_records(ready.sortWithinPartitions("scrape_id"), out, batch_id)

    # the time of the batch, which the stream's log keeps: a batch that runs again has the same
    held = scrapes.where(F.col("status") == "hold").withColumn("_seen", F.current_timestamp())
    once = held.withWatermark("_seen", within).dropDuplicatesWithinWatermark(["scrape_id"]).drop("_seen")
    return (once.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
            .trigger(**_trigger(interval)).start())


def hold_summary(results: DataFrame) -> DataFrame:
    """Found and started captures per polling pass."""
    return batch_summary(results.withColumn("succeeded", F.col("status") == "running"), "batch")


def score_stream(scrapes: DataFrame, scores: DataFrame, out: str, checkpoint: str,
                 limit: int = SCORE_LIMIT, interval: str | None = SCORE_INTERVAL,
                 parts: int = SCORE_PARTS) -> StreamingQuery:
    """The next posts to score after each batch of captures and scores, as `score_batch` of all that has
    arrived, without reading any of it again.

    Posts are kept in `parts` of state: which have a score, and the captures of the others. A part
    that changes gives its first `2 * limit` captures; the heads of all parts, a table of at most
    parts x 2 x limit rows below `out`, hold the first of all posts.
    """
    done = scrapes.where((F.col("status") == "completed") & F.col("job_post_id").isNotNull()).select(
        "job_post_id", queue_age().alias("age"), "scrape_id", F.lit(False).alias("scored"))
    known = scores.where(F.col("post_id").isNotNull()).select(
        F.col("post_id").alias("job_post_id"), F.lit(0).cast("bigint").alias("age"),
        F.lit(0).cast("bigint").alias("scrape_id"), F.lit(True).alias("scored"))
    heads = score_queue(done.unionByName(known), limit, parts)

    def work(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{out}/_heads"
        changed = batch.persist()
        try:
            current = changed
            if batch_id:
                before = spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}")
                current = before.join(changed.select("part").distinct(), "part", "left_anti").unionByName(
                    changed)
            # written before it is used: a batch that runs again replaces both
            current.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            heads_now = spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}")
            append_records(queue_head(heads_now.where("job_post_id is not null").select(
                "job_post_id", "age", "scrape_id"), limit), f"{out}/picked", batch_id)
            _forget(spark, f"{path}/batch={batch_id - 2}")
        finally:
            changed.unpersist()

    return (heads.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
            .trigger(**_trigger(interval)).start())


def _forget(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trace_stream(transitions: DataFrame, out: str, checkpoint: str,
                 interval: str | None = None) -> StreamingQuery:
    """Append transitions as they arrive; rows without a scrape are dropped."""
    return (transitions.writeStream
            .foreachBatch(lambda batch, batch_id: append_trace(batch, out, batch_id))
            .option("checkpointLocation", checkpoint).trigger(**_trigger(interval)).start())


def files(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None,
          bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """Stream of the parquet files of a folder. The bytes of a micro-batch are bounded, and with
    them the rows of one key that state handles at a time; or the number of files, if given."""
    limit = (("maxBytesPerTrigger", bytes_per_trigger) if per_trigger is None
             else ("maxFilesPerTrigger", per_trigger))
    return spark.readStream.schema(schema).option(*limit).parquet(path)
