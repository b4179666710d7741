"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any scale. Partition counts are left to AQE: it starts from
# `initialPartitionNum` and coalesces, so a small input does not pay for a large setting.
TUNED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # no call site for each Column: large expressions are built in half the time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


SHUFFLE_BYTES = 128 * 2**20


def shuffle_partitions(shuffled_bytes: int, cores: int) -> int:
    """Shuffle partitions of about 128 MiB, at least two per core. AQE merges small ones."""
    return max(2 * cores, -(-shuffled_bytes // SHUFFLE_BYTES))


def build_session(app_name: str = "capture-analytics", master: str | None = None,
                  **overrides: str) -> SparkSession:
    """A session with the tuned settings; `master` is only given for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**TUNED, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    It is named in `spark.checkpoint.dir`, or was set on the context. Where neither is, it lies in the
    warehouse, if the session's executors share that: a warehouse on a machine of a cluster is an
    error, since the checkpoint would be lost together with the machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context.getCheckpointDir():
        return context.getCheckpointDir()
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not context.master.startswith("local") and urlsplit(warehouse).scheme in ("", "file"):
            raise ValueError("spark.checkpoint.dir does not name a shared folder")
        folder = f"{warehouse.rstrip('/')}/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
