"""Tables laid out for what is read and written often: pages of a sort order, and patches by key.

An ordered table is written in ranges of its sort order, one folder each, with an index of one row per
range. A page, however deep, reads the index and the one or two ranges that hold it. A keyed
table is written in buckets of a key's hash; a change rewrites the buckets that hold a row it changes,
all other files stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capture_analytics.operators.records import apply_patch
from capture_analytics.session import checkpoint_dir
from capture_analytics.sources.sinks import html_if_empty

RANGE_ROWS = 1 << 20
MOST_RANGES = 1 << 10   # at most so many ranges; they grow with the rows beyond that
BUCKETS = 256
PART, BUCKET = "_part", "_bucket"


# ---- pages of a sort order ----------------------------------------------------------

def _order(sort: Sequence[tuple[str, bool]]) -> list[Column]:
    """Columns with whether they sort down; NULLs come first upwards and last downwards."""
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in sort]


def write_ordered(df: DataFrame, path: str, sort: Sequence[tuple[str, bool]],
                  range_rows: int = RANGE_ROWS) -> None:
    """Write `df` in ranges of its order. The last column of `sort` is to be unique.

    The driver hears of every range and of a sample of its rows, so ranges of a large table hold more
    than `range_rows` rows, rather than being ever more.
    """
    ranges = min(MOST_RANGES, -(-df.count() // range_rows)) or 1
    cut = df.repartitionByRange(ranges, *_order(sort)).withColumn(PART, F.spark_partition_id())
    cut.sortWithinPartitions(*_order(sort)).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    last = F.struct(*[F.col(c) for c, _ in sort])
    # the last row of a range: ranges are sorted, so it is the only one that no other row is behind
    inside = Window.partitionBy(PART).orderBy(*[F.col(c).asc() if down else F.col(c).desc() for c, down in sort])
    index = rows.select(PART, last.alias("last"), *[F.col(c) for c, _ in sort]).withColumn(
        "n", F.count("*").over(Window.partitionBy(PART))).withColumn("turn", F.row_number().over(inside))
    index.where("turn = 1").select(PART, "n", "last").write.mode("overwrite").parquet(f"{path}/index")


def _read(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    """Only the folders of these ranges are listed and read."""
    if not parts:
        return spark.read.parquet(f"{path}/rows").where(F.lit(False)).drop(PART)
    return spark.read.parquet(*[f"{path}/rows/{PART}={part}" for part in parts])


def read_page(spark: SparkSession, path: str, sort: Sequence[tuple[str, bool]], number: int,
              size: int) -> DataFrame:
    """Page `number`, counted from 1: what sorting and an offset give."""
    begin, end = (number - 1) * size, number * size
    index = spark.read.parquet(f"{path}/index")
    before = F.sum("n").over(Window.orderBy(PART)) - F.col("n")
    found = index.select(PART, "n", before.alias("before")).where(
        (F.col("before") < end) & (F.col("before") + F.col("n") > begin)).orderBy(PART).collect()
    skipped = begin - found[0]["before"] if found else 0
    return _read(spark, path, [r[PART] for r in found]).orderBy(*_order(sort)).offset(skipped).limit(size)


def behind(sort: Sequence[tuple[str, bool]], place: Sequence, row: Callable[[str], Column] = F.col) -> Column:
    """Whether a row comes after a place of the order, given by its values."""
    later, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(sort, place, strict=True):
        own, at = row(name), F.lit(value)
        if down:
            further = F.lit(False) if value is None else (own < at) | own.isNull()
        else:
            further = own.isNotNull() if value is None else own > at
        later = later | (equal & F.coalesce(further, F.lit(False)))
        equal = equal & own.eqNullSafe(at)
    return later


def read_after(spark: SparkSession, path: str, sort: Sequence[tuple[str, bool]], place: Sequence,
               size: int) -> DataFrame:
    """The `size` rows after a place: the next page, without counting what lies before it."""
    index = spark.read.parquet(f"{path}/index").where(behind(sort, place, lambda c: F.col("last")[c]))
    # the first of these ranges may hold a single row that is after the place
    order = Window.orderBy(PART)
    others = F.sum("n").over(order) - F.first("n").over(order) - F.when(
        F.row_number().over(order) > 1, F.col("n")).otherwise(0)
    parts = [r[PART] for r in index.select(PART, others.alias("before")).where(F.col("before") < size).collect()]
    return _read(spark, path, parts).where(behind(sort, place)).orderBy(*_order(sort)).limit(size)


# ---- changes by key -------------------------------------------------------------------

def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write `df` as one folder per bucket of its key."""
    df.withColumn(BUCKET, _bucket(key, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(
        BUCKET).parquet(path)


def change_buckets(spark: SparkSession, path: str, keys: DataFrame,
                   change: Callable[[DataFrame], DataFrame], key: str, buckets: int = BUCKETS) -> list[int]:
    """Rewrite the buckets in which `change` alters a row, and return their numbers.

    `keys` holds, in its only column, the keys that may be altered; only their buckets are read. The new
    rows are written to the shared folder first, so a task that runs again reads the old files, or
    rows that are already there; the folders of the buckets are replaced together at the end. A change
    that is applied again alters nothing and so writes nothing.
    """
    touched = [r[0] for r in keys.select(F.col(keys.columns[0]).alias(key)).select(
        _bucket(key, buckets)).distinct().collect()]
    if not touched:
        return []
    table = spark.read.parquet(path)
    old = table.where(F.col(BUCKET).isin(touched))
    columns = [c for c in table.columns if c != BUCKET]
    staged = f"{checkpoint_dir(spark).rstrip('/')}/change-{uuid.uuid4().hex}"
    change(old.drop(BUCKET)).select(*columns).withColumn(BUCKET, _bucket(key, buckets)).write.partitionBy(
        BUCKET).parquet(staged)
    new = spark.read.schema(table.schema).parquet(staged)

    def digest(rows: DataFrame) -> DataFrame:
        # the same rows in any order have the same digest
        return rows.groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast(
            "decimal(38,0)")).alias("h"))
    altered = [r[0] for r in digest(new).exceptAll(digest(old)).collect()]
    if altered:
        new.where(F.col(BUCKET).isin(altered)).repartition(BUCKET).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(altered)


def patch_table(spark: SparkSession, path: str, patches: DataFrame, columns: Sequence[str], key: str = "id",
                order: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """`apply_patch` on a table of buckets."""
    return change_buckets(spark, path, patches.select(key), lambda rows: apply_patch(
        rows, patches, columns, key, order), key, buckets)


def store_html(spark: SparkSession, path: str, snapshots: DataFrame, clip: int | None = None,
               buckets: int = BUCKETS) -> list[int]:
    """`html_if_empty` on a table of scrapes in buckets of `scrape_id`."""
    return change_buckets(spark, path, snapshots.select("scrape_id"), lambda rows: html_if_empty(
        rows, snapshots, clip), "scrape_id", buckets)
