"""Append-only sinks. A batch is written under its own id, so a repeated write after a lost
executor or a restarted stream replaces the same folder instead of adding rows twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capture_analytics.functions.records import debug_html
from capture_analytics.functions.text import filled
from capture_analytics.operators.conversations import usage_rows


def append_records(df: DataFrame, path: str, batch: str | int) -> None:
    """Append one batch of records below `path`."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_trace(transitions: DataFrame, path: str, batch: str | int) -> None:
    """Append transitions; rows without a scrape have nothing to belong to and are dropped. A node
    that a run enters again keeps all its rows: the batch folder makes the write repeatable."""
    append_records(transitions.where(F.coalesce("scrape_id", F.lit(0)) != 0), path, batch)


def append_usage(runs: DataFrame, path: str, batch: str | int) -> None:
    """Append one usage row per model run."""
    append_records(usage_rows(runs), path, batch)


def html_if_empty(scrapes: DataFrame, snapshots: DataFrame, clip: int | None = None) -> DataFrame:
    """Scrapes with the newest captured DOM as html where none is stored yet.

    `snapshots` has `scrape_id`, `captured_at`, `dom`. Snapshots of scrapes that need none are left
    out first, and the newest is found without its DOM, so only DOMs that are stored are moved.
    `clip` cuts a DOM after so many characters; by default it is stored whole.
    """
    missing = scrapes.where(filled(F.col("html")) == "").select("scrape_id").distinct()
    wanted = snapshots.join(missing, "scrape_id", "left_semi")
    newest = wanted.groupBy("scrape_id").agg(F.max("captured_at").alias("captured_at"))
    dom = wanted.join(newest, ["scrape_id", "captured_at"], "left_semi").groupBy("scrape_id").agg(
        # several snapshots of one moment: any order will do as long as it is the same each time
        F.max("dom").alias("_dom"))
    return (scrapes.join(dom, "scrape_id", "left")
            .withColumn("html", debug_html(F.col("html"), F.col("_dom"), clip)).drop("_dom"))
