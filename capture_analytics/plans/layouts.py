"""Queries over tables that are written, changed and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from capture_analytics.functions.registry import register_tables
from capture_analytics.plans.pages import _CANDIDATES
from capture_analytics.plans.records import apply_patch as patched
from capture_analytics.plans.registry import TWINS, query
from capture_analytics.session import checkpoint_dir
from capture_analytics.sources import layout, sinks
from capture_analytics.sources.views import view

_BY_SALARY = (("salary_max", True), ("id", False))


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


@query("ordered_page", """select id, salary_max from [job_posts] order by salary_max desc, id
    limit 25 offset 400""")
def ordered_page(spark, folder):
    path = _folder(spark)
    layout.write_ordered(view(spark, folder, "job_posts").select("id", "salary_max"), path, _BY_SALARY, 1_000)
    return layout.read_page(spark, path, _BY_SALARY, 17, 25)


@query("page_after", """select id, salary_max from [job_posts] order by salary_max desc, id
    limit 25 offset 425""")
def page_after(spark, folder):
    path = _folder(spark)
    layout.write_ordered(view(spark, folder, "job_posts").select("id", "salary_max"), path, _BY_SALARY, 1_000)
    last = layout.read_page(spark, path, _BY_SALARY, 17, 25).orderBy("salary_max", F.desc("id")).first()
    return layout.read_after(spark, path, _BY_SALARY, (last.salary_max, last.id), 25)


@query("bucket_patch")
def bucket_patch(spark, folder):
    """The patches of `apply_patch`, written into buckets; the second time nothing is left to write."""
    path = _folder(spark)
    posts = view(spark, folder, "job_posts").select("id", "title", "posting_status", "link")
    layout.write_buckets(posts, path, "id", 16)
    wanted = patched(spark, folder).select("id", "title", "posting_status")
    for _ in range(2):
        layout.patch_table(spark, path, wanted, ["title", "posting_status"], buckets=16)
    return spark.read.parquet(path).drop(layout.BUCKET)


TWINS["bucket_patch"] = TWINS["apply_patch"]


@query("append_records", "select id, title, link from [job_posts]")
def append_records(spark, folder):
    """Posts written in two batches, one of them twice, and read back."""
    path, posts = _folder(spark), view(spark, folder, "job_posts").select("id", "title", "link")
    for batch in (0, 1, 0):
        sinks.append_records(posts.where(F.col("id") % 2 == batch), path, batch)
    return spark.read.parquet(path).drop("batch")


@query("append_trace", "select scrape_id, event_id, node, routed_to from [transitions] where scrape_id <> 0")
def append_trace(spark, folder):
    """Transitions written as a batch, and again, and read back."""
    path = _folder(spark)
    rows = view(spark, folder, "transitions").select("scrape_id", "event_id", "node", "routed_to")
    for _ in range(2):
        sinks.append_trace(rows, path, 7)
    return spark.read.parquet(path).drop("batch")


@query("candidate_rows", f"select page_id, cast(1 as bigint) as position, selector, href, text, tag, score, reason from ({_CANDIDATES}) c")
def candidate_rows(spark, folder):
    """The table function in a lateral join."""
    register_tables(spark)
    return spark.sql("select page_id, c.* from {pages}, lateral apply_candidate_rows(html, url) c",
                     pages=view(spark, folder, "html_apply"))
