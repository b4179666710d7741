"""Readers and sinks: write, read back, and the same after a repeated write."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from capture_analytics.operators import records
from capture_analytics.session import checkpoint_dir
from capture_analytics.sources import layout, sinks, tables


def test_resource_dump(spark, tmp_path):
    page = {"data": [
        {"type": "job-post", "id": "1", "attributes": {"title": "t", "salary_min": 5, "extra": {"a": 1}},
         "relationships": {"scores": {"data": [{"type": "score", "id": "3"}]},
                           "company": {"data": {"type": "company", "id": "78"}}, "resume": {"data": None}}}],
        "included": [{"type": "company", "id": "78"}]}
    empty = {"data": []}
    path = tmp_path / "dump.json"
    path.write_text("\n".join(json.dumps(x) for x in (page, empty)))
    df = tables.read_resources(spark, str(path))
    row = records.slim_payload(df, "job_posts", single=False).first()
    assert df.count() == 1 and row.attributes == {"title": "t"}
    assert row.relationships == {"scores": "1", "company": "78", "resume": None}
    assert json.loads(df.first().attributes["extra"]) == {"a": 1}


def test_records_have_a_declared_schema(spark, tmp_path):
    path = tmp_path / "posts.json"
    path.write_text('{"id": 1, "title": "t", "posted_date": "2024-01-02", "salary_min": 3}\n')
    row = tables.read_records(spark, str(path), tables.JOB_POST).first()
    assert (row.id, row.posted_date.isoformat(), row.salary_min, row.link) == (1, "2024-01-02", 3, None)


def test_screenshots_are_listed_not_read(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "a.png").write_bytes(b"12345")
    listing = tables.screenshot_listing(spark, str(tmp_path))
    assert [(r.filename, r.size) for r in listing.collect()] == [("a.png", 5)]
    assert "content" not in listing.columns


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = records.filter_eq(tables.table(spark, sf, "orders"), o_orderstatus="F").select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "m", None, 0, 5, 0, "chat", None), ("b", "m", 1, 2, 3, 4, "chat", 9)],
                                 "agent_name string, model_name string, request_tokens int, response_tokens int, "
                                 "total_tokens int, request_count int, trigger string, pipeline_run_id int")
    path = str(tmp_path / "usage")
    for _ in range(2):
        sinks.append_usage(rows, path, 1)
    sinks.append_usage(rows.limit(0), path, 2)
    got = {tuple(r) for r in spark.read.parquet(path).drop("batch").collect()}
    assert got == {("a", "m", 0, 0, 5, 1, "chat", None), ("b", "m", 1, 2, 3, 4, "chat", "9")}


def test_html_is_written_only_where_missing(spark):
    scrapes = spark.createDataFrame([(1, None), (2, "kept"), (3, "")], "scrape_id int, html string")
    doms = spark.createDataFrame([(1, 5, "newest"), (2, 9, "other"), (1, 4, "older, yet larger")],
                                 "scrape_id int, captured_at int, dom string")
    got = {r.scrape_id: r.html for r in sinks.html_if_empty(scrapes, doms).collect()}
    assert got == {1: "newest", 2: "kept", 3: ""}
    cut = {r.scrape_id: r.html for r in sinks.html_if_empty(scrapes, doms, clip=3).collect()}
    assert cut[1].startswith("new") and "newest" not in cut[1] and cut[2] == "kept"


class _Session:
    """Stands for a session of a given master and settings."""

    def __init__(self, master, **settings):
        self.conf, self.sparkContext = self, self
        self.master, self.settings, self.set_to = master, settings, None

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getCheckpointDir(self):
        return self.set_to

    def setCheckpointDir(self, folder):
        self.set_to = folder


def test_checkpoint_folder_comes_from_the_session(spark):
    cluster = _Session("spark://x", **{"spark.checkpoint.dir": "/shared"})
    assert checkpoint_dir(cluster) == "/shared" == cluster.set_to
    alone = _Session("spark://x", **{"spark.sql.warehouse.dir": "hdfs://w/"})
    assert checkpoint_dir(alone) == "hdfs://w/_checkpoints" == alone.set_to
    for warehouse in ("/home/user/spark-warehouse", "file:/home/user/spark-warehouse"):
        with pytest.raises(ValueError):
            checkpoint_dir(_Session("spark://x", **{"spark.sql.warehouse.dir": warehouse}))
    assert checkpoint_dir(spark)


SORT = [("price", True), ("id", False)]


@pytest.fixture(scope="module")
def ordered_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordered"))
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 97).alias("price"))
    layout.write_ordered(rows.repartition(7), path, SORT, 250)
    return path, rows


def files_read(df):
    return {Path(r[0]).parent.name for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.mark.parametrize("number, size", [(1, 25), (3, 25), (200, 25), (7, 600), (1000, 25), (1, 5000)])
def test_a_page_reads_its_ranges_only(spark, ordered_path, number, size):
    path, rows = ordered_path
    order = [F.col("price").desc(), F.col("id").asc()]
    found = layout.read_page(spark, path, SORT, number, size)
    expected = [tuple(r) for r in records.page(rows, order, number, size).collect()]
    assert [tuple(r) for r in found.select("id", "price").collect()] == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not expected or "PartitionFilters: [" in plan
    ranges = [p for p in Path(path, "rows").iterdir() if p.is_dir()]
    assert len(ranges) > 15 and len(files_read(found)) <= size // 200 + 2


def test_walking_after_gives_all_rows(spark, ordered_path):
    path, rows = ordered_path
    expected = [tuple(r) for r in rows.orderBy(F.col("price").desc(), F.col("id").asc()).collect()]
    for at in (0, 1, 249, 250, 2_000, 4_890, 4_950, 4_999):
        i, price = expected[at]
        found = layout.read_after(spark, path, SORT, (price, i), 40)
        assert [tuple(r) for r in found.select("id", "price").collect()] == expected[at + 1:at + 41], at
        assert len(files_read(found)) <= 3


def test_ranges_of_a_large_table_are_not_ever_more(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "MOST_RANGES", 6, raising=False)
    rows = spark.range(3_000).select("id", (F.col("id") * 7919 % 97).alias("price"))
    layout.write_ordered(rows, str(tmp_path), SORT, 100)
    assert 1 < len([p for p in (tmp_path / "rows").iterdir() if p.is_dir()]) <= 6
    expected = [tuple(r) for r in rows.orderBy(F.col("price").desc(), F.col("id").asc()).collect()]
    page = layout.read_page(spark, str(tmp_path), SORT, 21, 50).select("id", "price").collect()
    assert [tuple(r) for r in page] == expected[1_000:1_050]
    i, price = expected[1_049]
    rest = layout.read_after(spark, str(tmp_path), SORT, (price, i), 50).select("id", "price").collect()
    assert [tuple(r) for r in rest] == expected[1_050:1_100]


def test_a_patch_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = spark.range(400).select("id", F.concat(F.lit("t"), "id").alias("title"), F.lit(None).cast("string").alias("link"))
    layout.write_buckets(rows, path, "id", 16)
    files = lambda: {str(f) for f in Path(path).rglob("*.parquet")}
    before = files()
    patches = spark.createDataFrame([(5, 1, "new", None), (5, 2, None, "l"), (6, 1, "t6", None), (999, 1, "x", "y")],
                                    "id bigint, seq int, title string, link string")
    changed = layout.patch_table(spark, path, patches, ["title", "link"], order="seq", buckets=16)
    assert len(changed) == 1 and len(before - files()) == len(files() - before) == 1
    expected = records.apply_patch(rows, patches, ["title", "link"], order="seq")
    got = spark.read.parquet(path).select(expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    after = files()
    assert layout.patch_table(spark, path, patches, ["title", "link"], order="seq", buckets=16) == []
    assert layout.patch_table(spark, path, patches.limit(0), ["title"], buckets=16) == []
    assert files() == after


def test_html_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "scrapes")
    scrapes = spark.range(60).select(F.col("id").alias("scrape_id"), F.when(F.col("id") % 2 == 0, "old").alias("html"))
    layout.write_buckets(scrapes, path, "scrape_id", 8)
    dom = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "scrape_id bigint, captured_at int, dom string")
    assert len(layout.store_html(spark, path, dom, buckets=8)) == 1
    got = {r.scrape_id: r.html for r in spark.read.parquet(path).collect()}
    assert (got[1], got[2], got[3], len(got)) == ("b", "old", None, 60)
    assert layout.store_html(spark, path, dom, buckets=8) == []
