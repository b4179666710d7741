"""Streams give what their batch twins give."""

import datetime
import random
import time

from pyspark.sql import functions as F

from capture_analytics.operators import conversations, dedup
from capture_analytics.operators.profiles import probation_fold
from capture_analytics.sources.views import view
from capture_analytics.streaming import queues, state


def _drain(df, name, checkpoint):
    query = (df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    assert query.awaitTermination(240)
    return df.sparkSession.table(name)


def _until(df, name, tmp_path, rows):
    """Run a stream with timers, which never ends by itself, until it has given so many rows."""
    query = (df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start())
    try:
        deadline = time.time() + 120
        while time.time() < deadline and df.sparkSession.table(name).count() < rows:
            time.sleep(1)
    finally:
        query.stop()
    return df.sparkSession.table(name)


def _write_in_order(df, path, order, n=4):
    """Several files whose file order is the data order."""
    ranked = df.withColumn("_slice", F.expr(f"ntile({n}) over (order by {order})"))
    for i in range(1, n + 1):
        ranked.where(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


# a row far ahead: it moves the watermark past all others
AHEAD = "timestamp'2200-01-01'"


def test_probation_stream_equals_fold(spark, sf, tmp_path):
    """Rows in any order over the batches give the state of the batch twin."""
    observations = view(spark, sf, "observations")
    path = str(tmp_path / "observations")
    _write_in_order(observations, path, "hash(event_id, 3)")
    last = observations.limit(1).select(*[
        F.expr(AHEAD).cast(kind).alias(c) if c == "ts" else F.lit("ahead" if c == "host" else None).cast(kind).alias(c)
        for c, kind in observations.dtypes]).withColumn("demote", F.lit(True))
    last.coalesce(1).write.mode("append").parquet(path)
    stream = queues.files(spark, path, observations.schema.simpleString()[7:-1].replace(":", " "), 1)
    changes = _drain(state.probation_stream(stream, "20000 days"), "probation", str(tmp_path / "cp"))
    changes = changes.where("host <> 'ahead'").join(
        observations.select("event_id", "ts"), "event_id").withColumn("event_id", F.struct("ts", "event_id"))
    last = changes.groupBy("host").agg(F.max_by(F.struct("graduated", "candidate", "matches"),
                                                "event_id").alias("s")).select("host", "s.*")
    batch = probation_fold(observations)
    assert {tuple(r) for r in last.collect()} == {
        tuple(r) for r in batch.where("graduated is not null or candidate is not null").collect()}


def test_chat_stream(spark, tmp_path):
    rows = [
        (1, 0, 1, "TEXT_MESSAGE_CONTENT", "Let ", None, None, None),
        (3, 0, 1, "TEXT_MESSAGE_CONTENT", "never ends", None, None, None),
        (1, 0, 2, "TOOL_CALL_START", None, "a", "create_answer", None),
        (1, 0, 3, "TEXT_MESSAGE_CONTENT", "me", None, None, None),
        (1, 0, 4, "TOOL_CALL_RESULT", None, "a", None, None),
        (1, 0, 5, "TOOL_CALL_START", None, "b", "update_answer", None),
        (1, 0, 6, "TOOL_CALL_RESULT", None, "b", None, None),
        (1, 0, 7, "USAGE", None, None, None, (5, 2, 7, 3)),
        (1, 0, 8, "USAGE", None, None, None, (1, None, 1, 2)),
        (1, 0, 9, "RUN_FINISHED", None, None, None, None),
        (2, 0, 1, "TOOL_CALL_RESULT", None, "zz", None, None),
        (2, 0, 2, "TOOL_CALL_START", None, "q", "get_scrapes", None),
        (2, 0, 3, "TOOL_CALL_RESULT", None, "q", None, None),
        (2, 0, 4, "RUN_FINISHED", None, None, None, None),
    ]
    schema = ("conv_id bigint, turn bigint, seq bigint, type string, delta string, call_id string, "
              "tool string, request_tokens bigint, response_tokens bigint, total_tokens bigint, "
              "requests bigint")
    df = spark.createDataFrame([(*r[:7], *(r[7] or (None,) * 4)) for r in rows], schema)
    path = str(tmp_path / "chat")
    _write_in_order(df, path, "seq", 3)
    out = _until(state.chat_stream(queues.files(spark, path, schema, 1)), "chat", tmp_path, 3)
    got = {tuple(r) for r in out.collect()}
    assert got == {(1, 0, "reload", "answer", None, None, None, None),
                   (1, 0, "turn", "Let me", 6, 2, 8, 5), (2, 0, "turn", "", 0, 0, 0, 0)}
    usage = conversations.turn_usage(df, "conv_id", "turn").where("conv_id < 3")
    assert {tuple(r) for r in usage.collect()} == {
        tuple(r) for r in out.where("kind = 'turn'").select(
            "conv_id", "turn", "request_tokens", "response_tokens", "total_tokens", "requests").collect()}
    paired = conversations.pair_tool_calls(df, conversations.Sequenced(
        ["conv_id", "turn", "call_id"], ("seq",), lambda: F.lit(0)))
    batch = conversations.reload_set(paired, "conv_id", "turn")
    assert {tuple(r) for r in batch.collect()} == {(1, 0, "answer")}


def test_hold_stream_equals_dispatch(spark, sf, tmp_path):
    urls = view(spark, sf, "wrapped_urls")
    scrapes = urls.select(F.col("page_id").alias("scrape_id"),
                          F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url"),
                          F.when(F.col("page_id") % 3 == 0, "running").otherwise("hold").alias("status"))
    path, out = str(tmp_path / "scrapes"), str(tmp_path / "out")
    _write_in_order(scrapes, path, "scrape_id", 3)
    profiles = view(spark, sf, "profiles")
    stream = queues.files(spark, path, "scrape_id bigint, url string, status string", 1)
    query = queues.hold_stream(stream, lambda: profiles, out, str(tmp_path / "cp"), interval=None)
    assert query.awaitTermination(240)
    written = spark.read.parquet(out)
    expected = queues.dispatch(scrapes, profiles)
    columns = expected.columns
    assert sorted(map(str, written.select(columns).collect())) == sorted(map(str, expected.collect()))
    found, succeeded = queues.hold_summary(written).agg(F.sum("found"), F.sum("succeeded")).first()
    assert found == expected.count() and succeeded == expected.where("status = 'running'").count()
    assert expected.where("status = 'failed'").count() > 0


def test_hold_stream_dispatches_once(spark, tmp_path):
    schema, path, out = "scrape_id bigint, url string, status string", str(tmp_path / "s"), str(tmp_path / "out")
    for rows in ([(1, "https://a.io/1", "hold"), (1, "https://a.io/1", "hold"), (2, "https://a.io/2", "running")],
                 [(1, "https://a.io/1", "hold"), (2, "https://a.io/2", "hold")], [(2, "https://a.io/2", "hold")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    profiles = spark.createDataFrame([(1, "a.io")], "id bigint, hostname string")
    query = queues.hold_stream(queues.files(spark, path, schema, 1), lambda: profiles, out, str(tmp_path / "cp"), None)
    assert query.awaitTermination(240)
    assert sorted(r.scrape_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_score_stream_equals_score_batch_after_each_batch(spark, tmp_path):
    """Scores before, with and after their captures; posts with many captures; captures without a time."""
    rng, out = random.Random(9), str(tmp_path / "out")
    start = datetime.datetime(2024, 1, 1)
    scrapes = [(n, None if n % 17 == 0 else start + datetime.timedelta(minutes=rng.randrange(500)),
                "failed" if n % 11 == 0 else "completed", None if n % 13 == 0 else rng.choice([7, rng.randrange(60)]))
               for n in range(160)]
    scores = [(p,) for p in rng.sample(range(60), 44)] + [(7,), (None,)]
    kinds = ("scrape_id bigint, scraped_at timestamp, status string, job_post_id bigint", "post_id bigint")
    paths = [str(tmp_path / name) for name in ("scrapes", "scores")]
    for k in range(4):
        for path, kind, rows, n in zip(paths, kinds, (scrapes, scores), (40, 11)):
            part = rows[k * n:(k + 1) * n] if k < 3 else rows[k * n:]
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    streams = [queues.files(spark, path, kind, 1) for path, kind in zip(paths, kinds)]
    query = queues.score_stream(*streams, out, str(tmp_path / "cp"), limit=4, interval=None, parts=3)
    assert query.awaitTermination(240)
    for k in range(4):
        seen = (scrapes[:(k + 1) * 40], scores[:(k + 1) * 11] if k < 3 else scores)
        expected = dedup.score_batch(*(spark.createDataFrame(r, kind) for r, kind in zip(seen, kinds)), 4)
        got = spark.read.parquet(f"{out}/picked/batch={k}")
        assert {tuple(r) for r in got.select("job_post_id", "scrape_id").collect()} == {
            tuple(r) for r in expected.collect()}, k


def test_trace_stream_keeps_loops_and_drops_rows_without_scrape(spark, tmp_path):
    schema = "scrape_id bigint, node string, t_start timestamp, routed_to string"
    df = spark.sql("""select * from values (1L, 'A', timestamp'2024-01-01', 'B'),
        (1L, 'A', timestamp'2024-01-01', 'C'), (1L, 'A', null, 'B'), (1L, 'A', null, 'C'), (0L, 'A', timestamp'2024-01-01', 'B'),
        (cast(null as bigint), 'A', timestamp'2024-01-01', 'B') as t(scrape_id, node, t_start, routed_to)""")
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    df.write.parquet(path)
    query = queues.trace_stream(queues.files(spark, path, schema), out, str(tmp_path / "cp"))
    assert query.awaitTermination(240)
    assert sorted((r.routed_to, r.t_start is None) for r in spark.read.parquet(out).collect()) == [
        ("B", False), ("B", True), ("C", False), ("C", True)]


def test_run_timeouts(spark, tmp_path):
    schema = "scrape_id bigint, seq bigint, status string, job_post_id bigint"
    path = str(tmp_path / "runs")
    # run 5 gets its post before it completes, run 6 after, each in a micro-batch of its own; run 3
    # gets a row after its end
    for rows in ([(1, 1, "running", None), (2, 1, "running", None), (2, 2, "completed", None),
                  (3, 1, "completed", 9), (4, 1, "failed", None), (5, 1, "running", 8),
                  (6, 1, "completed", None)],
                 [(5, 2, "completed", None), (6, 2, "completed", 7), (3, 2, "running", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = queues.files(spark, path, schema, 1)
    out = _until(state.run_timeouts(stream, 20.0, 15.0), "timeouts", tmp_path, 6)
    assert {(r.scrape_id, r.outcome) for r in out.collect()} == {
        (1, "timed_out"), (2, "unlinked"), (3, "linked"), (4, "failed"), (5, "linked"), (6, "linked")}


def test_replaying_a_log_gives_its_outcomes(spark, tmp_path):
    """Limits on event time do not depend on the pace of the replay or the order of arrival."""
    schema, start = "scrape_id bigint, seq bigint, status string, job_post_id bigint, at timestamp", datetime.datetime(2024, 1, 1)
    log = [(1, 1, "running", None, 0), (2, 1, "running", None, 0), (2, 2, "completed", None, 5), (3, 1, "running", None, 0),
           (3, 2, "completed", 9, 19), (4, 1, "running", None, 3), (4, 2, "failed", None, 8), (5, 1, "running", 8, 2),
           (5, 2, "completed", None, 30), (6, 1, "completed", None, 4), (6, 2, "completed", 7, 9), (1, 2, "completed", 5, 90),
           (7, 1, "running", None, 50), (7, 2, "completed", None, 60), (7, 3, "completed", 3, 74), (4, 3, "running", None, 95)]
    expected = {1: "timed_out", 2: "unlinked", 3: "linked", 4: "failed", 5: "timed_out", 6: "linked", 7: "linked"}
    for name, order, n in (("one", log, 1), ("mixed", random.Random(2).sample(log, len(log)), 4)):
        path = str(tmp_path / name)
        for k in range(n + 1):
            rows = order[k::n] if k < n else [(99, 1, "failed", None, 10**8)]
            spark.createDataFrame([(*r[:4], start + datetime.timedelta(seconds=r[4])) for r in rows], schema
                                  ).coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.05)
        out = _drain(state.run_timeouts(queues.files(spark, path, schema, 1), 20.0, 15.0, at="at", delay="1 hour"),
                     f"replay_{name}", str(tmp_path / f"cp-{name}"))
        assert {r.scrape_id: r.outcome for r in out.where("scrape_id < 99").collect()} == expected, name
