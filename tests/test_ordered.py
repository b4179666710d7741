"""Segmented operators equal plain windows and plain Python, also with one hot key."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from capture_analytics.operators import conversations as conv
from capture_analytics.operators import extraction, ordered, profiles, traces


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows belongs to key 0; some values are NULL."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, 60), n, rng.choice([None, 1, 2, 3]))
            for n in rng.sample(range(20_000), 3_000)]
    return spark.createDataFrame(rows, "k int, n bigint, v int").cache()


def same(actual, expected):
    columns = expected.columns
    assert sorted(map(str, actual.select(columns).collect())) == sorted(map(str, expected.collect()))


def test_segmented_equals_window(skewed):
    seq = ordered.by_number(["k"], "n", 256)
    w = Window.partitionBy("k").orderBy("n")
    same(ordered.running_totals(skewed, seq, {"total": F.col("v"), "rows": F.lit(1)}),
         skewed.select("k", "n", "v", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("total"),
                       F.row_number().over(w).cast("bigint").alias("rows")))
    down = Window.partitionBy("k").orderBy(F.desc("n"))
    same(ordered.running_totals(skewed, seq, {"rows": F.lit(1)}, newest_first=True),
         skewed.select("k", "n", "v", F.row_number().over(down).cast("bigint").alias("rows")))
    same(ordered.carry_last(skewed, seq, {"known": F.col("v")}),
         skewed.select("k", "n", "v", F.last("v", True).over(w).alias("known")))
    for step, shift in ((1, F.lead), (-1, F.lag)):
        same(ordered.neighbour(skewed, seq, {"v": "other", "n": "at"}, step),
             skewed.select("k", "n", "v", shift("v").over(w).alias("other"), shift("n").over(w).alias("at")))
    same(ordered.top_per_key(skewed, ["k"], [F.desc("n")], 3),
         skewed.withColumn("rank", F.row_number().over(down).cast("bigint")).where("rank <= 3"))


@pytest.mark.parametrize("block", [1, 4, 256, 100_000])
def test_run_lengths_equal_plain_runs(skewed, block):
    # long runs over many segments: the value changes rarely in the hot key
    rows = skewed.withColumn("v", F.when(F.col("k") == 0, F.floor(F.col("n") / 900).cast("int")).otherwise(F.col("v")))
    got = {(r.k, r.n): r.run for r in ordered.run_lengths(
        rows, ordered.by_number(["k"], "n", block), "v", "run").collect()}
    expected, last = {}, None
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.n)):
        run = expected[last.k, last.n] + 1 if last and (last.k, last.v) == (r.k, r.v) else 1
        expected[r.k, r.n], last = run, r
    assert got == expected


@pytest.fixture(scope="module")
def one_moment(spark):
    """Nearly all rows share one key and one timestamp; keys and ids may be NULL or repeat."""
    rng, moment = random.Random(6), datetime.datetime(2024, 5, 1, 12, 0, 0, 123456)
    rows = [("hot", moment, n, rng.choice([None, 1, 1, 1, 2])) for n in rng.sample(range(9_000), 1_500)]
    rows += [(f"k{n % 9}", moment + datetime.timedelta(microseconds=n % 5), n, 1) for n in range(200)]
    rows += [("hot", moment - datetime.timedelta(microseconds=1), n, n % 2) for n in range(50)]
    rows += [("hot", None, -n, 3) for n in range(1, 20)]
    return spark.createDataFrame(rows, "k string, t timestamp, n bigint, v int").repartition(4).cache()


def test_ranges_do_not_depend_on_keys_or_moments(one_moment, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    seq = ordered.by_time(["k"], "t", "n")
    tagged = seq.tagged(one_moment)
    sizes = {(r.k, r[ordered.SEGMENT]): r["count"] for r in tagged.groupBy("k", ordered.SEGMENT).count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) >= 10 and max(hot) <= 300
    w = Window.partitionBy("k").orderBy("t", "n")
    whole = Window.unboundedPreceding
    same(ordered.running_totals(one_moment, seq, {"rows": F.lit(1)}),
         one_moment.withColumn("rows", F.row_number().over(w).cast("bigint")))
    same(ordered.neighbour(one_moment, seq, {"n": "after"}),
         one_moment.withColumn("after", F.lead("n").over(w)))
    same(ordered.carry_last(one_moment, seq, {"known": F.col("v")}),
         one_moment.withColumn("known", F.last("v", True).over(w.rowsBetween(whole, 0))))
    new = one_moment.withColumn("new", ~F.col("v").eqNullSafe(F.lag("v").over(w)) | (F.row_number().over(w) == 1))
    new = new.withColumn("part", F.sum(F.col("new").cast("int")).over(w.rowsBetween(whole, 0)))
    same(ordered.run_lengths(one_moment, seq, "v", "run").withColumn("run", F.col("run").cast("bigint")),
         new.select("k", "t", "n", "v", F.row_number().over(
             Window.partitionBy("k", "part").orderBy("t", "n")).cast("bigint").alias("run")))


def test_ranges_of_repeated_positions(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 10)
    df = spark.createDataFrame([("a", 1, 1)] * 300 + [("b", n, n) for n in range(100)], "k string, t int, n int")
    seq = ordered.by_time(["k"], "t", "n")
    got = ordered.running_totals(df, seq, {"rows": F.lit(1)}).groupBy("k").agg(F.max("rows"), F.sum("rows"))
    assert {tuple(r) for r in got.collect()} == {("a", 300, 45150), ("b", 100, 5050)}
    assert ordered.running_totals(df.where("false"), seq, {"rows": F.lit(1)}).count() == 0


def test_top_per_key_is_cut_before_the_shuffle(skewed):
    plan = ordered.top_per_key(skewed, ["k"], [F.desc("n")], 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def fold(events, threshold=2):
    graduated = candidate = matches = None
    for selector, demote in events:
        if demote:
            if graduated:
                graduated, candidate, matches = None, graduated, 0
        elif selector and not graduated:
            matches = matches + 1 if candidate == selector else 1
            candidate = selector
            if matches >= threshold:
                graduated, candidate, matches = selector, None, None
    return graduated, candidate, matches


@pytest.mark.parametrize("threshold", [2, 3, 4])
def test_probation_fold_equals_plain_fold(spark, threshold, monkeypatch):
    rng = random.Random(threshold)
    rows, expected = [], {}
    for h in range(120):
        size = 400 if h == 0 else rng.randrange(1, 25)
        events = [(rng.choice([None, "a", "a", "a", "b"]), rng.random() < 0.2) for _ in range(size)]
        expected[f"h{h}"] = fold(events, threshold)
        rows += [(f"h{h}", n, n, s, d) for n, (s, d) in enumerate(events)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "host string, ts bigint, event_id bigint, selector string, demote boolean")
    monkeypatch.setattr(profiles, "STRETCH", 3)
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    got = {r.host: (r.graduated, r.candidate, r.matches)
           for r in profiles.probation_fold(df, threshold).collect()}
    for host, state in expected.items():
        assert got.get(host, (None, None, None)) == state, host


def py_exchange(response, requests):
    """One response with the requests up to the next one, repaired."""
    def returned(parts):
        return {i for kind, i in parts if kind == "tool-return"}

    def without(parts, unwanted):
        return [p for p in parts if not (p[0] == "tool-return" and p[1] in unwanted)]

    asked = {i for kind, i in response[2] if kind == "tool-call"} if response else set()
    own = [n for n, r in enumerate(requests) if any(kind != "tool-return" for kind, _ in r[2])]
    heard = requests[:own[0] + 1] if own else requests
    whole = asked <= set().union(*(returned(r[2]) for r in heard))
    if not whole:
        requests = requests[own[0]:] if own else []
        requests = [(t, k, without(p, asked) if n == 0 else p) for n, (t, k, p) in enumerate(requests)]
    kept, valid = ([response] if response and whole else []), (asked if whole else set())
    for turn, kind, parts in requests:
        left = without(parts, returned(parts) - valid)
        if left or not parts:
            kept.append((turn, kind, left))
            valid = set()
    return kept


def py_repair(messages):
    starts = [n for n, m in enumerate(messages) if m[1] == "response"]
    kept = py_exchange(None, messages[:starts[0]] if starts else messages)
    for start, end in zip(starts, starts[1:] + [len(messages)]):
        kept += py_exchange(messages[start], messages[start + 1:end])
    return kept or messages


def random_history(rng, size):
    messages, last = [], []
    for turn in range(size):
        if rng.random() < 0.45:
            last = [f"c{turn}{x}" for x in "ab"[:rng.randrange(3)]]
            parts = ([("text", None)] if rng.random() < 0.5 or not last else []) + [
                ("tool-call", c) for c in last]
            messages.append((turn, "response", parts))
        else:
            parts = [("tool-return", c) for c in last if rng.random() < 0.7]
            if rng.random() < 0.15:
                parts.append(("tool-return", "stray"))
            if rng.random() < 0.4 or not parts:
                parts.append(("user", None))
            messages.append((turn, "request", parts))
    return messages


def test_repair_equals_plain_passes(spark):
    rng = random.Random(11)
    histories = {c: random_history(rng, 300 if c == 0 else rng.randrange(1, 14)) for c in range(250)}
    histories[900] = [(0, "response", [("tool-call", "x")])]
    rows = [(c, t, k, [(pk, pi, f"{c}-{t}") for pk, pi in p]) for c, h in histories.items() for t, k, p in h]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, kind string, "
                                     "parts array<struct<kind:string,call_id:string,text:string>>")
    got = {}
    for r in conv.repair_tool_calls(df).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.kind, [(p.kind, p.call_id) for p in r.parts]))
    for c, history in histories.items():
        assert sorted(got.get(c, [])) == sorted(py_repair(history)), c


def py_budget(rows, budget):
    """The longest fitting end of the rows, from its first message that may open it."""
    ends = [rows[n:] for n in range(len(rows)) if sum(c for _, c, _ in rows[n:]) <= budget]
    longest = ends[0] if ends else rows[-1:]
    opened = list(itertools.dropwhile(lambda r: r[2] == "assistant", longest))
    return [t for t, _, _ in (rows if longest is rows or len(longest) == len(rows) else opened or rows)]


@pytest.mark.parametrize("budget", [1, 40, 400, 20_000])
def test_budget_equals_plain_walk(spark, budget):
    rng = random.Random(budget)
    convs = {c: [(t, rng.choice([1, 5, 30, 300]), rng.choice(["user", "assistant", "assistant"]))
                 for t in range(1_500 if c == 0 else rng.randrange(1, 12))] for c in range(80)}
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows],
                               "conv_id bigint, turn bigint, cost bigint, role string")
    got = {}
    for r in conv.budget_history(df, F.col("cost"), F.col("role") == "assistant", budget).collect():
        got.setdefault(r.conv_id, []).append(r.turn)
    for c, rows in convs.items():
        assert sorted(got[c]) == py_budget(rows, budget), c


def test_budget_strips_a_mixed_opening(spark):
    df = spark.createDataFrame([
        (1, 0, "request", [("user", None)], 50), (1, 1, "request", [("tool-return", "a")], 5),
        (1, 2, "request", [("tool-return", "b"), ("user", None)], 5), (1, 3, "response", [("text", None)], 5)],
        "conv_id bigint, turn bigint, kind string, parts array<struct<kind:string,call_id:string>>, cost bigint")
    pure = (F.col("kind") == "response") | F.forall("parts", lambda p: p["kind"] == "tool-return")
    rows = conv.budget_history(df, F.col("cost"), pure, 20).orderBy("turn").collect()
    assert [(r.turn, [p.kind for p in r.parts]) for r in rows] == [(2, ["user"]), (3, ["text"])]


def test_last_messages_take_twenty_before_roles(spark):
    df = spark.createDataFrame([(1, t, "system" if t % 2 else None) for t in range(30)],
                               "conv_id bigint, turn bigint, role string")
    assert sorted(r.turn for r in conv.last_messages(df).collect()) == list(range(10, 30, 2))


def test_lineage(spark):
    rng = random.Random(3)
    parent = {0: None}
    for n in range(1, 400):
        parent[n] = rng.choice([None, n - 1, n - 1, n - 1, rng.randrange(n)])
    for n in range(400, 440):        # one long chain
        parent[n] = n - 1 if n > 400 else None
    parent.update({500: 501, 501: 502, 502: 500, 503: 501, 510: 999})
    df = spark.createDataFrame(list(parent.items()), "scrape_id bigint, source_scrape bigint")

    def walk(n):
        seen = [n]
        while parent.get(seen[-1]) in parent:
            if parent[seen[-1]] in seen:
                return None, None
            seen.append(parent[seen[-1]])
        return seen[-1], len(seen) - 1
    got = {r.scrape_id: (r.root, r.depth) for r in traces.lineage_chain(df).collect()}
    assert got == {n: walk(n) for n in parent}


def test_probation_runs(spark):
    rows = [("h", 1, "a"), ("h", 2, None), ("h", 3, "a"), ("h", 4, "a"), ("i", 1, "a"), ("i", 2, "b"),
            ("j", 1, "x"), ("j", 2, "y"), ("j", 3, "y"), ("j", 4, "y")]
    df = spark.createDataFrame([(h, t, t, s, False) for h, t, s in rows],
                               "host string, ts bigint, event_id bigint, selector string, demote boolean")
    seq = ordered.Sequenced(["host"], ("ts", "event_id"), lambda: F.floor(F.col("ts") / 2))
    assert {(r.host, r.selector, r.event_id) for r in profiles.probation_runs(df, seq).collect()} == {
        ("h", "a", 3), ("j", "y", 3)}
    assert {(r.host, r.event_id) for r in profiles.probation_runs(df, seq, 3).collect()} == {("h", 4), ("j", 4)}


def test_cascade_keeps_the_latest_output(spark):
    full = "w " * 60
    rows = [
        (1, 1, True, "T", "C", full), (1, 2, True, None, None, None),
        (2, 1, True, "T", "", full), (2, 2, False, None, None, None),
        (3, 1, True, "T", "C", "thin"), (3, 2, True, "T", "C", ""),
        (4, 1, False, None, None, None), (4, 2, False, None, None, None), (4, 3, True, "T", "C", full)]
    df = spark.createDataFrame(rows, "run_id int, tier int, produced boolean, title string, company_name string, "
                                     "description string")
    two = {r.run_id: tuple(r)[1:] for r in extraction.tier_cascade(df).collect()}
    assert two == {1: (True, 1, 1, []), 2: (False, 2, 1, ["missing_company"]), 3: (True, 2, 2, []),
                   4: (False, 2, None, ["missing_title", "missing_company"])}
    three = {r.run_id: tuple(r)[1:] for r in extraction.tier_cascade(df, True).collect()}
    assert three[4] == (True, 3, 3, []) and three[2] == (False, 2, 1, ["missing_company"])
    cascade = extraction.tier_cascade(df)
    assert {(r.run_id, r.tier) for r in extraction.winning_output(df, cascade).collect()} == {(1, 1), (3, 2)}
    runs = df.select("run_id").distinct()
    assert {r.run_id for r in extraction.remaining_runs(runs, cascade).collect()} == {2, 4}


def test_obstacle_ladder(spark):
    rows = [("DetectObstacle", 0, 0, 0), ("DetectObstacle", 2, 0, 0), ("DetectObstacle", 2, 3, 0),
            ("DetectObstacle", 2, 3, 1), ("ObstacleWaitRetry", 0, 3, 0), ("ObstacleWaitRetry", 0, 2, 0),
            ("ObstacleWaitRetry", 0, 3, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, r int, w int, a int")
    got = df.select("i", traces.obstacle_route(*[F.col(c) for c in "nrwa"]).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["ObstacleRememberMe", "ObstacleWaitRetry", "ObstacleAgent", "ObstacleFail",
                                  "ObstacleAgent", "DetectObstacle", "DetectObstacle"]


def test_topology_is_closed():
    names = {n for n, _ in traces.NODES}
    assert len(names) == len(traces.NODES) == 27
    assert set(traces.EDGES) <= names
    assert {t for targets in traces.EDGES.values() for t in targets} <= names
    assert all(list(t) == sorted(t) and s not in t for s, t in traces.EDGES.items())
    assert {n for n, g in traces.NODES if g == "terminal"} | {"ResolveApplyUrl"} == names - set(traces.EDGES)
