"""Joins and selections against plain Python."""

import random

from pyspark.sql import functions as F

from capture_analytics.operators import dedup, profiles, records, traces


def test_company_resolution_equals_scan(spark):
    rng = random.Random(4)
    syllables = ["ac", "me", "foo", "bar", "Inc", " ", "x", "GmbH", "é"]
    companies = [(i, "".join(rng.choices(syllables, k=rng.randrange(1, 6))).strip() or "q")
                 for i in range(400)] + [(900, None), (901, "Common Co"), (902, "Common Co Inc")]
    names = ["Foobar", "acme", "Common Co", "COMMON", "n/a", " ", None, "zzz", "x" * 250, "INC"] + [
        "".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(60)]
    got = {r.name: (r.company_id, r.is_new) for r in dedup.resolve_companies(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame(companies, "id bigint, name string")).collect()}

    def expected(name):
        low = name.lower()
        exact = [i for i, c in companies if c and c.lower() == low]
        inside = [i for i, c in companies if c and low in c.lower()]
        best = min(exact or inside, default=None)
        return best, best is None
    skip = {"n/a", "", None}
    wanted = {n for n in names if n is not None and n.strip().lower() not in skip}
    assert got == {n: expected(n) for n in wanted}


def test_new_companies_are_stable(spark):
    resolved = spark.createDataFrame([("New A", None, True), ("Old", 1, False)],
                                     "name string, company_id bigint, is_new boolean")
    companies = spark.createDataFrame([(1, "Old")], "id bigint, name string")
    first = dedup.create_companies(resolved, companies).collect()
    assert first == dedup.create_companies(resolved, companies).collect() and len(first) == 1
    again = companies.union(spark.createDataFrame(first, companies.schema))
    assert dedup.create_companies(resolved, again).count() == 0


def test_link_duplicates(spark):
    full = "w " * 60
    posts = spark.createDataFrame([(7, "u1", full), (5, "u1", full), (3, "u1", "stub"), (9, "u2", None),
                                   (4, None, full)], "id bigint, link string, description string")
    scrapes = spark.createDataFrame([(1, "x", "u1"), (2, "u1", None), (3, "u2", ""), (4, None, None)],
                                    "scrape_id int, submitted_url string, canonical_url string")
    got = {r.scrape_id: (r.job_post_id, r.was_duplicate) for r in dedup.link_duplicates(scrapes, posts).collect()}
    assert got == {1: (5, True), 2: (5, True), 3: (None, False), 4: (None, False)}
    wanted = scrapes.select("scrape_id", F.col("canonical_url").alias("link"))
    got = {r.scrape_id: (r.existing_id, r.status_code) for r in dedup.link_conflicts(wanted, posts).collect()}
    assert got[1] == (3, 409) and got[2] == (None, None)


def test_score_batch_takes_two_pages_before_dedup(spark):
    rows = [(i, 100 - i // 3, "completed", f"2024-01-{30 - i:02d}") for i in range(20)]
    rows += [(50, 1, "failed", "2024-02-01"), (51, None, "completed", "2024-02-01"), (52, 100, "completed", None)]
    scrapes = spark.createDataFrame(rows, "scrape_id bigint, job_post_id bigint, status string, at string").select(
        "*", F.to_timestamp("at").alias("scraped_at"))
    scores = spark.createDataFrame([(100,)], "post_id bigint")
    got = [tuple(r) for r in dedup.score_batch(scrapes, scores, 3).collect()]
    assert got == [(99, 3), (98, 6)]


def test_domains(spark):
    rng = random.Random(9)
    labels = ["a", "b", "jobs", "example", "com", "org"]
    def name():
        return ".".join(rng.choices(labels, k=rng.randrange(1, 5)))
    hosts, domains = [name() for _ in range(150)], [name() for _ in range(40)]
    got = {r.host: r.domain for r in dedup.match_domains(
        spark.createDataFrame([(h,) for h in hosts], "host string"),
        spark.createDataFrame([(d,) for d in domains], "domain string")).collect()}

    def expected(host):
        if host in domains:
            return host
        near = [d for d in domains if host.endswith("." + d) or d.endswith("." + host)]
        return min(near, key=lambda d: (-len(d), d)) if near else None
    assert got == {h: expected(h) for h in hosts}


def test_closest_domains(spark):
    domains = ["linkedin.com", "indeed.com", "lever.co", "greenhouse.io"]
    hosts = ["linkedln.com", "indeed.co", "zzz", "linkedin.com"]
    got = {}
    wanted = spark.createDataFrame([(h,) for h in hosts * 2], "host string")
    listed = spark.createDataFrame([(d,) for d in domains], "domain string")
    for r in dedup.closest_domains(wanted, listed).orderBy("host", "rank").collect():
        got.setdefault(r.host, []).append(r.domain)
    assert got == {"linkedln.com": ["linkedin.com"], "linkedin.com": ["linkedin.com"],
                   "indeed.co": ["indeed.com"]}


def test_closest_domains_miss_no_pair(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc.") for _ in range(rng.randint(1, 9)))
    hosts, domains = sorted({word() for _ in range(60)}), sorted({word() for _ in range(40)})

    expected = set()
    for host in hosts:
        near = sorted((-(1 - levenshtein(host, d) / max(len(host), len(d))), d) for d in domains)
        expected |= {(host, d, k + 1) for k, (s, d) in enumerate(near[:3]) if -s >= 0.6}
    found = dedup.closest_domains(spark.createDataFrame([(h,) for h in hosts], "host string"),
                                  spark.createDataFrame([(d,) for d in domains], "domain string"))
    assert {(r.host, r.domain, r.rank) for r in found.collect()} == expected


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        before = now
    return before[-1]


def test_company_names_have_any_length(spark):
    companies = spark.createDataFrame([
        (3, "x" * 150 + " Acme " + "y" * 100), (5, "Al"), (6, "Alpha Beta"), (7, "beta"), (9, "Zed")],
        "id int, name string")
    names = spark.createDataFrame([(n,) for n in (
        "acme", "AL", "a", "Beta", "alpha b", "zz", "y" * 101, "y" * 99, "pha b", "N/A", "zed")],
        "name string")
    got = {r.name: r.company_id for r in dedup.resolve_companies(names, companies).collect()}
    assert got == {"acme": 3, "AL": 5, "a": 3, "Beta": 7, "alpha b": 6, "zz": None, "y" * 101: None,
                   "y" * 99: 3, "pha b": 6, "zed": 9}


def broadcast_rows(df):
    """The rows of each broadcast that the query made."""
    df.collect()
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        else:
            waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_many_names_that_share_their_parts(spark, tmp_path):
    """Every trigram of a name is in hundreds of others, and names repeat: no substring of theirs is
    broadcast for each name that it stands in."""
    stem = "The International Company Number "
    companies = spark.range(3_000).select("id", F.format_string("Customer#%09d", "id").alias("name")).union(
        spark.range(3_000, 3_400).select("id", F.concat(F.lit(stem), F.format_string("%09d", "id"))))
    names = companies.select(F.when(F.col("id") % 3 == 0, F.right("name", F.lit(6))).when(
        F.col("id") % 3 == 1, F.lower("name")).otherwise(F.concat(F.lit("New "), "name")).alias("name"))
    names = names.union(spark.createDataFrame(
        [("customer#0",), (stem,), (stem + "000003",), ("number 000003399",)], "name string"))
    companies.union(companies.withColumn("id", F.col("id") + 10_000)).write.parquet(f"{tmp_path}/companies")
    found = dedup.resolve_companies(names, spark.read.parquet(f"{tmp_path}/companies"))
    known = {r.name.lower(): r.id for r in companies.collect()}
    got = {r.name: r.company_id for r in found.collect()}

    def expected(name):
        low = name.lower()
        if low in known or low.startswith("new "):
            return known.get(low)
        return min((i for c, i in known.items() if low in c), default=None)
    assert got == {n: expected(n) for n in got} and len(got) == names.distinct().count()
    rows = broadcast_rows(found)
    assert rows and max(rows) < 60_000


def test_rewrite_by_profile_skips_bad_rules(spark):
    known = spark.createDataFrame([
        (2, "x.com", [("a", "never")]),
        (1, "x.com", [("[bad", "x"), (None, "x"), ("(", "x"), (r"\?vjk=(?P<k>\w+)", r"/view?jk=\g<k>"), ("x", "y")]),
    ], "id bigint, hostname string, url_rewrites array<struct<match:string,rewrite:string>>")
    pages = spark.createDataFrame([(1, "https://www.x.com/?vjk=7"), (2, "https://z.com/?vjk=7")],
                                  "page_id int, url string")
    got = {r.page_id: r.rewritten for r in profiles.rewrite_by_profile(pages, known).collect()}
    assert got == {1: "https://www.x.com//view?jk=7", 2: "https://z.com/?vjk=7"}


def test_patches_fold_in_order(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", None)], "id int, title string, pay int")
    patches = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, 7), (1, 3, "y", None)],
                                    "id int, seq int, title string, pay int")
    assert {tuple(r) for r in records.apply_patch(base, patches, ["title", "pay"], order="seq").collect()} == {
        (1, "y", 7), (2, "b", None)}
    errors = patches.select(records.patch_error(["title", "pay"]).alias("e")).distinct().collect()
    assert [r.e for r in errors] == [None]


def test_find_company(spark):
    companies = spark.createDataFrame([(1, "Acme"), (2, "Big ACME Inc"), (3, None)], "id bigint, name string")
    assert {(r.id, r["count"]) for r in records.find_company_by_name(companies, "acme").collect()} == {(1, 2), (2, 2)}
    missing = records.find_company_by_name(companies, "zz").collect()
    assert [(r.status_code, r.error) for r in missing] == [(404, "No companies found matching 'zz'")]


def test_run_outcome_ladder(spark):
    rows = [(1, 500, None, 0.0, None, None, 0.0), (2, 201, "running", 70.0, None, None, 0.0),
            (3, 201, "running", 5.0, None, None, 0.0), (4, 201, "failed", 5.0, None, None, 0.0),
            (5, 201, "completed", 5.0, None, None, 20.0), (6, 201, "completed", 5.0, None, None, 2.0),
            (7, 201, "completed", 5.0, 8, None, 0.0), (8, 501, "completed", 5.0, 8, 3, 0.0)]
    df = spark.createDataFrame(rows, "scrape_id int, create_status int, status string, waited_s double, "
                                     "job_post_id bigint, score_id bigint, unlinked_s double").withColumn(
                                         "score_status", F.lit(None).cast("string"))
    got = {r.scrape_id: (r.outcome, r.hold_fallback, r.final_score_status, r.scores_path)
           for r in traces.run_outcome(df).collect()}
    assert [got[i][0] for i in range(1, 9)] == [
        "create_failed", "timed_out", "running", "failed", "unlinked", "linking", "score_failed", "scored"]
    assert got[8][1:] == (True, "pending", "/job-posts/8/scores")


def test_retry_once(spark):
    closed = "Error: Connection closed"
    rows = [(1, 1, closed, None), (1, 2, None, "ok"), (2, 1, "404", None), (2, 2, None, "never"),
            (3, 1, None, "ok"), (4, 1, closed, None), (4, 2, closed, None), (4, 3, None, "late"), (5, 1, closed, None)]
    df = spark.createDataFrame(rows, "scrape_id int, attempt int, error string, content string")
    got = {r.scrape_id: (r.attempt, r.error, r.content) for r in traces.retry_final(df).collect()}
    assert got == {1: (2, None, "ok"), 2: (1, "404", None), 3: (1, None, "ok"), 4: (2, closed, None),
                   5: (1, closed, None)}
