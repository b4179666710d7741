"""Text gates, record rules and chat rules on exact cases."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from capture_analytics.functions import chat as C
from capture_analytics.functions import records as R
from capture_analytics.functions import text as T
from capture_analytics.functions.registry import FUNCTIONS, TABLES, register_functions, register_tables
from capture_analytics.operators import records as ops


def apply(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


TEXTS = ["", "   ", "one", "a b\x1cc\td\n", "x " * 59, "x " * 60, "y z " * 200, None]


def test_words(spark):
    counts = [len((t or "").split()) for t in TEXTS]
    assert apply(spark, TEXTS, T.word_count) == counts
    for n in (1, 2, 40, 60, 200):
        assert apply(spark, TEXTS, lambda c, n=n: T.has_words(c, n)) == [c >= n for c in counts]
    assert apply(spark, ["  x y \n"], T.strip) == ["x y"]


def py_wall(text, extra=()):
    hits = [sum(phrase in text.lower() for phrase in phrases)
            for phrases in (T.LOGIN_STRONG_PHRASES + tuple(extra), T.LOGIN_WEAK_PHRASES)]
    return hits[0] > 0 or (hits[1] > 1 and len(text.split()) < 200)


def test_login_wall(spark):
    long = "word " * 250
    texts = ["Sign in or create an account", "Sign in", long + "sign in join now", long + "Just a Moment",
             "fine page", "login", "", "Members Only", "members only"]
    assert apply(spark, texts, T.login_wall) == [py_wall(t) for t in texts]
    host = F.array(F.lit("members only"), F.lit("NEVER lower"))
    assert apply(spark, texts, lambda c: T.login_wall(c, host)) == [
        py_wall(t, ("members only", "NEVER lower")) for t in texts]


def test_still_loading(spark):
    def expected(text):
        low = text.strip().lower()
        return (not low or low.startswith(T.LOADING_PREFIXES)
                or (len(low.split()) < 40 and any(p in low for p in T.LOADING_PREFIXES)))
    texts = ["", "  Loading jobs " + "x " * 80, "x " * 50 + "please wait", "x " * 10 + "please wait", "ready"]
    assert apply(spark, texts, T.still_loading) == [expected(t) for t in texts]


def test_shell_and_validation(spark):
    shell = "Loading Sorry to interrupt CSS Error " + "word " * 50
    real = "word " * 45
    assert apply(spark, [shell, real, "css error"], T.loading_shell) == [True, False, False]
    assert apply(spark, [real, shell, "Too few words here."], T.validation_reasons) == [
        [], ["loading_shell_fingerprint"], ["source_too_short"]]


def test_evaluation(spark):
    rows = [("T", "C", ""), ("T", "C", "thin text"), (" ", None, "w " * 60), ("T", "C", "w " * 60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string, d string")
    got = df.select("i", T.extraction_reasons(F.col("t"), F.col("c"), F.col("d")).alias("x")).orderBy("i")
    assert [r.x for r in got.collect()] == [
        [], ["thin_description"], ["missing_title", "missing_company"], []]


def test_small_text_rules(spark):
    assert apply(spark, ["Error: Connection closed", "connection closed", None], T.transient_error) == [
        True, False, False]
    assert apply(spark, ["", "ab", "abcdef", None], T.token_estimate) == [1, 1, 2, 1]
    assert apply(spark, ["abc", "abcd", None], lambda c: T.clip_text(c, 3, "!")) == ["abc", "abc!", None]


def test_digest(spark):
    import hashlib
    import json
    values = {"node": "A \"b\"", "routed_to": None, "n": 3, "ok": True}
    expected = hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:16]
    got = T.json_digest(node=F.lit(values["node"]), routed_to=F.lit(None).cast("string"), n=F.lit(3), ok=F.lit(True))
    assert one(spark, got) == expected


def test_record_rules(spark):
    assert one(spark, R.response_gate(F.lit(201), F.lit("ok"))) == ("ok", None, None)
    assert one(spark, R.response_gate(F.lit(404), F.lit("Not found"))) == (None, "404 - Not found", 404)
    assert one(spark, R.response_gate(F.lit(500), F.lit("x" * 1000)))[1] == "500 - " + "x" * 500
    assert one(spark, R.response_gate(F.lit(302), F.lit("moved")))[2] is None
    assert apply(spark, [" N/A ", "Acme", None, "", "TBD"], R.placeholder_company) == [
        True, False, True, True, True]
    assert apply(spark, [" a ", " ", None], R.blank_marker) == ["a", "(blank)", "(blank)"]
    assert one(spark, R.link_fallback(F.lit(""), F.lit("u"))) == "u"
    assert apply(spark, ["12", "x", None], R.fk_int) == [12, None, None]
    assert one(spark, R.hyphenate_keys(F.create_map(F.lit("a_b_c"), F.lit(1)))) == {"a-b-c": 1}
    assert one(spark, R.frontend_url(F.lit("company"), F.lit(78))) == "/companies/78"
    assert one(spark, R.frontend_url(F.lit("widget"), F.lit(78))) is None
    none = F.lit(None).cast("string")
    assert one(spark, R.action_valid(F.lit("/x"), none, none)) is True
    assert one(spark, R.action_valid(none, none, none)) is False
    assert one(spark, R.action_valid(F.lit("/x"), none, F.lit("m"))) is False
    assert [one(spark, R.batch_valid(F.lit(n))) for n in (0, 1, 3, 4)] == [False, True, True, False]
    assert one(spark, R.debug_html(F.lit(""), F.lit("d" * 200_001))) == "d" * 200_001
    assert one(spark, R.debug_html(F.lit(""), F.lit("d" * 200_001), R.DOM_CLIP)) == "d" * 200_000 + R.DOM_MARKER
    assert one(spark, R.debug_html(F.lit("kept"), F.lit("d"))) == "kept"
    errors = R.new_post_errors(F.lit(""), F.lit(0), none, F.lit(-1), F.lit(5))
    assert one(spark, errors) == ["title", "company_id", "salary_min"]
    errors = R.company_errors(F.lit("x" * 201), F.lit("i" * 101), none)
    assert one(spark, errors) == ["name", "industry"]
    assert [one(spark, R.score_band(F.lit(s))) for s in (80, 79, 60, 59)] == [
        "strong", "reasonable", "reasonable", "gaps"]
    note = R.terminal_note(F.lit("success"), F.lit(None).cast("bigint"), F.lit("abc"), none)
    assert one(spark, note) == "extracted (3 chars)"


def test_promises(spark):
    said = ["I'll check that", "Let me  check", "I’ll look", "Ill find it", "Your last name is blank.",
            "I am going to create it", "I will fetch", None, "full check"]
    assert apply(spark, said, lambda c: C.unfulfilled_promise(c, F.lit(0))) == [
        True, True, True, True, False, True, True, False, False]
    assert apply(spark, said[:1], lambda c: C.unfulfilled_promise(c, F.lit(1))) == [False]


def test_onboarding(spark):
    flags = {k: F.lit(k == "profile_basics") for k in C.ONBOARDING_STEPS}
    assert one(spark, C.onboarding_next(flags, F.lit(None).cast("boolean"))) == "Import a resume"
    assert one(spark, C.onboarding_next(flags, F.lit(False))) == C.WIZARD_OFF
    done = {k: F.lit(True) for k in C.ONBOARDING_STEPS}
    assert one(spark, C.onboarding_next(done, F.lit(True))) == C.ALL_DONE
    assert one(spark, C.wizard_applies(done, F.lit(True))) is False


def test_sse(spark):
    chunks = ['data: {"type":"A","delta":"x"}\n\n', ": keep", "data: {bad\n\n", 'id: 1\ndata: {"type":"B"}\n\ndata: {}']
    got = apply(spark, chunks, C.sse_event)
    assert [(g.type, g.delta) if g else None for g in got] == [("A", "x"), None, None, ("B", None)]


def test_slim_records(spark):
    record = spark.sql("""select 'job-post' as type, '1' as id,
        map('title', 't', 'secret', 's') as attributes,
        map('scores', '{"data":[{"id":"1"},{"id":"2"}]}', 'company', '{"data":{"type":"company","id":"78"}}',
            'resume', '{"data":null}') as relationships, 'x' as included, 'l' as links""")
    slim = ops.slim_payload(record, "job_posts", single=False)
    row = slim.first()
    assert row.attributes == {"title": "t"} and "included" not in slim.columns
    assert row.relationships == {"scores": "2", "company": "78", "resume": None}
    assert ops.slim_payload(record, "job_posts", single=True).first().attributes.keys() == {"title", "secret"}
    assert "relationships" not in ops.slim_record(record, None, "omit").columns
    assert ops.slim_payload(record, "graph_trace", single=False) is record
    tagged = ops.with_frontend_url(record)
    assert tagged.first()._frontend_url == "/job-posts/1" and "links" not in tagged.columns


def test_sorting_rules():
    with pytest.raises(ValueError):
        ops.sort_columns("salary", allowed=ops.APPLICATION_SORT_FIELDS)


SAMPLES = {
    "string": "'<title>Caf&eacute; &#8211; &lt;x&gt;</title><a href=\"/apply?u=https%3A%2F%2Fx.com\">See <b>more</b></a>'",
    "int": "3", "bigint": "81", "boolean": "true", "array<string>": "array('see', 'x')",
    "map<string,string>": "map('b', 'x\"y', 'a', null)", "map<string,boolean>": "map('resume', true)",
    "array<struct<match:string,rewrite:string>>": "array(named_struct('match', 'apply', 'rewrite', 'go'))"}


@pytest.fixture(scope="module")
def registered(spark):
    return register_functions(spark)


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_every_sql_function_equals_its_column(spark, registered, name):
    parameters, build = FUNCTIONS[name]
    named = [p.split(" ", 1) for p in re.split(r",\s*(?![^<]*>)", parameters)]
    values = ", ".join(f"{SAMPLES[kind]} as {column}" for column, kind in named)
    row = spark.sql(f"select {values} from range(1)")
    row.createOrReplaceTempView("samples")
    called = spark.sql(f"select {name}({', '.join(c for c, _ in named)}) as x from samples").first()
    assert called.x == row.select(build(*[F.col(c) for c, _ in named]).alias("x")).first().x


def test_map_digest_is_that_of_the_fields(spark):
    fields = {"b": 'x"y', "a": None}
    text = json.dumps(fields, sort_keys=True)
    column = T.map_digest(F.create_map(F.lit("b"), F.lit('x"y'), F.lit("a"), F.lit(None).cast("string")))
    assert one(spark, column) == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_sql_functions_equal_columns(spark, registered):
    assert set(registered) == set(FUNCTIONS)
    html = "<title>T</title><a class=b href='/apply'>Apply</a><input name=q>"
    row = spark.sql("""select canonicalize_url('https://x.com//a?utm_source=1&b=c+d#f') as canonical,
        unwrap_url('https://t/?url=https%3A%2F%2Fx.com') as inner_url, word_count('a b') as words,
        login_wall('Please wait', null) as wall, score_band(81) as band, page_title(:html) as title,
        size(apply_candidates(:html, 'https://e.com/')) as candidates, reload_resource('create_scrape') as res,
        evaluate_extraction('', 'C', 'thin') as reasons, urls_differ('https://a.b', 'https://a.b#c') as differs
        """, args={"html": html}).first()
    assert tuple(row) == ("https://x.com/a?b=c+d", "https://x.com", 2, True, "strong", "T", 1, "scrape",
                          ["missing_title", "thin_description"], False)


def test_table_functions_join_laterally(spark, registered):
    assert register_tables(spark) == list(TABLES)
    html = "<a class=b href='/apply'>Apply</a><input name=q><button aria-label=apply>go</button><input type=password>"
    spark.createDataFrame([(1, html, "https://e.com/"), (2, "<p>", "https://e.com/"), (3, None, None)],
                          "page_id int, html string, url string").createOrReplaceTempView("captured")
    found = spark.sql("select page_id, c.* from captured, lateral apply_candidate_rows(html, url) c order by position")
    assert [tuple(r) for r in found.select("page_id", "position", "selector", "href", "score").collect()] == [
        (1, 1, "a.b", "https://e.com/apply", 0.9), (1, 2, "button", None, 0.3)]
    fields = spark.sql("select page_id, f.position, f.type, f.name from captured, lateral form_field_rows(html) f")
    assert sorted(map(tuple, fields.collect())) == [(1, 1, "text", "q"), (1, 2, "password", None)]
    for df in (found, fields):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
