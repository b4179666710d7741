"""Html functions, selector matching and capture rules on small pages."""

import html as standard
import re

import pytest
from pyspark.sql import functions as F

from capture_analytics.functions import html as H
from capture_analytics.functions.selectors import match_selectors
from capture_analytics.functions.text import login_wall
from capture_analytics.operators import pages as ops

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B
 C</title><style>p{}</style><script>var t="</p><a href=x>";</script></head>
<body class='outer'><!-- <a href="/gone">gone</a> --><nav><a href="/jobs">Jobs <b>n</b>ow</a>
<a name=anchor>no link</a><a href='../up' title="a > b">Up</a></nav>
<div id=main class="job-description wide"><p>First<p>Second <span data-testid="job-title-1">Engineer</span></div>
<div class="jobsearch-InlineCompanyRating"><i><a href="https://acme.test/apply">Acme</a></i></div>
<button>Plain</button><button aria-label='See More'>Show more text</button>
<form><input name=q placeholder=""><input type=PASSWORD id=pw><button type=submit>Go</button><br>
<span role=button aria-label="Open &quot;x&quot;">z</span></form></body>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, "https://e.com/d/e/f", PAGE)], "page_id int, url string, html string")


def value(page, column):
    return page.select(column.alias("x")).first().x


def test_text_and_title(page):
    assert value(page, H.page_title(F.col("html"))) == "A & B C"
    assert value(page, H.visible_text(F.col("html"))) == (
        "Jobs now no linkUp First Second Engineer Acme Plain Show more text Go z")


def test_links(page):
    links = value(page, H.page_links(F.col("html"), F.col("url")))
    assert [tuple(x) for x in links] == [
        ("Jobs now", "https://e.com/jobs"), ("Up", "https://e.com/d/up"), ("Acme", "https://acme.test/apply")]


@pytest.mark.parametrize("html, expected", [
    ('<a href="/x"><button>one</button><button>two</button> Apply here</a>',
     [("a", "one two Apply here"), ("button", "one"), ("button", "two")]),
    ('<div role="button"><div>icon</div> Apply now</div><p>after</p>', [("div", "icon Apply now")]),
    ('<div role="button"></div><p>after</p>', [("div", "")]),
    ('<a href="/1">un<b>closed</b><a href="/2">second</a> out', [("a", "unclosed"), ("a", "second")]),
    ('<span role=button>a<span>b<span>c</span></span>d</span>e', [("span", "abcd")]),
    ('<button>x<button>y apply</button>z', [("button", "x"), ("button", "y apply")]),
    ('<input role="button" value="v"> text', [("input", "")]),
    ('<div role="button">never closed <p>rest', [("div", "never closed rest")]),
])
def test_element_text_is_all_that_the_element_holds(spark, html, expected):
    elements = H.interactive_elements(F.lit(html))
    row = spark.range(1).select(F.transform(elements, lambda e: F.struct(e["tag"], e["text"])).alias("e"))
    assert [tuple(e) for e in row.first().e] == expected


def test_character_references_are_those_of_the_standard_library(spark):
    texts = ["we&#x27;re &#8211; &eacute;&rsquo;", "&amp;lt;", "&copy 2020", "&unknown; &", "a&b;c",
             "&#0;&#55296;&#99999999;&#x110000;", "&NotEqualTilde;", "plain", "&#128;", "&amp", "&AMP;&LT;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.d for r in df.select("i", H.decode_entities(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [standard.unescape(t) for t in texts]


def test_login_wall_reads_references(spark):
    page = F.lit("<p>we&#x27;re logging you in</p>")
    assert spark.range(1).select(login_wall(H.visible_text(page)).alias("x")).first().x


def test_counts_per_host_are_not_cut(spark):
    html = "".join(f'<a class="apply-link" href="/apply/{i}">Apply</a>' for i in range(80))
    df = spark.createDataFrame([(1, "https://e.com/", html)], "page_id int, url string, html string")
    (row,) = ops.candidates_by_host(ops.ranked_candidates(df)).collect()
    assert row.n == 80


def test_apply_is_found_behind_a_long_text(spark):
    html = f'<a href="/x">{"word " * 40}apply</a>'
    df = spark.createDataFrame([(1, "https://e.com/", html)], "page_id int, url string, html string")
    (row,) = ops.ranked_candidates(df).collect()
    assert row.score == 0.4 and len(row.text) == H.CANDIDATE_TEXT


def test_form_fields(page):
    fields = value(page, H.form_fields(F.col("html")))
    assert [(f.tag, f.type, f.name, f.placeholder, f.selector) for f in fields] == [
        ("input", "text", "q", None, '[name="q"]'), ("input", "password", None, None, "#pw"),
        ("button", "submit", None, None, None), ("span", None, None, None, '[aria-label="Open "x""]')]


def test_expandable(page):
    assert value(page, H.expandable_texts(F.col("html"))) == ["show more text"]


@pytest.mark.parametrize("selector, text", [
    ("h1", None), ("a", "Jobs now"), ("#main", "FirstSecond Engineer"), (".wide", "FirstSecond Engineer"),
    ("div.job-description.wide", "FirstSecond Engineer"), ("div.job-description.narrow", None),
    ("[data-testid*='title']", "Engineer"), ("[data-testid='job-title-1']", "Engineer"), ("[DATA='x']", None),
    (".jobsearch-InlineCompanyRating a", "Acme"), ("nav .jobsearch-InlineCompanyRating a", None),
    ("body div a", "Acme"), ("h1, #pw", ""), ("button[aria-label*='see more' i]", "Show more text"),
    ("button[aria-label*='see more']", None), ("div:has(p)", None), ("a[href^='https']", "Acme"),
    ("a[href$='apply']", "Acme"), ("", None), ("> div", None), ("div[class", None), ("script", ""),
])
def test_selectors(page, selector, text):
    match = value(page, match_selectors(F.col("html"), F.array(F.lit(selector))))[0]
    assert match.found == (text is not None)
    assert match.text == text


def test_apply_candidates(spark):
    html = """<a id="go1" href="/apply/1" aria-label="Apply">Apply here</a><a href="/x">Reapply</a>
      <a class="b 1x c-d e f" data-a="1" data-b='%s' data-c=3 href="mailto:apply@x.y">mail</a>
      <button class=big>Apply <i>now</i></button><a role="button" href="/y" aria-label="apply">y</a>
      <a href="/apply/2"><button>inner apply</button></a>""" % ("v" * 40)
    df = spark.createDataFrame([(1, "https://e.com/", html)], "page_id int, url string, html string")
    got = [(r["rank"], r.selector, r.href, r.text, r.tag, r.score) for r in ops.ranked_candidates(df).orderBy("rank").collect()]
    assert got == [
        (1, "#go1", "https://e.com/apply/1", "Apply here", "a", 1.0),
        (2, "a", "https://e.com/apply/2", "inner apply", "a", 0.9),
        (3, 'a.b.c-d.e[data-a="1"][data-b="%s"]' % ("v" * 40), None, "mail", "a", 0.5),
        (4, "button.big", None, "Apply now", "button", 0.4),
        (5, "button", None, "inner apply", "button", 0.4),
        (6, "a", "https://e.com/y", "y", "a", 0.3),
        (7, "a", None, "y", "a", 0.3)]
    assert ops.ranked_candidates(df, 2).count() == 2


CONFIG = ("struct<internal_apply_markers:array<string>,apply_link_selectors:array<string>,"
          "apply_button_selectors:array<string>>")


@pytest.mark.parametrize("config, expected", [
    (None, ("unknown", "no_config", None)),
    ((["#main"], ["a"], None), ("internal", "internal_marker: #main", None)),
    ((None, ["a[href='../up']", "div a"], None), ("resolved", "link_selector: div a", "https://acme.test/apply")),
    ((None, ["nav a"], None), ("failed", "no_selector_matched", None)),
    ((None, None, ["button"]), ("failed", "no_selector_matched", None)),
    (([], [], []), ("unknown", "config_empty", None)),
])
def test_apply_url(spark, config, expected):
    df = spark.createDataFrame([(PAGE, config)], f"html string, apply_resolver_config {CONFIG}")
    row = ops.apply_url(df).first()
    assert (row.apply_url_status, row.reason, row.apply_url) == expected


def test_apply_url_without_page(spark):
    df = spark.createDataFrame([(None, ([], [], []))], f"html string, apply_resolver_config {CONFIG}")
    assert ops.apply_url(df).first().reason == "no_browser_page"


def _profiled(spark, html, auth=None, blocked=None, job=None, ready=None):
    return spark.createDataFrame([(1, html, auth, blocked, job, ready)],
                                 "page_id int, html string, authenticated map<string,string>, "
                                 "blocked map<string,string>, job_data map<string,string>, "
                                 "ready_selector string")


def test_selector_check(spark):
    row = ops.selector_check(_profiled(spark, PAGE, {"me": "#nope"}, {"b": "nav a"},
                                       {"t": "h1", "d": ".job-description"})).first()
    assert (row.is_authenticated, row.is_blocked, row.job_data_matched) == (False, True, ["d"])
    row = ops.selector_check(_profiled(spark, PAGE)).first()
    assert (row.is_authenticated, row.is_blocked, row.job_data_matched) == (False, False, [])


def test_discovery(spark):
    row = ops.discover_selectors(spark.createDataFrame([(PAGE,)], "html string")).first()
    assert row.discovered == {"company_name": ".jobsearch-InlineCompanyRating a",
                              "description": ".job-description"}
    assert row.candidate_ready_selector is None
    html = "<h1>Plain</h1><h1 class='job-title'>x</h1><div class=salary-range> </div>"
    row = ops.discover_selectors(spark.createDataFrame([(html,)], "html string")).first()
    assert row.discovered == {"title": "h1"} and row.candidate_ready_selector == "h1.job-title"


def test_capture(spark):
    wall = "<body>Please wait <div id=me>you</div></body>"
    assert ops.capture_result(_profiled(spark, wall)).first().error == "login_wall_detected"
    assert ops.capture_result(_profiled(spark, wall, {"me": "#me"})).first().error is None
    row = ops.capture_result(_profiled(spark, wall, {"me": "#me"}, {"b": "#me"})).first()
    assert (row.error, row.content) == ("blocked_page_detected", "")
    row = ops.capture_result(_profiled(spark, "<body>Fine</body>")).first()
    assert (row.error, row.content, row.words) == (None, "Fine", 1)
    html = "<body><h1 class=job-title>Engineer</h1></body>"
    row = ops.capture_result(_profiled(spark, html)).first()
    assert (row.discovered, row.candidate_ready_selector) == ({"title": "h1.job-title"}, "h1.job-title")
    row = ops.capture_result(_profiled(spark, html, job={"title": "h1"}, ready="h1")).first()
    assert (row.discovered, row.candidate_ready_selector, row.job_data_matched) == (None, None, ["title"])


@pytest.mark.parametrize("html, selector, text", [
    ("<section><div class=x>in</section>out</div>", ".x", "in"),          # an outer end tag closes
    ("<div class=x>a</span>b</div>c", ".x", "ab"),                         # an end tag without a start
    ("<p class=x>one<div>two</div>", ".x", "one"),                         # a block ends a paragraph
    ("<div class=x>a<br>b<img src='>'>c</div>", ".x", "abc"),
    ("<div class=x>1 < 2 &amp; 3<!-- </div> --></div>", ".x", "1 < 2 & 3"),
    ("<DIV CLASS='a  x'>t</DIV>", "div.x", "t"), ("<div class=X>t</div>", ".x", None),
    ("<div class='a&#45;b'>t</div>", ".a-b", "t"),                         # a name behind a reference
    ("<div><i>no</i></div><i>no</i><ul><li><i>yes</i></li></ul>", "ul li i", "yes"),
    ("<div><div><b>t</b></div></div>", "div div b", "t"), ("<div><b>t</b></div>", "div div b", None),
    ("<noscript><i>x</i></noscript>", "i", ""), ("<a/>after", "a", ""), ("", "a", None), ("<", "a", None),
])
def test_selectors_on_awkward_markup(spark, html, selector, text):
    df = spark.createDataFrame([(html, [selector])], "html string, s array<string>")
    match = df.select(match_selectors(F.col("html"), F.col("s")).alias("m")).first().m[0]
    assert (match.found, match.text) == (text is not None, text)


def test_ranges_nest(spark):
    """Ranges of a random page equal those of a plain stack."""
    import random
    from capture_analytics.functions import elements as E
    random.seed(3)
    names = ["div", "p", "span", "a", "br", "li", "button"]
    html = "".join(random.choice([f"<{n}>", f"</{n}>", "text", f"<{n} x='>'>"])
                   for n in random.choices(names, k=700))
    tokens, stack, expected = E.tokens(F.col("html")), [], {}
    row = spark.createDataFrame([(html,)], "html string").select(
        tokens.alias("t"), E.ranges(E.tags(tokens), F.size(tokens)).alias("r")).first()
    assert "".join(row.t) == html

    def close(depth, last):
        while len(stack) > depth:
            expected[stack.pop()[1]] = last
    for i, token in enumerate(row.t):
        if not token.startswith("<"):
            continue
        name = token.strip("</>").split()[0]
        places = [d for d, (n, _) in enumerate(stack) if n == name]
        if token.startswith("</"):
            if places:
                close(places[-1], i)
            continue
        if name in E.UNNESTED and places:
            close(places[-1], i - 1)
        elif name in E.CLOSES_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1, i - 1)
        if name in E.VOID:
            expected[i] = i
        else:
            stack.append((name, i))
    close(0, len(row.t) - 1)
    assert [(r["first"], r["last"]) for r in row.r] == sorted(expected.items())


def test_a_page_of_many_links(spark):
    html = "".join(f"<div><a href='/l{i}'>link <b>{i}</b></a><p>text</div>" for i in range(3000))
    df = spark.createDataFrame([(html,)], "html string")
    links = df.select(H.page_links(F.col("html"), F.lit("http://e.com/")).alias("x")).first().x
    assert [x.text for x in links] == [f"link {i}" for i in range(3000)]
    found = df.select(match_selectors(F.col("html"), F.array(F.lit("div a[href='/l2999'] b"))).alias("x"))
    assert found.first().x[0].text == "2999"


@pytest.mark.parametrize("name", ["selector_check", "selector_discovery", "apply_url", "capture_class"])
def test_selectors_need_no_python(spark, name):
    from capture_analytics.plans import PLANS
    plan = PLANS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|In(?:Pandas|Arrow)|PythonUDF|pythonUDF", plan)
