"""URL functions against exact cases and against the standard library."""

import base64
import re
from urllib.parse import parse_qs, parse_qsl, quote, unquote, urlencode, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capture_analytics.functions import urls as U


def apply(spark, values, function, *extra):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.x for r in rows.select("i", function(F.col("u"), *extra).alias("x")).orderBy("i").collect()]


def std_canonical(url):
    """The canonical form as the standard library would write it."""
    parts = urlparse(url)
    dropped = re.compile("|".join([f"({'|'.join(U.CANONICAL_DROP_NAMES)})$", *U.CANONICAL_DROP_PREFIXES]))
    query = [(n, v) for n, v in parse_qsl(parts.query, keep_blank_values=True) if not dropped.match(n.lower())]
    return parts._replace(path=re.sub("/+", "/", parts.path), query=urlencode(query), fragment="").geturl()


def std_b64(text):
    try:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode()
    except ValueError:
        return ""


def std_unwrap(url, layers=5):
    """Follow the first usable target, layer by layer."""
    given = {}
    for name, values in parse_qs(urlparse(url).query).items():
        given[name.lower()] = unquote(values[0])
    readings = (read for name in U.TARGET_PARAMS if name in given
                for read in (given[name], std_b64(given[name])))
    inner = next((r for r in readings if re.match("https?://", r)), url)
    return url if inner == url or not layers else std_unwrap(inner, layers - 1)


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


URLS = [
    "https://x.com/jobs?utm_source=email&utm_medium=cpc&id=42", "https://x.com/jobs#apply", "",
    "https://A.com//x///y?b=1&&a&c=%20z+~*&d=%zz#f", "HTTP://a.com", "http://a.com?x", "mailto:x@y",
    "http://a.com/p;/q;?a=1", "http://u@h.com:80/?q=1", "?a=b", "//h/x?q=é", "http://a.com/?a=%E9&b=é&ref=1",
    " http://x.com/a b?c=d e", "https://x.com/j?locale=en&source=li&TRK=1&Ref=2&trkInfo=3&vq_x=4",
    "https://x.com/?a=1;b=2&c=%2B+%26", "http:/a//b", "https://x.com/a\tb\n?c",
]


def test_canonicalize(spark):
    assert apply(spark, URLS, U.canonicalize_url) == [std_canonical(u) for u in URLS]
    assert apply(spark, [None], U.canonicalize_url) == [None]


def test_strip_tracking(spark):
    def expected(url):
        parts = urlparse(url)
        query = [pair for pair in parse_qsl(parts.query, keep_blank_values=True)
                 if pair[0] not in U.TRACKING_PARAMS]
        return parts._replace(query=urlencode(query)).geturl() if parts.query else url
    urls = [*URLS, "https://x.com/?trk=1&TRK=2&refId=3&refid=4#top"]
    assert apply(spark, urls, U.strip_tracking_params) == [expected(u) for u in urls]


def test_hosts(spark):
    urls = [*URLS, "https://www.Example.com:8443/x", "http://u:p@www.a.b/x", "https://[::1]:80/x"]
    assert apply(spark, urls, U.hostname) == [(urlparse(u).hostname or "") for u in urls]
    assert apply(spark, ["https://WWW.x.com/a", "https://wwwx.com"], U.url_host) == ["x.com", "wwwx.com"]
    assert apply(spark, ["Example.COM/jobs", "https://A.b/c", "", "x"], U.extract_host) == ["example.com", "a.b", "", "x"]
    assert apply(spark, [".LinkedIn.com", "www.x.com"], U.normalize_host) == ["linkedin.com", "x.com"]


WRAPPED = [
    "https://www.google.com/url?q=https://x.com/a&sa=D", "https://click.indeed.com/r?url=https%3A%2F%2Fx.com%2Fa%3Fb%3D1",
    "https://t.co/?u=" + b64("https://x.com/job?id=7"), "https://t.co/?u=" + b64("https://x.com/jo"),
    "https://t/?redirect=" + quote("https://s/?url=" + quote("https://in/", safe=""), safe=""),
    "https://x.com/?q=hello", "https://x.com/?q=&u=https://z", "https://x.com/?URL=https://a&url=https://b&URL=https://c",
    "https://x.com/plain", "", "https://loop/?url=https%3A%2F%2Floop%2F%3Furl%3Dx", "https://t/?u=a+b%2Bc",
    "https://t/?destination=nope&target=https://ok/%2541", "https://t/?u=" + b64("ftp://x"),
    "https://t/?u=" + "/".join(["https%3A%2F%2Fa"]) + "&redirect_url=https%3A%2F%2Fb",
]


def test_unwrap(spark):
    assert apply(spark, WRAPPED, U.unwrap_url) == [std_unwrap(u) for u in WRAPPED]


def test_unwrap_stops_at_depth(spark):
    url = "https://end/"
    for i in range(8):
        url = f"https://l{i}/?url={quote(url, safe='')}"
    assert apply(spark, [url], U.unwrap_url) == [std_unwrap(url)]


_QUERY = st.lists(st.tuples(
    st.sampled_from(["id", "utm_x", "REF", "a b", "é", "q", "trk", "u", "url", "src2"]),
    st.sampled_from(["", "1", "a+b", "https://x.com/?a=1", "é&", "%41", "~*", "x y"])), max_size=5)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["/", "/a//b", "/x.html", ""]), _QUERY), min_size=15, max_size=30))
def test_random_urls_match_the_standard_library(spark, cases):
    urls = ["https://h.com" + path + ("?" + urlencode(q) if q else "") for path, q in cases]
    once = apply(spark, urls, U.canonicalize_url)
    assert once == [std_canonical(u) for u in urls]
    assert apply(spark, once, U.canonicalize_url) == once
    assert apply(spark, urls, U.unwrap_url) == [std_unwrap(u) for u in urls]


def test_urls_differ(spark):
    pairs = spark.createDataFrame([
        ("https://x.com/a?utm_source=1", "https://x.com/a"), ("https://x.com/a", "https://y.com/a"),
        ("https://linkedin.com/comm/1", "https://boards.io/1")], "s string, l string")
    assert [r.x for r in pairs.select(U.urls_differ(F.col("s"), F.col("l")).alias("x")).collect()] == [
        False, True, True]


def test_rewrites(spark):
    def rewritten(url, rules):
        return apply(spark, [url], U.apply_url_rewrites, rules)[0]
    url = "https://indeed.com/?vjk=abc123"
    rule = {"match": r"^https://indeed\.com/\?vjk=(\w+)", "rewrite": r"https://indeed.com/viewjob?jk=\1"}
    assert rewritten(url, [rule]) == "https://indeed.com/viewjob?jk=abc123"
    assert rewritten("https://x.com", [rule]) == "https://x.com"
    assert rewritten(url, [{"match": "[unclosed", "rewrite": "x"}, rule]).endswith("jk=abc123")
    assert rewritten(url, [{"match": "indeed", "rewrite": "indeed"}, rule]).endswith("jk=abc123")
    assert rewritten(url, [{"match": "(a)", "rewrite": r"\2"}, {"rewrite": "x"}, {"match": "x"}, "junk"]) == url
    assert rewritten(url, None) == url and rewritten(url, []) == url
    assert rewritten("a1b", [{"match": r"(?P<d>\d)", "rewrite": r"[\g<d>$\g<1>0]"}]) == "a[1$10]b"


def test_tracker_hosts(spark):
    hosts = ["click.indeed.com", "url12.alerts.jobot.com", "t.co", "links.a.sendgrid.net", "email.x-1.mailgun.org",
             "example.com", "click.a.com:80", "notclick.a.com"]
    assert apply(spark, hosts, U.is_tracker_host) == [
        re.match(U.TRACKER_HOST_PATTERN, h) is not None for h in hosts]
    urls = ["https://click.indeed.com/x", "https://example.com", "https://LNKD.in/a"]
    assert apply(spark, urls, U.is_known_tracker) == [True, False, True]


def test_dead_marker_reads_all_unless_told(spark):
    far = "x" * 17_000 + " job not found"
    wide = "é" * 9_000 + " job not found"
    assert apply(spark, ["Job Not Found", "This position has been filled", "fine", None, far, wide],
                 U.has_dead_marker) == [True, True, False, False, True, True]
    assert apply(spark, [far, wide, "no page: page not found"], U.has_dead_marker, 16_384) == [
        False, False, True]


def test_resolve_listing(spark):
    cases = [
        (("https://x.com/j?utm_source=1&id=2", 500, None, None, None), "https://x.com/j?id=2"),
        (("https://hiring.cafe/j?a=1", 200, None, "page not found", None), None),
        (("https://hiring.cafe/j?a=1", 404, None, "page not found", None), "https://hiring.cafe/j?a=1"),
        (("https://click.x.com/1?trk=2", 404, "https://y.com", "", None), None),
        (("https://click.x.com/1?trk=2", None, None, None, "timeout"), "https://click.x.com/1"),
        (("https://click.x.com/1", 200, "https://y.com/?utm_term=1", "ok", None), "https://y.com/"),
        (("https://click.x.com/1", 200, "https://y.com/", "Invalid link", None), None),
        (("https://click.x.com/1", 200, "https://t.y.com/", "ok", None), None)]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)],
                                 "i int, u string, s int, f string, b string, e string")
    got = rows.select("i", U.resolve_listing(*[F.col(c) for c in "usfbe"]).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [e for _, e in cases]


def test_absolute_url(spark):
    base = "https://e.com/d/e/f?x=1#z"
    refs = ["/a", "b", "../c", "./d", "//h/x", "#f", "?q=1", "https://o/", "", "../../../up", "a/../b?c=../d", "x/.."]
    from urllib.parse import urljoin
    got = apply(spark, refs, lambda href: U.absolute_url(F.lit(base), href))
    expected = [urljoin(base, r) for r in refs]
    expected[refs.index("")] = base.split("#")[0]
    assert got == expected


def test_extract_urls_and_routes(spark):
    assert apply(spark, ["see https://a.b/c?d=1, and (http://x.y/z). end", "none"], U.extract_urls) == [
        ["https://a.b/c?d=1", "http://x.y/z"], []]
    urls = ["/job-posts/5/questions/6/answers/7", "/questions/8", "/resumes/42/edit", "/about"]
    assert [tuple(r) for r in apply(spark, urls, U.route_ids)] == [
        ("5", "6", "7", "7"), (None, "8", None, "8"), (None, None, None, "42"), (None, None, None, None)]
