"""URL functions as native Column expressions (no Python in the hot path).

Spark's own `parse_url` raises on odd URLs and keeps the host's case, so the parts are
taken with one anchored regular expression each.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from capture_analytics.functions.base import let

# ---- fixed values ---------------------------------------------------------------

# Query parameters dropped from canonical URLs (names compared in lower case).
CANONICAL_DROP_NAMES = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "msclkid", "yclid",
    "mc_cid", "mc_eid",
    "_ga", "_gl",
    "igshid",
    "ref", "refid", "ref_id", "refsrc", "ref_src",
    "trackingid", "tracking_id",
    "lipi", "lgcadv", "lgcit",
    "eid", "midtoken", "midsig", "otptoken",
    "sharedid", "sharesource",
    "src",
)
CANONICAL_DROP_PREFIXES = ("utm_", "trk", "vq_", "mc_", "hsa_")

# Query parameters dropped when a listing URL is cleaned (case-sensitive).
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "gclid", "fbclid", "mc_cid", "mc_eid", "trackingId", "refId", "lipi", "eid",
    "midToken", "midSig", "otpToken", "trk", "trkEmail", "tsid", "ssid", "fmid",
    "email_source", "email_token",
)

# Parameters that carry a wrapped target URL, most specific first.
TARGET_PARAMS = ("redirect_url", "redirecturl", "destination", "target", "redirect",
                 "url", "u", "r", "q")

KNOWN_TRACKER_HOSTS = (
    "click.appcast.io", "click.linkedin.com", "click.mail.linkedin.com",
    "click.indeed.com", "www.google.com", "l.facebook.com", "lnkd.in",
)

TRACKER_HOST_PATTERN = (
    r"(?i)^(url\d*\.alerts\.jobot\.com|click\.ziprecruiter\.com"
    r"|email\.mg\d*\.ziprecruiter\.com|email\.mg\.ziprecruiter\.com"
    r"|url\d*\.mailmunch\.co|email\.[a-z0-9-]+\.mailgun\.org"
    r"|links?\.[a-z0-9.-]+\.sendgrid\.net|trk\.[a-z0-9.-]+|click\.[a-z0-9.-]+"
    r"|t\.[a-z0-9.-]+)$"
)
DEAD_CHECK_HOST_PATTERN = r"(?i)^((www\.)?hiring\.cafe|(www\.)?hiringcafe\.com)$"
DEAD_MARKER_PATTERN = (
    r"(?i)wrong link|invalid link|you have clicked on an invalid"
    r"|this (job|position|posting) (is )?(no longer|has been) (available|removed|filled)"
    r"|job (not found|expired|has been removed)|expired job"
    r"|posting (no longer|has been) (available|active)|page not found"
    r"|job you.re looking for|we.re sorry,? but this job has expired"
)
UNWRAP_DEPTH = 5

# ---- parts ----------------------------------------------------------------------

_CONTROL = "".join(chr(i) for i in range(1, 33))
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?\[?([^\]/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"#(.*)$"


def _tidy(url: Column) -> Column:
    return F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(_CONTROL))


def netloc(url: Column) -> Column:
    """Authority part, `user@host:port`, empty when there is none."""
    return F.regexp_extract(_tidy(url), _NETLOC, 1)


def hostname(url: Column) -> Column:
    """Lower-cased host without user and port, empty when there is none."""
    bracketed = F.regexp_extract(_tidy(url), r"^(?:[^/?#]*:)?//(?:[^/?#]*@)?\[([^\]]*)\]", 1)
    return F.lower(F.when(bracketed != "", bracketed)
                   .otherwise(F.regexp_extract(_tidy(url), _HOST, 1)))


def normalize_host(host: Column) -> Column:
    """Lower case, leading dots and one leading `www.` removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^\.+", ""), r"^www\.", "")


def url_host(url: Column) -> Column:
    """Host key of a URL: lower case without `www.`."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def extract_host(text: Column) -> Column:
    """Host of a URL or of a bare `host/path`."""
    trimmed = F.trim(text)
    host = hostname(trimmed)
    return F.lower(F.when(trimmed.contains("://"),
                          F.when(host != "", host).otherwise(trimmed))
                   .otherwise(F.split_part(trimmed, F.lit("/"), F.lit(1))))


def form_decode(text: Column) -> Column:
    """Form decoding; a malformed percent sign stands for itself."""
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def form_encode(text: Column) -> Column:
    """Form encoding that leaves letters, digits and `_.-~` as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")),
                     F.lit("%7E"), F.lit("~"))


def percent_decode(text: Column) -> Column:
    """Percent decoding that leaves `+` alone."""
    return form_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_pairs(url: Column) -> Column:
    """Decoded `(name, value)` pairs of the query string, in order."""
    def pair(segment: Column) -> Column:
        return F.struct(
            form_decode(F.regexp_extract(segment, r"^([^=]*)", 1)).alias("name"),
            form_decode(F.regexp_extract(segment, r"^[^=]*=(.*)$", 1)).alias("value"))

    segments = F.split(F.regexp_extract(_tidy(url), _QUERY, 1), "&")
    return F.transform(F.filter(segments, lambda s: s != ""), pair)


def _join_query(pairs: Column) -> Column:
    return F.array_join(F.transform(
        pairs, lambda p: F.concat(form_encode(p["name"]), F.lit("="), form_encode(p["value"]))), "&")


def _rebuild(url: Column, path: Column, query: Column, fragment: Column) -> Column:
    clean = _tidy(url)
    scheme = F.lower(F.regexp_extract(clean, _SCHEME, 1))
    authority = F.regexp_extract(clean, _NETLOC, 1)
    path = F.regexp_replace(path, r"(^|/)([^;/]*);$", "$1$2")
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    body = (F.when(authority != "", F.concat(F.lit("//"), authority, rooted))
            .when(path.startswith("//"), F.concat(F.lit("//"), path))
            .when(scheme.isin("http", "https", "ftp")
                  & ((path == "") | path.startswith("/")), F.concat(F.lit("//"), path))
            .otherwise(path))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        body,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


# ---- canonical forms ------------------------------------------------------------

def canonicalize_url(url: Column) -> Column:
    """Identity form of a URL: no tracking parameters, no fragment, single slashes."""
    def wanted(p: Column) -> Column:
        name = F.lower(p["name"])
        drop = name.isin(*CANONICAL_DROP_NAMES)
        for prefix in CANONICAL_DROP_PREFIXES:
            drop = drop | name.startswith(prefix)
        return ~drop

    has_query = url.contains("?")
    query = F.when(has_query, _join_query(F.filter(query_pairs(url), wanted))).otherwise("")
    path = F.regexp_replace(F.regexp_extract(_tidy(url), _PATH, 1), "/+", "/")
    return F.when(F.coalesce(url, F.lit("")) == "", url).otherwise(
        _rebuild(url, path, query, F.lit("")))


def strip_tracking_params(url: Column) -> Column:
    """Drop the listing tracking parameters; a URL without a query is left as it is."""
    raw_query = F.regexp_extract(_tidy(url), _QUERY, 1)
    query = _join_query(F.filter(query_pairs(url), lambda p: ~p["name"].isin(*TRACKING_PARAMS)))
    path = F.regexp_extract(_tidy(url), _PATH, 1)
    return F.when(raw_query == "", url).otherwise(
        _rebuild(url, path, query, F.regexp_extract(_tidy(url), _FRAGMENT, 1)))


def urls_differ(submitted: Column, landed: Column) -> Column:
    """True when both URLs stand for different pages after canonicalisation."""
    return ~canonicalize_url(submitted).eqNullSafe(canonicalize_url(landed))


# ---- rewrites -------------------------------------------------------------------

def java_replacement(template: str) -> str:
    """Write a Python replacement template the way `regexp_replace` reads it."""
    def token(match: re.Match) -> str:
        text = match.group(0)
        if match.group("name"):
            name = match.group("name")
            return f"${name}" if name.isdigit() else f"${{{name}}}"
        if match.group("num"):
            return f"${match.group('num')}"
        if text == "$":
            return r"\$"
        if text == "\\\\":
            return r"\\"
        return {r"\n": "\n", r"\t": "\t", r"\r": "\r"}.get(text, text)

    return re.sub(r"\\g<(?P<name>\w+)>|\\(?P<num>\d{1,2})|\\.|\$", token, template)


def usable_rules(rules: Sequence[dict] | None) -> list[tuple[str, str]]:
    """Rules that can run, as `(pattern, replacement)` in JVM spelling.

    A bad pattern would fail the whole Spark job, so a rule whose pattern or replacement
    does not compile is left out here, before any plan is built.
    """
    kept = []
    for rule in rules or []:
        if not isinstance(rule, dict):
            continue
        pattern, rewrite = rule.get("match"), rule.get("rewrite")
        if not pattern or rewrite is None:
            continue
        try:
            re.sub(pattern, rewrite, "")
        except (re.error, TypeError):
            continue
        kept.append((pattern.replace("(?P<", "(?<"), java_replacement(rewrite)))
    return kept


def apply_url_rewrites(url: Column, rules: Sequence[dict] | None) -> Column:
    """First rule that changes the URL wins; no rule, no change."""
    options = []
    for pattern, rewrite in usable_rules(rules):
        changed = F.regexp_replace(url, F.lit(pattern), F.lit(rewrite))
        options.append(F.when(changed != url, changed))
    return F.coalesce(*options, url) if options else url


def apply_rule_array(url: Column, rules: Column) -> Column:
    """As `apply_url_rewrites`, with the rules in an array column of checked rules."""
    def step(found: Column, rule: Column) -> Column:
        changed = F.regexp_replace(url, rule["match"], rule["rewrite"])
        return F.coalesce(found, F.when(changed != url, changed))

    return F.coalesce(F.aggregate(rules, F.lit(None).cast("string"), step), url)


# ---- unwrapping -----------------------------------------------------------------

def _is_http(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")


def b64_url(value: Column) -> Column:
    """URL held in url-safe base64 with optional padding, else NULL. Characters outside the
    alphabet are skipped."""
    body = F.regexp_replace(F.translate(value, "-_", "+/"), r"[^A-Za-z0-9+/]", "")
    usable = (body != "") & (F.length(body) % 4 != 1)
    padded = F.rpad(body, (F.ceil(F.length(body) / F.lit(4)) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(F.when(usable, padded), F.lit("base64")).cast("string")
    return F.when(F.is_valid_utf8(text) & _is_http(text), text)


def _unwrap_once(url: Column) -> Column:
    """Target URL one layer down, NULL when there is none."""
    def carried(pairs: Column, key: Column) -> Column:
        same = F.filter(pairs, lambda p: F.lower(p["name"]) == key)
        spelling = F.try_element_at(
            F.array_distinct(F.transform(same, lambda p: p["name"])), F.lit(-1))
        first = F.try_element_at(F.filter(same, lambda p: p["name"] == spelling), F.lit(1))
        raw = percent_decode(first["value"])
        return F.when(_is_http(raw), raw).otherwise(b64_url(raw))

    def pick(pairs: Column) -> Column:
        found = F.transform(F.array(*[F.lit(k) for k in TARGET_PARAMS]),
                            lambda key: carried(pairs, key))
        return F.try_element_at(F.filter(found, lambda c: c.isNotNull()), F.lit(1))

    filled = F.filter(query_pairs(url), lambda p: (p["value"] != "")
                      & F.lower(p["name"]).isin(*TARGET_PARAMS))
    return F.when(url.contains("?"), let(filled, pick))


def unwrap_url(url: Column, max_depth: int = UNWRAP_DEPTH) -> Column:
    """Innermost http(s) URL carried in redirect parameters, at most `max_depth` layers."""
    rounds = F.array(*[F.lit(i) for i in range(max_depth)])
    inner = F.aggregate(rounds, url, lambda u, _: F.coalesce(_unwrap_once(u), u))
    return F.when(url.contains("?"), inner).otherwise(url)


# ---- host classes and dead listings ----------------------------------------------

def is_known_tracker(url: Column) -> Column:
    return hostname(url).isin(*KNOWN_TRACKER_HOSTS)


def is_tracker_host(host: Column) -> Column:
    return host.rlike(TRACKER_HOST_PATTERN)


def is_dead_check_host(host: Column) -> Column:
    return host.rlike(DEAD_CHECK_HOST_PATTERN)


def has_dead_marker(body: Column, peek_bytes: int | None = None) -> Column:
    """Listing text says the job is gone. All of it is read, or with `peek_bytes` only so many
    bytes, as a check of a live response would."""
    seen = body
    if peek_bytes is not None:
        seen = F.when(F.octet_length(body) <= peek_bytes, body).otherwise(
            F.substring(F.encode(body, "UTF-8"), 1, peek_bytes).cast("string"))
    return F.coalesce(seen.rlike(DEAD_MARKER_PATTERN), F.lit(False))


def resolve_listing(url: Column, status: Column, final_url: Column, body: Column,
                    error: Column, peek_bytes: int | None = None) -> Column:
    """Cleaned listing URL after a logged fetch, NULL when the listing is dead."""
    host = netloc(url)
    dead = has_dead_marker(body, peek_bytes)
    reached = error.isNull() & (status < 400)
    direct = F.when(is_dead_check_host(host) & reached & dead, F.lit(None)).otherwise(
        strip_tracking_params(url))
    tracked = (F.when(error.isNotNull(), strip_tracking_params(url))
               .when(status >= 400, F.lit(None))
               .when(dead, F.lit(None))
               .when(is_tracker_host(netloc(final_url)), F.lit(None))
               .otherwise(strip_tracking_params(final_url)))
    return F.when(is_tracker_host(host), tracked).otherwise(direct)


# ---- URLs in text and routes ------------------------------------------------------

def extract_urls(text: Column) -> Column:
    """http(s) URLs embedded in free text, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def _route_id(url: Column, route: str) -> Column:
    found = F.regexp_extract(url, rf"/{route}/([0-9]+)", 1)
    return F.when(found != "", found)


def route_ids(url: Column) -> Column:
    """Ids named by an application route, and the most specific of them."""
    post, question, answer = (_route_id(url, r) for r in ("job-posts", "questions", "answers"))
    number = F.regexp_extract(url, r"/([0-9]+)(?:/|$)", 1)
    return F.struct(
        post.alias("job_post_id"), question.alias("question_id"), answer.alias("answer_id"),
        F.coalesce(answer, question, post, F.when(number != "", number)).alias("resource_id"))


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve `href` against the page address, dot segments included."""
    ref = F.trim(href)
    scheme = F.lower(F.regexp_extract(base, _SCHEME, 1))
    origin = F.concat(scheme, F.lit("://"), netloc(base))
    base_path = F.regexp_extract(base, _PATH, 1)
    folder = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*$", "")
    bare = F.regexp_replace(base, r"#.*$", "")
    joined = F.when(ref.startswith("/"), ref).otherwise(F.concat(folder, ref))
    tail = F.regexp_extract(joined, r"([?#].*)$", 1)
    parts = F.split(F.regexp_replace(joined, r"[?#].*$", ""), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    ends_in_dots = F.element_at(parts, -1).isin(".", "..")
    path = F.concat(F.array_join(kept, "/"), F.when(ends_in_dots, F.lit("/")).otherwise(""))
    return (F.when(ref.rlike(_SCHEME), ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref == "", bare)
            .when(ref.startswith("#"), F.concat(bare, ref))
            .when(ref.startswith("?"), F.concat(F.regexp_replace(bare, r"\?.*$", ""), ref))
            .otherwise(F.concat(origin, F.when(joined.contains("./") | ends_in_dots,
                                               F.concat(path, tail)).otherwise(joined))))
