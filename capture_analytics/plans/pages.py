"""Queries over captured html."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_analytics.functions import html as H
from capture_analytics.functions.text import word_count
from capture_analytics.operators import pages as ops
from capture_analytics.operators.ordered import top_per_key
from capture_analytics.operators.profiles import with_profile
from capture_analytics.plans import sqltext as S
from capture_analytics.plans.registry import query
from capture_analytics.sources.views import view


def _rows(spark, folder, name):
    return view(spark, folder, name)


# references as they come in the pages, and some by name and number that the views below add
_REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
               ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&#233;", "é"),
               ("&Eacute;", "É"), ("&#8211;", "–"), ("&#x27;", "'"), ("&rsquo;", "’"), ("&#150;", "–"),
               ("&#x1F600;", "😀"), ("&#55296;", "\ufffd"), ("&amp;", "&"))
_WITH_REFERENCES = """replace(replace(html, '<title>', '<title>&Eacute;t&#233; &#150; '), '<article>',
    '<article><p>caf&eacute; &#8211; we&#x27;re &rsquo;logging&rsquo; &amp;lt; &unknown; A&B &#55296; &#x1F600;</p>')"""


def _decoded(text: str) -> str:
    for name, char in _REFERENCES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


def _squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


def _visible(html: str) -> str:
    hidden = "|".join(f"<{tag}\\b[^>]*>.*?</{tag}\\s*>" for tag in H.HIDDEN)
    bare = f"regexp_replace({html}, '(?is)<!--.*?-->|{hidden}', ' ', 'g')"
    inline = f"regexp_replace({bare}, '(?i)</?(?:{'|'.join(H.INLINE)})(?:\\s[^>]*)?>', '', 'g')"
    return _squeezed(_decoded(f"regexp_replace({inline}, '<[^>]*>', ' ', 'g')"))


_TITLE = _squeezed(_decoded("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"))


@query("page_text", f"select page_id, content, {S.words('content')} as words from ("
                    f"select page_id, {_visible(_WITH_REFERENCES)} as content from [pages]) t")
def page_text(spark, folder):
    pages = _rows(spark, folder, "pages").withColumn("html", F.expr(_WITH_REFERENCES))
    return ops.page_scan(pages).select(
        "page_id", "content", word_count(F.col("content")).alias("words"))


@query("page_title", f"select page_id, {_TITLE} as title from (select page_id, {_WITH_REFERENCES} as html from [pages]) t")
def page_title(spark, folder):
    return _rows(spark, folder, "pages").select(
        "page_id", H.page_title(F.expr(_WITH_REFERENCES)).alias("title"))


_LINKS = """select page_id, url, html, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*')) as tag,
    unnest(generate_series(1, len(regexp_extract_all(html, '<a href="[^"]*">[^<]*')))) as position from [pages]"""


@query("page_links", f"""select page_id, position, {_squeezed(_decoded("regexp_extract(tag, '>([^<]*)', 1)"))} as text,
    lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || {S.netloc('url')}
        || {_decoded("regexp_extract(tag, 'href=.([^>]*).>', 1)")} as href
from ({_LINKS}) l""")
def page_links(spark, folder):
    return _rows(spark, folder, "pages").select("page_id", F.posexplode(
        H.page_links(F.col("html"), F.col("url"))).alias("at", "link")).select(
            "page_id", (F.col("at") + 1).cast("bigint").alias("position"), "link.text", "link.href")


_ORIGIN = f"regexp_extract(url, '^[a-z]+://', 0) || {S.netloc('url')}"
_CANDIDATES = f"""select page_id, {S.bare_host('url')} as host, case page_id % 5 when 0 then '#apply-now'
        when 1 then 'button.apply-btn.big[data-job="' || page_id || '"]' when 2 then 'div.jobs-apply' else 'a' end as selector,
    case page_id % 5 when 0 then {_ORIGIN} || '/apply/' || page_id
        when 3 then 'https://boards.example.org/apply?job=' || page_id end as href,
    case page_id % 5 when 0 then 'Apply now' when 1 then 'Apply' when 2 then 'Apply with profile' else 'Go' end as text,
    case page_id % 5 when 1 then 'button' when 2 then 'div' else 'a' end as tag,
    cast(case page_id % 5 when 0 then 0.9 when 1 then 0.7 when 2 then 0.4 else 0.8 end as double) as score,
    case page_id % 5 when 0 then 'href contains ''apply'' AND text ''apply''' when 1 then 'text ''apply'' AND aria-label ''apply'''
        when 2 then 'text ''apply''' else 'href contains ''apply'' AND aria-label ''apply''' end as reason
    from [html_apply] where contains(html, '<article>') and page_id % 5 <> 4"""


@query("apply_candidates", f"select page_id, cast(1 as bigint) as rank, selector, href, text, tag, score, reason from ({_CANDIDATES}) c")
def apply_candidates(spark, folder):
    return ops.ranked_candidates(_rows(spark, folder, "html_apply")).drop("host")


@query("apply_candidates_by_host", f"""select host, selector, count(*) as n, round(avg(score), 6) as avg_score,
    max(score) as max_score from ({_CANDIDATES}) c group by host, selector""")
def apply_candidates_by_host(spark, folder):
    return ops.candidates_by_host(ops.ranked_candidates(_rows(spark, folder, "html_apply")))


@query("top_candidates", f"""select page_id, selector, score, row_number() over (
    partition by page_id order by score desc, selector) as rank from ({_CANDIDATES}) c""")
def top_candidates(spark, folder):
    stored = ops.ranked_candidates(_rows(spark, folder, "html_apply")).select("page_id", "selector", "score")
    return top_per_key(stored, ["page_id"], [F.desc_nulls_last("score"), F.col("selector")],
                       ops.MAX_CANDIDATES)


@query("form_fields", """select page_id, unnest(['div', 'input', 'input', 'button']) as tag,
    unnest([null, 'text', 'password', 'submit']) as type, unnest([null, 'email', null, null]) as name,
    unnest([null, 'mail', null, null]) as placeholder,
    unnest([null, '[name="email"]', '#pw', '[aria-label="Sign in"]']) as selector
    from [html_apply] where contains(html, '<article>') and page_id % 5 = 2""")
def form_fields(spark, folder):
    return _rows(spark, folder, "html_apply").select(
        "page_id", F.explode(H.form_fields(F.col("html"))).alias("f")).select(
            "page_id", "f.tag", "f.type", "f.name", "f.placeholder", "f.selector")


@query("html_features", """select page_id, case when contains(html, '<article>') and page_id % 5 = 2 then 4 else 0 end as n_fields,
    case when contains(html, '<article>') and page_id % 5 = 1 then 2 else 0 end as n_more_buttons from [html_apply]""")
def html_features(spark, folder):
    return _rows(spark, folder, "html_apply").select(
        "page_id", F.size(H.form_fields(F.col("html"))).alias("n_fields"),
        F.size(H.expandable_texts(F.col("html"))).alias("n_more_buttons"))


_HAS_H1 = "length(trim(regexp_extract(html, '<h1>([^<]*)', 1))) > 1"


@query("selector_discovery", f"""select page_id,
    case when page_id % 5 = 3 and art then 'h1.job-title' when {_HAS_H1} then 'h1' end as title,
    case when page_id % 5 = 3 and art then '.company-name' end as company_name,
    case when page_id % 5 = 4 and art then '.job-description' end as description,
    case when page_id % 5 = 4 and art then '.salary-range' end as salary,
    case when page_id % 5 = 3 and art then 'h1.job-title' end as ready
from (select *, contains(html, '<article>') as art from [html_apply]) t""")
def selector_discovery(spark, folder):
    found = ops.discover_selectors(_rows(spark, folder, "html_apply"))
    return found.select("page_id", *[F.try_element_at("discovered", F.lit(f)).alias(f) for f in (
        "title", "company_name", "description", "salary")], F.col("candidate_ready_selector").alias("ready"))


def _profiled(spark, folder, pages):
    def selectors(**by_name):
        return F.create_map(*[F.lit(x) for item in by_name.items() for x in item])
    known = view(spark, folder, "profiles").select(
        "id", "hostname", F.when(F.col("id") % 2 == 0, F.col("ready_selector")).alias("ready_selector"),
        selectors(me="#apply-now").alias("authenticated"),
        selectors(captcha=".captcha-box", odd="div:has(p)").alias("blocked"),
        selectors(title="h1.job-title", company="article .company-name", none="nav .company-name")
        .alias("job_data"),
        F.struct(F.array(F.lit(".jobs-apply")).alias("internal_apply_markers"),
                 F.array(F.lit("a.apply-link"), F.lit("a[href*='apply?']")).alias("apply_link_selectors"),
                 F.array(F.lit("button.apply-btn")).alias("apply_button_selectors")
                 ).alias("apply_resolver_config"))
    return with_profile(pages, known)


_KNOWN = f"exists (select 1 from [profiles] f where f.hostname = {S.bare_host('p.url')}) as known"


@query("selector_check", f"""select page_id, known and art and page_id % 5 = 0 as is_authenticated,
    known and art and page_id % 5 = 4 as is_blocked,
    case when known and art and page_id % 5 = 3 then 'company,title' else '' end as job_data_matched
from (select *, contains(html, '<article>') as art, {_KNOWN} from [html_apply] p) t""")
def selector_check(spark, folder):
    return ops.selector_check(_profiled(spark, folder, _rows(spark, folder, "html_apply"))).select(
        "page_id", "is_authenticated", "is_blocked",
        F.array_join(F.array_sort("job_data_matched"), ",").alias("job_data_matched"))


@query("apply_url", f"""select page_id, case when not known then 'unknown' when art and page_id % 5 = 2 then 'internal'
        when art and page_id % 5 = 3 then 'resolved' else 'failed' end as apply_url_status,
    case when not known then 'no_config' when art and page_id % 5 = 2 then 'internal_marker: .jobs-apply'
        when art and page_id % 5 = 3 then 'link_selector: a[href*=''apply?'']' else 'no_selector_matched' end as reason,
    case when known and art and page_id % 5 = 3 then 'https://boards.example.org/apply?job=' || page_id end as apply_url
from (select *, contains(html, '<article>') as art, {_KNOWN} from [html_apply] p) t""")
def apply_url(spark, folder):
    return ops.apply_url(_profiled(spark, folder, _rows(spark, folder, "html_apply"))).select(
        "page_id", "apply_url_status", "reason", "apply_url")


_WALLED = """case when page_id % 3 = 0 then replace(html, '<article>', '<article><p>Please wait</p>') else html end"""


@query("capture_class", f"""select page_id, error,
    case when error is null and not known then case when page_id % 5 = 3 and art then '.company-name' end end as company_found,
    case when error is null and not known and {_HAS_H1} then true else false end as title_found,
    case when error is null and page_id % 5 = 3 and art and not (known and first_id % 2 = 0) then 'h1.job-title' end as ready
from (select *, case when known and art and page_id % 5 = 4 then 'blocked_page_detected'
    when not (known and art and page_id % 5 = 0) and art and page_id % 3 = 0 then 'login_wall_detected' end as error
  from (select *, contains(html, '<article>') as art, f.id is not null as known, f.id as first_id
    from [html_apply] p left join [profiles] f on f.hostname = {S.bare_host('p.url')}) t) u""")
def capture_class(spark, folder):
    walled = _rows(spark, folder, "html_apply").withColumn("html", F.expr(_WALLED))
    return ops.capture_result(_profiled(spark, folder, walled)).select(
        "page_id", "error", F.try_element_at("discovered", F.lit("company_name")).alias("company_found"),
        F.coalesce(F.map_contains_key("discovered", "title"), F.lit(False)).alias("title_found"),
        F.col("candidate_ready_selector").alias("ready"))
