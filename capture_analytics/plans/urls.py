"""Queries over URLs and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_analytics.functions import urls as U
from capture_analytics.operators import dedup, profiles
from capture_analytics.plans import sqltext as S
from capture_analytics.plans.registry import query
from capture_analytics.sources.views import view

REWRITES = (
    {"match": "[unclosed", "rewrite": "x"},
    {"match": r"^(https?://[^/]+)/en/(\d+)", "rewrite": r"\1/view/\2?lang=en"},
    {"match": r"^http://", "rewrite": "https://"},
    {"match": r"\.html", "rewrite": ""},
)

_UNWRAPPED = f"""with recursive steps as (
    select page_id, url, url as current, 0 as n from [captures]
    union all
    select page_id, url, nxt, n + 1 from (
        select page_id, url, n, current, {S.unwrap_step('current')} as nxt from steps) s
    where n < {U.UNWRAP_DEPTH} and nxt is not null and nxt <> current),
unwrapped as (select page_id, url, current as inner_url from steps
    qualify row_number() over (partition by page_id, url order by n desc) = 1)"""


@query("repeated_captures", f"""{_UNWRAPPED},
keyed as (select page_id, url, {S.canonical('inner_url')} as canonical from (
    select c.page_id, c.url, u.inner_url from [captures] c
    join unwrapped u on u.page_id = c.page_id and u.url = c.url))
select {S.bare_host('canonical')} as host, canonical, count(*) as captures,
    count(distinct url) as raw_urls, min(page_id) as first_page_id
from keyed group by canonical having count(*) > 1""")
def repeated_captures(spark, folder):
    return dedup.repeated_captures(view(spark, folder, "captures"))


@query("url_canonicalize", f"select page_id, {S.canonical('url')} as canonical from [pages]")
def url_canonicalize(spark, folder):
    return view(spark, folder, "pages").select(
        "page_id", U.canonicalize_url(F.col("url")).alias("canonical"))


@query("url_strip_tracking", f"select page_id, {S.stripped('url')} as stripped from [pages]")
def url_strip_tracking(spark, folder):
    return view(spark, folder, "pages").select(
        "page_id", U.strip_tracking_params(F.col("url")).alias("stripped"))


@query("url_unwrap", f"""{_UNWRAPPED}
select page_id, url, inner_url as unwrapped from unwrapped""")
def url_unwrap(spark, folder):
    return view(spark, folder, "captures").distinct().select(
        "page_id", "url", U.unwrap_url(F.col("url")).alias("unwrapped"))


@query("url_rewrite", r"""select page_id, rewritten, rewritten <> url as changed from (
select page_id, url, case
    when regexp_matches(url, '^(https?://[^/]+)/en/(\d+)')
        then regexp_replace(url, '^(https?://[^/]+)/en/(\d+)', '\1/view/\2?lang=en')
    when regexp_matches(url, '^http://') then regexp_replace(url, '^http://', 'https://')
    when regexp_matches(url, '[.]html') then regexp_replace(url, '[.]html', '', 'g')
    else url end as rewritten from [pages]) t""")
def url_rewrite(spark, folder):
    rewritten = U.apply_url_rewrites(F.col("url"), REWRITES)
    return view(spark, folder, "pages").select(
        "page_id", rewritten.alias("rewritten"), (rewritten != F.col("url")).alias("changed"))


@query("profile_rewrite", r"""select p.page_id, {host} as host,
    case when f.hostname is not null and regexp_matches(url, '/([0-9]+)')
        then regexp_replace(url, '/([0-9]+)', '/job-\1', 'g') else url end as rewritten
from [pages] p left join [profiles] f on f.hostname = {host}""".replace("{host}", S.bare_host("url")))
def profile_rewrite(spark, folder):
    rules = F.array(F.struct(F.lit("(bad").alias("match"), F.lit("x").alias("rewrite")),
                    F.struct(F.lit("/([0-9]+)").alias("match"), F.lit(r"/job-\1").alias("rewrite")))
    known = view(spark, folder, "profiles").select("id", "hostname", rules.alias("url_rewrites"))
    return profiles.rewrite_by_profile(
        view(spark, folder, "pages").select("page_id", "url"), known
    ).select("page_id", "host", "rewritten")


@query("url_redirected", f"""select page_id, {S.canonical('url')} <> {S.canonical('target')}
    as did_redirect from [wrapped_urls]""")
def url_redirected(spark, folder):
    return view(spark, folder, "wrapped_urls").select(
        "page_id", U.urls_differ(F.col("url"), F.col("target")).alias("did_redirect"))


@query("url_hosts", f"""select page_id, {S.host('url')} as hostname, {S.bare_host('url')} as host,
    {S.bare_host('url')} as normalized, {S.host('url')} as extracted from [wrapped_urls]""")
def url_hosts(spark, folder):
    url = F.col("url")
    return view(spark, folder, "wrapped_urls").select(
        "page_id", U.hostname(url).alias("hostname"), U.url_host(url).alias("host"),
        U.normalize_host(U.hostname(url)).alias("normalized"), U.extract_host(url).alias("extracted"))


_TRACKER = S.literal(U.TRACKER_HOST_PATTERN)
_DEAD_HOST = S.literal(U.DEAD_CHECK_HOST_PATTERN)


@query("url_tracker_flags", f"""select page_id, url,
    {S.host('url')} in ({S.quoted(U.KNOWN_TRACKER_HOSTS)}) as is_known,
    regexp_matches({S.netloc('url')}, {_TRACKER}) as is_tracker,
    regexp_matches({S.netloc('url')}, {_DEAD_HOST}) as is_dead_check
from (select page_id, url from [wrapped_urls] union all select page_id, url from [fetch_log]) u""")
def url_tracker_flags(spark, folder):
    both = view(spark, folder, "wrapped_urls").select("page_id", "url").unionByName(
        view(spark, folder, "fetch_log").select("page_id", "url"))
    host = U.netloc(F.col("url"))
    return both.select("page_id", "url", U.is_known_tracker(F.col("url")).alias("is_known"),
                       U.is_tracker_host(host).alias("is_tracker"),
                       U.is_dead_check_host(host).alias("is_dead_check"))


_MARKED = f"regexp_matches(body, {S.literal(U.DEAD_MARKER_PATTERN)})"


@query("listing_resolution", f"""select page_id, resolved_url, resolved_url is null as dropped from (
select page_id, case when regexp_matches({S.netloc('url')}, {_TRACKER}) then
    case when error is not null then {S.stripped('url')}
         when status >= 400 or {_MARKED} then null
         when regexp_matches({S.netloc('final_url')}, {_TRACKER}) then null
         else {S.stripped('final_url')} end
    when regexp_matches({S.netloc('url')}, {_DEAD_HOST}) and error is null and status < 400
        and {_MARKED} then null
    else {S.stripped('url')} end as resolved_url from [fetch_log]) r""")
def listing_resolution(spark, folder):
    resolved = U.resolve_listing(*[F.col(c) for c in ("url", "status", "final_url", "body", "error")])
    return view(spark, folder, "fetch_log").select(
        "page_id", resolved.alias("resolved_url")).withColumn(
            "dropped", F.col("resolved_url").isNull())


@query("url_extract_text", r"""select conv_id, turn, len(urls) as n_urls, urls[1] as first_url from (
select conv_id, turn, list_transform(regexp_extract_all(
    text || ' See https://jobs.example.com/' || conv_id || '?turn=' || turn || ', or (http://x.example.org/' || turn || ').',
    'https?://[^\s<>"'')\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')) as urls
from [conversations]) t""")
def url_extract_text(spark, folder):
    text = F.concat(F.col("text"), F.lit(" See https://jobs.example.com/"), F.col("conv_id"),
                    F.lit("?turn="), F.col("turn"), F.lit(", or (http://x.example.org/"),
                    F.col("turn"), F.lit(")."))
    return view(spark, folder, "conversations").select(
        "conv_id", "turn", U.extract_urls(text).alias("urls")).select(
            "conv_id", "turn", F.size("urls").cast("bigint").alias("n_urls"),
            F.try_element_at("urls", F.lit(1)).alias("first_url"))


_ROUTE = """case page_id % 4 when 0 then '/job-posts/' || page_id || '/questions/7/answers/' || (page_id + 1)
    when 1 then '/job-posts/' || page_id || '/questions/9'
    when 2 then '/resumes/' || page_id else url end"""


@query("url_route_ids", f"""select page_id, nullif(regexp_extract(u, '/job-posts/([0-9]+)', 1), '') as job_post_id,
    nullif(regexp_extract(u, '/questions/([0-9]+)', 1), '') as question_id,
    nullif(regexp_extract(u, '/answers/([0-9]+)', 1), '') as answer_id,
    coalesce(nullif(regexp_extract(u, '/answers/([0-9]+)', 1), ''),
        nullif(regexp_extract(u, '/questions/([0-9]+)', 1), ''),
        nullif(regexp_extract(u, '/job-posts/([0-9]+)', 1), ''),
        nullif(regexp_extract(u, '/([0-9]+)(?:/|$)', 1), '')) as resource_id
from (select page_id, {_ROUTE} as u from [pages]) t""")
def url_route_ids(spark, folder):
    return view(spark, folder, "pages").select(
        "page_id", U.route_ids(F.expr(_ROUTE)).alias("r")).select("page_id", "r.*")


@query("host_suffix_match", f"""with hosts as (
    select distinct {S.bare_host('url')} as host from [pages]),
domains as (select distinct regexp_replace(host, '^[^.]+[.]', '') as domain from hosts
    union select distinct 'www2.' || host from hosts where host like '%.org')
select host, domain from (select h.host, d.domain, row_number() over (partition by h.host
    order by d.domain is null, d.domain <> h.host, length(d.domain) desc, d.domain) as rn
  from hosts h left join domains d
    on d.domain = h.host or ends_with(h.host, '.' || d.domain) or ends_with(d.domain, '.' || h.host)) m
where rn = 1""")
def host_suffix_match(spark, folder):
    hosts = view(spark, folder, "pages").select(U.url_host(F.col("url")).alias("host")).distinct()
    domains = hosts.select(F.regexp_replace("host", r"^[^.]+[.]", "").alias("domain")).union(
        hosts.where(F.col("host").endswith(".org")).select(F.concat(F.lit("www2."), "host")))
    return dedup.match_domains(hosts, domains)


# site lists are written by hand: hosts with a letter dropped, doubled or swapped, and short ones
_LISTED = """select domain from (select replace(host, 'example', 'exmple') as domain from hosts
    union select 'x' || host from hosts union select reverse(host) from hosts
    union select substring(host, 1, 5) from hosts) d where domain <> ''"""


@query("closest_hosts", f"""with hosts as (select distinct {S.bare_host('url')} as host from [pages]),
listed as ({_LISTED}),
near as (select host, domain, 1 - levenshtein(host, domain)::double
    / greatest(length(host), length(domain)) as likeness from hosts cross join listed where host <> '')
select host, domain, rank from (select *, row_number() over (
    partition by host order by likeness desc, domain) as rank from near where likeness >= 0.6) r
where rank <= 3""")
def closest_hosts(spark, folder):
    hosts = view(spark, folder, "pages").select(U.url_host(F.col("url")).alias("host")).distinct()
    listed = spark.sql(_LISTED.replace("from hosts", "from {hosts}"), hosts=hosts)
    return dedup.closest_domains(hosts, listed)
