"""Queries that find duplicates, conflicts and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_analytics.functions import records as R
from capture_analytics.functions import urls as U
from capture_analytics.operators import dedup
from capture_analytics.plans import sqltext as S
from capture_analytics.plans.registry import query
from capture_analytics.sources.views import view

# links come from all pages, and posts share them: ids that are alike in halves take the same page
_POSTS = f"""select p.id, p.description, {S.canonical('w.target')} as link
    from [posts_text] p join [wrapped_urls] w
    on w.page_id = cast(floor(p.id / 2) as bigint) % (select count(*) from [wrapped_urls])"""


def _posts(spark, folder):
    urls = view(spark, folder, "wrapped_urls")
    pages = urls.select(F.col("page_id").alias("slot"), U.canonicalize_url(F.col("target")).alias("link"))
    slot = F.floor(F.col("id") / 2).cast("bigint") % urls.agg(F.count("*")).scalar()
    return view(spark, folder, "posts_text").withColumn("slot", slot).join(
        pages, "slot").select("id", "description", "link")


@query("link_dedup", f"""with posts as ({_POSTS}),
fullposts as (select link, min(id) as job_post_id from posts
    where {S.words('description')} >= 60 group by link)
select w.page_id as scrape_id, f.job_post_id, f.job_post_id is not null as was_duplicate
from [wrapped_urls] w left join fullposts f on f.link = {S.canonical('w.target')}""")
def link_dedup(spark, folder):
    scrapes = view(spark, folder, "wrapped_urls").select(
        F.col("page_id").alias("scrape_id"), F.col("url").alias("submitted_url"),
        U.canonicalize_url(F.col("target")).alias("canonical_url"))
    return dedup.link_duplicates(scrapes, _posts(spark, folder)).select(
        "scrape_id", "job_post_id", "was_duplicate")


@query("link_conflict", f"""with posts as ({_POSTS}),
firsts as (select link, min(id) as existing_id from posts group by link)
select w.page_id, f.existing_id, case when f.existing_id is not null then 409 end as status_code
from [wrapped_urls] w left join firsts f on f.link = {S.canonical('w.target')}""")
def link_conflict(spark, folder):
    wanted = view(spark, folder, "wrapped_urls").select(
        "page_id", U.canonicalize_url(F.col("target")).alias("link"))
    return dedup.link_conflicts(wanted, _posts(spark, folder)).select(
        "page_id", "existing_id", "status_code")


_NAMES = """select case id % 5 when 0 then lower(name) when 1 then right(name, 6) when 2 then 'New ' || name
    when 3 then 'N/A' else left(name, 10) end as name from [companies]"""


@query("company_resolve", f"""with names as (select distinct name from ({_NAMES}) n
    where lower(trim(name)) not in ({S.quoted(R.PLACEHOLDER_COMPANIES)})),
hits as (select n.name, c.id, row_number() over (partition by n.name
    order by lower(c.name) <> lower(n.name), c.id) as rn
    from names n join [companies] c on contains(lower(c.name), lower(n.name)))
select n.name, h.id as company_id, h.id is null as is_new
from names n left join hits h on h.name = n.name and h.rn = 1""")
def company_resolve(spark, folder):
    companies = view(spark, folder, "companies")
    names = spark.sql(_NAMES.replace("[companies]", "{c}"), c=companies)
    return dedup.resolve_companies(names, companies)


@query("placeholder_company", f"""select name, lower(trim(name)) in ({S.quoted(R.PLACEHOLDER_COMPANIES)})
    as is_placeholder, count(*) as n from ({_NAMES}) t group by name""")
def placeholder_company(spark, folder):
    names = spark.sql(_NAMES.replace("[companies]", "{c}"), c=view(spark, folder, "companies"))
    return names.groupBy("name").agg(F.count("*").alias("n")).withColumn(
        "is_placeholder", R.placeholder_company(F.col("name")))


@query("unscored_posts", """select c.scrape_id, c.job_post_id from [completed] c
    where c.status = 'completed' and c.job_post_id is not null
      and not exists (select 1 from [scores] s where s.post_id = c.job_post_id)""")
def unscored_posts(spark, folder):
    return dedup.unscored_posts(view(spark, folder, "completed"), view(spark, folder, "scores")
                                ).select("scrape_id", "job_post_id")


@query("score_batch", """with newest as (select scrape_id, job_post_id, scraped_at from [completed] c
    where c.status = 'completed' and c.job_post_id is not null
      and not exists (select 1 from [scores] s where s.post_id = c.job_post_id)
    order by scraped_at desc, scrape_id limit 40),
firsts as (select *, row_number() over (partition by job_post_id order by scraped_at desc, scrape_id) as rn
    from newest)
select job_post_id, scrape_id from firsts where rn = 1 order by scraped_at desc, scrape_id limit 20""")
def score_batch(spark, folder):
    return dedup.score_batch(view(spark, folder, "completed"), view(spark, folder, "scores"), 20)


@query("distinct_in_order", """select job_post_id, scrape_id, scraped_at from (select *, row_number() over (
    partition by job_post_id order by scraped_at desc, scrape_id) as rn from [completed]
    where job_post_id is not null) t where rn = 1""")
def distinct_in_order(spark, folder):
    scrapes = view(spark, folder, "completed").where(F.col("job_post_id").isNotNull())
    newest = -F.unix_micros(F.col("scraped_at").cast("timestamp"))
    return dedup.distinct_in_order(scrapes, "job_post_id", [newest, F.col("scrape_id")],
                                   ["scrape_id", "scraped_at"])


@query("queue_order", """select scrape_id, event_id, created_at from [statuses] where status = 'hold'
    order by scrape_id, event_id""")
def queue_order(spark, folder):
    held = view(spark, folder, "statuses").where(F.col("status") == "hold")
    return held.select("scrape_id", "event_id", "created_at").orderBy("scrape_id", "event_id")
