"""Queries over host profiles and what they learn."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_analytics.functions import records as R
from capture_analytics.operators import profiles as ops
from capture_analytics.operators.ordered import by_time
from capture_analytics.plans import sqltext as S
from capture_analytics.plans.registry import query
from capture_analytics.sources.views import view

_IN_HOST = by_time(["host"], "ts", "event_id")


@query("profile_join", f"""select p.page_id, {S.bare_host('p.url')} as host, f.ready_selector
    from [pages] p left join [profiles] f on f.hostname = {S.bare_host('p.url')}""")
def profile_join(spark, folder):
    return ops.with_profile(view(spark, folder, "pages").select("page_id", "url"),
                            view(spark, folder, "profiles").select("id", "hostname", "ready_selector")
                            ).select("page_id", "host", "ready_selector")


@query("profile_flatten", """select id, case when id % 2 = 0 then 'top' else ready_selector end as ready_selector,
    hostname as extra, case when id % 3 = 0 then null else 'hint' end as hint from [profiles]""")
def profile_flatten(spark, folder):
    top = F.when(F.col("id") % 2 == 0, F.create_map(
        F.lit("ready_selector"), F.lit("top"), F.lit("extra"), F.col("hostname"))).otherwise(
            F.create_map(F.lit("extra"), F.col("hostname")))
    nested = F.when(F.col("id") % 3 == 0, F.create_map(
        F.lit("ready_selector"), F.col("ready_selector"))).otherwise(F.create_map(
            F.lit("ready_selector"), F.col("ready_selector"), F.lit("hint"), F.lit("hint")))
    flat = ops.flatten_profile(top, nested)
    return view(spark, folder, "profiles").select("id", flat.alias("m")).select(
        "id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("ready_selector", "extra", "hint")])


@query("probation_runs", """with seen as (select host, ts, event_id, selector,
    lag(selector) over (partition by host order by ts, event_id) as previous
    from [observations] where selector is not null and not demote)
select host, selector, ts, event_id from seen where selector = previous
qualify row_number() over (partition by host order by ts, event_id) = 1""")
def probation_runs(spark, folder):
    return ops.probation_runs(view(spark, folder, "observations"), _IN_HOST)


@query("probation_runs_of_three", """with seen as (select host, ts, event_id, selector,
    lag(selector) over w as previous, lag(selector, 2) over w as before
    from [observations] where selector is not null and not demote
    window w as (partition by host order by ts, event_id))
select host, selector, ts, event_id from seen where selector = previous and selector = before
qualify row_number() over (partition by host order by ts, event_id) = 1""")
def probation_runs_of_three(spark, folder):
    return ops.probation_runs(view(spark, folder, "observations"), _IN_HOST, 3)


@query("probation_fold", """with recursive seq as (select host, selector, demote,
    row_number() over (partition by host order by ts, event_id) as n from [observations]
    where demote or selector is not null),
fold as (
    select host, 1 as n, cast(null as varchar) as graduated,
        case when not demote then selector end as candidate,
        case when not demote then 1 end as matches from seq where n = 1
    union all
    select s.host, s.n,
        case when s.demote then null when f.graduated is not null then f.graduated
             when f.candidate = s.selector and f.matches + 1 >= 2 then s.selector end,
        case when s.demote then coalesce(f.graduated, f.candidate)
             when f.graduated is not null then null
             when f.candidate = s.selector and f.matches + 1 >= 2 then null else s.selector end,
        case when s.demote then case when f.graduated is not null then 0 else f.matches end
             when f.graduated is not null then null
             when f.candidate = s.selector then case when f.matches + 1 >= 2 then null else f.matches + 1 end
             else 1 end
    from fold f join seq s on s.host = f.host and s.n = f.n + 1)
select host, graduated, candidate, matches from fold
qualify row_number() over (partition by host order by n desc) = 1""")
def probation_fold(spark, folder):
    return ops.probation_fold(view(spark, folder, "observations"))


@query("first_discoveries", """select host, selector as discovered from [observations]
    where selector is not null qualify row_number() over (partition by host order by ts, event_id) = 1""")
def first_discoveries(spark, folder):
    runs = view(spark, folder, "observations").withColumnRenamed("selector", "discovered")
    return ops.first_discoveries(runs, ["ts", "event_id"])


@query("host_outcomes", """select host, count(*) as runs, count(nullif(job_post_id, 0)) as successes,
    count(*) filter (tier0_hit) as tier0_hits, round(count(nullif(job_post_id, 0)) / count(*), 6) as success_rate
    from [runs] group by host""")
def host_outcomes(spark, folder):
    return ops.host_outcomes(view(spark, folder, "runs")).withColumn(
        "success_rate", F.round("success_rate", 6))


@query("outcome_counts", """select host, outcome, failure_reason, count(*) as runs from [runs]
    group by host, outcome, failure_reason""")
def outcome_counts(spark, folder):
    return ops.outcome_counts(view(spark, folder, "runs"), "host")


@query("batch_summary", """select batch, count(*) as found, count(*) filter (outcome <> 'failure') as succeeded
    from [runs] group by batch""")
def batch_summary(spark, folder):
    return ops.batch_summary(view(spark, folder, "runs").withColumn(
        "succeeded", F.col("outcome") != "failure"), "batch")


@query("terminal_note", """select run_id, case when outcome = 'duplicate' then 'duplicate: job_post ' || job_post_id
    when outcome = 'failure' then coalesce(failure_reason, 'extraction')
    when job_post_id is not null then 'extracted job_post ' || job_post_id
    else 'extracted (' || length(content) || ' chars)' end as note from [runs]""")
def terminal_note(spark, folder):
    note = R.terminal_note(*[F.col(c) for c in ("outcome", "job_post_id", "content", "failure_reason")])
    return view(spark, folder, "runs").select("run_id", note.alias("note"))


@query("run_projection", """select run_id as scrape_id, host as canonical_url, outcome, failure_reason, job_post_id,
    1 as tiers from [runs]""")
def run_projection(spark, folder):
    run = F.struct(
        F.col("run_id").alias("scrape_id"), F.col("run_id").alias("original_scrape_id"),
        F.col("host").alias("canonical_url"), F.lit(False).alias("did_redirect"),
        F.array(F.struct(F.lit("tier1").alias("tier"))).alias("tier_attempts"),
        F.array().cast("array<string>").alias("obstacle_history"), F.col("outcome"),
        F.col("failure_reason"), F.col("job_post_id"), F.col("content").alias("html"))
    return view(spark, folder, "runs").select(run.alias("run")).select(
        R.run_payload(F.col("run")).alias("p")).select(
            "p.scrape_id", "p.canonical_url", "p.outcome", "p.failure_reason", "p.job_post_id",
            F.size("p.tier_attempts").alias("tiers"))
