"""Queries over run traces, lineage and statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_analytics.functions import records as R
from capture_analytics.functions import text as T
from capture_analytics.operators import traces as ops
from capture_analytics.operators.ordered import by_number, by_time, running_totals
from capture_analytics.plans.registry import query
from capture_analytics.sources.views import view

_IN_RUN = by_time(["scrape_id"], "t_start", "event_id")
_NODES = ", ".join(f"('{n}', '{g}')" for n, g in ops.NODES)
_EDGES = ", ".join(f"('{s}', '{t}')" for s, targets in ops.EDGES.items() for t in targets)


@query("trace_order", """select scrape_id, event_id, node, next_node,
    case when next_node is not null then routed_to = next_node end as as_routed, duration_ms
from (select *, lead(node) over (partition by scrape_id order by t_start, event_id) as next_node,
    cast(trunc((epoch_us(t_end) - epoch_us(t_start)) / 1000) as bigint) as duration_ms from [transitions]) t""")
def trace_order(spark, folder):
    transitions = view(spark, folder, "transitions").withColumn(
        "duration_ms", ops.duration_ms(F.col("t_start"), F.col("t_end")))
    return ops.trace_order(transitions, _IN_RUN).select(
        "scrape_id", "event_id", "node", "next_node", "as_routed", "duration_ms")


@query("trace_path", """select scrape_id, event_id, node, row_number() over (partition by scrape_id
    order by t_start, event_id) as step from [transitions]""")
def trace_path(spark, folder):
    return ops.trace_path(view(spark, folder, "transitions"), _IN_RUN).select(
        "scrape_id", "event_id", "node", F.col("step").cast("bigint").alias("step"))


@query("trace_cluster", """select left(sha256('{"node": "' || node || '", "routed_to": "' || routed_to || '"}'), 16)
    as digest, count(*) as n from [transitions] group by digest""")
def trace_cluster(spark, folder):
    return ops.trace_clusters(view(spark, folder, "transitions"), "routed_to", "node")


@query("edge_drift", f"""with declared(source, target) as (values {_EDGES}),
observed as (select distinct node as source, routed_to as target from [transitions])
select source, target, 'missing' as kind from (select * from declared except select * from observed) m
union all
select source, target, 'extra' as kind from (select * from observed except select * from declared) e""")
def edge_drift(spark, folder):
    _, edges = ops.topology(spark)
    return ops.drift(edges, ops.observed_edges(view(spark, folder, "transitions")), "source", "target")


@query("topology_drift", f"""with declared(id, grp) as (values {_NODES}),
observed as (select distinct routed_to as id from [transitions] union select 'Unknown' || scrape_id % 2 from [transitions])
select id, 'missing' as kind from (select id from declared except select id from observed) m
union all
select id, 'extra' as kind from (select id from observed except select id from declared) e""")
def topology_drift(spark, folder):
    nodes, _ = ops.topology(spark)
    transitions = view(spark, folder, "transitions")
    observed = transitions.select(F.col("routed_to").alias("id")).unionByName(
        transitions.select(F.concat(F.lit("Unknown"), F.col("scrape_id") % 2).alias("id")))
    return ops.drift(nodes, observed, "id")


@query("topology_nodes", f"""with declared(id, grp) as (values {_NODES})
select d.id, d.grp as group, regexp_replace(d.id, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') as label,
    count(t.event_id) as visits from declared d
left join [transitions] t on t.node = d.id group by d.id, d.grp""".replace("as group,", 'as "group",'))
def topology_nodes(spark, folder):
    nodes, _ = ops.topology(spark)
    visits = view(spark, folder, "transitions").groupBy(F.col("node").alias("id")).agg(
        F.count("*").alias("visits"))
    return nodes.drop("position", "description").join(visits, "id", "left").withColumn(
        "visits", F.coalesce("visits", F.lit(0)))


@query("obstacle_counts", """select scrape_id, count(*) filter (node = 'ObstacleRememberMe') as remembers,
    count(*) filter (node = 'ObstacleWaitRetry') as waits, count(*) filter (node = 'ObstacleAgent') as agents
    from [transitions] group by scrape_id""")
def obstacle_counts(spark, folder):
    return ops.obstacle_counts(view(spark, folder, "transitions"))


@query("trace_conformance", """with counted as (select *,
    count(*) filter (node = 'ObstacleRememberMe') over w as remembers,
    count(*) filter (node = 'ObstacleWaitRetry') over w as waits,
    count(*) filter (node = 'ObstacleAgent') over w as agents
    from [transitions] window w as (partition by scrape_id order by t_start, event_id
        rows between unbounded preceding and current row)),
routed as (select *, case when node = 'DetectObstacle' then case when remembers < 2 then 'ObstacleRememberMe'
        when waits < 3 then 'ObstacleWaitRetry' when agents < 1 then 'ObstacleAgent' else 'ObstacleFail' end
    when waits >= 3 and agents < 1 then 'ObstacleAgent' else 'DetectObstacle' end as expected
    from counted where node in ('DetectObstacle', 'ObstacleWaitRetry'))
select scrape_id, event_id, node, routed_to, expected,
    (node = 'DetectObstacle' and routed_to = 'ResolveFinalUrl') or expected = routed_to as conforms from routed""")
def trace_conformance(spark, folder):
    return ops.obstacle_conformance(view(spark, folder, "transitions"), _IN_RUN).select(
        "scrape_id", "event_id", "node", "routed_to", "expected", "conforms")


@query("lineage_chain", """with recursive chain as (
    select scrape_id, scrape_id as root, 0 as depth from [scrapes] where source_scrape is null
    union all
    select s.scrape_id, c.root, c.depth + 1 from [scrapes] s join chain c on s.source_scrape = c.scrape_id)
select scrape_id, root, cast(depth as bigint) as depth from chain""")
def lineage_chain(spark, folder):
    return ops.lineage_chain(view(spark, folder, "scrapes").select("scrape_id", "source_scrape"))


@query("latest_status", """select scrape_id, status, created_at from [statuses]
    qualify row_number() over (partition by scrape_id order by created_at desc, event_id desc) = 1""")
def latest_status(spark, folder):
    return ops.latest_status(view(spark, folder, "statuses"), "scrape_id", ["created_at", "event_id"],
                             ["status", "created_at"])


@query("fk_resolve", """select a.job_post_id, a.ordinal, p.company_id from [applications] a
    left join [job_posts] p on p.id = a.job_post_id""")
def fk_resolve(spark, folder):
    return ops.resolve_fk(view(spark, folder, "applications"), "job_post_id",
                          view(spark, folder, "job_posts"), "id", "company_id").select(
                              "job_post_id", "ordinal", "company_id")


@query("fk_int", """select event_id, try_cast(coalesce(case when event_id % 3 = 0 then null
    when event_id % 3 = 1 then cast(user_id as varchar) else 'x' || user_id end,
    cast(event_id as varchar)) as bigint) as fk from [events]""")
def fk_int(spark, folder):
    hyphen = F.expr("case when event_id % 3 = 0 then null when event_id % 3 = 1 then string(user_id) "
                    "else 'x' || user_id end")
    return view(spark, folder, "events").select("event_id", R.fk_int(hyphen, F.col("event_id")).alias("fk"))


@query("run_outcome", """select event_id, case when create_status = 500 then 'create_failed'
    when status not in ('completed', 'failed') then case when value >= 60 then 'timed_out' else 'running' end
    when status = 'failed' then 'failed'
    when job_post_id is null then case when value >= 15 then 'unlinked' else 'linking' end
    when score_id is null then 'score_failed' else 'scored' end as outcome, create_status = 501 as hold_fallback
from (select e.event_id, e.status, e.value, p.id as job_post_id, s.post_id as score_id,
        case e.event_id % 10 when 0 then 500 when 1 then 501 else 201 end as create_status
    from [statuses] e left join [job_posts] p on p.id = e.scrape_id * 2
    left join [scores] s on s.post_id = p.id) r""")
def run_outcome(spark, folder):
    statuses = view(spark, folder, "statuses")
    posts = view(spark, folder, "job_posts").select(F.col("id").alias("job_post_id"))
    scores = view(spark, folder, "scores").select(F.col("post_id").alias("score_id"))
    runs = (statuses.join(posts, F.col("job_post_id") == F.col("scrape_id") * 2, "left")
            .join(scores, F.col("score_id") == F.col("job_post_id"), "left")
            .withColumn("waited_s", F.col("value")).withColumn("unlinked_s", F.col("value"))
            .withColumn("score_status", F.lit(None).cast("string"))
            .withColumn("create_status", F.expr(
                "case event_id % 10 when 0 then 500 when 1 then 501 else 201 end")))
    return ops.run_outcome(runs).select("event_id", "outcome", "hold_fallback")


_ATTEMPTS = """select user_id as scrape_id, row_number() over (partition by user_id order by event_id) as attempt,
    case event_type when 'error' then 'Error: Connection closed' when 'view' then 'Timeout' end as error,
    case when event_type not in ('error', 'view') then event_type end as content from [events]"""


@query("retry_final", f"""with attempts as ({_ATTEMPTS}),
ranked as (select a.*, f.error as first_error from attempts a join attempts f
    on f.scrape_id = a.scrape_id and f.attempt = 1 where a.attempt <= 2)
select scrape_id, attempt, error, content from ranked
where attempt <= case when contains(coalesce(first_error, ''), 'Connection closed') then 2 else 1 end
qualify row_number() over (partition by scrape_id order by attempt desc) = 1""")
def retry_final(spark, folder):
    events = view(spark, folder, "events").select("user_id", "event_id", "event_type")
    numbered = running_totals(events, by_number(["user_id"], "event_id", 65_536), {"attempt": F.lit(1)})
    attempts = numbered.select(
        F.col("user_id").alias("scrape_id"), F.col("attempt").cast("bigint").alias("attempt"),
        F.expr("case event_type when 'error' then 'Error: Connection closed' when 'view' then 'Timeout' end")
        .alias("error"),
        F.when(~F.col("event_type").isin("error", "view"), F.col("event_type")).alias("content"))
    return ops.retry_final(attempts)


@query("transient_error", """select event_id, event_type = 'error' as transient from [events]""")
def transient_error(spark, folder):
    message = F.when(F.col("event_type") == "error", F.lit("Browser has been closed")).when(
        F.col("event_type") == "view", F.lit("browser HAS been closed"))
    return view(spark, folder, "events").select("event_id", T.transient_error(message).alias("transient"))
