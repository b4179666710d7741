"""Queries over conversations, tool calls and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_analytics.functions import chat as C
from capture_analytics.functions import text as T
from capture_analytics.operators import conversations as ops
from capture_analytics.operators.ordered import by_number, by_time, neighbour
from capture_analytics.plans import sqltext as S
from capture_analytics.plans.registry import query
from capture_analytics.sources.views import view

_BUDGET = 400


@query("history_budget", f"""with costed as (select *, greatest(1, cast(floor(length(text) / 3) as bigint)) as cost
    from [conversations]),
placed as (select *, sum(cost) over (partition by conv_id) as total,
    sum(cost) over (partition by conv_id order by turn desc) as used,
    row_number() over (partition by conv_id order by turn desc) as n from costed),
kept as (select *, min(case when role <> 'assistant' then turn end) over (partition by conv_id) as opening
    from placed where total <= {_BUDGET} or used <= {_BUDGET} or n = 1)
select conv_id, turn from kept where total <= {_BUDGET} or turn >= opening
union all
select conv_id, turn from placed where conv_id in (
    select conv_id from kept where total > {_BUDGET} and opening is null)""")
def history_budget(spark, folder):
    history = view(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return ops.budget_history(history, T.token_estimate(F.col("text")), F.col("role") == "assistant",
                              _BUDGET).select("conv_id", "turn")


@query("history_last_n", """select conv_id, turn, role from (select conv_id, turn, role, row_number() over (
    partition by conv_id order by turn desc) as n from [conversations]) t
    where n <= 4 and role in ('user', 'assistant')""")
def history_last_n(spark, folder):
    return ops.last_messages(view(spark, folder, "conversations"), 4).select("conv_id", "turn", "role")


_KEPT = "array_to_string(list_transform(parts, lambda p: p.kind || ':' || coalesce(p.call_id, '')), ',')"


def _kept_parts():
    return F.array_join(F.transform("parts", lambda p: F.concat(
        p["kind"], F.lit(":"), F.coalesce(p["call_id"], F.lit("")))), ",").alias("kept_parts")


@query("history_repair", f"""with numbered as (select *,
    list_transform(list_filter(parts, lambda p: p.kind = 'tool-call'), lambda p: p.call_id) as calls,
    list_transform(list_filter(parts, lambda p: p.kind = 'tool-return'), lambda p: p.call_id) as returns,
    len(list_filter(parts, lambda p: p.kind <> 'tool-return')) as own,
    coalesce(max(case when kind = 'response' then turn end) over (partition by conv_id order by turn), -1) as ex
    from [messages]),
mixed as (select conv_id, ex, min(case when kind = 'request' and own > 0 then turn end) as mixed,
    max(case when kind = 'response' then calls end) as asked from numbered group by conv_id, ex),
answers as (select n.conv_id, n.ex, flatten(list(n.returns)) as answered from numbered n
    join mixed m on m.conv_id = n.conv_id and m.ex = n.ex
    where n.kind = 'request' and (m.mixed is null or n.turn <= m.mixed) group by n.conv_id, n.ex),
facts as (select m.*, m.asked is not null and
    not list_has_all(coalesce(a.answered, []), m.asked) as broken
    from mixed m left join answers a on a.conv_id = m.conv_id and a.ex = m.ex),
first_pass as (select n.conv_id, n.turn, n.kind, n.ex,
    case when f.broken or f.asked is null then [] else f.asked end as valid,
    case when f.broken and n.kind = 'request' and n.turn = f.mixed then list_filter(n.parts,
        lambda p: not (p.kind = 'tool-return' and list_contains(f.asked, p.call_id))) else n.parts end as parts
    from numbered n join facts f on f.conv_id = n.conv_id and f.ex = n.ex
    where not (f.broken and (n.kind = 'response' or f.mixed is null or n.turn < f.mixed))),
judged as (select *, len(list_filter(parts, lambda p: p.kind = 'tool-return')) as n_returns,
    kind = 'request' and (len(list_filter(parts, lambda p: p.kind = 'tool-return')) = 0
        or len(list_filter(parts, lambda p: p.kind <> 'tool-return')) > 0
        or len(list_filter(parts, lambda p: p.kind = 'tool-return' and list_contains(valid, p.call_id))) > 0) as follows
    from first_pass),
direct as (select *, min(case when follows then turn end) over (partition by conv_id, ex) as direct from judged),
second_pass as (select conv_id, turn, kind, n_returns, case when kind = 'request' then list_filter(parts, lambda p:
        p.kind <> 'tool-return' or (turn = direct and list_contains(valid, p.call_id))) else parts end as parts
    from direct),
kept as (select conv_id, turn, parts from second_pass where not (n_returns > 0 and kind = 'request' and len(parts) = 0)),
everything as (select * from kept union all
    select conv_id, turn, parts from [messages] where conv_id not in (select conv_id from kept))
select conv_id, turn, {_KEPT} as kept_parts from everything""")
def history_repair(spark, folder):
    return ops.repair_tool_calls(view(spark, folder, "messages")).select("conv_id", "turn", _kept_parts())


@query("history_text_only", f"""select conv_id, turn, {_KEPT} as kept_parts from (select conv_id, turn,
    list_filter(parts, lambda p: p.kind in ('user', 'text')) as parts from [messages]) m where len(parts) > 0""")
def history_text_only(spark, folder):
    return ops.text_only(view(spark, folder, "messages")).select("conv_id", "turn", _kept_parts())


@query("history_cap", """select conv_id, turn, cast(coalesce(list_sum(list_transform(parts, lambda p:
    case when p.kind = 'tool-return' and length(p.text) > 200 then 200 + length(chr(10) || '... [truncated]')
    else length(p.text) end)), 0) as bigint) as total_length from [messages]""")
def history_cap(spark, folder):
    capped = ops.cap_tool_responses(view(spark, folder, "messages"), 200)
    return capped.select("conv_id", "turn", F.aggregate(
        "parts", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["text"])).alias("total_length"))


@query("unanswered_calls", """select conv_id, turn, array_to_string(list_sort(list_filter(calls,
    lambda c: not list_contains(coalesce(returns, []), c))), ',') as unanswered
from (select conv_id, turn, kind, list_transform(list_filter(parts, lambda p: p.kind = 'tool-call'), lambda p: p.call_id) as calls,
    lead(list_transform(list_filter(parts, lambda p: p.kind = 'tool-return'), lambda p: p.call_id))
        over (partition by conv_id order by turn) as returns from [messages]) t where kind = 'response'""")
def unanswered_calls(spark, folder):
    messages = view(spark, folder, "messages").withColumn("calls", ops.part_ids("tool-call")).withColumn(
        "returns", ops.part_ids("tool-return"))
    paired = neighbour(messages, by_number(["conv_id"], "turn"), {"returns": "following"})
    open_calls = F.array_except("calls", F.coalesce("following", F.array().cast("array<string>")))
    return paired.where(F.col("kind") == "response").select(
        "conv_id", "turn", F.array_join(F.array_sort(open_calls), ",").alias("unanswered"))


_SPOKEN = """case (conv_id + turn) % 9 when 0 then 'I''ll check that. ' || text when 1 then 'Sure. Let me  look. ' || text
    when 2 then text || ' I will create it' when 3 then 'Going to fetch it. ' || text when 4 then 'I ll gather those'
    when 5 then 'I will think' when 6 then 'let me retrieve ' || text when 7 then 'Ill prepare that' else text end"""


@query("promise_flag", f"""select conv_id, turn, turn % 2 = 0
    and regexp_matches(said, {S.literal('(?i)' + C.PROMISE_PATTERN)}) as flag
from (select conv_id, turn, """ + _SPOKEN + """ as said from [conversations]) t""")
def promise_flag(spark, folder):
    said = F.expr(_SPOKEN.replace("'I''ll", "'I\\'ll"))
    return view(spark, folder, "conversations").select(
        "conv_id", "turn", C.unfulfilled_promise(said, F.col("turn") % 2).alias("flag"))


@query("turn_usage", """select pipeline_run_id, trigger, cast(sum(request_tokens) as bigint) as request_tokens,
    cast(sum(coalesce(response_tokens, 0)) as bigint) as response_tokens,
    cast(sum(total_tokens) as bigint) as total_tokens, cast(sum(request_count) as bigint) as requests
    from [usage] group by pipeline_run_id, trigger""")
def turn_usage(spark, folder):
    passes = view(spark, folder, "usage").withColumnRenamed("request_count", "requests")
    return ops.turn_usage(passes, "pipeline_run_id", "trigger")


@query("usage_by_agent", """select agent_name, model_name, trigger, cast(sum(total_tokens) as bigint) as total_tokens,
    cast(sum(case when request_count = 0 then 1 else request_count end) as bigint) as requests, count(*) as runs
    from [usage] group by agent_name, model_name, trigger""")
def usage_by_agent(spark, folder):
    return ops.usage_by_agent(ops.usage_rows(view(spark, folder, "usage")))


@query("tool_call_pairing", """select event_id, call_id, tool, case tool when 'create_answer' then 'answer'
    when 'update_scrape' then 'scrape' end as resource from (select event_id, call_id, type, last_value(tool ignore nulls)
    over (partition by conv_id, call_id order by ts, event_id rows between unbounded preceding and current row) as tool
    from [tool_events]) t where type = 'TOOL_CALL_RESULT'""")
def tool_call_pairing(spark, folder):
    events = view(spark, folder, "tool_events")
    return ops.pair_tool_calls(events, by_time(["conv_id", "call_id"], "ts", "event_id")).select(
        "event_id", "call_id", F.col("started_tool").alias("tool"), "resource")


@query("reload_set", """select distinct conv_id, case tool when 'create_answer' then 'answer'
    else 'scrape' end as resource from (select conv_id, type, last_value(tool ignore nulls)
    over (partition by conv_id, call_id order by ts, event_id rows between unbounded preceding and current row) as tool
    from [tool_events]) t where type = 'TOOL_CALL_RESULT' and tool in ('create_answer', 'update_scrape')""")
def reload_set(spark, folder):
    paired = ops.pair_tool_calls(view(spark, folder, "tool_events"),
                                 by_time(["conv_id", "call_id"], "ts", "event_id"))
    return ops.reload_set(paired, "conv_id")


def _flags():
    return {"profile_basics": F.col("c_custkey") % 2 == 0, "resume_imported": F.col("c_custkey") % 3 == 0,
            "resume_reviewed": F.col("c_nationkey") % 2 == 0, "first_job_post": F.col("c_nationkey") % 3 == 0,
            "first_score": F.col("c_acctbal") > 0, "first_cover_letter": F.col("c_acctbal") > 5000}


@query("onboarding_next", f"""select c_custkey as user_id, case when c_custkey % 11 = 0 then '{C.WIZARD_OFF}'
    when not c_custkey % 2 = 0 then 'Fill in name + email' when not c_custkey % 3 = 0 then 'Import a resume'
    when not c_nationkey % 2 = 0 then 'Review extracted resume fields'
    when not c_nationkey % 3 = 0 then 'Add a job post to target' when not c_acctbal > 0 then
    'Score your resume against a job' when not c_acctbal > 5000 then 'Generate a cover letter'
    else '{C.ALL_DONE}' end as next_step, c_custkey % 11 <> 0 and not (c_custkey % 2 = 0 and c_custkey % 3 = 0
    and c_nationkey % 2 = 0 and c_nationkey % 3 = 0 and c_acctbal > 5000) as wizard_applies from customer""")
def onboarding_next(spark, folder):
    enabled = F.when(F.col("c_custkey") % 11 == 0, F.lit(False))
    return view(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), C.onboarding_next(_flags(), enabled).alias("next_step"),
        C.wizard_applies(_flags(), enabled).alias("wizard_applies"))


@query("onboarding_reconcile", """select c_custkey as user_id, c_nationkey % 2 = 0 as resume_reviewed,
    c_nationkey % 5 <> 0 as profile_basics,
    exists (select 1 from orders where o_custkey = c_custkey) as first_job_post,
    exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') as first_score
    from customer""")
def onboarding_reconcile(spark, folder):
    users = view(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit(True).alias("wizard_enabled"),
        (F.col("c_nationkey") % 2 == 0).alias("resume_reviewed"), F.col("c_name").alias("first_name"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).otherwise(F.lit(" ")).alias("email"))
    orders = view(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderstatus")
    return ops.reconcile_onboarding(
        users, first_job_post=orders, first_score=orders.where(F.col("o_orderstatus") == "F")
    ).select("user_id", "resume_reviewed", "profile_basics", "first_job_post", "first_score")


_CHUNK = """case turn % 3 when 0 then ': keep-alive' when 1 then 'data: {broken' else
    'data: {"type":"TEXT_MESSAGE_CONTENT","delta":"' || role || '","toolCallId":"c' || turn || '"}' end"""


@query("sse_parse", """select conv_id, turn, case when turn % 3 = 2 then 'TEXT_MESSAGE_CONTENT' end as type,
    case when turn % 3 = 2 then role end as delta, case when turn % 3 = 2 then 'c' || turn end as call_id
    from [conversations]""")
def sse_parse(spark, folder):
    chunk = F.concat(F.expr(_CHUNK), F.lit("\n\n"))
    return view(spark, folder, "conversations").select(
        "conv_id", "turn", C.sse_event(chunk).alias("e")).select(
            "conv_id", "turn", "e.type", "e.delta", F.col("e.toolCallId").alias("call_id"))
