"""Queries over text quality and extraction gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from capture_analytics.functions import text as T
from capture_analytics.operators import extraction, traces
from capture_analytics.plans import sqltext as S
from capture_analytics.plans.registry import query
from capture_analytics.sources.views import view


def _rows(spark, folder, name):
    return view(spark, folder, name)

_HOST_PHRASE = "members only area"
_WALL_TEXT = f"case when lang = 'fr' then text || ' {_HOST_PHRASE}' else text end"


@query("login_wall", f"""select doc_id, {S.login_wall('text')} or (source in ('src0', 'src1')
        and contains(lower(text), '{_HOST_PHRASE}')) as flag,
    {S.hits('text', T.LOGIN_WEAK_PHRASES)} as hits, {S.words('text')} as words
from (select doc_id, source, {_WALL_TEXT} as text from [gated_text]) g""")
def login_wall(spark, folder):
    text = F.expr(_WALL_TEXT)
    host_phrases = F.when(F.col("source").isin("src0", "src1"), F.array(F.lit(_HOST_PHRASE)))
    return _rows(spark, folder, "gated_text").select("doc_id", "source", text.alias("text")).select(
        "doc_id", T.login_wall(F.col("text"), host_phrases).alias("flag"),
        T.phrase_hits(F.lower("text"), T.LOGIN_WEAK_PHRASES).alias("hits"),
        T.word_count(F.col("text")).alias("words"))


@query("signals_union", f"""select doc_id, len(list_filter(list_concat([{S.quoted(T.LOGIN_STRONG_PHRASES)}],
    case when lang = 'fr' then ['{_HOST_PHRASE}', source] else [] end),
    lambda p: contains(lower(text), p))) as hits from [gated_text]""")
def signals_union(spark, folder):
    own = F.when(F.col("lang") == "fr", F.array(F.lit(_HOST_PHRASE), F.col("source")))
    phrases = T.signals_union(own)
    return _rows(spark, folder, "gated_text").select("doc_id", F.size(F.filter(
        phrases, lambda p: F.lower("text").contains(p))).cast("bigint").alias("hits"))


@query("still_loading", f"select doc_id, {S.still_loading('text')} as flag from [gated_text]")
def still_loading(spark, folder):
    return _rows(spark, folder, "gated_text").select(
        "doc_id", T.still_loading(F.col("text")).alias("flag"))


@query("loading_shell", f"""select doc_id, {S.hits('text', T.LOADING_SHELL_PHRASES)} >= {T.SHELL_MIN_HITS}
    as flag, {S.hits('text', T.LOADING_SHELL_PHRASES)} as hits from [gated_text]""")
def loading_shell(spark, folder):
    return _rows(spark, folder, "gated_text").select(
        "doc_id", T.loading_shell(F.col("text")).alias("flag"),
        T.phrase_hits(F.lower("text"), T.LOADING_SHELL_PHRASES).alias("hits"))


@query("stub_words", f"""select doc_id, {S.words('text')} as words,
    {S.words('text')} < {T.STUB_MIN_WORDS} as is_stub from [gated_text]""")
def stub_words(spark, folder):
    return _rows(spark, folder, "gated_text").select(
        "doc_id", T.word_count(F.col("text")).alias("words"), T.is_stub(F.col("text")).alias("is_stub"))


_PARSED = """select doc_id, text, case when doc_id % 5 = 0 then '  ' else 'Role ' || doc_id end as title,
    case when doc_id % 11 = 0 then null else source end as company from [gated_text]"""
_EVALUATED = S.extraction("title", "company", "text")


def _parsed(spark, folder):
    return _rows(spark, folder, "gated_text").selectExpr(
        "doc_id", "text", "case when doc_id % 5 = 0 then '  ' else 'Role ' || doc_id end as title",
        "case when doc_id % 11 = 0 then null else source end as company")


@query("extraction_evaluate", f"""select doc_id, {_EVALUATED} = '' as passed, {_EVALUATED} as reasons
    from ({_PARSED}) p""")
def extraction_evaluate(spark, folder):
    reasons = T.extraction_reasons(F.col("title"), F.col("company"), F.col("text"))
    return _parsed(spark, folder).select("doc_id", reasons.alias("r")).select(
        "doc_id", (F.size("r") == 0).alias("passed"), F.array_join("r", ",").alias("reasons"))


@query("extraction_validate", f"""select doc_id, {_EVALUATED} = '' as passed, {_EVALUATED} as reasons,
    {S.validation('text')} = '' as validate_passed, {S.validation('text')} as validate_reasons,
    case when {S.validation('text')} <> '' then 'validate_failed: ' || {S.validation('text')} end
        as failure_reason from ({_PARSED}) p""")
def extraction_validate(spark, folder):
    reasons = T.extraction_reasons(F.col("title"), F.col("company"), F.col("text"))
    merged = T.merged_evaluation(F.size("r") == 0, F.col("r"), F.col("text"))
    return _parsed(spark, folder).withColumn("r", reasons).select("doc_id", merged.alias("e")).select(
        "doc_id", "e.passed", F.array_join("e.reasons", ",").alias("reasons"), "e.validate_passed",
        F.array_join("e.validate_reasons", ",").alias("validate_reasons"), "e.failure_reason")


_TIER_REASONS = S.extraction("title", "company_name", "description")


def _cascade_sql(tiers: int) -> str:
    return f"""with judged as (
    select run_id, tier, case when produced then {_TIER_REASONS} end as own,
        case when produced then tier end as own_tier from [tier_attempts] where tier <= {tiers}),
latest as (select run_id, tier,
    coalesce(last_value(own ignore nulls) over w, 'missing_title,missing_company') as reasons,
    last_value(own_tier ignore nulls) over w as output_tier
    from judged window w as (partition by run_id order by tier
        rows between unbounded preceding and current row)),
stops as (select *, row_number() over (partition by run_id
    order by case when reasons = '' then tier else 100 - tier end) as rn from latest)
select run_id, reasons = '' as passed, tier as last_tier, output_tier, reasons
from stops where rn = 1"""


def _cascade(spark, folder, tier3):
    return extraction.tier_cascade(_rows(spark, folder, "tier_attempts"), tier3).withColumn(
        "reasons", F.array_join("reasons", ","))


@query("tier_cascade", _cascade_sql(2))
def tier_cascade(spark, folder):
    return _cascade(spark, folder, False)


@query("tier_cascade_three", _cascade_sql(3))
def tier_cascade_three(spark, folder):
    return _cascade(spark, folder, True)


@query("tier_usage", """select tier, model, count(*) as attempts, count(*) filter (produced) as outputs,
    count(error) as errors, round(cast(sum(cost_usd) as double), 4) as cost_usd,
    cast(sum(duration_ms) as bigint) as duration_ms from [tier_attempts] group by tier, model""")
def tier_usage(spark, folder):
    return extraction.tier_usage(_rows(spark, folder, "tier_attempts")).withColumn(
        "cost_usd", F.round(F.col("cost_usd").cast("double"), 4))


@query("tier0_hits", """select run_id, coalesce(bool_or(tier - 1 = 0 and produced), false) as tier0_hit
    from [tier_attempts] group by run_id""")
def tier0_hits(spark, folder):
    return extraction.tier0_hits(_rows(spark, folder, "tier_attempts").withColumn(
        "tier", F.col("tier") - 1))


@query("last_tier", """select run_id, arg_max(tier, tier) as tier, arg_max(model, tier) as model
    from [tier_attempts] group by run_id""")
def last_tier(spark, folder):
    return traces.last_attempt(_rows(spark, folder, "tier_attempts"), "run_id", "tier", ["tier", "model"])


@query("text_clip", """select doc_id, length(clipped) as clipped_length, ends_with(clipped, '...') as cut
    from (select doc_id, case when length(text) > 500 then left(text, 500) || '...' else text end
    as clipped from [documents]) t""")
def text_clip(spark, folder):
    clipped = T.clip_text(F.col("text"), 500, "...")
    return view(spark, folder, "documents").select("doc_id", clipped.alias("c")).select(
        "doc_id", F.length("c").cast("bigint").alias("clipped_length"),
        F.col("c").endswith("...").alias("cut"))
