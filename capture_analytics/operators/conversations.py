"""Conversation histories, tool calls and usage accounting.

Messages are rows `(conv_id, turn, ...)` with `turn` unique per conversation, so a block
of turns is a bounded segment and a conversation of any length is cut into such blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from capture_analytics.functions.chat import reload_resource
from capture_analytics.functions.text import clip_text
from capture_analytics.operators.ordered import (
    SEGMENT, Sequenced, by_number, carry_last, top_per_key)
from capture_analytics.session import cut_lineage

# ---- fixed values ---------------------------------------------------------------

HISTORY_BUDGET = 20_000
HISTORY_LAST = 20
TOOL_RESPONSE_CLIP = 300_000
TOOL_RESPONSE_MARKER = "\n... [truncated]"

_NEVER = 2**62


# ---- windows over the history -----------------------------------------------------

def budget_history(messages: DataFrame, cost: Column, droppable: Column,
                   max_tokens: int = HISTORY_BUDGET) -> DataFrame:
    """Newest messages that fit the token budget; the newest one is always kept.

    A history within the budget stays whole. A cut one must not open with a `droppable`
    message (an assistant turn or a pure tool return); when nothing else is left the
    whole history is returned. With a `parts` column a mixed opening message loses its
    tool returns. `cost` is at least 1 per message.

    What is kept is the end of a conversation, so the work is done on numbers only: the
    result is one opening turn per cut conversation, and texts meet it in a single join.
    """
    seq = by_number(["conv_id"], "turn")
    rows = seq.tagged(messages.select("conv_id", "turn", cost.alias("_cost"),
                                      droppable.alias("_droppable")))
    later = Window.partitionBy("conv_id").orderBy(F.desc(SEGMENT)).rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", SEGMENT).agg(F.sum("_cost").alias("_sum")).select(
        "conv_id", SEGMENT, F.sum("_sum").over(later).alias("_after"),
        F.sum("_sum").over(Window.partitionBy("conv_id")).alias("_total"))
    # whole histories and blocks behind the budget are left out before rows are ordered
    reachable = blocks.where((F.col("_total") > max_tokens) & (
        F.col("_after").isNull() | (F.col("_after") < max_tokens)))
    inside = Window.partitionBy("conv_id", SEGMENT).orderBy(F.desc("turn"))
    placed = rows.join(reachable, ["conv_id", SEGMENT]).select(
        "*", (F.coalesce("_after", F.lit(0)) + F.sum("_cost").over(
            inside.rowsBetween(Window.unboundedPreceding, 0))).alias("_used"),
        (F.col("_after").isNull() & (F.row_number().over(inside) == 1)).alias("_newest"))
    openings = placed.where(((F.col("_used") <= max_tokens) | F.col("_newest"))
                            & ~F.col("_droppable")).groupBy("conv_id").agg(
                                F.min("turn").alias("_opening"))
    cut = messages.join(openings, "conv_id", "left").where(
        F.col("_opening").isNull() | (F.col("turn") >= F.col("_opening")))
    if "parts" in messages.columns:
        own = F.filter("parts", lambda p: p["kind"] != "tool-return")
        cut = cut.withColumn("parts", F.when(F.col("turn") == F.col("_opening"), own)
                             .otherwise(F.col("parts")))
    return cut.select(*messages.columns)


def last_messages(messages: DataFrame, n: int = HISTORY_LAST) -> DataFrame:
    """The last `n` messages, and of those the user and assistant ones."""
    newest = top_per_key(messages, ["conv_id"], [F.desc("turn")], n, "_recent").drop("_recent")
    return newest.where(F.coalesce("role", F.lit("user")).isin("user", "assistant"))


def cap_tool_responses(messages: DataFrame, limit: int = TOOL_RESPONSE_CLIP) -> DataFrame:
    """Cut tool returns longer than `limit` characters, with a marker."""
    def cap(p: Column) -> Column:
        text = F.when(p["kind"] == "tool-return", clip_text(p["text"], limit, TOOL_RESPONSE_MARKER)
                      ).otherwise(p["text"])
        return F.struct(p["kind"].alias("kind"), p["call_id"].alias("call_id"), text.alias("text"))
    return messages.withColumn("parts", F.transform("parts", cap))


def text_only(messages: DataFrame) -> DataFrame:
    """User and assistant text only; messages without any disappear."""
    kept = F.filter("parts", lambda p: p["kind"].isin("user", "text"))
    return messages.withColumn("parts", kept).where(F.size("parts") > 0)


def part_ids(kind: str) -> Column:
    """Call ids of the parts of one kind. Reads two fields of the parts, never their text."""
    pairs = F.arrays_zip(F.col("parts.kind").alias("kind"), F.col("parts.call_id").alias("call_id"))
    return F.transform(F.filter(pairs, lambda p: p["kind"] == kind), lambda p: p["call_id"])


def repair_tool_calls(messages: DataFrame) -> DataFrame:
    """Remove tool calls that were not all answered, and returns without their call.

    `messages` has `conv_id`, `turn`, `kind` (`request` or `response`) and `parts`
    (`kind`, `call_id`, `text`). A response and the requests up to the next response form
    an exchange. What has to change is worked out on ids alone, as facts per exchange and
    per call; texts meet the changed messages, usually few, in one join at the end.
    """
    changes = _tool_call_changes(messages)
    joined = messages.join(changes, ["conv_id", "turn"], "left")
    valid = F.filter("parts", lambda p: (p["kind"] != "tool-return")
                     | F.array_contains(F.col("_valid"), p["call_id"]))
    return joined.where(~F.coalesce("_gone", F.lit(False))).withColumn(
        "parts", F.when(F.col("_valid").isNotNull(), valid).otherwise(F.col("parts"))
    ).select(*messages.columns)


def _tool_call_changes(messages: DataFrame) -> DataFrame:
    """Messages to drop (`_gone`) or whose returns are limited to the `_valid` ids."""
    none = F.array().cast("array<string>")
    request = F.col("kind") == "request"
    rows = messages.select(
        "conv_id", "turn", "kind", part_ids("tool-call").alias("_calls"),
        part_ids("tool-return").alias("_returns"), F.size("parts.kind").alias("_size"))
    rows = rows.withColumn("_own", F.col("_size") - F.size("_returns"))
    rows = carry_last(rows, by_number(["conv_id"], "turn"),
                      {"_exchange": F.when(F.col("kind") == "response", F.col("turn"))})
    # read several times below: ids only, written once to the shared checkpoint folder
    rows = cut_lineage(rows.withColumn("_exchange", F.coalesce("_exchange", F.lit(-1))))
    key = ["conv_id", "_exchange"]

    # an exchange is broken when a call has no answer up to the first request with own content
    facts = rows.groupBy(*key).agg(
        F.min(F.when(request & (F.col("_own") > 0), F.col("turn"))).alias("_mixed"),
        F.any_value(F.when(~request, F.col("_calls")), ignoreNulls=True).alias("_asked"))
    mentions = rows.select(*key, "turn", request.alias("_answer"), F.explode(
        F.when(request, F.col("_returns")).otherwise(F.col("_calls"))).alias("_id"))
    answered = (mentions.groupBy(*key, "_id")
                .agg(F.min(F.when(F.col("_answer"), F.col("turn"))).alias("_at"),
                     F.bool_or(~F.col("_answer")).alias("_called"))
                .where("_called").groupBy(*key)
                .agg(F.max(F.coalesce("_at", F.lit(_NEVER))).alias("_last_answer")))
    facts = facts.join(answered, key, "left").select(
        *key, "_mixed", F.coalesce("_asked", none).alias("_asked"),
        F.coalesce(F.col("_last_answer") > F.coalesce("_mixed", F.lit(_NEVER - 1)), F.lit(False)
                   ).alias("_broken"))

    # first pass: a broken response goes, with the pure returns up to that request
    judged = rows.join(facts, key)
    gone = F.col("_broken") & F.when(~request, F.lit(True)).otherwise(
        F.col("turn") < F.coalesce("_mixed", F.lit(_NEVER)))
    stripped = F.when(F.col("_broken") & (F.col("turn") == F.col("_mixed")),
                      F.array_except("_returns", "_asked")).otherwise(F.col("_returns"))
    judged = judged.withColumns({
        "_gone": gone, "_original": F.col("_returns"), "_returns": F.when(request, stripped).otherwise(none),
        "_valid": F.when(F.col("_broken"), none).otherwise(F.col("_asked"))})

    # second pass: returns count only in the request that directly follows their response
    follows = request & ~F.col("_gone") & (
        (F.size("_returns") == 0) | (F.col("_own") > 0) | F.arrays_overlap("_returns", "_valid"))
    direct = judged.groupBy(*key).agg(F.min(F.when(follows, F.col("turn"))).alias("_direct"))
    touched = judged.where(F.col("_gone") | (request & (F.size("_original") > 0)))
    checked = touched.join(direct, key).withColumn("_valid", F.when(
        F.col("turn") == F.col("_direct"), F.array_intersect("_returns", "_valid")).otherwise(none))
    emptied = request & (F.col("_own") == 0) & (F.size("_valid") == 0) & (F.size("_returns") > 0)
    changes = cut_lineage(checked.select(
        "conv_id", "turn", (F.col("_gone") | emptied).alias("_gone"), "_valid"))

    # a conversation is never emptied: it then stays as it was
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("_all"))
    lost = changes.where("_gone").groupBy("conv_id").agg(F.count("*").alias("_lost"))
    emptied_conversations = lost.join(sizes, "conv_id").where(F.col("_lost") == F.col("_all"))
    return changes.join(emptied_conversations.select("conv_id"), "conv_id", "left_anti")


# ---- tool calls -------------------------------------------------------------------

def pair_tool_calls(events: DataFrame, seq: Sequenced) -> DataFrame:
    """Results with the tool name of the latest start of the same call.

    `events` has `type`, `call_id`, `tool`; `seq` orders events within a call. A result
    before its start, or without one, has no tool.
    """
    start = (F.col("type") == "TOOL_CALL_START") & (F.coalesce("tool", F.lit("")) != "")
    paired = carry_last(events, seq, {"started_tool": F.when(start, F.col("tool"))})
    return paired.where(F.col("type") == "TOOL_CALL_RESULT").withColumn(
        "resource", reload_resource(F.col("started_tool")))


def reload_set(paired: DataFrame, *turn: str) -> DataFrame:
    """Distinct resource types to reload per turn."""
    return paired.where(F.col("resource").isNotNull()).select(*turn, "resource").distinct()


# ---- usage ------------------------------------------------------------------------

def _or_default(column: str, default: int) -> Column:
    value = F.col(column)
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value).cast("bigint")


def usage_rows(runs: DataFrame) -> DataFrame:
    """Usage rows as they are stored: missing tokens are 0, missing requests are 1."""
    run_id = F.col("pipeline_run_id")
    if not isinstance(runs.schema["pipeline_run_id"].dataType, StringType):
        run_id = F.nullif(run_id, F.lit(0))
    return runs.select(
        "agent_name", "model_name",
        *[_or_default(c, 0).alias(c) for c in ("request_tokens", "response_tokens", "total_tokens")],
        _or_default("request_count", 1).alias("request_count"), "trigger",
        F.nullif(run_id.cast("string"), F.lit("")).alias("pipeline_run_id"))


def turn_usage(passes: DataFrame, *turn: str) -> DataFrame:
    """Tokens and requests of all passes of a turn."""
    return passes.groupBy(*turn).agg(*[
        F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
        for c in ("request_tokens", "response_tokens", "total_tokens", "requests")])


def usage_by_agent(usage: DataFrame, *by: str) -> DataFrame:
    """Spend per agent, model and trigger (or other fields of a usage row)."""
    return usage.groupBy(*(by or ("agent_name", "model_name", "trigger"))).agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("request_count").alias("requests"),
        F.count("*").alias("runs"))


# ---- onboarding -------------------------------------------------------------------

def reconcile_onboarding(users: DataFrame, **sources: DataFrame) -> DataFrame:
    """Objective onboarding flags from the data; wizard and review flags stay as they are.

    `users` has `user_id`, `wizard_enabled`, `resume_reviewed`, `first_name`, `email`;
    each source (`resume_imported=...`, `first_job_post=...`, ...) has `user_id`.
    """
    result = users.withColumn("profile_basics", (F.coalesce(F.trim("first_name"), F.lit("")) != "")
                              & (F.coalesce(F.trim("email"), F.lit("")) != ""))
    for flag, rows in sources.items():
        have = rows.select("user_id").distinct().withColumn("_has", F.lit(True))
        result = result.drop(flag).join(have, "user_id", "left").withColumn(
            flag, F.coalesce("_has", F.lit(False))).drop("_has")
    return result
