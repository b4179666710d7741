"""Scalar rules over chat turns, tool calls and onboarding flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capture_analytics.functions.records import text_map
from capture_analytics.functions.text import filled

# ---- fixed values ---------------------------------------------------------------

PROMISE_PATTERN = (
    r"\b(i(['’]?\s?)ll\s+(check|look|create|find|fetch|go|see|grab|pull|get|gather|collect"
    r"|retrieve|prepare)"
    r"|let me\s+(check|look|see|find|pull|grab|fetch|get|retrieve)"
    r"|going to\s+(check|create|look|fetch|find|retrieve)"
    r"|i will\s+(check|create|look|find|fetch|get|retrieve))\b"
)
TOOL_RELOADS = {
    "create_answer": "answer",
    "update_answer": "answer",
    "create_job_application": "job-application",
    "update_job_application": "job-application",
    "create_job_post_with_company_check": "job-post",
    "update_job_post": "job-post",
    "create_company": "company",
    "create_scrape": "scrape",
    "update_scrape": "scrape",
    "score_job_post": "score",
}
ONBOARDING_STEPS = {
    "profile_basics": "Fill in name + email",
    "resume_imported": "Import a resume",
    "resume_reviewed": "Review extracted resume fields",
    "first_job_post": "Add a job post to target",
    "first_score": "Score your resume against a job",
    "first_cover_letter": "Generate a cover letter",
}
ALL_DONE = "none — all setup complete"
WIZARD_OFF = "wizard is disabled — do not volunteer onboarding advice"

EVENT_SCHEMA = ("type string, delta string, toolCallId string, toolCallName string, "
                "name string, value string")


def unfulfilled_promise(text: Column, tool_calls: Column) -> Column:
    """The reply announces an action although no tool ran in this turn."""
    return (F.coalesce(tool_calls, F.lit(0)) == 0) & filled(text).rlike("(?iU)" + PROMISE_PATTERN)


def reload_resource(tool: Column) -> Column:
    """Resource type a finished tool call makes stale, NULL for reading tools."""
    return F.try_element_at(text_map(TOOL_RELOADS), tool)


def onboarding_next(flags: dict[str, Column], wizard_enabled: Column) -> Column:
    """Label of the first open onboarding step."""
    steps = [F.when(~F.coalesce(flags[key], F.lit(False)), F.lit(label))
             for key, label in ONBOARDING_STEPS.items()]
    return F.when(~F.coalesce(wizard_enabled, F.lit(True)), F.lit(WIZARD_OFF)).otherwise(
        F.coalesce(*steps, F.lit(ALL_DONE)))


def wizard_applies(flags: dict[str, Column], wizard_enabled: Column) -> Column:
    """The wizard is on and at least one step is open."""
    done = F.lit(True)
    for key in ONBOARDING_STEPS:
        done = done & F.coalesce(flags[key], F.lit(False))
    return F.coalesce(wizard_enabled, F.lit(True)) & ~done


def sse_event(chunk: Column) -> Column:
    """Event of a server-sent `data:` chunk, NULL for keep-alives and broken payloads."""
    payload = F.regexp_extract(chunk, r"(?s)^.*?data: (.*?)(?:\n\n.*)?$", 1)
    parses = chunk.contains("data: ") & F.get_json_object(payload, "$").isNotNull()
    return F.when(parses, F.from_json(payload, EVENT_SCHEMA))
