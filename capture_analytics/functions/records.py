"""Scalar rules over records: validation, labels, routes and small decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capture_analytics.functions.base import holding
from capture_analytics.functions.text import clip_text, filled, strip

# ---- fixed values ---------------------------------------------------------------

TYPE_ROUTES = {
    "job-post": "job-posts", "job-application": "job-applications", "company": "companies",
    "score": "scores", "resume": "resumes", "cover-letter": "cover-letters",
    "question": "questions", "answer": "answers", "summary": "summaries", "scrape": "scrapes",
}
PLACEHOLDER_COMPANIES = ("unknown", "n/a", "na", "none", "tbd", "not specified", "")
ALLOWED_PATCH_KEYS = {
    "resume": ("favorite", "title", "name", "notes"),
    "cover-letter": ("favorite", "status"),
    "answer": ("favorite",),
    "job-post": ("favorite",),
    "user": ("onboarding",),
}
MAX_ACTIONS = 3
OK_STATUSES = (200, 201, 202)
HOURS_PER_YEAR = 2080
ERROR_CLIP = 500
DOM_CLIP = 200_000
DOM_MARKER = "\n<!-- [truncated for debug artifact] -->"


def text_map(mapping: dict[str, str]) -> Column:
    """Literal lookup map."""
    return F.create_map(*[F.lit(part) for item in mapping.items() for part in item])


def frontend_url(resource_type: Column, resource_id: Column) -> Column:
    """Application path of a record, NULL for types that have no page."""
    route = F.try_element_at(text_map(TYPE_ROUTES), resource_type)
    return F.when(route.isNotNull(),
                  F.concat(F.lit("/"), route, F.lit("/"), resource_id.cast("string")))


def response_gate(status: Column, body: Column) -> Column:
    """Payload of an accepted response, or an error with the status when it is >= 400."""
    accepted = status.isin(*OK_STATUSES)
    message = F.concat(status.cast("string"), F.lit(" - "),
                       clip_text(filled(body), ERROR_CLIP))
    return F.struct(
        F.when(accepted, body).alias("payload"),
        F.when(~accepted, message).alias("error"),
        F.when(~accepted & (status >= 400), status).alias("status_code"))


def _length_outside(text: Column, low: int, high: int | None) -> Column:
    size = F.length(filled(text))
    return (size < low) | (size > high) if high is not None else size < low


def _salary_rules(low: Column, high: Column) -> list[tuple[str, Column]]:
    return [("salary_min", low < 0), ("salary_max", high < 0), ("salary_range", low > high)]


def extracted_post_errors(title: Column, description: Column, company_name: Column,
                          location: Column, salary_min: Column, salary_max: Column,
                          company_industry: Column, company_location: Column) -> Column:
    """Broken rules of a post as extracted from a page."""
    return holding(
        ("title", _length_outside(title, 1, 200)),
        ("description", _length_outside(description, 10, None)),
        ("company_name", _length_outside(company_name, 1, None)),
        ("location", F.length(location) > 100),
        *_salary_rules(salary_min, salary_max),
        ("company_industry", F.length(company_industry) > 100),
        ("company_location", F.length(company_location) > 100))


def new_post_errors(title: Column, company_id: Column, location: Column,
                    salary_min: Column, salary_max: Column) -> Column:
    """Broken rules of a post about to be created."""
    return holding(
        ("title", _length_outside(title, 1, 200)),
        ("company_id", company_id.isNull() | (company_id <= 0)),
        ("location", F.length(location) > 100),
        *_salary_rules(salary_min, salary_max))


def company_errors(name: Column, industry: Column, location: Column) -> Column:
    return holding(
        ("name", _length_outside(name, 1, 200)),
        ("industry", F.length(industry) > 100),
        ("location", F.length(location) > 100))


def application_input_error(job_post_id: Column) -> Column:
    """Error text for an application without a usable post id, else NULL."""
    return F.when(job_post_id.isNull() | (job_post_id <= 0), F.concat(
        F.lit("Invalid job_post_id="), F.coalesce(job_post_id.cast("string"), F.lit("None")),
        F.lit(". Look up the real ID first.")))


def placeholder_company(name: Column) -> Column:
    """Name that says nothing about the company; NULL counts as one."""
    return name.isNull() | F.lower(strip(name)).isin(*PLACEHOLDER_COMPANIES)


def link_fallback(link: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(link, F.lit("")), F.nullif(url, F.lit("")))


def blank_marker(value: Column) -> Column:
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit("(blank)"))


def hyphenate_keys(attributes: Column) -> Column:
    return F.transform_keys(attributes, lambda k, _: F.replace(k, F.lit("_"), F.lit("-")))


def allowed_patch(record_type: Column, patch: Column) -> Column:
    """Keys of a proposed patch that may be set on a record of this type."""
    allowed = F.create_map(*[part for kind, keys in ALLOWED_PATCH_KEYS.items() for part in (
        F.lit(kind), F.array(*[F.lit(k) for k in keys]))])
    keys = F.coalesce(F.try_element_at(allowed, record_type), F.array().cast("array<string>"))
    return F.map_filter(patch, lambda k, _: F.array_contains(keys, k))


def action_valid(navigate: Column, model: Column, message: Column) -> Column:
    """An action names exactly one of a route, a record patch or a message."""
    return sum((c.isNotNull().cast("int") for c in (navigate, model, message)), F.lit(0)) == 1


def batch_valid(action_count: Column) -> Column:
    return action_count.between(1, MAX_ACTIONS)


def annualize_salary(amount: Column, hourly: Column) -> Column:
    return F.when(hourly, amount * HOURS_PER_YEAR).otherwise(amount)


def score_band(score: Column) -> Column:
    return (F.when(score >= 80, F.lit("strong")).when(score >= 60, F.lit("reasonable"))
            .when(score < 60, F.lit("gaps")))


def terminal_note(outcome: Column, job_post_id: Column, content: Column,
                  failure_reason: Column) -> Column:
    """Status note a finished run leaves behind."""
    post = job_post_id.cast("string")
    return (F.when(outcome == "duplicate", F.concat(F.lit("duplicate: job_post "), post))
            .when((outcome == "success") & job_post_id.isNotNull(),
                  F.concat(F.lit("extracted job_post "), post))
            .when(outcome == "success", F.concat(
                F.lit("extracted ("), F.length(filled(content)).cast("string"), F.lit(" chars)")))
            .when(outcome == "failure", F.coalesce(F.nullif(failure_reason, F.lit("")),
                                                   F.lit("extraction"))))


def fk_int(*candidates: Column) -> Column:
    """First given foreign key as a number, NULL when it is not one."""
    return F.coalesce(*[c.cast("string") for c in candidates]).try_cast("bigint")


def debug_html(html: Column, dom: Column, clip: int | None = None) -> Column:
    """Stored html when there is some, else the captured DOM, cut with a marker if asked."""
    shown = dom if clip is None else clip_text(dom, clip, DOM_MARKER)
    return F.when(filled(html) != "", html).otherwise(
        F.when(filled(dom) != "", shown).otherwise(html))


def run_payload(run: Column) -> Column:
    """The nine fields of a run that go into its transition payload."""
    return F.struct(*[run[name].alias(name) for name in RUN_PAYLOAD_FIELDS])


RUN_PAYLOAD_FIELDS = (
    "scrape_id", "original_scrape_id", "canonical_url", "did_redirect", "tier_attempts",
    "obstacle_history", "outcome", "failure_reason", "job_post_id",
)
