"""The scalar functions as SQL functions of a session.

Every function is registered as a temporary SQL function whose body is the Column
expression itself, written out as SQL. No Python runs when it is called, and both
spellings are one definition.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from capture_analytics.functions import chat, html, records, text, urls

# name: (parameters, expression over the parameter columns)
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "canonicalize_url": ("url string", urls.canonicalize_url),
    "strip_tracking_params": ("url string", urls.strip_tracking_params),
    "urls_differ": ("submitted string, landed string", urls.urls_differ),
    "unwrap_url": ("url string", urls.unwrap_url),
    "b64_url": ("value string", urls.b64_url),
    "is_known_tracker": ("url string", urls.is_known_tracker),
    "is_tracker_host": ("host string", urls.is_tracker_host),
    "is_dead_check_host": ("host string", urls.is_dead_check_host),
    "has_dead_marker": ("body string", urls.has_dead_marker),
    "resolve_listing": ("url string, status int, final_url string, body string, error string",
                        urls.resolve_listing),
    "url_host": ("url string", urls.url_host),
    "normalize_host": ("host string", urls.normalize_host),
    "extract_host": ("value string", urls.extract_host),
    "extract_urls": ("value string", urls.extract_urls),
    "route_ids": ("url string", urls.route_ids),
    "absolute_url": ("base string, href string", urls.absolute_url),
    "word_count": ("value string", text.word_count),
    "is_stub": ("description string", text.is_stub),
    "login_wall": ("content string, host_phrases array<string>", text.login_wall),
    "still_loading": ("content string", text.still_loading),
    "loading_shell": ("content string", text.loading_shell),
    "evaluate_extraction": ("title string, company string, description string",
                            text.extraction_reasons),
    "validate_extraction": ("source_text string", text.validation_reasons),
    "transient_error": ("message string", text.transient_error),
    "token_estimate": ("value string", text.token_estimate),
    "frontend_url": ("resource_type string, resource_id string", records.frontend_url),
    "placeholder_company": ("name string", records.placeholder_company),
    "link_fallback": ("link string, url string", records.link_fallback),
    "blank_marker": ("value string", records.blank_marker),
    "annualize_salary": ("amount bigint, hourly boolean", records.annualize_salary),
    "score_band": ("score int", records.score_band),
    "terminal_note": ("outcome string, job_post_id bigint, content string, failure_reason string",
                      records.terminal_note),
    "unfulfilled_promise": ("reply string, tool_calls int", chat.unfulfilled_promise),
    "reload_resource": ("tool string", chat.reload_resource),
    "sse_event": ("chunk string", chat.sse_event),
    "visible_text": ("html string", html.visible_text),
    "page_title": ("html string", html.page_title),
    "page_links": ("html string, base string", html.page_links),
    "form_fields": ("html string", html.form_fields),
    "apply_candidates": ("html string, base string", html.apply_candidates),
    "expandable_texts": ("html string", html.expandable_texts),
    "apply_url_rewrites": ("url string, rules array<struct<match:string,rewrite:string>>",
                           urls.apply_rule_array),
    "clip_text": ("value string, size int, marker string", text.clip_text),
    "json_digest": ("fields map<string,string>", text.map_digest),
    "onboarding_next": ("flags map<string,boolean>, wizard_enabled boolean", lambda flags, wizard:
                        chat.onboarding_next({k: F.try_element_at(flags, F.lit(k))
                                              for k in chat.ONBOARDING_STEPS}, wizard)),
    "fk_int": ("first_key string, second_key string", records.fk_int),
}

# a quoted literal is left alone; an operator in call form needs quotes to parse
_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(<=>|<=|>=|=|<|>|\+|-|\*|/|%|!|and|or|&)\(")


def expression_sql(column: Column) -> str:
    """SQL text of a Column expression."""
    shown = str(column).removeprefix("Column<'").removesuffix("'>")
    return _TOKEN.sub(lambda m: f"`{m.group(1)}`(" if m.group(1) else m.group(0), shown)


# table functions: name, parameters, columns of a row, the scalar function whose array they unfold
TABLES: dict[str, tuple[str, str, str]] = {
    "apply_candidate_rows": (
        "html string, base string",
        "selector string, href string, text string, tag string, score double, reason string",
        "apply_candidates"),
    "form_field_rows": (
        "html string",
        "tag string, type string, name string, id string, placeholder string, aria_label string, selector string",
        "form_fields"),
}


def register_tables(spark: SparkSession) -> list[str]:
    """Register the table functions, one row per element in page order with its `position` from 1:
    `select page_id, c.* from pages, lateral apply_candidate_rows(html, url) c`."""
    for name, (parameters, columns, unfolded) in TABLES.items():
        fields = ", ".join(f"found.{c.split()[0]}" for c in columns.split(", "))
        # a function of SQL cannot be called inside posexplode, its body can
        called = expression_sql(FUNCTIONS[unfolded][1](*[
            F.col(p.split()[0]) for p in parameters.split(", ")]))
        spark.sql(f"create or replace temporary function {name}({parameters}) returns table (position bigint, "
                  f"{columns}) return select cast(at + 1 as bigint), {fields} from posexplode({called}) as t(at, found)")
    return list(TABLES)


def register_functions(spark: SparkSession) -> list[str]:
    """Register all scalar functions in the session and return their names; see `register_tables` too."""
    for name, (parameters, build) in FUNCTIONS.items():
        columns = [F.col(p.split()[0]) for p in re.split(r",\s*(?![^<]*>)", parameters)]
        spark.sql(f"create or replace temporary function {name}({parameters}) "
                  f"return {expression_sql(build(*columns))}")
    return list(FUNCTIONS)
