"""Text measures and content-quality gates as native Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from capture_analytics.functions.base import holding, let

# ---- fixed values ---------------------------------------------------------------

LOGIN_WEAK_PHRASES = (
    "sign in", "log in", "login", "create an account",
    "forgot password", "enter your email", "join now",
    "access denied", "not in our system", "contact support",
    "continue to sign in",
    "welcome back", "continue as", "not you?",
)
LOGIN_STRONG_PHRASES = (
    "logging you in", "signing you in", "we're logging",
    "redirecting", "please wait", "just a moment",
    "verifying you are human", "checking your browser",
    "performing security verification", "verifies you are not a bot",
    "are not a bot", "security service to protect",
    "ray id:",
    "sign in to discover",
)
LOADING_PREFIXES = (
    "loading", "logging you in", "signing you in", "we're logging", "redirecting",
    "please wait", "just a moment", "performing security verification",
    "verifying you are human", "checking your browser",
)
LOADING_SHELL_PHRASES = (
    "sorry to interrupt", "css error", "cookieenabled", "enable cookies",
    "please enable javascript", "this page requires javascript", "wd-body-loading",
)
TRANSIENT_ERRORS = (
    "Target page, context or browser has been closed",
    "Browser has been closed",
    "Connection closed",
)
WALL_MAX_WORDS = 200
WALL_MIN_WEAK = 2
LOADING_MAX_WORDS = 40
SHELL_MIN_HITS = 2
STUB_MIN_WORDS = 60
SOURCE_MIN_WORDS = 40
CHARS_PER_TOKEN = 3

# Whitespace as text splitting sees it: Unicode white space and the four file separators.
_SPACE, _LETTER = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}++|{_SPACE}++$", "")


def filled(text: Column) -> Column:
    """Text, or the empty string for NULL."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"(?U){_LETTER}++")), F.lit(0)).cast("bigint")


def has_words(text: Column, n: int) -> Column:
    """At least `n` words. Exact like `word_count(text) >= n`, but reading stops at the
    n-th word, which matters for long texts and small thresholds."""
    more = f"(?:{_LETTER}++{_SPACE}++){{{n - 1}}}" if n > 1 else ""
    return F.coalesce(text.rlike(f"(?U)^{_SPACE}*+{more}{_LETTER}"), F.lit(False))


def is_blank(text: Column) -> Column:
    return ~has_words(text, 1)


def is_stub(description: Column) -> Column:
    return ~has_words(description, STUB_MIN_WORDS)


def phrase_hits(lowered: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur in the (already lower-cased) text."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + lowered.contains(phrase).cast("int")
    return total.cast("bigint")


def any_phrase(lowered: Column, phrases: Iterable[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | lowered.contains(phrase)
    return found


def signals_union(host_phrases: Column) -> Column:
    """The global strong phrases followed by a host's own ones."""
    return F.concat(F.array(*[F.lit(p) for p in LOGIN_STRONG_PHRASES]),
                    F.coalesce(host_phrases, F.array().cast("array<string>")))


def login_wall(content: Column, host_phrases: Column | None = None) -> Column:
    """Strong phrases decide at any length; weak ones need two hits on a short page."""
    lowered = F.lower(filled(content))
    strong = any_phrase(lowered, LOGIN_STRONG_PHRASES)
    if host_phrases is not None:
        own = let(lowered, lambda t: F.exists(host_phrases, lambda p: t.contains(p)))
        strong = strong | F.coalesce(F.when(host_phrases.isNotNull(), own), F.lit(False))
    weak = phrase_hits(lowered, LOGIN_WEAK_PHRASES) >= WALL_MIN_WEAK
    return strong | (~has_words(content, WALL_MAX_WORDS) & weak)


def still_loading(content: Column) -> Column:
    """Empty, opening with an interstitial phrase, or short and containing one."""
    lowered = F.lower(filled(content))
    opening = f"(?U)^{_SPACE}*+(?:{'|'.join(LOADING_PREFIXES)})"
    return is_blank(content) | lowered.rlike(opening) | (
        ~has_words(content, LOADING_MAX_WORDS) & any_phrase(lowered, LOADING_PREFIXES))


def loading_shell(content: Column) -> Column:
    """The page is a script shell that never rendered."""
    return phrase_hits(F.lower(filled(content)), LOADING_SHELL_PHRASES) >= SHELL_MIN_HITS


def extraction_faults(title: Column, company: Column, description: Column) -> dict[str, Column]:
    """Faults of an extraction by name. An empty description is none: only a non-empty
    thin one is."""
    return {"missing_title": is_blank(title), "missing_company": is_blank(company),
            "thin_description": ~is_blank(description) & is_stub(description)}


def extraction_reasons(title: Column, company: Column, description: Column) -> Column:
    """Why an extraction is not good enough; an empty array means it passed."""
    return holding(*extraction_faults(title, company, description).items())


def validation_reasons(source_text: Column) -> Column:
    """Why the source of an extraction cannot hold a real posting."""
    return holding(
        ("source_too_short", ~has_words(source_text, SOURCE_MIN_WORDS)),
        ("loading_shell_fingerprint", loading_shell(source_text)))


def merged_evaluation(passed: Column, reasons: Column, source_text: Column) -> Column:
    """Evaluation of the extraction joined with the validation of its source."""
    failed = validation_reasons(source_text)
    return F.struct(
        passed.alias("passed"), reasons.alias("reasons"),
        (F.size(failed) == 0).alias("validate_passed"), failed.alias("validate_reasons"),
        F.when(F.size(failed) > 0,
               F.concat(F.lit("validate_failed: "), F.array_join(failed, ","))
               ).alias("failure_reason"))


def transient_error(message: Column) -> Column:
    """The browser died under the capture; worth exactly one more attempt."""
    return any_phrase(filled(message), TRANSIENT_ERRORS)


def clip_text(text: Column, limit: int, suffix: str = "") -> Column:
    """Text cut at `limit` characters with a marker, shorter text unchanged."""
    return F.when(F.length(text) > limit,
                  F.concat(F.left(text, F.lit(limit)), F.lit(suffix))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(filled(text)) / F.lit(CHARS_PER_TOKEN))
                      ).cast("bigint")


def map_digest(fields: Column) -> Column:
    """`json_digest` of the texts in a map."""
    members = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(
        F.regexp_extract(F.to_json(F.struct(k.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(": "),
        F.regexp_extract(F.to_json(F.struct(F.try_element_at(fields, k).alias("v")),
                                   {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)))
    return F.left(F.sha2(F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}")), 256), F.lit(16))


def json_digest(**fields: Column) -> Column:
    """First 16 hex digits of the sha256 of the fields as JSON: names sorted, a space after
    commas and colons."""
    def member(name: str) -> Column:
        shown = F.to_json(F.struct(fields[name].alias("v")), {"ignoreNullFields": "false"})
        return F.concat(F.lit(f'"{name}": '), F.regexp_extract(shown, r'(?s)^\{"v":(.*)\}$', 1))

    members = F.array_join(F.array(*[member(n) for n in sorted(fields)]), ", ")
    return F.left(F.sha2(F.concat(F.lit("{"), members, F.lit("}")), 256), F.lit(16))
