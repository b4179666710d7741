"""SQL snippets for the twins: URL and text rules in plain SQL for http(s) addresses."""

from __future__ import annotations

from capture_analytics.functions import text as T
from capture_analytics.functions import urls as U


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1))"


def bare_host(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www[.]', '')"


def _query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"


def _decoded(s: str) -> str:
    return f"url_decode(replace({s}, '+', ' '))"


def _encoded(s: str) -> str:
    return f"replace(url_encode({s}), '%20', '+')"


def _name(s: str) -> str:
    return _decoded(f"split_part({s}, '=', 1)")


def _value(s: str) -> str:
    return _decoded(f"case when strpos({s}, '=') > 0 then substr({s}, strpos({s}, '=') + 1) else '' end")


def _rejoined(u: str, keep: str) -> str:
    pair = f"{_encoded(_name('s'))} || '=' || {_encoded(_value('s'))}"
    return (f"array_to_string(list_transform(list_filter(string_split({_query(u)}, '&'), "
            f"lambda s: s <> '' and {keep}), lambda s: {pair}), '&')")


def _with_query(base: str, query: str) -> str:
    return f"{base} || case when {query} <> '' then '?' || {query} else '' end"


def canonical(u: str) -> str:
    lowered = f"lower({_name('s')})"
    prefixes = " and ".join(f"not starts_with({lowered}, '{p}')" for p in U.CANONICAL_DROP_PREFIXES)
    query = _rejoined(u, f"{lowered} not in ({quoted(U.CANONICAL_DROP_NAMES)}) and {prefixes}")
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    path = f"regexp_replace(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')"
    return f"({_with_query(f'{scheme} || $$://$$ || {netloc(u)} || {path}', query)})"


def stripped(u: str) -> str:
    query = _rejoined(u, f"{_name('s')} not in ({quoted(U.TRACKING_PARAMS)})")
    base = f"regexp_extract({u}, '^[^?#]*', 0)"
    fragment = f"regexp_extract({u}, '#.*$', 0)"
    return f"(case when {_query(u)} = '' then {u} else {_with_query(base, query)} || {fragment} end)"


def unwrap_step(u: str) -> str:
    """Target one layer down or NULL."""
    def carried(key: str) -> str:
        return (f"list_filter(string_split({_query(u)}, '&'), lambda s: lower({_name('s')}) = '{key}' "
                f"and {_value('s')} <> '')[1]")

    def target(key: str) -> str:
        raw = f"url_decode({_value(carried(key))})"
        padded = (f"rpad(translate(rtrim({raw}, '='), '-_', '+/'), "
                  f"cast(ceil(length(rtrim({raw}, '=')) / 4.0) * 4 as integer), '=')")
        plain = f"try(decode(from_base64({padded})))"
        return (f"case when regexp_matches({raw}, '^https?://') then {raw} "
                f"when regexp_matches({plain}, '^https?://') then {plain} end")

    return "coalesce(" + ", ".join(target(k) for k in U.TARGET_PARAMS) + ")"


def words(t: str) -> str:
    return f"len(regexp_extract_all(coalesce({t}, ''), '\\S+'))"


def hits(t: str, phrases) -> str:
    return "(" + " + ".join(
        f"cast(contains(lower(coalesce({t}, '')), {literal(p)}) as bigint)" for p in phrases) + ")"


def login_wall(t: str) -> str:
    return (f"({hits(t, T.LOGIN_STRONG_PHRASES)} > 0 or ({words(t)} < {T.WALL_MAX_WORDS} "
            f"and {hits(t, T.LOGIN_WEAK_PHRASES)} >= {T.WALL_MIN_WEAK}))")


def still_loading(t: str) -> str:
    opening = "|".join(T.LOADING_PREFIXES).replace("'", "''")
    return (f"({words(t)} = 0 or regexp_matches(lower({t}), '^\\s*({opening})') "
            f"or ({words(t)} < {T.LOADING_MAX_WORDS} and {hits(t, T.LOADING_PREFIXES)} > 0))")


def reasons(*rules: tuple[str, str]) -> str:
    cases = ", ".join(f"case when {cond} then '{name}' end" for name, cond in rules)
    return f"array_to_string(list_filter([{cases}], lambda r: r is not null), ',')"


def extraction(title: str, company: str, description: str) -> str:
    return reasons(("missing_title", f"{words(title)} = 0"),
                   ("missing_company", f"{words(company)} = 0"),
                   ("thin_description", f"{words(description)} between 1 and {T.STUB_MIN_WORDS - 1}"))


def validation(t: str) -> str:
    return reasons(("source_too_short", f"{words(t)} < {T.SOURCE_MIN_WORDS}"),
                   ("loading_shell_fingerprint",
                    f"{hits(t, T.LOADING_SHELL_PHRASES)} >= {T.SHELL_MIN_HITS}"))
