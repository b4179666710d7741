"""Matching css selectors against captured html with native expressions.

The page becomes a table of elements with token ranges (`functions.elements`), a selector a list of
chains of compounds. The selectors profiles use are covered: tag, `#id`, `.class`, `[attr]`,
`[attr='v']`, `[attr*='v' i]`, `[attr^='v']`, `[attr$='v']`, descendants and comma lists. Any other
selector matches nothing, like one the browser rejects.

Descendants are found in one pass: the elements that match the ancestors so far and those that match the
next compound are sorted by where they begin, and an element is inside one of the former if it
begins before the furthest end so far.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capture_analytics.functions import elements as E
from capture_analytics.functions.base import let
from capture_analytics.functions.html import attribute, attributes, decode_entities, squeeze

MATCH = "struct<selector:string,found:boolean,text:string,href:string>"

# ---- fixed values ---------------------------------------------------------------

SILENT = ("head", "noscript", "template", "title")

_WORD = r"(?:[\w-]|[^\x00-\x7F])+"
_TAG = r"(?:[A-Za-z][\w-]*|\*)"
_VALUE = r"(?:\"[^\"\]]*\"|'[^'\]]*'|[^\"'\]]*?)"
_SIMPLE = rf"#{_WORD}|\.{_WORD}|\[{_WORD}(?:[*^$]?={_VALUE}\s*i?)?\]"
_PIECE = r"(?:\[[^\]]*\]|[^\s\[])+"
# references that stand for letters, digits, hyphens or underscores
_HIDES_NAMES = "&(?:#|lowbar|UnderBar|fjlig)"

_RANGE = "struct<first:int,last:int>"


# ---- selectors --------------------------------------------------------------------

def _test(text: Column) -> Column:
    """One simple test: kind `#`, `.` or `[`, name, operator, value and whether case is ignored."""
    value = F.regexp_extract(text, rf"=({_VALUE})\s*i?\]$", 1)
    return F.struct(
        F.left(text, F.lit(1)).alias("kind"),
        F.when(text.startswith("["), F.lower(F.regexp_extract(text, rf"^\[({_WORD})", 1))).otherwise(
            F.substr(text, F.lit(2))).alias("name"),
        F.regexp_extract(text, rf"^\[{_WORD}([*^$]?=)", 1).alias("op"),
        F.regexp_replace(value, r"^([\"'])(.*)\1$", "$2").alias("value"),
        text.rlike(rf"={_VALUE}\s*i\]$").alias("any_case"))


def _compound(piece: Column) -> Column:
    """`(tag, tests)` of one compound; NULL when it has an unsupported part."""
    tests = F.regexp_extract_all(F.regexp_replace(piece, rf"^{_TAG}", ""), F.lit(_SIMPLE), F.lit(0))
    return F.when(piece.rlike(rf"^{_TAG}?(?:{_SIMPLE})*$"), F.struct(
        F.lower(F.regexp_extract(piece, rf"^({_TAG})", 1)).alias("tag"),
        F.transform(tests, _test).alias("tests")))


def chains(selector: Column) -> Column:
    """A comma list of descendant chains of compounds; NULL when it is not supported."""
    parsed = F.transform(F.split(F.trim(selector), ","), lambda branch: F.transform(
        F.regexp_extract_all(branch, F.lit(_PIECE), F.lit(0)), _compound))
    return let(parsed, lambda found: F.when(F.forall(found, lambda chain: (F.size(chain) > 0) & F.forall(
        chain, lambda c: c.isNotNull())), found))


def _possible(found: Column, page: Column, lower: Column, open_names: Column) -> Column:
    """Whether the names a selector asks for are in the page at all; a cheap test that skips
    most selectors, and pages that hold none of them."""
    def named(test: Column) -> Column:
        return F.when(test["kind"] == "[", lower.contains(test["name"])).otherwise(
            page.contains(test["name"]))

    def there(compound: Column) -> Column:
        tag = compound["tag"]
        return (tag.isin("", "*") | lower.contains(F.concat(F.lit("<"), tag))) & (
            open_names | F.forall(compound["tests"], named))
    return F.exists(found, lambda chain: F.forall(chain, there))


# ---- elements ---------------------------------------------------------------------

def _elements(tokens: Column, tags: Column) -> Column:
    """Every element as `(first, last, tag, opening)`, in document order."""
    def element(tag: Column, span: Column) -> Column:
        return F.struct(span["first"].alias("first"), span["last"].alias("last"),
                        tag["name"].alias("tag"), F.element_at(tokens, tag["at"] + 1).alias("opening"))
    opened = F.filter(tags, lambda t: t["kind"] != "close")
    return F.zip_with(opened, E.ranges(tags, F.size(tokens)), element)


def _attributes(opening: Column) -> Column:
    return attributes(F.regexp_extract(opening, rf"(?is)^<[a-z][^\s/>]*+{E.ATTRS}/?>", 1))


def _holds(element: Column, compound: Column, hidden: Column) -> Column:
    """Whether an element matches a compound. Attributes are only read where the opening tag
    holds all names that are asked for."""
    def named(test: Column) -> Column:
        text = element["opening"]
        return F.when(test["kind"] == "[", F.lower(text)).otherwise(text).contains(test["name"])

    def test(attrs: Column) -> Column:
        def held(t: Column) -> Column:
            own = F.when(t["kind"] == "#", F.lit("id")).when(t["kind"] == ".", F.lit("class")).otherwise(
                t["name"])
            actual = F.try_element_at(F.filter(attrs, lambda a: a["name"] == own), F.lit(1))["value"]

            def compared(pair: Column) -> Column:
                have, want = pair["have"], pair["want"]
                return F.when(have.isNull() | (t["kind"] == "#"), F.coalesce(have == t["name"], F.lit(
                    False))).when(t["kind"] == ".", F.array_contains(F.split(have, r"\s+"), t["name"])).when(
                    t["op"] == "", F.lit(True)).when(t["op"] == "=", have == want).otherwise((want != "") & (
                        F.when(t["op"] == "*=", have.contains(want)).when(
                            t["op"] == "^=", have.startswith(want)).otherwise(have.endswith(want))))
            return let(F.struct(F.when(t["any_case"], F.lower(actual)).otherwise(actual).alias("have"),
                                F.when(t["any_case"], F.lower(t["value"])).otherwise(t["value"]).alias(
                                    "want")), compared)
        return F.forall(compound["tests"], held)

    fits = compound["tag"].isin("", "*") | (element["tag"] == compound["tag"])
    return fits & ((F.size(compound["tests"]) == 0) | (
        (hidden | F.forall(compound["tests"], named)) & let(_attributes(element["opening"]), test)))


def _inside(outer: Column, inner: Column) -> Column:
    """Those of `inner` that lie inside one of `outer`, an element not inside itself."""
    def events(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["first"].alias("first"), F.lit(kind).alias("kind"), s["last"].alias("last")))

    def step(state: Column, event: Column) -> Column:
        holds = event["kind"] == 1
        return F.struct(
            F.when(holds, F.greatest(state["reach"], event["last"])).otherwise(
                state["reach"]).alias("reach"),
            F.when(~holds & (event["first"] <= state["reach"]), F.concat(state["found"], F.array(
                F.struct(event["first"].alias("first"), event["last"].alias("last"))))).otherwise(
                state["found"]).alias("found"))
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast(f"array<{_RANGE}>").alias("found"))
    return F.aggregate(F.sort_array(F.concat(events(inner, 0), events(outer, 1))), start, step)["found"]


def _first(elements: Column, n: Column, found: Column, hidden: Column) -> Column:
    """The range of the first element in document order that one of the chains matches."""
    page = F.array(F.struct(F.lit(-1).alias("first"), n.alias("last")))

    def next_of(outer: Column, compound: Column) -> Column:
        return _inside(outer, F.filter(elements, lambda e: _holds(e, compound, hidden)))
    return F.array_min(F.transform(found, lambda chain: F.try_element_at(
        F.aggregate(chain, page, next_of), F.lit(1))))


def _text(fragment: Column) -> Column:
    silent = "|".join(rf"{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", *SILENT))
    shown = F.regexp_replace(fragment, rf"(?is)<(?:!--.*?-->|{silent})", "")
    return squeeze(decode_entities(F.regexp_replace(shown, r"<(?=[A-Za-z/!?])" + E.QUOTED + ">", "")))


def match_selectors(html: Column, selectors: Column) -> Column:
    """First element per selector, aligned with the selector array: found, text and href."""
    def missing(name: Column) -> Column:
        return F.struct(name.alias("selector"), F.lit(False).alias("found"),
                        F.lit(None).cast("string").alias("text"),
                        F.lit(None).cast("string").alias("href"))

    def asked(page: Column) -> Column:
        names = F.struct(F.lower(page).alias("lower"), page.rlike(_HIDES_NAMES).alias("open"))
        return let(names, lambda known: F.transform(selectors, lambda s: let(chains(s), lambda c: F.struct(
            s.alias("selector"), F.when(_possible(c, page, known["lower"], known["open"]), c).alias(
                "chains")))))

    def matched(wanted: Column, page: Column) -> Column:
        tokens, elements = page["tokens"], page["elements"]

        def answer(name: Column, span: Column) -> Column:
            inside = E.part(page["blocks"], E.TEXT_BLOCK, span["first"], span["last"] - span["first"] + 1)
            unseen = F.exists(elements, lambda e: e["tag"].isin("script", "style", *SILENT) & span[
                "first"].between(e["first"], e["last"]))
            return F.struct(
                name.alias("selector"), F.lit(True).alias("found"),
                F.when(unseen, F.lit("")).otherwise(_text(F.array_join(inside, ""))).alias("text"),
                attribute(_attributes(F.element_at(tokens, span["first"] + 1)), "href").alias("href"))
        return F.transform(wanted, lambda w: let(F.when(w["chains"].isNotNull(), _first(
            elements, F.size(tokens), w["chains"], page["hidden"])), lambda span: F.when(
            span.isNull(), missing(w["selector"])).otherwise(answer(w["selector"], span))))

    def read(page: Column, wanted: Column) -> Column:
        return let(E.tokens(page), lambda tokens: let(E.tags(tokens), lambda tags: let(F.struct(
            tokens.alias("tokens"), E.blocks(tokens, E.TEXT_BLOCK).alias("blocks"),
            _elements(tokens, tags).alias("elements"), page.rlike(_HIDES_NAMES).alias("hidden")),
            lambda parsed: matched(wanted, parsed))))

    page = F.coalesce(html, F.lit(""))
    return let(page, lambda p: let(asked(p), lambda wanted: F.when(
        F.exists(wanted, lambda w: w["chains"].isNotNull()), read(p, wanted)).otherwise(
        F.transform(wanted, lambda w: missing(w["selector"])))))
