"""Reading captured html with native expressions.

Tags are cut out with regular expressions that never backtrack over a whole page
(possessive quantifiers, one pass each), so text, title, links, form fields and apply
targets need no Python; neither does selector matching, see `functions.selectors`.
"""

from __future__ import annotations

import html as standard
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from capture_analytics.functions import elements
from capture_analytics.functions.base import let
from capture_analytics.functions.text import filled
from capture_analytics.functions.urls import absolute_url

# ---- fixed values ---------------------------------------------------------------

HIDDEN = ("script", "style", "head", "noscript", "template")
INLINE = ("a", "abbr", "b", "bdi", "cite", "code", "em", "font", "i", "kbd", "label", "mark", "q",
          "s", "small", "span", "strong", "sub", "sup", "u", "var")
CANDIDATE_TEXT = 100
INPUT_TYPES = ("button", "checkbox", "color", "date", "datetime-local", "email", "file", "hidden",
               "image", "month", "number", "password", "radio", "range", "reset", "search",
               "submit", "tel", "text", "time", "url", "week")
EXPAND_CLASSES = ("jobs-description__footer-button", "show-more-less-html__button")
EXPAND_LABELS = ("see more", "show more")
EXPAND_TEXTS = ("see more", "show more", "read more")

_ATTRS = r"((?:\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)?)"
_ATTR = r"[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+"


# a tag, quoted values respected; the second form takes tags with unbalanced quotes
_TAG = r"</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[/!?A-Za-z][^>]*+>"
_OPENING = rf"(?is)^<[A-Za-z][A-Za-z0-9]*{_ATTRS}/?>"


# a character reference; names are looked up in the standard table, which also says which of them
# need no semicolon
_REFERENCE = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});?"
_NAMED = json.dumps({**html5, **{  # numbers that stand for other characters than their own
    f"#{i}": standard.unescape(f"&#{i};") for i in (0, *range(0x80, 0xA0))}})


def _character(reference: Column) -> Column:
    """The characters of one reference; of an unknown name, the reference itself."""
    name = F.substr(reference, F.lit(2))
    digits = F.rtrim(name, F.lit(";"))
    number = F.when(digits.rlike("^#[xX]"), F.conv(F.substr(digits, F.lit(3)), 16, 10)).when(
        digits.startswith("#"), F.substr(digits, F.lit(2))).cast("bigint")
    known = F.from_json(F.lit(_NAMED), "map<string,string>")
    numbered = F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    return F.when(number.isNull(), F.coalesce(F.try_element_at(known, name), reference)).otherwise(
        F.coalesce(F.try_element_at(known, F.concat(F.lit("#"), number.cast("string"))), numbered))


def decode_entities(text: Column) -> Column:
    """Text with its character references, by name and by number, replaced once."""
    between = F.split(text, _REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    decoded = F.array_join(F.zip_with(between, found, lambda t, r: F.concat(
        t, F.coalesce(_character(r), F.lit("")))), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def squeeze(text: Column) -> Column:
    """Runs of whitespace as one space, no space at the ends."""
    return F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r \xA0]++", " "))


def without_hidden(html: Column) -> Column:
    """Html without comments and without elements that never show text."""
    hidden = "|".join(rf"{tag}\b[^>]*>.*?</{tag}\s*>" for tag in HIDDEN)
    return F.regexp_replace(filled(html), rf"(?is)<(?:!--.*?-->|{hidden})", " ")


def plain_text(fragment: Column) -> Column:
    """Text of a fragment: inline tags join words, other tags part them."""
    inline = rf"(?i)</?(?:{'|'.join(INLINE)}){_ATTRS}/?>"
    return squeeze(decode_entities(F.regexp_replace(
        F.regexp_replace(fragment, inline, ""), _TAG, " ")))


def visible_text(html: Column) -> Column:
    """Text of the page body."""
    return plain_text(without_hidden(html))


def page_title(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_extract(
        filled(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))


def attributes(text: Column) -> Column:
    """Attributes of one tag in order, as `(name, value)`; a bare name has an empty value."""
    def parts(token: Column) -> Column:
        value = F.regexp_extract(token, r"(?s)^[^=]*?=\s*(.*)$", 1)
        return F.struct(
            F.lower(F.regexp_extract(token, r"^([^\s=]+)", 1)).alias("name"),
            decode_entities(F.regexp_replace(value, r"^([\"'])((?s).*)\1$", "$2")).alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(_ATTR), F.lit(0)), parts)


def attribute(attrs: Column, name: str) -> Column:
    """Value of the first attribute of that name, NULL when absent."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(1))["value"]


def open_tags(html: Column, tags: str) -> Column:
    """Opening tags whose name matches `tags`, as `(tag, attrs)` in document order."""
    pattern = rf"(?is)<(?:{tags}){_ATTRS}/?>"
    found = F.regexp_extract_all(without_hidden(html), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda t: F.struct(
        F.lower(F.regexp_extract(t, r"^<([A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"),
        attributes(F.regexp_extract(t, rf"(?is)^<[A-Za-z][A-Za-z0-9]*{_ATTRS}/?>$", 1)).alias("attrs")))


def interactive_elements(html: Column) -> Column:
    """Links, buttons and elements with the button role, as `(tag, attrs, text)`.

    The page is cut into tokens once; only tags of the names that such elements have are matched. The
    text of an element is all that lies in its range of tokens, other elements included.
    """
    opening = r"(?is)^<(?:(?:a|button)[\s/>]|[a-z][^\s/>]*+\s[^>]*\brole\s*=\s*[\"']?button\b)"

    def element(page: Column, cut: Column, span: Column) -> Column:
        token, n = F.element_at(page, span["first"] + 1), span["last"] - span["first"]
        inside = F.when(n > 0, elements.part(cut, elements.TEXT_BLOCK, span["first"] + 1, n))
        return F.struct(
            F.lower(F.regexp_extract(token, r"^<([A-Za-z][^\s/>]*)", 1)).alias("tag"),
            attributes(F.regexp_extract(token, _OPENING, 1)).alias("attrs"),
            plain_text(filled(F.array_join(inside, ""))).alias("text"))

    def steps(page: Column) -> Column:
        names = F.array_distinct(F.transform(
            F.filter(page, lambda t: t.rlike(opening)),
            lambda t: F.lower(F.regexp_extract(t, r"^<([A-Za-z][^\s/>]*)", 1))))
        spans = let(names, lambda wanted: F.when(F.size(wanted) > 0, elements.ranges(
            elements.tags(page, wanted), F.size(page))).otherwise(F.array().cast(elements.RANGES)))
        likely = F.filter(spans, lambda s: F.element_at(page, s["first"] + 1).rlike(opening))
        found = let(elements.blocks(page, elements.TEXT_BLOCK), lambda cut: F.transform(
            likely, lambda s: element(page, cut, s)))
        return F.filter(found, lambda e: e["tag"].isin("a", "button")
                        | (F.coalesce(attribute(e["attrs"], "role"), F.lit("")) == "button"))

    return let(elements.tokens(without_hidden(html)), steps)


def page_links(html: Column, base: Column) -> Column:
    """Every link of the page as `(text, href)`, href resolved against the page address."""
    links = F.filter(interactive_elements(html), lambda e: (e["tag"] == "a")
                     & F.exists(e["attrs"], lambda a: a["name"] == "href"))
    return F.transform(links, lambda e: F.struct(
        e["text"].alias("text"),
        absolute_url(base, attribute(e["attrs"], "href")).alias("href")))


def form_fields(html: Column) -> Column:
    """Inputs, submit buttons and button-role elements with a derived selector."""
    def blank(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    def wanted(t: Column) -> Column:
        attrs = t["attrs"]
        return ((t["tag"] == "input")
                | ((t["tag"] == "button") & (F.lower(attribute(attrs, "type")) == "submit"))
                | (attribute(attrs, "role") == "button"))

    def field(t: Column) -> Column:
        attrs = t["attrs"]
        control = t["tag"].isin("input", "button")
        ident, name = blank(attribute(attrs, "id")), F.when(control, blank(attribute(attrs, "name")))
        label, kind = attribute(attrs, "aria-label"), F.lower(blank(attribute(attrs, "type")))
        kind = F.when(t["tag"] == "input", F.when(kind.isin(*INPUT_TYPES), kind).otherwise("text")
                      ).when(t["tag"] == "button", F.lit("submit"))
        return F.struct(
            t["tag"].alias("tag"), kind.alias("type"),
            name.alias("name"), ident.alias("id"),
            F.when(t["tag"] == "input", blank(attribute(attrs, "placeholder"))).alias("placeholder"),
            label.alias("aria_label"),
            F.coalesce(F.concat(F.lit("#"), ident),
                       F.concat(F.lit('[name="'), name, F.lit('"]')),
                       F.concat(F.lit('[aria-label="'), blank(label), F.lit('"]'))
                       ).alias("selector"))

    tags = r"input|button|[a-z][a-z0-9]*(?=\s[^>]*\brole\s*=)"
    return F.transform(F.filter(open_tags(html, tags), wanted), field)


def _applyish(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\bapply\b"), F.lit(False))


def element_selector(tag: Column, attrs: Column) -> Column:
    """Short selector of an element: its id, else tag, three classes and two data values, whole."""
    ident = attribute(attrs, "id")
    word = r"^[A-Za-z][A-Za-z0-9_-]*$"
    classes = F.slice(F.filter(F.split(filled(attribute(attrs, "class")), r"\s+"),
                               lambda c: c.rlike(word)), 1, 3)
    data = F.slice(F.filter(attrs, lambda a: a["name"].startswith("data-")), 1, 2)
    return F.when(ident.rlike(word), F.concat(F.lit("#"), ident)).otherwise(F.concat(
        tag,
        F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""),
        F.array_join(F.transform(data, lambda a: F.concat(
            F.lit("["), a["name"], F.lit('="'), a["value"], F.lit('"]'))), "")))


def apply_candidates(html: Column, base: Column) -> Column:
    """Elements that look like an apply target, links first, with score and reason."""
    def seen(e: Column, href: Column | None) -> Column:
        return F.struct(
            e["tag"], e["attrs"], e["text"],
            (href if href is not None else F.lit(None).cast("string")).alias("href"),
            attribute(e["attrs"], "aria-label").alias("aria"))

    def judged(s: Column) -> Column:
        return F.struct(s.alias("s"), _applyish(s["href"]).alias("in_href"),
                        _applyish(s["text"]).alias("in_text"), _applyish(s["aria"]).alias("in_aria"))

    def candidate(j: Column) -> Column:
        s = j["s"]
        rules = ((0.5, "href contains 'apply'", j["in_href"]), (0.4, "text 'apply'", j["in_text"]),
                 (0.3, "aria-label 'apply'", j["in_aria"]))
        score = sum((F.when(hit, F.lit(points)).otherwise(0.0) for points, _, hit in rules),
                    F.lit(0.0))
        reasons = F.array_compact(F.array(*[F.when(hit, F.lit(why)) for _, why, hit in rules]))
        return F.struct(
            element_selector(s["tag"], s["attrs"]).alias("selector"),
            F.when(s["href"].startswith("http"), s["href"]).alias("href"),
            F.left(s["text"], F.lit(CANDIDATE_TEXT)).alias("text"), s["tag"],
            F.round(F.least(score, F.lit(1.0)), 2).alias("score"),
            F.array_join(reasons, " AND ").alias("reason"))

    def scan(elements: Column) -> Column:
        links = F.filter(elements, lambda e: (e["tag"] == "a")
                         & F.exists(e["attrs"], lambda a: a["name"] == "href"))
        buttons = F.filter(elements, lambda e: (e["tag"] == "button")
                           | (F.coalesce(attribute(e["attrs"], "role"), F.lit("")) == "button"))
        both = F.concat(
            F.transform(links, lambda e: seen(e, absolute_url(base, attribute(e["attrs"], "href")))),
            F.transform(buttons, lambda e: seen(e, None)))
        likely = F.filter(F.transform(both, judged),
                          lambda j: j["in_href"] | j["in_text"] | j["in_aria"])
        return F.transform(likely, candidate)

    return let(interactive_elements(html), scan)


def expandable_texts(html: Column) -> Column:
    """Distinct lower-cased texts of buttons that unfold shortened content."""
    def unfolds(e: Column) -> Column:
        text, label = F.lower(e["text"]), F.lower(filled(attribute(e["attrs"], "aria-label")))
        classes = F.split(filled(attribute(e["attrs"], "class")), r"\s+")
        named = F.lit(False)
        for name in EXPAND_CLASSES:
            named = named | F.array_contains(classes, name)
        for phrase in EXPAND_LABELS:
            named = named | label.contains(phrase)
        for phrase in EXPAND_TEXTS:
            named = named | text.contains(phrase)
        return (e["tag"] == "button") & named & text.contains("more")

    return F.array_distinct(F.transform(
        F.filter(interactive_elements(html), unfolds), lambda e: F.lower(e["text"])))
