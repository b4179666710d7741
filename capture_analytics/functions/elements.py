"""Elements of captured html, as arrays made by native expressions.

A page is cut into tokens once. Its tags are then read from left to right with a stack of the
open elements, as a browser does: an end tag closes the last open element of its name and all inside it,
one that nothing matches is ignored, some tags close others by themselves. What comes out is a table of
elements in document order, each with the number of its first and its last token. An element lies
inside another if its first token lies in the other's range.

The fold works on blocks of tags, so what it gathers is copied once per block and not once per tag:
the cost of a page grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capture_analytics.functions.base import let

# ---- fixed values ---------------------------------------------------------------

# elements without content, those that a further opening tag of the same name ends, and those whose
# opening ends an open paragraph
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
        "wbr")
UNNESTED = ("a", "button")
CLOSES_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form",
            "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
            "section", "table", "ul")

BLOCK = 32  # tags that are folded before their results are put to the others
TEXT_BLOCK = 256  # tokens of a block that texts of elements are cut from

QUOTED = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
ATTRS = rf"((?:[\s/]{QUOTED})?)"
# comments, scripts and styles with all they hold, tags, declarations, text
TOKEN = "|".join((
    r"(?is)<!--.*?(?:-->|\z)",
    *(rf"<{raw}(?=[\s/>]){QUOTED}>.*?(?:</{raw}\s*+>|\z)" for raw in ("script", "style")),
    rf"</?[a-z]{QUOTED}>", r"</?[a-z][^>]*+>", r"<[!?/][^>]*+>", r"[^<]++", r"<"))

RANGES = "array<struct<first:int,last:int>>"


def tokens(html: Column) -> Column:
    """The page as comments, tags, declarations and texts; joined they are the page again."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def tags(tokens_of_page: Column, wanted: Column | None = None) -> Column:
    """Tags among the tokens as `(at, name, kind)`: at is the token's number from 0, kind `open`,
    `close` or `empty`; only those with a `wanted` name, if given."""
    def read(token: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
        return F.when(token.startswith("<"), let(name, lambda n: F.struct(
            at.cast("int").alias("at"), n.alias("name"),
            F.when(token.startswith("</"), F.lit("close"))
            .when(n.isin(*VOID, "script", "style") | token.endswith("/>"), F.lit("empty"))
            .otherwise(F.lit("open")).alias("kind"))))

    def chosen(tag: Column) -> Column:
        named = tag.isNotNull() & (tag["name"] != "")
        return named if wanted is None else named & F.array_contains(wanted, tag["name"])

    return F.filter(F.transform(tokens_of_page, read), chosen)


def ranges(tags_of_page: Column, n_tokens: Column) -> Column:
    """`(first, last)` of every element in document order: the numbers of the token that opens it and of
    the last one that belongs to it, its end tag included."""
    none = F.array().cast(RANGES)

    def closed(stack: Column, n: Column, last: Column) -> Column:
        return F.transform(F.slice(stack, F.lit(1), n), lambda e: F.struct(
            e["at"].alias("first"), last.cast("int").alias("last")))

    def depth(stack: Column, tag: Column) -> Column:
        """How many open elements the tag closes; the innermost is the first of the stack."""
        def to(name: Column) -> Column:
            return F.array_position(F.transform(stack, lambda e: e["name"]), name).cast("int")
        ends_p = tag["name"].isin(*CLOSES_P) & (F.try_element_at(stack, F.lit(1))["name"] == "p")
        return F.when(F.size(stack) == 0, F.lit(0)).when(tag["kind"] == "close", to(tag["name"])).when(
            tag["name"].isin(*UNNESTED), to(tag["name"])).when(ends_p, F.lit(1)).otherwise(F.lit(0))

    def step(state: Column, tag: Column) -> Column:
        def apply(n: Column) -> Column:
            left = F.when(n > 0, F.slice(state["stack"], n + 1, F.size(state["stack"]))).otherwise(
                state["stack"])
            own = F.struct(tag["at"].alias("at"), tag["name"].alias("name"))
            # an end tag belongs to what it closes, an opening tag does not
            last = tag["at"] - F.when(tag["kind"] == "close", 0).otherwise(1)
            done = F.when(n > 0, closed(state["stack"], n, last)).otherwise(none)
            return F.struct(
                F.when(tag["kind"] == "open", F.concat(F.array(own), left)).otherwise(left).alias("stack"),
                F.concat(state["done"], done, F.when(tag["kind"] == "empty", F.array(F.struct(
                    tag["at"].alias("first"), tag["at"].alias("last")))).otherwise(none)).alias("done"))
        return let(depth(state["stack"], tag), apply)

    def block(state: Column, part: Column) -> Column:
        start = F.struct(state["stack"].alias("stack"), none.alias("done"))
        return let(F.aggregate(part, start, step), lambda s: F.struct(
            s["stack"].alias("stack"), F.concat(state["done"], F.array(s["done"])).alias("done")))

    start = F.struct(F.array().cast("array<struct<at:int,name:string>>").alias("stack"),
                     F.array().cast(f"array<{RANGES}>").alias("done"))
    return let(F.aggregate(blocks(tags_of_page, BLOCK), start, block), lambda s: F.sort_array(F.concat(
        F.flatten(s["done"]), closed(s["stack"], F.size(s["stack"]), n_tokens - 1))))


def blocks(values: Column, size: int) -> Column:
    """An array cut into arrays of `size` values. A slice costs as much as the array it is taken from is
    long, so what takes many slices takes them from blocks."""
    return let(values, lambda all_of_them: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(all_of_them), F.lit(1)), F.lit(size)),
                 lambda begin: begin <= F.size(all_of_them)),
        lambda begin: F.slice(all_of_them, begin, F.lit(size))))


def part(blocks_of: Column, size: int, begin: Column, n: Column) -> Column:
    """`n` values from number `begin` on, of an array that `blocks` has cut."""
    def cut(block: Column) -> Column:
        several = F.floor((begin + n - 1) / size).cast("int") - block + 1
        return F.slice(F.flatten(F.slice(blocks_of, block + 1, several)), begin % size + 1, n)
    return let(F.floor(begin / size).cast("int"), cut)
