"""Duplicate, conflict and candidate selection by joins and anti-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capture_analytics.functions.base import let
from capture_analytics.functions.records import placeholder_company
from capture_analytics.functions.text import is_stub, strip
from capture_analytics.functions.urls import canonicalize_url, normalize_host, unwrap_url, url_host
from capture_analytics.operators.ordered import first_per_key, top_per_key


def repeated_captures(pages: DataFrame) -> DataFrame:
    """Listings captured more than once after redirect wrappers and tracking are removed."""
    # two steps: the unwrapped URL is used many times by the second, computed once by the first
    opened = pages.select("page_id", "url", unwrap_url(F.col("url")).alias("target"))
    keyed = opened.select("page_id", "url", canonicalize_url(F.col("target")).alias("canonical"))
    grouped = keyed.groupBy("canonical").agg(
        F.count("*").alias("captures"),
        F.countDistinct("url").alias("raw_urls"),
        F.min("page_id").alias("first_page_id"))
    # the host is a function of the canonical URL: computed once per group, not per capture
    return grouped.where(F.col("captures") > 1).select(
        url_host(F.col("canonical")).alias("host"), "canonical", "captures", "raw_urls",
        "first_page_id")


def link_duplicates(scrapes: DataFrame, posts: DataFrame) -> DataFrame:
    """Scrapes whose link already belongs to a post with a full description.

    `scrapes` has `scrape_id`, `submitted_url`, `canonical_url`; `posts` has `id`, `link`,
    `description`. Posts are reduced to one row per link before the join, so a link that
    many posts share is never joined many times.
    """
    full = (posts.where(F.col("link").isNotNull() & ~is_stub(F.col("description")))
            .groupBy("link").agg(F.min("id").alias("job_post_id")))
    link = F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("submitted_url"))
    return (scrapes.withColumn("link", link).join(full, "link", "left")
            .withColumn("was_duplicate", F.col("job_post_id").isNotNull()))


def link_conflicts(new_posts: DataFrame, posts: DataFrame) -> DataFrame:
    """New posts with the first existing post of the same link and a 409 when there is one."""
    first = posts.where(F.col("link").isNotNull()).groupBy("link").agg(
        F.min("id").alias("existing_id"))
    return new_posts.join(first, "link", "left").withColumn(
        "status_code", F.when(F.col("existing_id").isNotNull(), F.lit(409)))


PIECE = 32


def _tails(text: Column) -> Column:
    """The up to PIECE characters from every place of a text on."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(PIECE)))


def _grams(text: Column) -> Column:
    """Distinct substrings of PIECE characters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (PIECE - 1)),
                                        lambda i: F.substr(text, i, F.lit(PIECE))))


def resolve_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Company id for every distinct wanted name: an exact name (any case) first, else the
    lowest id whose name contains it, else NULL (`is_new`).

    Company names count once, with their lowest id. Containment of a needle of at most PIECE
    characters is an equi-join on the whole needle: the substrings of company names that are as long as
    some needle are aggregated to their lowest id, so the work grows with the names, however many
    of them share a part. A longer needle is joined on one substring of PIECE characters, the one that
    the fewest company names have, with a check of what it finds. Names have any length.
    """
    wanted = names.select("name").where(~placeholder_company(F.col("name"))).distinct()
    wanted = wanted.withColumn("needle", F.lower("name"))
    known = companies.groupBy(F.lower("name").alias("haystack")).agg(F.min("id").alias("id")).where(
        F.length("haystack") > 0)
    size = F.length("needle")
    # at most PIECE numbers
    sizes = wanted.where(size <= PIECE).agg(F.collect_set(size)).scalar()
    cut = known.select("id", F.explode(_tails(F.col("haystack"))).alias("tail")).withColumn("sizes", sizes)
    held = cut.select("id", F.explode(F.transform(
        F.filter("sizes", lambda n: (n > 0) & (n <= F.length("tail"))),
        lambda n: F.substr("tail", F.lit(1), n))).alias("piece"))
    inside = held.groupBy("piece").agg(F.min("id").alias("inside_id"))

    long = wanted.where(size > PIECE)
    # dealt by gram here: a join would take them for as few as the names that they come from
    grams = known.where(F.length("haystack") > PIECE).select("id", "haystack", F.explode(
        _grams(F.col("haystack"))).alias("gram")).repartition("gram")
    counts = grams.groupBy("gram").agg(F.count("*").alias("held"))
    # a needle with a gram that no name has is in none
    rarest = (long.select("name", "needle", F.explode(_grams(F.col("needle"))).alias("gram"))
              .join(counts, "gram", "left").groupBy("name", "needle")
              .agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("best")))
    far = rarest.select("name", "needle", F.col("best.gram").alias("gram")).join(grams, "gram").where(
        F.contains("haystack", "needle")).select("name", "id")

    short = wanted.where(size <= PIECE).join(inside, F.col("needle") == F.col("piece")).select(
        "name", F.col("inside_id").alias("id"))
    found = short.unionByName(far).groupBy("name").agg(F.min("id").alias("inside_id"))
    exact = known.select("haystack", F.col("id").alias("exact_id"))
    return (wanted.join(exact, F.col("needle") == F.col("haystack"), "left").join(found, "name", "left")
            .select("name", F.coalesce("exact_id", "inside_id").alias("company_id"))
            .withColumn("is_new", F.col("company_id").isNull()))


def create_companies(resolved: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows for the companies that do not exist yet. The id is a hash of the name, so a
    repeated task or run makes the same row again instead of a second company."""
    fresh = resolved.where("is_new").select(
        F.xxhash64(F.lower(strip(F.col("name")))).alias("id"), "name")
    return fresh.join(companies.select("id"), "id", "left_anti")


def unscored_posts(scrapes: DataFrame, scores: DataFrame) -> DataFrame:
    """Completed scrapes whose post has no score yet."""
    done = scrapes.where((F.col("status") == "completed") & F.col("job_post_id").isNotNull())
    scored = scores.select(F.col("post_id").alias("job_post_id")).distinct()
    return done.join(scored, "job_post_id", "left_anti")


def queue_age() -> Column:
    """Place of a scrape in the queue: the newest first, those without a time last."""
    return F.coalesce(-F.unix_micros(F.col("scraped_at").cast("timestamp")), F.lit(2**63 - 1))


def queue_head(waiting: DataFrame, limit: int) -> DataFrame:
    """Of `(job_post_id, age, scrape_id)` the first `2 * limit`, each post once, first `limit`."""
    newest = waiting.orderBy("age", "scrape_id").limit(2 * limit).select(
        "job_post_id", F.struct("age", "scrape_id").alias("position"))
    return (newest.groupBy("job_post_id").agg(F.min("position").alias("position"))
            .orderBy("position").limit(limit)
            .select("job_post_id", F.col("position")["scrape_id"].alias("scrape_id")))


def score_batch(scrapes: DataFrame, scores: DataFrame, limit: int = 5) -> DataFrame:
    """Next posts to score: the newest `2 * limit` unscored scrapes, each post once, first
    `limit` in that order. Both limits are the operator: the work queue is read in batches."""
    waiting = unscored_posts(scrapes, scores).select(
        "job_post_id", queue_age().alias("age"), "scrape_id")
    return queue_head(waiting, limit)


def distinct_in_order(df: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str],
                      limit: int | None = None) -> DataFrame:
    """First occurrence of every key in order, at most `limit` keys when given."""
    once = first_per_key(df, [key], order, columns)
    return once.limit(limit) if limit is not None else once


# ---- hosts and configured domains -------------------------------------------------

def _suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels) - i + 1), "."))


def match_domains(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Best configured domain per distinct host: equal, parent or child; an equal one first,
    then the longest, then the lexically first.

    Both directions are equi-joins on exploded suffixes (a host has few labels).
    """
    host = hosts.select(normalize_host(F.col("host")).alias("host")).where("host <> ''").distinct()
    domain = domains.select(F.col("domain")).where("domain <> ''").distinct()
    parents = (host.select("host", F.explode(_suffixes(F.col("host"))).alias("domain"))
               .join(domain, "domain").select("host", "domain"))
    children = (domain.select("domain", F.explode(_suffixes(F.col("domain"))).alias("host"))
                .where("host <> domain").groupBy("host")
                # one child per host suffices: pre-aggregated, so a short host stays cheap
                .agg(F.min_by("domain", F.struct((-F.length("domain")).alias("l"), F.col("domain")))
                     .alias("domain"))
                .join(host, "host", "left_semi").select("host", "domain"))
    preference = F.struct((F.col("domain") != F.col("host")).alias("other"),
                          (-F.length("domain")).alias("size"), F.col("domain").alias("name"))
    best = parents.unionByName(children).groupBy("host").agg(
        F.min_by("domain", preference).alias("domain"))
    return host.join(best, "host", "left")


def _marked_bigrams(text: Column) -> Column:
    """Bigrams of a text between two marks, each with the number of its occurrence."""
    def numbered(grams: Column) -> Column:
        return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(
            F.slice(grams, 1, i + 1), lambda h: h == g)).cast("string")))
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return let(F.transform(F.sequence(F.lit(1), F.length(marked) - 1),
                           lambda i: F.substr(marked, i, F.lit(2))), numbered)


def closest_domains(hosts: DataFrame, domains: DataFrame, n: int = 3,
                    cutoff: float = 0.6) -> DataFrame:
    """Up to `n` domains that look like each distinct host, best first, equal ones by name.

    Likeness is 1 - levenshtein / length of the longer one. A pair above the cutoff has at most
    (1 - cutoff) x length edits; each destroys two of the length + 1 bigrams, so the pair shares a
    known number of them, and at least one of the host's rarest. Pairs come from an equi-join on
    those and are checked once.
    """
    host = hosts.select("host").where(F.length("host") > 0).distinct()
    domain = domains.select("domain").where(F.length("domain") > 0).distinct()
    held = domain.select("domain", F.explode(_marked_bigrams(F.col("domain"))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    size = F.length("host")
    # the least a pair can share: for longer domains it is more
    shared = F.greatest(F.lit(1), F.floor(size * F.lit(2 * cutoff - 1)) + 1)
    rare = (host.select("host", F.explode(_marked_bigrams(F.col("host"))).alias("gram"))
            .join(counts, "gram").groupBy("host")
            .agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams")))
    # bigrams that no domain has come first in the order and lead nowhere
    take = F.greatest(F.lit(0), F.size("grams") - shared + 1).cast("int")
    pairs = (rare.select("host", F.explode(F.slice("grams", 1, take)).alias("g"))
             .select("host", F.col("g.gram").alias("gram")).join(held, "gram")
             .select("host", "domain").distinct())
    likeness = 1 - F.levenshtein("host", "domain") / F.greatest(F.length("host"), F.length("domain"))
    near = pairs.withColumn("likeness", likeness).where(F.col("likeness") >= cutoff)
    return top_per_key(near, ["host"], [F.desc("likeness"), F.col("domain")], n).drop("likeness")
