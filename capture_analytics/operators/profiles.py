"""Per-host learning: profile joins, selector probation and outcome statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capture_analytics.functions.urls import apply_rule_array, java_replacement, url_host
from capture_analytics.operators.ordered import (
    SEGMENT, Sequenced, by_time, first_per_key, run_lengths)

# Consecutive sightings a selector needs before it is trusted (fixed value).
PROBATION = 2

STRETCH = 256  # observations that are folded together


# ---- profiles ---------------------------------------------------------------------

def flatten_profile(top: Column, nested: Column) -> Column:
    """Lift the nested selector blob to the top; a key present at the top wins."""
    nested = F.coalesce(nested, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    return F.map_concat(
        F.map_filter(nested, lambda k, _: ~F.map_contains_key(top, k)), top)


def with_profile(pages: DataFrame, profiles: DataFrame, url: str = "url") -> DataFrame:
    """Pages with the profile of their host; a host without profile keeps NULLs.

    The first profile per host (lowest id) counts. No broadcast hint: Spark broadcasts the
    profiles only below its size threshold, otherwise AQE splits hot hosts of the join.
    """
    columns = [c for c in profiles.columns if c not in ("hostname", "id")]
    first = first_per_key(profiles, ["hostname"], [F.col("id")], columns)
    return (pages.withColumn("host", url_host(F.col(url)))
            .join(first.withColumnRenamed("hostname", "host"), "host", "left"))


def checked_rules(rules: Column) -> Column:
    """Rewrite rules of a profile that compile, in the spelling `regexp_replace` reads.

    Runs over the profile table only, never over pages.
    """
    @F.pandas_udf("array<struct<match:string,rewrite:string>>")
    def check(batch: pd.Series) -> pd.Series:
        def usable(items):
            kept = []
            for item in ([] if items is None else items):
                match, rewrite = item.get("match"), item.get("rewrite")
                if not match or rewrite is None:
                    continue
                try:
                    re.sub(match, rewrite, "")
                except re.error:
                    continue
                kept.append({"match": match.replace("(?P<", "(?<"),
                             "rewrite": java_replacement(rewrite)})
            return kept
        return batch.map(usable)

    return check(rules)


def rewrite_by_profile(pages: DataFrame, profiles: DataFrame, url: str = "url") -> DataFrame:
    """Apply the ordered rewrite rules of each page's host; the first that changes it wins."""
    rules = profiles.select("id", "hostname", checked_rules(F.col("url_rewrites")).alias("rules"))
    joined = with_profile(pages, rules, url)
    empty = F.array().cast("array<struct<match:string,rewrite:string>>")
    return joined.withColumn(
        "rewritten", apply_rule_array(F.col(url), F.coalesce(F.col("rules"), empty))).drop("rules")


# ---- selector probation -----------------------------------------------------------

_STATE = "struct<graduated:string,candidate:string,matches:int,g_in:boolean,c_in:boolean>"


def _state(graduated=None, candidate=None, matches=0, g_in=False, c_in=False) -> Column:
    def col(value):
        return value if isinstance(value, Column) else F.lit(value)
    return F.struct(col(graduated).cast("string").alias("graduated"),
                    col(candidate).cast("string").alias("candidate"),
                    col(matches).cast("int").alias("matches"),
                    col(g_in).alias("g_in"), col(c_in).alias("c_in"))


def _advance(s: Column, event: Column, threshold: int) -> Column:
    """State after one observation. `g_in` / `c_in` stand for "the selector that had
    graduated before this stretch", whose name a stretch does not know."""
    seen, graduated = event["selector"], s["graduated"].isNotNull() | s["g_in"]
    same = F.coalesce(s["candidate"] == seen, F.lit(False))
    demoted = F.when(s["graduated"].isNotNull(), _state(candidate=s["graduated"])).when(
        s["g_in"], _state(c_in=True)).otherwise(s)
    sighted = (F.when(graduated | seen.isNull(), s)
               .when(same & (s["matches"] + 1 >= threshold), _state(graduated=seen))
               .when(same, _state(candidate=seen, matches=s["matches"] + 1))
               .otherwise(_state(candidate=seen, matches=1)))
    return F.when(event["demote"], demoted).otherwise(sighted)


def _outcomes(events: Column, threshold: int) -> Column:
    """What a stretch of observations does to every possible state before it: entry k for
    "its first selector was already seen k times", the last entry for "one had graduated"."""
    def summarise(first: Column) -> Column:
        starts = F.array(*[_state(candidate=first, matches=k) for k in range(threshold)],
                         _state(g_in=True))
        ends = F.aggregate(events, starts, lambda states, e: F.transform(
            states, lambda s: _advance(s, e, threshold)))
        return F.struct(first.alias("first"), ends.alias("ends"))

    sightings = F.filter(events, lambda e: ~e["demote"] & e["selector"].isNotNull())
    first = F.try_element_at(sightings, F.lit(1))["selector"]
    return F.element_at(F.transform(F.array(first), summarise), 1)


def _after(stretch: Column, s: Column, threshold: int) -> Column:
    """State after a stretch, given the state before it."""
    ends, first = stretch["ends"], stretch["first"]
    from_graduated = F.element_at(ends, threshold + 1)
    named = _state(
        graduated=F.when(from_graduated["g_in"], s["graduated"]).otherwise(from_graduated["graduated"]),
        candidate=F.when(from_graduated["c_in"], s["graduated"]).otherwise(from_graduated["candidate"]),
        matches=from_graduated["matches"])
    known = F.coalesce(s["candidate"] == first, F.lit(False))
    return (F.when(s["graduated"].isNotNull(), named)
            .when(s["g_in"], from_graduated)
            .when(first.isNull(), s)
            .when(known, F.element_at(ends, s["matches"] + 1))
            .otherwise(F.element_at(ends, 1)))


def _compose(stretches: Column, threshold: int) -> Column:
    """One stretch that does what several do one after the other."""
    empty = F.struct(F.lit(None).cast("string").alias("first"),
                     F.array(*[_state(matches=k) for k in range(threshold)], _state(g_in=True)
                             ).alias("ends"))

    def join(left: Column, right: Column) -> Column:
        graduated = _after(right, F.element_at(left["ends"], threshold + 1), threshold)
        begun = F.concat(F.slice(right["ends"], 1, threshold), F.array(graduated))
        return F.when(left["first"].isNull(), F.struct(
            right["first"].alias("first"), begun.alias("ends"))).otherwise(F.struct(
                left["first"].alias("first"),
                F.transform(left["ends"], lambda s: _after(right, s, threshold)).alias("ends")))

    return F.aggregate(stretches, empty, join)


def probation_fold(observations: DataFrame, threshold: int = PROBATION) -> DataFrame:
    """Probation state per host after all its observations in order.

    `observations` has `host`, `ts`, `event_id`, `selector` (NULL: nothing seen) and
    `demote`. A selector seen `threshold` times in a row graduates; a graduated host
    ignores sightings until a demotion makes its selector a candidate again.

    The fold is cut into stretches of `STRETCH` observations, so that a hot host is not folded in one
    task and no list is longer than that, however many observations a host or a moment has. Each
    stretch is summarised on its own, and summaries are composed in a tree: blocks of stretches, ranges
    of the order, hosts. Only the last step moves rows.
    """
    if threshold < 2:
        raise ValueError("a probation of one sighting is no probation")
    # observations that change nothing in any state are dropped before the shuffle
    rows = observations.select("host", "ts", "event_id", "selector", "demote").where(
        F.col("demote") | F.col("selector").isNotNull())
    seq = by_time(["host"], "ts", "event_id")
    rows = seq.tagged(rows).withColumn("_at", F.row_number().over(seq.local()) - 1)
    event = F.struct("_at", "selector", "demote")
    blocks = [F.floor(F.col("_at") / STRETCH ** k).alias(f"_block_{k}") for k in (1, 2)]
    levels = ["_block_1", "_block_2", SEGMENT]
    work = rows.select("host", SEGMENT, *blocks, event.alias("event")).groupBy("host", *levels).agg(
        _outcomes(F.array_sort(F.collect_list("event")), threshold).alias("stretch"))
    for i, level in enumerate(levels):
        coarser = levels[i + 1:]
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(
            F.col(level).alias("at"), F.col("stretch")))), lambda x: x["stretch"])
        work = work.groupBy("host", *coarser).agg(_compose(ordered, threshold).alias("stretch"))
    final = _after(F.col("stretch"), _state(), threshold)
    return work.select("host", final.alias("state")).select(
        "host", "state.graduated", "state.candidate",
        F.when(F.col("state.candidate").isNotNull(), F.col("state.matches")).alias("matches"))


def probation_runs(observations: DataFrame, seq: Sequenced, threshold: int = PROBATION) -> DataFrame:
    """First run of equal consecutive sightings per host that reaches `threshold`."""
    seen = observations.where(F.col("selector").isNotNull() & ~F.col("demote"))
    reached = run_lengths(seen, seq, "selector", "run").where(F.col("run") >= threshold)
    return first_per_key(reached, list(seq.keys), [F.col(c) for c in seq.order],
                         ["selector", *seq.order])


def first_discoveries(runs: DataFrame, order: Sequence[str], column: str = "discovered") -> DataFrame:
    """Selectors kept per host: the first non-empty discovery, later ones are ignored."""
    return runs.where(F.col(column).isNotNull()).groupBy("host").agg(
        F.min_by(column, F.struct(*order)).alias(column))


# ---- outcomes ---------------------------------------------------------------------

def host_outcomes(runs: DataFrame) -> DataFrame:
    """Runs, successes, selector-tier hits and success rate per host."""
    return runs.groupBy("host").agg(
        F.count("*").alias("runs"),
        F.count_if(F.coalesce("job_post_id", F.lit(0)) != 0).alias("successes"),
        F.count_if(F.col("tier0_hit")).alias("tier0_hits"),
    ).withColumn("success_rate", F.col("successes") / F.col("runs"))


def outcome_counts(runs: DataFrame, *by: str) -> DataFrame:
    """Runs per outcome and failure reason, optionally per host or batch."""
    return runs.groupBy(*by, "outcome", "failure_reason").agg(F.count("*").alias("runs"))


def batch_summary(results: DataFrame, batch: str) -> DataFrame:
    """Found and succeeded items per polling pass."""
    return results.groupBy(batch).agg(
        F.count("*").alias("found"), F.count_if(F.col("succeeded")).alias("succeeded"))
