"""Tier cascade and extraction gates over tables of extraction attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capture_analytics.functions.base import holding
from capture_analytics.functions.text import extraction_faults

TIERS = (1, 2, 3)
_BITS = ("missing_title", "missing_company", "thin_description")


def tier_cascade(attempts: DataFrame, tier3_enabled: bool = False) -> DataFrame:
    """Outcome per run of trying the tiers in order until one passes.

    `attempts` has `run_id`, `tier` (1..3), `produced`, `title`, `company_name`,
    `description`. After each tier the latest output so far is evaluated. The evaluation
    is a function of one row, so it is reduced to three bits before the shuffle; per run
    only small integers are combined, and that combines map-side.
    """
    faults = extraction_faults(F.col("title"), F.col("company_name"), F.col("description"))
    bits = sum((faults[name].cast("int") * (1 << i) for i, name in enumerate(_BITS)), F.lit(0))
    output = F.col("output")
    tiers = TIERS if tier3_enabled else TIERS[:-1]
    latest = [F.max(F.when((F.col("tier") <= t), output)).alias(f"after_{t}") for t in tiers]
    tried = [F.max((F.col("tier") == t).cast("int")).alias(f"tried_{t}") for t in tiers]
    nothing = F.lit(3)  # no output at all: title and company are missing

    judged = attempts.where(F.col("tier").isin(*tiers)).select(
        "run_id", "tier", F.when(F.col("produced"), F.col("tier") * 8 + bits).alias("output"))
    runs = judged.groupBy("run_id").agg(*latest, *tried)
    state = {t: F.coalesce(F.col(f"after_{t}") % 8, nothing) for t in tiers}
    passed_at = F.coalesce(*[F.when((F.col(f"tried_{t}") == 1) & (state[t] == 0), F.lit(t))
                             for t in tiers])
    last = F.coalesce(*[F.when(F.col(f"tried_{t}") == 1, F.lit(t)) for t in reversed(tiers)])
    stop = F.coalesce(passed_at, last)
    at_stop = F.coalesce(*[F.when(stop == t, state[t]) for t in tiers])
    source = F.coalesce(*[F.when(stop == t, F.floor(F.col(f"after_{t}") / 8)) for t in tiers])
    names = holding(*[(name, at_stop.bitwiseAND(1 << i) > 0) for i, name in enumerate(_BITS)])
    return runs.select(
        "run_id", passed_at.isNotNull().alias("passed"), stop.cast("int").alias("last_tier"),
        source.cast("int").alias("output_tier"), names.alias("reasons"))


def winning_output(attempts: DataFrame, cascade: DataFrame) -> DataFrame:
    """The extraction that passed, one row per passed run."""
    wins = cascade.where("passed").select("run_id", F.col("output_tier").alias("tier"))
    return attempts.join(wins, ["run_id", "tier"], "left_semi")


def remaining_runs(pages: DataFrame, cascade: DataFrame) -> DataFrame:
    """Runs an expensive tier still has to see: those that have not passed."""
    return pages.join(cascade.where("passed").select("run_id"), "run_id", "left_anti")


def tier_usage(attempts: DataFrame) -> DataFrame:
    """Attempts, outputs, errors, cost and duration by tier and model."""
    return attempts.groupBy("tier", "model").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("produced")).alias("outputs"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("duration_ms").alias("duration_ms"))


def tier0_hits(attempts: DataFrame) -> DataFrame:
    """Runs with the flag whether the selector tier (0) produced output."""
    return attempts.groupBy("run_id").agg(
        F.coalesce(F.bool_or((F.col("tier") == 0) & F.col("produced")), F.lit(False))
        .alias("tier0_hit"))
