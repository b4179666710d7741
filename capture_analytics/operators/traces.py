"""Run traces: order, path, drift, conformance, lineage and status ladders."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.functions.records import OK_STATUSES
from capture_analytics.functions.text import json_digest, transient_error
from capture_analytics.operators.ordered import (
    Sequenced, first_per_key, neighbour, running_totals)
from capture_analytics.session import cut_lineage

# ---- fixed values: the declared state machine -------------------------------------

NODES = (
    ("StartScrape", "scrape"), ("LoadProfile", "scrape"), ("Navigate", "scrape"),
    ("DetectObstacle", "obstacle"), ("ObstacleRememberMe", "obstacle"),
    ("ObstacleWaitRetry", "obstacle"), ("ObstacleAgent", "obstacle"),
    ("ObstacleFail", "terminal"),
    ("ResolveFinalUrl", "scrape"), ("CheckLinkDedup", "scrape"),
    ("DuplicateShortCircuit", "terminal"), ("WaitReadySelector", "scrape"),
    ("SettleWait", "scrape"), ("ExpandTruncations", "scrape"), ("Capture", "scrape"),
    ("PersistScrape", "scrape"),
    ("StartExtract", "extract"), ("Tier0CSS", "extract"), ("Tier1Mini", "extract"),
    ("Tier2Haiku", "extract"), ("Tier3Sonnet", "extract"), ("EvaluateExtraction", "extract"),
    ("ValidateExtraction", "extract"), ("PersistJobPost", "extract"),
    ("UpdateProfile", "extract"), ("ResolveApplyUrl", "extract"), ("ExtractFail", "terminal"),
)
EDGES = {
    "StartScrape": ("LoadProfile",),
    "LoadProfile": ("Navigate",),
    "Navigate": ("DetectObstacle",),
    "DetectObstacle": ("ObstacleAgent", "ObstacleFail", "ObstacleRememberMe",
                       "ObstacleWaitRetry", "ResolveFinalUrl"),
    "ObstacleRememberMe": ("DetectObstacle", "ObstacleWaitRetry"),
    "ObstacleWaitRetry": ("DetectObstacle", "ObstacleAgent"),
    "ObstacleAgent": ("DetectObstacle", "ObstacleFail"),
    "ResolveFinalUrl": ("CheckLinkDedup",),
    "CheckLinkDedup": ("DuplicateShortCircuit", "WaitReadySelector"),
    "WaitReadySelector": ("ExpandTruncations", "SettleWait"),
    "SettleWait": ("ExpandTruncations",),
    "ExpandTruncations": ("Capture",),
    "Capture": ("PersistScrape",),
    "PersistScrape": ("StartExtract",),
    "StartExtract": ("Tier0CSS",),
    "Tier0CSS": ("Tier1Mini",),
    "Tier1Mini": ("EvaluateExtraction",),
    "Tier2Haiku": ("EvaluateExtraction",),
    "Tier3Sonnet": ("EvaluateExtraction",),
    "EvaluateExtraction": ("ExtractFail", "Tier2Haiku", "Tier3Sonnet", "ValidateExtraction"),
    "ValidateExtraction": ("ExtractFail", "PersistJobPost"),
    "PersistJobPost": ("ExtractFail", "UpdateProfile"),
    "UpdateProfile": ("ResolveApplyUrl",),
}
PURPOSES = {
    "StartScrape": "Take up a capture request", "LoadProfile": "Read what is known about the host",
    "Navigate": "Open the address", "DetectObstacle": "Look for anything that hides the content",
    "ObstacleRememberMe": "Continue as the remembered user", "ObstacleWaitRetry": "Wait and look again",
    "ObstacleAgent": "Let an agent clear the way", "ObstacleFail": "Give up at an obstacle",
    "ResolveFinalUrl": "Settle which address was reached",
    "CheckLinkDedup": "Look the link up among known posts",
    "DuplicateShortCircuit": "Stop at a post that is known", "WaitReadySelector": "Wait for the known element",
    "SettleWait": "Wait until the page rests", "ExpandTruncations": "Unfold shortened texts",
    "Capture": "Take the page's content", "PersistScrape": "Store the capture",
    "StartExtract": "Begin to read the post", "Tier0CSS": "Read it by the profile's selectors",
    "Tier1Mini": "Read it with the smallest model", "Tier2Haiku": "Read it with a larger model",
    "Tier3Sonnet": "Read it with the largest model", "EvaluateExtraction": "Judge what was read",
    "ValidateExtraction": "Check the post against its source", "PersistJobPost": "Store the post",
    "UpdateProfile": "Learn from the result", "ResolveApplyUrl": "Find where to apply",
    "ExtractFail": "Give up reading",
}
END = "End"
MAX_REMEMBER, MAX_WAITS, MAX_AGENT = 2, 3, 1
RUN_CAP_SECONDS, COMPOSITE_SECONDS, LINK_SECONDS = 240, 60, 15


def topology(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Declared nodes in registration order, with the words of their name as label and what
    they are for, and edges sorted by target per source."""
    nodes = spark.createDataFrame([
        (i, n, g, re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", n), PURPOSES[n])
        for i, (n, g) in enumerate(NODES)],
        "position int, id string, group string, label string, description string")
    edges = spark.createDataFrame([(s, t) for s, targets in EDGES.items() for t in targets],
                                  "source string, target string")
    return nodes, edges


# ---- transitions ------------------------------------------------------------------

def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps, towards zero."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (micros / F.lit(1000)).cast("bigint")


def trace_order(transitions: DataFrame, seq: Sequenced) -> DataFrame:
    """Transitions with the node that really came next and whether the route said so."""
    ordered = neighbour(transitions, seq, {"node": "next_node"})
    return ordered.withColumn("as_routed", F.when(
        F.col("next_node").isNotNull(), F.col("routed_to").eqNullSafe(F.col("next_node"))))


def trace_path(transitions: DataFrame, seq: Sequenced) -> DataFrame:
    """The path of every run as numbered steps (rows, not one string: a run has no bound)."""
    return running_totals(transitions, seq, {"step": F.lit(1)})


def trace_clusters(transitions: DataFrame, *fields: str) -> DataFrame:
    """How often each identical node invocation occurs, by digest."""
    return transitions.select(json_digest(**{f: F.col(f) for f in fields}).alias("digest")
                              ).groupBy("digest").agg(F.count("*").alias("n"))


def observed_edges(transitions: DataFrame) -> DataFrame:
    return transitions.select(F.col("node").alias("source"), F.col("routed_to").alias("target")
                              ).where("target is not null").distinct()


def drift(declared: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Declared but never observed (`missing`) and observed but not declared (`extra`)."""
    declared, observed = declared.select(*keys).distinct(), observed.select(*keys).distinct()
    missing = declared.join(observed, list(keys), "left_anti").withColumn("kind", F.lit("missing"))
    extra = observed.join(declared, list(keys), "left_anti").withColumn("kind", F.lit("extra"))
    return missing.unionByName(extra)


def obstacle_counts(attempts: DataFrame, run: str = "scrape_id") -> DataFrame:
    """Attempts per obstacle handler and run."""
    def n(node: str, name: str) -> Column:
        return F.count_if(F.col("node") == node).alias(name)
    return attempts.groupBy(run).agg(
        n("ObstacleRememberMe", "remembers"), n("ObstacleWaitRetry", "waits"),
        n("ObstacleAgent", "agents"))


def obstacle_route(node: Column, remembers: Column, waits: Column, agents: Column) -> Column:
    """Next node a walled run must take, from the attempts made so far."""
    detect = (F.when(remembers < MAX_REMEMBER, F.lit("ObstacleRememberMe"))
              .when(waits < MAX_WAITS, F.lit("ObstacleWaitRetry"))
              .when(agents < MAX_AGENT, F.lit("ObstacleAgent"))
              .otherwise(F.lit("ObstacleFail")))
    wait = F.when((waits >= MAX_WAITS) & (agents < MAX_AGENT), F.lit("ObstacleAgent")
                  ).otherwise(F.lit("DetectObstacle"))
    return F.when(node == "DetectObstacle", detect).when(node == "ObstacleWaitRetry", wait)


def obstacle_conformance(transitions: DataFrame, seq: Sequenced) -> DataFrame:
    """Obstacle steps with the expected route beside the recorded one."""
    def seen(node: str) -> Column:
        return (F.col("node") == node).cast("int")
    counted = running_totals(transitions, seq, {
        "remembers": seen("ObstacleRememberMe"), "waits": seen("ObstacleWaitRetry"),
        "agents": seen("ObstacleAgent")})
    expected = obstacle_route(F.col("node"), F.col("remembers"), F.col("waits"), F.col("agents"))
    # leaving the loop is right whenever the wall is gone, so it conforms
    left = (F.col("node") == "DetectObstacle") & (F.col("routed_to") == "ResolveFinalUrl")
    return counted.where(F.col("node").isin("DetectObstacle", "ObstacleWaitRetry")).withColumn(
        "expected", expected).withColumn(
            "conforms", F.coalesce(left | (F.col("expected") == F.col("routed_to")), F.lit(False)))


# ---- lineage ----------------------------------------------------------------------

def lineage_chain(scrapes: DataFrame, key: str = "scrape_id", parent: str = "source_scrape"
                  ) -> DataFrame:
    """Root and depth of every scrape along its parent links.

    Pointer doubling: each round every open row takes over the pointer of the row it points
    to, so a chain of n needs log2(n) joins and settled rows are not joined again. Rows that
    never settle lie on or behind a cycle and get a NULL root. Every round is cut with a
    checkpoint, so the plan does not grow.
    """
    ids = scrapes.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    known = ids.select(F.col("id").alias("up"))
    # a parent that is not in the table ends the chain
    dangling = ids.where("up is not null").select("up").distinct().join(known, "up", "left_anti")
    ids = ids.join(dangling.withColumn("_gone", F.lit(True)), "up", "left").select(
        "id", F.when(F.col("_gone").isNull(), F.col("up")).alias("up"))
    start = cut_lineage(ids.select(
        "id", F.coalesce("up", "id").alias("up"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.col("up").isNull().alias("settled")))
    parts, still_open = [start.where("settled")], start.where("not settled")
    left = still_open.count()
    while left:
        targets = still_open
        for part in parts:
            targets = targets.unionByName(part)
        targets = targets.select(F.col("id").alias("up"), F.col("up").alias("up2"),
                                 F.col("hops").alias("hops2"), F.col("settled").alias("settled2"))
        jumped = cut_lineage(still_open.join(targets, "up").select(
            "id", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"),
            F.col("settled2").alias("settled")))
        parts.append(jumped.where("settled"))
        still_open, before = jumped.where("not settled"), left
        left = still_open.count()
        if left == before:  # every open chain shortens per round, so these are cycles
            parts.append(still_open.select(
                "id", F.lit(None).cast("bigint").alias("up"),
                F.lit(None).cast("bigint").alias("hops"), "settled"))
            break
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select(F.col("id").alias(key), F.col("up").alias("root"),
                         F.col("hops").alias("depth"))


# ---- statuses ---------------------------------------------------------------------

def latest_status(history: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]
                  ) -> DataFrame:
    """Newest status row per key, combined map-side."""
    return history.groupBy(key).agg(F.max_by(
        F.struct(*columns), F.struct(*order)).alias("_last")).select(
            key, *[F.col("_last")[c].alias(c) for c in columns])


def resolve_fk(children: DataFrame, fk: str, parents: DataFrame, parent_key: str, target: str
               ) -> DataFrame:
    """Children with the id their foreign key leads to in the parent table."""
    lookup = parents.select(F.col(parent_key).alias(fk), F.col(target).alias("_target")
                            ).groupBy(fk).agg(F.min("_target").alias(target))
    return children.join(lookup, fk, "left")


def run_outcome(runs: DataFrame) -> DataFrame:
    """One composite status per run.

    `runs` has `status`, `job_post_id`, `score_id`, `score_status`, `waited_s` (seconds
    until the terminal status or now), `unlinked_s` (seconds without a post after
    completion) and `create_status`.
    """
    status, waited = F.col("status"), F.col("waited_s")
    failed_create = ~F.coalesce("create_status", F.lit(201)).isin(*OK_STATUSES, 501)
    terminal = F.coalesce(status.isin("completed", "failed"), F.lit(False))
    outcome = (F.when(failed_create, F.lit("create_failed"))
               .when(~terminal & (waited >= COMPOSITE_SECONDS), F.lit("timed_out"))
               .when(~terminal, F.lit("running"))
               .when(status == "failed", F.lit("failed"))
               .when(F.col("job_post_id").isNull() & (F.col("unlinked_s") >= LINK_SECONDS),
                     F.lit("unlinked"))
               .when(F.col("job_post_id").isNull(), F.lit("linking"))
               .when(F.col("score_id").isNull(), F.lit("score_failed"))
               .otherwise(F.lit("scored")))
    scored = outcome == "scored"
    return runs.withColumn("outcome", outcome).withColumn(
        "hold_fallback", F.coalesce(F.col("create_status") == 501, F.lit(False))).withColumn(
        "final_score_status", F.when(scored, F.coalesce("score_status", F.lit("pending")))
    ).withColumn("scores_path", F.when(scored, F.concat(
        F.lit("/job-posts/"), F.col("job_post_id").cast("string"), F.lit("/scores"))))


def retry_final(attempts: DataFrame, key: str = "scrape_id") -> DataFrame:
    """Result that counts per capture: the second attempt after a transient error of the
    first, else the first. `attempts` has `attempt` (from 1), `error`, `content`."""
    first_two = attempts.where(F.col("attempt").isin(1, 2)).select(
        key, "attempt", F.struct("attempt", "error", "content").alias("row"))
    both = first_two.groupBy(key).agg(
        F.max(F.when(F.col("attempt") == 1, F.col("row"))).alias("one"),
        F.max(F.when(F.col("attempt") == 2, F.col("row"))).alias("two"))
    retried = transient_error(F.col("one.error")) & F.col("two").isNotNull()
    return both.withColumn("final", F.when(retried, F.col("two")).otherwise(F.col("one"))).select(
        key, F.col("final.attempt").alias("attempt"), F.col("final.error").alias("error"),
        F.col("final.content").alias("content"))


def last_attempt(attempts: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Last attempt per run."""
    return first_per_key(attempts, [key], [-F.col(order)], columns)
