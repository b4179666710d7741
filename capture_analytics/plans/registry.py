"""The query catalogue: each entry pairs a Spark plan with its SQL twin, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capture_analytics.sources.views import twin

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under `name`, with its twin (views in brackets) when there is one."""
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            TWINS[name] = twin(sql)
        return plan
    return register
