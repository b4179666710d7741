"""All registered queries."""

from capture_analytics.plans import (  # noqa: F401
    chat, dedup, layouts, pages, profiles, quality, records, traces, urls)
from capture_analytics.plans.registry import PLANS, TWINS

__all__ = ["PLANS", "TWINS"]
