"""Building blocks of Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def holding(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order. No lambda is involved, so the conditions are
    compiled and what they share is computed once."""
    names = F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules])
    return F.array_except(names, F.array(F.lit(None).cast("string")))
