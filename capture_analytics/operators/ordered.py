"""Order-dependent operators that survive hot keys.

A plain window over `key` puts all rows of that key into one task. Here every key is
first cut into segments, monotone in the order: a block of 1 024 turns, or a range of the
order of all rows by key and position, between splitters that a sample gives. Rows are
shuffled by (key, segment) and windowed inside their segment; only one summary row per
segment is ordered per key, and its value is joined back. The result equals the plain
window, whatever share of the rows has one key, and whatever share of those one timestamp.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from capture_analytics.functions.base import let

TURN_BLOCK = 1024
RANGE_ROWS = 1 << 16    # rows of a range
MOST_RANGES = 1 << 12   # at most so many ranges; they grow with the rows beyond that
RANGE_SAMPLE = 32       # sampled positions for each range
SEGMENT = "_segment"


@dataclass(frozen=True)
class Sequenced:
    """How rows are ordered within a key: `order` is total, `segment` is monotone in it.

    The segment is made on use, so an ordering can be declared before a session exists.
    """

    keys: Sequence[str]
    order: Sequence[str]
    segment: Callable[[], Column]

    def tagged(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SEGMENT, self.segment())

    def local(self):
        return Window.partitionBy(*self.keys, SEGMENT).orderBy(*self.order)

    def across(self):
        return Window.partitionBy(*self.keys).orderBy(SEGMENT)

    def summary(self, df: DataFrame, *aggregates: Column) -> DataFrame:
        return df.groupBy(*self.keys, SEGMENT).agg(*aggregates)

    def attach(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        return df.join(summary, [*self.keys, SEGMENT], "left")


class Ranged(Sequenced):
    """Segments are ranges of the order by key and position, of about `RANGE_ROWS` rows each.

    A sample of at most about MOST_RANGES x RANGE_SAMPLE positions gives the splitters; the tag of a
    row depends on its position and the splitters alone, so a task that runs again gives the same.
    """

    def tagged(self, df: DataFrame) -> DataFrame:
        place = F.struct(*self.keys, *self.order)
        splitters = self._splitters(df, place)
        if not splitters:
            return df.withColumn(SEGMENT, F.lit(0))
        known = F.from_json(F.lit(f"[{','.join(splitters)}]"), ArrayType(
            df.select(place.alias("place")).schema["place"].dataType), _EXACT)
        return df.withColumn(SEGMENT, let(place, lambda own: _rank(known, len(splitters), own)))

    def _splitters(self, df: DataFrame, place: Column) -> list[str]:
        """Positions that cut the rows into ranges, as json; one position is not split further."""
        n = df.count()
        ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
        if ranges <= 1:
            return []
        share = min(1.0, ranges * RANGE_SAMPLE / n)
        hashed = F.shiftrightunsigned(F.xxhash64(*self.keys, *self.order), 2)
        sample = df.where(hashed < int(2 ** 62 * share)).groupBy(place.alias("place")).count().orderBy(
            "place").select(F.to_json("place", _EXACT), "count").collect()
        reached = list(itertools.accumulate(r[1] for r in sample))
        wanted = sorted({bisect.bisect_left(reached, k * reached[-1] / ranges)
                         for k in range(1, ranges)}) if sample else []
        return [sample[i][0] for i in wanted]


_EXACT = {f"{kind}Format": f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}"
          for kind, zone in (("timestamp", "XXX"), ("timestampNTZ", ""))}


def _rank(splitters: Column, n: int, place: Column) -> Column:
    """How many of the sorted splitters are not above a position, by halving."""
    def step(s: Column, _: Column) -> Column:
        def halved(middle: Column) -> Column:
            above = F.element_at(splitters, middle + 1) > place
            return F.struct(F.when(above, s["low"]).otherwise(middle + 1).alias("low"),
                            F.when(above, middle).otherwise(s["high"]).alias("high"))
        return F.when(s["low"] >= s["high"], s).otherwise(
            let(F.floor((s["low"] + s["high"]) / 2).cast("int"), halved))
    turns = F.sequence(F.lit(1), F.lit(n.bit_length()))
    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), step)["low"]


def by_time(keys: Sequence[str], time: str, tiebreak: str) -> Sequenced:
    """Rows ordered by a timestamp and a tiebreak, cut into ranges of bounded length."""
    return Ranged(keys, (time, tiebreak), lambda: F.lit(0))


def by_number(keys: Sequence[str], number: str, block: int = TURN_BLOCK) -> Sequenced:
    """Rows ordered by an integer that is unique in its key: a segment holds at most
    `block` rows by construction."""
    return Sequenced(keys, (number,), lambda: F.floor(F.col(number) / F.lit(block)))


def running_totals(df: DataFrame, seq: Sequenced, totals: Mapping[str, Column],
                   newest_first: bool = False) -> DataFrame:
    """Running sums per key, the current row included."""
    tagged = seq.tagged(df)
    order = [F.col(c).desc() if newest_first else F.col(c) for c in seq.order]
    local = Window.partitionBy(*seq.keys, SEGMENT).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    seg = F.col(SEGMENT)
    before = Window.partitionBy(*seq.keys).orderBy(
        seg.desc() if newest_first else seg).rowsBetween(Window.unboundedPreceding, -1)
    summary = seq.summary(tagged, *[F.sum(v).alias(f"_t_{n}") for n, v in totals.items()])
    summary = summary.select(*seq.keys, SEGMENT, *[
        F.sum(f"_t_{n}").over(before).alias(f"_before_{n}") for n in totals])
    rows = tagged.select("*", *[F.sum(v).over(local).alias(f"_in_{n}") for n, v in totals.items()])
    joined = seq.attach(rows, summary)
    for name in totals:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_before_{name}"), F.lit(0))
                                   + F.coalesce(F.col(f"_in_{name}"), F.lit(0)))
    return joined.drop(SEGMENT, *[p + n for n in totals for p in ("_before_", "_in_")])


def neighbour(df: DataFrame, seq: Sequenced, columns: Mapping[str, str],
              step: int = 1) -> DataFrame:
    """Value of the next (`step=1`) or previous (`step=-1`) row of the key, under new names."""
    tagged = seq.tagged(df)
    packed = F.struct(*[F.col(c) for c in columns])
    position = F.struct(*[F.col(c) for c in seq.order])
    edge = F.min_by(packed, position) if step > 0 else F.max_by(packed, position)
    shift = F.lead if step > 0 else F.lag
    summary = seq.summary(tagged, edge.alias("_edge")).select(
        *seq.keys, SEGMENT, shift("_edge").over(seq.across()).alias("_beyond"))
    rows = tagged.withColumn("_inside", shift(packed).over(seq.local()))
    joined = seq.attach(rows, summary).withColumn(
        "_found", F.coalesce(F.col("_inside"), F.col("_beyond")))
    return joined.select(*df.columns, *[
        F.col("_found")[old].alias(new) for old, new in columns.items()])


def carry_last(df: DataFrame, seq: Sequenced, values: Mapping[str, Column]) -> DataFrame:
    """Latest non-null value per key up to and including the current row."""
    tagged = seq.tagged(df)
    local = seq.local().rowsBetween(Window.unboundedPreceding, 0)
    before = seq.across().rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*[F.col(c) for c in seq.order])
    summary = seq.summary(tagged, *[
        F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_s_{n}") for n, v in values.items()])
    summary = summary.select(*seq.keys, SEGMENT, *[
        F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in values])
    rows = tagged.select("*", *[
        F.last(v, ignorenulls=True).over(local).alias(f"_in_{n}") for n, v in values.items()])
    joined = seq.attach(rows, summary)
    for name in values:
        joined = joined.withColumn(name, F.coalesce(f"_in_{name}", f"_before_{name}"))
    return joined.drop(SEGMENT, *[p + n for n in values for p in ("_before_", "_in_")])


def run_lengths(df: DataFrame, seq: Sequenced, column: str, name: str) -> DataFrame:
    """How many rows of the key in a row, the current one included, have its value of `column`.

    A run that goes on over segments is carried by one row per segment: its last value, how long
    the run at its end is, and whether that run fills the segment and so continues the one before.
    """
    whole = Window.unboundedPreceding
    local, position = seq.local(), F.struct(*[F.col(c) for c in seq.order])
    rows = seq.tagged(df).withColumn("_at", F.row_number().over(local))
    begins = (F.col("_at") == 1) | ~F.lag(column).over(local).eqNullSafe(F.col(column))
    rows = rows.withColumn("_begin", F.when(begins, F.col("_at")))
    rows = rows.withColumn("_begin", F.last("_begin", ignorenulls=True).over(
        local.rowsBetween(whole, 0))).withColumn("_in", F.col("_at") - F.col("_begin") + 1)
    summary = seq.summary(rows, F.count("*").alias("_n"), F.max_by(F.struct(
        F.col(column).alias("value"), F.col("_in").alias("tail")), position).alias("_end"))
    before = F.lag("_end").over(seq.across())
    continues = (before.isNotNull() & before["value"].eqNullSafe(F.col("_end")["value"])
                 & (F.col("_end")["tail"] == F.col("_n")))
    summary = summary.withColumn("_new", F.when(continues, 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(seq.across().rowsBetween(whole, 0)))
    total = F.sum(F.col("_end")["tail"]).over(
        Window.partitionBy(*seq.keys, "_run").orderBy(SEGMENT).rowsBetween(whole, 0))
    summary = summary.withColumn("_end", F.struct(F.col("_end")["value"].alias("value"),
                                                  total.alias("tail")))
    summary = summary.select(*seq.keys, SEGMENT, F.lag("_end").over(seq.across()).alias("_before"))
    joined = seq.attach(rows, summary)
    carried = F.when((F.col("_begin") == 1) & F.col("_before").isNotNull()
                     & F.col("_before")["value"].eqNullSafe(F.col(column)), F.col("_before")["tail"])
    return joined.withColumn(name, F.col("_in") + F.coalesce(carried, F.lit(0))).drop(
        SEGMENT, "_at", "_begin", "_in", "_before")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  columns: Sequence[str]) -> DataFrame:
    """One row per key, the first in `order`; combined map-side, so hot keys stay cheap."""
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")).select(*keys, *[
            F.col("_first")[c].alias(c) for c in columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
                rank: str = "rank") -> DataFrame:
    """First `limit` rows per key. Spark cuts each map task to `limit` rows per key before
    the shuffle (window group limit), so a hot key moves few rows."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)
    return ranked.withColumn(rank, F.col(rank).cast("bigint"))
