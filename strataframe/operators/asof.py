"""As-of joins: each left row with the latest right row at or before its time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, prefix: str = "right_", tie: str | None = None, tolerance: Column | None = None, span: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the columns of the latest right row of the same by and right.on <= left.on.

    Both sides are laid one behind the other and sorted once by key and time; the latest right
    row is carried forward by a window. One exchange, no row multiplies, and memory doesn't
    depend on how many rows a key has. span: a number that never falls as time goes on (a day, say).
    A key's spans are then sorted apart from each other, so a key with a large share of all rows
    is many tasks' work; into each span comes the latest right row of those before it, found among
    one row for each span. Among right rows of one time the largest tie counts (or
    any without tie). tolerance: right rows older than this interval give nulls. Null keys or
    times match nothing; left rows stay as they are, repeated ones too.
    """
    values = [c for c in right.columns if c not in by]
    complete = F.col(on).isNotNull()
    for c in by:
        complete &= F.col(c).isNotNull()
    right, unmatched, left = right.filter(complete), left.filter(~complete), left.filter(complete)  # those with a null meet nothing and no window
    row = F.struct(*values)
    one = left.select(*(F.col(c).alias(f"_l_{c}") for c in left.columns), *by, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    if tie:
        one = one.withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType))
    two = right.select(*(F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in left.columns), *by, F.col(on).alias("_at"), F.lit(0).alias("_side"), row.alias("_row"), *([F.col(tie).alias("_tie")] if tie else []))
    order = ["_at", "_side", *(["_tie"] if tie else [])]
    if span:
        one, two = (side.withColumn("_span", span(F.col("_at"))) for side in (one, two))
        carried = _carried(one, two, by, ["_at", *(["_tie"] if tie else [])])
        lacking = [F.lit(None).cast(two.schema[c].dataType).alias(c) for c in two.columns if c.startswith("_l_")]
        at, *more = (F.col(f"_last.{c}").alias(c) for c in ("_at", *(["_tie"] if tie else [])))
        two = two.unionByName(carried.select(*lacking, *by, at, F.lit(0).alias("_side"), F.col("_last._row").alias("_row"), *more, "_span"))
    keys = [*by, *(["_span"] if span else [])]
    latest = F.last("_row", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = one.unionByName(two).withColumn("_found", latest).filter("_side = 1")
    usable = F.col(f"_found.{on}").isNotNull()
    if tolerance is not None:
        usable &= F.col(f"_found.{on}") >= F.col("_at") - tolerance
    made = joined.select(*(F.col(f"_l_{c}").alias(c) for c in left.columns), *(F.when(usable, F.col(f"_found.{c}")).alias(prefix + c) for c in values))
    return made.unionByName(unmatched.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(prefix + c) for c in values)))


def _carried(left: DataFrame, right: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, _span and _last (the latest right row of the spans before) of each span with left rows."""
    own = right.groupBy(*by, "_span").agg(F.max_by(F.struct(*order, "_row"), F.struct(*order)).alias("_own"))
    asked = left.groupBy(*by, "_span").agg(F.lit(True).alias("_asked"))
    spans = own.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_own", F.lit(None).cast(own.schema["_own"].dataType)))
    spans = spans.groupBy(*by, "_span").agg(F.max("_asked").alias("_asked"), F.first("_own", ignorenulls=True).alias("_own"))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_last", F.last("_own", ignorenulls=True).over(before)).filter(F.col("_asked") & F.col("_last").isNotNull())
