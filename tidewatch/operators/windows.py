"""Sums over a user's trailing window that see just what a one-by-one reader would have seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIRST, LAST = W.unboundedPreceding, W.unboundedFollowing


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def trailing_sum(value: Column, width_ms: int, keys: list[str], cap: int | None = None, cap_keys: list[str] | None = None) -> Column:
    """Sum over [now - width, now] of events up to this one, without later ones of the same millisecond. With a cap, never more than over
    the last ``cap`` events and this one (right for sums of non-negative values). Values are whole numbers: each sum is a running one
    less what has left the window, both read once, so that an event's cost doesn't grow with those in its window."""
    by_time, total = W.partitionBy(*keys).orderBy("at_ms"), lambda w: F.coalesce(F.sum(value).over(w), F.lit(0))
    row_of = lambda ks: W.partitionBy(*ks).orderBy("at_ms", "seq")
    # events without a time come first and have all before them in their window
    gone = F.when(F.col("at_ms").isNull(), F.lit(0)).otherwise(total(by_time.rangeBetween(FIRST, -width_ms - 1)))
    out = total(row_of(keys).rowsBetween(FIRST, 0)) - gone
    if cap:
        rows = row_of(cap_keys or keys)
        out = F.least(out, total(rows.rowsBetween(FIRST, 0)) - total(rows.rowsBetween(FIRST, -cap - 1)))
    return out


def trailing_list(value: Column, keys: list[str], rows: int) -> Column:
    """Values of the last rows events and this one, in time order; nulls left out."""
    return F.collect_list(value).over(W.partitionBy(*keys).orderBy("at_ms", "seq").rowsBetween(-rows, 0))


def signal(df: DataFrame, code: str, fires: Column, severity: Column | str, confidence: Column | float, detail: dict[str, Column] | None = None) -> DataFrame:
    """Rows of the signals table from the rows that fire; detail is kept as a map of numbers."""
    from tidewatch.config import SIGNALS
    from tidewatch.functions.math import half_up

    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    s = severity if isinstance(severity, Column) else F.lit(severity)
    pairs = [x for k, v in (detail or {}).items() for x in (F.lit(k), v.cast("double"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return df.filter(fires).select(
        "user_id", "room_id", "event_id", "at_ms", "seq", F.lit(code).alias("code"), F.lit(SIGNALS[code][0]).alias("category"), s.alias("severity"), half_up(c, 4).alias("confidence"), details.alias("details")
    )
