"""Rate budgets and counters over a request log (key, at_ms, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.windows import trailing_sum


def fixed_window(log: DataFrame, limit: int, width_ms: int, key: str = "key") -> DataFrame:
    """Adds hit, allowed, remaining and retry_s of a budget that starts anew with every window."""
    start = F.floor(F.col("at_ms") / width_ms) * width_ms
    hit = F.row_number().over(W.partitionBy(key, "window_ms").orderBy("at_ms", "seq"))
    rows = log.withColumn("window_ms", start).withColumn("hit", hit)
    return rows.withColumns({"allowed": F.col("hit") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("hit"), F.lit(0)), "retry_s": F.when(F.col("hit") > limit, F.ceil((F.col("window_ms") + width_ms - F.col("at_ms")) / 1000)).otherwise(0)})


def recent_count(log: DataFrame, width_ms: int, key: str = "key", bucketed: bool = False) -> DataFrame:
    """Adds n: requests in the trailing window, or in aligned buckets that the window touches."""
    if not bucketed:
        return log.withColumn("n", trailing_sum(F.lit(1), width_ms, [key]))
    minute = 60_000
    rows = log.withColumn("bucket", F.floor(F.col("at_ms") / minute))
    seen = F.count("*").over(W.partitionBy(key).orderBy("bucket").rangeBetween(-(width_ms // minute), 0))
    return rows.withColumn("n", seen).drop("bucket")
