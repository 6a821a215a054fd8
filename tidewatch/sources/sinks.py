"""Sinks: append-only tables of Parquet by day, idempotent by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expiry_stamp(at_ms: Column, days: int) -> Column:
    """Seconds at which a row may go."""
    return F.floor((at_ms + F.lit(days * 86_400_000)) / 1000).cast("long")


def with_day(rows: DataFrame, at: str = "at_ms") -> DataFrame:
    return rows.withColumn("dt", F.date_format(F.timestamp_millis(F.col(at)), "yyyy-MM-dd"))


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, or none of its rows if there is no table yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        return like.limit(0)


def append_new(rows: DataFrame, path: str, keys: list[str], at: str = "at_ms", refuse: bool = False) -> tuple[int, int]:
    """Appends rows whose keys aren't there yet; returns (written, duplicates). Only days that the new rows touch are
    looked up. With refuse, a key that is there raises, and nothing is written."""
    spark = rows.sparkSession
    rows = with_day(rows, at).dropDuplicates(keys).persist()
    try:
        total = rows.count()
        if not total:
            return 0, 0
        days = [r["dt"] for r in rows.select("dt").distinct().collect()]
        known = existing(spark, path, rows).filter(F.col("dt").isin(days)).select(*keys)
        if refuse and not rows.join(known, keys, "left_semi").isEmpty():
            raise ValueError(f"{path} holds one of these keys already and is written once only")
        new = rows.join(known, keys, "left_anti").persist()
        n = new.count()
        if n:
            new.repartition("dt").write.mode("append").partitionBy("dt").parquet(path)
        new.unpersist()
        return n, total - n
    finally:
        rows.unpersist()


def event_sink(rows: DataFrame, path: str) -> tuple[int, int]:
    return append_new(rows, path, ["event_id"])


def signal_sink(rows: DataFrame, path: str) -> tuple[int, int]:
    return append_new(rows, path, ["user_id", "at_ms", "code"])


def audit_sink(rows: DataFrame, path: str) -> tuple[int, int]:
    """Append only; an id that is there is refused. There is no way to change or delete a row."""
    return append_new(rows, path, ["audit_id"], refuse=True)


def evidence_sink(rows: DataFrame, path: str) -> tuple[int, int]:
    return append_new(rows, path, ["key"], at="created_ms", refuse=True)


def action_sink(rows: DataFrame, path: str) -> tuple[int, int]:
    return append_new(rows, path, ["target_user_id", "at_ms", "action_type"])


def upsert(rows: DataFrame, path: str, key: str, at: str) -> None:
    """Writes the latest row of each key, equal times settled by the rows' contents; only the days of the keys that change are rewritten. A day that loses its last row
    is deleted after the others are written, since an overwrite leaves days alone that have no row any more. Readers between the two steps see both; where that matters,
    snapshots.Snapshots has commits."""
    from tidewatch.sources.shared import delete, materialise

    spark = rows.sparkSession
    tie = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))
    latest = F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc(), tie.desc()))
    rows = materialise(with_day(rows.withColumn("_nth", latest).filter("_nth = 1").drop("_nth"), at), "upsert-rows")
    old = existing(spark, path, rows)
    moved = old.join(rows.select(key).distinct(), key, "left_semi").select("dt").unionByName(rows.select("dt")).distinct()
    kept = old.join(moved, "dt", "left_semi").join(rows.select(key).distinct(), key, "left_anti")
    fresh = materialise(kept.unionByName(rows), "upsert")
    days = materialise(moved, "upsert-days")
    stale = [r["dt"] for r in days.join(fresh.select("dt").distinct(), "dt", "left_anti").collect()]  # days, not rows
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    delete(spark, *(f"{path}/dt={day}" for day in stale))


def fan_out(feeds: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one table for each published feed; a batch that is written again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, of in feeds.items():
            of(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/{name}")
        batch.unpersist()

    return write
