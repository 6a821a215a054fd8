"""The operators as streams: dedupe, per-user scoring with state, sweeps, and incident sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Config, RiskConfig
from tidewatch.operators import client, evasion, spam
from tidewatch.operators.risk import History
from tidewatch.sources.shared import materialise, working_tables
from tidewatch.sources.sinks import existing, with_day

LATE = "10 minutes"


def with_time(events: DataFrame, late: str = LATE) -> DataFrame:
    """Adds ts and the watermark: what comes later than this is dropped and counted by Spark."""
    return events.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)


def dedupe(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def sweep(events: DataFrame, c: Config) -> DataFrame:
    """Tumbling sweeps: texts that several accounts sent into a room. events: with ts and fp."""
    said = events.filter(F.col("event_type").isin("message", "voice") & (F.length("fp") >= c.spam.coordination_min_length))
    window = F.window("ts", f"{c.coordination.sweep_ms} milliseconds")
    found = said.groupBy(window, "room_id", "fp").agg(F.array_sort(F.collect_set("user_id")).alias("user_ids"))
    return found.filter(F.size("user_ids") >= c.coordination.min_accounts).select(F.unix_millis("window.start").alias("sweep_ms"), "room_id", "fp", F.size("user_ids").alias("n"), "user_ids")


def incident_sessions(serious: DataFrame, c: Config) -> DataFrame:
    """Sessions of a user's serious events in a room. serious: with ts."""
    gap = F.session_window("ts", f"{c.case.incident_gap_ms} milliseconds")
    return serious.groupBy(gap, "user_id", "room_id").agg(F.min("at_ms").alias("created_ms"), F.max("at_ms").alias("updated_ms"), F.count("*").alias("n_events"), F.max("score").alias("risk_score"))


STATE = "carried double, violations int, evasions int, last long"
SCORED = "user_id string, event_id string, at_ms long, seq long, score int, level string, history double, repeat_bonus double, violations int, evasions int"


def user_history(narrow: DataFrame, c: RiskConfig) -> DataFrame:
    """The batch fold as a stream: the same step, its state kept by Spark. Rows of a micro-batch are put in time order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        own = History(c)
        if state.exists:
            carried, violations, evasions, last = state.get
            own = History(c, carried, violations, evasions, None if last is None or last < 0 else last)
        rows = pd.concat(list(frames)).sort_values(["at_ms", "seq"])
        out = []
        for r in rows.itertuples(index=False):
            score, level, past, bonus = own.step(r.at_ms, r.signal_total, r.n_contributions, r.severe, r.evading)
            out.append((key[0], r.event_id, r.at_ms, r.seq, score, level, int(past * 100 + 0.5) / 100, bonus, own.violations, own.evasions))
        carried, violations, evasions, last = own.state()
        state.update((carried, violations, evasions, -1 if last is None else int(last)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SCORED.split(", ")])

    return narrow.groupBy("user_id").applyInPandasWithState(step, SCORED, STATE, "append", "NoTimeout")


def with_restrictions(events: DataFrame, restrictions: DataFrame, window_ms: int) -> DataFrame:
    """Stream-static interval join: content shortly after a restriction of its user."""
    feed = restrictions.select(F.col("user_id").alias("r_user"), "applied_ms", F.col("room_id").alias("r_room"), "expires_ms")
    late = F.col("at_ms") - F.col("applied_ms")
    inside = (F.col("user_id") == F.col("r_user")) & (late > 0) & (late <= window_ms) & (F.col("expires_ms").isNull() | (F.col("at_ms") < F.col("expires_ms"))) & (F.col("r_room").isNull() | (F.col("r_room") == F.col("room_id")))
    return events.filter(F.col("event_type").isin("message", "voice")).join(feed, inside)


def user_detectors(c: Config) -> Callable[[DataFrame], DataFrame]:
    """All spam, client and rejoin detectors of the batch library; each looks back along one user's events alone."""

    def detect(events: DataFrame) -> DataFrame:
        parts = [spam.all_signals(events, c.spam), client.all_signals(events, c.client, c.spam.horizon_ms), evasion.rejoin_cycling(events, c.evasion)]
        return reduce(DataFrame.unionByName, parts)

    return detect


def detect_batches(folder: str, detect: Callable[[DataFrame], DataFrame], horizon_ms: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: runs batch detectors on a stream. Each micro-batch is judged together with what its users did in the
    horizon before it, which is read from the event table that this keeps (by day, and only those days), and the signals of
    its own events are written. A batch that is written again replaces itself. What detectors may look back on is all in the
    horizon, so signals are those of one batch over everything, as long as events come in time order between batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with working_tables(spark):
            own = materialise(with_day(batch.withColumn("batch_id", F.lit(batch_id))), "stream-batch")
            low = own.agg(F.min("at_ms")).first()[0]
            if low is None:
                return
            since = F.date_format(F.timestamp_millis(F.lit(low - horizon_ms)), "yyyy-MM-dd")
            before = existing(spark, f"{folder}/events", own).filter((F.col("dt") >= since) & (F.col("at_ms") >= low - horizon_ms) & (F.col("batch_id") < batch_id))
            known = before.join(own.select("user_id").distinct(), "user_id", "left_semi")
            found = detect(known.select(*own.columns).unionByName(own).drop("batch_id", "dt"))
            found = found.join(own.select("event_id"), "event_id", "left_semi").withColumn("batch_id", F.lit(batch_id))
            replace = lambda rows, name, *by: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/{name}")
            replace(found, "signals", "batch_id")
            replace(own, "events", "dt", "batch_id")

    return write


SIGNAL_KEY = ["user_id", "room_id", "event_id", "at_ms", "seq", "code", "category", "severity", "confidence", "detail"]


def current_signals(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The signals that stand after all changes: what was added and not taken back. before: only batches up to this one."""
    changes = spark.read.parquet(f"{folder}/changes")
    changes = changes if before is None else changes.filter(F.col("batch_id") < before)
    return changes.groupBy("dt", *SIGNAL_KEY).agg(F.sum("change").alias("n")).filter("n > 0").drop("n")


def revise_batches(folder: str, detect: Callable[[DataFrame], DataFrame], horizon_ms: int, late_ms: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: batch detectors on a stream in any order of arrival. A late row reopens its user's horizon alone: the
    user's events from the earliest new one to a horizon past the latest are judged again, with a horizon before them for
    their windows, and the table ``changes`` gets +1 for each signal that is new and -1 for each that no longer holds; current_signals()
    nets them. Rows more than late_ms behind the newest stored event are left out and kept in ``dropped``; ids that are stored
    already are left out as well. Everything is read from batches before this one and written by batch, so a batch that is
    written again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = lambda name, like: existing(spark, f"{folder}/{name}", like).filter(F.col("batch_id") < batch_id)
        replace = lambda rows, name, *by: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/{name}")
        with working_tables(spark):
            own = materialise(with_day(batch.withColumn("batch_id", F.lit(batch_id))).dropDuplicates(["event_id"]), "stream-batch")
            newest = earlier("events", own).agg(F.max("at_ms")).first()[0]  # of Parquet statistics, not of rows
            bound = None if newest is None else newest - late_ms
            if bound is not None:
                replace(own.filter(F.col("at_ms") < bound), "dropped", "batch_id")
                own = own.filter(F.col("at_ms") >= bound)
            span = own.agg(F.min("at_ms"), F.max("at_ms")).first()
            if span[0] is None:
                return
            day = lambda ms: F.date_format(F.timestamp_millis(F.lit(ms)), "yyyy-MM-dd")
            reopened = own.groupBy("user_id").agg(F.min("at_ms").alias("low"), (F.max("at_ms") + horizon_ms).alias("high"))
            reopened = materialise(reopened, "reopened")
            around = earlier("events", own).filter(F.col("dt").between(day(span[0] - horizon_ms), day(span[1] + horizon_ms)))
            known = around.join(reopened, "user_id").filter(F.col("at_ms").between(F.col("low") - horizon_ms, F.col("high"))).select(*own.columns)
            known = materialise(known, "horizon")
            own = own.join(known.select("event_id"), "event_id", "left_anti")
            found = detect(known.unionByName(own.select(*known.columns)).drop("batch_id", "dt"))
            found = with_day(found.withColumn("detail", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("details"))))))
            inside = lambda rows: rows.join(reopened, "user_id").filter(F.col("at_ms").between(F.col("low"), F.col("high"))).select("dt", *SIGNAL_KEY)
            now = inside(found).withColumn("change", F.lit(1))
            like = now.withColumn("batch_id", F.lit(batch_id))
            stood = earlier("changes", like.select("change", *SIGNAL_KEY, "dt", "batch_id")).filter(F.col("dt").between(day(span[0]), day(span[1] + horizon_ms)))
            stood = stood.groupBy("dt", *SIGNAL_KEY).agg(F.sum("change").alias("n")).filter("n > 0")
            both = now.unionByName(inside(stood).withColumn("change", F.lit(-1)))
            changed = both.groupBy("dt", *SIGNAL_KEY).agg(F.sum("change").cast("int").alias("change")).filter("change <> 0").withColumn("batch_id", F.lit(batch_id))
            changed = materialise(changed, "changes")
            replace(own, "events", "dt", "batch_id")
            replace(changed, "changes", "dt", "batch_id")

    return write
