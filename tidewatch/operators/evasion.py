"""Moderation evasion and hidden presence: interval joins with the platform's feeds. Without a feed there is no claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import EvasionConfig
from tidewatch.functions import math as M
from tidewatch.operators.spam import is_content
from tidewatch.operators.windows import signal, trailing_sum


def feed_status(feed: DataFrame | None) -> str:
    return "insufficient" if feed is None else "ok"


def with_feed_status(rows: DataFrame, feed: DataFrame | None) -> DataFrame:
    """Adds status to results: whether the feed that they rest on was there at all."""
    return rows.withColumn("status", F.lit(feed_status(feed)))


def post_moderation(events: DataFrame, restrictions: DataFrame, c: EvasionConfig) -> DataFrame:
    """Content strictly after a restriction, inside its window and before it expires, in its room or any if it names none.
    Of several the first in feed order counts. Joined by user and time bucket, so one user's long history stays apart."""
    width = c.post_moderation_window_ms
    content = events.filter(is_content()).withColumn("bucket", F.floor(F.col("at_ms") / width))
    feed = restrictions.select(
        "user_id", "applied_ms", "kind", F.col("room_id").alias("r_room"), "expires_ms", "feed_seq",
        F.explode(F.array(F.floor(F.col("applied_ms") / width), F.floor(F.col("applied_ms") / width) + 1)).alias("bucket"),
    )
    late = F.col("at_ms") - F.col("applied_ms")
    inside = (late > 0) & (late <= width) & (F.col("expires_ms").isNull() | (F.col("at_ms") < F.col("expires_ms"))) & (F.col("r_room").isNull() | (F.col("r_room") == F.col("room_id")))
    found = content.join(feed, ["user_id", "bucket"]).filter(inside)
    first = found.groupBy("user_id", "room_id", "event_id", "at_ms", "seq").agg(F.min_by(F.struct("applied_ms", "kind", "feed_seq"), "feed_seq").alias("r"))
    return signal(first, "EVASION_POST_MODERATION_ACTIVITY", F.lit(True), "HIGH", 0.85, {"after_ms": F.col("at_ms") - F.col("r.applied_ms")})


def with_rejoins(events: DataFrame, c: EvasionConfig) -> DataFrame:
    """Adds n_rejoins: joins and leaves of a user in one room; the current join counts, the current leave doesn't."""
    keys, width = ["user_id", "room_id"], c.rejoin_window_ms
    of = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0)
    return events.withColumn("n_rejoins", F.least(trailing_sum(of("join"), width, keys), trailing_sum(of("leave"), width, keys) - of("leave")))


def rejoin_cycling(events: DataFrame, c: EvasionConfig) -> DataFrame:
    """events: with_rejoins or without."""
    rows, n = events if "n_rejoins" in events.columns else with_rejoins(events, c), F.col("n_rejoins")
    return signal(rows, "EVASION_REJOIN_CYCLING", n >= c.rejoin_count, "MEDIUM", 0.65 + 0.25 * M.saturate(n, c.rejoin_count, 3 * c.rejoin_count), {"n": n})


def presence_correlation(events: DataFrame, presence: DataFrame, now_ms: Column | int, c: EvasionConfig) -> DataFrame:
    """(user_id, room_id, from_ms, to_ms, n, severity, confidence, evidence_ids): hidden stays with events inside them."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    spans = _spans(presence, now, c)
    found = events.join(spans, ["user_id", "room_id"]).filter(F.col("at_ms").between(F.col("from_ms"), F.col("to_ms")))
    found = found.groupBy("user_id", "room_id", "from_ms", "to_ms").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("event_id")), 1, 20).alias("evidence_ids"))
    found = found.filter(F.col("n") >= c.presence_min_events)
    return found.select("user_id", "room_id", "from_ms", "to_ms", "n", F.lit("LOW").alias("severity"), _presence_confidence(c).alias("confidence"), "evidence_ids")


def _presence_confidence(c: EvasionConfig) -> Column:
    n = F.col("n")
    return M.half_up(F.least(0.5 + 0.4 * M.saturate(n, c.presence_min_events, 5 * c.presence_min_events), F.lit(0.95)), 4)


def _spans(presence: DataFrame, now: Column, c: EvasionConfig) -> DataFrame:
    """(user_id, room_id, from_ms, to_ms, mode): one hidden stay per user and room, from its first record to its last one, or
    until now if that isn't a leave."""
    mode = F.min_by("mode", F.struct("at_ms", "seq")) if "mode" in presence.columns else F.lit(None).cast("string")
    spans = presence.groupBy("user_id", "room_id").agg(mode.alias("mode"), F.min("at_ms").alias("first"), F.max_by("kind", F.struct("at_ms", "seq")).alias("kind"), F.max("at_ms").alias("last"))
    ends = F.when(F.col("kind") == "HIDDEN_LEAVE", F.col("last")).otherwise(now)
    return spans.select("user_id", "room_id", "mode", (F.col("first") - c.presence_tolerance_ms).alias("from_ms"), (ends + c.presence_tolerance_ms).alias("to_ms"))


def presence_signals(events: DataFrame, presence: DataFrame, now_ms: int, c: EvasionConfig) -> DataFrame:
    """The signals of hidden stays, in the signals' schema, at the last event of each; with concealment_mode and, as
    evidence, twenty of the events at most."""
    spans = _spans(presence, F.lit(now_ms), c)
    found = events.join(spans, ["user_id", "room_id"]).filter(F.col("at_ms").between(F.col("from_ms"), F.col("to_ms")))
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("user_id", "room_id").orderBy("at_ms", "seq")))
    by = found.groupBy("user_id", "room_id", "mode").agg(
        F.count("*").alias("n"), F.max(F.struct("at_ms", "seq", "event_id")).alias("last"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 20, F.struct("nth", "event_id")))).alias("ids")
    )
    rows = by.select("user_id", "room_id", "last.*", "n", F.coalesce("mode", F.lit("unspecified")).alias("concealment_mode"), F.transform("ids", lambda x: x["event_id"]).alias("evidence_ids"))
    extra = rows.select(F.col("event_id").alias("_event"), F.col("room_id").alias("_room"), F.col("user_id").alias("_user"), "concealment_mode", "evidence_ids")
    made = signal(rows, "GHOST_HIDDEN_PRESENCE_CORRELATED", F.col("n") >= c.presence_min_events, "LOW", _presence_confidence(c), {"n": F.col("n")})
    same = (F.col("event_id") == F.col("_event")) & (F.col("room_id") == F.col("_room")) & (F.col("user_id") == F.col("_user"))
    return made.join(extra, same).drop("_event", "_room", "_user")


def presence_status(rooms: DataFrame, presence: DataFrame | None, correlated: DataFrame | None) -> DataFrame:
    """(room_id, status, message) of each room: without a feed nothing is claimed; with one, a room without reports, with
    too few events to go with them, or with correlations."""
    if presence is None:
        return rooms.select("room_id").distinct().select("room_id", F.lit("insufficient").alias("status"), F.lit("Insufficient authorized telemetry.").alias("message"))
    reported = presence.select("room_id").distinct().withColumn("reported", F.lit(True))
    found = correlated.select("room_id").distinct().withColumn("found", F.lit(True))
    rows = rooms.select("room_id").distinct().join(reported, "room_id", "left").join(found, "room_id", "left")
    status = F.when(F.col("found"), "found").when(F.col("reported"), "too_few_events").otherwise("none_reported")
    message = F.when(F.col("found"), "Potential hidden activity detected").otherwise("No hidden activity reported.")
    return rows.select("room_id", status.alias("status"), message.alias("message"))
