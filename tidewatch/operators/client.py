"""Client integrity: versions, platforms, impossible sequences and request rates of a user."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import MINUTE, ClientConfig
from tidewatch.functions import math as M
from tidewatch.operators.spam import is_content
from tidewatch.operators.windows import FIRST, free_name, signal, trailing_sum


def with_distinct(events: DataFrame, value: Column, width_ms: int, out: str) -> DataFrame:
    """Adds how many different values a user's events of the last width_ms have, those of the same millisecond included. A value is
    there from its first event until width_ms after the last one that no further one follows in time: the stays that have begun,
    less those that have ended, both running sums along the user's time, so that no row carries a set."""
    v, begin, end = free_name(events, "value"), free_name(events, "begin"), free_name(events, "end")
    by, time = W.partitionBy("user_id", v).orderBy("at_ms", "seq"), W.partitionBy("user_id").orderBy("at_ms")
    rows = events.withColumn(v, value)
    before, after = F.lag("at_ms").over(by), F.lead("at_ms").over(by)
    begins = F.col(v).isNotNull() & (before.isNull() | (F.col("at_ms") - before > width_ms))
    ends = F.col(v).isNotNull() & F.col("at_ms").isNotNull() & (after.isNull() | (after - F.col("at_ms") > width_ms))
    rows = rows.withColumns({begin: F.when(begins, 1).otherwise(0), end: F.when(ends, 1).otherwise(0)})
    begun, ended = F.sum(begin).over(time.rangeBetween(FIRST, 0)), F.sum(end).over(time.rangeBetween(FIRST, -width_ms - 1))
    return rows.withColumn(out, begun - F.coalesce(ended, F.lit(0))).drop(v, begin, end)


def with_counts(events: DataFrame, horizon_ms: int) -> DataFrame:
    """Adds n_events: the user's events in the horizon."""
    return events.withColumn("n_events", trailing_sum(F.lit(1), horizon_ms, ["user_id"]))


def with_marks(events: DataFrame, c: ClientConfig, horizon_ms: int) -> DataFrame:
    """Adds all that the detectors of clients count, in one pass over each user's time; what is there already stays."""
    made = {
        "n_events": lambda x: with_counts(x, horizon_ms), "n_versions": lambda x: with_versions(x, c, horizon_ms), "n_platforms": lambda x: with_platforms(x, horizon_ms),
        "case": lambda x: with_sequence_case(x, c, horizon_ms), "n_requests": with_requests,
    }
    for name, add in made.items():
        events = events if name in events.columns else add(events)
    return events


def with_enough(events: DataFrame, c: ClientConfig, horizon_ms: int, attestations: DataFrame | None = None) -> DataFrame:
    """Adds status: ok, or insufficient where a user shows too few events and has no attestation; and verified."""
    if attestations is None:
        rows = events.withColumn("verified", F.lit(None).cast("boolean"))
    else:
        seen = attestations.groupBy("user_id", F.coalesce("client_version", F.lit("")).alias("v")).agg(F.min("verified").alias("verified"))
        rows = events.withColumn("v", F.coalesce("client_version", F.lit(""))).join(seen, ["user_id", "v"], "left").drop("v")
    if "n_events" not in rows.columns:
        rows = with_counts(rows, horizon_ms)
    return rows.withColumn("status", F.when((F.col("n_events") >= c.min_telemetry_events) | F.col("verified").isNotNull(), "ok").otherwise("insufficient"))


def unknown_version(events: DataFrame, c: ClientConfig) -> DataFrame:
    v = F.col("client_version")
    none, odd = v.isNull() & F.lit(bool(c.known_versions)), v.isNotNull() & ~v.rlike(c.version_pattern)
    new = v.isNotNull() & ~v.isin(*c.known_versions) if c.known_versions else F.lit(False)
    confidence = F.when(none, 0.45).when(odd, 0.75).otherwise(0.55)
    return signal(events, "CLIENT_UNKNOWN_VERSION", none | odd | new, F.when(odd, "MEDIUM").otherwise("LOW"), confidence)


def with_versions(events: DataFrame, c: ClientConfig, horizon_ms: int) -> DataFrame:
    """Adds n_versions: how many client versions the user has shown of late."""
    return with_distinct(events, F.col("client_version"), min(c.version_flap_window_ms, horizon_ms), "n_versions")


def version_flapping(events: DataFrame, c: ClientConfig, horizon_ms: int) -> DataFrame:
    """events: with_versions or without."""
    rows, n = events if "n_versions" in events.columns else with_versions(events, c, horizon_ms), F.col("n_versions")
    return signal(rows, "CLIENT_VERSION_FLAPPING", n >= c.version_flap_count, "MEDIUM", 0.7 + 0.2 * M.saturate(n, c.version_flap_count, 2 * c.version_flap_count), {"n": n})


def with_platforms(events: DataFrame, horizon_ms: int) -> DataFrame:
    """Adds n_platforms: how many known platforms the user has shown of late."""
    return with_distinct(events, F.when(F.col("platform") != "unknown", F.col("platform")), horizon_ms, "n_platforms")


def platform_mismatch(events: DataFrame, c: ClientConfig, horizon_ms: int) -> DataFrame:
    """events: with_platforms or without."""
    rows, n = events if "n_platforms" in events.columns else with_platforms(events, horizon_ms), F.col("n_platforms")
    vague = (F.col("platform") == "unknown") & F.lit(bool(c.known_versions))
    return signal(rows, "CLIENT_PLATFORM_MISMATCH", (n > 1) | vague, F.when(n > 1, "MEDIUM").otherwise("LOW"), F.when(n > 1, 0.65).otherwise(0.4), {"n": n})


def with_sequence_case(events: DataFrame, c: ClientConfig, horizon_ms: int) -> DataFrame:
    """Adds case: content after the own leave (1), a join after a join (2), or voice in two rooms at once (3); the first that holds."""
    moves = F.col("event_type").isin("join", "leave")
    before = W.partitionBy("user_id", "room_id").orderBy("at_ms", "seq").rowsBetween(FIRST, -1)
    last = F.last(F.when(moves, F.struct("event_type", "at_ms")), ignorenulls=True).over(before)
    rows = with_distinct(events.withColumn("last", last), F.when(F.col("event_type") == "voice", F.col("room_id")), c.voice_window_ms, "voice_rooms")
    gap = F.col("at_ms") - F.col("last.at_ms")
    fresh = gap <= horizon_ms
    case = (
        F.when(is_content() & (F.col("last.event_type") == "leave") & fresh & (gap > c.leave_grace_ms), 1)
        .when((F.col("event_type") == "join") & (F.col("last.event_type") == "join") & fresh & (gap > c.join_grace_ms), 2)
        .when(F.col("voice_rooms") > 1, 3)
    )
    return rows.withColumn("case", case).drop("voice_rooms", "last")


def impossible_sequence(events: DataFrame, c: ClientConfig, horizon_ms: int) -> DataFrame:
    """events: with_sequence_case or without."""
    rows = events if "case" in events.columns else with_sequence_case(events, c, horizon_ms)
    return signal(rows, "CLIENT_IMPOSSIBLE_SEQUENCE", F.col("case").isNotNull(), "HIGH", 0.85, {"case": F.col("case")})


def malformed_requests(events: DataFrame, rejects: DataFrame, c: ClientConfig) -> DataFrame:
    """Events of users whose rejected requests (user_id, at_ms, seq) pile up: counted as of each event, without a join."""
    both = events.select("user_id", "room_id", "event_id", "at_ms", "seq", F.lit(0).alias("bad")).unionByName(
        rejects.select("user_id", F.lit(None).cast("string").alias("room_id"), F.lit(None).cast("string").alias("event_id"), "at_ms", "seq", F.lit(1).alias("bad"))
    )
    rows = both.withColumn("n", trailing_sum(F.col("bad"), c.malformed_window_ms, ["user_id"])).filter("bad = 0")
    return signal(rows, "CLIENT_MALFORMED_REQUESTS", F.col("n") >= c.malformed_count, "MEDIUM", 0.7 + 0.2 * M.saturate(F.col("n"), c.malformed_count, 4 * c.malformed_count), {"n": F.col("n")})


def with_requests(events: DataFrame, width_ms: int = MINUTE) -> DataFrame:
    """Adds n_requests: the user's events of the last width_ms."""
    return events.withColumn("n_requests", trailing_sum(F.lit(1), width_ms, ["user_id"]))


def abnormal_rate(events: DataFrame, c: ClientConfig, width_ms: int = MINUTE) -> DataFrame:
    """events: with_requests of the same width, or without."""
    rows, n = events if "n_requests" in events.columns else with_requests(events, width_ms), F.col("n_requests")
    return signal(rows, "CLIENT_ABNORMAL_REQUEST_RATE", n > c.abnormal_requests_per_minute, "HIGH", 0.75, {"n": n})


def attestation_failed(events: DataFrame) -> DataFrame:
    """events: with verified; no verdict is not a failed one."""
    return signal(events, "CLIENT_ATTESTATION_FAILED", ~F.col("verified"), "HIGH", 0.9)


def all_signals(events: DataFrame, c: ClientConfig, horizon_ms: int, attestations: DataFrame | None = None, rejects: DataFrame | None = None) -> DataFrame:
    # windows look over all events, also those that make no claim themselves
    gated = with_enough(with_marks(events, c, horizon_ms), c, horizon_ms, attestations)
    ok = gated.filter("status = 'ok'").select("event_id")
    gated = gated.filter("status = 'ok'")
    parts = [unknown_version(gated, c), version_flapping(gated, c, horizon_ms), platform_mismatch(gated, c, horizon_ms), impossible_sequence(gated, c, horizon_ms), abnormal_rate(gated, c)]
    if rejects is not None:
        parts.append(malformed_requests(events, rejects, c).join(ok, "event_id", "left_semi"))
    if attestations is not None:
        parts.append(attestation_failed(gated))
    return reduce(DataFrame.unionByName, parts)


def client_risk(signals: DataFrame, gated: DataFrame, c: ClientConfig) -> DataFrame:
    """(event_id, client_risk 0..100, confidence, indicators) for each event that may be judged."""
    weights = F.create_map(*(F.lit(x) for pair in c.indicator_weights.items() for x in (pair[0], float(pair[1]))))
    own = signals.filter("category = 'CLIENT'").groupBy("event_id").agg(F.sum(F.coalesce(F.try_element_at(weights, "code"), F.lit(10.0)) * F.col("confidence")).alias("raw"), F.array_sort(F.collect_set("code")).alias("indicators"))
    rows = gated.filter("status = 'ok'").join(own, "event_id", "left")
    confidence = 0.25 + 0.5 * M.saturate(F.col("n_events"), 5, 40) + F.when(F.col("verified").isNotNull(), 0.35).otherwise(0.0)
    return rows.select("event_id", "user_id", M.half_up(M.clamp(F.coalesce("raw", F.lit(0.0)), 0, 100)).cast("int").alias("client_risk"), M.half_up(M.clamp(confidence, 0, 1), 4).alias("confidence"), F.coalesce("indicators", F.array().cast("array<string>")).alias("indicators"))
