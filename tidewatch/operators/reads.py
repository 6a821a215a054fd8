"""Dashboard questions: top rows, counters and profiles, for any number of users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import LEVELS, RiskConfig
from tidewatch.functions import hashing as H
from tidewatch.operators.risk import range_label


def newest(rows: DataFrame, limit: int = 50, where: Column | None = None, at: str = "at_ms", tie: str = "seq", most: int = 200) -> DataFrame:
    """The newest rows, of a user, a room or all: a true top-k."""
    rows = rows if where is None else rows.filter(where)
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(min(limit, most))


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def incidents_where(incidents: DataFrame, status: str | None = None, user_id: str | None = None, room_id: str | None = None, since_ms: int | None = None, limit: int = 50) -> DataFrame:
    for column, value in (("status", status), ("user_id", user_id), ("room_id", room_id)):
        incidents = incidents if value is None else incidents.filter(F.col(column) == value)
    incidents = incidents if since_ms is None else incidents.filter(F.col("updated_ms") >= since_ms)
    return incidents.orderBy(F.desc("updated_ms"), "incident_id").limit(limit)


def audit_where(audit: DataFrame, since_ms: int | None = None, actor_id: str | None = None, limit: int = 100) -> DataFrame:
    audit = audit if since_ms is None else audit.filter(F.col("at_ms") >= since_ms)
    audit = audit if actor_id is None else audit.filter(F.col("actor_id") == actor_id)
    return audit.orderBy(F.desc("at_ms"), "audit_id").limit(limit)


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("status").isin("OPEN", "ACKNOWLEDGED")).groupBy("user_id").agg(F.count("*").alias("open_incidents"))


def high_risk_users(latest: DataFrame, incidents: DataFrame, events: DataFrame, limit: int = 20) -> DataFrame:
    seen = events.groupBy("user_id").agg(F.max("at_ms").alias("last_seen_ms"))
    rows = latest.join(open_incidents(incidents), "user_id", "left").join(seen, "user_id", "left")
    rows = rows.withColumn("open_incidents", F.coalesce("open_incidents", F.lit(0))).withColumn("handle", H.handle(F.col("user_id")))
    return rows.orderBy(F.desc("score"), "user_id").limit(limit)


def user_profiles(users: DataFrame, events: DataFrame, signals: DataFrame, latest: DataFrame, incidents: DataFrame, window_ms: int, c: RiskConfig, events_kept: int = 25) -> DataFrame:
    """For many users together: assessment with range, rate at the last event, abuse signals, last events and counts."""
    own = events.join(users.select("user_id").distinct(), "user_id", "left_semi")
    back = own.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("at_ms"), F.desc("seq"))))
    end = F.max("at_ms").over(W.partitionBy("user_id"))
    counts = back.withColumn("end", end).groupBy("user_id").agg(
        F.count("*").alias("events"), F.max("at_ms").alias("last_seen_ms"), F.count_if(F.col("at_ms") >= F.col("end") - window_ms).alias("rate"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= events_kept, F.struct("at_ms", "seq", "event_id")))).alias("recent"),
        F.max_by("client_version", F.struct("at_ms", "seq")).alias("client_version"), F.max_by("platform", F.struct("at_ms", "seq")).alias("platform"),
    )
    abuse = signals.filter(F.col("category").isin("ABUSE", "THREAT")).groupBy("user_id").agg(F.count("*").alias("abuse_signals"))
    rows = counts.join(abuse, "user_id", "left").join(latest.select("user_id", "score", "level"), "user_id", "left").join(open_incidents(incidents), "user_id", "left")
    rows = rows.withColumns({"recent": F.transform("recent", lambda x: x["event_id"]), "range": range_label(F.coalesce("level", F.lit("LOW")), c)})
    return rows.fillna(0, ["abuse_signals", "score", "open_incidents"]).fillna("LOW", ["level"])


def overview(incidents: DataFrame, latest: DataFrame, signals: DataFrame, actions: DataFrame) -> DataFrame:
    """(counter, n): open incidents, high-risk users, spam and abuse signals, effective blocks."""
    one = lambda df, name, cond: df.agg(F.count_if(cond).alias("n")).select(F.lit(name).alias("counter"), "n")
    parts = [
        one(incidents, "open_incidents", F.col("status").isin("OPEN", "ACKNOWLEDGED")),
        one(latest, "high_risk_users", F.col("level").isin("HIGH", "CRITICAL")),
        one(signals, "spam_signals", F.col("category").isin("SPAM", "FREQUENCY", "COORDINATION")),
        one(signals, "abuse_signals", F.col("category").isin("ABUSE", "THREAT")),
        one(actions, "effective_blocks", (F.col("action_type") == "PLATFORM_TEMPORARY_BLOCK") & F.col("succeeded")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def risk_distribution(latest: DataFrame, c: RiskConfig) -> DataFrame:
    levels = latest.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    by = latest.groupBy("level").agg(F.count("*").alias("n"))
    return levels.join(by, "level", "left").select("level", range_label(F.col("level"), c).alias("range"), F.coalesce("n", F.lit(0)).alias("n"))


def top_signals(signals: DataFrame, limit: int = 8) -> DataFrame:
    return signals.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(limit)


def recent_incidents(incidents: DataFrame, limit: int = 10) -> DataFrame:
    rows = incidents.orderBy(F.desc("updated_ms"), "incident_id").limit(limit)
    return rows.select("incident_id", "user_id", "risk_score", "risk_level", "updated_ms", F.slice("behaviors", 1, 4).alias("behaviors"))


def strongest(signals: DataFrame, limit: int = 20) -> DataFrame:
    return signals.orderBy(F.desc("confidence"), F.desc("at_ms"), "event_id", "code").limit(limit)
