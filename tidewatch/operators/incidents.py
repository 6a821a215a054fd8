"""Incidents: a user's serious events in a room, folded while they follow each other closely."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import CaseConfig
from tidewatch.functions import hashing as H
from tidewatch.functions import math as M
from tidewatch.functions import text as T
from tidewatch.operators.windows import FIRST

#: Version of the rules and weights, as incidents name it.
VERSION = "1"
CLOSED = ("RESOLVED", "DISMISSED", "FALSE_POSITIVE")


def sessions(events: DataFrame, c: CaseConfig, reviews: DataFrame | None = None) -> DataFrame:
    """Adds incident_id: events of one user and room whose gaps are at most the limit. A closing review in a gap ends the
    incident. reviews: user_id, room_id, at_ms, status."""
    keys = ["user_id", "room_id"]
    rows = events.withColumn("closing", F.lit(0))
    if reviews is not None:
        ends = reviews.filter(F.col("status").isin(*CLOSED)).select("user_id", "room_id", "at_ms", F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("closing"))
        rows = rows.unionByName(ends, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("at_ms", "closing", "seq")
    last = F.last(F.when(F.col("closing") == 0, F.col("at_ms")), ignorenulls=True).over(w.rowsBetween(FIRST, -1))
    shut = F.coalesce(F.lag("closing").over(w), F.lit(0)) == 1
    opens = (F.col("closing") == 0) & (last.isNull() | shut | (F.col("at_ms") - last > c.incident_gap_ms))
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("start_ms", F.last(F.when(F.col("opens"), F.col("at_ms")), ignorenulls=True).over(w.rowsBetween(FIRST, 0)))
    return rows.filter("closing = 0").withColumn("incident_id", H.incident_id(F.col("user_id"), F.col("room_id"), F.col("start_ms"))).drop("closing")


LIFECYCLE = "incident_id string, user_id string, room_id string, at_ms long, seq long, change string, status string, risk_score int, risk_level string"


class Case:
    """The incident of a user in a room that is current, as events and reviews fold into it."""

    def __init__(self, gap_ms: int):
        self.gap_ms, self.start, self.updated, self.status, self.score, self.level = gap_ms, None, 0, "", 0, ""

    def event(self, at_ms: int, score: int, level: str) -> str:
        """Folds a serious event in: OPENED, UPDATED, ESCALATED (a new peak) or REOPENED (a new peak of an acknowledged one)."""
        if self.start is None or self.status not in ("OPEN", "ACKNOWLEDGED") or at_ms - self.updated > self.gap_ms:
            self.start, self.updated, self.status, self.score, self.level = at_ms, at_ms, "OPEN", score, level
            return "OPENED"
        self.updated, change = at_ms, "UPDATED"
        if score > self.score:
            self.score, self.level = score, level
            change = "REOPENED" if self.status == "ACKNOWLEDGED" else "ESCALATED"
            self.status = "OPEN"
        return change

    def review(self, status: str) -> str | None:
        """A moderator's word on the current incident; none if there is none, or it says so already or is closed."""
        if self.start is None or self.status in CLOSED or status == self.status:
            return None
        self.status = status
        return status if status in ("ACKNOWLEDGED", "OPEN") else "CLOSED"


def lifecycle(serious: DataFrame, reviews: DataFrame, c: CaseConfig) -> DataFrame:
    """Every change of every incident (LIFECYCLE). serious: user_id, room_id, at_ms, seq, score, level; reviews: user_id, room_id, at_ms,
    status, and note, which has to have eight characters. A review of the same millisecond comes after the events. What an event
    does depends on all before it, so rows are dealt by user and room, sorted by Spark and streamed; a task holds one incident."""
    known = ["OPEN", "ACKNOWLEDGED", *CLOSED]
    said = reviews.filter((F.length(F.trim("note")) >= 8) & F.col("status").isin(*known)).select("user_id", "room_id", "at_ms", F.lit(None).cast("long").alias("seq"), F.lit(0).alias("score"), F.lit("").alias("level"), "status")
    rows = serious.select("user_id", "room_id", "at_ms", "seq", F.col("score").cast("int").alias("score"), "level", F.lit("").alias("status")).unionByName(said)
    rows = rows.withColumn("late", F.col("status") != "").withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, case = None, Case(c.incident_gap_ms)
        for frame in frames:
            out = []
            for user, room, at, seq, score, level, status in frame[["user_id", "room_id", "at_ms", "seq", "score", "level", "status"]].itertuples(index=False, name=None):
                if (user, room) != key:
                    key, case = (user, room), Case(c.incident_gap_ms)
                change = case.review(status) if status else case.event(at, score, level)
                if change:
                    out.append((user, room, case.start, at, seq, change, case.status, case.score, case.level))
            yield pd.DataFrame(out, columns=["user_id", "room_id", "start_ms", "at_ms", "seq", "change", "status", "risk_score", "risk_level"])

    dealt = rows.repartition("user_id", "room_id").sortWithinPartitions("user_id", "room_id", "at_ms", "late", "seq", "status")
    made = dealt.mapInPandas(run, "user_id string, room_id string, start_ms long, at_ms long, seq long, change string, status string, risk_score int, risk_level string")
    return made.select(H.incident_id(F.col("user_id"), F.col("room_id"), F.col("start_ms")).alias("incident_id"), *(x.split()[0] for x in LIFECYCLE.split(", ")[1:]))


def build(sessioned: DataFrame, signals: DataFrame, events: DataFrame, c: CaseConfig, excerpt_chars: int = 280, excerpts: int = 20) -> DataFrame:
    """One row for each incident: peak score and level, behaviours in order of appearance, confidence, redacted excerpts."""
    main = sessioned.groupBy("incident_id", "user_id", "room_id").agg(
        F.min("at_ms").alias("created_ms"), F.max("at_ms").alias("updated_ms"), F.count("*").alias("n_events"), F.max("score").alias("risk_score"), F.max_by("level", "score").alias("risk_level")
    )
    own = signals.join(sessioned.select("incident_id", "event_id"), "event_id")
    by_code = own.groupBy("incident_id", "code").agg(F.min(F.struct("at_ms", "seq")).alias("first"), F.max("confidence").alias("confidence"), F.max_by("severity", "confidence").alias("severity"))
    reason = F.format_string("[%s] %s, confidence %s", F.col("code"), F.lower("severity"), F.col("confidence").cast("string"))
    behaviours = by_code.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("first", "code", reason.alias("reason")))).alias("b"), F.least(M.noisy_or(F.col("confidence")), F.lit(0.99)).alias("confidence"))
    said = events.filter("message IS NOT NULL").select("event_id", "message").join(sessioned.select("incident_id", "event_id", "at_ms", "seq"), "event_id")
    said = said.withColumn("rank", F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("at_ms"), F.desc("seq")))).filter(F.col("rank") <= excerpts)
    excerpt = T.truncate(T.redact_identifiers(F.col("message")), excerpt_chars)
    said = said.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("at_ms", "seq", "event_id", excerpt.alias("excerpt")))).alias("messages"))
    rows = main.join(behaviours, "incident_id", "left").join(said, "incident_id", "left")
    rows = rows.withColumns({"behaviors": F.transform("b", lambda x: x["code"]), "reasons": F.transform("b", lambda x: x["reason"])})
    detectors = F.array_sort(F.array_distinct(F.transform("behaviors", lambda c: F.concat(F.lower(F.substring_index(c, "_", 1)), F.lit("-"), F.lit(VERSION)))))
    return rows.withColumns({"model_versions": F.array_union(F.array(F.lit(f"risk-{VERSION}")), detectors), "status": F.lit("OPEN")}).drop("b")


def with_metadata(incidents: DataFrame, sessioned: DataFrame, events: DataFrame) -> DataFrame:
    """Adds metadata, a map of what an incident may say of its last event and its assessment: platform, type, declared
    version, level, score, confidence and counts, and the event's own metadata as ``meta.*``. No address, device or place."""
    last = sessioned.groupBy("incident_id").agg(F.max_by("event_id", F.struct("at_ms", "seq")).alias("event_id"), F.max("peak_confidence").alias("peak"), F.sum("n_contributions").alias("n"), F.min("deterministic_only").alias("rules_only"))
    own = [c for c in events.columns if c in ("k", "value")]
    rows = last.join(events.select("event_id", "platform", "event_type", "client_version", "is_transcript", *own), "event_id", "left")
    text = lambda c: F.col(c).cast("string")
    pairs = {"peakConfidence": text("peak"), "deterministicOnly": text("rules_only"), "signalCount": text("n"), "platform": F.col("platform"), "eventType": F.col("event_type"), "declaredClientVersion": F.col("client_version"), "sourceIsTranscript": F.when(F.col("is_transcript"), "true")}
    pairs |= {f"meta.{c}": text(c) for c in own}
    made = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    level = F.create_map(F.lit("riskLevel"), F.col("risk_level"), F.lit("riskScore"), F.col("risk_score").cast("string"))
    return incidents.join(rows.select("incident_id", made.alias("_meta")), "incident_id", "left").withColumn("metadata", F.map_concat(level, F.coalesce("_meta", F.create_map().cast("map<string,string>")))).drop("_meta")


def new_behaviours(sessioned: DataFrame, signals: DataFrame, c: CaseConfig) -> DataFrame:
    """(incident_id, event_id, at_ms, seq, bundle): events that open an incident or bring a code that it hadn't, at most so
    many: each deserves an evidence bundle."""
    own = signals.join(sessioned.select("incident_id", "event_id"), "event_id").select("incident_id", "event_id", "at_ms", "seq", "code")
    first = own.withColumn("n", F.row_number().over(W.partitionBy("incident_id", "code").orderBy("at_ms", "seq"))).filter("n = 1")
    first = first.select("incident_id", "event_id", "at_ms", "seq").distinct()
    return first.withColumn("bundle", F.row_number().over(W.partitionBy("incident_id").orderBy("at_ms", "seq"))).filter(F.col("bundle") <= c.max_evidence)


def with_reviews(incidents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Status after the latest valid review (with a note of eight characters or more)."""
    good = reviews.filter(F.length(F.trim("note")) >= 8)
    last = good.groupBy("incident_id").agg(F.max_by(F.struct(F.col("status").alias("new"), "reviewed_by", "note"), "at_ms").alias("r"))
    return incidents.join(last, "incident_id", "left").withColumn("status", F.coalesce("r.new", "status")).withColumns({"reviewed_by": F.col("r.reviewed_by"), "note": F.col("r.note")}).drop("r")


def false_positives(incidents: DataFrame) -> DataFrame:
    """Per leading behaviour: incidents, false ones, and the rate of right ones."""
    by = incidents.groupBy(F.get("behaviors", F.lit(0)).alias("code")).agg(F.count("*").alias("incidents"), F.count_if(F.col("status") == "FALSE_POSITIVE").alias("false_ones"))
    return by.withColumn("precision", 1 - F.col("false_ones") / F.col("incidents"))


def restriction_rows(sessioned: DataFrame) -> DataFrame:
    """The first event of each incident for which a temporary restriction is recommended."""
    gated = sessioned.filter(F.col("restriction_status") == "recommended")
    return gated.withColumn("n", F.row_number().over(W.partitionBy("incident_id").orderBy("at_ms", "seq"))).filter("n = 1").drop("n")


def action_log(planned: DataFrame) -> DataFrame:
    """One row for each automated step of a plan; a step needs a reason."""
    rows = planned.select("user_id", "room_id", "at_ms", "event_id", F.explode("automated").alias("action_type"), F.col("rationale").alias("reason"))
    return rows.withColumn("reason", F.when(F.trim("reason") != "", F.col("reason")).otherwise(F.raise_error(F.lit("an action needs a reason")))).withColumns({"actor_kind": F.lit("SYSTEM"), "scope": F.lit("USER"), "succeeded": F.lit(True)})


def case_log(sessioned: DataFrame, evidence: DataFrame) -> DataFrame:
    """What became of each event of an incident: created by the first, folded in by the others, and a row for each evidence
    bundle (incident_id, event_id, at_ms), in the action log's schema."""
    first = F.row_number().over(W.partitionBy("incident_id").orderBy("at_ms", "seq")) == 1
    rows = sessioned.select("user_id", "room_id", "at_ms", "event_id", "incident_id", F.when(first, "INCIDENT_CREATED").otherwise("INCIDENT_UPDATED").alias("action_type"))
    kept = evidence.select("incident_id", "event_id").join(sessioned.select("user_id", "room_id", "at_ms", "event_id", "incident_id"), ["incident_id", "event_id"]).withColumn("action_type", F.lit("EVIDENCE_PRESERVED"))
    both = rows.unionByName(kept)
    return both.select("user_id", "room_id", "at_ms", "event_id", "action_type", F.concat(F.lit("incident "), "incident_id").alias("reason"), F.lit("SYSTEM").alias("actor_kind"), F.lit("INCIDENT").alias("scope"), F.lit(True).alias("succeeded"))
