"""Response plans: what to do at each level, and why a restriction is or isn't recommended. Nothing is ever applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import RiskConfig
from tidewatch.operators.risk import level_rank

CORROBORATING = "^(SPAM_|BOT_|CLIENT_|EVASION_|COORDINATED_)"


def _when(cond: Column, *items: str) -> Column:
    return F.when(cond, F.array(*map(F.lit, items))).otherwise(F.array().cast("array<string>"))


def plan(assessed: DataFrame, c: RiskConfig, can_block: bool = False) -> DataFrame:
    """Adds automated, recommended, restriction_status and rationale. assessed has score, level, peak_confidence, codes and
    contributions; also review (a person is asked for) and deterministic_only (no model had a part in it) if known."""
    rank = level_rank(F.col("level"))
    threat = F.array_contains("codes", "THREAT_LANGUAGE")
    review = F.col("review") if "review" in assessed.columns else F.lit(False)
    own = F.col("deterministic_only") if "deterministic_only" in assessed.columns else F.lit(False)
    corroborated = own | F.exists("codes", lambda x: x.rlike(CORROBORATING))
    status = (
        F.when(F.col("level") != "CRITICAL", "none")
        .when(F.col("peak_confidence") < c.critical_min_confidence, "low_confidence")
        .when(~corroborated, "not_corroborated")
        .when(review, "needs_review")
        .when(~F.lit(can_block), "unavailable")
        .otherwise("recommended")
    )
    rows = assessed.withColumn("restriction_status", status)
    automated = F.array_distinct(F.concat(
        F.array(F.lit("LOG")), _when(rank >= 1, "INCREASE_MONITORING"), _when(rank >= 2, "RECOMMEND_MUTE", "RECOMMEND_BLOCK", "RECOMMEND_REPORT"),
        _when(rank >= 3, "CREATE_INCIDENT", "PRESERVE_EVIDENCE", "NOTIFY_MODERATOR"), _when(F.col("restriction_status") == "recommended", "PLATFORM_TEMPORARY_BLOCK"),
        _when(threat, "NOTIFY_MODERATOR", "CREATE_INCIDENT", "PRESERVE_EVIDENCE"),
    ))
    recommended = F.array_distinct(F.concat(_when(rank >= 2, "MUTE", "BLOCK", "REPORT"), _when(threat, "REPORT")))
    recommended = F.when(F.size(recommended) > 0, recommended).otherwise(F.array(F.when(rank == 1, "WARN").otherwise("NONE")))
    top = F.array_join(F.transform(F.slice("contributions", 1, 3), lambda x: F.format_string("%s (+%s)", x["code"], x["applied"].cast("string"))), ", ")
    rationale = F.concat(F.format_string("Risk %d of 100, %s. Led by: ", F.col("score"), F.col("level")), top)
    return rows.withColumns({"automated": automated, "recommended": recommended, "rationale": rationale})


def may_open() -> Column:
    """Whether an assessment's plan opens an incident, by its level and codes alone."""
    return (level_rank(F.col("level")) >= 3) | F.array_contains("codes", "THREAT_LANGUAGE")


def with_notes(planned: DataFrame) -> DataFrame:
    """Adds notes: why a restriction wasn't recommended, and what goes to a person whatever the score."""
    status = F.col("restriction_status")
    why = {
        "low_confidence": "no restriction: the strongest signal is not sure enough for one",
        "not_corroborated": "no restriction: a model alone says so, a moderator decides",
        "needs_review": "no restriction: the classifier asks for a person",
        "unavailable": "no restriction: the platform grants no way to restrict; protections of the user's own remain",
        "recommended": "a temporary, reversible restriction, until a moderator has looked",
    }
    said = F.coalesce(*(F.when(status == k, F.lit(v)) for k, v in why.items()))
    threat = F.when(F.array_contains("codes", "THREAT_LANGUAGE"), F.lit("threat: goes to a moderator whatever the score"))
    return planned.withColumn("notes", F.filter(F.array(said, threat), lambda n: n.isNotNull()))


def capability_notes(spark, capabilities: dict[str, str]) -> DataFrame:
    """(field, status, note): what is clean, and what was never looked at."""
    said = {"available": "looked at", "unavailable": "the platform gives no such feed", "unauthorized": "not authorised to read", "disabled": "switched off"}
    return spark.createDataFrame([(k, v, said.get(v, v)) for k, v in sorted(capabilities.items())], "field string, status string, note string")


def with_capabilities(rows: DataFrame, capabilities: dict[str, str]) -> DataFrame:
    """Adds capability_notes to every row: which inputs were looked at, and which never were."""
    notes = [f"{r[0]}: {r[2]}" for r in capability_notes(rows.sparkSession, capabilities).collect()]
    return rows.withColumn("capability_notes", F.array(*map(F.lit, notes)).cast("array<string>"))
