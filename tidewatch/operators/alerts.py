"""Alerts: reasons, and one sent at most per key and window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import CaseConfig
from tidewatch.operators.risk import level_rank

#: Reasons, the gravest first.
ORDER = ("THREAT_DETECTED", "SEVERE_ABUSE", "CRITICAL_RISK", "REPEATED_EVASION", "SUSPICIOUS_CLIENT", "MASS_SPAM")


def decide(assessed: DataFrame, c: CaseConfig, off: frozenset[str] = frozenset()) -> DataFrame:
    """Adds reasons, fires and dedupe_key. assessed has user_id, level, codes; severe_repeat if an identical repeat was
    severe. off: reasons switched off."""
    has = lambda *codes: F.arrays_overlap("codes", F.array(*map(F.lit, codes)))
    severe = F.col("severe_repeat") if "severe_repeat" in assessed.columns else F.lit(False)
    enough = level_rank(F.col("level")) >= ("LOW", "MEDIUM", "HIGH", "CRITICAL").index(c.alert_min_level)
    tests = {
        "THREAT_DETECTED": has("THREAT_LANGUAGE"),
        "SEVERE_ABUSE": has("ABUSE_SEVERE"),
        "CRITICAL_RISK": enough & (F.col("level") == "CRITICAL"),
        "REPEATED_EVASION": has("EVASION_POST_MODERATION_ACTIVITY", "EVASION_REJOIN_CYCLING"),
        "SUSPICIOUS_CLIENT": has("CLIENT_ATTESTATION_FAILED", "CLIENT_IMPOSSIBLE_SEQUENCE", "CLIENT_ABNORMAL_REQUEST_RATE"),
        "MASS_SPAM": has("COORDINATED_IDENTICAL_CONTENT", "BOT_SUSTAINED_RATE") | (has("SPAM_IDENTICAL_REPEAT") & severe),
    }
    reasons = F.filter(F.array(*(F.when(tests[r], F.lit(r)) for r in ORDER if r not in off)), lambda r: r.isNotNull())
    rows = assessed.withColumn("reasons", reasons)
    always = F.arrays_overlap("reasons", F.array(F.lit("THREAT_DETECTED"), F.lit("SEVERE_ABUSE")))
    top = F.coalesce(F.get("reasons", F.lit(0)), F.lit("NONE"))
    return rows.withColumns({"fires": (F.size("reasons") > 0) & (enough | always), "dedupe_key": F.concat_ws(":", "user_id", "level", top)})


def second_consumer(assessed: DataFrame, c: CaseConfig) -> DataFrame:
    enough = level_rank(F.col("level")) >= ("LOW", "MEDIUM", "HIGH", "CRITICAL").index(c.alert_min_level)
    return assessed.filter(enough).withColumn("dedupe_key", F.concat_ws(":", F.lit("alert"), "user_id", "level"))


def wellbeing(calls: DataFrame) -> DataFrame:
    """Calls for care (operators.abuse.wellbeing) as alerts: one a user and window, whatever the risk level."""
    return calls.withColumn("dedupe_key", F.concat_ws(":", F.lit("wellbeing"), "user_id"))


def sent(alerts: DataFrame, window_ms: int, key: str = "dedupe_key") -> DataFrame:
    """Alerts less those within the window of the last one *sent* for their key: each sent one silences what follows, so
    keys are streamed in time order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for frame in frames:
            keep = []
            for k, at in zip(frame["key"], frame["at_ms"]):
                if k != now:
                    now, last = k, None
                ok = last is None or at - last >= window_ms
                last = at if ok else last
                keep.append(ok)
            yield frame[keep]

    narrow = alerts.select(F.col(key).alias("key"), "at_ms", "seq", "event_id").repartition("key").sortWithinPartitions("key", "at_ms", "seq")
    return narrow.mapInPandas(run, "key string, at_ms long, seq long, event_id string")
