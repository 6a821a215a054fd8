"""Risk scores: strongest signals weighed, then a user's history folded in time order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import LEVELS, RiskConfig
from tidewatch.functions import math as M


def level_of(score: Column, c: RiskConfig) -> Column:
    out = F.lit("LOW")
    for level in LEVELS[1:]:
        out = F.when(score >= c.thresholds[level], level).otherwise(out)
    return out


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1


def range_label(level: Column, c: RiskConfig) -> Column:
    ends = [c.thresholds[x] for x in LEVELS] + [101]
    out = F.lit(None).cast("string")
    for name, low, high in zip(LEVELS, ends, ends[1:]):
        out = F.when(level == name, F.lit(f"{low}-{high - 1}")).otherwise(out)
    return out


def contributions(signals: DataFrame, c: RiskConfig) -> DataFrame:
    """Per event and code the strongest signal, what it weighs, and what is applied of it."""
    best = signals.groupBy("user_id", "room_id", "event_id", "at_ms", "seq", "code").agg(F.max("confidence").alias("confidence"), F.max_by("severity", "confidence").alias("severity"))
    weights = F.create_map(*(F.lit(x) for k, w in c.weights.items() for x in (k, float(w))))
    rows = best.withColumn("weight", F.coalesce(F.try_element_at(weights, "code"), F.lit(0.0))).filter(F.col("weight") > 0)
    applied = F.least(F.col("weight") * F.least(F.lit(1.0), F.col("confidence") / c.confidence_floor), F.lit(float(c.max_single)))
    return rows.withColumn("applied", applied)


#: Signals in which a model's verdict may have a part.
_BY_MODEL = "^(ABUSE_|THREAT_)"


def score_signals(signals: DataFrame, c: RiskConfig) -> DataFrame:
    """One row for each event with signals: score and level without history; deterministic_only if rules alone gave them. Codes are
    gathered as bits, so that, where nobody asks for the contributions, numbers alone are aggregated."""
    known = sorted(k for k, w in c.weights.items() if w > 0)  # what contributions() lets through
    words = [known[i : i + 62] for i in range(0, len(known), 62)]
    bits = [F.bit_or(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, k in enumerate(part) for x in (k, 1 << i))).cast("map<string,long>"), "code"), F.lit(0))) for part in words]
    by = contributions(signals, c).groupBy("user_id", "room_id", "event_id", "at_ms", "seq").agg(
        F.sum("applied").alias("signal_total"), F.max("confidence").alias("peak_confidence"), F.count("*").alias("n_contributions"), *(b.alias(f"bits{i}") for i, b in enumerate(bits)),
        F.collect_list(F.struct((-F.col("applied")).alias("order"), "code", "weight", M.half_up(F.col("applied"), 2).alias("applied"), "confidence")).alias("parts"),
    )
    parts = F.transform(F.array_sort("parts"), lambda p: F.struct(p["code"].alias("code"), p["weight"].alias("weight"), p["applied"].alias("applied"), p["confidence"].alias("confidence")))
    there = [F.when(F.col(f"bits{n}").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(k)).otherwise("") for n, part in enumerate(words) for i, k in enumerate(part)]
    codes = F.array_remove(F.array(*there).cast("array<string>"), "")
    score = M.half_up(M.clamp(F.col("signal_total"), 0, 100)).cast("int")
    rows = by.withColumns({"contributions": parts, "codes": codes, "score": score}).drop("parts", *(f"bits{i}" for i in range(len(words))))
    return rows.withColumns({"deterministic_only": ~F.exists("codes", lambda x: x.rlike(_BY_MODEL)), "level": level_of(F.col("score"), c)})


class History:
    """A user's state between events: carried risk, violations, evasions, time of the last violation."""

    def __init__(self, c: RiskConfig, carried: float = 0.0, violations: int = 0, evasions: int = 0, last: int | None = None):
        self.c, self.carried, self.violations, self.evasions, self.last = c, carried, violations, evasions, last

    def step(self, at_ms: int, total: float, n: int, severe: bool, evasion: bool) -> tuple[int, str, float, float]:
        """Score, level, history part and repeat bonus of an event; then the state moves on."""
        c, units = self.c, self.violations + self.evasions
        bonus = min(units * c.repeat_violation_weight, c.max_repeat_bonus) if units and n else 0.0
        past = 0.0
        if self.carried > 0:
            gone = max(0, at_ms - self.last) if self.last is not None else 0
            past = min(max(self.carried * 0.5 ** (gone / c.history_half_life_ms) if gone else self.carried, 0.0), c.max_history)
        score = int(min(max(total + bonus + past, 0.0), 100.0) + 0.5)
        level = [x for x in LEVELS if score >= c.thresholds[x]][-1]
        self.carried = int(score * c.carry * 100 + 0.5) / 100
        if level in ("HIGH", "CRITICAL") or severe:
            self.violations, self.last = self.violations + 1, at_ms
        self.evasions += int(evasion)
        return score, level, past, bonus

    def state(self) -> tuple[float, int, int, int | None]:
        return self.carried, self.violations, self.evasions, self.last


def fold_input(scored_events: DataFrame) -> DataFrame:
    """Narrow rows for the fold: time, total, number of contributions, and whether severe or evading."""
    severe = F.arrays_overlap("codes", F.array(F.lit("THREAT_LANGUAGE"), F.lit("ABUSE_SEVERE")))
    evading = F.arrays_overlap("codes", F.array(F.lit("EVASION_POST_MODERATION_ACTIVITY"), F.lit("EVASION_REJOIN_CYCLING")))
    return scored_events.select("user_id", "event_id", "at_ms", "seq", "signal_total", "n_contributions", severe.alias("severe"), evading.alias("evading"))


def user_history(narrow: DataFrame, c: RiskConfig) -> DataFrame:
    """Scores with history. What an event adds depends on all scores before it, so each user's rows are streamed in time
    order, dealt by user and sorted by Spark; a task holds one user's state, never a user's rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, History(c)
        for frame in frames:
            out = []
            for u, event_id, at_ms, seq, total, n, severe, evading in frame.itertuples(index=False, name=None):
                if u != user:
                    user, state = u, History(c)
                score, level, past, bonus = state.step(at_ms, total, n, severe, evading)
                out.append((u, event_id, at_ms, seq, score, level, int(past * 100 + 0.5) / 100, bonus, state.violations, state.evasions))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "at_ms", "seq", "score", "level", "history", "repeat_bonus", "violations", "evasions"])

    dealt = narrow.select("user_id", "event_id", "at_ms", "seq", "signal_total", F.col("n_contributions").cast("long"), "severe", "evading").repartition("user_id").sortWithinPartitions("user_id", "at_ms", "seq")
    return dealt.mapInPandas(run, "user_id string, event_id string, at_ms long, seq long, score int, level string, history double, repeat_bonus double, violations int, evasions int")


def latest_assessment(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("user_id").agg(F.max_by(F.struct("event_id", "at_ms", "score", "level"), F.struct("at_ms", "seq")).alias("x")).select("user_id", "x.*")
