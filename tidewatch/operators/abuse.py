"""Abusive language: layers judge a message, one decision is made of them, signals follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import AbuseConfig
from tidewatch.functions import math as M
from tidewatch.functions import text as T
from tidewatch.operators import lexicon as L
from tidewatch.operators.spam import is_content
from tidewatch.operators.windows import FIRST

CLASSES = ("SAFE", "UNCERTAIN", "ABUSIVE", "SEVERE_ABUSE", "THREAT")
_LAYER = "struct<layer:string,class:string,confidence:double>"


def rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), c).cast("int") - 1


def _hits(tier: str, lex: L.Lexicon) -> Column:
    """Distinct matches in the text and, where letters are spaced out, in the joined text. The pattern, which is large, is only for
    texts with a word that it asks for."""
    if tier not in lex.patterns:
        return F.array().cast("array<string>")
    plain = F.regexp_extract_all("normalized", F.lit(lex.patterns[tier]), F.lit(0))
    if tier in lex.words:
        plain = F.when(_has_any("seen", lex.words[tier]), plain)
    dense = F.regexp_extract_all(F.coalesce(F.col("joined"), F.lit("")), F.lit(lex.dense[tier]), F.lit(0))
    return F.slice(F.array_distinct(F.concat(F.coalesce(plain, F.array().cast("array<string>")), dense)), 1, 200)


def _has_any(words: str, wanted: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted)))


HITS = ["mild_hits", "severe_hits", "threat_hits", "mitigations", "obfuscated", "addressed", "mentions_someone", "other_target", "self_harm"]


def message_hits(said: DataFrame, lex: L.Lexicon | None = None) -> DataFrame:
    """Adds HITS to messages with their text features. Mitigations are looked for where something was hit."""
    lex = lex or L.Lexicon()
    target, other, harm = (w.split("|") for w in (L.TARGET_WORDS, L.OTHER_WORDS, L.SELF_HARM_WORDS))
    wanted = sorted({*target, *other, *harm, *(w for some in lex.words.values() for w in some)})
    words = F.split("normalized", r"\W+")
    said = said.withColumns({"joined": T.collapse_letter_spacing(F.col("normalized")), "seen": F.array_intersect(words, F.array(*map(F.lit, wanted)))})
    for tier in ("mild", "severe", "threat"):
        said = said.withColumn(f"{tier}_hits", _hits(tier, lex))
    if lex.allow:
        ok = F.array(*map(F.lit, lex.allow))
        said = said.withColumn("mild_hits", F.filter("mild_hits", lambda h: ~F.exists(ok, lambda a: F.contains(a, h) | F.contains(h, a))))
    found = [F.when(F.col("normalized").rlike(p if n == "quotation" else L.bounded(p)), F.lit(n)) for n, p in L.MITIGATIONS]
    any_hit = (F.size("mild_hits") + F.size("severe_hits") + F.size("threat_hits")) > 0
    said = said.withColumn("mitigations", F.filter(F.when(any_hit, F.array(*found)).otherwise(F.array().cast("array<string>")), lambda m: m.isNotNull()))
    x = T.char_anomalies(F.col("message"), F.col("forms"), F.col("normalized"))
    hidden = x["invisible_in_word"] | (x["mixed_words"] > 0) | x["letter_spaced"]
    handled = lambda pattern: F.contains("normalized", F.lit("@")) & F.col("normalized").rlike(pattern)
    return said.withColumns({
        "obfuscated": any_hit & hidden, "addressed": _has_any("seen", target) | handled(L.TARGET), "mentions_someone": handled(r"(?:^|\s)@[a-z0-9_.-]{2,}"),
        "other_target": _has_any("seen", other) | handled(L.OTHER_TARGET), "self_harm": _has_any("seen", harm) & F.col("normalized").rlike(L.bounded(L.SELF_HARM)),
    }).drop("seen")


def with_hits(featured: DataFrame, lex: L.Lexicon) -> DataFrame:
    """Adds mild, severe and threat hits, mitigations, targeted, obfuscated and self_harm; works on distinct messages, which
    are joined back by their digest. Events to which the hits of their messages were joined already keep them."""
    rows = featured
    if not set(HITS) <= set(rows.columns):
        rows = rows.withColumn("key", F.md5("message"))
        said = rows.filter("message IS NOT NULL").groupBy("key").agg(*(F.first(c).alias(c) for c in ("message", "normalized", "forms")))
        rows = rows.join(message_hits(said, lex).select("key", *HITS), "key", "left").drop("key")
    return rows.withColumn("targeted", F.coalesce(F.col("mentions_someone") | (F.col("addressed") & (F.col("event_type") != "join")), F.lit(False)))


def _layer(name: str, cls: Column, confidence: Column) -> Column:
    return F.struct(F.lit(name).alias("layer"), cls.alias("class"), confidence.cast("double").alias("confidence"))


def with_layers(hit: DataFrame, c: AbuseConfig, verdicts: DataFrame | None = None) -> DataFrame:
    """Adds sources: the verdicts of the rules, the lexicon, the rate of repetition, and a classifier if there is one."""
    has = lambda m: F.array_contains("mitigations", m)
    quoted, reporting = has("quotation") | has("reported-speech"), has("reporting-abuse")
    none = lambda hits: F.coalesce(F.size(hits), F.lit(0)) == 0
    rule = lambda cls, sure: _layer("rules", F.lit(cls), F.lit(sure))
    threat = (
        F.when(none("threat_hits"), None)
        .when(has("negated-intent"), rule("SAFE", 0.6))
        .when(reporting, rule("SAFE", 0.55))
        .when(quoted, rule("UNCERTAIN", 0.5))
        .when(has("gaming-context"), rule("UNCERTAIN", 0.45))
        .otherwise(rule("THREAT", 0.9))
    )
    severe = (
        F.when(none("severe_hits"), None)
        .when(has("self-directed") & ~F.col("other_target"), rule("SAFE", 0.6))
        .when(reporting | quoted, rule("UNCERTAIN", 0.5))
        .otherwise(rule("SEVERE_ABUSE", 0.85))
    )
    n = F.size("mild_hits")
    mild = (
        F.when(none("mild_hits"), None)
        .when(quoted | reporting | has("self-directed"), _layer("lexicon", F.lit("SAFE"), F.lit(0.5)))
        .when(F.col("targeted"), _layer("lexicon", F.lit("ABUSIVE"), F.when(n >= 4, 0.8).otherwise(0.68)))
        .otherwise(_layer("lexicon", F.lit("UNCERTAIN"), F.lit(0.42)))
    )
    rows = hit.withColumns({"l_threat": threat, "l_severe": severe, "l_mild": mild})
    if verdicts is not None:
        given = verdicts.select("event_id", F.struct(F.lit("ai").alias("layer"), F.col("classification").alias("class"), M.clamp(F.col("confidence"), 0, 1).alias("confidence")).alias("l_ai"))
        rows = rows.join(given, "event_id", "left")
    else:
        rows = rows.withColumn("l_ai", F.lit(None).cast(_LAYER))
    rows = rows.withColumn("base", decide(_some("l_threat", "l_severe", "l_mild", "l_ai"), c))
    # up to the threshold only verdicts without the rate layer count, and the list never shrinks below it
    said = F.col("message").isNotNull() if "message" in rows.columns else F.col("has_message")
    counted = F.when(said & (rank(F.col("base.class")) >= 2), 1).otherwise(0)
    prior = F.coalesce(F.sum(counted).over(W.partitionBy("user_id").orderBy("at_ms", "seq").rowsBetween(FIRST, -1)), F.lit(0))
    rows = rows.withColumn("repeated", prior + 1 >= c.repeat_count)
    rate = F.when(F.col("repeated") & ((F.size("mild_hits") > 0) | (F.size("severe_hits") > 0)), _layer("rate", F.lit("ABUSIVE"), F.lit(0.75)))
    return rows.withColumn("l_rate", rate).withColumn("sources", _some("l_threat", "l_severe", "l_mild", "l_rate", "l_ai")).drop("l_threat", "l_severe", "l_mild", "l_rate", "l_ai", "base")


def _some(*names: str) -> Column:
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def decide(sources: Column, c: AbuseConfig) -> Column:
    """Struct (class, confidence, review, recommended) of the layers' verdicts: the first most severe fixed rule leads; a
    classifier raises it only for a person to confirm, and real disagreement is uncertain. What is named often is computed once."""
    none = F.lit(None).cast(_LAYER)
    top = F.aggregate(F.filter(sources, lambda s: s["layer"] != "ai"), none, lambda best, s: F.when(best.isNull() | (rank(s["class"]) > rank(best["class"])), s).otherwise(best))
    ai = F.get(F.filter(sources, lambda s: s["layer"] == "ai"), F.lit(0))
    found = T.once(F.struct(top.alias("top"), ai.alias("ai")), lambda x: _judged(x["top"], x["ai"], c))
    return T.once(found, lambda x: _advised(x, c))


def _judged(top: Column, ai: Column, c: AbuseConfig) -> Column:
    made = lambda cls, conf, review: F.struct((cls if isinstance(cls, Column) else F.lit(cls)).alias("class"), (conf if isinstance(conf, Column) else F.lit(float(conf))).alias("confidence"), (review if isinstance(review, Column) else F.lit(review)).alias("review"))
    a, b = rank(top["class"]), rank(ai["class"])
    gap = F.abs(a - b)
    apart = gap / 4 + F.abs(top["confidence"] - ai["confidence"]) / 2
    both = (
        F.when(a == b, made(top["class"], M.half_up(1 - (1 - top["confidence"]) * (1 - ai["confidence"]), 4), False))
        .when(a >= 3, made(top["class"], top["confidence"], ai["class"] == "SAFE"))
        .when((gap >= 2) | (apart >= c.disagreement_threshold), made("UNCERTAIN", 0.5, True))
        .when(b > a, made(ai["class"], F.least(ai["confidence"], F.lit(0.75)), True))
        .otherwise(made(top["class"], top["confidence"], False))
    )
    alone = made(F.when(ai["class"] == "SAFE", "SAFE").otherwise("UNCERTAIN"), F.least(ai["confidence"], F.lit(0.7)), ai["class"] != "SAFE")
    return F.when(top.isNotNull() & ai.isNotNull(), both).when(top.isNotNull(), made(top["class"], top["confidence"], False)).when(ai.isNotNull(), alone).otherwise(made("SAFE", 0.9, False))


def _advised(found: Column, c: AbuseConfig) -> Column:
    cls, conf = found["class"], M.half_up(M.clamp(found["confidence"], 0, 1), 4)
    sure = found["confidence"] >= c.auto_action_min_confidence
    advice = F.when(cls == "THREAT", "REPORT").when(cls == "SEVERE_ABUSE", F.when(sure, "BLOCK").otherwise("REPORT")).when(cls == "ABUSIVE", F.when(sure, "MUTE").otherwise("WARN")).when(cls == "UNCERTAIN", "WARN").otherwise("NONE")
    return F.struct(cls.alias("class"), conf.alias("confidence"), (found["review"] | (~sure & (cls != "SAFE"))).alias("review"), advice.alias("recommended"))


def classify(featured: DataFrame, c: AbuseConfig, lex: L.Lexicon | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Adds decision to content events; those without text are safe."""
    rows = with_layers(with_hits(featured.filter(is_content()), lex or L.Lexicon()), c, verdicts)
    return rows.withColumn("decision", decide(F.coalesce("sources", F.array().cast(f"array<{_LAYER}>")), c))


def signals(classified: DataFrame, c: AbuseConfig) -> DataFrame:
    from tidewatch.config import SIGNALS

    one = lambda code, severity, confidence: F.struct(F.lit(code).alias("code"), F.lit(SIGNALS[code][0]).alias("category"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))

    def made(decision: Column) -> Column:
        cls, conf = decision["class"], decision["confidence"]
        worth = (cls != "SAFE") & (cls.isin("THREAT", "SEVERE_ABUSE") | (conf >= c.min_confidence))
        found = F.array(
            F.when(cls == "THREAT", one("THREAT_LANGUAGE", "SEVERE", conf)).when(cls == "SEVERE_ABUSE", one("ABUSE_SEVERE", "SEVERE", conf)).when(cls.isin("ABUSIVE", "UNCERTAIN"), one("ABUSE_LANGUAGE", F.when(cls == "ABUSIVE", "MEDIUM").otherwise("LOW"), conf)),
            F.when(F.col("targeted") & (rank(cls) >= 2), one("ABUSE_TARGETED_HARASSMENT", "HIGH", F.least(conf, F.lit(0.85)))),
            F.when(F.col("repeated"), one("ABUSE_REPEATED", "HIGH", 0.8)),
            F.when(F.col("obfuscated"), one("EVASION_FILTER_OBFUSCATION", "MEDIUM", 0.8)),
        )
        return F.filter(found, lambda x: worth & x.isNotNull())

    # as one expression over the decision: a filter would be pushed below it, and repeat it for each mention
    rows = classified.select("user_id", "room_id", "event_id", "at_ms", "seq", F.explode(T.once(F.col("decision"), made)).alias("x"))
    return rows.select("user_id", "room_id", "event_id", "at_ms", "seq", "x.*", F.create_map().cast("map<string,double>").alias("details"))


def wellbeing(classified: DataFrame) -> DataFrame:
    """Events that call for care, not for enforcement."""
    return classified.filter("self_harm").select("user_id", "room_id", "event_id", "at_ms")
