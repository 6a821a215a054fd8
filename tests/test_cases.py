import random

from pyspark.sql import functions as F

from tests.helpers import START
from tidewatch.config import CaseConfig, Config, RiskConfig, resolve, validate
from tidewatch.operators import alerts, evidence, incidents, policy, rates, reads, risk, shield

R, X = RiskConfig(), CaseConfig()
SIGNALS = "user_id string, room_id string, event_id string, at_ms long, seq long, code string, category string, severity string, confidence double"


def signals(spark, rows):
    return spark.createDataFrame([("u", "r", e, START + t, t, code, code.split("_")[0], "HIGH", c) for e, t, code, c in rows], SIGNALS)


def test_score_and_plan(spark):
    rows = [("a", 0, "SPAM_BURST", 0.9), ("a", 0, "SPAM_BURST", 0.3), ("a", 0, "THREAT_LANGUAGE", 0.9), ("b", 1, "SPAM_BURST", 0.25), ("c", 2, "ABUSE_SEVERE", 0.9), ("c", 2, "ABUSE_REPEATED", 0.8), ("c", 2, "ABUSE_TARGETED_HARASSMENT", 0.85)]
    got = {r.event_id: r for r in policy.plan(risk.score_signals(signals(spark, rows), R), R).collect()}
    assert (got["a"].score, got["a"].level, got["a"].contributions[0].code) == (60, "HIGH", "THREAT_LANGUAGE")
    assert (got["b"].score, got["b"].level) == (10, "LOW") and got["c"].score == 80
    assert got["c"].restriction_status == "not_corroborated" and "CREATE_INCIDENT" in got["a"].automated and got["b"].recommended == ["NONE"]


def test_history(spark):
    random.seed(4)
    rows = [(random.choice("uv"), f"e{i}", START + random.randrange(10**9), i, float(random.choice([0, 20, 45, 60, 90])), random.randrange(3), random.random() < 0.1, random.random() < 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id string, event_id string, at_ms long, seq long, signal_total double, n_contributions long, severe boolean, evading boolean")
    got = {r.event_id: r for r in risk.user_history(df, R).collect()}
    for user in "uv":
        carried, violations, evasions, last = 0.0, 0, 0, None
        for _, e, at, _, total, n, severe, evading in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[3])):
            bonus = min(25 * (violations + evasions), 25) if n else 0
            past = min(carried * 0.5 ** ((at - last) / R.history_half_life_ms), 20) if carried and last is not None else min(carried, 20)
            score = int(min(total + bonus + past, 100) + 0.5)
            assert got[e].score == score
            carried = int(score * 40 + 0.5) / 100
            if score >= 50 or severe:
                violations, last = violations + 1, at
            evasions += evading
            assert (got[e].violations, got[e].evasions) == (violations, evasions)


def test_incidents_fold_and_reopen(spark):
    gap = X.incident_gap_ms
    times = [0, gap, 2 * gap + 1, 2 * gap + 5]
    df = spark.createDataFrame([("u", "r", f"e{i}", START + t, i, 60 + i, "HIGH") for i, t in enumerate(times)], "user_id string, room_id string, event_id string, at_ms long, seq long, score int, level string")
    n = lambda *reviews: incidents.sessions(df, X, spark.createDataFrame(list(reviews), "user_id string, room_id string, at_ms long, status string") if reviews else None).select("incident_id").distinct().count()
    assert n() == 2  # an equal gap folds, one millisecond more doesn't
    assert n(("u", "r", START + 2 * gap + 3, "RESOLVED")) == 3 and n(("u", "r", START + 2 * gap + 3, "ACKNOWLEDGED")) == 2
    s = incidents.sessions(df, X)
    sig = spark.createDataFrame([("u", "r", f"e{i}", START + t, i, c, "SPAM", "HIGH", 0.5) for i, t, c in ((0, 0, "A"), (1, gap, "A"), (1, gap, "B"), (2, 2 * gap + 1, "A"))], SIGNALS)
    said = spark.createDataFrame([("e0", "mail me a@b.org"), ("e1", "x y " * 100)], "event_id string, message string")
    cases = incidents.build(s, sig, said, X).orderBy("created_ms").collect()
    assert cases[0].behaviors == ["A", "B"] and cases[0].messages[0].excerpt == "mail me [redacted-email]" and len(cases[0].messages[1].excerpt) == 280
    assert cases[0].confidence == 0.75 and cases[0].risk_score == 61
    assert [(r.event_id, r.bundle) for r in incidents.new_behaviours(s, sig, X).orderBy("at_ms").collect()] == [("e0", 1), ("e1", 2), ("e2", 1)]
    reviews = spark.createDataFrame([(cases[0].incident_id, 1, "FALSE_POSITIVE", "mod", "not spam at all"), (cases[0].incident_id, 2, "OPEN", "mod", "short")], "incident_id string, at_ms long, status string, reviewed_by string, note string")
    assert {r.status for r in incidents.with_reviews(incidents.build(s, sig, said, X), reviews).collect()} == {"OPEN", "FALSE_POSITIVE"}


def test_alerts_count_from_the_last_sent(spark):
    rows = [("k", START + t, t, f"e{t}") for t in (0, 299_999, 300_000, 300_001, 600_000)] + [("m", START, 0, "m0")]
    df = spark.createDataFrame(rows, "dedupe_key string, at_ms long, seq long, event_id string")
    assert sorted(r.event_id for r in alerts.sent(df, 300_000).collect()) == ["e0", "e300000", "e600000", "m0"]
    a = spark.createDataFrame([("u", "LOW", ["THREAT_LANGUAGE"]), ("u", "MEDIUM", ["EVASION_REJOIN_CYCLING"]), ("u", "CRITICAL", ["BOT_SUSTAINED_RATE", "ABUSE_SEVERE"])], "user_id string, level string, codes array<string>")
    got = alerts.decide(a, X).collect()
    assert [r.fires for r in got] == [True, False, True] and got[2].reasons == ["SEVERE_ABUSE", "CRITICAL_RISK", "MASS_SPAM"] and got[0].dedupe_key == "u:LOW:THREAT_DETECTED"


def test_evidence_chain_shows_tampering(spark):
    rows = [(f"i{n}", "u", START + n // 2, "{\"schemaVersion\":1,\"n\":%d}" % n) for n in range(20)]
    made = evidence.chain(spark.createDataFrame(rows, "incident_id string, user_id string, created_ms long, body string"))
    chained = spark.createDataFrame(made.collect(), made.schema)
    assert [r.sequence for r in chained.orderBy("sequence").collect()] == list(range(20))
    bad = lambda df: {r.sequence: r.problems for r in evidence.verify_chain(df).filter("size(problems) > 0").collect()}
    assert bad(chained) == {}
    assert bad(chained.withColumn("body", F.when(F.col("sequence") == 3, F.lit('{"schemaVersion":1}')).otherwise(F.col("body")))) == {3: ["content"]}
    assert bad(chained.filter("sequence <> 5")) == {6: ["gap", "broken_link"]}
    assert bad(chained.withColumn("previous_hash", F.when(F.col("sequence") == 7, F.lit("0" * 64)).otherwise(F.col("previous_hash")))) == {7: ["chain_hash", "broken_link"]}
    old = spark.createDataFrame([("i0", START), ("i19", START + 10**12)], "incident_id string, updated_ms long")
    plan = {r.incident_id: r.decision for r in evidence.retention_plan(old, chained, START + 400 * 86_400_000, 365, 365).collect()}
    assert plan["i0"] == "delete" and plan["i19"] == plan["i5"] == "keep"


def test_shield(spark):
    def run(*rows):
        cols = "listener_id string, speaker_id string, event_id string, at_ms long, seq long, class string, confidence double, cleared boolean, blocked boolean"
        df = spark.createDataFrame([("l", "s", f"e{i}", START + t, i, c, p, clear, block) for i, (t, c, p, clear, block) in enumerate(rows)], cols)
        return [r.action for r in shield.decisions(shield.with_offences(df, X), X).orderBy("seq").collect()]

    plain = lambda t, c, p=0.8: (t, c, p, False, False)
    assert run(plain(0, "ABUSIVE"), plain(10_000, "ABUSIVE"), plain(20_000, "SAFE"), plain(20_000 + 600_000, "SAFE")) == ["LOCAL_SOFT_MUTE", "LOCAL_MUTE", "LOCAL_MUTE", "NONE"]
    assert run(plain(0, "ABUSIVE", 0.5), plain(70_000, "ABUSIVE"), plain(80_000, "THREAT", 0.1)) == ["FLAG", "LOCAL_SOFT_MUTE", "LOCAL_MUTE"]
    assert run((0, "SAFE", 0.9, False, True), plain(1, "SAFE"), (2, "SAFE", 0.9, True, False), plain(3, "SAFE")) == ["LOCAL_BLOCK", "LOCAL_BLOCK", "CLEARED", "NONE"]


def test_rates_and_reads(spark):
    log = spark.createDataFrame([("k", t, t) for t in (0, 1, 2, 59_999, 60_000)], "key string, at_ms long, seq long")
    got = {r.at_ms: r for r in rates.fixed_window(log, 3, 60_000).collect()}
    assert not got[59_999].allowed and got[59_999].retry_s == 1 and got[60_000].allowed and got[2].remaining == 0
    assert {r.at_ms: r.n for r in rates.recent_count(log, 60_000).collect()}[60_000] == 5
    latest = spark.createDataFrame([("a", 80, "CRITICAL"), ("b", 10, "LOW")], "user_id string, score int, level string")
    assert [(r.level, r.n) for r in reads.risk_distribution(latest, R).collect()].count(("HIGH", 0)) == 1
    assert reads.newest(log, 2).first().at_ms == 60_000


def test_config():
    assert validate(Config()) == []
    c = resolve({"risk": {"weights": {"SPAM_BURST": 50}}, "client": {"known_versions": ["1.0.0"]}})
    assert c.risk.weights["SPAM_BURST"] == 50 and c.risk.weights["SPAM_LINK_FLOOD"] == 15 and c.client.known_versions == ("1.0.0",)
    for bad in ({"risk": {"weights": {"SPAM_BURST": 101}}}, {"risk": {"thresholds": {"MEDIUM": 60}}}, {"spam": {"burst_count": 0}}, {"case": {"event_days": 0}}, {"spam": {"nonsense": 1}}):
        try:
            resolve(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
