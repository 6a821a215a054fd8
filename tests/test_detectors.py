"""Scenario shapes at real widths, exact edges, and brute force on random small tables."""

import random

from pyspark.sql import functions as F

from tests.helpers import START, codes, every, events
from tidewatch.config import Config, SpamConfig, resolve
from tidewatch.operators import abuse, client, coordination, evasion, spam

C = Config()


def test_spam_scenarios(spark):
    run = lambda rows: codes(spam.all_signals(events(spark, rows), C.spam))
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    assert run(every(25, 20_000, lambda i: f"{words[i % 10]} is what i think about {words[(i * 7) % 10]} today {i * i}", user_id="x") + every(10, 120_000, lambda i: words[i], user_id="q")) <= {"BOT_UNIFORM_TIMING"}
    assert "SPAM_BURST" in run(every(12, 420, lambda i: words[i % 10] * 2))
    flood = run(every(50, 1100, lambda i: ("Buy cheap gold now!", "buy CHEAP gold, now")[i % 2]))
    assert {"SPAM_IDENTICAL_REPEAT", "SPAM_HIGH_FREQUENCY", "BOT_UNIFORM_TIMING"} <= flood and "SPAM_NEAR_DUPLICATE" not in flood
    assert "SPAM_NEAR_DUPLICATE" in run(every(10, 2500, lambda i: f"join the biggest free giveaway of the year right now code {10000 + 137 * i}"))
    assert "SPAM_MENTION_FLOOD" in run([{"message": " ".join(f"@user{i}" for i in range(8))}])
    assert "SPAM_LINK_FLOOD" in run([{"message": " ".join(f"http://s{i}.com" for i in range(6))}])
    assert "SPAM_SUSPICIOUS_CHARACTERS" in run([{"message": "a​b hidden"}])
    assert run([{"message": "hello there"}, {"event_type": "join"}]) == set()


def test_windows_see_what_a_reader_saw(spark):
    random.seed(5)
    c = SpamConfig(burst_window_ms=50, window_ms=120, sustained_window_ms=300, max_window_events=7)
    rows = [{"at_ms": START + random.randrange(400), "user_id": random.choice("AB"), "event_type": random.choice(["message", "voice", "join"]), "message": random.choice(["x one", "y two"])} for _ in range(150)]
    got = {r.event_id: r for r in spam.with_repeats(spam.with_rates(spam.with_text_features(events(spark, rows)), c), SpamConfig(horizon_ms=200, max_window_events=7)).collect()}
    order = sorted(range(150), key=lambda i: (rows[i]["at_ms"], i))
    for pos, i in enumerate(order):
        own = [j for j in order[: pos + 1] if rows[j]["user_id"] == rows[i]["user_id"]][-8:]
        content = lambda j: rows[j]["event_type"] in ("message", "voice")
        count = lambda w: sum(content(j) and rows[i]["at_ms"] - rows[j]["at_ms"] <= w for j in own)  # noqa: E731,B023
        r = got[f"e{i}"]
        assert (r.n_burst, r.n_window, r.n_sustained) == (count(50), count(120), count(300))
        same = sum(content(j) and rows[j]["message"] == rows[i]["message"] and rows[i]["at_ms"] - rows[j]["at_ms"] <= 200 for j in own) if content(i) else 0
        assert r.n_same == same


def test_burst_edges(spark):
    at = lambda n, last: every(n - 1, 1) + [{"at_ms": START + last}]
    rated = lambda rows: spam.burst(spam.with_rates(events(spark, rows, message="x"), C.spam), C.spam).count()
    assert rated(at(10, 5000)) == 1 and rated(at(10, 5001)) == 0 and rated(at(9, 100)) == 0


def test_client(spark):
    known = resolve({"client": {"known_versions": ["4.2.1", "4.3.0"]}}).client
    rows = [{"at_ms": START + i * 3000, "client_version": ("4.2.1", "4.3.0", "9.9.9", "odd")[i % 4], "platform": ("ios", "web")[i % 2], "message": "x"} for i in range(12)]
    found = client.all_signals(events(spark, rows), known, 300_000)
    assert {"CLIENT_UNKNOWN_VERSION", "CLIENT_VERSION_FLAPPING", "CLIENT_PLATFORM_MISMATCH"} <= codes(found)
    assert codes(client.all_signals(events(spark, rows[:4]), known, 300_000)) == set()  # too few events for a claim
    seq = every(8, 6000, "x") + [{"at_ms": START + 50_000, "event_type": "leave"}, {"at_ms": START + 110_000, "message": "y"}]
    assert "CLIENT_IMPOSSIBLE_SEQUENCE" in codes(client.all_signals(events(spark, seq), C.client, 300_000))
    seq[-1]["at_ms"] = START + 55_000
    assert "CLIENT_IMPOSSIBLE_SEQUENCE" not in codes(client.all_signals(events(spark, seq), C.client, 300_000))
    rejects = spark.createDataFrame([("user-A", START + i, 1000 + i) for i in range(5)], "user_id string, at_ms long, seq long")
    assert client.malformed_requests(events(spark, [{"at_ms": START + 10, "seq": 2000}]), rejects, C.client).count() == 1
    seen = spark.createDataFrame([("user-A", "4.2.1", False)], "user_id string, client_version string, verified boolean")
    assert codes(client.all_signals(events(spark, [{"message": "x"}]), C.client, 300_000, seen)) == {"CLIENT_ATTESTATION_FAILED"}


def test_evasion_and_presence(spark):
    feed = lambda *rows: spark.createDataFrame(list(rows), "user_id string, applied_ms long, kind string, room_id string, expires_ms long, feed_seq long")
    said = events(spark, [{"message": "x", "at_ms": START + 1000}, {"message": "y", "at_ms": START + 2000, "room_id": "other"}])
    n = lambda *rows: sorted(r.event_id for r in evasion.post_moderation(said, feed(*rows), C.evasion).collect())
    assert n(("user-A", START, "MUTE", None, None, 1)) == ["e0", "e1"]
    assert n(("user-A", START, "MUTE", "ABC123", None, 1)) == ["e0"]
    assert n(("user-A", START, "MUTE", None, START + 1000, 1)) == []  # it ends at that millisecond
    assert n(("user-A", START + 1000, "MUTE", None, None, 1)) == ["e1"] and n(("user-B", START, "MUTE", None, None, 1)) == []
    assert n(("user-A", START + 1000 - 600_000, "MUTE", None, None, 1)) == ["e0"]
    rows = []
    for i in range(6):
        t = START + i * 25_000
        rows += [{"at_ms": t, "event_type": "join"}, {"at_ms": t + 12_000, "message": "m"}, {"at_ms": t + 20_000, "event_type": "leave"}]
    assert codes(evasion.rejoin_cycling(events(spark, rows), C.evasion)) == {"EVASION_REJOIN_CYCLING"}
    hidden = spark.createDataFrame([("user-A", "ABC123", START + 5000, "HIDDEN_JOIN", 1), ("user-A", "ABC123", START + 90_000, "HIDDEN_PRESENT", 2)], "user_id string, room_id string, at_ms long, kind string, seq long")
    talk = events(spark, [{"at_ms": START + t, "message": "x"} for t in (1999, 2000, 20_000, 45_000, 70_000)])
    r = evasion.presence_correlation(talk, hidden, START + 100_000, C.evasion).collect()
    assert len(r) == 1 and r[0].n == 4 and r[0].evidence_ids == ["e1", "e2", "e3", "e4"]


def test_coordination(spark):
    base = START // 300_000 * 300_000
    text = "everyone come to the new server right now and bring your friends"
    rows = [{"at_ms": base + i * 1000, "event_type": "join", "user_id": f"u{i}"} for i in range(6)] + [{"at_ms": base + 10_000 + i * 1500, "user_id": f"u{i}", "message": text} for i in range(6)] + [{"at_ms": base + 30_000, "user_id": "u0", "message": text}]
    found = coordination.findings(spam.with_text_features(events(spark, rows)), C.coordination)
    got = {r.code: r for r in found.collect()}
    assert got["COORDINATED_IDENTICAL_CONTENT"].n == 6 and got["COORDINATED_IDENTICAL_CONTENT"].severity == "HIGH"
    assert got["COORDINATED_SYNCHRONIZED_JOINS"].severity == "HIGH" and coordination.attributed(found).count() == 12
    assert coordination.findings(spam.with_text_features(events(spark, [r for r in rows if r["user_id"] in ("u0", "u1")])), C.coordination).count() == 0


def test_abuse(spark):
    def run(*texts, verdicts=None, gap=4000):
        df = events(spark, [{"at_ms": START + i * gap, "message": t} for i, t in enumerate(texts)])
        return abuse.classify(spam.with_text_features(df), C.abuse, verdicts=verdicts)

    cls = lambda *texts: [r.decision["class"] for r in run(*texts).orderBy("seq").collect()]
    assert cls("you are an idiot", "what an idiot he was", "hello", "i will kill you", "i will never kill you", "i will kill you in the next round", None) == ["ABUSIVE", "UNCERTAIN", "SAFE", "THREAT", "SAFE", "UNCERTAIN", "SAFE"]
    assert cls("go kill yourself", "he told me go kill yourself", "i am so stupid and worthless") == ["SEVERE_ABUSE", "UNCERTAIN", "SAFE"]
    found = codes(abuse.signals(run(*["you idiot"] * 4), C.abuse))
    assert found == {"ABUSE_LANGUAGE", "ABUSE_TARGETED_HARASSMENT", "ABUSE_REPEATED"}
    assert "EVASION_FILTER_OBFUSCATION" in codes(abuse.signals(run("you i d i o t"), C.abuse)) or "EVASION_FILTER_OBFUSCATION" in codes(abuse.signals(run("you id​iot"), C.abuse))
    assert abuse.wellbeing(run("i want to die")).count() == 1
    v = lambda c, p: spark.createDataFrame([("e0", c, p)], "event_id string, classification string, confidence double")
    d = lambda text, c, p: run(text, verdicts=v(c, p)).first().decision
    assert d("you idiot", "ABUSIVE", 0.8)["confidence"] == 0.936 and d("hello", "THREAT", 0.9)["class"] == "UNCERTAIN"
    assert d("i will kill you", "SAFE", 0.9)["class"] == "THREAT" and d("i will kill you", "SAFE", 0.9)["review"]
    assert d("you idiot", "SAFE", 0.9)["class"] == "UNCERTAIN" and d("you idiot", "SEVERE_ABUSE", 0.7)["class"] == "SEVERE_ABUSE"


def test_uniform_timing_skips_sparse_talk(spark):
    assert spam.uniform_timing(events(spark, every(10, 120_000, "x")), C.spam).count() == 0
    assert spam.uniform_timing(events(spark, every(20, 2000, "x")), C.spam).filter(F.col("confidence") > 0.8).count() > 0
