"""Abuse families, validation details, sinks, chains and feeds, with rows that reach the branches the given tables don't."""

import os
import random
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.helpers import START, codes, events
from tests.test_cases import SIGNALS
from tidewatch.config import CaseConfig, Config, CoordinationConfig, RiskConfig, SpamConfig
from tidewatch.functions import text as T
from tidewatch.operators import abuse, coordination, evasion, evidence, incidents, lexicon, policy, risk, shield, spam, validation
from tidewatch.sources import sinks

C, R, X = Config(), RiskConfig(), CaseConfig()

#: What each family should catch, and what it shouldn't.
CAUGHT = {
    "telling someone to harm themselves": ("please go and kill yourself", "end your own life", "do everyone a favour and disappear"),
    "wishing someone dead": ("i hope you die", "you ought to die", "i hope you get run over", "rot in hell"),
    "denying that people are human": ("you people are vermin", "refugees are a plague"),
    "hate by identity": ("all immigrants should be deported", "go back to your own country"),
    "sexual harassment": ("send me some nudes", "i want to undress you"),
    "saying that one will hurt someone": ("i will kill you", "i m going to really hurt your sister", "gonna break your legs", "i ll find you"),
    "weapons": ("i have a gun with your name", "bullet in your head"),
    "knowing where someone is": ("we know where your kids live", "i found out where you work", "i am outside your house"),
    "laying private data open": ("i will leak your home address", "i ll dox you"),
    "sending police to someone's door": ("i will swat you", "gonna send the police to your house"),
    "threats to a family": ("your mother is next", "your family will pay"),
    "warnings": ("your days are numbered", "you won t make it to the morning", "sleep with one eye open"),
}
NEAR_MISSES = (
    "the kids are next to their mother", "i will find the book for you", "we know where the library is", "the deadline is dead", "she works at the police station", "send me some notes", "my days are full",
    "go back to your seat", "all women should be paid the same", "i hope you like it", "what a killer tune", "the rats are in the house",
)


def test_every_family_has_hits_and_near_misses():
    lex = lexicon.Lexicon()
    assert set(CAUGHT) == set(lexicon.FAMILIES)
    for family, said in CAUGHT.items():
        tier = lexicon.FAMILIES[family][0]
        for text in said:
            assert re.search(lex.patterns[tier], text), (family, text)
    for text in NEAR_MISSES:
        assert not any(re.search(lex.patterns[t], text) for t in ("severe", "threat")), text


def test_mitigations_and_self_harm():
    found = lambda t: {n for n, p in lexicon.MITIGATIONS if re.search(p if n == "quotation" else lexicon.bounded(p), t)}
    cases = {
        "reported-speech": ("she said i will kill you", "he texted me that"), "quotation": ("he wrote “you are dead”",), "negated-intent": ("i would never hurt anyone", "i don t want to kill him"),
        "reporting-abuse": ("mods this guy threatened my friend", "i want to report him he abused her"), "self-directed": ("i am so stupid", "i hate myself"), "gaming-context": ("i will crush you in the next match", "kill the boss"),
    }
    for name, said in cases.items():
        assert all(name in found(t) for t in said), name
    assert found("you are an idiot") == found("good morning to all of you") == set()
    harm = lambda t: bool(re.search(lexicon.bounded(lexicon.SELF_HARM), t))
    assert harm("i just want to die") and harm("i keep thinking about suicide") and harm("there is no reason to live") and not harm("i want to dye my hair") and not harm("this game makes me want to live")


def test_lexicon_table(spark):
    rows = spark.createDataFrame([("mild", "word", "bad egg", "2"), ("threat", "phrase", "<will> .. ruin you", "2"), ("allow", "word", "trash", "2"), ("mild", "word", "old", "1")], "tier string, kind string, text string, version string")
    lex = lexicon.from_table(rows, "2")
    df = events(spark, [{"message": t} for t in ("what a bad egg you are", "i will surely ruin you", "you trash", "you old one", "you b a d e g g")])
    got = [r.decision["class"] for r in abuse.classify(spam.with_text_features(df), C.abuse, lex).orderBy("seq").collect()]
    assert got == ["ABUSIVE", "THREAT", "SAFE", "SAFE", "ABUSIVE"]


def test_obfuscated_and_benign_talk(spark):
    benign = ("that exam was shit", "he said you are an idiot", "i would never hurt you", "gg i will destroy you in the next round", "my brother called me stupid", "lovely weather")
    df = abuse.classify(spam.with_text_features(events(spark, [{"message": t, "at_ms": START + i * 20_000, "user_id": f"u{i % 4}"} for i, t in enumerate(benign)])), C.abuse)
    assert {r.decision["class"] for r in df.collect()} <= {"SAFE", "UNCERTAIN"}
    hidden = ("you id​iot", "you i d i o t", "you idiоt")
    df = abuse.classify(spam.with_text_features(events(spark, [{"message": t} for t in hidden])), C.abuse)
    assert "EVASION_FILTER_OBFUSCATION" in codes(abuse.signals(df, C.abuse)) and all(r.decision["class"] == "ABUSIVE" for r in df.collect())


def test_event_ids_and_metadata(spark):
    base = '"userId":"u","roomId":"r","timestamp":"2026-03-01T12:00:00Z","eventType":"message","message":"hi"'
    rows = [f'{{{base},"eventId":"{i}"}}' for i in ("good-1", "odd id!", "x" * 129)] + [f"{{{base}}}", f'{{{base},"eventId":5}}', '{%s,"metadata":{"n":1.5,"b":true,"s":" a\\u200bb  \\uff21 "}}' % base]
    raw = spark.createDataFrame([(i, 0, r) for i, r in enumerate(rows)], "batch_id long, idx int, raw string")
    got = validation.accepted(validation.validate(raw, F.lit(START))).orderBy("batch_id").selectExpr("event_id", "to_json(metadata) AS m").collect()
    assert len(got) == 6 and got[0].event_id == "good-1" and len({r.event_id for r in got[1:]}) == 1 and len(got[1].event_id) == 32
    assert got[5].m in ('{"n":1.5,"b":true,"s":"ab A"}', '{"b":true,"n":1.5,"s":"ab A"}')


def test_validation_limits(spark):
    fine = {"userId": "u", "roomId": "r", "timestamp": "2026-03-01T12:00:00Z", "eventType": "message"}
    import json

    cases = {
        ("roomId", "TOO_LONG"): {"roomId": "r" * 129}, ("clientVersion", "TOO_LONG"): {"clientVersion": "1" * 65}, ("message", "BAD_TYPE"): {"message": 5}, ("message", "TOO_LONG"): {"message": "\U0001f600" * 2001},
        ("metadata", "FORBIDDEN_KEY"): {"metadata": {"__proto__": 1}}, ("metadata", "BAD_VALUE"): {"metadata": {"a": [1]}}, ("metadata", "BAD_KEY"): {"metadata": {"a b": 1}}, ("metadata", "TOO_MANY_KEYS"): {"metadata": {f"k{i}": 1 for i in range(26)}},
        ("metadata", "BAD_TYPE"): {"metadata": "x"}, ("timestamp", "TOO_OLD"): {"timestamp": "2026-02-20T12:00:00Z"}, ("timestamp", "IN_FUTURE"): {"timestamp": "2026-03-01T12:03:00Z"}, ("messageIsTranscript", "BAD_TYPE"): {"messageIsTranscript": "no"},
    }
    raw = spark.createDataFrame([(i, 0, json.dumps(fine | c)) for i, c in enumerate(cases.values())], "batch_id long, idx int, raw string")
    got = {r.batch_id: [(x["field"], x["code"]) for x in r.issues] for r in validation.rejected(validation.validate(raw, F.lit(START))).collect()}
    assert got == {i: [c] for i, c in enumerate(cases)}
    odd = spark.createDataFrame([(0, 0, json.dumps(fine | {"platform": "toaster"}))], "batch_id long, idx int, raw string")
    assert {x["code"] for r in validation.warned(validation.validate(odd, F.lit(START))).collect() for x in r.warnings} == {"UNKNOWN_PLATFORM", "EMPTY_MESSAGE"}


def test_upsert_moves_between_days(spark, tmp_path):
    path = f"file://{tmp_path}/incidents"
    put = lambda *rows: sinks.upsert(spark.createDataFrame(list(rows), "id string, at_ms long, v int"), path, "id", "at_ms")
    day = 86_400_000
    put(("i1", START, 1), ("i2", START + day, 2))
    put(("i1", START + 2 * day, 9))  # its old day has no row any more
    read = lambda: sorted((r.id, r.v) for r in spark.read.parquet(path).collect())
    assert read() == [("i1", 9), ("i2", 2)]
    put(("i2", START + 2 * day, 3), ("i3", START, 4))
    assert read() == [("i1", 9), ("i2", 3), ("i3", 4)]


def test_near_duplicates_look_back_a_bounded_number(spark):
    c = SpamConfig(max_window_events=5, near_duplicate_min_length=4, near_duplicate_count=2, horizon_ms=10**9)
    texts = ["join the great giveaway today code 11111"] + [f"{w * 4} {w}" for w in ("alpha", "beta", "gamma", "delta", "omega")] + ["join the great giveaway today code 22222", "join the great giveaway today code 33333"]
    repeated = spam.with_repeats(spam.with_text_features(events(spark, [{"message": t, "at_ms": START + i} for i, t in enumerate(texts)])), c)
    assert [r.event_id for r in spam.near_duplicate(repeated, c).collect()] == ["e7"]  # six events back is too far for e6


def test_near_duplicates_against_brute_force(spark):
    random.seed(9)
    c = SpamConfig(max_window_events=6, near_duplicate_min_length=4, near_duplicate_count=2, horizon_ms=40)
    kinds = [f"{w} of the week number {n}" for w in ("offer", "offers", "message", "massage") for n in (1, 2, 12)]
    rows = [{"message": random.choice(kinds), "user_id": random.choice("AB"), "at_ms": START + random.randrange(150)} for _ in range(60)]
    featured = spam.with_repeats(spam.with_text_features(events(spark, rows)), c).collect()
    grams = lambda t: {f" {t} "[i : i + 3] for i in range(len(t))}
    like = lambda a, b: a == b or len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= c.near_duplicate_similarity
    want = {}
    for user in "AB":
        own = sorted((r for r in featured if r.user_id == user), key=lambda r: (r.at_ms, r.seq))
        for i, r in enumerate(own):
            n = 1 + sum(like(r.fp, o.fp) for o in own[max(0, i - 6) : i] if r.at_ms - o.at_ms <= c.horizon_ms)
            if n >= c.near_duplicate_count:
                want[r.event_id] = n
    got = spam.near_duplicate(spam.with_repeats(spam.with_text_features(events(spark, rows)), c), c).collect()
    assert {r.event_id: int(r.details["n"]) for r in got} == want and want


def test_synchronized_joins_against_brute_force(spark):
    random.seed(3)
    c = CoordinationConfig(join_window_ms=20, join_accounts=3, min_accounts=2, sweep_ms=100)
    base = START // 100 * 100
    rows = [{"at_ms": base + random.randrange(400), "event_type": "join", "user_id": f"u{random.randrange(6)}", "room_id": random.choice("ab")} for _ in range(120)]
    want = {}
    for room in "ab":
        for sweep in range(base, base + 400, 100):
            own = sorted((r["at_ms"], i, r["user_id"]) for i, r in enumerate(rows) if r["room_id"] == room and sweep <= r["at_ms"] < sweep + 100)
            for at, _, _ in own:
                near = [u for t, _, u in own if at <= t <= at + 20]
                if len(set(near)) >= 3:
                    want[room, sweep] = (at, sorted(set(near)))
                    break
    got = {(r.room_id, r.sweep_ms): (r.from_ms, r.user_ids) for r in coordination.synchronized_joins(events(spark, rows), c).collect()}
    assert got == want and want


def test_model_alone_and_rules_alone(spark):
    rows = [("u", "r", "a", START, 1, "ABUSE_SEVERE", "ABUSE", "HIGH", 0.95), ("u", "r", "b", START, 2, "GHOST_HIDDEN_PRESENCE_CORRELATED", "GHOST", "LOW", 0.95)]
    scored = risk.score_signals(spark.createDataFrame(rows, SIGNALS), R).withColumn("level", F.lit("CRITICAL"))
    got = {r.event_id: (r.restriction_status, r.notes) for r in policy.with_notes(policy.plan(scored, R, can_block=True)).collect()}
    assert got["a"][0] == "not_corroborated" and got["b"][0] == "recommended" and len(got["a"][1]) == 1
    threat = [("u", "r", "t", START, 1, "THREAT_LANGUAGE", "THREAT", "SEVERE", 0.2)]
    planned = policy.plan(risk.score_signals(spark.createDataFrame(threat, SIGNALS), R), R).first()
    assert planned.level != "CRITICAL" and "CREATE_INCIDENT" in planned.automated  # a threat opens an incident at any level
    noted = policy.with_capabilities(scored, {"hidden_presence": "unauthorized"}).first()
    assert noted.capability_notes == ["hidden_presence: not authorised to read"]


def test_hidden_presence_signals_and_statuses(spark):
    feed = spark.createDataFrame([("u", "r", START, "HIDDEN_JOIN", "ghost", 1), ("v", "s", START, "HIDDEN_JOIN", None, 2)], "user_id string, room_id string, at_ms long, kind string, mode string, seq long")
    talk = events(spark, [{"user_id": "u", "room_id": "r", "at_ms": START + i} for i in range(30)] + [{"user_id": "v", "room_id": "s", "at_ms": START}, {"user_id": "w", "room_id": "t", "at_ms": START}])
    found = evasion.presence_signals(talk, feed, START + 1000, C.evasion)
    r = found.collect()
    assert len(r) == 1 and r[0].code == "GHOST_HIDDEN_PRESENCE_CORRELATED" and r[0].concealment_mode == "ghost" and r[0].event_id == "e29" and len(r[0].evidence_ids) == 20
    status = lambda feed, found: {x.room_id: x.status for x in evasion.presence_status(talk, feed, found).collect()}
    assert status(feed, found) == {"r": "found", "s": "too_few_events", "t": "none_reported"} and set(status(None, None).values()) == {"insufficient"}
    assert evasion.with_feed_status(found, None).first().status == "insufficient"


def test_incident_reasons_metadata_and_log(spark):
    sig = spark.createDataFrame([("u", "r", "e0", START, 0, "SPAM_BURST", "SPAM", "HIGH", 0.9), ("u", "r", "e1", START + 5, 1, "THREAT_LANGUAGE", "THREAT", "SEVERE", 0.9)], SIGNALS)
    scored = risk.score_signals(sig, R)
    s = incidents.sessions(scored, X)
    said = events(spark, [{"message": "a"}, {"message": "b"}]).withColumns({"is_transcript": F.col("seq") == 1, "k": F.lit(7)})
    cases = incidents.with_metadata(incidents.build(s, sig, said, X), s, said).first()
    assert cases.reasons[0] == "[SPAM_BURST] high, confidence 0.9" and cases.model_versions == ["risk-1", "spam-1", "threat-1"]
    assert cases.metadata["platform"] == "ios" and cases.metadata["meta.k"] == "7" and cases.metadata["sourceIsTranscript"] == "true" and cases.metadata["deterministicOnly"] == "false" and cases.metadata["signalCount"] == "2"
    log = sorted(r.action_type for r in incidents.case_log(s, incidents.new_behaviours(s, sig, X)).collect())
    assert log == ["EVIDENCE_PRESERVED", "EVIDENCE_PRESERVED", "INCIDENT_CREATED", "INCIDENT_UPDATED"]


def test_chains_within_keys_and_keys_of_an_incident(spark):
    rows = [(f"i{n % 3}", "u", START + n, '{"schemaVersion":1,"n":%d}' % n) for n in range(9)]
    made = evidence.chain(spark.createDataFrame(rows, "incident_id string, user_id string, created_ms long, body string"))
    chained = spark.createDataFrame(made.collect(), made.schema).withColumn("tenant", F.lit("a"))
    both = chained.unionByName(chained.withColumn("tenant", F.lit("b")).filter("sequence <> 4"))
    bad = evidence.verify_chain(both, ["tenant"]).filter("size(problems) > 0").collect()
    assert [(r.tenant, r.sequence, r.problems) for r in bad] == [("b", 5, ["gap", "broken_link"])]
    keys = [r.key for r in evidence.keys_of("i1", chained).collect()]
    assert len(keys) == 3 and all("/i1/" in k for k in keys)
    plan = evidence.verify_chain(chained)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_shield_evidence_and_muted_set(spark):
    rows = [("l", "s", "r", f"e{i}", START + t, i, c, 0.9, f"call me at a{i}@b.org") for i, (t, c) in enumerate(((0, "THREAT"), (1000, "SAFE"), (2000, "ABUSIVE")))]
    df = spark.createDataFrame(rows, "listener_id string, speaker_id string, room_id string, event_id string, at_ms long, seq long, class string, confidence double, transcript string")
    offences = shield.with_offences(df, X)
    assert [r.total_offences for r in offences.orderBy("seq").collect()] == [1, 1, 2]
    kept = shield.evidence(offences, X).orderBy("seq").collect()
    assert len(kept) == 2 and kept[0].excerpt == "call me at [redacted-email]" and kept[0].redacted
    muted = shield.mute_intervals(shield.decisions(offences, X))
    at = spark.createDataFrame([("l", START - 1), ("l", START), ("l", START + 10**9)], "listener_id string, at_ms long")
    assert [r.speaker_ids for r in shield.muted_at(muted, at).orderBy("at_ms").collect()] == [[], ["s"], []]


def test_sql_functions(spark):
    assert "half_up" in T.register_functions(spark)
    r = spark.sql("SELECT half_up(2.345D, 2) a, saturate(5D, 4D, 8D) b, decay(8D, 10D, 10D) c, utf16_length('\U0001f600a') d, truncate_text('abcdef', 3) e, similarity(array('a','b'), array('b')) f, clamp(7D, 0D, 1D) g, event_handle('u') h, incident_name('u','r',0) i").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (2.35, 0.25, 4.0, 3, "ab…", 0.5, 1.0) and len(r.h) == 6 and r.i.startswith("INC-19700101-")


def test_imports_without_the_text_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in (("tidewatch/llm", "tests/llm"), ("tidewatch/llm", "tests/llm", "corpus_pipeline.py")):
        to = tmp_path / str(len(gone))
        shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
        for name in gone:
            path = to / name
            shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'spam_burst' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        done = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr


def test_working_tables_are_deleted(spark):
    from tidewatch.sources import shared

    with shared.working_tables(spark):
        shared.materialise(spark.range(3).toDF("x"), "gone").count()
        path = shared._open[-1][0]
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_messages_are_read_once_and_events_carry_no_text(spark, sf):
    """What is found of a message is made from the table of documents, not from each event that says it, with the same signals."""
    from tidewatch.plans import queries
    from tidewatch.sources.telemetry import telemetry

    rows = queries.featured(spark, sf, "odd", "links", "hits")
    assert not {"message", "normalized", "fp", "forms"} & set(rows.columns)
    whole = spam.with_text_features(telemetry(spark, sf))
    key = ["event_id", "fp_key", "fp_length", "mentions"]
    assert sorted(map(str, rows.select(*key).collect())) == sorted(map(str, whole.select(*key).collect()))
    read = lambda df: sorted(map(str, df.drop("details").collect()))
    assert read(spam.suspicious_characters(rows)) == read(spam.suspicious_characters(whole))
    assert read(spam.link_flood(rows, queries.S)) == read(spam.link_flood(whole, queries.S))
    assert read(abuse.signals(abuse.classify(rows, queries.A), queries.A)) == read(abuse.signals(abuse.classify(whole, queries.A), queries.A))


def test_a_decision_is_computed_once(spark):
    """The filter on a decision does not repeat the decision for each mention: the plan stays short."""
    df = abuse.signals(abuse.classify(spam.with_text_features(events(spark, [{"message": "you idiot"}])), C.abuse), C.abuse)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(filter(") <= 6 and codes(df) == {"ABUSE_LANGUAGE", "ABUSE_TARGETED_HARASSMENT"}


def test_the_chain_is_verified_from_what_was_written(spark, sf):
    """Verification looks at the chain three times; none of them makes the incidents and their excerpts again."""
    from tidewatch.plans import queries

    assert not any("testdata" in f for f in queries.evidence_chain(spark, sf).inputFiles())


def test_messages_apart_are_judged_as_those_in_their_rows(spark):
    """Each text is measured and cleaned once, not for each row that says it; issues, ids and clean texts are those of rows that hold it."""
    from tidewatch.sources.telemetry import raw_events

    said = ["hi", "hi", " a​b  Ａ ", "", "  ", None, "x" * 4000, "\U0001f600" * 2001, 'quo"te\n\\']
    rows = spark.createDataFrame([(i, i, "u", "r", START, "message", t, "4.2.1", "ios", 1, 1.5) for i, t in enumerate(said)], "number long, seq long, user_id string, room_id string, at_ms long, event_type string, message string, client_version string, platform string, k long, value double")
    rows = rows.withColumn("number", F.lit(None).cast("long"))
    apart = raw_events(validation.message_facts(rows))
    assert "x" * 9 not in "".join(r.raw for r in apart.collect())
    want, got = ([r.asDict(True) for r in validation.validate(df, F.col("at_ms")).drop("raw", "metadata").orderBy("seq").collect()] for df in (raw_events(rows), apart))
    assert got == want and [len(r["issues"]) for r in want] == [0, 1, 0, 0, 1, 1, 0, 1, 0] and want[2]["message"] == "ab A"


def test_a_tasks_share_of_events_stays_the_same(spark):
    """Events are dealt by user into partitions that grow with them, whatever spark.sql.shuffle.partitions says; windows need no other shuffle."""
    from tidewatch.plans.queries import _dealt

    rows = spark.range(1_500_000).selectExpr("id % 999 AS user_id", "id AS at_ms", "id AS seq")
    assert _dealt(rows).rdd.getNumPartitions() == 10 and _dealt(rows.limit(100)).rdd.getNumPartitions() == 1
    summed = _dealt(rows, "at_ms", "seq").withColumn("n", F.sum("seq").over(W.partitionBy("user_id", "at_ms").orderBy("seq")))
    plan = summed._jdf.queryExecution().sparkPlan().toString() + summed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 0
