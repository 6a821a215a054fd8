import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import START, every, events
from tidewatch.config import Config, RiskConfig
from tidewatch.operators import coordination, incidents, risk, spam, validation
from tidewatch.sources import events as E
from tidewatch.sources import sinks
from tidewatch.streaming import pipelines as P


def stream(spark, df, folder, batches=2):
    for i, part in enumerate(df.randomSplit([1.0] * batches, 7) if batches > 1 else [df]):
        part.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_history_as_a_stream(spark, tmp_path):
    rows = [("u" if i % 3 else "v", f"e{i}", START + i * 10**6, i, 20.0 * (i % 4), i % 3, i % 11 == 0, i % 7 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, event_id string, at_ms long, seq long, signal_total double, n_contributions long, severe boolean, evading boolean")
    want = {r.event_id: (r.score, r.level) for r in risk.user_history(df, RiskConfig()).collect()}
    for i, part in enumerate((df.filter("seq < 30"), df.filter("seq >= 30"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    got = drain(P.user_history(spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), RiskConfig()), "history")
    assert {r.event_id: (r.score, r.level) for r in got.collect()} == want


def test_dedupe_sweep_and_sessions(spark, tmp_path):
    c = Config()
    text = "everyone come to the new server right now and bring friends"
    base = START // 300_000 * 300_000
    df = spam.with_text_features(events(spark, [{"at_ms": base + i * 1000, "user_id": f"u{i}", "message": text} for i in range(4)] + [{"at_ms": base + 3_600_000, "message": "something else, later, that moves the watermark on"}])).drop("forms")
    df = spark.createDataFrame(df.collect(), df.schema)
    twice = df.unionByName(df)
    live = P.with_time(stream(spark, twice, f"{tmp_path}/a", 1))
    assert drain(P.dedupe(live), "deduped").count() == 5
    swept = drain(P.sweep(P.with_time(stream(spark, df, f"{tmp_path}/b", 1)), c), "swept").collect()
    batch = coordination.identical_content(df, c.coordination).collect()
    assert [(r.sweep_ms, r.n) for r in swept] == [(r.sweep_ms, r.n) for r in batch] == [(base, 4)]
    serious = spark.createDataFrame([("u", "r", f"e{i}", START + t, i, 60, "HIGH") for i, t in enumerate((0, 1_800_000, 3_600_001, 10**8))], "user_id string, room_id string, event_id string, at_ms long, seq long, score int, level string")
    live = drain(P.incident_sessions(P.with_time(stream(spark, serious, f"{tmp_path}/c", 1)), c), "sessions").collect()
    want = incidents.sessions(serious, c.case).groupBy("incident_id").agg(F.min("at_ms").alias("a"), F.count("*").alias("n")).collect()
    assert {(r.created_ms, r.n_events) for r in live} <= {(r.a, r.n) for r in want} and len(live) >= 2


def test_envelopes_and_validation(spark):
    good = {"userId": "a", "roomId": "r", "timestamp": "2026-03-01T12:00:00Z", "eventType": "message", "message": "hi​ there"}
    bodies = [json.dumps(good), json.dumps({"events": [good, {**good, "userId": ""}]}), "[1]", "7", "{broken", json.dumps({"events": 5})]
    one, bad = E.envelopes(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert one.count() == 3 and bad.count() == 4
    cases = [
        (good, []), (good, ["DUPLICATE_IN_BATCH"]), ({**good, "userId": "x" * 129}, ["TOO_LONG"]), ({**good, "roomId": 5}, ["MISSING"]), ({**good, "timestamp": "2026-03-09T12:00:00Z"}, ["IN_FUTURE"]),
        ({**good, "timestamp": "2026-02-01T12:00:00Z"}, ["TOO_OLD"]), ({**good, "eventType": "x"}, ["NOT_ALLOWED"]), ({**good, "message": 5}, ["BAD_TYPE"]), ({**good, "message": "x" * 4001}, ["TOO_LONG"]),
        ({**good, "metadata": [1]}, ["BAD_TYPE"]), ({**good, "metadata": {"a b": 1}}, ["BAD_KEY"]), ({**good, "metadata": {"a": {"b": 1}}}, ["BAD_VALUE"]), ({**good, "metadata": {"constructor": 1}}, ["FORBIDDEN_KEY"]),
        ({**good, "metadata": {f"k{i}": i for i in range(26)}}, ["TOO_MANY_KEYS"]), ({**good, "messageIsTranscript": "yes"}, ["BAD_TYPE"]), ({**good, "zzz": 1, "eventId": "!"}, ["UNKNOWN_FIELD"]), ({**good, "eventId": "own", "metadata": {"a": 1, "b": "x", "c": True}}, []),
    ]
    raw = spark.createDataFrame([(1, i, json.dumps(e)) for i, (e, _) in enumerate(cases)] + [(2, 0, "[]"), (2, 1, "nonsense")], "batch_id long, idx int, raw string")
    done = validation.validate(raw, F.lit(1_772_366_400_000))
    got = {(r.batch_id, r.idx): [x.code for x in r.issues] for r in done.collect()}
    for i, (_, want) in enumerate(cases):
        assert got[(1, i)] == want, i
    assert got[(2, 0)] == got[(2, 1)] == ["NOT_AN_OBJECT"]
    ok = validation.accepted(done).orderBy("idx").collect()
    assert ok[0].message == "hi there" and len(ok[0].event_id) == 32 and ok[1].event_id == "own"


def test_feeds(spark):
    said = ['```json\n{"classification": "abusive", "confidence": 0.7, "reason": "rude"}\n```', 'sure: {"classification":"SAFE","confidence":1.5,"reason":"x"}', '{"classification":"ODD","confidence":0.5,"reason":"x"}', "no", '{"classification":"SAFE","confidence":0.5,"reason":" "}']
    got = E.parse_verdicts(spark.createDataFrame(list(enumerate(said)), "event_id int, completion string")).collect()
    assert [(r.event_id, r.classification, r.confidence) for r in got] == [(0, "ABUSIVE", 0.7)]
    configs = spark.createDataFrame([("1", "{}", 10), ("2", "{}", 20)], "version string, patch string, updated_ms long")
    at = spark.createDataFrame([(5,), (10,), (19,), (20,)], "at_ms long")
    assert [r.config_version for r in E.config_at(at, configs).orderBy("at_ms").collect()] == [None, "1", "1", "2"]


def test_sinks(spark, tmp_path):
    df = events(spark, every(5, 10**7, "x"))
    assert sinks.event_sink(df, f"{tmp_path}/e") == (5, 0) and sinks.event_sink(df, f"{tmp_path}/e") == (0, 5)
    assert spark.read.parquet(f"{tmp_path}/e").count() == 5
    audit = df.select(F.col("event_id").alias("audit_id"), "at_ms")
    assert sinks.audit_sink(audit, f"{tmp_path}/a") == (5, 0)
    with pytest.raises(ValueError):
        sinks.audit_sink(audit.limit(1), f"{tmp_path}/a")
    inc = spark.createDataFrame([("i1", START, 1), ("i2", START, 1)], "incident_id string, updated_ms long, score int")
    sinks.upsert(inc, f"{tmp_path}/i", "incident_id", "updated_ms")
    sinks.upsert(spark.createDataFrame([("i1", START + 86_400_000, 9)], inc.schema), f"{tmp_path}/i", "incident_id", "updated_ms")
    assert {r.incident_id: r.score for r in spark.read.parquet(f"{tmp_path}/i").collect()} == {"i1": 9, "i2": 1}
    spark.range(1).select(sinks.expiry_stamp(F.lit(1500), 1).alias("s")).first().s == 86_401


def test_detectors_as_a_stream(spark, tmp_path):
    """The same signals as one batch over everything, also if a micro-batch is written twice."""
    import random

    from tidewatch.config import resolve

    random.seed(8)
    c = resolve({"client": {"known_versions": ["4.2.1"], "min_telemetry_events": 3}})
    rows = [{"at_ms": START + i * 700, "user_id": random.choice("AB"), "event_type": random.choice(["message", "message", "join", "leave"]), "message": random.choice(["buy gold now", "hello to all", None]), "client_version": random.choice(["4.2.1", "4.2.2", "4.3.0"])} for i in range(150)]
    df = events(spark, rows)
    df = spark.createDataFrame(df.collect(), df.schema)
    detect = P.user_detectors(c)
    key = lambda r: (r.event_id, r.code, r.severity, r.confidence)
    want = sorted(key(r) for r in detect(df).collect())
    write = P.detect_batches(f"file://{tmp_path}/state", detect, c.spam.horizon_ms)
    for i in range(3):
        df.filter((F.col("seq") >= 50 * i) & (F.col("seq") < 50 * i + 50)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = live.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    write(df.filter("seq >= 100"), 2)  # once more
    got = sorted(key(r) for r in spark.read.parquet(f"file://{tmp_path}/state/signals").collect())
    assert got == want and len({k[1] for k in want}) >= 4
