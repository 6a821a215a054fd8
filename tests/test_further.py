"""Sources, sinks and operators of the later rounds against brute force or scenario rows."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import START, events, every
from tidewatch.config import CaseConfig, Config, RiskConfig
from tidewatch.functions import hashing as H
from tidewatch.functions import text as TX
from tidewatch.operators import client, coordination, incidents, policy, risk, spam
from tidewatch.sources import events as E
from tidewatch.sources import sinks
from tidewatch.sources.snapshots import Snapshots

ROW = "id string, at_ms long, score int"


def scores(df):
    return {r.id: r.score for r in df.collect()}


def test_snapshots(spark, tmp_path):
    """Latest of several rows of a key, keys that change their day, old versions, a crash before the commit, two writers, vacuum."""
    day = 86_400_000
    made = lambda *rows: spark.createDataFrame(rows, ROW)
    table = Snapshots(spark, f"file://{tmp_path}/t", "id", "at_ms")
    empty = made().limit(0)
    assert table.read(empty).count() == 0 and table.versions() == []
    assert table.upsert(made(("a", START, 1), ("a", START + 5, 2), ("a", START + 3, 3), ("b", START, 4), ("c", START + day, 5))) == 1
    assert scores(table.read(empty)) == {"a": 2, "b": 4, "c": 5}
    assert table.upsert(made(("a", START + day, 6), ("d", START + 2 * day, 7))) == 2
    assert scores(table.read(empty)) == {"a": 6, "b": 4, "c": 5, "d": 7} and scores(table.read(empty, 1)) == {"a": 2, "b": 4, "c": 5}
    assert scores(table.read(empty, days=[max(table.days())])) == {"d": 7}
    assert table.upsert(made(("d", START, 8))) == 3 and len(table.days()) == 2  # the last row of its day moves: the day goes
    lost = table.write(made(("a", START, 99)))  # dies before its commit
    assert lost and scores(table.read(empty)) == {"a": 6, "b": 4, "c": 5, "d": 8}
    with pytest.raises(Exception, match="exist"):
        table.commit(table.days(), 2)  # another writer was first
    before = scores(table.read(empty))
    assert table.vacuum() >= 2 and table.versions() == [3] and scores(table.read(empty)) == before
    equal = [("e", START, 1), ("e", START, 2)]
    table.upsert(made(*equal))
    first = scores(table.read(empty))["e"]
    table.upsert(made(*equal[::-1]))
    assert scores(table.read(empty))["e"] == first


def test_upsert_keeps_the_latest_row_of_a_key(spark, tmp_path):
    df = spark.createDataFrame([("i", START, 1), ("i", START + 9, 2), ("i", START + 4, 3)], "incident_id string, updated_ms long, score int")
    sinks.upsert(df, f"{tmp_path}/i", "incident_id", "updated_ms")
    sinks.upsert(df, f"{tmp_path}/i", "incident_id", "updated_ms")
    assert [r.score for r in spark.read.parquet(f"{tmp_path}/i").collect()] == [2]


def test_config_as_of_many_versions(spark):
    r = random.Random(5)
    times = [r.randrange(2000) for _ in range(3000)]
    marks = [(f"v{i:04}", f"p{i}", r.randrange(50, 2000)) for i in range(900)]
    got = E.config_at(spark.createDataFrame([(i, t, "x") for i, t in enumerate(times)], "id int, at_ms long, _at string").repartition(7), spark.createDataFrame(marks, "version string, patch string, updated_ms long")).collect()
    for row in got:
        best = max(((t, v, p) for v, p, t in marks if t <= times[row.id]), default=(None, None, None))
        assert (row.config_version, row.config_patch) == best[1:]
    assert len(got) == 3000
    none = E.config_at(spark.createDataFrame([(1,)], "at_ms long"), spark.createDataFrame([], "version string, patch string, updated_ms long")).first()
    assert none.config_version is None


def test_no_nested_loop_in_config_as_of(spark):
    plan = E.config_at(spark.range(10).select(F.col("id").alias("at_ms")), spark.createDataFrame([("1", "p", 4)], "version string, patch string, updated_ms long"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_json(x):
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{brute_json(v)}" for k, v in sorted(x.items()) if v is not None) + "}"
    if isinstance(x, list):
        return "[" + ",".join(brute_json(v) for v in x) + "]"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else str(x)
    return json.dumps(x, ensure_ascii=False)


def test_canonical_json_over_three_levels(spark):
    pairs = T.ArrayType(T.StructType().add("q", "integer").add("c", "string"))
    inner = T.StructType().add("y", T.MapType(T.StringType(), pairs)).add("x", "boolean").add("é", T.MapType(T.StringType(), T.DoubleType()))
    kind = T.StructType().add("z", "string").add("b", "double").add("a", inner)
    rows = [
        ("t\"\\\n\u0001é😀", 3.0, {"y": {"k2": [{"q": 1, "c": None}, None], "k1": [], "k3": None}, "x": True, "é": {"b": 1.5, "a": 2.0}}),
        (None, None, None), ("", -0.25, {"y": None, "x": None, "é": {}}),
    ]
    df = spark.createDataFrame(rows, kind)
    got = [r.j for r in df.select(H.canonical_row(df).alias("j")).collect()]
    want = [brute_json({"z": z, "b": b, "a": a}) for z, b, a in rows]
    assert [g.replace("\\u0001", "\\u0001") for g in got] == want
    v = spark.sql("""select parse_json('{"b": {"d": 1, "c": [true, null]}, "a": "x"}') as v""")
    assert v.select(H.canonical(F.col("v"), T.VariantType()).alias("j")).first().j == '{"a":"x","b":{"c":[true,null],"d":1}}'


def test_distinct_counts_by_intervals(spark):
    r = random.Random(3)
    rows = [{"at_ms": START + r.randrange(4000) // 7 * 7, "user_id": r.choice("AB"), "client_version": r.choice(["1", "2", "3", "4", None])} for _ in range(300)]
    for width in (0, 50, 700):
        got = client.with_distinct(events(spark, rows).withColumn("_change", F.lit("own")), F.col("client_version"), width, "n").collect()
        assert len(got) == 300 and all(x["_change"] == "own" for x in got)
        for x in got:
            assert x.n == len({y["client_version"] for y in rows if y["user_id"] == x.user_id and x.at_ms - width <= y["at_ms"] <= x.at_ms} - {None})


def test_evidence_lists_are_bounded(spark):
    r = random.Random(2)
    rows = [{"at_ms": START + i // 2 * 900, "user_id": r.choice("AB"), "event_type": r.choice(["message", "voice", "join"])} for i in range(200)]
    df = events(spark, rows)
    some = df.filter(F.col("seq") % 3 == 0).select("event_id", "user_id")
    got = {x.event_id: x.evidence_ids for x in spam.with_evidence(some, df, 20_000).collect()}
    for i in range(0, 200, 3):
        own = [f"e{j}" for j in range(i + 1) if rows[j]["user_id"] == rows[i]["user_id"] and rows[j]["event_type"] != "join"][-20:]
        assert got[f"e{i}"] == [e for e in own if rows[int(e[1:])]["at_ms"] >= rows[i]["at_ms"] - 20_000]


def test_incident_lifecycle(spark):
    c, hour = CaseConfig(), 3_600_000
    near, far = c.incident_gap_ms, c.incident_gap_ms + 1
    hits = [(START, 60), (START + 10, 60), (START + 20, 80), (START + 40, 80), (START + 50, 90), (START + 70, 95), (START + 70 + near, 50), (START + 71 + near + far, 50)]
    serious = spark.createDataFrame([("u", "r", at, i, s, "HIGH" if s < 75 else "CRITICAL") for i, (at, s) in enumerate(hits)] + [("w", "r", START, 1, 60, "HIGH")], "user_id string, room_id string, at_ms long, seq long, score int, level string")
    said = [(START - hour, "RESOLVED", "no incident as yet"), (START + 30, "ACKNOWLEDGED", "looked at it"), (START + 35, "RESOLVED", "short"), (START + 45, "ACKNOWLEDGED", "once more, no change"), (START + 60, "FALSE_POSITIVE", "nothing in it"), (START + 65, "OPEN", "closed ones stay closed")]
    reviews = spark.createDataFrame([("u", "r", *x) for x in said], "user_id string, room_id string, at_ms long, status string, note string")
    got = incidents.lifecycle(serious, reviews, c).filter("user_id = 'u'").orderBy("at_ms").collect()
    # the acknowledged one isn't reopened by 80 again, but by 90
    assert [(r.at_ms - START, r.change, r.status, r.risk_score) for r in got] == [
        (0, "OPENED", "OPEN", 60), (10, "UPDATED", "OPEN", 60), (20, "ESCALATED", "OPEN", 80), (30, "ACKNOWLEDGED", "ACKNOWLEDGED", 80), (40, "UPDATED", "ACKNOWLEDGED", 80),
        (50, "REOPENED", "OPEN", 90), (60, "CLOSED", "FALSE_POSITIVE", 90), (70, "OPENED", "OPEN", 95), (70 + near, "UPDATED", "OPEN", 95), (71 + near + far, "OPENED", "OPEN", 50),
    ]
    assert len({r.incident_id for r in got}) == 3


def test_coordination_reaches_the_next_assessment(spark):
    c = Config().coordination
    base = START // c.sweep_ms * c.sweep_ms
    text = "everyone come to the new server right now and bring friends"
    rows = [{"at_ms": base + i, "user_id": f"u{i}", "message": text} for i in range(4)]
    rows += [{"at_ms": base + c.sweep_ms, "user_id": "u0", "room_id": "else"}, {"at_ms": base + c.sweep_ms + 5, "user_id": "u0"}, {"at_ms": base + 10**7, "user_id": "u1"}, {"at_ms": base + 99, "user_id": "u2"}]
    df = events(spark, rows)
    found = coordination.findings(spam.with_text_features(df), c)
    got = {(r.user_id, r.event_id, r.code, r.room_id) for r in coordination.as_signals(found, df, c).collect()}
    assert got == {("u0", "e4", "COORDINATED_IDENTICAL_CONTENT", "else"), ("u1", "e6", "COORDINATED_IDENTICAL_CONTENT", "ABC123")}


def test_plans_say_whether_rules_alone_decided(spark):
    c = RiskConfig()
    made = [("e1", "THREAT_LANGUAGE", 0.95), ("e1", "ABUSE_SEVERE", 0.95), ("e1", "ABUSE_LANGUAGE", 0.9), ("e2", "SPAM_BURST", 0.9), ("e2", "SPAM_HIGH_FREQUENCY", 0.95), ("e2", "SPAM_IDENTICAL_REPEAT", 0.95), ("e2", "BOT_UNIFORM_TIMING", 0.9)]
    signals = spark.createDataFrame([("u", "r", e, START, i, code, "HIGH", x) for i, (e, code, x) in enumerate(made)], "user_id string, room_id string, event_id string, at_ms long, i int, code string, severity string, confidence double").withColumn("seq", F.lit(1).cast("long")).drop("i")
    got = {r.event_id: r for r in policy.plan(risk.score_signals(signals, c), c, can_block=True).collect()}
    assert got["e1"].restriction_status == "not_corroborated" and not got["e1"].deterministic_only and "CREATE_INCIDENT" in got["e1"].automated
    assert got["e2"].restriction_status == "recommended" and got["e2"].deterministic_only


def test_stable_texts_need_no_normal_form(spark):
    import unicodedata

    stable = "".join(map(chr, range(0x80))) + "".join(map(chr, range(0xC0, 0x100))) + "–—‘’“”"
    r = random.Random(1)
    odd = ["é", "ﬁx", "ａｂｃ", "x²", "a b", "…"]
    texts = ["".join(r.choice(stable) for _ in range(60)) for _ in range(50)] + odd
    assert all(unicodedata.normalize("NFKC", t) == t for t in texts[:50])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(TX.sanitize_visible(F.col("t")).alias("a"), TX.visible(TX.nfkc(F.col("t"))).alias("b")).collect()
    assert all(x.a == x.b for x in got)


def test_identical_repeat_without_text_features(spark):
    df = events(spark, every(6, 1000, "hello hello hello hello")).withColumn("fp", F.lit("hello hello hello hello"))
    assert spam.identical_repeat(spam.with_repeats(df, Config().spam), Config().spam).count() == 3
