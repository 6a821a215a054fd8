"""Queries of plans.outcomes against their SQL and brute force; mute intervals against a fold."""

import random
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import START
from tidewatch.config import WIDE, CaseConfig
from tidewatch.operators import alerts, evidence, shield
from tidewatch.plans import outcomes


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(lambda x: x.notna(), None)
    rows = [tuple(round(float(v), 9) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False, name=None)]
    return list(frame.columns), sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    made = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        made.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return made


@pytest.mark.parametrize("name", sorted(outcomes.SQL))
def test_equals_sql(spark, sf, duck, name):
    got, want = outcomes.QUERIES[name](spark, sf).toPandas(), duck.execute(outcomes.SQL[name]).df()
    assert canonical(got) == canonical(want)


def test_excerpts(spark, sf):
    """Every abusive utterance once, no address left, 280 characters at most."""
    rows = outcomes.shield_excerpts(spark, sf).collect()
    abusive = shield.with_offences(outcomes._utterances(spark, sf), WIDE.case).filter("abusive").count()
    assert len(rows) == abusive and all(len(r.excerpt) <= 280 and not re.search(r"\w@\w+\.\w", r.excerpt) for r in rows)


def test_mute_intervals_equal_a_fold(spark):
    """Who is muted after each utterance, as a listener who keeps one state a speaker would say."""
    rng, c = random.Random(5), CaseConfig()
    rows = []
    for seq in range(400):
        kind = rng.choices(("talk", "clear", "block"), (30, 2, 1))[0]
        rows.append((f"l{seq % 2}", f"s{rng.randrange(4)}", f"e{seq}", START + seq * rng.choice((60_000,)), seq, rng.choice(("SAFE", "SAFE", "ABUSIVE", "SEVERE_ABUSE")) if kind == "talk" else "SAFE", rng.choice((0.5, 0.9)), kind == "clear", kind == "block"))
    df = spark.createDataFrame(rows, "listener_id string, speaker_id string, event_id string, at_ms long, seq long, class string, confidence double, cleared boolean, blocked boolean")
    decided = shield.decisions(shield.with_offences(df, c), c)
    spans = shield.mute_intervals(decided)
    got = {(r.listener_id, r.at_ms): r.speaker_ids for r in shield.muted_at(spans, df).collect()}
    state, want = {}, {}
    for r in decided.orderBy("seq").collect():
        key = (r.listener_id, r.speaker_id)
        until = {"LOCAL_BLOCK": float("inf"), "LOCAL_MUTE": r.muted_until_ms, "CLEARED": 0}.get(r.action)
        state[key] = state.get(key, 0) if until is None else until
        want[r.listener_id, r.at_ms] = sorted(s for (li, s), t in state.items() if li == r.listener_id and t > r.at_ms)
    assert got == want and any(len(v) > 1 for v in want.values()) and any(not v for v in want.values())
    by = {}
    for r in spans.collect():
        by.setdefault((r.listener_id, r.speaker_id), []).append((r.from_ms, r.to_ms or 2**63))
    assert all(a[1] < b[0] or a[1] == b[0] for x in by.values() for a, b in zip(sorted(x), sorted(x)[1:])) and any(r[-1][1] == 2**63 for r in map(sorted, by.values()))
    assert shield.mute_intervals(decided.limit(0)).count() == 0


def test_muted_sets_do_not_travel(spark):
    """200 speakers muted at 300 times: what is shuffled are intervals and times, not their pairs; overlapping intervals end once."""
    spans = spark.range(200).selectExpr("'l' AS listener_id", "concat('s', id) AS speaker_id", "explode(array(id * 1000, id * 1000 + 50000)) AS from_ms", "CASE WHEN id % 2 = 0 THEN 25000000L ELSE id * 1000 + 60000 END AS to_ms")
    times = spark.range(300).selectExpr("'l' AS listener_id", "id * 100000 AS at_ms")
    store = spark._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (x.apply(i) for x in [store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)] for i in range(x.size()))}
    before = stages()
    got = {r.at_ms: r.speaker_ids for r in shield.muted_at(spans, times).collect()}
    spent = sum(n for stage, n in stages().items() if stage not in before)
    spans = spans.collect()
    assert got == {t: sorted({r.speaker_id for r in spans if r.from_ms <= t < r.to_ms}) for t in range(0, 30_000_000, 100_000)}
    assert sum(map(len, got.values())) > 20_000 and spent < 5000
    told = {r.at_ms: r.speaker_ids for r in shield.muted_at(spark.createDataFrame(spans), times, "|").collect()}
    assert told == {t: "|".join(v) for t, v in got.items()}


def test_evidence_states_its_sources(spark):
    row = [("i", "u", "r", START, 80, "CRITICAL", ["SPAM_BURST"], None)]
    cases = spark.createDataFrame(row, "incident_id string, user_id string, room_id string, created_ms long, risk_score int, risk_level string, behaviors array<string>, messages array<struct<excerpt:string>>")
    read = lambda df: df.select(F.from_json("body", "collected array<string>, notCollected array<string>").alias("x")).first().x
    plain, told = read(evidence.bodies(cases)), read(evidence.bodies(cases, {"hidden_presence": "available", "attestation": "disabled"}))
    assert plain.collected == list(evidence.COLLECTED) and plain.notCollected == list(evidence.NOT_COLLECTED)
    assert told.collected == [*plain.collected, "hidden_presence"] and told.notCollected == [*plain.notCollected, "attestation: disabled"]


def test_calls_for_care_are_sent_once_a_window(spark):
    c = CaseConfig()
    calls = spark.createDataFrame(pd.DataFrame({"user_id": ["u", "u", "u", "v"], "room_id": "r", "event_id": list("abcd"), "at_ms": [START, START + 1, START + c.alert_window_ms, START], "seq": range(4)}))
    sent = alerts.sent(alerts.wellbeing(calls), c.alert_window_ms).orderBy("event_id").collect()
    assert [(r.key, r.event_id) for r in sent] == [("wellbeing:u", "a"), ("wellbeing:u", "c"), ("wellbeing:v", "d")]
