"""Streams with state against the batch operators, whatever the order of arrival and after a restart."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.helpers import START, events
from tidewatch.config import resolve
from tidewatch.operators import client, coordination, evasion, risk, spam
from tidewatch.streaming import pipelines as P
from tidewatch.streaming import stateful as S

C = resolve(
    {
        "spam": {"burst_count": 4, "high_frequency_count": 6, "sustained_count": 9, "max_window_events": 20, "mentions_per_window": 5, "mentions_per_message": 3, "identical_repeat_count": 3},
        "client": {"known_versions": ["4.2.1"], "min_telemetry_events": 1}, "evasion": {"rejoin_count": 2},
    }
)


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def made(spark, n, seed, users="AB"):
    r = random.Random(seed)
    at, rows = START, []
    for _ in range(n):
        at += r.choice([0, 0, 300, 900, 900, 4000, 9000, 30_000, 200_000])
        rows.append({"at_ms": at, "user_id": r.choice(users), "room_id": r.choice("RS"), "event_type": r.choice(["message", "message", "voice", "join", "leave"]), "message": r.choice(["buy gold now at the shop", "hi", "@abc @bcd @cde @def look", None]), "client_version": r.choice(["4.2.1", "4.2.2", "4.3.0", None]), "platform": r.choice(["ios", "web", "unknown"])})
    featured = spam.with_text_features(events(spark, rows)).drop("forms", "normalized")
    return spark.createDataFrame(featured.collect(), featured.schema), rows


def batch_scores(df):
    rated, repeated = spam.with_rates(df, C.spam), spam.with_repeats(df, C.spam)
    parts = [
        spam.burst(rated, C.spam), spam.high_frequency(rated, C.spam), spam.sustained_rate(rated, C.spam), spam.identical_repeat(repeated, C.spam), spam.mention_flood(rated, C.spam),
        client.version_flapping(df, C.client, C.spam.horizon_ms), client.platform_mismatch(df, C.client, C.spam.horizon_ms), evasion.rejoin_cycling(df, C.evasion),
    ]
    scored = risk.score_signals(reduce(DataFrame.unionByName, parts), C.risk)
    folded = risk.user_history(risk.fold_input(scored), C.risk).join(scored.select("event_id", "codes"), "event_id")
    return sorted((r.user_id, r.event_id, tuple(r.codes), r.score, r.level, r.history, r.repeat_bonus, r.violations, r.evasions) for r in folded.collect())


def last(df, at):
    """A row of a user of its own that moves the watermark past everything."""
    row = df.limit(1).withColumns({"user_id": F.lit("zz"), "event_id": F.lit(f"end{at}"), "at_ms": F.lit(at), "event_type": F.lit("leave"), "seq": F.lit(10**6), "fp": F.lit(None).cast("string"), "mentions": F.lit(0)})
    return df.sparkSession.createDataFrame(row.select(*df.columns).collect(), df.schema)


def run(spark, out, folder, name):
    """Until all input is through; into a Parquet table, from the checkpoint if there is one."""
    q = out.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-check").start()
    q.processAllAvailable()
    dropped = S.dropped_rows(q)
    q.stop()
    return dropped


def test_user_scores_equal_the_batch_in_any_order_and_after_a_restart(spark, store, tmp_path):
    df, _ = made(spark, 260, 4)
    want = batch_scores(df)
    assert {c for r in want for c in r[2]} == set(S.ROLLING)
    end = df.agg(F.max("at_ms")).first()[0]
    order = list(range(260))
    r = random.Random(1)
    for i in range(0, 260, 60):  # arrive out of order within what the watermark allows
        part = order[i : i + 60]
        r.shuffle(part)
        order[i : i + 60] = part
    turns = [order[i : i + 70] for i in range(0, 260, 70)]
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    scores = lambda: S.user_scores(source(), C, late="3 hours")
    for k, turn in enumerate(turns):
        df.filter(F.col("seq").isin(turn)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if k == 1:
            run(spark, scores(), tmp_path, "scores")  # stops here; the next run goes on from the checkpoint
    last(df, end + 10**8).coalesce(1).write.parquet(f"{tmp_path}/in/end")
    assert run(spark, scores(), tmp_path, "scores") == 0
    got = sorted((r.user_id, r.event_id, tuple(r.codes), r.score, r.level, r.history, r.repeat_bonus, r.violations, r.evasions) for r in spark.read.schema(S.SCORES).parquet(f"{tmp_path}/scores").collect())
    assert got == want
    # what comes after the watermark is dropped and counted
    df.limit(3).coalesce(1).write.parquet(f"{tmp_path}/in/late")
    assert run(spark, scores(), tmp_path, "scores") == 3


def test_room_joins_equal_the_batch(spark, store, tmp_path):
    r = random.Random(6)
    base = START // 300_000 * 300_000
    rows = [{"at_ms": base + r.randrange(0, 1_500_000) // 500 * 500, "user_id": f"u{r.randrange(9)}", "room_id": r.choice("RST"), "event_type": r.choice(["join", "join", "message"])} for _ in range(500)]
    rows += [{"at_ms": base + 3_000_000 + i * 1000, "user_id": f"v{i}", "room_id": "Q", "event_type": "join"} for i in range(5)]
    df = events(spark, rows)
    df = spark.createDataFrame(df.collect(), df.schema)
    key = lambda x: (x.room_id, x.sweep_ms, x.n, x.from_ms, x.severity, x.confidence, tuple(x.user_ids))
    want = sorted(key(x) for x in coordination.synchronized_joins(df, C.coordination).collect())
    brute = []
    for room in "QRST":
        for sweep in sorted({x["at_ms"] // 300_000 * 300_000 for x in rows}):
            joins = sorted((x["at_ms"], x["user_id"]) for x in rows if x["room_id"] == room and x["event_type"] == "join" and x["at_ms"] // 300_000 * 300_000 == sweep)
            for at, _ in joins:
                people = {u for t, u in joins if at <= t <= at + C.coordination.join_window_ms}
                if len(people) >= C.coordination.join_accounts:
                    brute.append((room, sweep, at, tuple(sorted(people))))
                    break
    assert [(x[0], x[1], x[3], x[6]) for x in want] == brute and len(brute) >= 5
    for i, part in enumerate(df.randomSplit([1.0] * 3, 5)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    end = events(spark, [{"at_ms": base + 10**9, "user_id": "zz", "room_id": "Z", "event_type": "leave", "seq": 10**6}])
    spark.createDataFrame(end.collect(), df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run(spark, S.synchronized_joins(live, C, late="2 hours"), tmp_path, "joins")
    assert sorted(key(x) for x in spark.read.schema(S.JOINED).parquet(f"{tmp_path}/joins").collect()) == want


def test_late_rows_revise_signals(spark, tmp_path):
    """Any order of arrival, repeated rows and repeated batches give the signals of one batch; rows behind the bound are kept aside."""
    _, rows = made(spark, 120, 9)
    df = events(spark, rows)
    df = spark.createDataFrame(df.collect(), df.schema)
    detect = P.user_detectors(C)
    key = lambda r: (r.event_id, r.code, r.severity, r.confidence)
    want = sorted(key(r) for r in detect(df).collect())
    parts = df.randomSplit([1.0] * 3, 3)
    folder = f"file://{tmp_path}/state"
    write = P.revise_batches(folder, detect, C.spam.horizon_ms, late_ms=10**9)
    for i, part in enumerate(parts):
        write(part.unionByName(part.limit(2)), i)
    write(parts[2], 2)  # once more
    write(parts[0].limit(5), 3)  # rows that are there already
    got = sorted(key(r) for r in P.current_signals(spark, folder).collect())
    assert got == want and spark.read.parquet(f"{folder}/changes").filter("change < 0").count() > 0
    old = df.limit(1).withColumns({"event_id": F.lit("old"), "at_ms": F.lit(START - 2 * 10**9)})
    write(old, 4)
    assert [r.event_id for r in spark.read.parquet(f"{folder}/dropped").filter("batch_id = 4").collect()] == ["old"]
    assert sorted(key(r) for r in P.current_signals(spark, folder).collect()) == want
