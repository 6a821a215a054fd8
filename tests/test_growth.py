"""Steps whose cost per row has to stay the same however many rows a user, a window or an incident has."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tests.helpers import START, events
from tidewatch.config import WIDE, RiskConfig, SpamConfig
from tidewatch.functions import text as T
from tidewatch.operators import abuse, client, coordination, evasion, lexicon, risk, spam
from tidewatch.operators.windows import trailing_sum
from tidewatch.plans import outcomes, queries


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trailing_sums_are_running_sums(spark):
    """no frame slides, so that an event costs the same in a busy window; ties, caps and missing times are right."""
    r = random.Random(8)
    rows = [{"at_ms": None if r.random() < 0.05 else START + r.randrange(3000) // 5 * 5, "user_id": r.choice("AB")} for _ in range(300)]
    df = events(spark, rows).withColumn("v", F.when(F.col("seq") % 7 > 0, F.col("seq") % 3))
    for width, cap in ((0, None), (200, None), (900, 20)):
        summed = df.withColumn("n", trailing_sum(F.col("v"), width, ["user_id"], cap))
        assert not re.search(r"specifiedwindowframe\(\w+, -?\d", plan_of(summed))
        got = summed.collect()
        key = lambda x: (x.at_ms is not None, x.at_ms or 0, x.seq)
        for x in got:
            own = sorted((y for y in got if y.user_id == x.user_id and key(y) <= key(x)), key=key)
            near = [y.v or 0 for y in own if (y.at_ms is None if x.at_ms is None else y.at_ms is not None and y.at_ms >= x.at_ms - width)]
            assert x.n == min(sum(near), sum(y.v or 0 for y in own[-cap - 1 :]) if cap else sum(near))


def test_distinct_counts_add_no_rows(spark):
    df = events(spark, [{"at_ms": START + i, "client_version": str(i % 3)} for i in range(9)])
    counted = client.with_distinct(df, F.col("client_version"), 1, "n")
    assert "Union" not in plan_of(counted) and [x.n for x in counted.orderBy("seq").collect()] == [1, 2, 2, 2, 2, 2, 2, 2, 2]


def test_detectors_take_what_one_pass_counted(spark):
    """Marked events give the same signals without another window."""
    r, (c, e, s) = random.Random(4), (WIDE.client, WIDE.evasion, WIDE.spam)
    rows = [{"at_ms": START + i * 3_000_000, "user_id": r.choice("AB"), "room_id": r.choice("XY"), "event_type": r.choice(["join", "leave", "voice", "message"]), "client_version": r.choice("1234")} for i in range(200)]
    df = events(spark, rows)
    marked = client.with_versions(client.with_sequence_case(evasion.with_rejoins(spam.with_rates(df, s), e), c, s.horizon_ms), c, s.horizon_ms).localCheckpoint()
    for find in (lambda x: client.version_flapping(x, c, s.horizon_ms), lambda x: client.impossible_sequence(x, c, s.horizon_ms), lambda x: evasion.rejoin_cycling(x, e)):
        assert "Window" not in plan_of(find(marked))
        got, want = (sorted((x.event_id, x.severity, x.confidence, sorted(x.details.items())) for x in find(y).collect()) for y in (marked, df))
        assert got == want and got


def test_scores_without_contributions_are_numbers(spark):
    """Codes are bits, in as many words as it takes; lists are gathered only for those who ask."""
    codes = [f"C{i:03d}" for i in range(70)]
    rows = [("u", "r", "e", 1, 1, k, "LOW", 0.5) for k in reversed(codes)] + [("u", "r", "f", 2, 2, k, "LOW", 0.1 + i / 10) for i, k in enumerate(("C069", "C001", "none", "C001"))]
    signals = spark.createDataFrame(rows, "user_id string, room_id string, event_id string, at_ms long, seq long, code string, severity string, confidence double")
    scored = risk.score_signals(signals, RiskConfig(weights=dict.fromkeys(codes, 1.0)))
    got = {x.event_id: x for x in scored.collect()}
    assert got["e"].codes == codes and got["f"].codes == ["C001", "C069"] and [x.code for x in got["f"].contributions] == ["C001", "C069"]
    assert "collect_list" not in plan_of(scored.select("event_id", "score", "level", "codes", "deterministic_only")) and "collect_list" in plan_of(scored)


def test_the_chain_reads_written_bodies(spark, sf, monkeypatch):
    """the chain looks at the bodies twice, so they are a table and not the making of all incidents."""
    seen, chain = [], outcomes.evidence.chain
    monkeypatch.setattr(outcomes.evidence, "chain", lambda found: seen.append(plan_of(found)) or chain(found))
    outcomes._chain(spark, sf)
    assert len(seen) == 1 and "Aggregate" not in seen[0] and "Join" not in seen[0]


def _shuffled(spark, job):
    """What job() returns, and the bytes that its stages shuffled."""
    store = spark._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (x.apply(i) for x in [store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)] for i in range(x.size()))}
    before, out = stages(), job()
    return out, sum(n for stage, n in stages().items() if stage not in before)


def test_unlike_texts_send_no_trigrams(spark):
    """60 long texts of one user, of which two are alike: a text's trigrams travel for likely pairs, not for each pair."""
    r, c = random.Random(6), SpamConfig(near_duplicate_count=2, horizon_ms=10**9)
    texts = [" ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(400)) for _ in range(59)]
    rows = [{"at_ms": START + i, "message": t} for i, t in enumerate([*texts, texts[7] + " indeed"])]
    repeated = spam.with_repeats(spam.with_text_features(events(spark, rows)), c).localCheckpoint()
    got, spent = _shuffled(spark, lambda: spam.near_duplicate(repeated, c).collect())
    assert [(x.event_id, x.details["n"]) for x in got] == [("e59", 2)] and spent < 3_000_000


def test_bitmaps_keep_all_that_are_alike(spark):
    """of texts of all sizes and likenesses none that is alike is dropped, and unlike ones are; text in Python is text in Spark."""
    r = random.Random(7)
    made = []
    for size in (3, 20, 90, 130, 300, 700, 1500):
        base = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789äßждλ", k=size))
        for change in (0, 0.01, 0.03, 0.05, 0.1, 0.3, 1):
            cut = base[: int(size * r.choice((0.8, 0.9, 1)))]
            made.append((base, "".join(r.choice("abcdefghijk") if r.random() < change else x for x in cut)))
    made += [("aaaa1aab" * 9, "aaa1aab" * 9), ("𐌰𐌱𐌲𐌳𐌴𐌵" * 5, "𐌰𐌱𐌲𐌳𐌴𐌶" * 5)]
    two = spam.with_sketch(spark.createDataFrame(made, "fp string, other string")).withColumnsRenamed({n: f"{n}1" for n in ("fp", *spam.NEAR)}).withColumnRenamed("other", "fp")
    two = spam.with_sketch(two)
    like = T.similarity(T.trigrams(F.col("again1")), T.trigrams(F.col("again")))
    got = two.select(like.alias("like"), spam._may_be_alike(F.col("grams1"), F.col("grams"), F.col("sketch1"), F.col("sketch"), 0.78).alias("may"), (T.normalize_for_match(F.col("fp")) == F.col("again")).alias("same")).collect()
    assert all(x.may for x in got if x.like >= 0.78) and any(x.like >= 0.78 for x in got) and sum(not x.may for x in got) > 10 and all(x.same for x in got)


def test_joins_slide_no_frame_and_findings_are_written(spark, sf, monkeypatch):
    """a join costs the same however many there are in its window; the summary reads a table, not the making of all findings."""
    joins = events(spark, [{"at_ms": START + i, "event_type": "join", "user_id": f"u{i % 7}"} for i in range(40)])
    plan = plan_of(coordination.synchronized_joins(joins, WIDE.coordination))
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding" in plan and "specifiedwindowframe(RangeFrame, currentrow" not in plan
    seen, summary = [], queries.coordination.sweep_summary
    monkeypatch.setattr(queries.coordination, "sweep_summary", lambda found: seen.append(plan_of(found)) or summary(found))
    queries.coordination_sweep(spark, sf)
    assert len(seen) == 1 and "Aggregate" not in seen[0] and "Window" not in seen[0]


def test_patterns_are_for_texts_with_a_word_that_they_ask_for(spark):
    """the words leave out no match; a tier with an entry whose words aren't known is looked for everywhere."""
    lex = lexicon.Lexicon()
    assert set(lex.words) == {"mild", "severe", "threat"} and not {"you", "i", "for", "with"} & {w for x in lex.words.values() for w in x}
    r, pool = random.Random(5), ["i", "will", "you", "kill", "find", "your", "u", "ur", "mother", "is", "next", "hope", "die", "idiot", "stupid,", "kys", "gun", "for", "with", "house", "rot", "in", "hell", "é", "know", "where", "live"]
    said = [" ".join(r.choices(pool, k=r.randrange(1, 9))) for _ in range(1500)]
    said += ["i will surely kill you", "your mother is next", "rot in hell", "you (idiot)"]
    df = spark.createDataFrame([(t, t) for t in said], "message string, normalized string").withColumn("forms", F.struct(F.lit(0).alias("marks"), F.length("message").alias("base")))
    own = {f"{t}_hits": F.array_distinct(F.regexp_extract_all("normalized", F.lit(p), F.lit(0))) for t, p in lex.patterns.items()}
    got = abuse.message_hits(df).select(*((F.col(k) == v).alias(k) for k, v in own.items()), *((F.size(k) > 0).alias(f"{k}_any") for k in own)).collect()
    assert all(x[k] for x in got for k in own) and all(any(x[f"{k}_any"] for x in got) for k in own)
    assert "mild" not in lexicon.Lexicon((*lexicon.SEED, ("mild", "pattern", r"bad\s+\w+"))).words


def test_character_counts(spark):
    """counts without arrays of characters equal those by hand."""
    texts = ["", "AbC  dd!!!", "aaa é É ß 12 ½  　x", "ÀÀÀÀ λλ 😀😀😀", "   ", "№№ Ⅷ ǅ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.char_anomalies(F.col("t"), F.struct(F.lit(0).alias("marks"), F.lit(1).alias("base")), F.col("t")).alias("x"))
    for row in df.collect():
        kinds, runs = [unicodedata.category(x) for x in row.t], [len(m[0]) for m in re.finditer(r"(?s)(.)\1*", row.t)]
        letters, symbols = sum(k[0] == "L" for k in kinds), sum(k[0] not in "LN" and not x.isspace() for k, x in zip(kinds, row.t))
        assert row.x.longest_run == max(runs, default=0) and row.x.caps_ratio == (kinds.count("Lu") / letters if letters else 0.0)
        assert row.x.symbol_ratio == (symbols / (len(row.t.encode("utf-16-le")) // 2) if row.t else 0.0)


def test_marked_events_give_client_signals_without_windows(spark):
    """detectors of clients read what one pass counted; repeats leave the events' own columns alone."""
    r, (c, s) = random.Random(4), (WIDE.client, WIDE.spam)
    rows = [{"at_ms": START + i * 9_000_000, "user_id": r.choice("AB"), "event_type": r.choice(["join", "leave", "voice"]), "client_version": r.choice("1234"), "platform": r.choice(["ios", "web", "unknown"])} for i in range(120)]
    df = events(spark, rows)
    marked = client.with_marks(df, c, s.horizon_ms).localCheckpoint()
    assert "Window" not in plan_of(client.all_signals(marked, c, s.horizon_ms))
    got, want = (sorted((x.event_id, x.code, x.severity, x.confidence, sorted(x.details.items())) for x in client.all_signals(y, c, s.horizon_ms).collect()) for y in (marked, df))
    assert got == want and {x[1] for x in got} >= {"CLIENT_PLATFORM_MISMATCH", "CLIENT_VERSION_FLAPPING"}
    own = df.withColumns({"number": F.col("seq") + 100, "key": F.lit("k"), "fp": F.lit("f")})
    assert [(x.number, x.key) for x in spam.with_repeats(own, s).orderBy("seq").collect()] == [(i + 100, "k") for i in range(120)]
