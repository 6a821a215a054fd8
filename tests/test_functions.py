import hashlib
import json

from pyspark.sql import functions as F

from tidewatch.functions import hashing as H
from tidewatch.functions import math as M
from tidewatch.functions import text as T


def one(spark, value, of):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(of(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, "Héyyyyy  w0rld_а", T.normalize_for_match) == "heyy world a"
    assert one(spark, "buy now!!!", T.normalize_for_match) == "buy now!!" and one(spark, "k!ll m0ney 1111", T.normalize_for_match) == "kill money 11"
    assert one(spark, "Buy, NOW!", T.fingerprint) == "buynow" and one(spark, "?!?", T.fingerprint) == "?!?"
    assert one(spark, "  a​b Ａ ", T.sanitize_visible) == "ab A"
    assert one(spark, "i d i o t", T.collapse_letter_spacing) == "idiot" and one(spark, "a b words here", T.collapse_letter_spacing) is None
    assert one(spark, "@ann hi (@bob x@not @c", T.count_mentions) == 2
    assert one(spark, "see HTTP://A.com/x www.b.org b.org/Y a.com x.zzz", T.extract_urls) == ["http://a.com/x", "www.b.org", "b.org/y", "a.com"]
    assert sorted(one(spark, "abc да α", T.scripts_used)) == ["Cyrillic", "Greek", "Latin"]
    assert one(spark, "ab", T.trigrams) == [" ab", "ab "]
    assert one(spark, "mail a.b@c.org, ip 10.0.0.1, id " + "k" * 32, T.redact_identifiers) == "mail [redacted-email], ip [redacted-ip], id [redacted-token]"
    assert one(spark, "abcdef", lambda c: T.truncate(c, 4)) == "abc…" and one(spark, "abcd", lambda c: T.truncate(c, 4)) == "abcd"
    assert one(spark, "\U0001f600a", T.utf16_length) == 3
    x = spark.createDataFrame([("A​B аbc aaaa!!!!",)], "x string").withColumn("f", T.unicode_forms("x"))
    a = x.select(T.char_anomalies(F.col("x"), F.col("f"), F.lit("a b")).alias("a")).first().a
    assert a.invisible == 1 and a.invisible_in_word and a.mixed_words == 1 and a.longest_run == 4


def test_similarity(spark):
    df = spark.createDataFrame([("good morning", "good morning"), ("good morning", "good evening"), ("", "x")], "a string, b string")
    got = [r.s for r in df.select(T.similarity(T.trigrams(F.col("a")), T.trigrams(F.col("b"))).alias("s")).collect()]
    assert got[0] == 1.0 and 0 < got[1] < 1 and got[2] == 0.0


def test_math(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (2.0,)], "c double")
    assert df.limit(2).agg(M.noisy_or(F.col("c")).alias("x")).first().x == 0.75
    v = spark.range(1).select(
        M.half_up(F.lit(2.5)).alias("a"), M.saturate(F.lit(15), 10, 20).alias("b"), M.saturate(F.lit(5), 10, 20).alias("c"), M.decay(F.lit(8.0), F.lit(10), 10).alias("d"), M.decay(F.lit(8.0), F.lit(0), 10).alias("e"),
        M.array_cv(F.array(*map(F.lit, (2, 4, 4, 4, 5, 5, 7, 9)))).alias("f"), M.deltas(F.array(*map(F.lit, (1, 3, 7)))).alias("g"), M.clamp(F.lit(float("nan")), 1, 2).alias("h"),
    ).first()
    assert (v.a, v.b, v.c, v.d, v.e, v.g, v.h) == (3.0, 0.5, 0.0, 4.0, 8.0, [2, 4], 1.0) and abs(v.f - 2.138 / 5) < 1e-3


def test_hashes(spark):
    got = spark.range(1).select(H.event_id(F.lit("message"), F.lit('a"b'), F.lit("R"), F.lit("2026-03-01T12:00:00.000Z"), F.lit("U")).alias("i"), H.handle(F.lit("U"), "s").alias("h")).first()
    said = json.dumps({"eventType": "message", "message": 'a"b', "roomId": "R", "timestamp": "2026-03-01T12:00:00.000Z", "userId": "U"}, separators=(",", ":"))
    assert got.i == hashlib.sha256(said.encode()).hexdigest()[:32] and got.h == hashlib.sha256(b"s:U").hexdigest()[:6].upper()
