"""Event table and feeds made from the tables events, documents and labels, so that every operator can run on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"click": "message", "view": "voice", "signup": "join", "error": "leave", "purchase": "moderation"}
CONTENT = ("message", "voice")
#: Texts that content events say again and again: five to each of twenty groups of users.
SLOTS = 100


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, message): the texts that events say, each once."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("message"))


def telemetry(spark: SparkSession, sf_dir: str, texts: bool | Callable[[DataFrame], DataFrame] = True) -> DataFrame:
    """Events with users, rooms, messages, versions and platforms; seq breaks ties of at_ms and follows time.

    Content events say one of a hundred texts that their group of users shares. Besides, every document is a message of its
    own, whole, sent by the user of the event whose turn it is: documents are dealt out evenly over all events. number is
    the event's; it is null for a document's message. Without texts there is has_message instead of message, and doc_id tells
    which of documents() it is, so that no text is repeated for each event that says it. texts may also be what makes something else of documents()'s
    messages; events then have that as their message."""
    events, docs = spark.read.parquet(f"{sf_dir}/events.parquet"), documents(spark, sf_dir).withColumnRenamed("message", "text")
    made = texts if callable(texts) else lambda said: said
    if not texts:
        docs = docs.select("doc_id", F.col("text").isNotNull().alias("text"))
    n, d = ((df.agg(F.max(c)).first()[0] or 0) + 1 for df, c in ((events, "event_id"), (docs, "doc_id")))
    stride = d // n + 2  # numbers that an event and the documents dealt to it take
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    place = (F.col("user_id") % 20) * 5 + F.col("event_id") % 5
    rows = events.select(
        F.col("event_id").alias("number"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user_id"),
        F.concat(F.lit("r"), (F.col("user_id") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)) % 10).alias("room_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        kinds[F.col("event_type")].alias("event_type"),
        (place * max(1, d // SLOTS) % d).alias("doc_id"),
        F.concat(F.lit("4.2."), F.col("event_id") % 5).alias("client_version"),
        F.element_at(F.array(*map(F.lit, ("ios", "android", "web", "desktop"))), (F.col("event_id") % 4 + 1).cast("int")).alias("platform"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value",
    )
    content = F.col("event_type").isin(*CONTENT)
    found = lambda rows: made(rows.withColumnRenamed("text", "message")).withColumnRenamed("message", "text")
    again = found(docs.join(F.broadcast(rows.select("doc_id").distinct()), "doc_id", "left_semi")).withColumnRenamed("doc_id", "again")  # a hundred texts
    base = rows.withColumn("doc_id", F.when(content, F.col("doc_id"))).withColumn("seq", F.col("number") * stride)
    base = base.join(F.broadcast(again), F.col("doc_id") == F.col("again"), "left").drop("again")
    turn = found(docs).withColumn("turn", F.col("doc_id") % n * max(1, n // d))
    own = turn.join(rows.drop("doc_id"), F.col("turn") == F.col("number")).withColumn("seq", F.col("number") * stride + 1 + F.floor(F.col("doc_id") / n))
    own = own.withColumns({"event_type": F.lit("message"), "number": F.lit(None).cast("long")})
    columns = ["number", "seq", "user_id", "room_id", "at_ms", "event_type", "text", "doc_id", "client_version", "platform", "k", "value"]
    both = base.select(*columns).unionByName(own.select(*columns))
    said = F.col("text").alias("message") if texts else F.coalesce("text", F.lit(False)).alias("has_message")
    return both.select(
        F.col("seq").cast("string").alias("event_id"), "seq", "number", "user_id", "room_id", "at_ms", "event_type", said, "doc_id",
        (F.col("event_type") == "voice").alias("is_transcript"), "client_version", "platform", "k", "value",
    )


def restrictions(events: DataFrame) -> DataFrame:
    """Moderation events as restrictions: user, applied_ms, kind, room (or null for all), expires_ms (or null)."""
    day = 86_400_000
    return events.filter("event_type = 'moderation'").select(
        "user_id", F.col("at_ms").alias("applied_ms"), F.lit("MUTE").alias("kind"), F.when(F.col("number") % 3 != 0, F.col("room_id")).alias("room_id"),
        F.when(F.col("number") % 2 == 0, F.col("at_ms") + day).alias("expires_ms"), F.col("seq").alias("feed_seq"),
    )


def hidden_presence(events: DataFrame) -> DataFrame:
    """Joins and leaves, as a feed that tells of all hidden ones would report them."""
    own = events.filter(F.col("event_type").isin("join", "leave"))
    return own.select("user_id", "room_id", "at_ms", F.when(F.col("event_type") == "join", "HIDDEN_JOIN").otherwise("HIDDEN_LEAVE").alias("kind"), "seq")


def verdicts(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Labels over a message's document, as if a classifier had judged it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = events.filter("message IS NOT NULL" if "message" in events.columns else "has_message").select("event_id", "doc_id").join(labels, "doc_id")
    return rows.select("event_id", F.when(F.col("toxic") == 1, "ABUSIVE").otherwise("SAFE").alias("classification"), F.lit(0.8).alias("confidence"))


#: Events of a batch of raw events; the first ones break a rule each.
BATCH = 50


def raw_events(events: DataFrame) -> DataFrame:
    """The events as JSON lines in batches, one of each batch made invalid or odd in each way that its number names. Messages that aren't
    texts but validation.message_facts go beside the JSON, as apart."""
    texts = dict(events.dtypes)["message"] == "string"
    day = 86_400_000
    broken = F.coalesce(F.col("number") % BATCH, F.lit(-1))
    at = F.col("at_ms") + F.when(broken == 9, day).when(broken == 10, -8 * day).otherwise(0)
    stamp = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    batch = F.floor(F.col("number") / BATCH)
    ids = F.when(broken == 7, F.lit("odd id!")).when(broken == 8, F.concat(F.lit("given-"), F.col("number"))).when(broken.isin(15, 16), F.concat(F.lit("twin-"), batch))
    said = F.to_json(
        F.struct(
            F.when(broken == 1, F.lit("bad user!")).otherwise(F.col("user_id")).alias("userId"),
            F.when(broken == 13, F.repeat(F.lit("r"), 129)).when(broken != 2, F.col("room_id")).alias("roomId"),
            F.when(broken == 3, F.lit("yesterday")).otherwise(stamp).alias("timestamp"),
            F.when(broken == 4, F.lit("shout")).otherwise(F.col("event_type")).alias("eventType"),
            *([F.col("message")] if texts else []),
            F.when(broken == 14, F.lit("yes")).alias("messageIsTranscript"),
            F.when(broken == 12, F.repeat(F.lit("4"), 65)).otherwise(F.col("client_version")).alias("clientVersion"),
            F.when(broken == 5, F.lit("toaster")).otherwise(F.col("platform")).alias("platform"),
            F.when(broken == 6, F.lit(1)).alias("surprise"),
            ids.alias("eventId"),
            F.struct(F.col("k"), F.col("value"), F.when(broken == 11, F.lit("x")).alias("__proto__")).alias("metadata"),
        )
    )
    # documents' messages come in batches of their own
    batch_id, idx = F.coalesce(batch, -1 - F.floor(F.col("seq") / BATCH)), F.coalesce("number", "seq") % BATCH
    apart = [] if texts else [F.col("message").alias("apart")]
    return events.select(said.alias("raw"), batch_id.cast("long").alias("batch_id"), idx.cast("int").alias("idx"), "at_ms", "seq", *apart)
