"""Validation of raw events: every issue of a row is named, valid rows get types, ids and clean text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import hashing as H
from tidewatch.functions import text as T

#: The fields, types and platforms of an event.
FIELDS = ("clientVersion", "eventId", "eventType", "message", "messageIsTranscript", "metadata", "platform", "roomId", "timestamp", "userId")
TYPES = ("message", "voice", "join", "leave", "moderation")
PLATFORMS = ("ios", "android", "web", "desktop", "unknown")
FORBIDDEN_KEYS = ("__proto__", "constructor", "prototype")


@dataclass(frozen=True)
class Limits:
    id_length: int = 128
    message_length: int = 4000
    version_length: int = 64
    metadata_keys: int = 25
    metadata_key_length: int = 64
    metadata_value_length: int = 512
    max_future_ms: int = 2 * 60_000
    max_age_ms: int = 7 * 86_400_000
    content_allowed: bool = True


#: A valid id.
ID = r"^[A-Za-z0-9_.:@-]+$"


def with_fields(raw: DataFrame) -> DataFrame:
    """Adds v (the row as a variant), kind_ and text_ of each field, and meta, the metadata if they are an object; each read once."""
    rows = raw.withColumn("v", F.try_parse_json("raw"))
    kinds = {f"kind_{f}": F.schema_of_variant(F.variant_get("v", f"$.{f}", "variant")) for f in FIELDS}
    texts = {f"text_{f}": F.try_variant_get("v", f"$.{f}", "string") for f in FIELDS if f != "metadata"}
    return rows.withColumns({**kinds, **texts, "meta": F.try_variant_get("v", "$.metadata", "map<string,variant>")})


def _kind(path: str) -> Column:
    """The JSON type of a field; null if it is absent, VOID if it is null."""
    return F.col(f"kind_{path}")


def _text(path: str) -> Column:
    return F.col(f"text_{path}")


def _metadata() -> Column:
    return F.coalesce("meta", F.create_map().cast("map<string,variant>"))


def clean_metadata() -> Column:
    """The metadata with its types; strings without what doesn't show."""
    meta = _metadata()
    values = F.map_values(meta)
    strings = F.transform(values, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    cleaned = F.transform(T.nfkc_all(strings), T.visible)
    back = lambda x, s: F.when(s.isNull(), x).otherwise(F.variant_get(F.parse_json(F.to_json(F.array(s))), "$[0]", "variant"))
    return F.when(_kind("metadata").startswith("OBJECT"), F.map_from_arrays(F.map_keys(meta), F.zip_with(values, cleaned, back)))


def message_facts(said: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """said: message, among other columns. Puts what the rules ask of a message in its place: too_long, empty and clean, the clean text of
    one that isn't too long. Null for no message. Texts that many rows say are so looked at once each."""
    rows = said.withColumn("_long", T.utf16_length(F.col("message")) > limits.message_length)
    rows = rows.withColumn("_clean", F.nullif(T.sanitize_visible(F.when(~F.col("_long") & F.lit(limits.content_allowed), F.col("message"))), F.lit("")))
    facts = F.struct(F.col("_long").alias("too_long"), (F.trim("message") == "").alias("empty"), F.col("_clean").alias("clean"))
    return rows.withColumn("message", F.when(F.col("message").isNotNull(), facts)).drop("_long", "_clean")


def issues_of(now_ms: Column, limits: Limits, apart: bool = False) -> tuple[Column, Column]:
    """(issues, warnings) of a row with columns raw and v, each array<struct<field, code>>. apart: messages stand in a column apart, as
    message_facts."""
    one = lambda cond, field, code: F.when(cond, F.struct((field if isinstance(field, Column) else F.lit(field)).alias("field"), F.lit(code).alias("code")))
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    is_object = F.col("v").isNotNull() & F.ltrim(F.col("raw"), F.lit(" \t\r\n")).startswith("{")  # a row's whole schema takes far longer
    extra = F.transform(F.array_except(F.json_object_keys("raw"), F.array(*map(F.lit, FIELDS))), lambda k: F.struct(F.left(F.regexp_replace(k, "[^A-Za-z0-9_.-]", ""), F.lit(64)).alias("field"), F.lit("UNKNOWN_FIELD").alias("code")))
    found = []
    for field in ("userId", "roomId"):
        s, kind = _text(field), _kind(field)
        none = kind.isNull() | (kind != "STRING") | (s == "")
        found.append(F.coalesce(one(none, field, "MISSING"), one(F.length(s) > limits.id_length, field, "TOO_LONG"), one(~s.rlike(ID), field, "BAD_CHARACTERS")))
    s, at = _text("timestamp"), F.unix_millis(F.try_to_timestamp(_text("timestamp")))
    found.append(F.coalesce(one(_kind("timestamp").isNull() | (_kind("timestamp") != "STRING"), "timestamp", "MISSING"), one(at.isNull(), "timestamp", "UNPARSABLE"), one(at > now_ms + limits.max_future_ms, "timestamp", "IN_FUTURE"), one(at < now_ms - limits.max_age_ms, "timestamp", "TOO_OLD")))
    found.append(one(~F.coalesce(_text("eventType").isin(*TYPES), F.lit(False)), "eventType", "NOT_ALLOWED"))
    message, kind = _text("message"), _kind("message")
    if apart:
        said, too_long, empty = F.col("apart").isNotNull(), F.col("apart.too_long"), F.col("apart.empty")
        found.append(one(too_long, "message", "TOO_LONG"))
    else:
        said, empty = kind.isNotNull() & (kind != "VOID"), F.trim(message) == ""
        found.append(F.coalesce(one(said & (kind != "STRING"), "message", "BAD_TYPE"), one(T.utf16_length(message) > limits.message_length, "message", "TOO_LONG")))
    kind = _kind("clientVersion")
    found.append(F.coalesce(one(kind.isNotNull() & ~kind.isin("STRING", "VOID"), "clientVersion", "BAD_TYPE"), one(F.length(_text("clientVersion")) > limits.version_length, "clientVersion", "TOO_LONG")))
    kind = _kind("messageIsTranscript")
    found.append(one(kind.isNotNull() & ~kind.isin("BOOLEAN", "VOID"), "messageIsTranscript", "BAD_TYPE"))
    kind = _kind("metadata")
    meta = _metadata()
    keys = F.map_keys(meta)
    values = F.transform(F.map_values(meta), lambda x: F.struct(F.schema_of_variant(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("s")))
    bad_value = F.exists(values, lambda x: ~x["kind"].rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*|BOOLEAN|VOID)$") | ((x["kind"] == "STRING") & (F.length(x["s"]) > limits.metadata_value_length)))
    found.append(F.coalesce(
        one(kind.isNotNull() & ~kind.startswith("OBJECT") & (kind != "VOID"), "metadata", "BAD_TYPE"), one(F.size(keys) > limits.metadata_keys, "metadata", "TOO_MANY_KEYS"),
        one(F.exists(keys, lambda k: k.isin(*FORBIDDEN_KEYS)), "metadata", "FORBIDDEN_KEY"), one(F.exists(keys, lambda k: ~k.rlike(rf"^[A-Za-z0-9_.-]{{1,{limits.metadata_key_length}}}$")), "metadata", "BAD_KEY"), one(bad_value, "metadata", "BAD_VALUE"),
    ))
    whole = F.concat(F.coalesce(extra, F.array().cast("array<struct<field:string,code:string>>")), some(*found))
    issues = F.when(is_object, whole).otherwise(F.array(F.struct(F.lit("").alias("field"), F.lit("NOT_AN_OBJECT").alias("code"))))
    platform = _text("platform")
    warnings = some(
        one(platform.isNotNull() & ~platform.isin(*PLATFORMS), "platform", "UNKNOWN_PLATFORM"), one(F.lit(not limits.content_allowed) & said, "message", "CONTENT_NOT_AUTHORIZED"),
        one((_text("eventType") == "message") & F.coalesce(empty, F.lit(True)), "message", "EMPTY_MESSAGE"),
    )
    return issues, F.when(is_object, warnings).otherwise(F.array().cast("array<struct<field:string,code:string>>"))


def validate(raw: DataFrame, now_ms: Column, limits: Limits = Limits()) -> DataFrame:
    """raw: batch_id, idx, raw. Adds issues, warnings and the fields of a valid event; of valid rows that share an id in a
    batch the first stays, the others get DUPLICATE_IN_BATCH. An id that isn't a good one is derived from the event, as a
    missing one is. Accepted rows are those without issues. raw may have apart, the message_facts of messages that many rows say and
    that are kept apart from them; the JSON then has none."""
    rows, apart = with_fields(raw), "apart" in raw.columns
    fields = rows.columns[len(raw.columns):]
    issues, warnings = issues_of(now_ms, limits, apart)
    said = (F.col("apart.clean") if apart else _text("message")) if limits.content_allowed else F.lit(None).cast("string")
    # a generator, so that what is made of these further down, also in the same row, doesn't make them again each time
    once = F.explode(F.array(F.struct(issues.alias("issues"), warnings.alias("warnings"))))
    rows = rows.withColumn("once", once).select(*rows.columns, "once.*").withColumn("said", F.when(F.size("issues") == 0, said))
    at = F.unix_millis(F.try_to_timestamp(_text("timestamp")))
    stamp = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = rows.withColumns({"user_id": _text("userId"), "room_id": _text("roomId"), "event_at_ms": at, "event_type": _text("eventType")})
    # rows with issues go nowhere, so their texts needn't be sanitised
    clean = F.col("said") if apart else F.nullif(T.sanitize_visible(F.col("said")), F.lit(""))
    rows = rows.withColumn("message", clean).withColumns({
        "client_version": F.nullif(F.trim(_text("clientVersion")), F.lit("")), "platform": F.when(_text("platform").isin(*PLATFORMS), _text("platform")).otherwise("unknown"),
        "is_transcript": F.coalesce(F.try_variant_get("v", "$.messageIsTranscript", "boolean"), F.lit(False)), "metadata": clean_metadata(),
    })
    derived = H.event_id(F.col("event_type"), F.col("message"), F.col("room_id"), stamp, F.col("user_id"))
    own = _text("eventId")
    given = F.when((_kind("eventId") == "STRING") & (F.length(own) <= limits.id_length) & own.rlike(ID), own)
    rows = rows.withColumn("event_id", F.coalesce(given, derived)).drop("said", "apart", *fields)
    good = F.size("issues") == 0
    order = F.row_number().over(W.partitionBy("batch_id", "event_id", good).orderBy("idx"))
    again = F.array(F.struct(F.lit("eventId").alias("field"), F.lit("DUPLICATE_IN_BATCH").alias("code")))
    return rows.withColumn("n", order).withColumn("issues", F.when(good & (F.col("n") > 1), again).otherwise(F.col("issues"))).drop("n")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("issues") == 0).drop("issues", "warnings", "raw")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("issues") > 0).select("batch_id", "idx", "user_id", "event_at_ms", "issues")


def warned(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("warnings") > 0).select("batch_id", "idx", "warnings")


def withhold_content(events: DataFrame, authorized: bool) -> DataFrame:
    """For reads: without permission the text stays away, and a note says so."""
    if authorized:
        return events.withColumn("content_note", F.lit(None).cast("string"))
    return events.withColumn("message", F.lit(None).cast("string")).withColumn("content_note", F.lit("content withheld"))
