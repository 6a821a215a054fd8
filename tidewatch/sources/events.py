"""Readers: raw event envelopes and the platform's feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.windows import free_name
from tidewatch.sources.shared import materialise

RESTRICTIONS = ("MUTE", "KICK", "BAN", "SUSPEND")
PRESENCE = ("HIDDEN_JOIN", "HIDDEN_LEAVE", "HIDDEN_PRESENT")
CLASSES = ("SAFE", "UNCERTAIN", "ABUSIVE", "SEVERE_ABUSE", "THREAT")


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines as they came, in column body."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "body")


def envelopes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw events with their index in the envelope, bad envelopes): a body is one event or {"events": [...]}; a bare
    array, a scalar and broken JSON are bad."""
    v = F.try_parse_json("body")
    rows = lines.withColumns({"v": v, "shape": F.schema_of_variant(v)})
    good = F.col("shape").startswith("OBJECT")
    many = F.try_variant_get("v", "$.events", "array<variant>")
    listed = rows.filter(good).withColumn("list", F.when(F.get_json_object("body", "$.events").isNotNull(), many))
    bad_list = F.get_json_object("body", "$.events").isNotNull() & F.col("list").isNull()
    one = listed.filter(F.col("list").isNull() & ~bad_list).select("body", F.lit(0).alias("idx"), F.col("body").alias("raw"))
    several = listed.filter(F.col("list").isNotNull()).select("body", F.posexplode("list").alias("idx", "x")).select("body", "idx", F.to_json("x").alias("raw"))
    bad = rows.filter(~good | F.col("shape").isNull()).select("body").unionByName(listed.filter(bad_list).select("body"))
    return one.unionByName(several), bad


def _one_of(column: Column, known: tuple[str, ...]) -> Column:
    return F.when(column.isin(*known), column).otherwise("UNKNOWN")


def restriction_feed(feed: DataFrame) -> DataFrame:
    """Unknown kinds become UNKNOWN; entries without a time are left out."""
    return feed.filter(F.col("applied_ms").isNotNull()).withColumn("kind", _one_of(F.col("kind"), RESTRICTIONS))


def presence_feed(feed: DataFrame) -> DataFrame:
    return feed.filter(F.col("at_ms").isNotNull()).withColumn("kind", F.when(F.col("kind").isin(*PRESENCE), F.col("kind")).otherwise("HIDDEN_PRESENT"))


def parse_verdicts(completions: DataFrame, max_reason: int = 400) -> DataFrame:
    """(event_id, classification, confidence, reason) from a classifier's text: one code fence comes off, the outermost
    braces are read; rows with an unknown label, a confidence outside 0..1 or no reason are left out."""
    bare = F.regexp_replace(F.trim("completion"), r"^```[a-zA-Z]*\s*|\s*```$", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    v = F.from_json(body, "classification string, confidence double, reason string")
    rows = completions.withColumn("v", v).select("event_id", F.upper("v.classification").alias("classification"), F.col("v.confidence").alias("confidence"), F.trim("v.reason").alias("reason"))
    good = F.col("classification").isin(*CLASSES) & F.col("confidence").between(0, 1) & (F.col("reason") != "")
    return rows.filter(good).withColumn("reason", F.left("reason", F.lit(max_reason)))


def as_of(times: DataFrame, marks: DataFrame, at: str, mark: str) -> DataFrame:
    """(at, mark): for each different time the latest mark at or before it, null before the first. A merge: both sides are
    range-partitioned by time together, the last mark is carried along each partition and over the ends of partitions, of which
    there is one row each."""
    both = times.select(F.col(at).cast("long").alias("t"), F.lit(1).alias("asks")).unionByName(marks.select(F.col(mark).cast("long").alias("t"), F.lit(0).alias("asks"))).distinct()
    placed = materialise(both.repartitionByRange("t").withColumn("part", F.spark_partition_id()), "as-of")
    ends = placed.filter("asks = 0").groupBy("part").agg(F.max("t").alias("end"))
    ends = placed.select("part").distinct().join(ends, "part", "left")
    ends = ends.select("part", F.last("end", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = F.last(F.when(F.col("asks") == 0, F.col("t")), ignorenulls=True).over(W.partitionBy("part").orderBy("t", "asks").rowsBetween(W.unboundedPreceding, 0))
    found = placed.withColumn("last", inside).filter("asks = 1").join(ends, "part", "left")
    return found.select(F.col("t").alias(at), F.coalesce("last", "carried").alias(mark))


def config_at(events: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds the version and patch of the config that was current at each event; of versions of the same time the greatest counts. Times
    are merged with times, so neither side is broadcast by force nor compared with all of the other."""
    at, since, mark, c = (free_name(events, x) for x in ("at", "since", "mark", "config"))
    newest = configs.groupBy(F.col("updated_ms").alias(mark)).agg(F.max(F.struct("version", "patch")).alias(c))
    found = as_of(events, configs, "at_ms", "updated_ms").select(F.col("at_ms").alias(at), F.col("updated_ms").alias(since))
    rows = events.join(found, F.col("at_ms") == F.col(at), "left").join(newest, F.col(since) == F.col(mark), "left")
    return rows.withColumns({"config_version": F.col(f"{c}.version"), "config_patch": F.col(f"{c}.patch")}).drop(at, since, mark, c)


def current_config(configs: DataFrame) -> DataFrame:
    return configs.agg(F.max_by(F.struct("version", "patch", "updated_by", "updated_ms"), "updated_ms").alias("c")).select("c.*")
