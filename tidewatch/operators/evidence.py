"""Evidence bundles in a hash chain, their verification, and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import DAY
from tidewatch.functions import hashing as H
from tidewatch.sources.shared import materialise

ZEROS, SCHEMA_VERSION = "0" * 64, 1
AUTHORISATION = "made from events and feeds that the platform hands over; nothing was asked of a device or of another account"
COLLECTED = {"messages": "redacted excerpts", "signals": "codes, severities and confidences", "events": "identifiers and times"}
NOT_COLLECTED = {"audio": "never read", "device identifiers": "never read", "precise location": "never read"}


def bodies(incidents: DataFrame, capabilities: dict[str, str] | None = None) -> DataFrame:
    """(incident_id, user_id, created_ms, body): the canonical JSON of what is kept, with the signals if incidents name them
    (column signals) and the statement of what it was made from. capabilities: feed to status; those that are available
    join what was collected, all others what wasn't, with their status."""
    had = [*COLLECTED, *sorted(k for k, v in (capabilities or {}).items() if v == "available")]
    not_had = [*NOT_COLLECTED, *(f"{k}: {v}" for k, v in sorted((capabilities or {}).items()) if v != "available")]
    named = {"signals": F.col("signals")} if "signals" in incidents.columns else {}
    body = H.canonical_json(
        incidentId=F.col("incident_id"), userId=F.col("user_id"), roomId=F.col("room_id"), createdMs=F.col("created_ms"), riskScore=F.col("risk_score"), riskLevel=F.col("risk_level"),
        behaviors=F.col("behaviors"), messages=F.transform("messages", lambda m: m["excerpt"]), schemaVersion=F.lit(SCHEMA_VERSION), collected=F.array(*map(F.lit, had)), notCollected=F.array(*map(F.lit, not_had)),
        authorisation=F.lit(AUTHORISATION), **named,
    )
    return incidents.select("incident_id", "user_id", "created_ms", body.alias("body"))


def chain(found: DataFrame) -> DataFrame:
    """Adds sequence, content_hash, previous_hash and chain_hash in order of (created_ms, incident_id). A link needs only
    its neighbour's content hash, so narrow rows are sorted by range and numbered from per-partition counts; the last
    hash of a partition comes from the nearest one before it that has rows."""
    order = ["created_ms", "incident_id"]
    n = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = found.select(*order, H.sha256(F.col("body")).alias("content_hash")).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    keys = materialise(keys, "evidence-order")  # range bounds are sampled: both uses must see these
    ends = keys.groupBy("part").agg(F.count("*").alias("n"), F.max_by("content_hash", F.struct(*order)).alias("end"))  # a row for each partition
    w = W.orderBy("part")
    ends = ends.select("part", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.coalesce(F.lag("end").over(w), F.lit(ZEROS)).alias("start"))
    inside = W.partitionBy("part").orderBy(*order)
    rows = keys.join(F.broadcast(ends), "part").select(*order, "content_hash", (F.col("before") + F.row_number().over(inside) - 1).alias("sequence"), F.coalesce(F.lag("content_hash").over(inside), F.col("start")).alias("previous_hash"))
    rows = rows.withColumn("chain_hash", H.sha256(F.concat("previous_hash", "content_hash")))
    return found.join(rows, order)


def evidence_key(user_id: str = "user_id", incident_id: str = "incident_id", created_ms: str = "created_ms", bundle: int = 0):
    day = F.date_format(F.timestamp_millis(F.col(created_ms)), "yyyy/MM/dd")
    return F.concat_ws("/", F.lit("evidence"), day, F.left(H.sha256(F.col(user_id)), F.lit(4)), F.col(incident_id), F.lit(f"{bundle:04d}.json"))


def verify_bundles(chained: DataFrame) -> DataFrame:
    """Adds problems: what is wrong with a bundle by itself."""
    content = H.sha256(F.col("body"))
    link = H.sha256(F.concat("previous_hash", "content_hash"))
    version = F.get_json_object("body", "$.schemaVersion").cast("int")
    made = F.array(F.when(content != F.col("content_hash"), F.lit("content")), F.when(link != F.col("chain_hash"), F.lit("chain_hash")), F.when(version.isNull() | (version != SCHEMA_VERSION), F.lit("schema_version")))
    return chained.withColumn("problems", F.filter(made, lambda p: p.isNotNull()))


def verify_chain(chained: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds to problems: gap where a sequence number's predecessor is missing (its link can't be right either), and
    broken_link between neighbours, over the whole chain or within keys. Neighbours meet by their numbers, so that no task
    holds a chain."""
    keys = keys or []
    narrow = chained.select(*keys, "sequence", "content_hash")
    before = narrow.groupBy(*keys, (F.col("sequence") + 1).alias("sequence")).agg(F.min("content_hash").alias("_hash"))
    rows = verify_bundles(chained).join(before, [*keys, "sequence"], "left")
    if keys:
        rows = rows.join(narrow.groupBy(*keys).agg(F.min("sequence").alias("_first")), keys)
    else:
        rows = rows.withColumn("_first", F.lit(narrow.agg(F.min("sequence")).first()[0]))
    first = F.col("sequence") == F.col("_first")
    gap = ~first & F.col("_hash").isNull()
    broken = F.when(first, (F.col("sequence") == 0) & (F.col("previous_hash") != ZEROS)).otherwise(gap | (F.col("previous_hash") != F.col("_hash")))
    more = F.filter(F.array(F.when(gap, F.lit("gap")), F.when(broken, F.lit("broken_link"))), lambda p: p.isNotNull())
    return rows.select(*chained.columns, F.concat("problems", more).alias("problems"))


def keys_of(incident_id: str, chained: DataFrame) -> DataFrame:
    """(sequence, key) of an incident's bundles, in the order of the chain."""
    return chained.filter(F.col("incident_id") == incident_id).select("sequence", evidence_key().alias("key")).orderBy("sequence")


def verify_incidents(keys: DataFrame, chained: DataFrame) -> DataFrame:
    """Per incident: bundles expected, missing ones, and bundles with problems. keys: incident_id, created_ms."""
    found = verify_bundles(chained).select("incident_id", "created_ms", F.lit(1).alias("there"), (F.size("problems") > 0).cast("int").alias("bad"))
    return keys.join(found, ["incident_id", "created_ms"], "left").groupBy("incident_id").agg(F.count("*").alias("expected"), F.count_if(F.col("there").isNull()).alias("missing"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


def retention_plan(incidents: DataFrame, chained: DataFrame, now_ms: int, incident_days: int, evidence_days: int) -> DataFrame:
    """Bundles to delete or keep: both the incident and its bundle must be old. Deletion leaves an audit row with the hash."""
    old = incidents.filter(F.col("updated_ms") < now_ms - incident_days * DAY).select("incident_id")
    rows = chained.select("incident_id", "created_ms", "content_hash").join(old.withColumn("old", F.lit(True)), "incident_id", "left")
    gone = F.col("old").isNotNull() & (F.col("created_ms") < now_ms - evidence_days * DAY)
    return rows.select("incident_id", "created_ms", "content_hash", F.when(gone, "delete").otherwise("keep").alias("decision"), F.when(gone, F.concat(F.lit("retention:"), "content_hash")).alias("audit_detail"))


def unexpired(rows: DataFrame, now_ms: int, column: str = "expires_at") -> DataFrame:
    """Rows whose stamp (in seconds) hasn't passed."""
    return rows.filter(F.col(column) > F.lit(now_ms // 1000))
