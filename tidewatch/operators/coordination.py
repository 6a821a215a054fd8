"""Accounts that act together in a room, per sweep window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import CoordinationConfig
from tidewatch.functions import math as M
from tidewatch.operators.spam import fp_key, fp_length, is_content
from tidewatch.operators.windows import FIRST


def sweep_of(at_ms: Column, c: CoordinationConfig) -> Column:
    return F.floor(at_ms / c.sweep_ms) * c.sweep_ms


def _busy(events: DataFrame, c: CoordinationConfig) -> DataFrame:
    """Rooms and sweeps with enough accounts of any kind of event."""
    people = events.select("room_id", sweep_of(F.col("at_ms"), c).alias("sweep_ms"), "user_id").distinct()
    return people.groupBy("room_id", "sweep_ms").agg(F.count("*").alias("accounts")).filter(F.col("accounts") >= c.min_accounts).select("room_id", "sweep_ms")


def identical_content(featured: DataFrame, c: CoordinationConfig, min_length: int = 24) -> DataFrame:
    """One row for each text that several accounts sent into a room in one sweep; a flooder counts once."""
    said = featured.filter(is_content() & (fp_length(featured) >= min_length)).select("room_id", sweep_of(F.col("at_ms"), c).alias("sweep_ms"), fp_key(featured).alias("key"), "user_id").distinct()
    found = said.groupBy("room_id", "sweep_ms", "key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("user_id")).alias("user_ids")).filter(F.col("n") >= c.min_accounts)
    found = found.join(_busy(featured, c), ["room_id", "sweep_ms"], "left_semi")
    confidence = F.least(0.6 + 0.3 * M.saturate(F.col("n"), c.min_accounts, 3 * c.min_accounts), F.lit(0.95))
    return found.select("room_id", "sweep_ms", "key", F.lit("COORDINATED_IDENTICAL_CONTENT").alias("code"), "n", F.when(F.col("n") >= c.severe_accounts, "HIGH").otherwise("MEDIUM").alias("severity"), M.half_up(confidence, 4).alias("confidence"), "user_ids")


def synchronized_joins(events: DataFrame, c: CoordinationConfig) -> DataFrame:
    """The earliest cluster of joins in each room and sweep; evenly spaced ones look scripted. Starts are judged by counts:
    accounts that join for the first time in the sweep are different ones, so enough of them ahead settle a start, and
    too few joins rule it out. Only starts between, which come before a settled one, look at the joins ahead; lists are
    made for the winning start alone."""
    keys, width = ["room_id", "sweep_ms"], c.join_window_ms
    joins = events.filter("event_type = 'join'").select("room_id", sweep_of(F.col("at_ms"), c).alias("sweep_ms"), "at_ms", "seq", "user_id")
    new = F.when(F.row_number().over(W.partitionBy(*keys, "user_id").orderBy("at_ms", "seq")) == 1, 1).otherwise(0)
    # running sums up to the window's end, less those before it: no frame slides, however many join in a window
    along = W.partitionBy(*keys).orderBy("at_ms")
    ahead = lambda v: F.sum(v).over(along.rangeBetween(FIRST, width)) - F.coalesce(F.sum(v).over(along.rangeBetween(FIRST, -1)), F.lit(0))
    starts = joins.withColumn("new", new).withColumns({"n_new": ahead(F.col("new")), "n_all": ahead(F.lit(1))}).filter(F.col("n_all") >= c.join_accounts)
    start = F.struct("at_ms", "seq")
    settled = starts.filter(F.col("n_new") >= c.join_accounts).groupBy(*keys).agg(F.min(start).alias("settled"))
    open_ = starts.filter(F.col("n_new") < c.join_accounts).join(settled, keys, "left").filter(F.col("settled").isNull() | (start < F.col("settled")))
    bucket = F.floor(F.col("at_ms") / width)
    near = joins.select(*keys, F.col("at_ms").alias("t"), "user_id", F.floor(F.col("at_ms") / width).alias("bucket"))
    open_ = open_.select(*keys, "at_ms", "seq", F.explode(F.array(bucket, bucket + 1)).alias("bucket")).join(near, [*keys, "bucket"]).filter(F.col("t").between(F.col("at_ms"), F.col("at_ms") + width))
    enough = open_.groupBy(*keys, "at_ms", "seq").agg(F.count_distinct("user_id").alias("n")).filter(F.col("n") >= c.join_accounts)
    first = settled.select(*keys, F.col("settled").alias("start")).unionByName(enough.select(*keys, start.alias("start"))).groupBy(*keys).agg(F.min("start.at_ms").alias("from_ms"))
    inside = joins.join(first, keys).filter(F.col("at_ms").between(F.col("from_ms"), F.col("from_ms") + width))
    first = inside.groupBy(*keys, "from_ms").agg(F.array_sort(F.collect_list("at_ms")).alias("times"), F.array_sort(F.collect_set("user_id")).alias("user_ids"))
    gaps = M.deltas(F.col("times"))
    scripted = (F.size(gaps) >= 3) & (M.array_cv(gaps) < c.scripted_cv)
    found = first.select("room_id", "sweep_ms", F.lit("COORDINATED_SYNCHRONIZED_JOINS").alias("code"), F.size("user_ids").alias("n"), "from_ms", F.when(scripted, "HIGH").otherwise("MEDIUM").alias("severity"), F.when(scripted, 0.8).otherwise(0.55).alias("confidence"), "user_ids")
    return found.join(_busy(events, c), keys, "left_semi")


def findings(featured: DataFrame, c: CoordinationConfig, min_length: int = 24) -> DataFrame:
    columns = ["room_id", "sweep_ms", "code", "n", "severity", "confidence", "user_ids"]
    return identical_content(featured, c, min_length).select(*columns).unionByName(synchronized_joins(featured, c).select(*columns))


def attributed(found: DataFrame) -> DataFrame:
    """One row for every member of a finding."""
    return found.select("room_id", "sweep_ms", "code", "severity", "confidence", F.explode("user_ids").alias("user_id"))


def as_signals(found: DataFrame, events: DataFrame, c: CoordinationConfig) -> DataFrame:
    """Findings in the signals' schema: each belongs to the first event of each member, in any room, once the sweep is over, which is
    when the next assessment can know of it. Members who never come back have none. An as-of join by one window over both."""
    reports = attributed(found).select("user_id", (F.col("sweep_ms") + c.sweep_ms).alias("at_ms"), F.struct("code", "severity", "confidence", "sweep_ms").alias("finding"))
    both = events.select("user_id", "at_ms", F.struct("room_id", "event_id", "at_ms", "seq").alias("event"), "seq").unionByName(reports, allowMissingColumns=True)
    after = W.partitionBy("user_id").orderBy("at_ms", F.col("seq").asc_nulls_first()).rowsBetween(0, W.unboundedFollowing)
    rows = both.withColumn("next", F.first("event", ignorenulls=True).over(after)).filter(F.col("finding").isNotNull() & F.col("next").isNotNull())
    category = F.lit("COORDINATION")
    return rows.select("user_id", "next.room_id", "next.event_id", "next.at_ms", "next.seq", "finding.code", category.alias("category"), "finding.severity", "finding.confidence", F.create_map(F.lit("sweep_ms"), F.col("finding.sweep_ms").cast("double")).alias("details"))


def sweep_summary(found: DataFrame) -> DataFrame:
    """Per sweep: rooms, findings and distinct accounts."""
    rooms = found.groupBy("sweep_ms").agg(F.count_distinct("room_id").alias("rooms"), F.count("*").alias("findings"))
    people = attributed(found).groupBy("sweep_ms").agg(F.count_distinct("user_id").alias("accounts"))
    return rooms.join(people, "sweep_ms")
