"""Streams with state of their own: a user's rolling signals and score, and a room's synchronised joins.

Both wait for the watermark: a row is judged once no earlier one can come any more, in time order, so what a stream gives doesn't
depend on the order of arrival within the lateness that the watermark allows, and equals the batch operators over all rows. Rows
that come later still are dropped by Spark and counted in its progress (``dropped_rows``). State is kept by key in Spark's state
store and survives a restart from the checkpoint. transformWithStateInPandas needs the RocksDB store: ``use_state_store``.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidewatch.config import SIGNALS, Config, RiskConfig
from tidewatch.functions import text as T
from tidewatch.operators.coordination import sweep_of
from tidewatch.operators.risk import History

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over the progress reports that the query still holds."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


class Event(NamedTuple):
    """What a user's window keeps of an event; no text."""

    at_ms: int
    seq: int
    event_id: str
    room_id: str
    event_type: str
    key: str | None
    fp_length: int
    mentions: int
    version: str | None
    platform: str | None


EVENT = "at_ms long, seq long, event_id string, room_id string, event_type string, key string, fp_length int, mentions int, version string, platform string"
CONTENT = ("message", "voice")
#: Signals that a user's own window gives; what needs whole texts or other tables stays with detect_batches.
ROLLING = (
    "SPAM_BURST", "SPAM_HIGH_FREQUENCY", "BOT_SUSTAINED_RATE", "SPAM_IDENTICAL_REPEAT", "SPAM_MENTION_FLOOD", "CLIENT_VERSION_FLAPPING", "CLIENT_PLATFORM_MISMATCH", "EVASION_REJOIN_CYCLING",
)


def narrow(featured: DataFrame) -> DataFrame:
    """Events with text features (fp, mentions) as what the state keeps, with ts for the watermark."""
    fp = F.when(F.col("event_type").isin(*CONTENT), F.col("fp"))
    return featured.select(
        "user_id", "at_ms", "seq", "event_id", "room_id", "event_type", F.md5(fp).alias("key"), F.coalesce(T.utf16_length(fp), F.lit(0)).cast("int").alias("fp_length"),
        F.coalesce("mentions", F.lit(0)).cast("int").alias("mentions"), F.col("client_version").alias("version"), "platform", F.timestamp_millis("at_ms").alias("ts"),
    )


def _saturate(n: float, threshold: float, full: float) -> float:
    return (0.0 if n <= threshold else 1.0) if full <= threshold else min(max((n - threshold) / (full - threshold), 0.0), 1.0)


def _half_up(x: float, places: int) -> float:
    return math.floor(x * 10.0**places + 0.5) / 10.0**places


def judge(events: list[Event], first: int, c: Config) -> Iterator[tuple[Event, dict[str, float]]]:
    """Codes and confidences of the events from index ``first`` on. events: one user's, in order of time and number, from the
    horizon before the first on."""
    s, k, e = c.spam, c.client, c.evasion
    times = [x.at_ms for x in events]
    running = lambda values: [0, *accumulate(values)]
    content, mentions = running(int(x.event_type in CONTENT) for x in events), running(x.mentions if x.event_type in CONTENT else 0 for x in events)
    for i in range(first, len(events)):
        x, found = events[i], {}
        since = lambda width: bisect_left(times, x.at_ms - width)  # noqa: B023, E731
        seen = lambda sums, width: sums[i + 1] - sums[max(since(width), i - s.max_window_events)]  # noqa: B023, E731
        burst, window, sustained = (seen(content, w) for w in (s.burst_window_ms, s.window_ms, s.sustained_window_ms))
        if burst >= s.burst_count:
            found["SPAM_BURST"] = 0.6 + 0.35 * _saturate(burst, s.burst_count, 3 * s.burst_count)
        if window >= s.high_frequency_count:
            found["SPAM_HIGH_FREQUENCY"] = 0.55 + 0.4 * _saturate(window, s.high_frequency_count, 3 * s.high_frequency_count)
        if sustained >= s.sustained_count:
            found["BOT_SUSTAINED_RATE"] = 0.75
        if x.event_type in CONTENT and (x.mentions > s.mentions_per_message or seen(mentions, s.window_ms) > s.mentions_per_window):
            found["SPAM_MENTION_FLOOD"] = 0.7
        if x.key is not None:
            times_over = s.identical_short_multiplier if x.fp_length <= s.identical_short_length else 1
            many, full = s.identical_repeat_count * times_over, s.identical_severe_count * times_over
            n = sum(y.key == x.key for y in events[max(since(s.horizon_ms), i - s.max_window_events) : i + 1])
            if n >= many:
                found["SPAM_IDENTICAL_REPEAT"] = 0.95 if n >= full else 0.65 + 0.3 * _saturate(n, many, full)
        upto = bisect_right(times, x.at_ms)  # versions and platforms of the same millisecond count whatever their order
        versions = {y.version for y in events[since(min(k.version_flap_window_ms, s.horizon_ms)) : upto]} - {None}
        if len(versions) >= k.version_flap_count:
            found["CLIENT_VERSION_FLAPPING"] = 0.7 + 0.2 * _saturate(len(versions), k.version_flap_count, 2 * k.version_flap_count)
        platforms = {y.platform for y in events[since(s.horizon_ms) : upto]} - {None, "unknown"}
        if len(platforms) > 1:
            found["CLIENT_PLATFORM_MISMATCH"] = 0.65
        elif x.platform == "unknown" and k.known_versions:
            found["CLIENT_PLATFORM_MISMATCH"] = 0.4
        here = [y.event_type for y in events[since(e.rejoin_window_ms) : i + 1] if y.room_id == x.room_id]
        moves = min(here.count("join"), here.count("leave") - (x.event_type == "leave"))
        if moves >= e.rejoin_count:
            found["EVASION_REJOIN_CYCLING"] = 0.65 + 0.25 * _saturate(moves, e.rejoin_count, 3 * e.rejoin_count)
        yield x, {code: _half_up(v, 4) for code, v in found.items()}


def applied(codes: dict[str, float], c: RiskConfig) -> list[float]:
    """What each signal adds to the score."""
    weights = {k: float(c.weights.get(k, 0.0)) for k in codes}
    return [min(weights[k] * min(1.0, v / c.confidence_floor), float(c.max_single)) for k, v in sorted(codes.items()) if weights[k] > 0]


SCORES = "user_id string, event_id string, at_ms long, seq long, codes array<string>, score int, level string, history double, repeat_bonus double, violations int, evasions int"
_NEVER = -1


class UserScores(StatefulProcessor):
    """By user: rows that wait for the watermark and the judged ones of the horizon (list states), the history (value state), a timer
    for the next row to judge and one at which an idle user's state goes. The horizon is by time; a row of it has no text."""

    def __init__(self, config: Config, forget_ms: int):
        self.config, self.forget_ms = config, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.window = handle.getListState("waiting", EVENT), handle.getListState("window", EVENT)
        self.past = handle.getValueState("past", "carried double, violations int, evasions int, last long, newest long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [Event(*(None if v is None or v != v else v for v in r)) for frame in rows for r in frame[list(Event._fields)].astype(object).itertuples(index=False)]
        for x in self.handle.listTimers():
            self.handle.deleteTimer(x)
        self.waiting.appendList([(int(x.at_ms), int(x.seq), *x[2:6], int(x.fp_length), int(x.mentions), *x[8:]) for x in new])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: Any, watermark: int) -> Iterator[pd.DataFrame]:
        """Judges what no row can precede any more, and sets the timer for what is next."""
        c, waiting = self.config, sorted(Event(*x) for x in self.waiting.get())
        ready = [x for x in waiting if x.at_ms <= watermark]
        past = self.past.get() if self.past.exists() else (0.0, 0, 0, _NEVER, _NEVER)
        if ready:
            window = [Event(*x) for x in self.window.get()]
            history = History(c.risk, past[0], past[1], past[2], None if past[3] == _NEVER else past[3])
            out = []
            for x, codes in judge(window + ready, len(window), c):
                parts = applied(codes, c.risk)
                if not parts:
                    continue
                evading = "EVASION_REJOIN_CYCLING" in codes
                score, level, carried, bonus = history.step(x.at_ms, math.fsum(parts), len(parts), False, evading)
                out.append((key[0], x.event_id, x.at_ms, x.seq, sorted(codes), score, level, _half_up(carried, 2), bonus, history.violations, history.evasions))
            carried, violations, evasions, last = history.state()
            past = (float(carried), int(violations), int(evasions), _NEVER if last is None else int(last), ready[-1].at_ms)
            self.past.update(past)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCORES.split(", ")])
            width = max(c.spam.horizon_ms, c.spam.sustained_window_ms, c.evasion.rejoin_window_ms)
            kept = [x for x in window + ready if x.at_ms >= ready[-1].at_ms - width]
            self._put(self.window, kept)
            waiting = [x for x in waiting if x.at_ms > watermark]
            self._put(self.waiting, waiting)
        if waiting:
            self.handle.registerTimer(waiting[0].at_ms)
        elif watermark >= past[4] + self.forget_ms:
            for state in (self.waiting, self.window, self.past):
                state.clear()
        else:
            self.handle.registerTimer(past[4] + self.forget_ms)

    @staticmethod
    def _put(state: Any, rows: list[Event]) -> None:
        state.put([tuple(x) for x in rows]) if rows else state.clear()

    def close(self) -> None:
        pass


def user_scores(featured: DataFrame, c: Config, late: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """One streaming job that detects and scores: a row for each event with signals of ROLLING, with its codes and the score that
    the batch fold gives. featured: a stream of events with fp and mentions. forget_ms: after so long without an event a user's
    state goes; by default when their history has decayed to nothing."""
    forget = forget_ms if forget_ms is not None else 64 * c.risk.history_half_life_ms
    rows = narrow(featured).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(UserScores(c, forget), SCORES, "append", "EventTime")


JOINED = "room_id string, sweep_ms long, code string, n int, from_ms long, severity string, confidence double, user_ids array<string>"


class RoomJoins(StatefulProcessor):
    """By room: joins of the open sweeps, and for each sweep the accounts of any event, up to as many as the gate asks for. A timer at
    each sweep's end gives its finding and clears it."""

    def __init__(self, config: Config):
        self.c = config.coordination

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.joins = handle.getMapState("joins", "sweep_ms long, seq long, user_id string", "at_ms long")
        self.people = handle.getMapState("people", "sweep_ms long", "user_ids array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        timers, seen = set(self.handle.listTimers()), {}
        for frame in rows:
            for sweep, at, seq, user, kind in frame[["sweep_ms", "at_ms", "seq", "user_id", "event_type"]].itertuples(index=False, name=None):
                sweep = int(sweep)
                if sweep not in seen:
                    seen[sweep] = list(self.people.getValue((sweep,))[0]) if self.people.containsKey((sweep,)) else []
                if user is not None and user not in seen[sweep] and len(seen[sweep]) < self.c.min_accounts:
                    seen[sweep].append(user)
                if kind == "join":
                    self.joins.updateValue((sweep, int(seq), user), (int(at),))
        for sweep, users in seen.items():
            self.people.updateValue((sweep,), (users,))
            if (end := sweep + self.c.sweep_ms - 1) not in timers:
                self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        sweep = expiredTimerInfo.getExpiryTimeInMs() + 1 - self.c.sweep_ms
        own = [(k, v[0]) for k, v in self.joins.iterator() if k[0] == sweep]
        joins = sorted((at, k[1], k[2]) for k, at in own)
        enough = len(self.people.getValue((sweep,))[0]) >= self.c.min_accounts
        for k, _ in own:
            self.joins.removeKey(k)
        self.people.removeKey((sweep,))
        found = first_cluster(joins, self.c.join_window_ms, self.c.join_accounts) if enough else None
        if found:
            times, users = found
            gaps = [b - a for a, b in zip(times, times[1:])]
            scripted = len(gaps) >= 3 and _cv(gaps) < self.c.scripted_cv
            row = (key[0], sweep, "COORDINATED_SYNCHRONIZED_JOINS", len(users), times[0], "HIGH" if scripted else "MEDIUM", 0.8 if scripted else 0.55, sorted(users))
            yield pd.DataFrame([row], columns=[f.split()[0] for f in JOINED.split(", ")])

    def close(self) -> None:
        pass


def first_cluster(joins: list[tuple[int, int, str]], width: int, accounts: int) -> tuple[list[int], set[str]] | None:
    """Times and accounts of the earliest span of ``width`` in which so many accounts join; joins in time order."""
    inside: dict[str, int] = {}
    end = 0
    for i, (at, _, user) in enumerate(joins):
        while end < len(joins) and joins[end][0] <= at + width:
            inside[joins[end][2]] = inside.get(joins[end][2], 0) + 1
            end += 1
        if len(inside) >= accounts:
            return [x[0] for x in joins[i:end]], set(inside)
        inside[user] -= 1
        if not inside[user]:
            del inside[user]
    return None


def _cv(gaps: list[int]) -> float:
    n, mean = len(gaps), sum(gaps) / len(gaps)
    return 0.0 if n < 2 or mean == 0 else math.sqrt(sum((g - mean) ** 2 for g in gaps) / (n - 1)) / mean


def synchronized_joins(events: DataFrame, c: Config, late: str = "10 minutes") -> DataFrame:
    """The batch operator's findings as a stream, a row when a room's sweep is over. Only joins and first appearances are kept."""
    rows = events.select("room_id", sweep_of(F.col("at_ms"), c.coordination).alias("sweep_ms"), "at_ms", "seq", "user_id", "event_type", F.timestamp_millis("at_ms").alias("ts"))
    return rows.withWatermark("ts", late).groupBy("room_id").transformWithStateInPandas(RoomJoins(c), JOINED, "append", "EventTime")
