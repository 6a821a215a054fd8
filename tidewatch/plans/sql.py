"""DuckDB SQL for the registered queries. T is the event table, as sources.telemetry makes it."""

from __future__ import annotations

from tidewatch.config import WIDE

#: d, n: document and event numbers; stride: numbers that an event and the documents dealt to it take.
T = """
size AS (SELECT *, d // n + 2 AS stride FROM (SELECT (SELECT max(doc_id) + 1 FROM documents) AS d, (SELECT max(event_id) + 1 FROM events) AS n)),
turns AS (SELECT event_id AS number, event_id * stride AS seq, user_id, event_type, ts, ((user_id % 20) * 5 + event_id % 5) * greatest(1, d // 100) % d AS doc_id FROM events, size),
posts AS (
  SELECT number, seq, user_id, event_type, ts, CASE WHEN event_type IN ('click', 'view') THEN x.text END AS message, CASE WHEN event_type IN ('click', 'view') THEN turns.doc_id END AS doc_id, number AS turn
  FROM turns LEFT JOIN documents x ON x.doc_id = turns.doc_id
  UNION ALL
  SELECT NULL, e.event_id * stride + 1 + x.doc_id // n, e.user_id, 'click', e.ts, x.text, x.doc_id, e.event_id FROM documents x, size, events e WHERE e.event_id = x.doc_id % n * greatest(1, n // d)
),
t AS (
  SELECT seq::VARCHAR AS event_id, seq, number, 'u' || user_id AS user_id,
    'r' || ((user_id + CASE WHEN turn % 10 = 0 THEN 1 ELSE 0 END) % 10) AS room_id, epoch_us(ts) // 1000 AS at_ms,
    CASE event_type WHEN 'click' THEN 'message' WHEN 'view' THEN 'voice' WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'moderation' END AS event_type,
    message, doc_id, event_type IN ('click', 'view') AS content, '4.2.' || (turn % 5) AS client_version, ['ios', 'android', 'web', 'desktop'][turn % 4 + 1] AS platform
  FROM posts
)"""


def trailing(value: str, width: int, keys: str, cap: int | None = None) -> str:
    seen = f"coalesce(sum({value}) OVER (PARTITION BY {keys} ORDER BY at_ms RANGE BETWEEN {width} PRECEDING AND CURRENT ROW), 0)"
    later = f"coalesce(sum({value}) OVER (PARTITION BY {keys}, at_ms ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)"
    out = f"({seen} - {later})"
    if cap:
        out = f"least({out}, sum({value}) OVER (PARTITION BY {keys} ORDER BY at_ms, seq ROWS BETWEEN {cap} PRECEDING AND CURRENT ROW))"
    return out


def sat(n: str, low: float, full: float) -> str:
    return f"CASE WHEN {n} <= {low} THEN 0.0 ELSE least(1.0, ({n} - {low}) / {full - low}::DOUBLE) END"


def rounded(x: str, places: int = 4) -> str:
    return f"floor(({x}) * {10**places} + 0.5) / {10.0**places}::DOUBLE"


_s = WIDE.spam
ONE = "CASE WHEN content THEN 1 ELSE 0 END"


def rate(column: str, width: int, least: int, severity: str, confidence: str) -> str:
    return f"""WITH {T}, r AS (SELECT *, {trailing(ONE, width, "user_id", _s.max_window_events)} AS n FROM t)
SELECT user_id, event_id, n::BIGINT AS {column}, {severity} AS severity, {rounded(confidence)} AS confidence FROM r WHERE n >= {least}"""


BURST = rate("n", _s.burst_window_ms, _s.burst_count, f"CASE WHEN n >= {2 * _s.burst_count} THEN 'HIGH' ELSE 'MEDIUM' END", f"0.6 + 0.35 * ({sat('n', _s.burst_count, 3 * _s.burst_count)})")
HIGH_FREQUENCY = rate("n", _s.window_ms, _s.high_frequency_count, f"CASE WHEN n >= {2 * _s.high_frequency_count} THEN 'HIGH' ELSE 'MEDIUM' END", f"0.55 + 0.4 * ({sat('n', _s.high_frequency_count, 3 * _s.high_frequency_count)})")
SUSTAINED = rate("n", _s.sustained_window_ms, _s.sustained_count, "'HIGH'", "0.75")
#: A message's class, for SQL without normal forms: equal letters and digits.
FP = "lower(regexp_replace(message, '[^\\p{L}\\p{N}]', '', 'g'))"
IDENTICAL = f"""WITH {T}, f AS (SELECT *, {FP} AS fp FROM t WHERE content AND message IS NOT NULL),
r AS (SELECT *, {trailing("1", _s.horizon_ms, "user_id, fp")} AS n, CASE WHEN length(fp) <= {_s.identical_short_length} THEN {_s.identical_short_multiplier} ELSE 1 END AS k FROM f)
SELECT user_id, event_id, n::BIGINT AS n, CASE WHEN n >= {_s.identical_severe_count} * k THEN 'SEVERE' ELSE 'MEDIUM' END AS severity,
  CASE WHEN n >= {_s.identical_severe_count} * k THEN 0.95 ELSE {rounded(f"0.65 + 0.3 * CASE WHEN n <= {_s.identical_repeat_count} * k THEN 0.0 ELSE least(1.0, (n - {_s.identical_repeat_count} * k) / (({_s.identical_severe_count} - {_s.identical_repeat_count}) * k)::DOUBLE) END")} END AS confidence
FROM r WHERE n >= {_s.identical_repeat_count} * k"""
UNIFORM = f"""WITH {T}, c AS (SELECT *, list(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, seq ROWS BETWEEN {max(4 * _s.timing_min_samples, 12) - 1} PRECEDING AND CURRENT ROW) AS all_times FROM t WHERE content),
k AS (SELECT *, list_filter(all_times, lambda x: x >= at_ms - {_s.horizon_ms}) AS times FROM c),
g AS (SELECT *, list_transform(range(2, len(times) + 1), lambda i: (times[i] - times[i - 1])::DOUBLE) AS gaps FROM k),
m AS (SELECT *, len(gaps) AS n, list_avg(gaps) AS mean_gap, list_stddev_samp(gaps) / list_avg(gaps) AS cv FROM g WHERE len(gaps) + 1 >= {_s.timing_min_samples})
SELECT user_id, event_id, (n + 1)::BIGINT AS samples, 'HIGH' AS severity,
  {rounded(f"least(0.97, greatest(0, 0.55 + 0.3 * (1 - cv / {_s.timing_max_cv}) + 0.15 * ({sat('n', _s.timing_min_samples, 4 * _s.timing_min_samples)})))")} AS confidence
FROM m WHERE mean_gap BETWEEN {_s.timing_min_mean_gap_ms} AND {_s.timing_max_mean_gap_ms} AND cv <= {_s.timing_max_cv}"""

SQL = {
    "spam_burst": BURST,
    "spam_high_frequency": HIGH_FREQUENCY,
    "bot_sustained_rate": SUSTAINED,
    "spam_identical_repeat": IDENTICAL,
    "bot_uniform_timing": UNIFORM,
}

_c, _e, _k = WIDE.client, WIDE.evasion, WIDE.coordination
_FLAP = min(_c.version_flap_window_ms, _s.horizon_ms)
SQL["client_version_flapping"] = f"""WITH {T}, r AS (SELECT *, count(DISTINCT client_version) OVER (PARTITION BY user_id ORDER BY at_ms RANGE BETWEEN {_FLAP} PRECEDING AND CURRENT ROW) AS n FROM t)
SELECT user_id, event_id, n::BIGINT AS n, 'MEDIUM' AS severity, {rounded(f"0.7 + 0.2 * ({sat('n', _c.version_flap_count, 2 * _c.version_flap_count)})")} AS confidence FROM r WHERE n >= {_c.version_flap_count}"""
SQL["client_platform_mismatch"] = f"""WITH {T}, r AS (SELECT *, count(DISTINCT platform) OVER (PARTITION BY user_id ORDER BY at_ms RANGE BETWEEN {_s.horizon_ms} PRECEDING AND CURRENT ROW) AS n FROM t)
SELECT user_id, event_id, n::BIGINT AS n, 'MEDIUM' AS severity, 0.65::DOUBLE AS confidence FROM r WHERE n > 1"""
SQL["client_unknown_version"] = f"""WITH {T} SELECT user_id, event_id, 'LOW' AS severity, 0.55::DOUBLE AS confidence FROM t WHERE client_version NOT IN {_c.known_versions}"""
SQL["client_impossible_sequence"] = f"""WITH {T}, r AS (SELECT *,
  last_value(CASE WHEN event_type IN ('join', 'leave') THEN event_type END IGNORE NULLS) OVER w AS last_type,
  last_value(CASE WHEN event_type IN ('join', 'leave') THEN at_ms END IGNORE NULLS) OVER w AS last_ms,
  count(DISTINCT CASE WHEN event_type = 'voice' THEN room_id END) OVER (PARTITION BY user_id ORDER BY at_ms RANGE BETWEEN {_c.voice_window_ms} PRECEDING AND CURRENT ROW) AS voice_rooms
  FROM t WINDOW w AS (PARTITION BY user_id, room_id ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN content AND last_type = 'leave' AND at_ms - last_ms <= {_s.horizon_ms} AND at_ms - last_ms > {_c.leave_grace_ms} THEN 1
  WHEN event_type = 'join' AND last_type = 'join' AND at_ms - last_ms <= {_s.horizon_ms} AND at_ms - last_ms > {_c.join_grace_ms} THEN 2
  WHEN voice_rooms > 1 THEN 3 END AS n FROM r)
SELECT user_id, event_id, n::BIGINT AS "case", 'HIGH' AS severity, 0.85::DOUBLE AS confidence FROM s WHERE n IS NOT NULL"""
R = """r AS (SELECT user_id, at_ms AS applied_ms, CASE WHEN number % 3 <> 0 THEN room_id END AS r_room, CASE WHEN number % 2 = 0 THEN at_ms + 86400000 END AS expires_ms, seq AS feed_seq FROM t WHERE event_type = 'moderation')"""
SQL["evasion_post_moderation"] = f"""WITH {T}, {R}
SELECT t.user_id, event_id, (at_ms - arg_min(applied_ms, feed_seq))::BIGINT AS after_ms, 'HIGH' AS severity, 0.85::DOUBLE AS confidence
FROM t JOIN r ON t.user_id = r.user_id AND at_ms > applied_ms AND at_ms - applied_ms <= {_e.post_moderation_window_ms} AND (expires_ms IS NULL OR at_ms < expires_ms) AND (r_room IS NULL OR r_room = room_id)
WHERE content GROUP BY t.user_id, event_id, at_ms"""
_J, _L = "CASE WHEN event_type = 'join' THEN 1 ELSE 0 END", "CASE WHEN event_type = 'leave' THEN 1 ELSE 0 END"
SQL["evasion_rejoin_cycling"] = f"""WITH {T}, r AS (SELECT *, least({trailing(_J, _e.rejoin_window_ms, "user_id, room_id")}, {trailing(_L, _e.rejoin_window_ms, "user_id, room_id")} - {_L}) AS n FROM t)
SELECT user_id, event_id, n::BIGINT AS n, 'MEDIUM' AS severity, {rounded(f"0.65 + 0.25 * ({sat('n', _e.rejoin_count, 3 * _e.rejoin_count)})")} AS confidence FROM r WHERE n >= {_e.rejoin_count}"""
SQL["ghost_presence"] = f"""WITH {T}, p AS (SELECT user_id, room_id, min(at_ms) AS first, max(at_ms) AS last, arg_max(event_type, seq) AS kind FROM t
  WHERE event_type IN ('join', 'leave') GROUP BY ALL),
i AS (SELECT user_id, room_id, first - {_e.presence_tolerance_ms} AS from_ms, CASE WHEN kind = 'leave' THEN last ELSE (SELECT max(at_ms) FROM t) END + {_e.presence_tolerance_ms} AS to_ms FROM p),
j AS (SELECT t.user_id, t.room_id, from_ms, to_ms, count(*) AS n FROM t JOIN i ON t.user_id = i.user_id AND t.room_id = i.room_id AND at_ms BETWEEN from_ms AND to_ms GROUP BY ALL)
SELECT user_id, room_id, from_ms, to_ms, n, 'LOW' AS severity, {rounded(f"least(0.95, 0.5 + 0.4 * ({sat('n', _e.presence_min_events, 5 * _e.presence_min_events)}))")} AS confidence FROM j WHERE n >= {_e.presence_min_events}"""
_SWEEP = f"at_ms // {_k.sweep_ms} * {_k.sweep_ms}"
_BUSY = f"busy AS (SELECT room_id, {_SWEEP} AS sweep_ms FROM t GROUP BY ALL HAVING count(DISTINCT user_id) >= {_k.min_accounts})"
SQL["coordinated_content"] = f"""WITH {T}, {_BUSY}, f AS (SELECT room_id, {_SWEEP} AS sweep_ms, {FP} AS fp, count(DISTINCT user_id) AS n, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM t WHERE content AND length({FP}) >= {_s.coordination_min_length} GROUP BY ALL)
SELECT f.room_id, f.sweep_ms, n::BIGINT AS n, CASE WHEN n >= {_k.severe_accounts} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {rounded(f"least(0.95, 0.6 + 0.3 * ({sat('n', _k.min_accounts, 3 * _k.min_accounts)}))")} AS confidence, users
FROM f SEMI JOIN busy USING (room_id, sweep_ms) WHERE n >= {_k.min_accounts}"""
SQL["coordinated_joins"] = f"""WITH {T}, {_BUSY}, j AS (SELECT *, {_SWEEP} AS sweep_ms FROM t WHERE event_type = 'join'),
w AS (SELECT room_id, sweep_ms, at_ms, seq, list(DISTINCT user_id) OVER (PARTITION BY room_id, sweep_ms ORDER BY at_ms RANGE BETWEEN CURRENT ROW AND {_k.join_window_ms} FOLLOWING) AS users FROM j)
SELECT room_id, sweep_ms, arg_min(len(users), seq)::BIGINT AS n, min(at_ms) AS from_ms FROM w SEMI JOIN busy USING (room_id, sweep_ms) WHERE len(users) >= {_k.join_accounts} GROUP BY ALL"""

_r, _x = WIDE.risk, WIDE.case
#: The signals whose rules SQL can say, as the case queries use them.
_PARTS = {
    "SPAM_BURST": "spam_burst",
    "SPAM_HIGH_FREQUENCY": "spam_high_frequency",
    "BOT_SUSTAINED_RATE": "bot_sustained_rate",
    "CLIENT_VERSION_FLAPPING": "client_version_flapping",
    "CLIENT_IMPOSSIBLE_SEQUENCE": "client_impossible_sequence",
    "EVASION_POST_MODERATION_ACTIVITY": "evasion_post_moderation",
    "EVASION_REJOIN_CYCLING": "evasion_rejoin_cycling",
}
SIG = "sig AS (" + " UNION ALL ".join(f"SELECT user_id, event_id, '{code}' AS code, severity, confidence::DOUBLE AS confidence FROM ({SQL[name]})" for code, name in _PARTS.items()) + ")"
_WEIGHT = "CASE code " + " ".join(f"WHEN '{code}' THEN {float(_r.weights[code])}::DOUBLE" for code in _PARTS) + " END"
_LEVEL = f"CASE WHEN score >= {_r.thresholds['CRITICAL']} THEN 'CRITICAL' WHEN score >= {_r.thresholds['HIGH']} THEN 'HIGH' WHEN score >= {_r.thresholds['MEDIUM']} THEN 'MEDIUM' ELSE 'LOW' END"
RISK = f"""{T}, {SIG},
best AS (SELECT user_id, event_id, code, max(confidence) AS c FROM sig GROUP BY ALL),
weighed AS (SELECT *, least({_WEIGHT} * least(1.0, c / {_r.confidence_floor}), {_r.max_single}) AS applied FROM best),
summed AS (SELECT event_id, floor(least(100, sum(applied)) + 0.5)::INTEGER AS score, max(c) AS peak_confidence, sum(applied)::DOUBLE AS total, count(*) AS n, array_to_string(list_sort(list(code)), ',') AS codes FROM weighed GROUP BY event_id),
scored AS (SELECT t.user_id, t.room_id, t.event_id, t.at_ms, t.seq, score, {_LEVEL} AS level, peak_confidence, total, n, codes FROM summed JOIN t USING (event_id)),
latest AS (SELECT user_id, arg_max(score, seq) AS score, arg_max(level, seq) AS level FROM scored GROUP BY user_id)"""
INCIDENT = f"""{RISK},
serious AS (SELECT *, lag(at_ms) OVER (PARTITION BY user_id, room_id ORDER BY at_ms, seq) AS before FROM scored WHERE level = 'CRITICAL' OR list_contains(string_split(codes, ','), 'THREAT_LANGUAGE')),
marked AS (SELECT *, last_value(CASE WHEN before IS NULL OR at_ms - before > {_x.incident_gap_ms} THEN at_ms END IGNORE NULLS) OVER (PARTITION BY user_id, room_id ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS start_ms FROM serious),
sessioned AS (SELECT *, 'INC-' || strftime(make_timestamp(start_ms * 1000), '%Y%m%d') || '-' || substr(sha256(user_id || '|' || room_id || '|' || start_ms), 1, 8) AS incident_id FROM marked),
cases AS (SELECT incident_id, user_id, room_id, min(at_ms) AS created_ms, max(at_ms) AS updated_ms, count(*) AS n_events, max(score) AS risk_score, arg_max(level, score) AS risk_level FROM sessioned GROUP BY ALL),
firsts AS (SELECT incident_id, code, min(seq) AS seq FROM sessioned JOIN sig USING (event_id) GROUP BY ALL),
behaved AS (SELECT incident_id, list(code ORDER BY seq, code) AS behaviors FROM firsts GROUP BY ALL)"""
_RANGES = "CASE level WHEN 'LOW' THEN '0-24' WHEN 'MEDIUM' THEN '25-49' WHEN 'HIGH' THEN '50-74' ELSE '75-100' END"
SQL |= {
    "risk_scores": f"WITH {RISK} SELECT user_id, event_id, score, level, peak_confidence, n AS n_contributions, codes FROM scored",
    "response_plans": f"""WITH {RISK} SELECT user_id, event_id, level, CASE WHEN level <> 'CRITICAL' THEN 'none' WHEN peak_confidence < {_r.critical_min_confidence} THEN 'low_confidence' ELSE 'unavailable' END AS restriction_status,
  CASE level WHEN 'LOW' THEN 'LOG' WHEN 'MEDIUM' THEN 'LOG,INCREASE_MONITORING' WHEN 'HIGH' THEN 'LOG,INCREASE_MONITORING,RECOMMEND_MUTE,RECOMMEND_BLOCK,RECOMMEND_REPORT'
    ELSE 'LOG,INCREASE_MONITORING,RECOMMEND_MUTE,RECOMMEND_BLOCK,RECOMMEND_REPORT,CREATE_INCIDENT,PRESERVE_EVIDENCE,NOTIFY_MODERATOR' END AS automated,
  CASE level WHEN 'LOW' THEN 'NONE' WHEN 'MEDIUM' THEN 'WARN' ELSE 'MUTE,BLOCK,REPORT' END AS recommended FROM scored""",
    "incident_sessions": f"WITH {INCIDENT} SELECT incident_id, user_id, room_id, created_ms, updated_ms, n_events, risk_score FROM cases",
    "incident_evidence": f"""WITH {INCIDENT}, e AS (SELECT DISTINCT incident_id, seq FROM firsts), n AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY seq) AS bundle FROM e)
SELECT incident_id, seq::VARCHAR AS event_id, bundle::INTEGER AS bundle FROM n WHERE bundle <= {_x.max_evidence}""",
    "retention_plan": f"""WITH {INCIDENT} SELECT incident_id, CASE WHEN updated_ms < (SELECT max(at_ms) FROM t) - {_x.incident_days * 86400000} AND created_ms < (SELECT max(at_ms) FROM t) - {_x.evidence_days * 86400000} THEN 'delete' ELSE 'keep' END AS decision FROM cases""",
    "high_risk_users": f"""WITH {INCIDENT} SELECT l.user_id, upper(substr(sha256('tidewatch:' || l.user_id), 1, 6)) AS handle, score, level, (SELECT max(at_ms) FROM t WHERE t.user_id = l.user_id) AS last_seen_ms,
  (SELECT count(*) FROM cases c WHERE c.user_id = l.user_id) AS open_incidents FROM latest l ORDER BY score DESC, l.user_id LIMIT 20""",
    "user_profiles": f"""WITH {INCIDENT}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r, max(at_ms) OVER (PARTITION BY user_id) AS last FROM t),
u AS (SELECT user_id, count(*) AS events, count(*) FILTER (WHERE at_ms >= last - {_s.window_ms}) AS rate, arg_max(client_version, seq) AS client_version, arg_max(platform, seq) AS platform, string_agg(event_id, ',' ORDER BY seq) FILTER (WHERE r <= 25) AS recent FROM b GROUP BY user_id)
SELECT u.user_id, events, rate, coalesce(score, 0) AS score, coalesce(level, 'LOW') AS level, {_RANGES.replace("level", "coalesce(level, 'LOW')")} AS range, client_version, platform, (SELECT count(*) FROM cases c WHERE c.user_id = u.user_id) AS open_incidents, recent
FROM u LEFT JOIN latest l ON l.user_id = u.user_id""",
    "overview": f"""WITH {INCIDENT} SELECT 'open_incidents' AS counter, count(*) AS n FROM cases UNION ALL SELECT 'high_risk_users', count(*) FROM latest WHERE level IN ('HIGH', 'CRITICAL')
UNION ALL SELECT 'spam_signals', count(*) FROM sig WHERE code LIKE 'SPAM%' OR code LIKE 'BOT%' UNION ALL SELECT 'abuse_signals', 0 UNION ALL SELECT 'effective_blocks', 0""",
    "risk_distribution": f"""WITH {RISK}, levels AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS level) SELECT level, {_RANGES} AS range, (SELECT count(*) FROM latest l WHERE l.level = levels.level) AS n FROM levels""",
    "top_signals": f"WITH {SIG} SELECT code, count(*) AS n FROM sig GROUP BY code ORDER BY n DESC, code LIMIT 8",
    "recent_incidents": f"""WITH {INCIDENT} SELECT incident_id, user_id, risk_score, risk_level, updated_ms, array_to_string(behaviors[1:4], ',') AS behaviors FROM cases JOIN behaved USING (incident_id) ORDER BY updated_ms DESC, incident_id LIMIT 10""",
    "rate_budget": f"""WITH {T}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id, at_ms // 86400000 ORDER BY at_ms, seq) AS hit FROM t)
SELECT user_id AS key, event_id, hit, hit <= 3 AS allowed, greatest(3 - hit, 0) AS remaining, CASE WHEN hit > 3 THEN ceil(((at_ms // 86400000 + 1) * 86400000 - at_ms) / 1000.0)::BIGINT ELSE 0 END AS retry_s FROM h""",
    "rate_trailing": f"""WITH {T} SELECT user_id AS key, event_id, {trailing("1", 3 * 86400000, "user_id")}::BIGINT AS n FROM t""",
}

#: What each number of a batch breaks, as sources.telemetry.raw_events breaks it; the rule and its code are the validation's.
_BROKEN = """broken(number, field, code) AS (VALUES (1, 'userId', 'BAD_CHARACTERS'), (2, 'roomId', 'MISSING'), (3, 'timestamp', 'UNPARSABLE'), (4, 'eventType', 'NOT_ALLOWED'), (6, 'surprise', 'UNKNOWN_FIELD'),
  (9, 'timestamp', 'IN_FUTURE'), (10, 'timestamp', 'TOO_OLD'), (11, 'metadata', 'FORBIDDEN_KEY'), (12, 'clientVersion', 'TOO_LONG'), (13, 'roomId', 'TOO_LONG'), (14, 'messageIsTranscript', 'BAD_TYPE'))"""
_UTF16 = "(length(message) + length(regexp_replace(message, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
_RAW = f"""{T}, {_BROKEN},
raw AS (SELECT *, number % 50 AS n, coalesce(number // 50, -1 - seq // 50) AS batch_id, coalesce(number, seq) % 50 AS idx FROM t),
bad AS (SELECT raw.seq, batch_id, idx, field, code FROM raw JOIN broken ON broken.number = n
  UNION ALL SELECT seq, batch_id, idx, 'message', 'TOO_LONG' FROM raw WHERE {_UTF16} > 4000),
twins AS (SELECT seq, batch_id, idx, row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS nth FROM raw WHERE n IN (15, 16) AND seq NOT IN (SELECT seq FROM bad)),
issues AS (SELECT * FROM bad UNION ALL SELECT seq, batch_id, idx, 'eventId', 'DUPLICATE_IN_BATCH' FROM twins WHERE nth > 1)"""
SQL["validation_issues"] = f"WITH {_RAW} SELECT batch_id, idx, field, code FROM issues"
SQL["accepted_events"] = f"""WITH {_RAW} SELECT seq, user_id, room_id, at_ms, event_type, client_version, CASE WHEN n = 5 THEN 'unknown' ELSE platform END AS platform,
  CASE WHEN n = 8 THEN length('given-' || number) WHEN n IN (15, 16) THEN length('twin-' || batch_id) ELSE 32 END::BIGINT AS id_length FROM raw WHERE seq NOT IN (SELECT seq FROM issues)"""

_MEMBERS = f"""{T}, {_BUSY},
said AS (SELECT room_id, sweep_ms, 'COORDINATED_IDENTICAL_CONTENT' AS code, severity, confidence::DOUBLE AS confidence, string_split(users, ',') AS users FROM ({SQL["coordinated_content"]})),
j AS (SELECT *, {_SWEEP} AS sweep_ms FROM t WHERE event_type = 'join'),
w AS (SELECT room_id, sweep_ms, seq, list(DISTINCT user_id) OVER near AS users, list(at_ms) OVER near AS times FROM j
  WINDOW near AS (PARTITION BY room_id, sweep_ms ORDER BY at_ms RANGE BETWEEN CURRENT ROW AND {_k.join_window_ms} FOLLOWING)),
f AS (SELECT room_id, sweep_ms, arg_min(users, seq) AS users, list_sort(arg_min(times, seq)) AS times FROM w SEMI JOIN busy USING (room_id, sweep_ms) WHERE len(users) >= {_k.join_accounts} GROUP BY ALL),
g AS (SELECT *, list_transform(range(2, len(times) + 1), lambda i: (times[i] - times[i - 1])::DOUBLE) AS gaps FROM f),
s AS (SELECT *, len(gaps) >= 3 AND coalesce(list_stddev_samp(gaps) / nullif(list_avg(gaps), 0), 0) < {_k.scripted_cv} AS scripted FROM g),
found AS (SELECT * FROM said UNION ALL SELECT room_id, sweep_ms, 'COORDINATED_SYNCHRONIZED_JOINS', CASE WHEN scripted THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN scripted THEN 0.8 ELSE 0.55 END, users FROM s)"""
SQL["coordination_members"] = f"WITH {_MEMBERS} SELECT room_id, sweep_ms, code, severity, confidence, unnest(users) AS user_id FROM found"
SQL["coordination_sweep"] = f"""WITH {_MEMBERS}, people AS (SELECT sweep_ms, count(DISTINCT user_id) AS accounts FROM (SELECT sweep_ms, unnest(users) AS user_id FROM found) GROUP BY ALL)
SELECT sweep_ms, count(DISTINCT room_id) AS rooms, count(*) AS findings, any_value(accounts) AS accounts FROM found JOIN people USING (sweep_ms) GROUP BY sweep_ms"""
_w = _c.indicator_weights
SQL["client_risk"] = f"""WITH {T}, c AS (
  SELECT event_id, 'CLIENT_UNKNOWN_VERSION' AS code, {_w['CLIENT_UNKNOWN_VERSION']} * 0.55::DOUBLE AS part FROM ({SQL["client_unknown_version"]})
  UNION ALL SELECT event_id, 'CLIENT_VERSION_FLAPPING', {_w['CLIENT_VERSION_FLAPPING']} * confidence FROM ({SQL["client_version_flapping"]})
  UNION ALL SELECT event_id, 'CLIENT_PLATFORM_MISMATCH', {_w['CLIENT_PLATFORM_MISMATCH']} * 0.65::DOUBLE FROM ({SQL["client_platform_mismatch"]})
  UNION ALL SELECT event_id, 'CLIENT_IMPOSSIBLE_SEQUENCE', {_w['CLIENT_IMPOSSIBLE_SEQUENCE']} * 0.85::DOUBLE FROM ({SQL["client_impossible_sequence"]})),
r AS (SELECT event_id, sum(part) AS raw, array_to_string(list_sort(list(code)), ',') AS indicators FROM c GROUP BY event_id),
g AS (SELECT *, {trailing("1", _s.horizon_ms, "user_id")} AS n FROM t)
SELECT g.event_id, user_id, floor(least(100, coalesce(raw, 0)) + 0.5)::INTEGER AS client_risk, {rounded(f"0.25 + 0.5 * ({sat('n', 5, 40)})")} AS confidence, coalesce(indicators, '') AS indicators
FROM g LEFT JOIN r USING (event_id) WHERE n >= {_c.min_telemetry_events}"""
SQL["incident_details"] = f"""WITH {INCIDENT}, peak AS (SELECT incident_id, code, max(confidence) AS c FROM sessioned JOIN sig USING (event_id) GROUP BY ALL),
sure AS (SELECT incident_id, least(0.99, {rounded("1 - product(1 - c)")}) AS confidence FROM peak GROUP BY ALL)
SELECT incident_id, risk_level, confidence, array_to_string(behaviors, ',') AS behaviors FROM cases JOIN behaved USING (incident_id) JOIN sure USING (incident_id)"""

SQL["alerts_sent"] = f"""WITH RECURSIVE {RISK},
why AS (SELECT *, CASE WHEN level = 'CRITICAL' THEN 'CRITICAL_RISK' WHEN codes LIKE '%EVASION_%' THEN 'REPEATED_EVASION' WHEN codes LIKE '%IMPOSSIBLE_SEQUENCE%' THEN 'SUSPICIOUS_CLIENT' WHEN codes LIKE '%BOT_SUSTAINED_RATE%' THEN 'MASS_SPAM' END AS top
  FROM scored WHERE level IN ('HIGH', 'CRITICAL')),
fired AS (SELECT user_id || ':' || level || ':' || top AS key, at_ms, seq, event_id FROM why WHERE top IS NOT NULL),
s AS (SELECT key, min(at_ms) AS at_ms FROM fired GROUP BY key UNION ALL SELECT s.key, min(f.at_ms) FROM s JOIN fired f ON f.key = s.key AND f.at_ms >= s.at_ms + {_x.alert_window_ms} GROUP BY s.key)
SELECT key, at_ms, arg_min(event_id, seq) AS event_id FROM s JOIN fired USING (key, at_ms) GROUP BY ALL"""
SQL["risk_history"] = f"""WITH RECURSIVE {RISK},
x AS (SELECT *, codes LIKE '%EVASION_POST%' OR codes LIKE '%EVASION_REJOIN%' AS evading, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, seq) AS rn FROM scored),
h AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::VARCHAR AS event_id, NULL::BIGINT AS at_ms, NULL::BIGINT AS seq, 0 AS score, 'LOW' AS level, 0::DOUBLE AS past, 0::DOUBLE AS bonus, 0 AS violations, 0 AS evasions, 0::DOUBLE AS carried, NULL::BIGINT AS last
  FROM (SELECT DISTINCT user_id FROM x)
  UNION ALL
  SELECT user_id, rn, event_id, at_ms, seq, score, level, past, bonus, v + CASE WHEN score >= {_r.thresholds['HIGH']} THEN 1 ELSE 0 END, e + CASE WHEN evading THEN 1 ELSE 0 END,
    floor(score * {_r.carry}::DOUBLE * 100 + 0.5) / 100, CASE WHEN score >= {_r.thresholds['HIGH']} THEN at_ms ELSE last END
  FROM (SELECT *, {_LEVEL} AS level FROM (SELECT *, floor(least(100, total + bonus + past) + 0.5)::INTEGER AS score FROM (
    SELECT x.user_id, x.rn, x.event_id, x.at_ms, x.seq, x.total, x.evading, h.violations AS v, h.evasions AS e, h.last,
      CASE WHEN h.violations + h.evasions > 0 THEN least((h.violations + h.evasions) * {_r.repeat_violation_weight}, {_r.max_repeat_bonus})::DOUBLE ELSE 0::DOUBLE END AS bonus,
      CASE WHEN h.carried > 0 THEN least(CASE WHEN x.at_ms > h.last THEN h.carried * pow(0.5::DOUBLE, (x.at_ms - h.last) / {float(_r.history_half_life_ms)}::DOUBLE) ELSE h.carried END, {_r.max_history}) ELSE 0 END::DOUBLE AS past
    FROM h JOIN x ON x.user_id = h.user_id AND x.rn = h.rn + 1))))
SELECT user_id, event_id, at_ms, seq, score, level, floor(past * 100 + 0.5) / 100 AS history, bonus AS repeat_bonus, violations, evasions FROM h WHERE rn > 0"""
