"""Thresholds, windows and weights. Values become literals of the plan; patches are checked before a job starts."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000

#: Signal code -> (category, risk weight).
SIGNALS: dict[str, tuple[str, float]] = {
    "SPAM_IDENTICAL_REPEAT": ("SPAM", 20),
    "SPAM_NEAR_DUPLICATE": ("SPAM", 14),
    "SPAM_HIGH_FREQUENCY": ("FREQUENCY", 20),
    "SPAM_BURST": ("FREQUENCY", 20),
    "SPAM_MENTION_FLOOD": ("SPAM", 15),
    "SPAM_SUSPICIOUS_CHARACTERS": ("SPAM", 10),
    "SPAM_LINK_FLOOD": ("SPAM", 15),
    "BOT_UNIFORM_TIMING": ("FREQUENCY", 20),
    "BOT_SUSTAINED_RATE": ("FREQUENCY", 20),
    "COORDINATED_IDENTICAL_CONTENT": ("COORDINATION", 25),
    "COORDINATED_SYNCHRONIZED_JOINS": ("COORDINATION", 18),
    "ABUSE_LANGUAGE": ("ABUSE", 15),
    "ABUSE_SEVERE": ("ABUSE", 30),
    "ABUSE_REPEATED": ("ABUSE", 25),
    "ABUSE_TARGETED_HARASSMENT": ("ABUSE", 25),
    "THREAT_LANGUAGE": ("THREAT", 40),
    "CLIENT_UNKNOWN_VERSION": ("CLIENT", 10),
    "CLIENT_VERSION_FLAPPING": ("CLIENT", 15),
    "CLIENT_IMPOSSIBLE_SEQUENCE": ("CLIENT", 20),
    "CLIENT_MALFORMED_REQUESTS": ("CLIENT", 15),
    "CLIENT_ABNORMAL_REQUEST_RATE": ("CLIENT", 20),
    "CLIENT_PLATFORM_MISMATCH": ("CLIENT", 15),
    "CLIENT_ATTESTATION_FAILED": ("CLIENT", 20),
    "EVASION_POST_MODERATION_ACTIVITY": ("EVASION", 25),
    "EVASION_REJOIN_CYCLING": ("EVASION", 20),
    "EVASION_FILTER_OBFUSCATION": ("EVASION", 15),
    "GHOST_HIDDEN_PRESENCE_CORRELATED": ("GHOST", 10),
}
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class SpamConfig:
    window_ms: int = 30 * SECOND
    high_frequency_count: int = 15
    burst_window_ms: int = 5 * SECOND
    burst_count: int = 10
    identical_repeat_count: int = 4
    identical_severe_count: int = 15
    identical_short_length: int = 16
    identical_short_multiplier: int = 3
    coordination_min_length: int = 24
    near_duplicate_similarity: float = 0.78
    near_duplicate_count: int = 5
    near_duplicate_min_length: int = 16
    mentions_per_message: int = 6
    mentions_per_window: int = 15
    links_per_message: int = 6
    timing_min_samples: int = 6
    timing_max_cv: float = 0.18
    timing_max_mean_gap_ms: int = 20 * SECOND
    timing_min_mean_gap_ms: int = 50
    sustained_window_ms: int = 5 * MINUTE
    sustained_count: int = 120
    max_window_events: int = 200
    #: Width over which repeats and near-duplicates are looked for; detectors never see further back.
    horizon_ms: int = 5 * MINUTE


@dataclass(frozen=True)
class AbuseConfig:
    repeat_count: int = 3
    min_confidence: float = 0.5
    disagreement_threshold: float = 0.45
    auto_action_min_confidence: float = 0.7
    excerpt_max_chars: int = 280


@dataclass(frozen=True)
class ClientConfig:
    known_versions: tuple[str, ...] = ()
    version_pattern: str = r"^\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?$"
    version_flap_window_ms: int = 10 * MINUTE
    version_flap_count: int = 3
    abnormal_requests_per_minute: int = 240
    malformed_window_ms: int = 5 * MINUTE
    malformed_count: int = 5
    min_telemetry_events: int = 5
    leave_grace_ms: int = 5 * SECOND
    join_grace_ms: int = 10 * SECOND
    voice_window_ms: int = 30 * SECOND
    #: Weight of each indicator in the client risk; others weigh 10.
    indicator_weights: dict[str, float] = field(
        default_factory=lambda: {
            "CLIENT_UNKNOWN_VERSION": 18,
            "CLIENT_VERSION_FLAPPING": 22,
            "CLIENT_IMPOSSIBLE_SEQUENCE": 28,
            "CLIENT_MALFORMED_REQUESTS": 20,
            "CLIENT_ABNORMAL_REQUEST_RATE": 22,
            "CLIENT_PLATFORM_MISMATCH": 20,
            "CLIENT_ATTESTATION_FAILED": 35,
        }
    )


@dataclass(frozen=True)
class EvasionConfig:
    post_moderation_window_ms: int = 10 * MINUTE
    rejoin_window_ms: int = 5 * MINUTE
    rejoin_count: int = 5
    presence_tolerance_ms: int = 3 * SECOND
    presence_min_events: int = 2


@dataclass(frozen=True)
class CoordinationConfig:
    sweep_ms: int = 5 * MINUTE
    min_accounts: int = 3
    severe_accounts: int = 6
    join_window_ms: int = 10 * SECOND
    join_accounts: int = 4
    scripted_cv: float = 0.25


@dataclass(frozen=True)
class RiskConfig:
    weights: dict[str, float] = field(default_factory=lambda: {c: w for c, (_, w) in SIGNALS.items()})
    thresholds: dict[str, int] = field(default_factory=lambda: {"LOW": 0, "MEDIUM": 25, "HIGH": 50, "CRITICAL": 75})
    repeat_violation_weight: float = 25
    max_repeat_bonus: float = 25
    history_half_life_ms: int = 24 * HOUR
    max_history: float = 20
    confidence_floor: float = 0.5
    max_single: float = 40
    critical_min_confidence: float = 0.8
    carry: float = 0.4


@dataclass(frozen=True)
class CaseConfig:
    incident_gap_ms: int = 30 * MINUTE
    max_evidence: int = 10
    alert_min_level: str = "HIGH"
    alert_window_ms: int = 5 * MINUTE
    evidence_days: int = 365
    incident_days: int = 365
    event_days: int = 30
    signal_days: int = 90
    audit_days: int = 730
    mute_ms: int = 10 * MINUTE
    offence_window_ms: int = 60 * SECOND
    max_offences: int = 40
    mute_after_offences: int = 2
    min_mute_confidence: float = 0.6


@dataclass(frozen=True)
class Config:
    spam: SpamConfig = SpamConfig()
    abuse: AbuseConfig = AbuseConfig()
    client: ClientConfig = field(default_factory=ClientConfig)
    evasion: EvasionConfig = EvasionConfig()
    coordination: CoordinationConfig = CoordinationConfig()
    risk: RiskConfig = field(default_factory=RiskConfig)
    case: CaseConfig = CaseConfig()
    version: str = "1.0.0"


def resolve(patch: dict[str, Any], base: Config | None = None) -> Config:
    """A config with a patch laid over it: mappings merge, lists and values replace, unknown keys are an error."""
    base = base or Config()
    groups = {}
    for name, own in patch.items():
        old = getattr(base, name)
        if not dataclasses.is_dataclass(old):
            groups[name] = own
            continue
        known = {f.name for f in dataclasses.fields(old)}
        if not own.keys() <= known:
            raise ValueError(f"unknown settings in {name}: {sorted(own.keys() - known)}")
        fixed = {k: {**getattr(old, k), **v} if isinstance(getattr(old, k), dict) else tuple(v) if isinstance(v, list) else v for k, v in own.items()}
        groups[name] = dataclasses.replace(old, **fixed)
    out = dataclasses.replace(base, **groups)
    if problems := validate(out):
        raise ValueError("; ".join(problems))
    return out


def validate(c: Config) -> list[str]:
    """What is wrong with a config; empty if nothing is."""
    out = [f"weight of {k} outside 0..100" for k, w in c.risk.weights.items() if not 0 <= w <= 100]
    t = [c.risk.thresholds.get(level) for level in LEVELS]
    if None in t or t[0] != 0 or any(b <= a for a, b in zip(t, t[1:])):
        out.append("thresholds must rise from LOW = 0")
    out += [f"spam.{f.name} must be positive" for f in dataclasses.fields(c.spam) if getattr(c.spam, f.name) <= 0]
    if not 0.5 <= c.abuse.auto_action_min_confidence <= 1:
        out.append("abuse.auto_action_min_confidence outside 0.5..1")
    out += [f"case.{k} outside 1..3650" for k in ("evidence_days", "incident_days", "event_days", "signal_days", "audit_days") if not 1 <= getattr(c.case, k) <= 3650]
    return out


#: For sparse telemetry, where a user's events lie hours apart: the same operators, wider.
WIDE = Config(
    spam=SpamConfig(
        burst_window_ms=DAY, burst_count=4, window_ms=3 * DAY, high_frequency_count=6, identical_repeat_count=5, identical_severe_count=8, sustained_window_ms=10 * DAY, sustained_count=14,
        timing_max_cv=0.5, timing_max_mean_gap_ms=10 * DAY, mentions_per_message=1, mentions_per_window=2, links_per_message=1, horizon_ms=14 * DAY, near_duplicate_count=3,
    ),
    client=ClientConfig(known_versions=("4.2.0", "4.2.1", "4.2.2"), version_flap_window_ms=3 * DAY, voice_window_ms=3 * DAY, leave_grace_ms=5 * SECOND, join_grace_ms=10 * SECOND, malformed_window_ms=14 * DAY, malformed_count=2),
    evasion=EvasionConfig(post_moderation_window_ms=2 * DAY, rejoin_window_ms=7 * DAY, rejoin_count=4, presence_tolerance_ms=3 * HOUR),
    coordination=CoordinationConfig(sweep_ms=5 * DAY, join_window_ms=12 * HOUR),
    risk=RiskConfig(history_half_life_ms=3 * DAY),
    case=CaseConfig(incident_gap_ms=2 * DAY, alert_window_ms=DAY, mute_ms=2 * DAY, offence_window_ms=7 * DAY, evidence_days=10, incident_days=10),
)
