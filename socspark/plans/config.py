"""Thresholds and weights of the jobs (EXT-3)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CorrelationConfig:
    """Pair scoring. The same weights must give the same scores."""

    window_seconds: int = 1800
    min_score: float = 0.70
    min_chain_events: int = 2
    same_user: float = 0.35
    same_host: float = 0.25
    host_pivot: float = 0.40
    shared_ip: float = 0.20
    process_host: float = 0.15
    domain_overlap: float = 0.15
    suspicious_coincidence: float = 0.25
    time_proximity: float = 0.25
    neighbours_per_key: int = 30
    links_per_event: int = 10


@dataclass(frozen=True)
class LateralConfig:
    window_seconds: int = 600
    min_score: float = 0.70
    actions: tuple[str, ...] = ("RDP_LOGIN", "SMB_AUTH", "NETWORK_LOGON", "PRIVILEGED_LOGIN", "REMOTE_SERVICE_EXEC")


@dataclass(frozen=True)
class DetectionConfig:
    dns_count: int = 5
    dns_span_seconds: int = 600
    failure_count: int = 3
    failure_span_seconds: int = 600
    console_hours: int = 12
    privileged_repeat_seconds: int = 600
    baseline_events: int = 20
    baseline_hours: int = 24
    routine_days: int = 3


@dataclass(frozen=True)
class PredictionConfig:
    """Points of the factors of a next target, and how many targets a chain has."""

    # The weights of the score.
    access: float = 30.0
    privilege: float = 25.0
    connectivity: float = 20.0
    criticality: float = 20.0
    recent: float = 15.0
    proximity: float = 20.0
    ceiling: float = 140.0
    most: int = 4
