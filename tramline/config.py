"""Every fixed figure of the transit operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    watermark: str = "2 minutes"
    window: str = "60 seconds"
    slide: str = "30 seconds"
    trigger: str = "30 seconds"
    max_offsets: int = 20_000
    max_cross_track_m: float = 150.0
    zone: str = "America/New_York"
    stationary_m: float = 25.0
    terminal_m: float = 250.0
    schedule_half_window_s: int = 2_700
    severe_bunching: float = 0.25
    bunching: float = 0.50
    gapping: float = 1.50
    severe_gapping: float = 2.50
    earth_m: float = 6_371_008.8
    metres_per_degree: float = 111_195.08
    ping_max_age: str = "10 minutes"
    clock_skew: str = "2 minutes"
    route_ttl: str = "10 minutes"
    vehicle_ttl: str = "5 minutes"
    alert_linger: str = "3 minutes"
    history: int = 200
    history_default: int = 50
    history_most: int = 500
    hint_window_m: float = 3_000.0
    vertex_stride: int = 40
    ambiguous_m: float = 50.0
    vertex_hint_m: float = 400.0


CONFIG = Config()
