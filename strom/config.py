"""Analytical parameters shared by the plans. Every plan takes a ``Config`` argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: thresholds and targets that define the results
    corridor_buffer_m: float = 5000.0
    fast_kw: float = 50.0
    ultra_fast_kw: float = 150.0
    normal_below_kw: float = 22.0
    target_max_gap_km: float = 50.0
    target_fast_per_100km: float = 2.0
    traffic_buffer_m: float = 2000.0
    reference_vehicle: str = "compact_ev"
    metric_srid: int = 25832
    lookback_minutes: int = 30
    energy_tolerance_kwh: float = 0.5
    energy_tolerance_percent: float = 5.0
    # physical layout choices, free to change without changing any result
    slice_seconds: int = 86_400
    broadcast_rows: int = 200_000
    salt_buckets: int = 16
    hot_rows: int = 1_000_000


DEFAULT = Config()
