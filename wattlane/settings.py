"""Tunable values of the pipeline with their defaults."""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Defaults that decide results.
    processing_mode: str = "proposed"  # or "baseline"
    storage_policy: str = "raw"  # raw | hybrid | event_only | aggregate_only
    store_raw_readings: bool = True
    supported_versions: tuple[str, ...] = ("1.0",)
    voltage_range: tuple[float, float] = (0.0, 300.0)
    current_range: tuple[float, float] = (0.0, 100.0)
    power_range: tuple[float, float] = (0.0, 20000.0)
    temperature_range: tuple[float, float] = (-20.0, 100.0)
    max_future_skew_seconds: int = 60
    max_past_skew_seconds: int = 86400
    alerts_enabled: bool = True
    alert_critical_only: bool = True
    alert_cooldown_seconds: int = 300
    alert_channels: tuple[str, ...] = ("console",)
    outbox_batch_size: int = 50
    outbox_max_attempts: int = 5
    retry_delays_seconds: tuple[int, ...] = (30, 120, 600, 1800)
    outbox_lease_seconds: int = 120
    heartbeat_timeout_seconds: int = 30
    heartbeat_cooldown_seconds: int = 300
    liveness: str = "status"  # or "any": readings, too, show that a device is alive
    metrics_latency_samples: int = 10_000
    model_version: str = "iforest_v1"
    detection_mode: str = "hybrid"  # rules | ml | hybrid: which hits become events
    ml_inline: bool = False  # model hits count for the storage decision
    escalation_mode: str = "off"  # off | all | gated
    escalation_threshold: float | None = None
    model_event_type: str = "ML_ANOMALY"
    model_event_severity: str = "WARNING"
    scoring_batch: tuple[int, int] = (128, 50)  # rows, milliseconds
    forward_batch: tuple[int, int] = (64, 1000)
    nominal_voltage: float = 220.0
    verifier_window: int = 8
    recent_limit: int = 500
    retention_days: dict[str, int] = field(
        default_factory=lambda: {
            "energy_readings": 30,
            "data_quality_logs": 14,
            "system_metrics": 30,
            "device_status_history": 30,
            "alert_deliveries": 30,
            "alert_outbox": 30,
        }
    )

    def __post_init__(self) -> None:
        if self.processing_mode not in ("baseline", "proposed"):
            raise ValueError(f"unknown processing mode {self.processing_mode!r}")
        if self.storage_policy not in ("raw", "hybrid", "event_only", "aggregate_only"):
            raise ValueError(f"unknown storage policy {self.storage_policy!r}")
        if self.detection_mode not in ("rules", "ml", "hybrid"):
            raise ValueError(f"unknown detection mode {self.detection_mode!r}")
        if self.liveness not in ("status", "any"):
            raise ValueError(f"unknown liveness {self.liveness!r}")

    @property
    def stores_every_reading(self) -> bool:
        policy = self.storage_policy
        return self.processing_mode == "baseline" or policy == "raw" or (policy == "hybrid" and self.store_raw_readings)
