"""Settings of a processing run, checked against each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import InvalidInput
from .operators.labels import CUT_POINTS


@dataclass
class Config:
    epoch_period: int = 30  # seconds
    sample_rate: int = 100
    low_pass: float | None = 20.0  # Hz
    sensor_range: float = 8.0  # g
    stationary_std: float = 0.013  # g
    calibrate: bool = True
    coefficients: dict[str, float] | None = None  # given ones leave calibration out
    features: bool = True
    resample: str = "linear"
    nonwear_std: float = 0.013  # g
    nonwear_minutes: float = 60
    zone: str = "UTC"  # of the recordings' local times
    arrival: str | None = None  # the column that samples came in order of: late ones are left out and counted
    start: str | None = None
    end: str | None = None
    cuts: dict[str, float] = field(default_factory=lambda: dict(CUT_POINTS))
    sleep_tolerance_minutes: float = 60
    min_wear_hours: float | None = None
    circadian: bool = False  # power at one cycle a day, dominant frequency, M10 and L5
    circadian_of_acc: bool = False  # of acceleration, also where there are labels
    ecdf: bool = False
    legacy_ecdf: bool = False

    def __post_init__(self) -> None:
        if self.sample_rate < 25:
            raise InvalidInput("features need a sample rate of 25 Hz at least")
        if self.sample_rate <= 40:
            self.low_pass = None  # there is nothing above 20 Hz
        if self.coefficients is not None:
            self.calibrate = False
        if self.start and self.end and self.start > self.end:
            raise InvalidInput(f"start {self.start} is after end {self.end}")
        if self.resample not in ("linear", "nearest"):
            raise InvalidInput(f"no resampling method {self.resample}")
