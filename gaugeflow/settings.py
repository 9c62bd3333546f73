"""Tunable parameters with their default values."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorSettings:
    """Thresholds of the two detectors.

    ``z_threshold``    a reading fires the z-score detector at or above it
    ``alpha``          weight of the newest reading in the moving baseline
    ``ewma_threshold`` a reading fires the EWMA detector strictly above it
    """

    # Defaults and warm-up lengths.
    z_threshold: float = 2.0
    alpha: float = 0.1
    ewma_threshold: float = 3.0
    z_warmup: int = 10
    ewma_warmup: int = 20

    def __post_init__(self) -> None:
        if not 0.0 < self.alpha < 1.0:
            raise ValueError(f"alpha must lie strictly between 0 and 1, got {self.alpha}")
        for name in ("z_threshold", "ewma_threshold"):
            if math.isnan(getattr(self, name)):
                raise ValueError(f"{name} must be a number")


@dataclass(frozen=True)
class SkewSettings:
    """When a key counts as heavy and how finely its rows are sliced.

    A sensor is heavy when it holds more than ``heavy_rows`` rows and more than
    1/``max_heavy`` of all rows, so there are fewer than ``max_heavy`` of them
    whatever the data looks like. ``slice_rows`` is the target size of one slice of
    heavy rows; there are at most ``max_slices`` slices, the slices grow beyond that.
    The results do not depend on any of these.
    """

    heavy_rows: int = 5_000_000
    slice_rows: int = 2_000_000
    max_heavy: int = 10_000
    max_slices: int = 20_000

    def sensor_limit(self, total: int) -> int:
        return max(self.heavy_rows, total // self.max_heavy)

    def slice_count(self, rows: int) -> int:
        return max(2, min(self.max_slices, -(-rows // self.slice_rows)))
