"""Sensor-stream analytics on Spark: tumbling metrics, detectors, read queries."""

from gaugeflow.settings import DetectorSettings

__all__ = ["DetectorSettings"]
