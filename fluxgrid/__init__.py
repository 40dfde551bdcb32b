"""fluxgrid: a PySpark-native engine for gridded anomalies, event detection and event validation."""

__version__ = "0.1.0"
