"""A PySpark-native analytics engine for network-flow telemetry."""
