"""basalt: a Spark-native analytics engine for industrial telemetry."""
