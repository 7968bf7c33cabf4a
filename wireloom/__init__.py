"""Network telemetry analytics as Spark DataFrame operators."""
