"""Default-risk analytics as Spark DataFrame operators."""
