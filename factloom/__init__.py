"""factloom: a Spark-native engine for open information extraction and fact graphs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
