"""Cross-sectional factor analytics as Spark DataFrame operators."""
