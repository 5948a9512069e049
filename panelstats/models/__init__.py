"""Estimators whose sums are aggregated by Spark and solved as small systems."""
