"""Spark ML estimators on the feature frames."""
