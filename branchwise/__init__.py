"""Counterfactual outcome analytics as PySpark DataFrame jobs."""
