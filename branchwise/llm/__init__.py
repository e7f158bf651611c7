"""Operators of a training-data pipeline; nothing outside this folder imports it except the entry module's guard."""
