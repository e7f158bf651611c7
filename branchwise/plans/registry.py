"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["value_queries", "text_queries", "source_queries", "model_queries", "policy_queries", "learner_queries"]


def collect(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"branchwise.plans.{m}"), kind)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out |= part
    return out
