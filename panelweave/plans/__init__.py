"""Registered queries of the library."""

import importlib

MODULES = ["cleaning_queries", "panel_queries", "model_queries", "panel_model_queries", "engine_queries", "inference_queries", "regime_queries", "mixture_queries", "structural_queries", "completing_queries"]


def QUERIES_OF():
    """(queries, oracles) of all query modules."""
    for m in MODULES:
        importlib.import_module(f"panelweave.plans.{m}")
    from panelweave.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
