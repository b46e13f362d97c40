"""Registered queries over the given tables, each with its SQL counterpart where one exists."""
from .registry import ORACLES, QUERIES
from . import (q_scoring, q_functions, q_reshape, q_validation, q_catalog, q_benchmark, q_windows,  # noqa: F401
               q_diagnose, q_consensus, q_layout, q_sources, q_incremental)

__all__ = ["ORACLES", "QUERIES"]
