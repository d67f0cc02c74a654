"""Imports every query module so that the registry is complete."""

from . import q_changes, q_diffs, q_history, q_messages, q_metrics, q_jobs, q_scores, q_sources  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
