"""Registered queries: operators bound to tables."""

from . import q_eval, q_evidence, q_flow, q_labels, q_scalar  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
