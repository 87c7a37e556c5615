"""Every query over the driver's tables, with its SQL."""

from . import aggregation, audits, diagnoses, evaluators, joining, ordering, packets, parsing, protocols, routing, runtimes, samples, scalars, states, temporal, verdicts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
