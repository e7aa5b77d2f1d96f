"""All queries of the engine by name, with their DuckDB counterparts."""

from provscan.plans.oracles import ORACLES
from provscan.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
