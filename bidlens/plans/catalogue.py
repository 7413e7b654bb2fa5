"""All named queries of the library and their SQL twins."""

from bidlens.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
