"""Every registered query of the library, and its SQL where SQL can say it."""

from .plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
