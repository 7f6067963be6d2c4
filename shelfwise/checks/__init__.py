"""Every operator as a query over the provided tables, with the SQL that must agree with it."""

from shelfwise.checks import pipelines, recommending, relational, scalar  # noqa: F401
from shelfwise.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
