"""Every query of the library by name, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from quarry.plans import repository, rules  # noqa: F401 - its queries join the others
from quarry.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
