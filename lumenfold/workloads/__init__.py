"""Named queries over the test tables, each with its SQL oracle where SQL can express it."""

from . import analytic, dialect, relational, scalar, structural
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytic", "dialect", "relational", "scalar", "structural"]
