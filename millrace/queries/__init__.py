"""One query per operator over the driver's tables, with equivalent SQL where SQL can say it."""

from .base import ORACLES, QUERIES
from . import columns, files, filters, functions, grouping, joins, others, windows  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
