"""Named queries over the driver's tables, and reports composed of operators."""

from . import aggregates, inputs, relational, reports, searching, statistics, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
