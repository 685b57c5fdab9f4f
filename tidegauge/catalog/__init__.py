"""Every core query by name, and its SQL."""

from . import designs, extras, misc, pipeline, trends
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "designs", "extras", "misc", "pipeline", "trends"]
