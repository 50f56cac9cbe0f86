"""Registered queries over the driver tables, each with its SQL where one can be written."""

from . import ask, charts, clean, explore, metrics, models, profile
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "ask", "charts", "clean", "explore", "metrics", "models", "profile"]
