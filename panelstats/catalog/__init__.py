"""Registered queries over the given tables, with their SQL twins."""

from .base import ORACLES, QUERIES
from . import columns, joining, tables, series, design_based, spatial, modelling, studies, scores  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
