"""Importing this module registers every query."""

from labelscope.plans import costing, exchanging, fitting, resampling, retrieving, scoring, splitting  # noqa: F401
from labelscope.plans.registry import ORACLE, QUERIES  # noqa: F401
