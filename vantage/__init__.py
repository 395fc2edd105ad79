"""vantage: view, shape and query tables from many connections on Spark.

Everything returns a lazy ``DataFrame``; nothing is collected except an
explicit ``preview`` asked for by the caller.
"""

from vantage.catalog import Catalog, Connection
from vantage.functions.json_paths import json_keypaths
from vantage.operators.predicates import FilterSpec, apply_filters, remove_filter
from vantage.operators.view import View
from vantage.plans.worksheet import Worksheet, check_read_only

__all__ = [
    "Catalog",
    "Connection",
    "FilterSpec",
    "apply_filters",
    "remove_filter",
    "Worksheet",
    "check_read_only",
    "View",
    "json_keypaths",
]
