"""``View``: the viewer's per-table state (filters, search, chosen columns, sort)
as one immutable value that compiles to a single lazy plan.

Every change returns a new View; ``frame()`` is the DataFrame (filter, search,
projection and sort in that order, so Catalyst pushes the filters and prunes the
scan); ``preview(n)`` is the top-k a screen shows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Sequence

from pyspark.sql import DataFrame

from vantage.operators import shaping
from vantage.operators.predicates import FilterSpec, apply_filters, remove_filter, upsert_filter


@dataclass(frozen=True)
class View:
    base: DataFrame
    filters: tuple[FilterSpec, ...] = ()
    text: str | None = None
    columns: tuple[str, ...] | None = None
    order: tuple = ()
    case_sensitive_search: bool = False

    def filter(self, spec: FilterSpec) -> "View":
        return replace(self, filters=tuple(upsert_filter(self.filters, spec)))

    def unfilter(self, filter_id: str) -> "View":
        return replace(self, filters=tuple(remove_filter(self.filters, filter_id)))

    def search(self, text: str | None, case_sensitive: bool = False) -> "View":
        return replace(self, text=text or None, case_sensitive_search=case_sensitive)

    def select(self, columns: Sequence[str] | None) -> "View":
        return replace(self, columns=None if columns is None else tuple(columns))

    def sort(self, *keys) -> "View":
        return replace(self, order=tuple(keys))

    def frame(self) -> DataFrame:
        df = apply_filters(self.base, self.filters)
        if self.text:
            cols = list(self.columns) if self.columns else None
            df = shaping.search(df, self.text, columns=cols,
                                case_sensitive=self.case_sensitive_search)
        if self.columns:
            df = shaping.project(df, list(self.columns))
        if self.order:
            df = shaping.sort(df, list(self.order))
        return df

    def preview(self, n: int = 100) -> DataFrame:
        return self.frame().limit(n)

    def structure(self, profile: bool = False) -> DataFrame:
        return shaping.structure(self.frame(), profile=profile)

    def export(self, path: str, fmt: str = "csv", **options) -> str:
        """K3: the whole filtered/sorted view written by Spark (one file
        per task); nothing is collected."""
        from vantage.operators.sinks import export
        return export(self.frame(), path, fmt=fmt, **options)
