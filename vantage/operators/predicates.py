"""Text filters (P1-P11) and filter sets.

Every comparison is on text, as in the viewer: the column is cast to string and
trimmed (spaces), the value is stripped. Case-sensitive.

Catalyst cannot push ``trim(cast(c))`` into a scan, so each filter also emits a
*necessary* bare-column conjunct that Parquet (and JDBC) can evaluate:
``contains(v)`` for a string column, ``c = v`` for an integral/double/decimal
column, a half-open range for a date or timestamp prefix. The exact text test
stays in the plan, so results are unchanged; the scan just reads less.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operator names a filter record carries (fixed values of the viewer's filter form).
OPS = ("equal", "not equal", "contains", "not contains", "starts with", "ends with",
       "null", "not null")

NULL_TOKEN = "Null"


class UnknownFilterOp(ValueError):
    pass


@dataclass(frozen=True)
class FilterSpec:
    """One filter record.

    mode  ``literal`` (default): ``%``/``_``/``\\`` in the value are plain text;
          ``like``: the value is pasted into a LIKE pattern as the viewer did;
          ``exact``: as ``literal``, but neither the cell nor the value is trimmed.
    nulls ``true`` (default): null cells are SQL nulls; ``null``/``not null`` test
          ``IS NULL``; other comparisons drop null rows.
          ``token``: string nulls read as the text ``Null`` (the viewer's fill);
          non-string nulls stay null and drop out of every comparison.
    """

    op: str
    column: str
    value: object = None
    id: str | None = None
    mode: str = "literal"
    nulls: str = "true"

    def __post_init__(self):
        if self.op not in OPS:
            raise UnknownFilterOp(f"unknown filter op {self.op!r}; expected one of {OPS}")
        if self.mode not in ("literal", "like", "exact"):
            raise ValueError(f"mode must be 'literal', 'like' or 'exact', not {self.mode!r}")
        if self.nulls not in ("true", "token"):
            raise ValueError(f"nulls must be 'true' or 'token', not {self.nulls!r}")


def _field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise KeyError(f"no column {name!r}; columns are {df.columns}")


def _ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _text(df: DataFrame, spec: FilterSpec) -> Column:
    f = _field(df, spec.column)
    c = _ref(spec.column)
    if not isinstance(f.dataType, T.StringType):
        c = c.cast("string")
    elif spec.nulls == "token":
        c = F.coalesce(c, F.lit(NULL_TOKEN))
    return c if spec.mode == "exact" else F.trim(c)


def _value(spec: FilterSpec) -> str:
    v = "" if spec.value is None else str(spec.value)
    return v if spec.mode == "exact" else v.strip()


def predicate(df: DataFrame, spec: FilterSpec) -> Column:
    """The exact filter condition of one spec (a Column)."""
    text = _text(df, spec)
    v = _value(spec)
    op = spec.op
    if op == "null":
        if spec.nulls == "token":
            return text == NULL_TOKEN
        return _ref(spec.column).isNull()
    if op == "not null":
        if spec.nulls == "token":
            return text != NULL_TOKEN
        return _ref(spec.column).isNotNull()
    if op == "equal":
        return text == v
    if op == "not equal":
        return text != v
    if spec.mode == "like":
        pattern = {"contains": f"%{v}%", "not contains": f"%{v}%",
                   "starts with": f"{v}%", "ends with": f"%{v}"}[op]
        cond = text.like(pattern)
    else:
        cond = {"contains": lambda: text.contains(v),
                "not contains": lambda: text.contains(v),
                "starts with": lambda: text.startswith(v),
                "ends with": lambda: text.endswith(v)}[op]()
    return ~cond if op == "not contains" else cond


_DATE_PREFIX = re.compile(r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$")
_TS_TEXT = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?")
_INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_INT_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _prefix_range(v: str):
    m = _DATE_PREFIX.match(v)
    if not m:
        return None
    y, mo, d = int(m.group(1)), m.group(2), m.group(3)
    try:
        if d is not None:
            lo = date(y, int(mo), int(d))
            hi = date.fromordinal(lo.toordinal() + 1)
        elif mo is not None:
            lo = date(y, int(mo), 1)
            hi = date(y + (lo.month == 12), lo.month % 12 + 1, 1)
        else:
            lo, hi = date(y, 1, 1), date(y + 1, 1, 1)
    except ValueError:
        return None
    return lo, hi


def pushable_hint(df: DataFrame, spec: FilterSpec) -> Column | None:
    """A bare-column condition implied by ``predicate(df, spec)``, or None.

    Positive ops (equal, contains, starts/ends with) in literal mode, where
    "text matches" implies a simple condition on the stored value; negative ops
    (not equal, not contains) imply only that the cell is not null, unless a
    null string reads as the token.
    """
    if spec.op in ("not equal", "not contains"):
        dt = _field(df, spec.column).dataType
        if spec.nulls == "token" and isinstance(dt, T.StringType):
            return None
        return _ref(spec.column).isNotNull()
    if spec.mode == "like" or spec.op not in ("equal", "contains", "starts with", "ends with"):
        return None
    v = _value(spec)
    if not v:
        return None
    f = _field(df, spec.column)
    c, dt = _ref(spec.column), f.dataType
    if isinstance(dt, T.StringType):
        if spec.nulls == "token" and NULL_TOKEN.find(v) >= 0:
            return None  # a null cell may match through the token
        if spec.mode == "exact":
            return None  # the test itself is on the bare column
        # trim() strips spaces only: a cell whose trimmed text begins with the value
        # begins with it or with a space (prefixes that row group statistics can use)
        if spec.op == "equal":
            return (c == v) | c.startswith(" ") | c.startswith(v + " ")
        if spec.op == "starts with":
            return c.startswith(v) | c.startswith(" ")
        return c.contains(v)
    if spec.op == "equal":
        if isinstance(dt, _INT_TYPES) and re.fullmatch(r"-?\d+", v):
            bits = _INT_BITS[type(dt)]
            x = int(v)
            if -(2 ** (bits - 1)) <= x < 2 ** (bits - 1):
                return c == F.lit(x).cast(dt)
            return None
        if isinstance(dt, T.DoubleType):
            try:
                x = float(v)
            except ValueError:
                return None
            return (c == F.lit(x)) if x == x and abs(x) != float("inf") else None
        if isinstance(dt, T.DecimalType):
            try:
                x = Decimal(v)
            except InvalidOperation:
                return None
            if not x.is_finite() or len(x.as_tuple().digits) > 38 or abs(x.as_tuple().exponent) > 38:
                return None  # no cell has that text; the exact test finds none
            return c == F.lit(x)
        if isinstance(dt, T.DateType) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
            try:
                return c == F.lit(date.fromisoformat(v))
            except ValueError:
                return None
    if spec.op in ("starts with", "equal") and isinstance(
            dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        rng = _prefix_range(v)
        if rng is None:
            if spec.op == "equal" and isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
                if not _TS_TEXT.fullmatch(v):
                    return None
                try:
                    datetime.fromisoformat(v)
                except ValueError:
                    return None
                return c == F.lit(v).cast(dt)
            return None
        if spec.op == "equal" and not isinstance(dt, T.DateType):
            return None  # a timestamp's text always has a time part
        lo, hi = rng
        return (c >= F.lit(lo.isoformat()).cast(dt)) & (c < F.lit(hi.isoformat()).cast(dt))
    return None


def condition(df: DataFrame, specs: Sequence[FilterSpec]) -> Column | None:
    """AND of all specs (insertion order), with pushable hints first."""
    parts: list[Column] = []
    for s in specs:
        hint = pushable_hint(df, s)
        if hint is not None:
            parts.append(hint)
        parts.append(predicate(df, s))
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filters(df: DataFrame, specs: Iterable[FilterSpec]) -> DataFrame:
    """One Filter node; specs with the same id replace earlier ones."""
    specs = _dedupe(list(specs))
    cond = condition(df, specs)
    return df if cond is None else df.filter(cond)


def remove_filter(specs: Sequence[FilterSpec], filter_id: str) -> list[FilterSpec]:
    """P10: the filter list without ``filter_id``; re-apply with ``apply_filters``."""
    return [s for s in specs if s.id != filter_id]


def upsert_filter(specs: Sequence[FilterSpec], spec: FilterSpec) -> list[FilterSpec]:
    """Add a filter; one with the same id is replaced in place."""
    out = list(specs)
    for i, s in enumerate(out):
        if spec.id is not None and s.id == spec.id:
            out[i] = spec
            return out
    return out + [spec]


def _dedupe(specs: list[FilterSpec]) -> list[FilterSpec]:
    out: list[FilterSpec] = []
    for s in specs:
        out = upsert_filter(out, s)
    return out


def from_records(records, **defaults) -> list[FilterSpec]:
    """Filter records ``{id: {logic1_op, logic1_val, column_name, ...}}`` -> specs."""
    items = records.items() if hasattr(records, "items") else enumerate(records)
    return [FilterSpec(op=r["logic1_op"], column=r["column_name"], value=r.get("logic1_val"),
                       id=str(k), **defaults) for k, r in items]
