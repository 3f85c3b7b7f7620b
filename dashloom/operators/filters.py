"""Filter bar, derived columns, JSON dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Filter:
    """One entry of the filter bar.

    op is one of: eq, in, between (from included, to excluded, either may be
    None), prefix, null, not_null. Values stay literals and never become SQL text.
    """

    column: str
    op: str
    value: Any = None


def _literal(value: Any, kind: T.DataType) -> Column:
    """The value in the column's own type, so the comparison reaches the scan."""
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, (date, datetime)):
        return F.lit(value.isoformat()).cast(kind)
    return F.lit(value).cast(kind)


def condition(df: DataFrame, f: Filter) -> Column:
    c, kind = F.col(f.column), df.schema[f.column].dataType
    if f.op == "eq":
        return c == _literal(f.value, kind)
    if f.op == "in":
        return c.isin([_literal(v, kind) for v in f.value])
    if f.op == "between":
        lo, hi = f.value
        bounds = []
        if lo is not None:
            bounds.append(c >= _literal(lo, kind))
        if hi is not None:
            bounds.append(c < _literal(hi, kind))
        return reduce(lambda a, b: a & b, bounds, F.lit(True))
    if f.op == "prefix":
        return c.startswith(F.lit(f.value))
    if f.op == "null":
        return c.isNull()
    if f.op == "not_null":
        return c.isNotNull()
    raise ValueError(f"unknown filter {f.op!r}")


def apply_filters(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    """Rows that pass every filter."""
    return reduce(lambda d, f: d.filter(condition(df, f)), filters, df)


def derive(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add named derived columns."""
    return df.withColumns(exprs) if exprs else df


def json_dims(df: DataFrame, col: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Several properties of a JSON column as dimensions: `name: (path, kind)`.

    Each row's text is parsed once, to a variant that all paths read. Null where a property is
    missing or of another kind, or where the text is no JSON.
    """
    parsed = df.withColumn("_variant", F.try_parse_json(col))
    found = {name: F.try_variant_get("_variant", path, kind) for name, (path, kind) in paths.items()}
    return parsed.withColumns(found).drop("_variant")


def json_dim(df: DataFrame, col: str, path: str, kind: str = "string",
             name: str | None = None) -> DataFrame:
    """A property of a JSON column as a dimension; null where it is missing or of another kind."""
    name = name or path.rsplit(".", 1)[-1]
    return df.withColumn(name, F.get_json_object(col, path).try_cast(kind))
