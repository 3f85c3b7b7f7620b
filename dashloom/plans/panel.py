"""A panel chosen at run time: a description that becomes one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grain import truncate
from ..operators.aggregates import breakdown
from ..operators.filters import Filter, apply_filters, derive
from ..operators.joins import star
from ..operators.ranking import top_n_other
from ..sources.rollups import read_rollup
from ..sources.tables import table


@dataclass(frozen=True)
class Join:
    """A dimension table and the columns that join it."""

    table: str
    left: str
    right: str


@dataclass(frozen=True)
class Panel:
    """What to show.

    `order` names result columns, "-" in front for descending; it should end in a
    column that makes the order complete where there is a limit. `top` (measure, n)
    keeps the n largest values of the one dimension and adds up all others, so it
    needs measures that can be added. `rollup` is the path of a rollup table that is
    read in place of the source; its measures then add up stored columns.
    """

    source: str
    measures: Mapping[str, Column]
    joins: tuple[Join, ...] = ()
    filters: tuple[Filter, ...] = ()
    derived: Mapping[str, Column] = field(default_factory=dict)
    dims: tuple[str, ...] = ()
    grain: tuple[str, str] | None = None  # time column, grain
    order: tuple[str, ...] = ()
    limit: int | None = None
    top: tuple[str, int] | None = None
    rollup: str | None = None


def run_panel(spark: SparkSession, sf_dir: str, panel: Panel) -> DataFrame:
    """The panel's rows; one scan of the source."""
    if panel.top and (panel.grain or len(panel.dims) != 1):
        raise ValueError("top needs exactly one dimension and no grain")
    df = read_rollup(spark, panel.rollup) if panel.rollup else table(spark, sf_dir, panel.source)
    df = star(df, *[(table(spark, sf_dir, j.table), (j.left, j.right)) for j in panel.joins])
    # Filters on columns that are there come first, so that they reach the scan.
    there = [f for f in panel.filters if f.column not in panel.derived]
    df = derive(apply_filters(df, there), **panel.derived)
    df = apply_filters(df, [f for f in panel.filters if f.column in panel.derived])
    if panel.top:
        df = top_n_other(df, panel.dims[0], panel.measures, *panel.top)
    else:
        groups = [truncate(*panel.grain).alias("t")] if panel.grain else []
        df = breakdown(df, [*groups, *panel.dims], panel.measures)
    if panel.order:
        df = df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c.startswith("-")
                          else F.col(c).asc_nulls_last() for c in panel.order])
    return df if panel.limit is None else df.limit(panel.limit)
