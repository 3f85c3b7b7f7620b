"""Many tiles over one filtered fact, from one scan and one aggregate."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Filter, apply_filters, condition, derive
from ..operators.joins import star
from ..sources.tables import table
from .panel import Join


@dataclass(frozen=True)
class Tile:
    """One tile: its dimensions, its own filters, and whether it shows subtotals.

    With `subtotals` every drill-down level is there, told apart by `level` as in `subtotals`:
    a bit for each dimension that is summed over, the first dimension's the highest.
    """

    name: str
    dims: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    subtotals: bool = False


@dataclass(frozen=True)
class Dashboard:
    """Tiles with the same measures over one fact; `facets` are tiles of one column each, named after it."""

    source: str
    measures: Mapping[str, Column]
    tiles: tuple[Tile, ...] = ()
    joins: tuple[Join, ...] = ()
    filters: tuple[Filter, ...] = ()
    derived: Mapping[str, Column] = field(default_factory=dict)
    facets: tuple[str, ...] = ()


def _filtered(df: DataFrame, dashboard: Dashboard) -> DataFrame:
    """The rows that pass the common filters; those on columns that are there come first."""
    late = [f for f in dashboard.filters if f.column in dashboard.derived]
    df = derive(apply_filters(df, [f for f in dashboard.filters if f not in late]), **dashboard.derived)
    return apply_filters(df, late)


def _sets(tiles: tuple[Tile, ...]) -> list[tuple[Tile, int, tuple[str, ...]]]:
    """Each tile's grouping sets: its level and the dimensions that it keeps."""
    out = []
    for tile in tiles:
        n = len(tile.dims)
        out += [(tile, (1 << n - k) - 1, tile.dims[:k]) for k in (range(n, -1, -1) if tile.subtotals else [n])]
    return out


def run_dashboard(spark: SparkSession, sf_dir: str, dashboard: Dashboard) -> DataFrame:
    """The rows of all tiles: tile, level, a column for each dimension (null where the tile lacks it), measures.

    The fact is scanned once. Each row is dealt to the grouping sets of the tiles whose filters it
    passes, and all of them are one aggregate, combined before the shuffle: a task gives out a row
    for each tile's group, however many tiles there are. Rows that pass no tile's filters
    are dropped before that. A tile that no row passes has no rows, also where it has no
    dimension. Tiles' names must differ.
    """
    tiles = (*dashboard.tiles, *(Tile(c, (c,)) for c in dashboard.facets))
    if len({t.name for t in tiles}) < len(tiles):
        raise ValueError("two tiles have the same name")
    df = table(spark, sf_dir, dashboard.source)
    df = star(df, *[(table(spark, sf_dir, j.table), (j.left, j.right)) for j in dashboard.joins])
    df = _filtered(df, dashboard)
    if not tiles:
        raise ValueError("a dashboard needs a tile")
    passes = {t.name: reduce(lambda a, b: a & b, [condition(df, f) for f in t.filters]) if t.filters else None for t in tiles}
    if all(p is not None for p in passes.values()):
        df = df.filter(reduce(lambda a, b: a | b, passes.values()))
    dims = list(dict.fromkeys(d for t in tiles for d in t.dims))
    kinds = {d: df.schema[d].dataType for d in dims}
    targets = []
    for tile, level, kept in _sets(tiles):
        columns = [F.col(d).alias(d) if d in kept else F.lit(None).cast(kinds[d]).alias(d) for d in dims]
        target = F.struct(F.lit(tile.name).alias("tile"), F.lit(level).cast("bigint").alias("level"), *columns)
        targets.append(target if passes[tile.name] is None else F.when(passes[tile.name], target))
    dealt = df.withColumn("_to", F.explode(F.array_compact(F.array(*targets))))
    keys = [F.col(f"_to.{c}").alias(c) for c in ("tile", "level", *dims)]
    return dealt.groupBy(*keys).agg(*[c.alias(n) for n, c in dashboard.measures.items()])


def tile_rows(found: DataFrame, dashboard: Dashboard, name: str) -> DataFrame:
    """One tile of `run_dashboard`'s rows, with its own dimensions and `level` for subtotals only."""
    tile = next(t for t in (*dashboard.tiles, *(Tile(c, (c,)) for c in dashboard.facets)) if t.name == name)
    level = ["level"] if tile.subtotals else []
    return found.filter(F.col("tile") == name).select(*level, *tile.dims, *dashboard.measures)
