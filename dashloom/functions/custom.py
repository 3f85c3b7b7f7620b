"""User-defined dimensions and measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def register_dimension(spark: SparkSession, name: str, fn: Callable[..., pd.Series],
                       kind: str) -> Callable[..., Column]:
    """A pandas function from columns to a column, for DataFrames and SQL."""
    udf = F.pandas_udf(fn, kind)
    spark.udf.register(name, udf)
    return udf


def register_measure(spark: SparkSession, name: str, fn: Callable[..., pd.Series],
                     kind: str) -> Callable[..., Column]:
    """A measure computed from built-in aggregates, for DataFrames and SQL.

    `fn` gets the aggregates of many groups as series:
    `weighted_mean(sum(price * qty), sum(qty))`. The rows are aggregated by Spark,
    so Python sees one row per group and never the rows of a group.
    """
    return register_dimension(spark, name, fn, kind)


def custom_measure(
    df: DataFrame,
    dims: Sequence[str],
    inputs: Sequence[str],
    partial: Callable[[pd.DataFrame], dict[str, object]],
    state: Mapping[str, tuple[str, Callable[[Column], Column]]],
    finish: Callable[..., pd.Series],
    kind: str,
    name: str,
) -> DataFrame:
    """A measure whose per-row work needs Python.

    `partial` turns the rows of one group in one Arrow batch into state values,
    `state` gives each value's type and the aggregate that merges it (such as
    `F.sum`), `finish` computes the result from the merged state. Python never holds
    more than a batch, however large a group is.
    """
    kinds = {f.name: f.dataType for f in df.select(*dims).schema}
    # As text, since pandas turns whole numbers with nulls into floats.
    texts = [F.col(d).cast("string").alias(d) for d in dims]
    schema = ", ".join([f"`{d}` string" for d in dims]
                       + [f"`{s}` {t}" for s, (t, _) in state.items()])
    dims, names = list(dims), [*dims, *state]

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(dims, dropna=False) if dims else [((), batch)]
            found = []
            for key, group in groups:
                values = partial(group)
                key = [k if isinstance(k, str) else None for k in key]
                found.append((*key, *[values[s] for s in state]))
            yield pd.DataFrame(found, columns=names)

    parts = df.select(*texts, *inputs).mapInPandas(per_batch, schema)
    merged = parts.groupBy(*dims).agg(
        *[merge(F.col(s)).alias(s) for s, (_, merge) in state.items()])
    return merged.select(*[F.col(d).cast(kinds[d]).alias(d) for d in dims],
                         F.pandas_udf(finish, kind)(*state).alias(name))
