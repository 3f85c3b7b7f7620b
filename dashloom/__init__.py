"""Dashboard panels as Spark DataFrames."""

from .operators.aggregates import (
    breakdown, cross_totals, distinct, distinct_bitmaps, distinct_sketch, facets, first_last,
    grouping_sets, histogram, kpi, label_rates, matrix, melt, merge_bitmaps, merge_distinct, percentiles, percentiles_approx,
    profile, spread, subtotals)
from .operators.behaviour import funnel, funnel_times, retention, sessions
from .operators.filters import Filter, apply_filters, derive, json_dim, json_dims
from .operators.joins import asof_latest, in_segment, not_in_segment, orphans, star, within
from .operators.ranking import pareto, rows_after, top_n_other, top_per_group
from .operators.series import fill_gaps, moving, rolling, running, series, vs_previous, zscore
from .operators.sets import members, period_diff, stack
from .plans.dashboard import Dashboard, Tile, run_dashboard, tile_rows
from .plans.panel import Join, Panel, run_panel
from .sources.tables import event_stream, load, table

__all__ = [
    "Dashboard", "Filter", "Join", "Panel", "Tile", "distinct_bitmaps", "json_dims", "merge_bitmaps", "run_dashboard", "tile_rows", "apply_filters", "asof_latest", "breakdown",
    "cross_totals", "derive", "distinct", "distinct_sketch", "event_stream", "facets",
    "fill_gaps", "first_last", "funnel", "funnel_times", "grouping_sets", "histogram",
    "in_segment", "json_dim", "kpi", "label_rates", "load", "matrix", "melt", "members",
    "merge_distinct", "moving", "not_in_segment", "orphans", "pareto", "percentiles",
    "percentiles_approx", "period_diff", "profile", "retention", "rolling", "rows_after",
    "run_panel", "running", "series", "sessions", "spread", "stack", "star", "subtotals",
    "table", "top_n_other", "top_per_group", "vs_previous", "within", "zscore",
]
