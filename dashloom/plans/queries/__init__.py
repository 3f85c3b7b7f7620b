"""Every operator on the given tables. Importing a module registers its queries."""

from . import aggregates, behaviour, custom, joins, panels, ranking, series, streams, tables  # noqa: F401

