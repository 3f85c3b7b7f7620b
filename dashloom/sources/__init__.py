"""Reading tables and streams, writing rollup tables."""
