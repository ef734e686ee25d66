"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import key_queries, more_queries, source_queries, store_queries, traffic_queries

QUERIES: dict = {**key_queries.QUERIES, **traffic_queries.QUERIES, **store_queries.QUERIES, **more_queries.QUERIES, **source_queries.QUERIES}
ORACLES: dict[str, str] = {**key_queries.ORACLES, **traffic_queries.ORACLES, **store_queries.ORACLES, **more_queries.ORACLES, **source_queries.ORACLES}


def _as_bigint(name: str, *columns: str) -> None:
    """Counts that DuckDB gives as HUGEINT, as Spark's long."""
    ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({ORACLES[name]})"


_as_bigint("agg_02_prefix_tree", "ends")
_as_bigint("agg_05_naming_findings", "n")
_as_bigint("agg_09_key_accesses", "reads", "writes", "deletes")
_as_bigint("srt_03_busiest_keys", "reads", "writes", "deletes", "total")
_as_bigint("agg_10_pattern_rollup", "read_once")
_as_bigint("agg_12_hot_keys", "total")
_as_bigint("agg_12_findings", "n")
_as_bigint("fil_02_comparisons", "eq", "ne", "lt", "ge", "not_ge")
_as_bigint("fil_05_functions", "not_exists", "begins", "contains", "element", "size")
