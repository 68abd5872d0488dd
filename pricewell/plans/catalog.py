"""All queries over the adapter views, with the DuckDB SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricewell.operators import estimate, text
from pricewell.plans import anomaly, chaining, estimates, frames, matching, nowcast, sql_index, sql_queries, sql_rules
from pricewell.sources.adapters import VIEWS, with_views

VIEWS.update(sql_rules.VIEWS)

FLAGSHIP = "flagship"


#: All queries in SQL.
SQL: dict[str, str] = {**sql_queries.SQL, **sql_index.SQL, **sql_rules.SQL}

#: Queries in the DataFrame API; their SQL is only the check.
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {**estimate.FRAMES, **text.FRAMES, **frames.FRAMES, **anomaly.FRAMES, **nowcast.FRAMES, **chaining.FRAMES}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for n, (f, _) in FRAMES.items()} | {n: estimates.query(s) for n, s in SQL.items()} | estimates.PLANS | anomaly.PLANS | frames.UNCHECKED | anomaly.UNCHECKED | nowcast.UNCHECKED | matching.UNCHECKED
ORACLES: dict[str, str] = {n: with_views(s, False) for n, s in [*((n, s) for n, (_, s) in FRAMES.items()), *SQL.items()]}
