"""All queries of the engine's own operators by name, each with SQL that computes the same rows in another engine."""

from __future__ import annotations

from kilnflow.plans import anomaly, catalog, preparation, recommendation, screening, suggestions

QUERIES: dict = preparation.QUERIES | anomaly.QUERIES | recommendation.QUERIES | screening.QUERIES | suggestions.QUERIES | catalog.QUERIES
ORACLE_SQL: dict = preparation.ORACLE_SQL | anomaly.ORACLE_SQL | recommendation.ORACLE_SQL | screening.ORACLE_SQL | suggestions.ORACLE_SQL | catalog.ORACLE_SQL
