"""The first and last second of the export against its SQL, to the second."""

import duckdb
import pytest

from kilnflow.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("first, last", [("2024-01-01 00:09:58.778549", "2024-01-30 23:26:16.220708"), ("2024-01-01 00:00:01.5", "2024-01-01 00:00:02.5"), ("1969-12-31 23:59:57.5", "1969-12-31 23:59:58.700001"), ("2024-01-01 00:00:00", "2024-01-01 00:00:00.499999")])
def test_seconds_equal_the_sql(spark, tmp_path, first, last):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * FROM (VALUES (TIMESTAMP '{first}'), (TIMESTAMP '{last}'), (NULL)) t(ts)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert tuple(QUERIES["epoch_export"](spark, str(tmp_path)).first()) == con.execute(ORACLE_SQL["epoch_export"]).fetchone()
