"""Address queries against their SQL on the numbers of many customers: Corsica's codes, department 99, and beyond five digits."""

import duckdb
import pytest

from ledgerloom.plans import catalogue

KEYS = [k for at in (1, 9_995, 10_500, 11_000, 79_990, 87_500, 89_100, 89_990, 90_000, 170_000, 900_000, 999_990, 1_000_010) for k in range(at, at + 18)]


@pytest.mark.parametrize("name", ["address_verification", "address_index_manifest", "address_enrichment"])
def test_matches_sql(spark, tmp_path, name):
    path = str(tmp_path / "customer.parquet")
    duckdb.sql(f"COPY (SELECT DISTINCT unnest({KEYS}) AS c_custkey) TO '{path}'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
