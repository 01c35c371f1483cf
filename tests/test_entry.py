import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF
from foliospark.catalog import check, load
from foliospark.catalog.tables import BASE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in BASE:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", [
    "sr_bm25", "sr_hybrid_rrf", "jn_page_chapter", "jn_solution_resolve", "win_moving_latency", "agg_term_counts",
    "job_enqueue", "set_index_rows", "rate_limit_batch"])
def test_oracle(spark, con, name):
    state, note, _ = check.compare(spark, SF, load()[name], con)
    assert state == "ok", note
