"""Query plans of questions in which the joining word stands beside marks, held against the SQL of the queries."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from proofloom.plans import registry

TEXTS = ["Onha inor onor or. Es in reerwh.", "Ntwh ing or, es be.", "Rooms or halls", "Oror onor, orly.", "The of", "", None]


@pytest.mark.parametrize("name", ["budget_quotas", "query_plan_variants"])
def test_joining_word_beside_marks(spark, tmp_path, name):
    pq.write_table(pa.table({"item_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet')")
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    assert want and sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select(*names).collect()) == want
