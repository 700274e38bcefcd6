"""Every registered query of the subpackage at the smallest size, and its SQL twin where there is one."""

import glob
import os

import duckdb
import pytest

from pagewright.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
COLUMNS = {
    "p1_found": ["page_id", "boundary"], "p2_found": ["record_id", "group_id"], "p3_found": ["table_name", "key_a", "key_b"], "p4_found": ["table_name", "row_key", "start_pos"],
    "p5_found": ["page_id", "line_no", "kind"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    got = df.toPandas()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert not got[[c for c in COLUMNS[name] if c != "ids"]].duplicated().any()
    sql = Q.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = con.execute(sql).df()
        assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))
