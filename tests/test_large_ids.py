"""Check texts and queries agree on ids of more digits than the test tables have."""

import pytest

from tests.oracle import compare, connect

ORDERS = """select i as o_orderkey, 5 as o_custkey, 'O' as o_orderstatus, 1.0 as o_totalprice, timestamp '2000-01-01' as o_orderdate, '1' as o_orderpriority
  from range(230000) t(i)"""
LINEITEM = "select i as l_orderkey, n::int as l_linenumber from range(230000) t(i), range(3) u(n)"
CUSTOMER = "select i as c_custkey, 'c' as c_name, 0 as c_nationkey, 0.0 as c_acctbal, 'MACHINERY' as c_mktsegment from unnest([7, 700, 70000, 700000, 7000000]) t(i)"


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """More than 99,999 patients without a case id of their own, and case ids of up to seven digits."""
    folder = str(tmp_path_factory.mktemp("large"))
    con = connect("/root/testdata/sf0.001")
    for name in ("supplier", "part"):
        con.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    for name, text in (("orders", ORDERS), ("lineitem", LINEITEM), ("customer", CUSTOMER)):
        con.execute(f"copy ({text}) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create or replace view {name} as select * from '{folder}/{name}.parquet'")
    con.execute(f"create or replace view supplier as select * from '{folder}/supplier.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["assign_case_ids", "case_id_collisions", "manifest_by_partition", "label_cells"])
def test_many_patients(spark, large, name):
    folder, con = large
    ok, message = compare(spark, con, folder, name)
    assert ok, message


def test_roc_halves(spark, tmp_path):
    """With 16,000 negatives some shares lie halfway between two roundings, such as 1001 / 16000."""
    con = connect("/root/testdata/sf0.001")
    con.execute(
        f"""copy (select i as event_id, timestamp '2024-01-01' as ts, (i % 2 + 1)::bigint as user_id, 'view' as event_type, 1.0 as value, '' as props from range(16000) t(i)
union all select 16000 + i, timestamp '2024-01-01', 0, 'view', 2.0, '' from range(100) t(i)) to '{tmp_path}/events.parquet' (format parquet)"""
    )
    con.execute(f"create or replace view events as select * from '{tmp_path}/events.parquet'")
    ok, message = compare(spark, con, str(tmp_path), "roc_curve")
    assert ok, message
