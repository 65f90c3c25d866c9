import pytest
from oracle import compare

from talweg.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, name):
    if name in ORACLES:
        compare(QUERIES[name](spark, small), ORACLES[name], small)
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_rank_does_not_depend_on_partitions(spark, small):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, QUERIES["guide_hybrid"](spark, small).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]


def test_filters_reach_the_scan(spark, small, capsys):
    QUERIES["point_lookup"](spark, small).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(s_suppkey,3)" in plan
    assert "ReadSchema: struct<s_suppkey:bigint,s_name:string>" in plan
