"""Facts that many checks share are made once."""

from matchlake.plans import publish
from matchlake.sources import adapters

SF = "/root/testdata/sf0.001"


def test_facts_last_as_long_as_their_block(spark):
    with adapters.facts(spark, SF):
        inside = adapters.matches(spark, SF)
        assert adapters.matches(spark, SF) is inside and adapters.matches(spark, "/root/testdata/sf0.01") is not inside
    after = adapters.matches(spark, SF)
    assert after is not inside and sorted(after.columns) == sorted(inside.columns)
    assert sorted(map(repr, inside.collect())) == sorted(map(repr, after.select(*inside.columns).collect()))


def test_master_list_scans(spark):
    plan = publish.gate_master(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("lineitem.parquet" in x for x in scans) <= 2 and len(scans) <= 45, len(scans)
