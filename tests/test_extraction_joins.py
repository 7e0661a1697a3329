"""Extraction's tables grow with the pixels: none is broadcast, however small its file is."""

import pytest

from voxelweave.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["slice_extraction", "extraction_cliques", "extraction_runs"])
def test_no_broadcast(spark, monkeypatch, name):
    plans = []
    write = type(spark.range(1)).write.fget

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(type(spark.range(1)), "write", property(seen))
    got = catalogue.QUERIES[name](spark, SMALL)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and sum("SortMergeJoin" in p for p in plans) > 3
    assert not [p for p in plans if "BroadcastExchange" in p]
