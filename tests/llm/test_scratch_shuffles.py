"""Writing an intermediate leaves the setting of shuffle removal as it was, and uses it meanwhile."""

import pytest

from tablescope.llm import common


@pytest.mark.parametrize("before", [None, "false"])
def test_pin_removes_shuffles_of_its_own_write_only(spark, monkeypatch, before):
    seen, path = [], common.scratch_path
    at = lambda: spark.conf.get(common.SHUFFLES_GO, None)
    usual = at()
    if before is not None:
        spark.conf.set(common.SHUFFLES_GO, before)
    with common.shuffles_go(spark):
        seen.append(at())
    rows = common.pin(spark.range(100).groupBy((common.F.col("id") % 7).alias("k")).count(), "shuffles")
    assert seen == ["true"] and rows.count() == 7
    assert at() == (usual if before is None else before)
    spark.conf.unset(common.SHUFFLES_GO)
