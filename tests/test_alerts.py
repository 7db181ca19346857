"""Plans of operators that must not gather a key's history, or all rows, in one place."""

import pytest

from fieldloom.plans import catalog


@pytest.mark.parametrize("name", ["t04_alerts", "t07_rate_limit", "k07_retain", "d12_age"])
def test_nothing_is_gathered(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert "windowspecdefinition(specifiedwindowframe" not in plan
