from __future__ import annotations

import pytest

from cairn.operators.spread import spread_join
from tests.conftest import rows


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_the_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("x", 1), ("x", 1), (None, 2), ("only", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "h"), ("x", "a"), ("x", "b"), (None, "n"), ("other", "o")], "k string, v string")
    assert rows(spread_join(left, right, ["k"], "i", how)) == rows(left.join(right, ["k"], how))
    assert rows(spread_join(left.limit(0), right, ["k"], "i", how)) == []
