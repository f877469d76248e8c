from __future__ import annotations

from cairn.operators.sampling import hash_sample


def test_hash_sample(spark):
    df = spark.range(20_000).selectExpr("id", "IF(id % 100 = 0, 'rare', 'often') AS kind")
    some = hash_sample(df, "id", 1000)
    assert 850 < some.count() < 1150 and some.exceptAll(hash_sample(df, "id", 1000)).isEmpty()
    by = {r[0]: r[1] for r in hash_sample(df, "id", 1000, "kind").groupBy("kind").count().collect()}
    assert by["rare"] == 200 and 850 < by["often"] < 1150
    assert hash_sample(df, "id", 10**9).count() == 20_000
    assert hash_sample(df.limit(0), "id", 5).count() == hash_sample(df.limit(0), "id", 5, "kind").count() == 0
    assert "TakeOrdered" not in some._jdf.queryExecution().toString()
