"""The bounded prefilter never loses a key and leaves most others out."""

import pytest
from pyspark.sql import functions as F

from belfry.operators import keyfilter


@pytest.mark.parametrize("bits", [17, 23])
def test_no_key_is_lost(spark, monkeypatch, bits):
    monkeypatch.setattr(keyfilter, "BITS", bits)
    table = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("path"), "id")
    keys = table.where("id % 37 = 0").select(F.col("path").alias("wanted"))
    flagged = keyfilter.with_likely(table, keys, "path", "wanted")
    assert flagged.columns == ["path", "id", "likely"] and flagged.count() == 40_000
    assert flagged.where("id % 37 = 0 and not likely").count() == 0
    assert flagged.where("id % 37 <> 0 and likely").count() < 1000
    assert keyfilter.likely(table, keys.limit(0), "path", "wanted").count() == 0


def test_null_keys_and_no_exchange(spark):
    table = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "path string, n int")
    keys = spark.createDataFrame([("a",), (None,)], "path string")
    kept = keyfilter.likely(table, keys, "path")
    assert {r.n for r in kept.collect()} >= {1}
    plan = kept._jdf.queryExecution().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all("_groupingexpression" in line for line in shuffles)  # those of the bits, none of the table
