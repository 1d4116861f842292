"""Cubes of event numbers that pass 64 bits."""

from collections import Counter

from pyspark.sql import functions as F

from braidflow.functions import numbers
from braidflow.plans import QUERIES


def test_cubes(spark, tmp_path):
    ids = [0, 1, 20, 2_097_151, 2_097_152, 5_999_999, 10**12 + 7, 2**63 - 1, -(2**62) - 3]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    rest = lambda a, m: a % m if a >= 0 else -(-a % m)  # the sign of the number, as in SQL
    want = spark.createDataFrame([((rest(i, 41) - 20) * rest(i**3, 9999999967),) for i in ids], "v long").select(numbers.signed_bucket(F.col("v")).alias("b")).collect()
    got = {r["bucket"]: r["n"] for r in QUERIES["p16_signed_bucket"](spark, str(tmp_path)).collect()}
    assert got == Counter(r["b"] for r in want)
