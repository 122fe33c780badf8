"""Sizes are rounded by what they are in binary, as the SQL does, not by how they are printed."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from cuemill.functions import numbers as N


def test_memory_label_is_the_rounded_binary_value(spark):
    rng = random.Random(3)
    ties = [(2 * n + 1) * 2.0**28 for n in (0, 1, 2, 3, 7812, 7813)]  # quarters of a gigabyte
    sizes = [4194304e6, 8388608e6, 1.0, 0.05 * 2**30, 0.15 * 2**30, 0.25 * 2**30 * (1 + 2.0**-52), 2.0**30 - 1, 1e16, -ties[1], *ties, *[float(rng.randrange(10**13)) for _ in range(200)], *[rng.random() * 2**30 for _ in range(200)]]
    found = spark.createDataFrame([(s,) for s in sizes], "size double").select("size", N.memory_label(F.col("size")).alias("label")).collect()
    assert {r["size"]: r["label"] for r in found} == {s: f"{s / 2**30:.1f} GB" for s in sizes}
    assert f"{4194304e6 / 2**30:.1f}" == "3906.2" and Fraction(4194304e6) / 2**30 == Fraction("3906.25")
    rest = spark.sql("SELECT CAST(NULL AS DOUBLE) AS size UNION ALL SELECT 0").select(N.memory_label(F.col("size"))).collect()
    assert [r[0] for r in rest] == ["--", "--"]
