"""The folds of caption regions run once, however often their results are read."""

from cuemill.operators import regions


def test_steps_are_not_folded_again(spark):
    boxes = [("v", n, 25.0, 80.0, 30.0, 4.0, f"text {n}", 0.875) for n in range(8)]
    found = regions.caption_regions(spark.createDataFrame(boxes, regions.BOX))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 1  # the clusters' alone
    row = found.collect()[0]
    assert (row["samples"], row["x_percent"], row["width_percent"], row["y_percent"]) == (8, 25.0, 30.0, 80.0)
