"""Rows for boosting are binned and packed into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from shelfcast.operators import boosting

ROWS = [("a", 1.0, 0.5, None, 2.0), ("a", 2.0, float("nan"), 3, None), (None, 3.0, -0.0, 5, 1.0), ("b", 4.0, 7.0, 9, 0.5), ("b", 5.0, float("-inf"), 2, 1.0)]
CUTS = [[0.0, 0.5, 6.0], [2.0, 5.0]]


def test_blocks_hold_every_row_and_count_the_cuts_below(spark):
    rows = spark.createDataFrame(ROWS, "g string, y double, x0 double, x1 int, w double").coalesce(1)
    held = boosting.binned(rows, "g", ["x0", "x1"], CUTS, "y", "w")
    assert held.count() == 1  # a block, not a row each
    totals = held.selectExpr("sum(w)", "sum(wy)").first()
    assert tuple(totals) == (4.5, 2.0 + 3.0 + 2.0 + 5.0)  # a missing weight is left out
    batch = pa.RecordBatch.from_pylist([held.first().asDict()])
    ((code, bins, y, w),) = boosting._read(batch, {"a": 0, "b": 1}, 2, True)
    assert bins.tolist() == [[1, 3, 0, 3, 0], [0, 1, 1, 2, 0]]  # null is lowest, NaN highest
    assert y.tolist() == [1.0, 2.0, 3.0, 4.0, 5.0] and np.isnan(w[1])
    ((code, bins, y, w),) = boosting._read(batch, {"a": 0, "b": 1}, 2, False)
    assert code.tolist() == [0, 0, 1, 1] and y.tolist() == [1.0, 2.0, 4.0, 5.0] and bins.tolist() == [[1, 3, 3, 0], [0, 1, 2, 0]]
