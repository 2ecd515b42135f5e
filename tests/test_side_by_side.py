"""Independent fits run side by side."""

import threading

import pytest

from metablend.session import side_by_side


def test_independent_fits_run_at_the_same_time(spark):
    meet = threading.Barrier(3, timeout=60)  # passed only if all three are there at once

    def fit(i):
        meet.wait()
        return spark.range(i + 1).count()
    assert side_by_side(spark, [lambda i=i: fit(i) for i in range(3)]) == [1, 2, 3]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0])
