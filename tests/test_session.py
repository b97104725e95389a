"""Steps that do not need each other."""
import threading

import pytest

from pricecast.session import together


def test_steps_run_side_by_side_and_keep_their_order(spark):
    """each waits for the other, so one after the other would never end."""
    met = threading.Barrier(2, timeout=30)

    def step(n):
        met.wait()
        return spark.range(n).count()

    assert together(spark, lambda: step(3), lambda: step(5)) == [3, 5]


def test_the_error_of_a_step_is_raised(spark):
    def fails():
        raise ValueError("no rows")

    with pytest.raises(ValueError, match="no rows"):
        together(spark, fails, lambda: spark.range(2).count())
