"""Long chains: whole or an error, never cut short."""

import inspect

import pytest

from linkloom.operators import graphs as G
from tests.conftest import rows

N = 53


def test_long_chain_is_whole(spark):
    e = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(N)], "src string, dst string")
    start = spark.createDataFrame([("000",)], "node string")
    assert rows(G.distances(e, start)) == [("000", f"{i:03}", i) for i in range(N + 1)]


@pytest.mark.parametrize("f", [G.cycle_nodes, G.distances])
def test_a_bound_that_is_met_is_an_error(spark, f):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    with pytest.raises(RuntimeError):
        f(e, *([start] if f is G.distances else []), max_rounds=1)
    assert inspect.signature(f).parameters["max_rounds"].default is None
