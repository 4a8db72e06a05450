import numpy as np
import pytest

from tabletypes.operators import emd as E
from tabletypes.operators import profile as P

from .test_emd import brute


@pytest.mark.parametrize(("hot_rows", "side"), [(10**6, 256), (15, 3)])
def test_blocks_and_cells_give_the_distances_of_all_pairs(spark, hot_rows, side):
    rng = np.random.default_rng(4)
    data = {f"c{i}": rng.integers(0, 5 + 10 * i, 40 + i).astype(float) * 10 ** (i % 4 - 2) for i in range(6)}
    data |= {"one": np.array([3.0]), "far": np.array([1e6, 1e6 + 1])}
    hist = P.value_histogram(spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "dataset_id string, x double")).cache()
    pairs = [(u, l) for u in data for l in data]
    got = {(r.u, r.l): r.emd for r in E.block_distances(spark.createDataFrame(pairs, "u string, l string"), hist, hist, hot_rows, side).collect()}
    assert set(got) == set(pairs)
    for u, l in pairs:
        assert got[u, l] == pytest.approx(brute(data[u], data[l]), rel=1e-12, abs=1e-9)


def test_a_side_without_values_and_values_without_end(spark):
    hist = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 1), ("b", 2.0, 2), ("z", 1.0, 1), ("z", float("inf"), 1)], "dataset_id string, x double, cnt long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "none"), ("none", "a"), ("none", "nil"), ("a", "z"), ("a", None)], "u string, l string")
    for hot_rows in (10**6, 2):
        got = {(r.u, r.l): r.emd for r in E.block_distances(pairs, hist, hist, hot_rows).collect()}
        assert got == {("a", "b"): 1.0, ("a", "none"): 1.0, ("none", "a"): 1.0, ("a", "z"): float("inf")}
