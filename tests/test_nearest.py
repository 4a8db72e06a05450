"""Exact nearest columns, constants against histograms and related tables, against all pairs."""

import numpy as np
import pytest

from tabletypes.operators import emd as E
from tabletypes.operators import profile as P


def brute(a, b):
    xs = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.sum(np.abs(fa - fb)[:-1] * np.diff(xs)))


@pytest.fixture(scope="module")
def sides(spark):
    """Columns whose means say little: wide and narrow ones, copies, constants and far outliers."""
    rng = np.random.default_rng(5)
    u, l = {}, {}
    for i in range(24):
        centre, width = rng.uniform(-40, 40), rng.choice([0.5, 8, 60])
        u[f"u{i:02}"] = np.round(rng.normal(centre, width, rng.integers(2, 30)), 1)
    for i in range(40):
        centre, width = rng.uniform(-40, 40), rng.choice([0.5, 8, 60])
        l[f"l{i:02}"] = np.round(rng.normal(centre, width, rng.integers(1, 30)), 1)
    u |= {"one": np.array([7.0]), "same": np.array([7.0, 7.0, 7.0]), "far": np.array([1e6, 1e6 + 1]), "copy": u["u03"], "low": np.array([-1e5])}
    l |= {"l_copy": l["l05"], "l_twice": np.repeat(l["l05"], 2), "l_high": np.array([2e6]), "u03_twin": u["u03"]}

    def hist(columns):
        rows = [(k, float(x)) for k, v in columns.items() for x in v]
        return P.value_histogram(spark.createDataFrame(rows, "dataset_id string, x double")).cache()

    types = {k: f"t{i % 5}" for i, k in enumerate(sorted(l))}
    return u, l, hist(u), hist(l), types, spark.createDataFrame(list(types.items()), "dataset_id string, semantic_type string")


def best_of(u, l, types, partners=None):
    out = {}
    for k, x in u.items():
        d = {m: round(brute(x, y), 9) for m, y in l.items() if partners is None or (k, m) in partners}
        if d:
            ties = [m for m in d if d[m] == min(d.values())]
            out[k] = (pytest.approx(min(d.values()), abs=1e-8), min(ties), min(types[m] for m in ties), len({types[m] for m in ties}))
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 30])
def test_every_column_has_its_nearest(spark, sides, hot_rows):
    u, l, hu, hl, types, frame = sides
    got = {r.u: (r.emd, r.l, r.semantic_type, r.n_types) for r in E.nearest(hu, hl, frame, hot_rows).collect()}
    assert got == best_of(u, l, types)


def test_band_measures_few_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    centres = rng.permutation(200) * 10.0
    rows = [(f"{'ul'[i % 2]}{i}", float(c + x)) for i, c in enumerate(centres) for x in rng.integers(0, 9, 6)]
    hist = P.value_histogram(spark.createDataFrame(rows, "dataset_id string, x double")).cache()
    found = E.band_pairs(hist.where("dataset_id like 'u%'"), hist.where("dataset_id like 'l%'"))
    assert found.count() == found.distinct().count() < 100 * 100 / 20


def test_all_columns_compared(spark, sides):
    u, l, hu, hl, _, _ = sides
    for block in (1000, 3):
        rows = E.cross_compare(hu, hl, block=block).collect()
        assert len(rows) == len(u) * len(l)
        assert {(r.u, r.l): r.emd for r in rows} == {(a, b): pytest.approx(brute(x, y), abs=1e-8) for a, x in u.items() for b, y in l.items()}


@pytest.mark.parametrize("hot_rows", [10**6, 8])
def test_constants_look_up_running_sums(spark, sides, hot_rows):
    _, l, _, hl, _, _ = sides
    asked = [(f"c{i}", m, c) for i, c in enumerate([-1e5, -3.3, 0.0, 7.0, 12.5, 1e6]) for m in l]
    got = {(r.u, r.l): r.emd for r in E.constant_distances(spark.createDataFrame(asked, "u string, l string, c double"), hl, hot_rows).collect()}
    assert got == {(k, m): pytest.approx(brute(np.array([c]), l[m]), rel=1e-12, abs=1e-9) for k, m, c in asked}


@pytest.mark.parametrize("mode", [0, 1])
def test_related_tables_only(spark, sides, mode):
    u, l, hu, hl, types, frame = sides
    text = {"A": {"p", "q"}, "B": {"q"}, "C": {"r"}}
    tables = "ABCD"  # D has no labeled text
    ut = {k: tables[i % 4] for i, k in enumerate(u)}
    lt = {k: tables[i % 3 if i % 5 else 3] for i, k in enumerate(l)}
    labeled = [(k, lt[k], types[k], "numeric") for k in l] + [(f"{t}{s}", t, s, "text") for t, kinds in text.items() for s in kinds]
    partners = {(a, b) for a in u for b in l if ut[a] != lt[b] and text.get(ut[a], set()) & text.get(lt[b], set())}
    if mode == 1:
        partners |= {(a, b) for a in u for b in l if lt[b] == "D"}
    want = {}
    for k, (emd, _, label, n) in best_of(u, l, types, partners).items():
        std = np.std(u[k], ddof=1) if len(u[k]) > 1 else None
        if n == 1 and (std is None or emd.expected < 0.9 * std):
            want[k] = (label, emd)
    got = E.lf_numeric_emd_pruned(
        hu, hl, frame, 0.9, spark.createDataFrame(list(ut.items()), "dataset_id string, table_id string"),
        spark.createDataFrame(labeled, "dataset_id string, table_id string, semantic_type string, kind string"), mode,
    )
    assert {r.dataset_id: (r.label, r.emd) for r in got.collect()} == want and want


def test_no_columns(spark, sides):
    _, _, hu, hl, _, frame = sides
    none = hu.limit(0)
    assert E.nearest(none, hl, frame).collect() == [] and E.nearest(hu, none, frame).collect() == []
    assert E.cross_compare(none, hl).collect() == [] and E.lf_numeric_emd(hu, none, frame).collect() == []
