"""The value dictionary: short values by themselves, long ones by digest, with the same votes either way."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tabletypes.operators import lfs as L
from tabletypes.operators import profile as P
from tabletypes.operators import values as N

ROWS = [(d, v) for d, many in (("a", 3), ("b", 5)) for v in [None, "", "x", "X", "nan", "12", " 7.5 ", "long text " * 9 + d, "LONG text " * 9, "é" * 40, "NaN"] for _ in range(many)]
PATTERNS = {"n": ["nan", r"\d+"], "long": ["long"], "none": ["zzz"]}


def cells(spark):
    return spark.createDataFrame(ROWS, "dataset_id string, value string")


def test_table_holds_every_value_once(spark):
    want = Counter(ROWS)
    for short in (0, 3, 32, 1000):
        table = N.value_table(cells(spark), {**N.NUMBER, **N.EXACT, "len": F.length}, short).collect()
        assert sorted((r.dataset_id, r.c, r.len or 0) for r in table) == sorted((d, n, len(v or "")) for (d, v), n in want.items())
        assert len({(r.dataset_id, r.v1, r.v2) for r in table}) == len(want)
        for r in table:
            assert r.name is None or (r.d1 is None and len(r.name.encode()) <= short)
            assert (r.d1 is None) == (r.d2 is None)
    assert {r.x for r in table if r.x is not None and r.x == r.x} == {12.0, 7.5}
    hist = N.numeric_histogram(N.value_table(cells(spark), N.NUMBER, 3)).collect()
    assert sorted(map(tuple, hist)) == [("a", 7.5, 3), ("a", 12.0, 3), ("b", 7.5, 5), ("b", 12.0, 5)]


def test_votes_do_not_depend_on_the_length_that_counts_as_short(spark):
    words = spark.createDataFrame([("t", "X"), ("t", "nan"), ("u", "long text " * 9), ("w", None)], "sem_type string, element string")
    n = Counter(d for d, _ in ROWS)
    overlap, pattern = set(), set()
    for t, ws in (("t", {"x", "nan"}), ("u", {"long text " * 9})):
        for d in n:
            hits = sum(v is not None and v.lower() in ws for e, v in ROWS if e == d)
            if hits >= (2 if 0.2 * n[d] <= 1 else 0.2 * n[d]):
                overlap.add((d, t))
    for t, ps in PATTERNS.items():
        for d in n:
            hits = sum(bool(re.match(f"(?i)(?:{p})", "nan" if v is None else v)) for e, v in ROWS if e == d for p in ps)
            need = int(0.2 * n[d])
            if hits >= (2 if need <= 1 else need):
                pattern.add((d, t))
    assert overlap and ("a", "long") in pattern and ("a", "none") not in pattern
    for short in (0, 3, 32, 1000):
        table = N.value_table(cells(spark), {**L.OVERLAP_MARKS, **L.pattern_marks(PATTERNS)}, short).cache()
        assert {(r.dataset_id, r.label) for r in L.overlap_votes(table, words).collect()} == overlap
        assert {(r.dataset_id, r.label) for r in L.pattern_votes(table, PATTERNS).collect()} == pattern


def test_long_texts_are_not_shuffled(spark):
    plan = P.text_stats(cells(spark))._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert keys and not any(re.search(r"\b(value|text)#", k) for k in keys)
    empty = cells(spark).limit(0)
    assert P.text_stats(empty).collect() == [] and L.lf_value_pattern(empty, PATTERNS).collect() == []
