from collections import Counter

from pyspark.sql import functions as F

from tabletypes.operators import entities as E


def test_edges_equal_brute_force_and_are_made_where_they_are_counted(spark):
    cells = [(t, r, c) for t in range(4) for r in range(5 + t) for c in range(1 + t) if (t + r + c) % 7] + [(1, 2, None), (3, None, 1), (None, 1, 1), (2, 0, 1)]
    df = spark.createDataFrame([(*x, "h", "e") for x in cells], "t_id long, r_id int, c_id int, c_name string, entity string").cache()
    chunk = {(r.t_id, r.r_id): r.chunk for r in E.table_chunks(df, 6).collect() if r.t_id is not None and r.r_id is not None}
    node = lambda *x: ":".join(["cell", *[str(v) for v in x if v is not None]])
    known = sorted({x for x in cells if x[:2] in chunk}, key=str)
    want = Counter()
    for t, r, c in known:
        k, a = (t, chunk[t, r]), node(r, c)
        header = "header" + (f":{c}" if c is not None else "")
        want.update([(*k, header, a), (*k, a, header), (*k, "title", a)])
        want.update((*k, a, node(r2, c2)) for t2, r2, c2 in known if (t2, chunk[t2, r2]) == k and (r == r2 or (c is not None and c == c2)) and node(r2, c2) != a)
    edges = E.visibility_edges(df, 6)
    assert Counter(map(tuple, edges.select("t_id", "chunk", "a", "b").collect())) == want
    plan = edges.groupBy("t_id", "chunk").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange" not in plan.split("Generate inline")[0]
