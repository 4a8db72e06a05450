"""A few registered queries of each family beside their SQL on the smallest tables; tools/check.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["a4_char_features", "a5_text_stats", "c5_drop_sparse", "d4_negative_candidates", "e5_merge_fallback", "f3_parse_date", "l2_lf_value_pattern", "m9_mapped_report", "r2_bm25_search", "s5_read_webtables_jsonl", "s8_read_sniffed_csv", "w2_inverse_transform"]


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert mine == theirs


def test_entry_gives_a_report(spark):
    df = entry.entry(spark)
    assert df.columns == ["cls", "precision", "recall", "f1", "support"] and df.count() > 3


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
