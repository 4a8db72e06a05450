"""Profiles, value distributions and cell functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corpus as C
from ..operators import profile as P
from . import fixtures as X
from .registry import query


def hist(spark, sf, types=None):
    return P.value_histogram(C.numeric_cells(X.cells(spark, sf, types or X.NUMERIC)))


_PROFILE = (
    "prof AS (SELECT dataset_id, count(*) AS n, round(avg(x) + 1e-10, 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS min, "
    "round(quantile_cont(x, 0.25), 6) + 0.0 AS q1, round(quantile_cont(x, 0.5), 6) + 0.0 AS median, round(quantile_cont(x, 0.75), 6) + 0.0 AS q3, "
    "round(max(x), 6) + 0.0 AS max, count(DISTINCT x) AS nunique FROM num GROUP BY dataset_id)"
)


def profile(spark, sf):
    p = P.numeric_profile(hist(spark, sf))
    p = p.withColumn("mean", F.col("mean") + 1e-10)  # keep clear of rounding ties
    return p.select("dataset_id", "n", "nunique", *[S.rnd(c).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")])


@query("a1_numeric_profile", f"WITH {X.hist_cte()}, {_PROFILE} SELECT * FROM prof")
def a1(spark, sf):
    return profile(spark, sf)


@query(
    "a2_profile_groups",
    f"WITH {X.hist_cte()}, {_PROFILE} SELECT dataset_id, min, q1, median, q3, max, n_columns FROM "
    "(SELECT *, count(*) OVER (PARTITION BY min, q1, median, q3, max) AS n_columns FROM prof) WHERE n_columns > 1",
)
def a2(spark, sf):
    return P.same_summary(profile(spark, sf))


@query(
    "a2_constant_or_zero",
    f"WITH {X.hist_cte()}, {_PROFILE} SELECT dataset_id, 'constant' AS why FROM prof WHERE nunique < 2 UNION ALL SELECT dataset_id, 'zero' FROM prof WHERE q1 = 0 AND median = 0 AND q3 = 0",
)
def a2_flags(spark, sf):
    p = profile(spark, sf)
    return P.constant_columns(p).withColumn("why", F.lit("constant")).unionByName(P.zero_quartiles(p).withColumn("why", F.lit("zero")))


@query("a3_value_histogram", f"WITH {X.hist_cte()} SELECT dataset_id, x, cnt FROM hist")
def a3(spark, sf):
    return hist(spark, sf)


@query(
    "w1_cdf",
    f"WITH {X.hist_cte()} SELECT dataset_id, x, round(sum(cnt) OVER (PARTITION BY dataset_id ORDER BY x) / sum(cnt) OVER (PARTITION BY dataset_id), 6) + 0.0 AS cdf FROM hist",
)
def w1(spark, sf):
    return P.cdf(hist(spark, sf)).withColumn("cdf", S.rnd("cdf"))


@query(
    "w2_inverse_transform",
    f"WITH {X.hist_cte()}, c AS (SELECT dataset_id, x, sum(cnt) OVER w AS u, sum(cnt) OVER (PARTITION BY dataset_id) AS n, lead(x) OVER w AS nx, lead(cnt) OVER w AS nc, "
    "row_number() OVER w AS r FROM hist WINDOW w AS (PARTITION BY dataset_id ORDER BY x)), "
    "g AS (SELECT i FROM range(1, 11) t(i)) "
    "SELECT dataset_id, i::INTEGER AS i, round(CASE WHEN nx IS NULL THEN x ELSE x + (nx - x) * (i * n / 10 - u) / nc END, 6) + 0.0 AS x FROM c JOIN g "
    "ON i * n >= 10 * u AND (nx IS NULL OR i * n < 10 * (u + nc)) "
    "UNION ALL SELECT dataset_id, i::INTEGER, round(x, 6) + 0.0 FROM c JOIN g ON r = 1 AND i * n < 10 * u",
)
def w2(spark, sf):
    return P.inverse_transform(hist(spark, sf), 10).withColumn("x", S.rnd("x"))


_ALL = X.NUMERIC + X.TEXT + ["date", "description"]
_WANTED = "(ascii(char) BETWEEN 32 AND 126 OR ascii(char) = 12)"


@query(
    "a4_char_features",
    f"WITH {X.cells_cte(_ALL)}, p AS (SELECT * FROM cells WHERE value IS NOT NULL), sz AS (SELECT dataset_id, count(*) AS n FROM p GROUP BY 1), "
    "e AS (SELECT dataset_id, row_id, unnest(string_split(value, '')) AS char FROM p), "
    f"k AS (SELECT dataset_id, row_id, char, count(*) AS k FROM e WHERE {_WANTED} GROUP BY ALL "
    "UNION ALL SELECT dataset_id, row_id, 'length', length(value) FROM p WHERE length(value) > 0), "
    "g AS (SELECT dataset_id, char, n, count(*) AS sm, min(k) AS lo, max(k) AS hi, sum(k::DOUBLE) AS s1, sum(k::DOUBLE ** 2) AS s2, sum(k::DOUBLE ** 3) AS s3, sum(k::DOUBLE ** 4) AS s4, "
    "list_sort(list(k)) AS ks FROM k JOIN sz USING (dataset_id) GROUP BY ALL), "
    "m AS (SELECT *, s1 / n AS mean, s2 / n - (s1 / n) ** 2 AS m2, s3 / n - 3 * (s1 / n) * s2 / n + 2 * (s1 / n) ** 3 AS m3, "
    "s4 / n - 4 * (s1 / n) * s3 / n + 6 * (s1 / n) ** 2 * s2 / n - 3 * (s1 / n) ** 4 AS m4, n - sm AS z, (n - 1) // 2 AS i1, n // 2 AS i2 FROM g) "
    "SELECT dataset_id, char, sm > 0 AS \"any\", sm = n AS \"all\", round(mean + 1e-10, 6) + 0.0 AS mean, round(CASE WHEN m2 > 1e-9 THEN m2 ELSE 0 END + 1e-8, 4) + 0.0 AS var, "
    "CASE WHEN sm = n THEN lo ELSE 0 END AS min, hi AS max, "
    "((CASE WHEN i1 < z THEN 0 ELSE ks[i1 - z + 1] END) + (CASE WHEN i2 < z THEN 0 ELSE ks[i2 - z + 1] END)) / 2 AS median, s1::BIGINT AS sum, "
    "round(CASE WHEN m2 > 1e-9 THEN m4 / (m2 * m2) - 3 END + 1e-8, 4) + 0.0 AS kurtosis, round(CASE WHEN m2 > 1e-9 THEN m3 / m2 ** 1.5 END + 1e-8, 4) + 0.0 AS skewness FROM m",
)
def a4(spark, sf):
    f = P.char_features(X.cells(spark, sf, _ALL))
    return f.withColumns({"mean": S.rnd(F.col("mean") + 1e-10), **{c: S.rnd(F.col(c) + 1e-8, 4) for c in ("var", "kurtosis", "skewness")}})


@query(
    "a4_null_features",
    f"WITH {X.cells_cte(X.TEXT, True)} SELECT dataset_id, count(*) AS n_values, count(*) > count(value) AS none_has, round((count(*) - count(value)) / count(*), 6) + 0.0 AS none_percent, "
    "count(*) - count(value) AS none_num, count(value) = 0 AS none_all FROM cells GROUP BY 1",
)
def a4_nulls(spark, sf):
    return P.null_features(X.cells(spark, sf, X.TEXT, dirty=True)).withColumn("none_percent", S.rnd("none_percent"))


def _count(pattern):
    return f"length(regexp_replace(value, '[^{pattern}]', '', 'g'))"


_SPEC = '!@#$%^&*(),.?":{}|<>'
_STATS = {"num": _count("0-9"), "text": _count("a-zA-Z"), "spec": f"length(value) - length(translate(value, '{_SPEC}', ''))", "word": "length(value) - length(translate(value, '\" ', '')) + 1"}


@query(
    "a5_text_stats",
    f"WITH {X.cells_cte(_ALL)}, k AS (SELECT dataset_id, value, {', '.join(f'{e} AS {c}' for c, e in _STATS.items())} FROM cells WHERE value IS NOT NULL), "
    "p AS (SELECT dataset_id, value, count(*) AS f FROM k GROUP BY ALL), e AS (SELECT dataset_id, sum(f) AS n, -sum(f / n0 * log2(f / n0)) AS col_entropy, count(*) AS d FROM "
    "(SELECT *, sum(f) OVER (PARTITION BY dataset_id) AS n0 FROM p) GROUP BY 1) "
    "SELECT k.dataset_id, round(any_value(col_entropy), 6) + 0.0 AS col_entropy, round(any_value(d / n), 6) + 0.0 AS frac_unique, "
    "round(avg((num > 0)::INTEGER), 6) + 0.0 AS frac_numcells, round(avg((text > 0)::INTEGER), 6) + 0.0 AS frac_textcells, "
    + ", ".join(f"round(avg({c}), 6) + 0.0 AS avg_{c}_cells, round(stddev_pop({c}), 6) + 0.0 AS std_{c}_cells" for c in _STATS)
    + " FROM k JOIN e USING (dataset_id) GROUP BY 1",
)
def a5(spark, sf):
    out = P.text_stats(X.cells(spark, sf, _ALL))
    return out.select("dataset_id", *[S.rnd(c).alias(c) for c in out.columns if c != "dataset_id"])


_MONTHS = ", ".join(f"'{m}'" for name in S.MONTH_NAMES for m in (name, name.lower(), name[:3], name[:3].lower()))
_BOOL = ", ".join(f"'{w}'" for w in S.BOOLEAN_WORDS)


@query(
    "f2_storage_type",
    f"WITH {X.cells_cte(_ALL)}, {X.columns_cte()}, v AS (SELECT dataset_id, translate(value, ',%$€\"''', '') AS v FROM cells WHERE value <> ''), "
    "s AS (SELECT dataset_id, count(*) + 1 AS string, "
    f"7 * count(*) FILTER (WHERE lower(trim(v)) IN ({_BOOL})) AS boolean, 6 * count(*) FILTER (WHERE regexp_matches(v, '^(0|-?[1-9]\\d*)$')) AS integer, "
    "4 * count(*) FILTER (WHERE regexp_matches(v, '^\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?\\s*$')) AS decimal, "
    "6 * count(*) FILTER (WHERE length(v) <> 1 AND regexp_matches(v, '^\\d{1,4}[-/]\\S+[-/]\\S+')) AS date, "
    f"7 * count(*) FILTER (WHERE v IN ({_MONTHS})) AS month, "
    "7 * count(*) FILTER (WHERE length(v) >= 4 AND v[1:2] IN ('18', '19', '20', '21')) AS year FROM v GROUP BY 1), "
    "r AS (SELECT dataset_id, CASE greatest(string, boolean, integer, decimal, date, month, year) WHEN string THEN 'string' WHEN boolean THEN 'boolean' WHEN integer THEN 'integer' "
    "WHEN decimal THEN 'decimal' WHEN date THEN 'date' WHEN month THEN 'month' ELSE 'year' END AS voted FROM s), "
    "o AS (SELECT c.dataset_id, CASE WHEN regexp_matches(header, '(date|Date|DATE)$') THEN 'date' WHEN regexp_matches(header, '(month|Month|MONTH)$') THEN 'month' "
    "WHEN regexp_matches(header, '(year|Year|YEAR)$') THEN 'year' WHEN regexp_matches(header, '(id|ID|Id|name)$') THEN 'id' ELSE coalesce(voted, 'string') END AS storage_type "
    "FROM columns_ c LEFT JOIN r USING (dataset_id)) "
    "SELECT dataset_id, storage_type, CASE WHEN storage_type IN ('id', 'string', 'boolean') THEN 'c' WHEN storage_type IN ('integer', 'decimal') THEN 'q' ELSE 't' END AS general_type FROM o",
)
def f2(spark, sf):
    return P.storage_types(X.columns(spark, sf), X.cells(spark, sf, _ALL))


# word vectors: every word of the low-cardinality text columns gets the vector of one embedding
WORD_TYPES = ["segment", "product", "category", "language", "flag"]


def word_vectors(spark, sf, types=None):
    from ..plans.ordered import position

    cells = X.cells(spark, sf, types or WORD_TYPES)
    tokens = cells.select(F.explode(F.split(F.lower("value"), " ")).alias("token")).distinct()
    numbered = position(tokens, [], ["token"], "i")
    vectors = X.base(spark, sf, "embeddings")
    ordered = position(vectors.select("vec_id", "embedding"), [], ["vec_id"], "j")
    n = vectors.agg(F.count(F.lit(1)).alias("m"))
    keyed = numbered.crossJoin(F.broadcast(n)).withColumn("j", (F.col("i") - 1) % F.col("m") + 1)  # one row
    return keyed.join(ordered, "j").select("token", F.col("embedding").alias("vec"))


WORDS_CTE = (
    "tok AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS i FROM (SELECT DISTINCT unnest(string_split(lower(value), ' ')) AS token FROM cells)), "
    "emb AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS j, count(*) OVER () AS m FROM embeddings), "
    "wv AS (SELECT token, embedding AS vec FROM tok JOIN emb ON i % m = j), "
    "d AS (SELECT dataset_id, value, count(*) AS f FROM cells WHERE value IS NOT NULL GROUP BY ALL), "
    "dv AS (SELECT DISTINCT value FROM d), "
    "wt AS (SELECT value, CASE WHEN lower(value) IN (SELECT token FROM wv) THEN [lower(value)] ELSE string_split(lower(value), ' ') END AS ts FROM dv), "
    "wd AS (SELECT value, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM (SELECT value, unnest(ts) AS token FROM wt) JOIN wv USING (token)), "
    "vv AS (SELECT value, dim, avg(x::DOUBLE) AS x FROM wd GROUP BY ALL), "
    "pl AS (SELECT dataset_id, dim, x, f FROM d JOIN vv USING (value))"
)


@query(
    "a6_vector_stats",
    f"WITH {X.cells_cte(WORD_TYPES)}, {WORDS_CTE}, "
    "h AS (SELECT dataset_id, dim, x, sum(f) AS f FROM pl GROUP BY ALL), "
    "r AS (SELECT dataset_id, dim, unnest(range(0, f::BIGINT)) AS rep, x FROM h) "
    "SELECT dataset_id, dim::INTEGER AS dim, round(avg(x), 5) + 0.0 AS avg, round(stddev_pop(x), 5) + 0.0 AS std, round(quantile_cont(x, 0.5), 5) + 0.0 AS median, "
    "round(any_value(mo), 5) + 0.0 AS mode FROM r JOIN (SELECT dataset_id, dim, first(x ORDER BY f DESC, x) AS mo FROM h GROUP BY ALL) USING (dataset_id, dim) GROUP BY ALL",
)
def a6(spark, sf):
    out = P.vector_stats(X.cells(spark, sf, WORD_TYPES), word_vectors(spark, sf))
    return out.select("dataset_id", "dim", *[S.rnd(c, 5).alias(c) for c in ("avg", "std", "median", "mode")])


@query(
    "a7_column_embedding",
    f"WITH {X.cells_cte(WORD_TYPES)}, {WORDS_CTE} SELECT dataset_id, (generate_subscripts(e, 1) - 1)::INTEGER AS dim, round(unnest(e), 5) + 0.0 AS x, used_values FROM ("
    "SELECT dataset_id, list(x ORDER BY dim) AS e, max(u) AS used_values FROM (SELECT dataset_id, dim, sum(f * x) / sum(f) AS x, sum(f)::BIGINT AS u FROM pl GROUP BY ALL) GROUP BY 1)",
)
def a7(spark, sf):
    out = P.column_embedding(X.cells(spark, sf, WORD_TYPES), word_vectors(spark, sf))
    return out.select("dataset_id", "used_values", F.posexplode("embedding").alias("dim", "x")).withColumn("x", S.rnd("x", 5))
