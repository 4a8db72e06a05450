"""Models on table corpora: topics and their clusters, header vectors, column classifiers and the weight of their features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import scalars as S
from ..functions import vectors as V
from ..plans.ordered import position, top
from ..plans.session import cut
from .metrics import classification_report


def table_terms(cells: DataFrame, longest: int, stop: list[str], numbers_as_type: bool = True) -> DataFrame:
    """Bag of words of every table in long form (table_id, term, tf)."""
    v = S.number_token("value", numbers_as_type)
    freq = cells.where(F.col("value").isNotNull()).groupBy("table_id", v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return freq.select("table_id", "c", F.explode(S.marked_tokens("v", longest, stop)).alias("term")).groupBy("table_id", "term").agg(F.sum("c").alias("tf"))


def number_terms(terms: DataFrame) -> DataFrame:
    """(term, i): all terms numbered from 0, those of most tables first. Large vocabularies are numbered in range partitions."""
    df = terms.groupBy("term").agg((-F.count(F.lit(1))).alias("neg"))
    return position(df, [], ["neg", "term"], "at").select("term", (F.col("at") - 1).cast("int").alias("i"))


def count_vectors(terms: DataFrame) -> DataFrame:
    """(table_id, features): sparse count vector of each table over the whole vocabulary of ``terms(table_id, term, tf)``.

    The rows are written in the storage form of vectors and read back as such, so no row passes through Python.
    """
    numbered = cut(number_terms(terms))
    size = numbered.count()
    pairs = F.array_sort(F.collect_list(F.struct("i", F.col("tf").cast("double").alias("tf"))))  # the distinct terms of one table
    packed = terms.join(numbered, "term").groupBy("table_id").agg(pairs.alias("p"))
    stored = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("p.i").alias("indices"), F.col("p.tf").alias("values"))
    kind = packed.schema["table_id"].dataType
    return cut(packed.select("table_id", stored.alias("features")), StructType([StructField("table_id", kind), StructField("features", VectorUDT())]))


def psi(x, order: int = 0):
    """Digamma, or trigamma for ``order`` 1, of positive numbers: by recurrence up to 8, then by the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        out += np.where(low, -1 / x if order == 0 else 1 / x**2, 0.0)
        x = x + low
    y = 1 / x**2
    if order:
        return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return out + np.log(x) - 1 / (2 * x) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _uniform(*cols: Column) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 1) / float(1 << 52)


def _first_weights(k: int, seed: int) -> Column:
    """Near-gamma weights with shape 100 and mean 1 of term ``i`` in ``k`` topics, by a cube of a normal draw."""

    def draw(topic: Column) -> Column:
        z = F.sqrt(-2 * F.log(_uniform("i", topic, F.lit(seed), F.lit(1)))) * F.cos(2 * np.pi * _uniform("i", topic, F.lit(seed), F.lit(2)))
        return F.pow(F.lit(1 - 1 / 900) + z / 30, F.lit(3.0))

    return F.transform(F.sequence(F.lit(1), F.lit(k)), draw)


def _inferred(pairs: DataFrame, weights: DataFrame, totals: np.ndarray, alpha: np.ndarray, stats: bool) -> DataFrame:
    """(table_id, i, s): per table its topic weights (``i`` null) and, with ``stats``, the expected counts of its terms in the topics."""
    k = len(alpha)

    def infer(table: pa.Table) -> pa.Table:
        tf = table.column("tf").to_numpy().astype(float)
        beta = np.exp(psi(table.column("w").combine_chunks().flatten().to_numpy().reshape(-1, k)) - psi(totals))
        gamma = np.ones(k)
        for _ in range(100):
            theta = np.exp(psi(gamma) - psi(gamma.sum()))
            ratio = tf / (beta @ theta + 1e-100)
            last, gamma = gamma, theta * (ratio @ beta) + alpha
            if np.abs(gamma - last).mean() < 1e-3:
                break
        numbers, rows = [None], [gamma]
        if stats:
            theta = np.exp(psi(gamma) - psi(gamma.sum()))
            numbers += table.column("i").to_pylist()
            rows.append((beta * theta * (tf / (beta @ theta + 1e-100))[:, None]).ravel())
        lists = pa.ListArray.from_arrays(np.arange(0, k * len(numbers) + 1, k, dtype=np.int32), np.concatenate(rows))
        first = table.column("table_id")[0]
        return pa.table({"table_id": pa.array([first.as_py()] * len(numbers), first.type), "i": pa.array(numbers, pa.int32()), "s": lists})

    kind = pairs.schema["table_id"].dataType.simpleString()
    return pairs.join(weights, "i").groupBy("table_id").applyInArrow(infer, f"table_id {kind}, i int, s array<double>")


def topic_model(terms: DataFrame, k: int, iterations: int = 10, seed: int = 1, share: float = 0.05):
    """Online variational LDA over the tables; (model, topics): ``model(i, w)`` holds the weights of every term in the topics, ``topics(table_id, topic)`` the shares.

    Each round takes a ``share`` of the tables, infers their topics and moves the weights of all terms towards the expected counts. The weights are a table that is
    rewritten in each round; the driver holds sums per topic and the prior of the topics. A table is inferred in one task, which holds its different terms.
    """
    numbered = cut(number_terms(terms))
    pairs = cut(terms.join(numbered, "term").select("table_id", "i", "tf"))
    tables = pairs.select("table_id").distinct().count()
    weights = cut(numbered.select("i", _first_weights(k, seed).alias("w")))
    alpha, eta = np.full(k, 1 / k), 1 / k

    def totals() -> np.ndarray:
        return np.array([x or 1.0 for x in weights.agg(*[F.sum(F.col("w")[j]) for j in range(k)]).first()])

    for step in range(1, iterations + 1):
        drawn = pairs.where(_uniform("table_id", F.lit(seed), F.lit(step)) <= share)
        found = cut(_inferred(drawn, weights, totals(), alpha, True))
        logs = found.where("i IS NULL").select("s").mapInArrow(_expected_logs(k), "s array<double>").agg(F.count(F.lit(1)), *[F.avg(F.col("s")[j]) for j in range(k)]).first()
        if not logs[0]:
            continue
        rate = (1024 + step) ** -0.51
        counts = found.where("i IS NOT NULL").groupBy("i").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(k)]).alias("s"))
        seen = F.coalesce("s", F.array(*[F.lit(0.0)] * k))
        moved = F.zip_with("w", seen, lambda w, c: (1 - rate) * w + rate * (c * (tables / logs[0]) + eta))
        weights = cut(weights.join(counts, "i", "left").select("i", moved.alias("w")))
        alpha = _moved_prior(alpha, np.array(logs[1:]), rate)
    shares = F.transform("s", lambda x: x / F.aggregate("s", F.lit(0.0), lambda a, b: a + b))
    return weights, cut(_inferred(pairs, weights, totals(), alpha, False)).select("table_id", shares.alias("topic"))


def _expected_logs(k: int):
    def run(batches):
        for batch in batches:
            gamma = batch.column("s").flatten().to_numpy().reshape(-1, k)
            logs = psi(gamma) - psi(gamma.sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(logs), pa.list_(pa.float64()))], names=["s"])

    return run


def _moved_prior(alpha: np.ndarray, logs: np.ndarray, rate: float) -> np.ndarray:
    """A Newton step of the Dirichlet prior towards the mean expected logarithms of the topic shares; the old prior if it would leave the positive numbers."""
    slope = logs - (psi(alpha) - psi(alpha.sum()))
    curve, common = -psi(alpha, 1), psi(alpha.sum(), 1)
    shift = (slope / curve).sum() / (1 / common + (1 / curve).sum())
    moved = alpha - rate * (slope - shift) / curve
    return moved if (moved > 0).all() else alpha


def topic_clusters(topics: DataFrame, k: int = 20, seed: int = 1) -> DataFrame:
    data = topics.withColumn("features", array_to_vector("topic"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("table_id", F.col("prediction").cast("long").alias("cluster"))


def train_column_classifier(matrix: DataFrame, labels: DataFrame, iterations: int = 20):
    """Classifier of semantic types on the dense feature arrays; ``labels(dataset_id, label)``."""
    data = matrix.join(labels, "dataset_id").withColumn("raw", array_to_vector("features"))
    stages = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(data)


def predict_types(model, matrix: DataFrame) -> DataFrame:
    """The columns of ``matrix`` but the features, with ``pred``."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    data = matrix.withColumn("raw", array_to_vector("features"))
    scored = model.stages[2].transform(model.stages[1].transform(data))
    return scored.select(*[c for c in matrix.columns if c != "features"], F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred"))


WALKS = 200  # a number outside the range walks on; three quarters do at most, so none is left after these


def shuffled_number(number: Column, seed: Column, size: int) -> Column:
    """A seeded bijection of 0 .. ``size`` - 1: a Feistel network on the next power of four, walked until it is back in the range."""
    half = 1
    while 4**half < size:
        half += 1
    base = 2**half

    def network(x: Column) -> Column:
        left, right = F.floor(x / base), x % base
        for i in range(4):
            left, right = right, (left + F.pmod(F.xxhash64(right, seed, F.lit(i)), F.lit(base))) % base
        return left * base + right

    first = network(number)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < size, x).otherwise(network(x)))


def permute_groups(matrix: DataFrame, groups: dict[str, list[int]], seeds: list[int], fill: float = 0.0) -> DataFrame:
    """(grp, seed, dataset_id, features) for each feature group and seed: the group's features come from the same column of another table.

    ``matrix(dataset_id, table_id, col_idx, features)``. Tables are numbered once; the other table of a seed is a bijection of the numbers. A table without that column
    gives ``fill``.
    """
    tables = cut(position(matrix.select("table_id").distinct(), [], ["table_id"], "at").withColumn("at", F.col("at") - 1))
    size = tables.count()
    drawn = tables.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    drawn = drawn.withColumn("to", shuffled_number(F.col("at"), F.col("seed"), size)).select("table_id", "seed", "to")
    other = drawn.join(tables.withColumnRenamed("table_id", "other"), F.col("to") == F.col("at")).select("table_id", "seed", "other")
    theirs = matrix.select(F.col("table_id").alias("other"), "col_idx", F.col("features").alias("theirs"))
    both = matrix.join(other, "table_id").join(theirs, ["other", "col_idx"], "left")
    named = F.array(*[F.struct(F.lit(g).alias("grp"), F.array(*[F.lit(p) for p in at]).alias("places")) for g, at in groups.items()])
    each = both.select("dataset_id", "seed", "features", "theirs", F.inline(named))
    mixed = F.transform("features", lambda x, i: F.when(F.array_contains("places", i), F.coalesce(F.element_at("theirs", i + 1), F.lit(fill))).otherwise(x))
    return each.select("grp", "seed", "dataset_id", mixed.alias("features"))


def permutation_importance(model, matrix: DataFrame, gold: DataFrame, groups: dict[str, list[int]], seeds: list[int]) -> DataFrame:
    """(grp, seed, metric, loss_pct): relative loss of F1 in percent, macro and weighted, after exchanging a feature group between tables.

    ``matrix(dataset_id, table_id, col_idx, features)`` holds the columns of held-out tables. All runs are scored in one frame.
    """
    truth = gold.select("dataset_id", F.col("semantic_type").alias("truth"))
    plain = matrix.select(F.lit("").alias("grp"), F.lit(0).alias("seed"), "dataset_id", "features")
    runs = predict_types(model, plain.unionByName(permute_groups(matrix, groups, seeds))).join(truth, "dataset_id")
    f1 = cut(classification_report(runs, True, ("grp", "seed")).where("cls in ('macro avg', 'weighted avg')").select("grp", "seed", F.col("cls").alias("metric"), "f1"))
    base = f1.where("grp = ''").select("metric", F.col("f1").alias("base"))
    return f1.where("grp <> ''").join(base, "metric").select("grp", "seed", "metric", (100 * (F.col("base") - F.col("f1")) / F.col("base")).alias("loss_pct"))


# --- many small fits in one job ---------------------------------------------------------------------

FIT_ROWS = 20_000  # training columns of a fit, those of the least digest


def training_sets(labeled: DataFrame, generated: DataFrame) -> DataFrame:
    """(run_id, variant, dataset_id, label): what each set-up trains on.

    ``labeled(run_id, dataset_id, semantic_type)``; ``generated(run_id, dataset_id, label)``, which may also cover labeled columns. Variants: ``labeled`` alone; ``overwrite``, where a generated
    label replaces a known one; ``keep_gold``, where it does not.
    """
    gold = labeled.select("run_id", "dataset_id", F.col("semantic_type").alias("gold"))
    both = gold.join(generated.select("run_id", "dataset_id", "label"), ["run_id", "dataset_id"], "full")
    kinds = {"labeled": F.col("gold"), "overwrite": F.coalesce("label", "gold"), "keep_gold": F.coalesce("gold", "label")}
    each = F.array(*[F.struct(F.lit(v).alias("variant"), c.alias("label")) for v, c in kinds.items()])
    return both.withColumn("each", each).select("run_id", "dataset_id", F.inline("each")).where("label IS NOT NULL").select("run_id", "variant", "dataset_id", "label")


def _fit(rate: float, steps: int):
    """Softmax regression on standardised features, by accelerated gradient steps from zero."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("dataset_id")
        names, y = np.unique(rows.column("label").to_pylist(), return_inverse=True)
        x = np.array(rows.column("features").to_pylist(), float)
        mean, std = x.mean(axis=0), x.std(axis=0)
        std[std == 0] = 1
        z = np.c_[(x - mean) / std, np.ones(len(x))]
        target = np.eye(len(names))[y]
        bound = 0.5 * np.linalg.norm(z, 2) ** 2 / len(z) + rate
        w = ahead = np.zeros((z.shape[1], len(names)))
        for t in range(steps):
            s = z @ ahead
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            new = ahead - (z.T @ (p - target) / len(z) + rate * ahead) / bound
            w, ahead = new, new + t / (t + 3) * (new - w)
        weights = w[:-1] / std[:, None]
        bias = w[-1] - mean @ weights
        n = len(names)
        return pa.table({
            "run_id": pa.array(rows.column("run_id").to_pylist()[:1] * n, pa.int32()), "variant": pa.array(rows.column("variant").to_pylist()[:1] * n, pa.string()),
            "pred": pa.array(names.tolist(), pa.string()), "weights": pa.array(weights.T.tolist(), pa.list_(pa.float64())), "bias": pa.array(bias.tolist(), pa.float64()),
        })

    return run


def fit_grid(sets: DataFrame, matrix: DataFrame, rate: float = 0.01, steps: int = 200, rows: int = FIT_ROWS) -> DataFrame:
    """(run_id, variant, pred, weights, bias): a classifier for each (run_id, variant) of ``training_sets``, fitted in one job, each on ``rows`` columns at most."""
    data = sets.join(matrix.select("dataset_id", "features"), "dataset_id").withColumn("__o", F.md5("dataset_id"))
    kept = top(data, ["run_id", "variant"], [F.col("__o"), F.col("dataset_id")], rows, "__r").drop("__o", "__r")
    shape = "run_id int, variant string, pred string, weights array<double>, bias double"
    return kept.withColumn("run_id", F.col("run_id").cast("int")).groupBy("run_id", "variant").applyInArrow(lambda t: _fit(rate, steps)(t), shape)


def predict_grid(models: DataFrame, columns: DataFrame, matrix: DataFrame) -> DataFrame:
    """(run_id, variant, dataset_id, pred) for ``columns(run_id, dataset_id)`` by the models of their run; ties go to the first name."""
    data = columns.select(F.col("run_id").cast("int"), "dataset_id").join(matrix.select("dataset_id", "features"), "dataset_id")
    scored = data.join(models, "run_id").withColumn("score", F.round(V.dot("features", "weights") + F.col("bias"), 9))
    best = scored.groupBy("run_id", "variant", "dataset_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "pred")).alias("m"))
    return best.select("run_id", "variant", "dataset_id", "m.pred")


# --- vectors of headers -----------------------------------------------------------------------------


def header_pairs(headers: DataFrame) -> DataFrame:
    """(h1, h2, n): in how many tables two different headers stand together; ``headers(table_id, header)``. Tables of the same headers are one class."""
    packed = headers.groupBy("table_id").agg(F.array_sort(F.collect_set("header")).alias("hs"))  # the headers of one table
    classes = packed.groupBy("hs").agg(F.count(F.lit(1)).alias("n"))
    a = classes.select("hs", "n", F.explode("hs").alias("h1"))
    return a.select("h1", F.explode("hs").alias("h2"), "n").where("h1 <> h2").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def shifted_information(pairs: DataFrame, shift: float = 1.0) -> DataFrame:
    """(h1, h2, w): the positive pointwise mutual information of the pairs less ln ``shift``; pairs without any drop out."""
    one = pairs.groupBy("h1").agg(F.sum("n").alias("n1"))
    total = pairs.agg(F.sum("n").alias("total"))
    w = F.log(F.col("n") * F.col("total") / (F.col("n1") * F.col("n2") * F.lit(shift)))
    joined = pairs.join(one, "h1").join(one.select(F.col("h1").alias("h2"), F.col("n1").alias("n2")), "h2").crossJoin(F.broadcast(total))  # one row
    return joined.select("h1", "h2", w.alias("w")).where("w > 0")


def _gram(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the outer products of ``v``: ``size`` by ``size`` numbers."""
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(i, size)])
    sums = rows.select("v", F.inline(places)).groupBy("i", "j").agg(F.sum(F.col("v")[F.col("i")] * F.col("v")[F.col("j")]).alias("s")).collect()
    g = np.zeros((size, size))
    for r in sums:
        g[r.i, r.j] = g[r.j, r.i] = r.s
    return g


def _turned(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """Each ``v`` times the small matrix ``m``."""
    columns = [F.array(*[F.lit(float(x)) for x in m[:, j]]) for j in range(m.shape[1])]
    return rows.select("h", F.array(*[V.dot("v", c) for c in columns]).alias("v"))


def header_vectors(weights: DataFrame, size: int = 16, rounds: int = 4, seed: int = 1) -> DataFrame:
    """(h, v): vectors of headers whose products are close to the symmetric sparse ``weights(h1, h2, w)``.

    Randomised block power iteration: seeded random rows, then in each round the sparse matrix is applied by a join and a sum, and the block is made
    orthogonal by its Gram matrix. Only matrices of ``size`` by ``size`` reach the driver.
    """
    weights = cut(weights)
    names = weights.select(F.col("h1").alias("h")).distinct()
    size = min(size, names.count())
    if not size:
        return names.withColumn("v", F.array().cast("array<double>"))
    digits = lambda i, at: (F.conv(F.substring(S.seeded_order(seed, "h", F.lit(i)), at, 10), 16, 10).cast("double") + 1) / float(16**10)
    normal = [F.sqrt(-2 * F.log(digits(i, 1))) * F.cos(2 * np.pi * digits(i, 11)) for i in range(size)]
    block = names.select("h", F.array(*normal).alias("v"))

    def applied(rows: DataFrame) -> DataFrame:
        parts = weights.join(rows.withColumnRenamed("h", "h2"), "h2")
        return cut(parts.groupBy(F.col("h1").alias("h")).agg(F.array(*[F.sum(F.col("w") * F.col("v")[i]) for i in range(size)]).alias("v")))

    for _ in range(rounds):
        block = applied(block)
        values, turn = np.linalg.eigh(_gram(block, size))
        keep = values > 1e-12 * values.max()
        size = int(keep.sum())
        block = cut(_turned(block, turn[:, keep] / np.sqrt(values[keep])))
    image = applied(block).withColumnRenamed("v", "mv")
    both = block.join(image, "h").select(F.concat("v", "mv").alias("v"))
    inner = _gram(both, 2 * size)[:size, size:]
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return _turned(block, turn * np.sqrt(np.abs(values)))


def nearest_headers(vectors: DataFrame, seeds: DataFrame, n: int, block: int = 1000) -> DataFrame:
    """(seed, header, sim, rank): the ``n`` headers most like each ``seeds(seed)`` by cosine. Seeds meet blocks of headers."""
    units = vectors.where(V.norm("v") > 0).select("h", V.unit("v").alias("v"))
    units = cut(units)
    blocks = max(1, -(-units.count() // block))
    asked = seeds.select("seed").distinct().join(units.select(F.col("h").alias("seed"), F.col("v").alias("sv")), "seed")
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = asked.join(units.withColumn("b", F.pmod(F.xxhash64("h"), F.lit(blocks))), "b").where("h <> seed")
    scored = met.select("seed", F.col("h").alias("header"), F.round(V.dot("sv", "v"), 9).alias("sim"))
    return top(scored, ["seed"], [F.desc("sim"), F.col("header")], n)


def header_retrieval(vectors: DataFrame, headers: DataFrame, n: int = 1000) -> DataFrame:
    """(query_id, rank, rel): for each table of more than one header the nearest headers of its first, relevant where the table has them.

    ``headers(table_id, col_idx, header)``. Tables whose first header has no vector get one irrelevant row, so that they count with 0.
    """
    packed = headers.groupBy("table_id").agg(F.min(F.struct("col_idx", "header")).alias("f"), F.collect_set("header").alias("hs")).where(F.size("hs") > 1)
    tables = packed.select(F.col("table_id").alias("query_id"), F.col("f.header").alias("seed"), "hs")
    near = nearest_headers(vectors, tables, n)
    found = tables.join(near, "seed", "left")
    rel = F.coalesce(F.array_contains("hs", F.col("header")), F.lit(False)).cast("int")
    return found.select("query_id", F.coalesce("rank", F.lit(1)).alias("rank"), rel.alias("rel"))
