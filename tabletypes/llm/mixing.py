"""Mixing by soft membership: domain posteriors from labels, then nonnegative document rates by projected Newton steps."""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletypes.plans.session import cut

from .quality import SPACES, SYMBOLS

log = logging.getLogger(__name__)
DOMAINS = ("clean", "low_quality", "toxic")
# Shares of the mixture's tokens; the total is set so that the first domain keeps all its tokens.
WEIGHTS = {"clean": 0.91, "low_quality": 0.07, "toxic": 0.02}
STEPS = 40  # a guard; more of them raise an error
CLOSE = 1e-3  # gap of a domain's total, as a share of its target
EASE = 1e-8  # weight of rates close to 1 against the squares of the gaps


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low_quality").when(quality == 1, "clean")


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens, f): words of the whole text and its features, all by built-in functions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "").alias("w"))
    n, size = F.size("w"), F.length("t")
    count = lambda letters: size - F.length(F.translate("t", letters, ""))
    upper = "".join(map(chr, range(65, 91)))
    per = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    values = [F.log1p(n), F.log1p(100 * per(F.size(F.array_distinct("w")), n)), F.log1p(100 * per(count(SYMBOLS), n)), F.log1p(100 * per(count("!?"), n)), F.log1p(100 * per(count(upper), n)), per(size, n + 1)]
    return rows.select("id", n.cast("long").alias("tokens"), F.array(*[v.cast("double") for v in values]).alias("f"))


def posteriors(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tokens, p): the probability of each domain by a Gaussian model of each feature, fitted on all labelled rows.

    A domain without labelled rows has probability 0; without any labels every domain is equally likely.
    """
    known = labels.select(F.col(id_col).alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL").groupBy("id").agg(F.max("domain").alias("domain"))
    n = 6
    moments = [x for i in range(n) for x in (F.avg(F.get("f", F.lit(i))).alias(f"m{i}"), F.var_pop(F.get("f", F.lit(i))).alias(f"v{i}"))]
    fitted = {r.domain: r for r in rows.join(known, "id").groupBy("domain").agg(F.count("*").alias("n"), *moments).collect()}  # one row per domain
    total = sum(r.n for r in fitted.values())
    logs = []
    for d in DOMAINS:
        r = fitted.get(d)
        if not total:
            logs.append(F.lit(0.0))
        elif r is None:
            logs.append(F.lit(-1e9))
        else:
            log = F.lit(math.log(r.n / total))
            for i in range(n):
                v = r[f"v{i}"] + 0.05
                log = log - F.pow(F.get("f", F.lit(i)) - r[f"m{i}"], F.lit(2)) / (2 * v) - 0.5 * math.log(v)
            logs.append(log)
    scored = rows.select("id", "tokens", F.array(*logs).alias("l")).withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("whole", whole).select("id", "tokens", F.transform("e", lambda x: x / F.col("whole")).alias("p"))


def rates(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``rows`` (id, tokens, p) with ``rate``: nonnegative, and the expected domain totals sum(rate * tokens * p) at the targets.

    Of the rates with the least squares of the totals' gaps, each domain scaled by its own tokens, those closest to 1 by tokens. They are
    max(0, 1 - p * x) with a number x per domain, found by Newton steps with the matrix sum(tokens * p_i * p_j) of the rates above 0; a step is one
    sum over the table for each length tried. Targets out of reach are named in a warning; steps that do not end raise an error.
    """
    k = range(len(DOMAINS))
    first = rows.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in k]).first()
    own = [x or 0.0 for x in first]
    share = [max(0.0, weights.get(d, 0.0)) for d in DOMAINS]
    total = own[0] / share[0] if share[0] and own[0] else sum(own)
    want = [total * s / (sum(share) or 1) for s in share]
    scale = np.maximum(own, 1e-3 * (sum(own) or 1)) * EASE
    target = np.array(want)
    close = CLOSE * np.where(target > 0, target, sum(want) or 1)

    def rate(x: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - sum((F.get("p", F.lit(i)) * float(x[i]) for i in k), F.lit(0.0)))

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The convex function whose least value is sought, its slope and bend, and the gaps of the totals."""
        p, r, n = [F.get("p", F.lit(i)) for i in k], F.col("r"), F.col("tokens")
        sums = [F.sum(n * r * r), *[F.sum(n * r * p[i]) for i in k], *[F.sum(F.when(r > 0, n * p[i] * p[j]).otherwise(0.0)) for i in k for j in k]]
        s = np.array([float(v or 0.0) for v in rows.select("tokens", "p", rate(x).alias("r")).agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()])
        gaps = s[1 : 1 + len(k)] - target
        return float(s[0] / 2 + x @ target + (scale * x * x).sum() / 2), scale * x - gaps, s[1 + len(k) :].reshape(len(k), len(k)) + np.diag(scale), gaps

    x = np.zeros(len(k))
    value, slope, bend, gaps = at(x)
    for _ in range(STEPS):
        if (np.abs(gaps) <= close).all() or not any(own):
            break
        if (np.abs(slope) <= close / 10).all():  # the least squares; no rates come closer
            log.warning("mixing: targets out of reach, totals over targets: %s", {d: (float(g + t), float(t)) for d, g, t in zip(DOMAINS, gaps, target, strict=True)})
            break
        step, part = -np.linalg.solve(bend, slope), 1.0
        new = at(x + step)
        while new[0] > value + 1e-4 * part * float(slope @ step) + 1e-12 * abs(value) and part > 1e-6:
            part /= 4
            new = at(x + part * step)
        x = x + part * step
        value, slope, bend, gaps = new
    else:
        if (np.abs(gaps) > close).any() and (np.abs(slope) > close / 10).any():
            raise RuntimeError(f"mixing: no rates after {STEPS} steps, gaps {gaps.tolist()} of targets {want}")
    return rows.withColumn("rate", rate(x))


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """One row per document: tokens, the posterior of each domain, its rate, and copies (the rate rounded up or down at random, by id).

    A null text has no tokens and its rate does not count. Rows without an id get a rate and one copy at rates from 0.5. Repeated rows are documents of
    their own. Labels of unknown documents, null labels and extra columns are ignored; without labels all rates stay proportional.
    """
    rows = cut(features(docs, id_col, text_col))
    rows = cut(posteriors(rows, labels, id_col))
    mixed = rates(rows, weights)
    draw = F.coalesce(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30), F.lit(0.5))
    copies = F.when(F.col("id").isNull(), F.floor(F.col("rate") + 0.5)).otherwise(F.floor(F.col("rate") + draw)).cast("int")
    return mixed.select(F.col("id").alias(id_col), "tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies.alias("copies"))
