"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Tokens that may be disguised (digits or symbols for letters, letters
drawn out, letters set apart) become lattices of readings, and Viterbi decoding under the model picks one. The words of the plain and
the restored text are scored with evidence learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import column_bytes, row_slices

# Letters that a digit or symbol is used for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
READ = frozenset(READINGS)
LABELLED = 50_000  # labelled rows used for fitting, chosen by a hash of the id
TERMS = 4096  # words with evidence
CALIBRATION = 5  # one labelled row of so many also sets the scale of the scores
RATIO = 60  # least ratio of a word's share of toxic rows to its share of others
LONGEST = 48  # longer tokens are restored anew each time
KEPT = 200_000  # restored tokens kept by a task
_SWAP, _SKIP, _BREAK = 1.0, 0.7, 3.0  # costs of a substituted letter, a dropped repeat and a word border between spaced letters

TOKEN = re.compile(r"[^\s.,;:?\"()\[\]{}]+")
LETTERS = re.compile(r"[^\W\d_]+")
DRAWN = re.compile(r"([^\W\d_])\1\1+")
SPACED = re.compile(r"(?<!\S)[^\W_](?:(?: {1,3}|[.\-_*])[^\W_]|(?: {1,3}|[.\-_*])[@$!|+])+(?![^\s.,;:!?])")
EDGES = "*#%&$!|+-_'\"~<>="


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams (27 x 27 x 27; 0 stands for any other character) over all texts; a bounded table however many texts there are."""
    table = np.zeros(256, np.int64)
    for i in range(26):
        table[65 + i] = table[97 + i] = i + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            offsets, data = column_bytes(batch.column(0))
            for a, b in row_slices(offsets, 1 << 20):
                c = table[data[offsets[a] : offsets[b]]]
                if len(c):
                    c = np.concatenate([[0], c, [0]])
                    total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(27**3)
    for r in sums.collect():  # at most 27^3 rows
        counts[r.at] = r.n
    return counts.reshape(27, 27, 27)


def _spelled(letters: tuple) -> str:
    """The text of letters linked from the last to the first."""
    out = []
    while letters:
        letters, x = letters
        out.append(x)
    return "".join(reversed(out))


class Decoder:
    """Restores disguised words under a character model."""

    def __init__(self, counts: np.ndarray) -> None:
        pairs = counts.sum(axis=2, keepdims=True)
        singles = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + 27)
        self.cost = (-np.log((counts + 2 * singles) / (pairs + 2))).tolist()
        self.known: dict[tuple[str, bool], tuple[str, ...]] = {}

    def words(self, token: str, spaced: bool = False) -> tuple[str, ...]:
        """The words of the best reading; ``spaced``: letters set apart, so word borders are open."""
        token = DRAWN.sub(r"\1\1", token)  # no word has a letter three times in a row
        if len(token) > LONGEST:
            return tuple(LETTERS.findall(self._decode(token, spaced)))
        key = (token, spaced)
        out = self.known.get(key)
        if out is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            out = self.known[key] = tuple(LETTERS.findall(self._decode(token, spaced)))
        return out

    def _decode(self, token: str, spaced: bool) -> str:
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # of each state its cost and its letters, last first, as linked pairs
        cost, before = self.cost, ""
        for c in token:
            if spaced and c in " .-_*":
                continue
            letter = "a" <= c <= "z"
            options = [(c, 0.0)] if letter else [(x, _SWAP) for x in READINGS.get(c, "")] or [(c, 0.0)]
            found: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (so_far, text) in best.items():
                if letter and c == before:
                    x = so_far + _SKIP
                    if (a, b) not in found or x < found[a, b][0]:
                        found[a, b] = (x, text)
                for x, extra in options:
                    k = ord(x) - 96 if "a" <= x <= "z" else 0
                    total = so_far + extra + cost[a][b][k]
                    if (b, k) not in found or total < found[b, k][0]:
                        found[b, k] = (total, (text, x))
                    if spaced and b:
                        total = so_far + extra + _BREAK + cost[a][b][0] + cost[b][0][k]
                        if (0, k) not in found or total < found[0, k][0]:
                            found[0, k] = (total, (text, " " + x))
            best, before = found, c
        ends = [(total + cost[a][b][0], text) for (a, b), (total, text) in best.items()]
        least = min(total for total, _ in ends)
        return min(_spelled(text) for total, text in ends if total == least)

    def features(self, text: str) -> set[str]:
        """The distinct words of a text, as written and as restored."""
        text = text.lower()
        out: set[str] = set()
        for token in set(TOKEN.findall(text)):
            core = token if token.isalpha() else token.strip(EDGES)
            if core.isalpha():
                out.add(core)
                if DRAWN.search(core):
                    out.update(self.words(core))
            else:
                plain = LETTERS.findall(core)
                out.update(plain)
                if plain:
                    out.update(self.words(core))
                    if core != token:
                        out.update(self.words(token))
            for part in {token, token.strip("!"), token.lstrip(EDGES), token.rstrip(EDGES), core}:  # signs at an edge are letters or punctuation
                if not READ.isdisjoint(part):
                    out.update(self.words(part))
        for m in SPACED.finditer(text):
            if len(m[0]) >= 5:
                out.update(self.words(m[0], spaced=True))
        return out


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def _term_counts(decoder: Decoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in decoder.features(text or ""):
                    seen.setdefault(word, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["word", "bad", "good"])

    return run


def _evidence(decoder: Decoder, weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [round(evidence(decoder, weights, text), 2) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(1)], names=["evidence", "toxic"])

    return run


def evidence(decoder: Decoder, weights: dict[str, float], text: str | None) -> float:
    """The sum of the weights of a text's distinct words."""
    return sum(sorted(weights[w] for w in decoder.features(text or "") & weights.keys()))


def calibrated(bias: float, x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(bias, scale) of the logistic curve over evidence ``x`` seen ``n`` times with label ``toxic``; few rows leave it near (bias, 1).

    Newton steps on the log loss with a unit Gaussian prior around (bias, 1).
    """
    prior = now = np.array([bias, 1.0])
    basis = np.stack([np.ones(len(x)), x], axis=1)

    def loss(at: np.ndarray) -> float:
        z = basis @ at
        return float((n * (np.logaddexp(0, z) - toxic * z)).sum() + ((at - prior) ** 2).sum() / 2)

    for _ in range(50):
        share = 1 / (1 + np.exp(-np.clip(basis @ now, -500, 500)))
        slope = basis.T @ (n * (share - toxic)) + now - prior
        bend = (basis * (n * share * (1 - share))[:, None]).T @ basis + np.eye(2)
        step, part = np.linalg.solve(bend, slope), 1.0
        while part > 1e-6 and loss(now - part * step) > loss(now):
            part /= 2
        now = now - part * step
        if np.abs(part * step).max() < 1e-9:
            break
    return (float(now[0]), float(now[1])) if now[1] > 0 else (bias, 1.0)


def fit(docs: DataFrame, labels: DataFrame, decoder: Decoder, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, float, dict[str, float]]:
    """(bias, scale, evidence of words) from labelled rows outside the held-out fold.

    Words count that are at least sixty times as frequent in toxic rows, beyond chance (lower ratios mark languages and copied texts rather than
    toxicity). A fifth of the rows, chosen by their ids, then sets bias and scale: a lone word met by chance is no proof. A word with evidence
    stands in several rows, so it hardly matters that these rows are among those that the words come from.
    """
    id_ = F.col(id_col)
    known = labels.select(id_.cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    known = known.withColumn("sets_scale", F.pmod(F.xxhash64(F.lit("scale"), "id"), F.lit(CALIBRATION)) == 0)
    rows = docs.select(id_.cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("text", "toxic", "sets_scale")  # bounded by LABELLED
    numbers = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = numbers.get(1, 0), numbers.get(0, 0)
    bias = math.log((bad + 0.5) / (good + 0.5))
    if not bad or not good:
        return bias, 1.0, {}
    counts = rows.select("text", "toxic").mapInArrow(_term_counts(decoder), "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share_bad, share_good = (F.col("bad") + 0.5) / (bad + 1.0), (F.col("good") + 0.5) / (good + 1.0)
    even = (F.col("bad") + F.col("good") + 1.0) / (bad + good + 2.0)
    chance = 2 * ((F.col("bad") + 0.5) * F.log(share_bad / even) + (F.col("good") + 0.5) * F.log(share_good / even))
    strong = counts.select("word", F.log(share_bad / share_good).alias("weight"), chance.alias("beyond")).where((F.col("weight") > math.log(RATIO)) & (F.col("beyond") > 30))
    weights = {r.word: r.weight for r in strong.orderBy(F.desc("beyond"), "word").limit(TERMS).collect()}
    seen = rows.where("sets_scale").select("text", "toxic").mapInArrow(_evidence(decoder, weights), "evidence double, toxic int")
    seen = seen.groupBy("evidence", "toxic").agg(F.count("*").alias("n")).orderBy("evidence", "toxic").collect()  # bounded by LABELLED
    x, toxic, n = (np.array([float(r[i]) for r in seen]) for i in range(3))
    return *calibrated(bias, x, toxic, n), weights


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Callable[[str | None], float]:
    """The score of a text, from counts over all of ``docs`` and the labelled rows."""
    decoder = Decoder(character_counts(docs, text_col))
    bias, scale, weights = fit(docs, labels, decoder, id_col, text_col)

    def score(text: str | None) -> float:
        total = bias + scale * evidence(decoder, weights, text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Scores depend on the text alone; a null or empty text gets the score of a text without evidence. held_out is false for rows without an id.
    Labels with nulls or for unknown documents are ignored; without labels of both classes all scores are the share of toxic labels.
    Repeated rows get equal scores. Other columns are not read.
    """
    score = scorer(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    score = scorer(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
