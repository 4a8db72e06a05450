"""Spelling variants: words one edit apart, by dynamic programming over sorted word lists.

A near pair whose shorter word has m letters agrees in its first m // 2 letters or in its last m - m // 2. Words meet under these two keys, for m
their own length and one less. What the key leaves open (the middles) is sorted within each key; a list is scanned depth by depth: all words
with a common beginning share one banded row of the edit matrix for each query, the adjacent common prefixes tell where a beginning ends, and a
range whose row exceeds one edit is skipped with all its words. Keys with too many words are halved again, in the same way, until
they are small or only one letter is open, so that no task depends on how often a key occurs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletypes.plans.session import cut

RUN = re.compile("[a-zÀ-ÿ]+")
BETWEEN = re.compile("[^A-Za-zÀ-ÿ]")
SMALL = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
PIECE = 1 << 20  # characters of a text worked on at once
FLUSH = 400_000  # words a map task holds
GROUP = 20_000  # words of a key in one piece
BUCKET = 60_000  # words a task compares at a time, on average
QUERIES = 8192  # words that scan the lists at once


def _pieces(text: str) -> Iterator[str]:
    """Parts of a text that end where no run is cut."""
    a = 0
    while len(text) - a > PIECE:
        gap = BETWEEN.search(text, a + PIECE)
        if gap is None:
            break
        yield text[a : gap.start()]
        a = gap.start()
    yield text[a:]


def _counted(least_length: int, every: int | None):
    def table(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        crc = zlib.crc32
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                salt = crc(f"{'' if doc is None else doc}:".encode())
                for piece in _pieces(text):
                    for word, n in Counter(RUN.findall(piece.encode().translate(SMALL).decode())).items():
                        if every:
                            h = crc(word.encode(), salt)
                            if h % every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= FLUSH:
                    yield table(held)
                    held = Counter()
        yield table(held)

    return run


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z in lower case) of whole texts and how often they occur.

    With ``every``, a run whose CRC-32 h (of ``<id>:<run>``) it divides loses the letter h % length. Every row counts, repeats too; null texts have no runs,
    a null id counts as an empty one.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_counted(least_length, every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _node(lo: Column, hi: Column, m: Column) -> Column:
    """A key: the first lo letters, and the last m - hi, of a pair whose shorter word has m; the others are open."""
    left = F.substring(F.col("word"), F.lit(1), lo)
    right = F.when(m > hi, F.substring(F.col("word"), F.length("word") - (m - hi) + 1, m - hi)).otherwise("")
    return F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"), F.concat_ws(" ", m.cast("string"), lo.cast("string"), hi.cast("string"), left, right).alias("key"))


def _halved(rows: DataFrame) -> DataFrame:
    """The two halves of open stretches: agreement goes on to the middle, or begins there."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    nodes = F.array(_node(mid, F.col("hi"), F.col("m")), _node(F.col("lo"), mid, F.col("m")))
    return rows.select("word", "n", F.explode(nodes).alias("node")).select("word", "n", "node.*")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, where each begins, and their lengths."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words))
    return np.append(flat, np.uint32(0)), np.cumsum(length) - length, length


def _common(flat: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each word with the one before it; -1 at the first of a group."""
    out = np.zeros(len(start), np.int64)
    live = np.flatnonzero(group[1:] == group[:-1]) + 1
    fresh = np.ones(len(start), bool)
    fresh[live] = False
    d = 0
    while len(live):
        live = live[(length[live] > d) & (length[live - 1] > d)]
        live = live[flat[start[live] + d] == flat[start[live - 1] + d]]
        d += 1
        out[live] = d
    out[fresh] = -1
    return out


def near_in_lists(group: np.ndarray, middles: list[str], asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, other) of words of one group whose middles are exactly one edit apart.

    Words are sorted by group, then middle. ``asks`` marks the queries; the others of a pair are as long or one letter longer. A state is a query with a
    range of words that share their first d letters and the row of its edit matrix for these, of which only the three cells next to
    the diagonal can be one or less.
    """
    flat, start, length = _letters(middles)
    lcp = _common(flat, start, length, group)
    size = len(middles)
    first = np.flatnonzero(lcp < 0)
    group_at = np.searchsorted(first, np.arange(size), "right") - 1
    ends = np.append(first[1:], size)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    all_queries = np.flatnonzero(asks & ((ends - first)[group_at] > 1))
    for a in range(0, len(all_queries), QUERIES):
        q = all_queries[a : a + QUERIES]
        lo, hi = first[group_at[q]], ends[group_at[q]]
        before, here, after = np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        d = 0
        while len(q):
            heads = np.flatnonzero(lcp <= d)  # where beginnings of d + 1 letters start
            a_, b_ = np.searchsorted(heads, lo), np.searchsorted(heads, hi)
            many = b_ - a_
            back = np.repeat(np.arange(len(q)), many)
            at = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a_, many)
            child = heads[at]
            until = np.minimum(np.append(heads[1:], size)[at], hi[back])
            q, before, here, after = q[back], before[back], here[back], after[back]
            ended = length[child] == d
            rest = length[q] - d  # letters of the query beyond d
            distance = np.where(rest == 0, here, np.where(rest == -1, before, 2))
            hit = ended & (distance == 1)
            out.append((q[hit], child[hit]))
            go = ~ended
            q, lo, hi, rest = q[go], child[go], until[go], rest[go]
            before, here, after = before[go], here[go], after[go]
            letter = flat[start[lo] + d]

            def differs(j: np.ndarray, q: np.ndarray = q, letter: np.ndarray = letter) -> np.ndarray:
                inside = (j >= 0) & (j < length[q])
                return np.where(inside, flat[start[q] + np.where(inside, j, 0)] != letter, 2).astype(np.int8)

            one, j = np.int8(1), np.full(len(q), d)
            new_before = np.minimum(before + differs(j - 1), here + one)
            new_here = np.minimum(np.minimum(here + differs(j), after + one), new_before + one)
            new_after = np.minimum(after + differs(j + 1), new_here + one)
            new_here[rest < 1], new_after[rest < 2] = 2, 2
            keep = np.minimum(np.minimum(new_before, new_here), new_after) <= 1
            q, lo, hi = q[keep], lo[keep], hi[keep]
            before, here, after = new_before[keep], new_here[keep], new_after[keep]
            d += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _near(table: pa.Table) -> pa.Table:
    """Near pairs of a bucket, in both directions."""
    words = table.column("word").to_pylist()
    m, lo, hi = (table.column(c).to_numpy() for c in ("m", "lo", "hi"))
    middles = pa.array([w[a : len(w) - (k - b)] for w, k, a, b in zip(words, m.tolist(), lo.tolist(), hi.tolist(), strict=True)], pa.string())
    order = pc.sort_indices(pa.table({"key": table.column("key"), "middle": middles}), [("key", "ascending"), ("middle", "ascending")])
    table, middles, m, hi = table.take(order), middles.take(order).to_pylist(), m[order.to_numpy()], hi[order.to_numpy()]
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    group = pc.rank(table.column("key"), tiebreaker="dense").to_numpy()
    own = np.fromiter(map(len, words), np.int64, len(words))
    q, other = near_in_lists(group, middles, own == m)
    # a pair that agrees in the whole open stretch of a key belongs to the key after it
    once = np.fromiter((hi[x] == m[x] or not middles[y].startswith(middles[x]) for x, y in zip(q.tolist(), other.tolist(), strict=True)), bool, len(q))
    q, other = q[once], other[once]
    longer = own[other] > own[q]  # pairs of equal length are found from both sides
    a, b = np.concatenate([q, other[longer]]), np.concatenate([other, q[longer]])
    word = pa.array(words, pa.string())
    return pa.table({"word": word.take(pa.array(a)), "n": pa.array(n[a], pa.int64()), "other": word.take(pa.array(b)), "other_n": pa.array(n[b], pa.int64())})


def near_pairs(words: DataFrame, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(word, n, other, other_n) for all pairs of ``words`` (word, n; each word once) that differ by one inserted, deleted or replaced code point, in both directions."""
    length = F.length("word")
    both = F.array(length, length - 1)
    rows = words.where("length(word) > 0").select("word", "n", F.explode(both).alias("m")).where("m > 0").withColumn("lo", F.lit(0)).withColumn("hi", F.col("m"))
    rest = _halved(rows)
    parts = []
    while True:
        sizes = cut(rest.groupBy("key").agg(F.count("*").alias("size"), (F.first("hi") - F.first("lo")).alias("open")).where("size > 1"))
        fine = (F.col("size") <= group) | (F.col("open") < 2)
        parts.append(rest.join(sizes.where(fine).select("key"), "key"))
        large = sizes.where(~fine).select("key")
        if large.isEmpty():
            break
        rest = cut(_halved(rest.join(large, "key")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part.select(*found.columns))
    found = cut(found.select("key", "word", "n", "m", "lo", "hi"))
    buckets = max(1, -(-found.count() // bucket))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(lambda t: _near(t), "word string, n long, other string, other_n long")


def variants(words: DataFrame, factor: int = 5, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n; each word once).

    ``form`` is the near word of largest n (ties: the first in code-point order) if its n is ``factor`` times the word's or more, else null; ``root`` is where the
    forms lead to. Without words the result is empty. ``factor`` is at least 2, so that forms never lead back.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    words = cut(words)
    near = near_pairs(words, group, bucket).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    good = -F.col("best.n") >= F.lit(factor) * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n")
    )
    found = cut(found)
    paths = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken; n grows with every step, so there are few
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(paths.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        paths = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(paths, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, factor: int = 5, least_length: int = 6, least_count: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of ``docs`` (see ``word_counts``). Null, empty and repeated rows count as they stand; other columns are not read."""
    return variants(word_counts(docs, least_length, least_count, every, id_col, text_col), factor)
