"""Alignment of the tokens of two tokenizers: a byte-level BPE (A, by tokenizers) and a BPE with byte fallback (B, by sentencepiece).

Both libraries tell where their tokens lie. These spans are the coarse cuts; where tokens share a character (A's parts of a multibyte character,
B's byte fallback) their decoded bytes tell how far each goes. Offsets where tokens of both end cut a text into groups, and the tokens that
end there are linked.

No token of either vocabulary reaches over a single blank between two other characters, so a text is a row of units that begin with one, and each is encoded
by itself. A task keeps the alignments of the units it has seen, so a frequent word is encoded once.

Links are counted over the corpus in two steps: each map task sums its documents' pairs, then the sums meet by pair. Pairs with a ``HEAVY``-th
of all links or more, of which there cannot be more than ``HEAVY``, are sent to all tasks; all others are rare, and meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletypes.plans.session import cut

from .token_counts import byte_letters

BLANK = "▁"  # stands for a blank in B's pieces
BEFORE_UNIT = re.compile(r"(?<=\S)(?= \S)")
KEPT = 300_000  # units a task keeps, and as many that it asked for before
AT_ONCE = 1 << 14  # characters of units encoded as one text
SUMMED = 1_000_000  # pairs a map task holds
HEAVY = 1 << 17


def ends(end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte offsets where the tokens of a run of bytes end: a span's end if the token's ``size`` decoded bytes fill the span from the end of the one before, else as
    far as the decoded bytes go (parts of a character share a span, or all but one have none)."""
    refined = np.cumsum(size)
    fits = np.diff(end, prepend=0) == size
    return np.where(fits & (end == refined), end, refined)


class Aligner:
    """Aligns texts by the tokenizer files of A and B."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = {c: b for b, c in enumerate(byte_letters())}
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: special[i].encode() if i in special else bytes(letters[c] for c in name) for name, i in self.a.get_vocab().items()}
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(" " in p.lstrip(b" ").decode() for i, p in enumerate(self.b_bytes) if not self.b.is_byte(i))
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(p) for p in self.b_bytes], np.int64)
        for i, part in self.a_bytes.items():
            self.a_size[i] = len(part)
        names = [str(i) for i in range(max(len(self.a_size), self.width))]
        self.names = {sign: np.array([n + sign for n in names], object) for sign in ",|;"}
        self.name_size = np.array([len(n) + 1 for n in names], np.int64)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def units(self, text: str) -> list[str]:
        """A blank and the text, cut before single blanks (kept whole if a piece of B has a blank inside)."""
        return BEFORE_UNIT.split(" " + text) if self.apart else [" " + text]

    def learn(self, units: set[str]) -> None:
        """Align units that are not known yet. Of the known ones those asked for lately are kept."""
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        fresh: list[str] = []
        size = 0
        for unit in units.difference(self.known):
            if unit in self.older:
                self.known[unit] = self.older[unit]
            elif self.apart and BLANK not in unit:
                fresh.append(unit)
                size += len(unit)
                if size >= AT_ONCE:
                    self._learn(fresh)
                    fresh, size = [], 0
            else:
                self._learn([unit])
        if fresh:
            self._learn(fresh)

    def _learn(self, units: list[str]) -> None:
        """Units that stand side by side are a text of their own, and are encoded as one."""
        if not self._aligned(units):
            for unit in units:
                if len(units) == 1 or not self._aligned([unit]):
                    self.known[unit] = None

    def _aligned(self, units: list[str]) -> bool:
        """Keep (groups as text, tokens of A, links as 64-bit codes) of each unit; not if the tokens' bytes are not the units'."""
        text = "".join(units)
        a, b = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        a_list, b_list, raw = a.ids, [p.id for p in b], text.encode()
        if b"".join([self.a_bytes[x] for x in a_list]) != raw or b"".join([self.b_bytes[x] for x in b_list]) != raw:
            return False
        a_ids, b_ids = np.array(a_list), np.array(b_list)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        a_ends = ends(byte_at[[y for _, y in a.offsets]], self.a_size[a_ids])
        b_ends = ends(np.array([p.end for p in b]) + 1, self.b_size[b_ids])  # B's spans are bytes of the text without its first blank, which the first token takes in
        cuts, i, j = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        unit_ends = byte_at[np.cumsum([len(u) for u in units])]
        if not np.isin(unit_ends, cuts, assume_unique=True).all():
            return False
        codes = (a_ids[i] * self.width + b_ids[j]).tobytes()
        n_a, n_b, n = (np.bincount(np.searchsorted(unit_ends, x), minlength=len(units)) for x in (a_ends, b_ends, cuts))
        a_in, b_in = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        a_text = np.where(a_ends == cuts[a_in], self.names["|"][a_ids], self.names[","][a_ids])
        b_text = np.where(b_ends == cuts[b_in], self.names[";"][b_ids], self.names[","][b_ids])
        order = np.argsort(np.concatenate([2 * a_in, 2 * b_in + 1]), kind="stable")
        groups = "".join(np.concatenate([a_text, b_text])[order].tolist())
        size = np.add.reduceat(self.name_size[a_ids], np.cumsum(n_a) - n_a) + np.add.reduceat(self.name_size[b_ids], np.cumsum(n_b) - n_b)
        stop, last = np.cumsum(size).tolist(), (8 * np.cumsum(n)).tolist()
        for unit, x, z, w, to, upto in zip(units, n_a.tolist(), n.tolist(), size.tolist(), stop, last, strict=True):
            self.known[unit] = groups[to - w : to - 1], x, codes[upto - 8 * z : upto]
        return True

    def align(self, units: list[str]) -> tuple | None:
        """(groups as text, tokens of A, of B, groups, links as an array of codes) of a text's units."""
        found = [self.known[u] for u in units]
        if None in found:
            return None
        groups, a = ";".join([x[0] for x in found]), sum([x[1] for x in found])
        links = np.frombuffer(b"".join([x[2] for x in found]), np.int64)
        return groups, a, groups.count(",") + 2 * len(links) - a, len(links), links  # a group of k tokens has k - 2 commas

    def forget(self) -> None:
        self.known, self.older = {}, {}


@lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


ALIGNED = "row long, id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, counts binary"


def _documents(a_file: str, b_file: str):
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(a_file, b_file)
        for batch in batches:
            out, parts = [], []
            for row, doc, text in zip(*(batch.column(c) for c in range(3)), strict=True):
                parts.append((row.as_py(), doc.as_py(), work.units(text.as_py()) if text.as_py() else []))
                if len(parts) == 256:
                    out += _rows(work, parts)
                    parts = []
            out += _rows(work, parts)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)
        work.forget()  # an idle worker holds no units

    return run


def _rows(work: Aligner, parts: list[tuple[int, int | None, list[str]]]) -> list[tuple]:
    work.learn({u for _, _, units in parts for u in units})
    out = []
    for row, doc, units in parts:
        found = work.align(units) if units else None
        if found is None:
            out.append((row, doc, 0, 0, 0, "", b"", b""))
        else:
            codes, counts = np.unique(found[4], return_counts=True)
            out.append((row, doc, *found[1:4], hashlib.sha256(found[0].encode()).hexdigest(), codes.tobytes(), counts.astype(np.int32).tobytes()))
    return out


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the batch, code, count) of the pairs of the documents."""
    codes, counts = batch.column("codes").to_pylist(), batch.column("counts").to_pylist()
    place = np.repeat(np.arange(len(codes)), [len(c) // 8 for c in codes])
    return place, np.frombuffer(b"".join(codes), np.int64), np.frombuffer(b"".join(counts), np.int32).astype(np.int64)


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, counts, len(codes)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])

    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            _, codes, counts = _pairs(batch.slice(a, 1024))
            held = _sums(np.concatenate([held[0], codes]), np.concatenate([held[1], counts]))
            if len(held[0]) >= SUMMED:
                yield table(*held)
                held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield table(*held)


def _find(codes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code stands in the sorted known ones, and whether it does."""
    at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
    return at, known[at] == codes if len(known) else np.zeros(len(codes), bool)


def _rare(heavy):
    """(row, code, c): the pairs of each document that are not heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value[0]
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for a in range(0, batch.num_rows, 1024):
                place, codes, counts = _pairs(batch.slice(a, 1024))
                rest = ~_find(codes, known)[1]
                yield pa.RecordBatch.from_arrays([pa.array(rows[a + place[rest]]), pa.array(codes[rest]), pa.array(counts[rest])], names=["row", "code", "c"])

    return run


def _summed(heavy):
    """The documents with their links and what their heavy pairs add."""
    names = ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = heavy.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                place, codes, counts = _pairs(part)
                at, there = _find(codes, known)
                total, links, top = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                np.add.at(links, place, counts)
                at, here, times = at[there], place[there], counts[there]
                np.add.at(total, here, times * n[at])
                np.add.at(top, here, times * best[at])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:6]), *(pa.array(x) for x in (links, top, total))], names=names)

    return run


def aligned_tokens(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A reads a blank and the text, B the text, to which it adds the blank itself; neither adds special tokens. Texts that are null or empty, or that the tokens of
    either do not give back byte by byte, have zeros and an empty digest. A pair's count is the number of links that hold it in all ``docs``, repeats and
    rows with a null id included; ``n_best`` are the links whose count is the highest of their B token. Other columns are not read;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut(rows.mapInArrow(_documents(a_file, b_file), ALIGNED))
    width = _vocabulary(b_file)
    pairs = found.select("codes", "counts").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = cut(pairs.withColumn("b", F.col("code") % width))
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    counts = cut(pairs.join(top, "b").select("code", "n", (F.col("n") == F.col("top")).alias("best")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * F.lit(heavy) >= F.lit(total)
    known = sorted((r.code, r.n, r.best) for r in counts.where(often).collect())  # at most ``heavy`` of them
    shared = spark.sparkContext.broadcast(tuple(np.array([r[c] for r in known], t) for c, t in enumerate((np.int64, np.int64, np.int64))))
    rare = found.select("row", "codes", "counts").mapInArrow(_rare(shared), "row long, code long, c long").join(counts.where(~often), "code")
    rare = rare.groupBy("row").agg(F.sum(F.col("c") * F.col("n")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("rare_best"))
    whole = found.mapInArrow(_summed(shared), "row long, id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    return whole.join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


@lru_cache(maxsize=4)
def _vocabulary(b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
