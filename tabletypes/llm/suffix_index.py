"""Exact repeats of byte strings across documents by a logarithmic family of suffix arrays.

A string of ``size`` bytes belongs to the bucket of its anchor, the k-gram in it with the least hash (the leftmost of
equals): equal strings share the anchor and the bucket. The map side cuts each text into fragments, the stretches whose
strings have one anchor, so a bucket is a piece of work that machines share without seeing whole texts. A bucket
takes its fragments in the order of their first documents, in batches. Each batch gets a suffix array (its strings in sorted order, each with
its first document), which is scanned against every level of the index; then it becomes a level itself, and levels of equal size
merge, so that each string takes part in at most log(n) merges.

Hot strings: a map task resolves repeats among its own rows and sends each fragment once, with its first
document only; a passage held by a third of all rows is one fragment per map task in its bucket. Fragments are equal by a 128-bit
fingerprint, strings by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import column_bytes, mix, powers, prefix_sums, row_slices, union_spans

GRAM = 8
SLICE = 1 << 20  # bytes hashed at a time
FLUSH = 250_000  # fragments held by a map task
BUCKET_BYTES = 8 << 20  # text per bucket
BATCH = 1 << 14  # fragments per suffix array
_odd = np.random.default_rng(7).integers(0, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _width(size: int) -> int:
    """Bytes of the longest fragment, rounded up to whole 64-bit words."""
    return -(-(2 * size - GRAM) // 8) * 8


def fragments(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, anchor hash) of the fragments of the rows; a row's last string ends at its end."""
    n, window = len(data), size - GRAM + 1
    lengths = np.diff(offsets)
    if n < size or not (lengths >= size).any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64)
    s = prefix_sums(data)
    h = mix((s[GRAM:] - s[:-GRAM]) * powers(n)[1][: n - GRAM + 1])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= window:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < window:
        low = np.minimum(low[: len(low) - (window - step)], low[window - step :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    long = lengths >= size
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - size + 1, -1)
    valid = np.cumsum(valid[: len(anchor)]) > 0
    fresh = np.ones(len(anchor) + 1, bool)
    fresh[1:-1] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    rows = np.zeros(n + 1, bool)
    rows[offsets] = True
    fresh |= rows[: len(fresh)]
    edges = np.flatnonzero(fresh)
    start, stop = edges[:-1], edges[1:]
    keep = valid[start]
    start, stop = start[keep], stop[keep]
    # a run of valid starts may be followed by starts that are not valid: its strings end where they do
    row_end = offsets[np.searchsorted(offsets, start, "right")]
    stop = np.minimum(stop, row_end - size + 1)
    return start, stop - 1 + size, h[anchor[start]]


def _matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Fragments as rows of bytes, padded with zeros."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    m = padded[start[:, None] + np.arange(width)]
    m[np.arange(width) >= (end - start)[:, None]] = 0
    return m


def _by_parts(fn, m: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """``fn`` over parts of the rows, so that its working arrays stay small."""
    parts = [fn(m[i : i + 32_768], *(x[i : i + 32_768] for x in more)) for i in range(0, max(1, len(m)), 32_768)]
    return np.concatenate(parts, axis=-1)


def _fingerprints(m: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Two 64-bit values for each fragment."""

    def part(m: np.ndarray, length: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(m).view(np.uint64)
        words = mix(words + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, words.shape[1] + 1, dtype=np.uint64))
        return np.stack([mix((words * _odd[i, : words.shape[1]]).sum(axis=1, dtype=np.uint64) + length.astype(np.uint64)) for i in (0, 1)])

    return _by_parts(part, m, length)


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    raw = sizes + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, count, 8), 8 + 8 * count, []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


OUT = "bucket int, spans boolean, blob binary"


def _cut_rows(size: int, buckets: int):
    """Map side: blobs of distinct fragments per bucket, and blobs of spans already known to be repeats."""
    width = _width(size)

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        m, length, doc, pos, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
        h1, h2 = _fingerprints(m, length)
        order = np.lexsort((pos, doc, h2, h1))
        same = np.zeros(len(order), bool)
        same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        group = np.cumsum(~same) - 1
        first = order[np.flatnonzero(~same)]
        own = doc[order] == doc[first][group]  # occurrences in the first document share the fragment's fate
        late = order[~own]
        bucket = (mix(gram[first] + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
        frag_order = np.lexsort((pos[first], doc[first], bucket))
        place = np.empty(len(first), np.int64)
        place[frag_order] = np.arange(len(first))
        occ, occ_frag = order[own], place[group[own]]
        by_frag = np.argsort(occ_frag, kind="stable")
        occ, occ_frag = occ[by_frag], occ_frag[by_frag]
        first, bucket = first[frag_order], bucket[frag_order]
        used, begin = np.unique(bucket, return_index=True)
        names, flags, blobs = [], [], []
        for b, i, j in zip(used, begin, np.append(begin[1:], len(first)), strict=True):
            x, y = np.searchsorted(occ_frag, (i, j))
            f = first[i:j]
            rows, lens = m[f], length[f]
            names.append(int(b))
            flags.append(False)
            times = np.bincount(occ_frag[x:y] - i, minlength=len(f)).astype(np.int32)
            blobs.append(_pack(rows[np.arange(width) < lens[:, None]], lens.astype(np.uint8), np.diff(doc[f], prepend=0), times, pos[occ[x:y]].astype(np.int32)))
        if len(late):
            key, a, z = union_spans(doc[late], pos[late], pos[late] + length[late])
            to = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(to):
                k = to == b
                names.append(int(b))
                flags.append(True)
                blobs.append(_pack(key[k], a[k], z[k]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(flags), pa.array(blobs, pa.binary())], names=["bucket", "spans", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets, data = column_bytes(batch.column(1))
            for a, b in row_slices(offsets, SLICE):
                at = offsets[a : b + 1]
                piece, at = data[at[0] : at[-1]], at - at[0]
                start, end, gram = fragments(piece, at, size)
                row = np.searchsorted(at, start, "right") - 1
                for i in range(0, len(start), FLUSH):
                    k = slice(i, i + FLUSH)
                    parts.append((_matrix(piece, start[k], end[k], width), end[k] - start[k], ids[a:b][row[k]], start[k] - at[row[k]], gram[k]))
                    held += len(parts[-1][1])
                    if held >= FLUSH:
                        yield from flush(parts)
                        parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


class Levels:
    """The index of a bucket: sorted, distinct strings with their first documents, in levels of doubling size."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def first_documents(self, strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each string of a batch the first document that has it; the batch joins the index. No earlier batch has later documents."""
        order = np.argsort(strings, kind="stable")  # the batch comes in the order of documents, so the first of equals is the earliest
        keys = strings[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        suffixes, first = keys[fresh], doc[order][fresh]
        known = np.zeros(len(suffixes), bool)
        for level, docs in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            hit = level[at] == suffixes
            first = np.where(hit, np.minimum(first, docs[at]), first)
            known |= hit
        out = np.empty(len(strings), np.int64)
        out[order] = first[np.cumsum(fresh) - 1]
        if (~known).any():
            self._add(suffixes[~known], first[~known])
        return out

    def _add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][0]) < 2 * len(keys):
            older, older_docs = self.levels.pop()
            keys, docs = np.concatenate([older, keys]), np.concatenate([older_docs, docs])
            order = np.argsort(keys, kind="stable")  # two sorted runs: one merge
            keys, docs = keys[order], docs[order]
        self.levels.append((keys, docs))


def _bucket_spans(blobs: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the strings that an earlier document has, from the fragment blobs of one bucket."""
    width = _width(size)
    rows, lens, docs, occ_frag, occ_pos, base = [], [], [], [], [], 0
    for blob in blobs:
        raw, length, steps, times, pos = _unpack(blob, "u1", "u1", "i8", "i4", "i4")
        length = length.astype(np.int64)
        m = np.zeros((len(length), width), np.uint8)
        m[np.arange(width) < length[:, None]] = raw
        rows.append(m)
        lens.append(length)
        docs.append(np.cumsum(steps))
        occ_frag.append(np.repeat(np.arange(len(length)), times) + base)
        occ_pos.append(pos.astype(np.int64))
        base += len(length)
    m, length, doc, frag, pos = (np.concatenate(x) for x in (rows, lens, docs, occ_frag, occ_pos))
    del rows
    h1, h2 = _fingerprints(m, length)
    order = np.lexsort((doc, h2, h1))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = order[fresh]  # one row for each distinct fragment, of its first document
    first_doc = doc[first]
    occ_doc, occ_group = doc[frag], group[frag]
    copy = occ_doc > first_doc[occ_group]
    found = [(occ_doc[copy], pos[copy], pos[copy] + length[frag[copy]])]
    # strings of two fragments can be equal only if the fragments share the anchor and half of the other bytes on one side of it
    left, right, has_left, has_right = _sides(m[first], length[first], size)
    rest = np.flatnonzero(_shared(left, has_left) | _shared(right, has_right))
    rest = rest[np.argsort(first_doc[rest], kind="stable")]
    own = np.flatnonzero(~copy)
    own = own[np.argsort(occ_group[own], kind="stable")]
    own_at = np.searchsorted(occ_group[own], np.arange(len(first) + 1))
    index = Levels()
    for i in range(0, len(rest), BATCH):
        f = rest[i : i + BATCH]
        count = length[first[f]] - size + 1
        row = np.repeat(np.arange(len(f)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        views = np.lib.stride_tricks.sliding_window_view(m[first[f]], size, axis=1)
        strings = np.ascontiguousarray(views[row, j]).view(f"S{size}").ravel()
        repeat = index.first_documents(strings, first_doc[f][row]) < first_doc[f][row]
        row, j = row[repeat], j[repeat]
        if len(row):
            row, a, z = union_spans(row, j, j + 1)
            n = own_at[f[row] + 1] - own_at[f[row]]
            which = np.repeat(np.arange(len(row)), n)
            o = own[np.repeat(own_at[f[row]], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
            found.append((occ_doc[o], pos[o] + a[which], pos[o] + z[which] - 1 + size))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sides(m: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a fragment's anchor with the bytes before and after it, half a string's rest each, and whether the fragment has these.

    A string has at least half of its other bytes on one side of its anchor.
    """
    up, grams, half = powers(1)[0], size - GRAM + 1, -(-(size - GRAM) // 2)
    odd = np.uint64(0xD6E8FEB86659FD93)

    def part(m: np.ndarray, length: np.ndarray) -> np.ndarray:
        x = m[:, :size].astype(np.uint64) + np.uint64(1)
        value = x[:, :grams] * up[0]
        for k in range(1, GRAM):
            value += x[:, k : k + grams] * up[k]
        at = ((mix(value) & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)).argmin(axis=1)
        out = []
        for start in (at - half, at):
            near = m[np.arange(len(m))[:, None], np.clip(start[:, None] + np.arange(half + GRAM), 0, m.shape[1] - 1)]
            h = np.zeros(len(m), np.uint64)
            for k in range(half + GRAM):
                h = (h + near[:, k] + np.uint64(1)) * odd
            out.append(mix(h))
        return np.stack([*out, at >= half, at + GRAM + half <= length]).astype(np.uint64)

    left, right, has_left, has_right = _by_parts(part, m, length)
    return left, right, has_left > 0, has_right > 0


def _shared(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which of the valid keys occur twice or more."""
    at = np.flatnonzero(valid)
    _, inverse, count = np.unique(keys[at], return_inverse=True, return_counts=True)
    out = np.zeros(len(keys), bool)
    out[at] = count[inverse] > 1
    return out


def _scan(size: int):
    def run(table: pa.Table) -> pa.Table:
        blobs, flags = table.column("blob").to_pylist(), table.column("spans").to_pylist()
        found = [tuple(_unpack(b, "i8", "i8", "i8")) for b, f in zip(blobs, flags, strict=True) if f]
        cut_rows = [b for b, f in zip(blobs, flags, strict=True) if not f]
        if cut_rows:
            found.append(_bucket_spans(cut_rows, size))
        key, a, z = union_spans(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return pa.table({"id": pa.array(key, pa.int64()), "a": pa.array(a.astype(np.int32)), "z": pa.array(z.astype(np.int32))})

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """(id, a, z): byte ranges of ``docs`` covered by ``size``-byte strings that a document with a smaller id has too.

    Ranges of one document may overlap. Texts count as UTF-8; null, empty and short texts and rows without an id have no strings. Rows that
    share an id are repeats of one document. Other columns are not read; an empty table gives an empty result.
    """
    if size < 2 * GRAM or 2 * size - GRAM > 255:
        raise ValueError("size must lie between 16 and 131 bytes")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(f"id IS NOT NULL AND octet_length(text) >= {size}")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET_BYTES))
    blobs = rows.mapInArrow(_cut_rows(size, buckets), OUT)
    return blobs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_scan(size), "id long, a int, z int")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): each row's text without its spans; kept is what remains, as bytes."""
    import hashlib

    lists = spans.groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("z").alias("z"))  # bounded by the document's length
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(lists, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column(1))
            ids, n, removed, runs, digest, kept = batch.column(0), [], [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                a = batch.column(2)[i].values
                a = np.zeros(0, np.int64) if a is None else np.asarray(a.to_numpy(), np.int64)
                z = np.zeros(0, np.int64) if not len(a) else np.asarray(batch.column(3)[i].values.to_numpy(), np.int64)
                _, a, z = union_spans(np.zeros(len(a), np.int64), a, z)
                rest, last = [], 0
                for x, y in zip(a.tolist(), z.tolist(), strict=True):
                    rest.append(text[last:x].tobytes())
                    last = y
                rest = b"".join([*rest, text[last:].tobytes()])
                n.append(len(text))
                removed.append(int((z - a).sum()))
                runs.append(len(a))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
