"""Spelling variants, exact top-k search and token alignment against brute-force versions and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from math import floor, isfinite, nan

import numpy as np
import public_tokenizers
import pytest

from tabletypes.llm import alignment, spelling, topk

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = "doc_id long, text string, id string, n long, word string, key int, row int, code int, rank int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "w", 1, 2, 3, 4) for i, t in rows], EXTRA)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, every):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variants_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def typed_text(rnd, vocabulary, size):
    words = []
    for _ in range(size):
        w = rnd.choice(vocabulary[: 1 + int(len(vocabulary) * rnd.random() ** 3)])
        if rnd.random() < 0.2:
            i, c = rnd.randrange(len(w)), rnd.choice("abé")
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
        words.append(rnd.choice([w, w.upper(), w.capitalize()]))
    return rnd.choice([" ", "-", "3", ", "]).join(words)


def test_spelling_variants_match_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(5, 9))) for _ in range(60)]
    rows = [(i, typed_text(rnd, vocabulary, rnd.randrange(1, 400))) for i in range(80)]
    rows += [(None, "banana Banana " * 6), (None, None), (5, None), (6, ""), (7, " \n"), (8, "x" * 3000), rows[0], rows[0], (9, "ÀÉÎÕÜ× ÷àéîõü " * 9)]
    for every in (None, 7):
        want = brute_words(rows, every)
        assert want
        docs = docs_of(spark, rows).repartition(5)
        assert {(r.word, r.n) for r in spelling.word_counts(docs, every=every).collect()} == set(want.items())
        assert variants_of(spelling.spelling_variants(docs, every=every)) == brute_variants(want)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    text = " ".join(["letters", "Öffnung", "überall"] * 50) + "z" * 100
    for piece in (1, 10, 1 << 20):
        monkeypatch.setattr(spelling, "PIECE", piece)
        assert "".join(spelling._pieces(text)) == text
        assert sum((spelling.RUN.findall(p) for p in spelling._pieces(text)), []) == spelling.RUN.findall(text)


@pytest.mark.parametrize(("group", "bucket"), [(2, 10), (40, 100), (20_000, 60_000)])
def test_hot_keys_are_halved_and_every_pair_found_once(spark, group, bucket):
    rnd = random.Random(4)
    words = {"common" + "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 6))) for _ in range(120)}
    words |= {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 7))) + "ending" for _ in range(120)}
    words |= {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(200)} | {"é", "日本語", "日本", "w" * 500, "w" * 501}
    n = {w: 5 + hash_of(w) % 200 for w in words}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    found = Counter((r.word, r.other) for r in spelling.near_pairs(frame, group, bucket).collect())
    assert max(found.values()) == 1
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert variants_of(spelling.variants(frame, group=group, bucket=bucket)) == brute_variants(n)


def hash_of(word):
    return zlib.crc32(word.encode())


def test_roots_follow_long_chains(spark):
    words = ["abcdef" + "g" * i for i in range(9)]
    frame = spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(words)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.variants(frame).collect()}
    assert got == {w: (words[i + 1] if i < 8 else None, words[8]) for i, w in enumerate(words)}
    with pytest.raises(ValueError):
        spelling.variants(frame, factor=1)


def test_spelling_of_empty_tables(spark):
    assert spelling.spelling_variants(docs_of(spark, [])).collect() == []
    assert spelling.spelling_variants(docs_of(spark, [(1, None), (2, "a b c")])).collect() == []


def brute_top(rows, k, every):
    good = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and isfinite(x) for x in v):
            good[i].append([floor(64 * x) for x in v])
    out = set()
    for q in good:
        if q % every == 0:
            score = {}
            for c in good:
                for x in good[q]:
                    for y in good[c]:
                        if c != q and len(x) == len(y):
                            score[c] = max(score.get(c, -(10**30)), sum(a * b for a, b in zip(x, y, strict=True)))
            for r, c in enumerate(sorted(score, key=lambda c: (-score[c], c))[:k]):
                out.add((q, r + 1, c, score[c]))
    return out


def vectors(rnd, n, size, step=0.25):
    return [(i, [step * rnd.randrange(-8, 9) for _ in range(size)]) for i in range(n)]


def searched(spark, rows, k=20, every=20, parts=3, **sizes):
    frame = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, label int, tile int, rank int").repartition(parts)
    return [tuple(r) for r in topk.top_k(frame, k, every, **sizes).select("query_id", "rank", "vec_id", "score").collect()]


@pytest.mark.parametrize("sizes", [{}, {"tile_values": 40, "shard_values": 100}, {"tile_values": 500, "shard_values": 8}])
def test_top_k_matches_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rnd = random.Random(5)
    rows = vectors(rnd, 230, 4)
    for i in range(40, 130):
        rows[i] = (i, [0.5, -0.25, 1.0, 0.0])  # one very common vector
    rows += [(300, None), (320, [nan, 1, 1, 1]), (340, [1, None, 1, 1]), (360, [float("inf"), 0, 0, 0]), (None, [1.0] * 4), (380, []), (381, []), (400, [1.0, 2.0]), (401, [3.0, -2.0]), (420, [5.0])]
    rows += [(7, [2.0] * 4), (20, [2.0] * 4), (20, [-2.0] * 4), rows[3], rows[60], rows[60], (-40, [-1.0] * 4), (440, [1000.0, 1, 1, 1])]
    got = searched(spark, rows, **sizes)
    assert len(got) == len(set(got)) and set(got) == brute_top(rows, 20, 20)


def test_large_scores_stay_exact(spark):
    rnd = random.Random(6)
    for most in (1 << 16, 1 << 23):  # beyond what single and double precision hold
        rows = [(i, [float(rnd.randrange(-most, most)) + rnd.randrange(64) / 64 for _ in range(3)]) for i in range(80)]
        assert set(searched(spark, rows, k=5)) == brute_top(rows, 5, 20)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    assert searched(spark, [(0, [1.0]), (3, [2.0])]) == [(0, 1, 3, 64 * 128)]
    assert searched(spark, [(0, [1.0])]) == []
    assert searched(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert searched(spark, []) == []


def decoded(name):
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    table = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    return bytes(table[c] for c in name)


@cache
def tokenizers_of_both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def brute_alignment(rows):
    a, b = tokenizers_of_both()
    per = []
    for doc, text in rows:
        x = a.encode(" " + text, add_special_tokens=False) if text else None
        xs, ys = (x.ids, b.encode(text)) if text else ([], [])
        px = [decoded(t) for t in x.tokens] if text else []
        py = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ys)]
        if not text or b"".join(px) != (" " + text).encode() or b"".join(py) != (" " + text).encode():
            per.append((doc, [], [], [], []))
            continue
        ex, ey = np.cumsum([len(p) for p in px]).tolist(), np.cumsum([len(p) for p in py]).tolist()
        links = [(xs[i], ys[ey.index(e)]) for i, e in enumerate(ex) if e in set(ey)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ex) & set(ey)):
            ni, nj = ex.index(e) + 1, ey.index(e) + 1
            groups.append(f"{','.join(map(str, xs[i:ni]))}|{','.join(map(str, ys[j:nj]))}")
            i, j = ni, nj
        per.append((doc, xs, ys, groups, links))
    count = Counter(p for _, _, _, _, links in per for p in links)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return Counter(
        (doc, len(xs), len(ys), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if xs else "")
        for doc, xs, ys, groups, links in per
    )


def mixed_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\t", "\r\n", "naïve", "日本語", "𝒳", "🙂", "👩‍👩‍👧", "é", "don't", "1234", "<|endoftext|>", "<s>", "</s>", "<0x41>", " ", " ", "​", "\u0000", "ﬁ", "İ", "!!", "$%", "x" * 30, "Ünïcode", "\u0085", "\u001c", "a", "word", "'s", " '", "ß"]
    return ["".join(rnd.choice(parts) + rnd.choice(["", "", " "]) for _ in range(rnd.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("heavy", [1, 50, 1 << 17])
def test_alignment_matches_whole_texts_of_the_libraries(spark, heavy):
    texts = mixed_texts(8, 150)
    rows = [*enumerate(texts), (None, "the word the word"), (3, texts[3]), (3, "another one"), (200, None), (201, ""), (202, " "), (203, "  leading"), (204, "trailing  "), (205, "has ▁ in it"), (206, "the " * 5000), (207, "ab" * 4000), (208, "日本" * 2000)]
    found = alignment.aligned_tokens(docs_of(spark, rows).repartition(4), A_FILE, B_FILE, heavy=heavy)
    assert found.columns[0] == "doc_id"
    assert Counter(tuple(r) for r in found.collect()) == brute_alignment(rows)


def test_known_units_are_bounded_and_forgotten(spark, monkeypatch):
    work = alignment.Aligner(A_FILE, B_FILE)
    monkeypatch.setattr(alignment, "KEPT", 3)
    texts = mixed_texts(9, 40)
    out = [r for t in texts for r in alignment._rows(work, [(0, 1, work.units(t))])]
    fresh = alignment.Aligner(A_FILE, B_FILE)
    assert out == alignment._rows(fresh, [(0, 1, fresh.units(t)) for t in texts])


@pytest.mark.parametrize(
    ("span_ends", "sizes", "want"),
    [
        ([2, 3], [2, 1], [2, 3]),
        ([3, 3, 3, 4], [1, 1, 1, 1], [1, 2, 3, 4]),  # parts of a character, each with the whole span
        ([1, 1, 3, 4], [1, 1, 1, 1], [1, 2, 3, 4]),  # bytes of a character, of which the last has the span
    ],
)
def test_spans_are_cuts_and_bytes_refine_them(span_ends, sizes, want):
    assert alignment.ends(np.array(span_ends), np.array(sizes)).tolist() == want


def test_alignment_of_empty_tables(spark):
    assert alignment.aligned_tokens(docs_of(spark, []), A_FILE, B_FILE).collect() == []
    assert [tuple(r) for r in alignment.aligned_tokens(docs_of(spark, [(1, None)]), A_FILE, B_FILE).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
