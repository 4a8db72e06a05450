"""The operators against brute-force versions and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date
from difflib import SequenceMatcher

import numpy as np
import pytest

import corpus_pipeline
from tabletypes.llm import decontaminate, line_dedup, minhash, mixing, passages, quality, sharding, suffix_index, token_counts, toxicity
from tabletypes.llm.arrays import mix, union_spans
from tabletypes.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = SCHEMA + ", bucket int, shard string, id string, h string, copies date"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(rnd, n, vocabulary=4000):
    return " ".join(f"w{rnd.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeats, nulls, empty, blank and long texts."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randrange(1, 200)) for _ in range(n)]
    shared = prose(rnd, 80)
    for i in range(0, n, 7):
        texts[i] = f"{texts[i]} {shared} {prose(rnd, 20)}"
    for i in range(3, n, 9):
        words = texts[i - 1].split()
        words[rnd.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    texts[5] = texts[4]
    return [*texts, None, "", " \n\t ", "a" * 300, "ab" * 5000, "éü " * 60, "A a A a A a\nA a A a A a\n", prose(rnd, 3000)]


def words_of(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))) if w]


def test_repeated_bytes_match_brute_force(spark):
    docs = corpus()
    first, want = {}, {}
    for d, text in enumerate(docs):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d) < d:
                cover[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(raw, cover, strict=True) if not c)
        want[d] = (len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    df = frame(spark, docs)
    got = suffix_index.without_spans(df, suffix_index.repeated_spans(df.repartition(3))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_levels_merge_and_find_first_documents():
    rnd = np.random.default_rng(3)
    index, first = suffix_index.Levels(), {}
    for batch in range(40):
        keys = np.array([b"%050d" % x for x in rnd.integers(0, 3000, 100)])
        docs = np.full(100, batch)
        for k in keys:
            first.setdefault(k, batch)
        assert index.first_documents(keys, docs).tolist() == [first[k] for k in keys]
    sizes = [len(k) for k, _ in index.levels]
    assert len(sizes) <= 12 and all(x >= 2 * y for x, y in zip(sizes, sizes[1:], strict=False))


def test_union_spans_joins_what_touches():
    key, a, z = union_spans(np.array([1, 1, 2, 1]), np.array([5, 0, 0, 2]), np.array([9, 2, 3, 4]))
    assert list(zip(key.tolist(), a.tolist(), z.tolist(), strict=True)) == [(1, 0, 4), (1, 5, 9), (2, 0, 3)]


def expected_components(texts, size, percent=80):
    sets = []
    for t in texts:
        w = words_of(t)
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rnd = random.Random(5)
    base = prose(rnd, 60).split()
    family = []
    for _ in range(40):  # around the threshold, all in the same buckets
        w = list(base)
        for _ in range(rnd.randrange(2, 7)):
            w[rnd.randrange(len(w))] = f"new{rnd.random()}"
        family.append(" ".join(w))
    texts = corpus() + family
    got = minhash.near_duplicates(frame(spark, texts), size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected_components(texts, size)


def test_confirmed_links_join_what_belongs_together():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 40, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 50 - i % 9], rnd.integers(0, 1 << 40, i % 9).astype(np.uint64)])) for i in range(60)]
    ids = np.arange(60)
    links = minhash.confirmed_links(ids, ids, sets, 80)
    true = {(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert all((max(x), min(x)) in true for x in links)
    groups = lambda edges: sorted(map(sorted, merge(60, edges)))
    assert groups(links) == groups(true)


def merge(n, edges):
    group = {i: {i} for i in range(n)}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {id(g): g for g in group.values()}.values()


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (3, 2), (2, 3), (None, 4)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, **{i: 100 for i in range(100, 160)}, 2: 2, 3: 2}


def test_lines_match_brute_force(spark):
    rnd = random.Random(4)
    line = lambda: prose(rnd, rnd.randrange(8, 25))
    common, near = line(), line()
    texts = [f"{line()}\n{common}\n{line()}" for _ in range(20)] + [f"{near} tail{i % 10}\n\n{line()}" for i in range(10)] + [None, "", "\n \n", "ab\nAB \nab", common.upper()]
    rows = [(d, p, x.strip(" \t").lower()) for d, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if x.strip()]
    cut = lambda x: {x.encode()[i : i + 8] for i in range(max(1, len(x.encode()) - 7))}
    names = list(dict.fromkeys(x for _, _, x in rows))
    sets = [cut(x) for x in names]
    edges = [(i, j) for i in range(len(names)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = {names[i]: k for k, g in enumerate(merge(len(names), edges)) for i in g}
    first, removed = {}, defaultdict(list)
    for d, p, x in rows:
        if first.setdefault(group[x], (d, p)) != (d, p):
            removed[d].append(p)
    got = {r.doc_id: (r.n_lines, r.removed_lines) for r in line_dedup.line_report(frame(spark, texts)).collect()}
    assert got == {d: (sum(r[0] == d for r in rows), removed[d]) for d in range(len(texts))}


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    changed = list(passage)
    changed[20], changed[45] = "x", "y"
    del changed[60]
    texts = [prose(rnd, 300, 10**6) for _ in range(12)]
    for i, p in ((2, passage), (5, passage), (8, changed)):
        texts[i] = f"{texts[i]} {' '.join(p)} {prose(rnd, 90, 10**6)}"
    texts += [texts[0], None, "", " ".join(passage[:40])]
    got = {(r.doc_id, r.source_doc_id): r for r in passages.passages(frame(spark, texts)).collect()}
    assert set(got) == {(5, 2), (8, 2), (12, 0)}
    assert got[5, 2].equal_words == 70 and got[8, 2].equal_words == 67 and got[12, 0].end_word == 300


def test_every_passage_that_two_documents_share_is_reported(spark):
    rnd = random.Random(21)
    one, two = prose(rnd, 60, 10**6), prose(rnd, 60, 10**6)
    texts = [f"{prose(rnd, 40, 10**6)} {one} {prose(rnd, 300, 10**6)} {two} {prose(rnd, 40, 10**6)}" for _ in range(2)]
    got = sorted((r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.source_start, r.source_end, r.equal_words) for r in passages.passages(frame(spark, texts)).collect())
    assert got == [(1, 0, 40, 100, 40, 100, 60), (1, 0, 400, 460, 400, 460, 60)]


def test_matching_blocks_are_those_of_difflib():
    rng, xs, ys, want = random.Random(5), [], [], []
    for words in (2, 3, 12, 1000) * 60:
        x = [rng.randrange(words) for _ in range(rng.randrange(120))]
        y = list(x)
        for _ in range(rng.randrange(20) if y else 0):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = [rng.randrange(words) for _ in range(rng.randrange(3))]
        xs.append(mix(np.array(x, np.uint64)).tobytes())
        ys.append(mix(np.array(y, np.uint64)).tobytes())
        want.append([b for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if b.size >= passages.SHORTEST])
    assert list(passages.matching_blocks(xs, ys)) == want


def test_passages_whose_parts_stand_in_several_earlier_documents(spark):
    rnd = random.Random(34)

    def around(*parts):
        return " ".join(f"{prose(rnd, 40, 10**6)} {p}" for p in [*parts, ""])

    pieces = [prose(rnd, 20, 10**6) for _ in range(6)]
    whole, long = " ".join(pieces[:3]), " ".join(pieces)
    texts = [around(p) for p in pieces] + [around(whole), around(prose(rnd, 70, 10**6)), around(whole, whole), around(long), around(long)]
    got = {}
    for r in passages.passages(frame(spark, texts)).collect():
        got.setdefault((r.doc_id, r.source_doc_id), []).append((r.start_word, r.end_word, r.source_start, r.source_end, r.equal_words))
        assert words_of(texts[r.doc_id])[r.start_word : r.end_word] == words_of(texts[r.source_doc_id])[r.source_start : r.source_end]
    assert set(got) == {(8, 6), (9, 6), (10, 9)}
    assert sorted(got[8, 6]) == [(40, 100, 40, 100, 60), (140, 200, 40, 100, 60)] and got[9, 6] == [(40, 100, 40, 100, 60)]
    assert got[10, 9] == [(40, 160, 40, 160, 120)]
    same = [" ".join(["a"] * n) for n in (70, 300)]  # runs that overlap themselves
    found = passages.passages(frame(spark, [around(x) for x in same])).collect()
    assert 1 <= len(found) <= 8 and {(r.doc_id, r.source_doc_id) for r in found} == {(1, 0)}


def test_runs_of_equal_words_lie_in_rows_whose_source_has_them(spark):
    rnd = random.Random(35)
    shelf = [prose(rnd, rnd.choice([9, 17, 26, 55]), 10**6) for _ in range(14)]
    texts = [" ".join(rnd.choice([*shelf, prose(rnd, 12, 10**6)]) for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    rows = {}
    for r in passages.passages(frame(spark, texts)).collect():
        rows.setdefault(r.doc_id, []).append((r.start_word, r.end_word, words_of(texts[r.source_doc_id])[r.source_start : r.source_end]))
    first, seen = {}, 0
    for d, text in enumerate(texts):
        words = words_of(text)
        for i in range(len(words) - 49):
            run = words[i : i + 50]
            if first.setdefault(tuple(run), d) < d:
                seen += 1
                assert any(a <= i and z >= i + 50 and any(source[j : j + 50] == run for j in range(len(source) - 49)) for a, z, source in rows.get(d, []))
    assert seen > 100


def test_every_place_of_runs_that_overlap_themselves_lies_in_a_row(spark):
    rnd = random.Random(36)
    unit = prose(rnd, 7, 10**6)
    around = [prose(rnd, 40, 10**6) for _ in range(12)]
    same = [" ".join(["a"] * n) for n in (55, 300)]
    texts = [f"{around[0]} {same[0]} {around[1]}", f"{around[2]} {' '.join([unit] * 11)} {around[3]}", f"{around[4]} {same[1]} {around[5]}", f"{around[6]} {' '.join([unit] * 60)} w {same[1]}"]
    ids = [0, 1, 2, 3, 3, 4]  # a document whose rows share an id
    texts += [f"{around[7]} {same[1]} {around[8]}", None]
    rows, seen = {}, 0
    for r in passages.passages(frame(spark, texts, ids)).collect():
        assert 5 * r.equal_words >= 4 * max(r.end_word - r.start_word, r.source_end - r.source_start)
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) < 120
    words = [(d, words_of(t)) for d, t in zip(ids, texts, strict=True)]
    has = lambda x, run: any(x[j : j + 50] == run for j in range(len(x) - 49))
    for d, own in words:
        for i in range(len(own) - 49):
            run = own[i : i + 50]
            if any(e < d and has(x, run) for e, x in words):
                seen += 1
                assert any(r.start_word <= i and r.end_word >= i + 50 and any(e == r.source_doc_id and has(x[r.source_start : r.source_end], run) for e, x in words) for r in rows.get(d, []))
    assert seen > 800


def test_fenwick_chains_are_the_best_ones():
    rnd = random.Random(6)
    for _ in range(30):
        pos, at = ([rnd.randrange(60) for _ in range(12)] for _ in range(2))
        points = sorted(set(zip(pos, at, strict=True)))
        best = [0.0] * len(points)
        for i, (p, a) in enumerate(points):
            best[i] = passages.REWARD + max([0.0, *(best[j] - passages.GAP * (p - q + a - b) for j, (q, b) in enumerate(points) if q < p and b < a)])
        top = points[max(range(len(points)), key=lambda i: best[i])]
        chains = passages.chains(np.array([p for p, _ in points]), np.array([a for _, a in points]))
        assert sum(best[i] == max(best) for i in range(len(points))) > 1 or (chains[0][1] - passages.K, chains[0][3] - passages.K) == top


def test_toxicity_scale_minimises_the_penalised_loss():
    x, toxic, n = np.array([0.0, 0.0, 4.3, 4.3, 9.0, 14.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0, 1.0]), np.array([900.0, 1.0, 40.0, 3.0, 60.0, 40.0])
    bias, scale = toxicity.calibrated(-2.0, x, toxic, n)

    def loss(b, s):
        z = b + s * x
        return (n * (np.log1p(np.exp(z)) - toxic * z)).sum() + ((b + 2) ** 2 + (s - 1) ** 2) / 2

    around = [loss(bias + i, scale + j) for i in np.linspace(-1, 1, 21) for j in np.linspace(-0.3, 0.3, 21)]
    assert loss(bias, scale) <= min(around) + 1e-9
    assert bias + scale * 4.3 < 0 < bias + scale * 9.0  # one word met by chance is no proof, several are
    assert toxicity.calibrated(-2.0, np.zeros(0), np.zeros(0), np.zeros(0)) == (-2.0, 1.0)
    assert toxicity.calibrated(-2.0, np.array([0.0, 9.0]), np.array([1.0, 0.0]), np.array([500.0, 500.0])) == (-2.0, 1.0)  # never turned around


def decoder():
    """A decoder under the character model of a few English words."""
    counts = np.zeros((27, 27, 27))
    for w in "you are such a stupid idiot and a loser or an ass who said so it is not the last one of those that pass".split() * 50:
        c = [0, 0, *(ord(x) - 96 for x in w), 0]
        for x in zip(c, c[1:], c[2:], strict=False):
            counts[x] += 1
    return toxicity.Decoder(counts)


def test_signs_at_the_edges_of_words_are_read_as_letters():
    d = decoder()
    for text, word in (("$tupid", "stupid"), ("!diot", "idiot"), ("a$$", "ass"), ("a$$!!", "ass"), ("$tupid!", "stupid"), ("lo$er$!", "losers"), ("455", "ass"), ("@$$", "ass"), ("'!diot'", "idiot")):
        assert word in d.features(f"well, {text} there"), text
    assert "stupid" in d.features("stupid!")


def test_long_stretches_and_tokens_are_restored_whole():
    d = decoder()
    assert "idiot" in d.features(" ".join("you are such a loser and " * 40 + "idiot").replace("   ", "  "))
    assert "idiot" in d.features("an " + "idi" + "o" * 400 + "t said so")
    long = "-".join(["such_a"] * 20 + ["$tup1d", "l0ser"] + ["so"] * 3000)
    assert {"stupid", "loser"} <= d.features(long)


def test_toxicity_restores_disguised_words(spark):
    rnd = random.Random(9)
    syllables = ["ka", "lo", "mi", "ne", "ru", "ta", "so", "pe"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 4)))
    texts, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [word() for _ in range(30)] + (["idiot", "moron"] if bad else [])
        rnd.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, 1, int(bad)))
    tests = ["kalo 1d10t mine m0r0n", "kalo i d i o t mine", "kalo idiooooot mine", "kalo mine ruta", None, ""]
    df = frame(spark, texts + tests)
    got = {r.doc_id: r for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[400 + i].predicted for i in range(6)] == [1, 1, 1, 0, 0, 0]
    assert all(got[i].predicted == x for i, _, x in labels) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())


def test_quality_counts_match_brute_force(spark):
    texts = corpus() + ["x y z x y z x y z x y z", "# $ a b c d e f g h i", "one two\none two\n\none  two"]
    for r in quality.quality(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_shards_are_even_and_gapless(spark):
    texts = corpus() + ["same"] * 50
    df = frame(spark, texts, [*range(len(texts) - 50), *[None] * 25, *[7] * 25])
    rows = sharding.document_shards(df).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)


def test_leaks_match_brute_force(spark):
    rnd = random.Random(12)
    items = [prose(rnd, n) for n in (12, 30, 45, 4)] + [None, "", "one"]
    altered = items[1].split()
    altered[0] = "else"
    texts = [prose(rnd, 50) for _ in range(8)] + [f"{prose(rnd, 30)} {items[0]} {prose(rnd, 9)}", items[2].upper(), " ".join(altered), f"{prose(rnd, 5)} {items[3]}", f"x {items[1][:60]}", None, "", "one two"]
    got = decontaminate.matches(frame(spark, texts), spark.createDataFrame(enumerate(items), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(8, 0), (9, 2), (10, 1), (11, 3), (15, 6)}
    assert {r.doc_id: r.position for r in got}[8] == 30


def test_rates_reach_the_targets(spark):
    rnd = random.Random(13)
    texts = [prose(rnd, rnd.randrange(20, 200)) for _ in range(200)] + ["$$$ ### " * 30 for _ in range(60)]
    labels = [(i, int(i < 200), 0) for i in range(0, 260, 2)] + [(None, 1, 0), (1, None, None)]
    df = frame(spark, [*texts, None, ""])
    rows = mixing.mixture(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"clean": 0.8, "low_quality": 0.2}).collect()
    totals = [sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS]
    assert abs(totals[0] / sum(totals) - 0.8) < 0.01 and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


@pytest.mark.parametrize("tail", [0.3, 0.001])
def test_rates_of_three_overlapping_domains_reach_all_targets(spark, tail):
    rnd = np.random.default_rng(4)
    alpha = np.array([2.0, 1.0, tail])
    rows = [(i, int(n), [float(v) for v in p]) for i, (n, p) in enumerate(zip(rnd.integers(20, 400, 3000), rnd.dirichlet(alpha, 3000), strict=True))]
    got = mixing.rates(spark.createDataFrame(rows, "id long, tokens long, p array<double>")).collect()
    totals = np.array([sum(r.rate * r.tokens * r.p[i] for r in got) for i in range(3)])
    own = sum(n * p[0] for _, n, p in rows)
    want = own / 0.91 * np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    assert (abs(totals / want - 1) < 2e-3).all() and min(r.rate for r in got) >= 0


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(14)
    odd = ["it's we'll I'D they'VE ''s '''ll !'s", "<|endoftext|>x<|startoftext|> <|END", "ΣΑΣ İ ΟΔΟΣ.", "é Å １２３ ½", "日本語 😀👍🏽", " x y　z\x85", "a" * 5000]
    odd += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz'é1! ") for _ in range(rnd.randrange(40))) for _ in range(500)]
    texts = corpus() + odd
    library = Tokenizer.from_file(tokenizer())
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = token_counts.token_counts(frame(spark, texts), tokenizer()).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(want)) and all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    machine = token_counts.compiled(tokenizer())
    assert [machine.count(t or "", chunk) for t in texts for chunk in (1, 7, 50)] == [n for n in want for _ in range(3)]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        suffix_index.without_spans(docs, suffix_index.repeated_spans(docs)), line_dedup.line_report(docs), toxicity.toxicity(docs, labels), quality.quality(docs),
        sharding.document_shards(docs), passages.passages(docs), minhash.near_duplicates(docs), decontaminate.matches(docs, items), mixing.mixture(docs, labels), token_counts.token_counts(docs, tokenizer()),
    ):
        assert df.collect() == []


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    rnd = random.Random(15)
    texts = [prose(rnd, 80) for _ in range(60)]
    texts[7] = texts[3]
    item = prose(rnd, 40)
    texts[9] = f"{prose(rnd, 10)} {item} {prose(rnd, 10)}"
    texts[11] += " vile vile"
    for i in range(20, 40):
        texts[i] += " vile"
    rows = [(i, t, "en", "s", len(t), 1, "x", "y", "z", date(2020, 1, 1)) for i, t in enumerate(texts)]
    rows += [(None, prose(rnd, 60), None, None, None, None, None, None, None, None), (70, None, None, None, None, None, None, None, None, None), (71, "", None, None, None, None, None, None, None, None), rows[1]]
    spark.createDataFrame(rows, WIDE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in t)) for i, t in enumerate(texts) if i != 11], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert set(docs.columns) == {*WIDE.replace(" string", "").replace(" long", "").replace(" int", "").replace(" date", "").split(", ")} | ({"slot"} if name == "sharding" else set())
        seen[name] = [r.doc_id for r in docs.collect()]
    toxic = {11, *range(20, 40)}
    assert not toxic & set(seen["toxicity"]) and len(seen["toxicity"]) == 64 - 21
    assert sorted(x for x in seen["near_duplicates"] if x is not None) == sorted({*range(60), 70, 71} - toxic - {7}) and None in seen["near_duplicates"]
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {9}
    assert len(seen["sharding"]) == len(seen["mixing"]) >= 0.9 * len(seen["decontamination"])
