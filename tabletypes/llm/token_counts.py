"""Token counts by a finite-state transducer compiled from a tokenizer file (BPE with word ends).

Pre-tokens: the file's split pattern is a small automaton over character classes; white space resets it. A chunk of text is
summarised as (head, count, tail): the part before its first reset, the tokens between, and the part after its last. That is the
chunk's map from any state at its start to the state at its end and the tokens emitted; summaries compose associatively, so chunks of a
long text can be scanned in any grouping.

Inside a pre-token the transducer's state is the last token of the encoding so far. Reading on, a token that ends here
follows the state before it if merging would not have joined or split the two otherwise; exactly one does, so the machine is
deterministic and each transition emits one token. Transitions are determinised when first needed and kept.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16  # characters
KEPT = 1_000_000  # words with a known count kept by a task


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Transducer:
    """Counts tokens as the tokenizer of ``spec`` (the parsed file) does without added special tokens."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            x, y = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = self.vocab[x], self.vocab[y], self.vocab[x + y]
            self.parts[c] = (a, b)
            self.joined[a, b] = c
        # merges are applied by rank: a token's rank is its place among the merges, single letters come before all
        self.rank = {c: i for i, c in enumerate(self.parts)}
        self.letters = dict(enumerate(byte_letters()))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.follows: dict[tuple[int, int], bool] = {}
        self.counts: dict[str, int] = {}
        # tokens that merging can make, by their letters, inside a word and at its end; and by the last two letters the lengths to try
        self.inner, self.ending = ({}, {}), ({}, {})
        for name, token in self.vocab.items():
            tokens, lengths = self.ending if self.end and name.endswith(self.end) and name != self.end else self.inner
            name = name.removesuffix(self.end) if tokens is self.ending[0] else name
            if self._whole(token):
                tokens[name] = token
                lengths.setdefault(name[-2:], set()).add(len(name))
        for _, lengths in (self.inner, self.ending):
            lengths |= {x: tuple(sorted(v | {1}, reverse=True)) for x, v in lengths.items()}

    def allowed(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side: walks back through the merges that made them, latest first, and
        looks for one across the border that would have come earlier."""
        known = self.follows.get((left, right))
        if known is None:
            known = self.follows[left, right] = self._allowed(left, right)
        return known

    def _allowed(self, left: int, right: int) -> bool:
        # until: across the border only merges of a lower rank than this would have been applied while these two stood there
        a, b, none = left, right, len(self.rank)
        until = none
        while True:
            across = self.joined.get((a, b))
            if across is not None and self.rank[across] < until:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # the side made later is undone first; of one rank the right one, as merging goes from left to right
            if ra > rb:
                until, a = ra, self.parts[a][1]
            else:
                until, b = rb + 1, self.parts[b][0]

    def word(self, piece: str) -> int:
        """Tokens of one pre-token."""
        letters, follows = self.letters, self.follows
        word = piece if PLAIN.fullmatch(piece) else "".join([letters[b] for b in piece.encode()])
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            tokens, lengths = self.ending if i == n else self.inner
            for k in lengths.get(word[i - 2 if i > 1 else 0 : i], ONE):
                token = tokens.get(word[i - k : i]) if k <= i else None
                if token is not None:
                    j = i - k
                    if j:
                        fits = follows.get((last[j], token))
                        if fits is None:
                            fits = self.allowed(last[j], token)
                        if not fits:
                            continue
                    last[i], count[i] = token, count[j] + 1
                    break
        return count[n]

    def _whole(self, token: int) -> bool:
        """Whether merging makes this token from its letters (a token may lie behind merges that take its letters away)."""
        known = self.follows.get((token, -1))
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or self._whole(parts[0]) and self._whole(parts[1]) and self._made(*parts, self.rank[token])
            self.follows[token, -1] = known
        return known

    def _made(self, left: int, right: int, until: int) -> bool:
        a, b = left, right
        while True:
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, self.parts[a][1]
            else:
                until, b = rb + 1, self.parts[b][0]
            across = self.joined.get((a, b))
            if across is not None and self.rank[across] < until:
                return False

    def run(self, text: str) -> int:
        """Tokens of a stretch that begins and ends where the automaton is reset."""
        total, at = 0, 0
        for m in self.special.finditer(text):
            total, at = total + self._plain(text[at : m.start()]) + 1, m.end()
        return total + self._plain(text[at:])

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}")
        counts, total = self.counts, 0
        pieces = self.pieces.findall(text.lower())
        try:
            return sum(map(counts.__getitem__, pieces))
        except KeyError:
            for piece in pieces:
                n = counts.get(piece)
                if n is None:
                    if len(counts) >= KEPT:
                        counts.clear()
                    n = counts[piece] = self.word(piece)
                total += n
            return total

    def summary(self, chunk: str) -> tuple[str, int, str] | str:
        """A chunk's map: (head, count, tail), or the chunk itself if nothing in it resets the automaton."""
        first = RESET.search(chunk)
        if first is None:
            return chunk
        last = max(chunk.rfind(" "), chunk.rfind("\n"), first.start())
        return chunk[: first.start()], self.run(chunk[first.start() : last]), chunk[last + 1 :]

    def compose(self, x: tuple[str, int, str] | str, y: tuple[str, int, str] | str) -> tuple[str, int, str] | str:
        """The map of two neighbouring chunks."""
        if isinstance(x, str) and isinstance(y, str):
            return x + y
        if isinstance(x, str):
            return x + y[0], y[1], y[2]
        if isinstance(y, str):
            return x[0], x[1], x[2] + y
        return x[0], x[1] + self.run(x[2] + y[0]) + y[1], y[2]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text: the maps of its chunks, composed in pairs."""
        if len(text) <= chunk:
            return self.run(text)
        maps = [self.summary(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        whole = maps[0]
        return self.run(whole) if isinstance(whole, str) else self.run(whole[0]) + whole[1] + self.run(whole[2])


ONE = (1,)
PLAIN = regex.compile("[!-~]+")  # bytes that stand for themselves
RESET = regex.compile("[ \n]")  # white space that no normal form joins with its neighbours


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """The transducer of a tokenizer file, once per worker process."""
    with open(path, encoding="utf-8") as f:
        return Transducer(json.load(f))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; ``path`` names a BPE file with word ends that every machine has.

    Whole texts are counted; a null text counts as empty (0 tokens). Ids may be null or repeated; other columns are not read.
    The compiled tables are bounded by the file; each task keeps the counts of a bounded number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [machine.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
