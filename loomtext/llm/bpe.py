"""Exact BPE encoding and decoding by dynamic programming over prefixes.

BPE has the property that the tokens of a prefix of a word are the first tokens of some encoding: for every prefix
there is one last token, and the encoding of the word follows from the back-pointers. The tokens that end at a
place are found with the suffix automaton of the vocabulary: its state is the longest stretch that ends there and occurs in
any token, and suffix links lead from it to the tokens that the stretch ends with. Of those, the last token of the prefix
is the one whose boundary with the last token of the rest holds: no merge across the boundary would have come
before the merges that made the two tokens.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, read_table, with_small_batches
from .packing import _byte_alphabet

# White space as the tokenizer's patterns see it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bounds of what a Python worker remembers: bytes of units with their ids (about), characters of such a unit, and pairs of tokens.
KNOWN_BYTES = 128 << 20
KNOWN_CHARS = 256
KNOWN_PAIRS = 500_000
_ENTRY_BYTES = 200
_NEVER = 1 << 30


class TokenAutomaton:
    """Suffix automaton of many strings, with the string that each state stands for.

    A string is the longest of its state, as nothing comes before its own first character; so a state stands for one at most.
    """

    def __init__(self, strings: dict[str, int]):
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = {self._add(text): i for text, i in strings.items()}
        self.token = [ends.get(v, -1) for v in range(len(self.moves))]
        self.up = [0] * len(self.moves)  #: the nearest state up the suffix links that stands for a string, 0 for none
        for v in sorted(range(1, len(self.moves)), key=self.length.__getitem__):
            above = self.link[v]
            self.up[v] = above if self.token[above] >= 0 else self.up[above]

    def _state(self, length: int, moves: dict[str, int], link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.moves) - 1

    def _split(self, p: int, c: str) -> int:
        """The state that c leads to from p, made one whose longest string is p's with c."""
        q = self.moves[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.moves[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = twin
            p = self.link[p]
        return twin

    def _add(self, text: str) -> int:
        last = 0
        for c in text:
            if c in self.moves[last]:
                last = self._split(last, c)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and c not in self.moves[p]:
                self.moves[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new
        return last


class WordBpe:
    """Encoder and decoder for a BPE file with word ends: NFC, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        end = model["end_of_word_suffix"]
        marked = {name: f"{name[: -len(end)]} " if name.endswith(end) else name for name in vocab}  # a blank marks a word's end
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.made = [-1] * len(self.names)  # rank of the merge that makes a token
        self.parts: list[tuple[int, int] | None] = [None] * len(self.names)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = vocab[left], vocab[right]
            new = vocab[left + right]
            self.merge_rank[a, b] = rank
            if self.parts[new] is None:
                self.made[new], self.parts[new] = rank, (a, b)
        self._holds: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._known_bytes = 0
        self.byte_names = {b: c for c, b in _byte_alphabet().items()}
        self.automaton = TokenAutomaton({marked[name]: i for name, i in vocab.items() if name not in self.special and self._reached(i)})
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.gap = regex.compile(rf"[{_SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")  # white space for Python alone
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _reached(self, token: int) -> bool:
        """Whether merging the token's own characters ends in the token."""
        return self.parts[token] is None or self._survives(*self.parts[token], self.made[token])

    def _survives(self, x: int, y: int, until: int) -> bool:
        """Whether no merge across the boundary between x and y comes before the one numbered until."""
        x_ends = y_ends = until
        while True:
            rank = self.merge_rank.get((x, y), _NEVER)
            if rank < x_ends and rank <= y_ends and rank < until:
                return False
            if self.parts[x] is None and self.parts[y] is None:
                return True
            if self.made[y] >= self.made[x]:  # the later merge is undone first; of equal ones the right is later
                y_ends, y = self.made[y], self.parts[y][0]
            else:
                x_ends, x = self.made[x], self.parts[x][1]

    def holds(self, a: int, b: int) -> bool:
        """Whether the boundary between tokens a and b survives all merges."""
        key = a << 20 | b
        if (known := self._holds.get(key)) is None:
            if len(self._holds) >= KNOWN_PAIRS:
                self._holds.clear()
            known = self._holds[key] = self._survives(a, b, _NEVER)
        return known

    def word(self, symbols: str) -> list[int]:
        """Token ids of one word in the byte alphabet."""
        n = len(symbols)
        last: list[int] = [-1] * (n + 2)
        begin = [0] * (n + 2)
        holds = self._holds
        moves, link, length, token, up = self.automaton.moves, self.automaton.link, self.automaton.length, self.automaton.token, self.automaton.up
        state = matched = 0
        for e, c in enumerate(symbols + " ", 1):
            while (to := moves[state].get(c)) is None and state:
                state = link[state]
                matched = length[state]
            state, matched = (0, 0) if to is None else (to, matched + 1)
            if e == n:
                continue  # the last symbol of a word is the one with the mark
            v = state if matched == length[state] and token[state] >= 0 else up[state]
            while v:
                j = e - length[v]
                if j == 0:
                    last[e] = token[v]
                    break
                before = last[j]
                if before >= 0:
                    known = holds.get(before << 20 | token[v])
                    if self.holds(before, token[v]) if known is None else known:
                        last[e], begin[e] = token[v], j
                        break
                v = up[v]
        out, e = [], n + 1
        while e > 0:
            out.append(last[e])
            e = begin[e]
        return out[::-1]

    def unit(self, text: str) -> bytes:
        """Ids of a stretch without white space, little-endian."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        ids: list[int] = []
        for w in self.pattern.findall(text):
            ids += self.word(w if w.isascii() and w.isprintable() else "".join([self.byte_names[b] for b in w.encode()]))
        return np.array(ids, "<u4").tobytes()

    def plain(self, text: str) -> list[bytes]:
        """Ids of a text without special tokens."""
        known = self._known
        units = [u for u in self.gap.split(text) if u] if self.odd.search(text) else text.split()
        out = []
        for u in units:
            if (ids := known.get(u)) is None:
                ids = self.unit(u)
                if len(u) <= KNOWN_CHARS:
                    self._known_bytes += 4 * len(u) + len(ids) + _ENTRY_BYTES
                    if self._known_bytes > KNOWN_BYTES:
                        known.clear()
                        self._known_bytes = 0
                    known[u] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        if self.specials is None or "<|" not in text:
            return b"".join(self.plain(text))
        out: list[bytes] = []
        for part in self.specials.split(text):
            out += [np.array([self.special[part]], "<u4").tobytes()] if part in self.special else self.plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_coders: dict[str, WordBpe] = {}


def bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every whole text.

    Defined cases: a null or empty text has no tokens and decodes to the empty text; a null id stays null; repeated
    rows get a row each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.get(tokenizer) or _coders.setdefault(tokenizer, WordBpe(tokenizer))
        for batch in by_bytes(batches, "text"):
            ids = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return with_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As bpe_round_trip, with hashes in place of the ids and the decoded text: made where the ids are, so neither travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.get(tokenizer) or _coders.setdefault(tokenizer, WordBpe(tokenizer))
        for batch in by_bytes(batches, "text"):
            ids = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            sums = [hashlib.sha256(x).hexdigest() for x in ids]
            decoded = [hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return with_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_prefix_bpe(spark, sf_dir):
    return bpe_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op7_prefix_bpe": op7_prefix_bpe}
