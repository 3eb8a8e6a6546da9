"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A document is parsed greedily
into the longest pieces that occur in that sample; the language that needs the fewest pieces for the document's
length wins. The parse only follows the automaton's transitions, so all automata are walked for many stretches
of text at once, one character a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, carried, in_fold, read_table

#: The bound of the sample: so many labelled documents of a language, lowest hash first, and so many of their characters.
SAMPLE_DOCS = 48
SAMPLE_CHARS = 24_000
#: So many times its share of the characters a document may give where others are short.
SHARES = 8
#: Text is parsed in stretches of so many characters; a stretch's first piece starts anew.
STRETCH = 256
#: How sharply the shares of the piece rates are turned into a score.
SHARPNESS = 8.0
UNKNOWN = "und"

_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_letters long, pieces array<long>"


def simplified(text: str) -> np.ndarray:
    """Code points in lower case; whatever is no letter is a blank."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters(codes), codes, np.uint32(32))


_KNOWN_LETTERS = np.zeros(0x110000, np.int8)  # 0: not asked yet, 1: letter, 2: none


def _letters(codes: np.ndarray) -> np.ndarray:
    kinds = _KNOWN_LETTERS[codes]
    if not kinds.all():
        for c in np.unique(codes[kinds == 0]):
            _KNOWN_LETTERS[c] = 1 if chr(c).isalpha() else 2
        kinds = _KNOWN_LETTERS[codes]
    return kinds == 1


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text, state 0 first."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Transitions:
    """The transitions of all automata by state and character, in open addressing: memory in proportion to the samples, whatever their alphabets."""

    def __init__(self, states: np.ndarray, chars: np.ndarray, to: np.ndarray):
        keys = states.astype(np.int64) << 21 | chars
        bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of several, the last stays
            here = self.keys[slot[left]] == keys[left]
            self.to[slot[left[here]]] = to[left[here]]
            left = left[~here]
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is no transition."""
        keys = states.astype(np.int64) << 21 | chars
        slot = self._slots(keys)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return np.where(self.keys[slot] == keys, self.to[slot], -1)


class CrossParser:
    """The automata of all languages; where one has no transition, a piece ends and the next one begins with the character."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        states, chars, to, self.starts, base = [], [], [], [], 0
        for lang in self.langs:
            moves = suffix_automaton(simplified(samples[lang]).tolist())
            for s, out in enumerate(moves):
                states += [base + s] * len(out)
                chars += out.keys()
                to += [base + q for q in out.values()]
            self.starts.append((base, base + len(moves)))  # the second: after a character that the sample lacks, a piece of its own
            base += len(moves) + 1
        self.table = Transitions(np.array(states, np.int64), np.array(chars, np.int64), np.array(to, np.int32))

    def pieces(self, texts: list[np.ndarray]) -> np.ndarray:
        """Pieces for each text and language."""
        lengths = np.array([len(t) for t in texts], np.int64)
        stretches = (lengths + STRETCH - 1) // STRETCH
        owner = np.repeat(np.arange(len(texts)), stretches)
        first = np.repeat(np.cumsum(lengths) - lengths, stretches)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        begin = first + nth * STRETCH
        size = np.minimum(np.repeat(lengths, stretches) - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        flat = np.concatenate(texts).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        alive = np.searchsorted(-size, -np.arange(STRETCH), side="left")  # how many stretches are longer than t
        found = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, (start, lost) in enumerate(self.starts):
            state = np.full(len(owner), start, np.int32)
            ends = np.ones(len(owner), np.int32)  # the piece under way at the end
            for t in range(STRETCH):
                n = alive[t]
                if not n:
                    break
                c = flat[begin[:n] + t]
                to = self.table.follow(state[:n], c)
                none = np.flatnonzero(to < 0)
                if len(none):  # a piece ends before this character, but for the first of a stretch
                    ends[none] += state[none] != start
                    to[none] = self.table.follow(np.full(len(none), start), c[none])
                    to[to < 0] = lost
                state[:n] = to
            found[:, k] = np.bincount(owner, ends, minlength=len(texts))
        return found


def sample_texts(docs: DataFrame, per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A bounded sample of each language: a stretch of chars / per_lang characters of each of per_lang documents.

    The documents are those with letters whose id has the lowest hash; rows that repeat an id count as one. A stretch begins
    at a hashed place and is cut before it leaves Spark. Where texts are short or few, more of each is taken,
    up to SHARES times its share, until the language has its characters.
    """
    share = chars // per_lang
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    once = rows.groupBy("lang", "doc_id", "h").agg(F.min("t").alias("t"))
    picked = once.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= per_lang).select("lang", "doc_id", "r", "t")
    spare = F.greatest(F.length("text") - SHARES * share, F.lit(0)) + 1
    cut = F.substring("text", (F.pmod(F.col("t"), spare.cast("long")) + 1).cast("int"), F.lit(SHARES * share))
    texts = docs.select("doc_id", "lang", F.xxhash64("text").alias("t"), "text").join(F.broadcast(picked), ["doc_id", "lang", "t"])  # per_lang rows a language
    got = texts.select("lang", "r", cut.alias("part")).distinct().collect()
    found: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.r, r.part)):
        found.setdefault(r.lang, []).append(r.part)
    out = {}
    for lang, parts in found.items():
        size = share
        while size < SHARES * share and sum(min(len(p), size) for p in parts) < chars:
            size += share
        out[lang] = " ".join(p[:size] for p in parts)[:chars]
    return out


_parsers: dict[int, CrossParser] = {}


def identify_languages(docs: DataFrame, learn_from: DataFrame, held_out=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text of docs (doc_id, text) from learn_from (doc_id, text, lang).

    Returns doc_id, held_out, lang_pred, score (0 to 1), n_letters and pieces (for each language in order of name), and
    the columns of docs named in carry, as they are.
    Defined cases: a null text, or one without letters, is ``und`` with score 0; so is everything if nothing can be
    learned; ties between languages go to the first in order of name; repeated rows get a row each; other columns
    are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sample_texts(learn_from))  # SAMPLE_CHARS for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parsers.get(key := hash(tuple(sorted(sent.value.items()))))
        if parser is None:
            _parsers.clear()
            parser = _parsers[key] = CrossParser(sent.value)
        for batch in by_bytes(batches, "text"):
            texts = [simplified(t or "") for t in batch.column("text").to_pylist()]
            n_letters = np.array([int(np.count_nonzero(t != 32)) for t in texts], np.int64)
            found = parser.pieces(texts)
            if parser.langs and len(texts):
                rate = found / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]
                share = np.exp(-SHARPNESS * (rate / np.maximum(rate.min(axis=1, keepdims=True), 1e-9) - 1))
                best = found.argmin(axis=1)
                score = share[np.arange(len(texts)), best] / share.sum(axis=1)
                known = n_letters > 0
                preds = [parser.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, score, 0.0)
            else:
                preds, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(score), pa.array(n_letters), pa.array(found.tolist(), pa.list_(pa.int64())), *[batch.column(f"carry_{c}") for c in carry]],
                names=["doc_id", "held_out", "lang_pred", "score", "n_letters", "pieces", *[f"carry_{c}" for c in carry]],
            )

    out = F.lit(None).cast("boolean") if held_out is None else held_out
    return carried(docs, out, carry, run, _SCHEMA)


def op2_cross_parsing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return identify_languages(docs, docs.where(~in_fold("doc_id", 5, 0)), in_fold("doc_id", 5, 0))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op2_cross_parsing": op2_cross_parsing}
