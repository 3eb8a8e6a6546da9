"""Fill-in-middle texts, cut between units that an automaton finds.

Units (lines, words) begin where a small automaton says so. A stretch of text is summed up by what it does to every
state, the state it ends in and the number of units that begin, and two stretches in a row by the composition of
the two. As composition is associative, stretches are scanned at once whatever the state they begin in: blocks of BLOCK
characters side by side in one array, and chunks of CHUNK characters of a giant document in tasks of their own. A
prefix of compositions then gives each stretch its entry state and the units before it, and the k-th unit of a
document is looked up in one block of one chunk.

Texts of at most CHUNK characters never leave their task; of longer ones the chunks are dealt over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, read_table, shuffle_partitions, table_of, with_small_batches

BLOCK = 64
CHUNK = 1 << 15


@dataclass(frozen=True)
class Automaton:
    """step[s][c]: the state after a character of class c in state s; begins[s][c]: whether a unit begins at it. State 0 is the entry of a text."""

    members: str  # characters of class 1, all others are class 0
    step: tuple[tuple[int, ...], ...]
    begins: tuple[tuple[int, ...], ...]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """With a class 2 for the padding of blocks, which changes nothing."""
        n = len(self.step)
        step = np.column_stack([np.array(self.step), np.arange(n)]).astype(np.int8)
        return step, np.column_stack([np.array(self.begins), np.zeros(n)]).astype(np.int32)

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.isin(codes, [ord(c) for c in self.members]).astype(np.int8)


#: A line with its line feed; the last may have none. States: between lines, inside one.
LINES = Automaton("\n", ((1, 0), (1, 0)), ((1, 1), (0, 0)))
#: A word with the blanks after it; blanks before the first word are a unit. States: start, word, blanks.
WORDS = Automaton(" \t\n\x0b\f\r", ((1, 2), (1, 2), (1, 2)), ((1, 1), (0, 0), (1, 0)))


@dataclass(frozen=True)
class Scan:
    """Texts in blocks: their classes, the text of each block, where a text's blocks begin, and per block and state what all blocks of the text up to it do."""

    classes: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    states: np.ndarray
    counts: np.ndarray

    def end(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        """What a whole text does to each state: the state it ends in and the units that begin."""
        n = self.states.shape[1]
        if self.first[text] == self.first[text + 1]:
            return np.arange(n), np.zeros(n, np.int64)
        return self.states[self.first[text + 1] - 1], self.counts[self.first[text + 1] - 1]


def scan(texts: list[str], automaton: Automaton) -> Scan:
    step, begins = automaton.tables()
    n = len(step)
    found = [automaton.classes(t) for t in texts]
    lengths = np.array([len(c) for c in found], np.int64)
    sizes = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    classes = np.full(int(first[-1]) * BLOCK, 2, np.int8)
    for c, at in zip(found, first, strict=False):
        classes[at * BLOCK : at * BLOCK + len(c)] = c
    classes = classes.reshape(-1, BLOCK)
    owner = np.repeat(np.arange(len(texts)), sizes)
    states = np.tile(np.arange(n, dtype=np.int8), (len(classes), 1))
    counts = np.zeros((len(classes), n), np.int64)
    columns = np.ascontiguousarray(classes.T)
    for t in range(BLOCK):  # all blocks a character further, from every state
        c = columns[t][:, None]
        counts += begins[states, c]
        states = step[states, c]
    reach = 1
    while reach < int(sizes.max(initial=0)):  # a block's composition with the one before it, then with two, four, ...
        later = np.flatnonzero(owner[reach:] == owner[:-reach]) + reach
        before = states[later - reach]
        counts[later] = counts[later - reach] + np.take_along_axis(counts[later], before.astype(np.int64), 1)
        states[later] = np.take_along_axis(states[later], before.astype(np.int64), 1)
        reach *= 2
    return Scan(classes, owner, first, lengths, states, counts)


def places(found: Scan, text: np.ndarray, entry: np.ndarray, k: np.ndarray, automaton: Automaton) -> np.ndarray:
    """For each query the place in its text where the k-th unit (from 1) begins, the text being entered in a state; its length where there are fewer."""
    out = found.lengths[text].copy()
    step, begins = automaton.tables()
    open_ = np.flatnonzero((k > 0) & (found.first[text + 1] > found.first[text]))
    if not len(open_):
        return out
    # binary search for the first block up to which k units have begun
    low, high = found.first[text[open_]].copy(), found.first[text[open_] + 1].copy()
    while (low < high).any():
        mid = (low + high) // 2
        enough = found.counts[np.minimum(mid, len(found.counts) - 1), entry[open_]] >= k[open_]
        high = np.where((low < high) & enough, mid, high)
        low = np.where((low < high) & ~enough, mid + 1, low)
    inside = low < found.first[text[open_] + 1]
    open_, block = open_[inside], low[inside]
    begun = block > found.first[text[open_]]
    state = np.where(begun, found.states[block - 1, entry[open_]], entry[open_])
    left = k[open_] - np.where(begun, found.counts[block - 1, entry[open_]], 0)
    for t in range(BLOCK):
        c = found.classes[block, t]
        left = left - begins[state, c]
        hit = (left == 0) & (begins[state, c] == 1)
        out[open_[hit]] = (block[hit] - found.first[text[open_[hit]]]) * BLOCK + t
        state = step[state, c]
    return out


def cuts_of(n: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units before the middle and before the suffix, from two numbers drawn for the document."""
    a, b = r1 % (n + 1), r2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


_DRAWN = ["r1", "r2"]
_DONE = "doc_id long, text string, body string, plain boolean, r4 long, n long, low long, high long"


def _whole_texts(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "body"):
            found = scan(batch.column("body").to_pylist(), automaton)
            n = np.array([int(found.end(t)[1][0]) for t in range(batch.num_rows)], np.int64)
            low, high = cuts_of(n, *[batch.column(r).to_numpy() for r in _DRAWN])
            each, start = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            at = [pa.array(places(found, each, start, k + 1, automaton)) for k in (low, high)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text", "body", "plain", "r4")], pa.array(n), *at], names=["doc_id", "text", "body", "plain", "r4", "n", "low", "high"])

    return run


def _summaries(automaton: Automaton):
    """What each chunk does to every state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "chunk"):
            found = scan(batch.column("chunk").to_pylist(), automaton)
            ends = [found.end(t) for t in range(batch.num_rows)]
            columns = [pa.array(found.lengths), pa.array([e[0].tolist() for e in ends], pa.list_(pa.int32())), pa.array([e[1].tolist() for e in ends], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEY], batch.column("place"), *columns], names=[*_KEY, "place", "length", "states", "counts"])

    return run


_KEY = ["doc", "text_a", "text_b"]
_KEY_TYPES = "doc string, text_a long, text_b long"


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document of chunk summaries in order its n and, for both cuts, the chunk to search, its entry state, the unit to find there and the characters before it."""
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            parts = batch.column("parts")[k].as_py()
            state, units, chars, entries = 0, [0], [0], [0]
            for p in parts:
                units.append(units[-1] + p["counts"][state])
                chars.append(chars[-1] + p["length"])
                state = p["states"][state]
                entries.append(state)
            n = np.array([units[-1]])
            own = [batch.column(c)[k].as_py() for c in _KEY]
            for side, cut in zip(("low", "high"), cuts_of(n, *[np.array([batch.column(r)[k].as_py()]) for r in _DRAWN]), strict=True):
                unit = int(cut[0]) + 1
                at = min(int(np.searchsorted(units, unit)) - 1, len(parts) - 1)  # the first chunk up to which so many units have begun
                rows.append([*own, units[-1], side, parts[at]["place"], entries[at], unit - units[at], chars[at]])
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in _WANTED_ARROW], names=_WANTED_NAMES)


_WANTED_NAMES = [*_KEY, "n", "side", "place", "entry", "unit", "ahead"]
_WANTED_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_WANTED = f"{_KEY_TYPES}, n long, side string, place long, entry long, unit long, ahead long"


def _selected(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "chunk"):
            found = scan(batch.column("chunk").to_pylist(), automaton)
            at = places(found, np.arange(batch.num_rows), batch.column("entry").to_numpy(), batch.column("unit").to_numpy(), automaton)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*_KEY, "n", "side"]], pa.array(at + batch.column("ahead").to_numpy())], names=[*_KEY, "n", "side", "at"])

    return run


def _giants_cut(giants: DataFrame, automaton: Automaton, chunk: int) -> DataFrame:
    """Chunks of giant texts are dealt over the cluster; only their summaries and the chunks with a cut meet again."""
    spread = shuffle_partitions(giants.sparkSession)
    pieces = giants.select(*_KEY, F.posexplode(F.regexp_extract_all("body", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("place", "chunk"))
    pieces = table_of(pieces.withColumn("place", F.col("place").cast("long")).repartition(spread, *_KEY, "place"), "chunks")
    sums = pieces.mapInArrow(_summaries(automaton), f"{_KEY_TYPES}, place long, length long, states array<int>, counts array<long>").dropDuplicates([*_KEY, "place"])
    sums = sums.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("place", "length", "states", "counts"))).alias("parts"))
    drawn = giants.select(*_KEY, *_DRAWN).dropDuplicates(_KEY)
    wanted = table_of(sums.join(drawn, _KEY).select(*_KEY, *_DRAWN, "parts").mapInArrow(_wanted, _WANTED), "wanted-cuts")
    searched = wanted.join(pieces.dropDuplicates([*_KEY, "place"]), [*_KEY, "place"]).select(*_WANTED_NAMES, "chunk")
    at = searched.mapInArrow(_selected(automaton), f"{_KEY_TYPES}, n long, side string, at long")
    cut = lambda side: F.max(F.when(F.col("side") == side, F.col("at")))
    both = table_of(at.groupBy(*_KEY, "n").agg(cut("low").alias("low"), cut("high").alias("high")), "cuts")
    return giants.join(both, _KEY).select("doc_id", "text", "body", "plain", "r4", "n", "low", "high")


def fill_in_middle(
    docs: DataFrame, automaton: Automaton = LINES, seed: int = 7, rate: int = 100, spm_rate: int = 50,
    prefix_mark: str = "<P>", suffix_mark: str = "<S>", middle_mark: str = "<M>", chunk: int = CHUNK,
) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output of every row of docs (doc_id, text).

    rate per cent of the documents are transformed, spm_rate per cent of those in the order suffix, prefix, middle. What is drawn for
    a document depends on seed and doc_id alone, so rows that repeat an id are cut alike where their texts are equal.
    Defined cases: a null or empty text and one that holds a mark are plain, and a plain output is the text (empty for
    null); a null id draws as the word ``null``; a prefix, middle or suffix may be empty; repeated rows get a row each;
    other columns are ignored; an empty table gives no rows. Marks must begin with one character that stands nowhere
    else in any of them, so that restored() can find them again.
    """
    marks = [prefix_mark, suffix_mark, middle_mark]
    if len(set(marks)) < 3 or any(len(m) < 2 or m[0] != marks[0][0] or marks[0][0] in m[1:] for m in marks):
        raise ValueError("marks must differ and begin with one character that stands nowhere else in them")
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    draws = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long").alias(f"r{i + 1}") for i in range(4)]
    rows = with_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", text.alias("body"), *draws)
    plain = F.col("body") == ""
    for m in marks:
        plain = plain | F.contains("body", F.lit(m))
    rows = rows.withColumn("plain", plain | (F.col("r3") % 100 >= rate))
    short = rows.where(F.length("body") <= chunk).select("doc_id", "text", "body", "plain", *_DRAWN, "r4").mapInArrow(_whole_texts(automaton), _DONE)
    giants = rows.where(F.length("body") > chunk).withColumn("doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    giants = giants.withColumn("text_a", F.xxhash64("body")).withColumn("text_b", F.xxhash64(F.lit("b"), "body"))
    done = short.unionByName(_giants_cut(giants, automaton, chunk))

    form = F.when(F.col("plain"), "plain").when(F.col("r4") % 100 < spm_rate, "spm").otherwise("psm")
    prefix, middle, suffix = F.expr("substring(body, 1, low)"), F.expr("substring(body, low + 1, high - low)"), F.expr("substring(body, high + 1)")
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", F.col("body")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return done.withColumn("form", form).select(
        "doc_id", "text", "n", "form", F.when(cut, F.col("low")).alias("prefix_chars"), F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output")
    )


def restored(output: str = "output", form: str = "form", prefix_mark: str = "<P>", suffix_mark: str = "<S>", middle_mark: str = "<M>") -> Column:
    """The text that an output was made of."""
    def parts(opened: str, then: str) -> list[Column]:
        """What stands after the opening mark, after the second one and after that of the middle."""
        rest = F.substring(F.col(output), len(opened) + 1, 1 << 30)
        after = F.substring_index(rest, then, -1)
        return [F.substring_index(rest, then, 1), F.substring_index(after, middle_mark, 1), F.substring_index(after, middle_mark, -1)]

    (prefix, suffix, middle), (suffix_first, prefix_second, middle_third) = parts(prefix_mark, suffix_mark), parts(suffix_mark, prefix_mark)
    whole = F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(prefix_second, middle_third, suffix_first))
    return whole.otherwise(F.col(output))


def op12_fill_in_middle(spark, sf_dir):
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE_SQL = {
    "op12_fill_in_middle": r"""
WITH base AS (
  SELECT doc_id, coalesce("text", '') AS body, regexp_extract_all(coalesce("text", ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM base
),
formed AS (
  SELECT doc_id, body, n, units, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT doc_id, n, form, body, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
""",
}
QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
