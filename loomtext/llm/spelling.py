"""Words that are one edit apart, by merging the subtrees of a trie with one character skipped or replaced.

The words form a trie. At a node the child with most words below it is heavy, its siblings are light; a word has few
light edges on its way from the root, as each at least halves the words below. Where two words differ by one edit,
they part at a node, and at least one of them goes on by a light edge or ends there. So at each node only the light
subtrees are merged: into their siblings with the first character replaced, into the node itself with it skipped, and into the
heavy child with its character put in front. Of each word below a light edge a merge makes one string, and terminals that
coincide are equal strings, so every merge of every node is done at once by joins on equality:

- replaced by the heavy character, or with the heavy character put in front: the word itself, looked up among the words;
- skipped, where the character is the last of its run (each skip counts once): looked up among the words;
- light siblings among each other: equal strings left after the character at the same place; they differ in that character only;
- a word that ends at a node, with the heavy character added: looked up among the words.

That is at most 4 * log2(words) strings a word, small subtrees into large ones, and each pair of near words comes from
one of them once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, join_counted, read_table, table_of, with_small_batches

RUN = r"[A-Za-zÀ-ÿ]+"
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A task's counts are sent on when they hold so many words or characters.
HELD_WORDS, HELD_CHARS = 200_000, 8 << 20


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_ASCII)


def runs_of(text: str, pattern: re.Pattern) -> Counter:
    """Maximal runs of a text, A-Z in lower case, with their numbers."""
    raw: Counter = Counter()
    found = (m.group() for m in pattern.finditer(text))
    while some := list(islice(found, 1 << 16)):
        raw.update(some)
    out: Counter = Counter()
    for run, n in raw.items():
        out[lowered(run)] += n
    return out


def slipped(doc_id: int | None, run: str, one_in: int) -> str:
    """The run as the document has it: in one of so many (by crc32 of id and run) a character is missing. 0: never."""
    if not one_in:
        return run
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, min_chars: int = 5, min_count: int = 3, one_in: int = 0, pattern: str = RUN) -> DataFrame:
    """word, n of the words of min_chars code points or more that docs (doc_id, text) hold min_count times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, held, size = re.compile(pattern), Counter(), 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in by_bytes(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in runs_of(text or "", compiled).items():
                    word = slipped(doc_id, word, one_in)
                    if len(word) >= min_chars:
                        size += len(word) if word not in held else 0
                        held[word] += n
                if len(held) >= HELD_WORDS or size >= HELD_CHARS:
                    yield sent()
                    held.clear()
                    size = 0
        yield sent()

    rows = with_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _node(word: str) -> bytes:
    return xxhash.xxh3_128_digest(word.encode())


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edge on the way of each word: the nodes at both ends (128 bits of their prefix), the character and its place."""
    names = ["id", "place", "letter", "parent", "child"]
    for batch in by_bytes(batches, "word", 1 << 16):
        rows: tuple[list, ...] = ([], [], [], [], [])
        for word, own in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist(), strict=True):
            h = xxhash.xxh3_128()
            at = [h.digest()]
            for c in word:
                h.update(c.encode())
                at.append(h.digest())
            for column, values in zip(rows, ([own] * len(word), range(len(word)), word, at[:-1], at[1:]), strict=True):
                column.extend(values)
        kinds = [pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)


def merged_strings(word: str, light: list[tuple[int, str]], ends: str | None) -> Iterator[tuple[int, str]]:
    """(place, string) of the merges a word takes part in. light: the places of its light edges with the heavy character there; ends: the heavy character below its own node.

    Place -1: looked up among the words; otherwise met with the strings of light siblings.
    """
    for i, heavy in light:
        rest = word[i + 1 :]
        yield -1, word[:i] + heavy + rest
        yield -1, word[:i] + heavy + word[i:]
        if not rest.startswith(word[i]):
            yield -1, word[:i] + rest
        yield i, word[:i] + rest
    if ends is not None:
        yield -1, word + ends


def _merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "n", "place", "string"]
    for batch in by_bytes(batches, "word", 1 << 16):
        rows: tuple[list, ...] = ([], [], [], [])
        for word, n, light, ends in zip(*[batch.column(c).to_pylist() for c in ("word", "n", "light", "ends")], strict=True):
            for place, string in merged_strings(word, [(s["place"], s["heavy"]) for s in light or []], ends):
                for column, value in zip(rows, (word, n, place, string), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word of the near word of largest n; ties: first in code-point order) of the words (distinct, with n) that have a near word.

    An empty word has no place in the trie and no near word. Its rows must be distinct words.
    """
    named = table_of(words.where("word <> ''").mapInArrow(_named, "id binary, word string, n long"), "words")
    steps = table_of(named.select("id", "word").mapInArrow(_steps, "id binary, place int, letter string, parent binary, child binary"), "trie-edges")
    nodes = steps.groupBy("child").agg(F.count("*").alias("weight"), F.first("parent").alias("parent"), F.first("letter").alias("letter"))
    nodes = table_of(nodes, "trie-nodes")
    heavy = nodes.groupBy("parent").agg(F.max_by("letter", F.struct("weight", "letter")).alias("heavy"), F.count("*").alias("children"))
    heavy = table_of(heavy, "heavy-children")
    light = table_of(nodes.join(heavy.where("children > 1"), "parent").where("letter <> heavy").select("child", "heavy", "weight"), "light-children")
    below = join_counted(steps.select("id", "place", "child"), light, ["child"], named.count(), share=1 << 10)
    lights = below.groupBy("id").agg(F.collect_list(F.struct("place", "heavy")).alias("light"))  # log2(words) at most
    ends = heavy.select(F.col("parent").alias("id"), F.col("heavy").alias("ends"))
    whole = named.join(lights, "id", "left").join(ends, "id", "left").select("word", "n", "light", "ends")
    strings = table_of(whole.mapInArrow(_merges, "word string, n long, place int, string string"), "merges")

    rank = lambda n, word: F.struct((-F.col(n)).alias("m"), F.col(word).alias("word"))
    met = strings.where("place < 0").join(named.select(F.col("word").alias("string"), F.col("n").alias("n_other")), "string")
    met = met.select(F.explode(F.array(F.struct("word", F.lit(1).cast("long").alias("n_near"), rank("n_other", "string").alias("best")), F.struct(F.col("string").alias("word"), F.lit(1).cast("long").alias("n_near"), rank("n", "word").alias("best")))).alias("x")).select("x.*")
    # light siblings with one string: as many as the alphabet has letters, each near to all others, so no pair is written out
    siblings = strings.where("place >= 0").groupBy("place", "string").agg(F.array_sort(F.collect_list(rank("n", "word"))).alias("all")).where(F.size("all") > 1)
    each = siblings.select("all", F.posexplode("all").alias("at", "own"))
    each = each.select(F.col("own.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("at") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    return met.unionByName(each).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_node(w) for w in batch.column("word").to_pylist()], pa.binary()), batch.column("word"), batch.column("n")], names=["id", "word", "n"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of forms (word, form) that has a form, by pointers that jump twice as far each round. No chain may lead back."""
    at = table_of(forms.where("form is not null").select("word", F.col("form").alias("root")), "pointers")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = table_of(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_variants(words: DataFrame, times: float = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word, n; distinct).

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near
    word of largest n (ties: the first in code-point order) if that n is at least times the word's own; root is the end of the chain of forms.
    Defined cases: a word without near words, or whose near words are rare, has no form and is its own root; null and empty
    words are left out; an empty table gives no rows; other columns are ignored. times must be more than 1, so chains end.
    """
    if times <= 1:
        raise ValueError("chains of forms end only if a form is more frequent than its word")
    words = table_of(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n")), "counted-words")
    found = words.join(near_words(words), "word", "left")
    form = F.col("best.m") <= -times * F.col("n")
    found = table_of(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n")), "forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(word_counts(read_table(spark, sf_dir, "documents"), one_in=97))


#: CRC-32 is spelled out, as DuckDB has no function for it.
ORACLE_SQL = {
    "op13_spelling_variants": r"""
WITH RECURSIVE bits AS (
  SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all("text", '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
),
in_doc AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS h FROM runs GROUP BY doc_id, w),
summed AS (
  SELECT w, n, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM in_doc, crc_table
),
slipped AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, (crc % length(w))::BIGINT) || substr(w, (crc % length(w))::BIGINT + 2) ELSE w END AS word, n FROM summed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
shorter AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM cut),
near AS (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.s = b.word
  UNION
  SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.s = b.word
),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS m FROM near GROUP BY word
),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
),
chain AS (
  SELECT word, word AS "last", 0 AS k FROM forms
  UNION ALL
  SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON c."last" = f.word WHERE f.form IS NOT NULL
),
ends AS (SELECT word, arg_max("last", k) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN ends e ON f.word = e.word
""",
}
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
