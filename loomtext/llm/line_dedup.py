"""Lines that repeat across documents are kept in one document only.

Every text is exploded into lines; a line is known by the hash of its normalised form (its key). Keys are counted by
the documents that hold them, and those in too many lose their lines everywhere but in the document with the smallest
id. What goes is a list of positions for each document, so texts themselves are shuffled once: to meet that list and
be put together again from the lines between the dropped ones.

The count is combined before its shuffle, and a line that fills the corpus is joined by broadcast, so no task gets a
group that grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, read_table, table_of

BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where rows without an id stand among documents: after all others, as one document.
NO_ID = (1 << 63) - 1


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    """A line without the blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _digest(prefix: str, value: Column) -> list[Column]:
    """128 bits of a text, as two columns."""
    return [F.xxhash64(value).alias(f"{prefix}a"), F.xxhash64(F.lit(prefix), value).alias(f"{prefix}b")]


def _without(text: Column, dropped: Column) -> Column:
    """text without its lines at the positions dropped (ascending, from 0): the stretches between them, in order."""
    def kept(s: Column) -> Column:
        stretch = lambda i: F.slice(
            s["lines"],
            F.when(i == 0, 1).otherwise(F.try_element_at(s["dropped"], i) + 2),
            F.coalesce(F.try_element_at(s["dropped"], i + 1), F.size(s["lines"])) - F.when(i == 0, 0).otherwise(F.try_element_at(s["dropped"], i) + 1),
        )
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["dropped"])), stretch))

    # the struct in an array is there for the lambda, so that the text is split once
    one = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), dropped.alias("dropped")))
    return F.array_join(F.flatten(F.transform(one, kept)), "\n")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_documents: int = 2) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with the text that is left, n_lines (before) and n_dropped.

    A key of min_chars code points or more that min_documents documents or more hold loses all its lines except in the
    smallest doc_id holding it, which keeps all of them.
    Defined cases: a null or empty text is one empty line and comes back empty; a text all of whose lines go comes back
    empty; rows that repeat an id are one document; rows without an id are one document after all others; other columns stay
    (but for those named n_lines and n_dropped, which are replaced); an empty table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    known = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), *_digest("text_", text)]
    at = ["doc", "text_a", "text_b"]
    each = docs.select(*known, F.posexplode(F.split(text, "\n", -1)).alias("place", "line")).withColumn("line", line_key(F.col("line")))
    lines = table_of(each.where(F.length("line") >= min_chars).select(*at, "place", *_digest("key_", F.col("line"))), "lines")

    key = ["key_a", "key_b"]
    per_key = [F.min("doc").alias("keeper"), F.count("*").alias("weight")]
    if min_documents == 2:  # the smallest and the largest id tell whether there are two
        repeated = lines.groupBy(*key).agg(*per_key, F.max("doc").alias("last")).where("keeper < last")
    else:
        held = lines.groupBy(*key, "doc").agg(F.count("*").alias("n")).groupBy(*key)
        repeated = held.agg(F.min("doc").alias("keeper"), F.sum("n").alias("weight"), F.count("*").alias("documents")).where(F.col("documents") >= min_documents)
    repeated = table_of(repeated.select(*key, "keeper", "weight"), "repeated-lines")
    gone = join_counted(lines, repeated, key, lines.count()).where(F.col("doc") != F.col("keeper"))
    dropped = table_of(gone.groupBy(*at).agg(F.array_sort(F.collect_set("place")).alias("dropped")), "dropped-lines")

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), text.alias("body"), *known)
    kept = F.when(F.col("dropped").isNull(), F.col("body")).otherwise(_without(F.col("body"), F.col("dropped")))
    n_lines = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1
    return whole.join(dropped, at, "left").select(
        *[F.col("row").getField(c).alias(c) for c in own], kept.alias("text"), n_lines.cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
    )


def op11_line_dedup(spark, sf_dir):
    return drop_repeated_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op11_line_dedup": r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents
),
each AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
),
repeated AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
),
marked AS (
  SELECT e.doc_id, e.place, e.line, r.keeper IS NOT NULL AND r.keeper <> e.doc_id AS gone FROM keyed e LEFT JOIN repeated r ON e.k = r.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
QUERIES = {"op11_line_dedup": op11_line_dedup}
