"""Graph tables derived from documents by rule, so that every graph operator has input; SQL repeats the same rules.

Every third sentence is a chunk; a chunk is linked to the one before it and to another earlier one; levels follow from
the token count. Ids come from the document's id and the sentence's place, without a global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.cluster import kept
from loomtext.functions.sentences import sentences
from loomtext.operators.weights import with_edge_weights, with_node_weights

BUDGET = 200
IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentence_rows(spark: SparkSession, sf_dir: str, budget: int = BUDGET) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id", budget=budget)


def _level(tokens: str, n: int, words: list[str]) -> Column:
    out = None
    for k, w in enumerate(words):
        test = F.col(tokens) % n == k
        out = F.when(test, w) if out is None else out.when(test, w)
    return out


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentence_rows(spark, sf_dir).where("sentence_index % 3 = 0")
    rows = s.select(
        (F.col("chapter_id") * IDS + F.col("sentence_index")).alias("id"), F.col("fragment_id").alias("generation"), "chapter_id", "fragment_id", "sentence_index",
        F.substring("text", 1, 12).alias("label"), F.col("text").alias("content"),
        _level("token_count", 5, ["verbatim", "detailed", "focused", "relevant"]).alias("retention"),
        _level("token_count", 4, ["critical", "important", "helpful"]).alias("importance"), F.col("token_count").alias("tokens"),
    )
    return with_node_weights(rows)


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_rows without their texts, written once for queries that read them several times."""
    return kept(chunk_rows(spark, sf_dir).drop("content"))


def chunk_sentence_rows(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None) -> DataFrame:
    """A chunk covers its sentence and the next one of the fragment."""
    s = sentence_rows(spark, sf_dir).select("chapter_id", "fragment_id", "sentence_index")
    own = s.where("sentence_index % 3 = 0").withColumn("chunk_id", F.col("chapter_id") * IDS + F.col("sentence_index"))
    own = own if chunks is None else chunks.select("chapter_id", "fragment_id", "sentence_index", F.col("id").alias("chunk_id"))
    after = s.where("sentence_index % 3 = 1").join(own.select("chapter_id", "fragment_id", (F.col("sentence_index") + 1).alias("sentence_index"), "chunk_id"), ["chapter_id", "fragment_id", "sentence_index"])
    return own.select("chunk_id", "chapter_id", "fragment_id", "sentence_index").unionByName(after)


def edge_rows(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None) -> DataFrame:
    c = (chunk_rows(spark, sf_dir) if chunks is None else chunks).select("id", "chapter_id", "sentence_index", "tokens", (F.col("sentence_index") / 3).cast("int").alias("ord"))
    to = F.explode(F.array(F.col("ord") - 1, F.col("ord") - 2 - F.col("tokens") % 3)).alias("to_ord")
    linked = c.select("id", "chapter_id", "tokens", to).where("to_ord >= 0")
    return linked.select(F.col("id").alias("from_id"), (F.col("chapter_id") * IDS + F.col("to_ord") * 3).alias("to_id"), _level("tokens", 4, ["critical", "important", "helpful"]).alias("strength"))


def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edge_weights(chunk_rows(spark, sf_dir), edge_rows(spark, sf_dir))


def group_rows(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None) -> DataFrame:
    """Two fragments a group."""
    return (chunk_rows(spark, sf_dir) if chunks is None else chunks).select("chapter_id", (F.col("fragment_id") / 2).cast("int").alias("group_id"), "fragment_id").distinct()


def member_rows(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None) -> DataFrame:
    """Chains by rule: the chunks of a group with one remainder of their place by 3."""
    c = (chunk_rows(spark, sf_dir) if chunks is None else chunks).select("id", "chapter_id", "fragment_id", "sentence_index")
    group, local = (F.col("fragment_id") / 2).cast("int"), F.expr("(sentence_index div 3) % 3")
    rows = c.select("chapter_id", group.alias("group_id"), local.cast("int").alias("local_snake_id"), F.col("id").alias("chunk_id"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("chapter_id", "group_id", "local_snake_id").orderBy("chunk_id")) - 1
    return rows.withColumn("position", place).withColumn("snake_id", F.col("chapter_id") * IDS + F.col("group_id") * 10 + F.col("local_snake_id"))


#: The same tables for DuckDB.
BASE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id AS chapter_id,
         list_filter(list_transform(regexp_extract_all(coalesce("text", ''), '([^.!?\n]+[.!?]*)', 1), lambda x: trim(x)), lambda x: x <> '') AS ss
  FROM documents
),
sent AS MATERIALIZED (
  SELECT chapter_id, i::INT AS sentence_index, ss[i + 1] AS text, ((length(ss[i + 1]) + 3) // 4)::INT AS token_count
  FROM (SELECT chapter_id, ss, unnest(range(len(ss))) AS i FROM split)
),
pack AS (
  SELECT chapter_id, sentence_index, 0 AS fragment_id, token_count AS run FROM sent WHERE sentence_index = 0
  UNION ALL
  SELECT s.chapter_id, s.sentence_index, CASE WHEN p.run + s.token_count > 200 THEN p.fragment_id + 1 ELSE p.fragment_id END,
         CASE WHEN p.run + s.token_count > 200 THEN s.token_count ELSE p.run + s.token_count END
  FROM pack p JOIN sent s ON s.chapter_id = p.chapter_id AND s.sentence_index = p.sentence_index + 1
),
s AS MATERIALIZED (SELECT sent.*, pack.fragment_id::INT AS fragment_id FROM sent JOIN pack USING (chapter_id, sentence_index)),
c AS MATERIALIZED (
  SELECT *, (CASE retention WHEN 'verbatim' THEN 27 WHEN 'detailed' THEN 9 WHEN 'focused' THEN 3 WHEN 'relevant' THEN 1 ELSE 0 END
    + CASE importance WHEN 'critical' THEN 9 WHEN 'important' THEN 3 WHEN 'helpful' THEN 1 ELSE 0 END)::DOUBLE AS weight
  FROM (
    SELECT chapter_id * 1000000 + sentence_index AS id, fragment_id AS generation, chapter_id, fragment_id, sentence_index,
           "left"(text, 12) AS label, text AS content,
           CASE token_count % 5 WHEN 0 THEN 'verbatim' WHEN 1 THEN 'detailed' WHEN 2 THEN 'focused' WHEN 3 THEN 'relevant' END AS retention,
           CASE token_count % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'important' WHEN 2 THEN 'helpful' END AS importance, token_count AS tokens
    FROM s WHERE sentence_index % 3 = 0)
),
cs AS (
  SELECT id AS chunk_id, chapter_id, fragment_id, sentence_index FROM c
  UNION ALL
  SELECT c.id, s.chapter_id, s.fragment_id, s.sentence_index FROM s JOIN c ON s.chapter_id = c.chapter_id AND s.fragment_id = c.fragment_id AND s.sentence_index = c.sentence_index + 1
),
e AS MATERIALIZED (
  SELECT id AS from_id, chapter_id * 1000000 + o * 3 AS to_id,
         CASE tokens % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'important' WHEN 2 THEN 'helpful' END AS strength,
         CASE tokens % 4 WHEN 0 THEN 9.0 WHEN 1 THEN 3.0 ELSE 1.0 END::DOUBLE AS st
  FROM (SELECT id, chapter_id, tokens, unnest([sentence_index // 3 - 1, sentence_index // 3 - 2 - tokens % 3]) AS o FROM c) WHERE o >= 0
),
inc AS (SELECT id, sum(st) AS total FROM (SELECT from_id AS id, st FROM e UNION ALL SELECT to_id, st FROM e) GROUP BY 1),
w AS MATERIALIZED (
  SELECT e.*, greatest(a.weight * st / ia.total + b.weight * st / ib.total, 0.1::DOUBLE) AS weight
  FROM e JOIN c a ON a.id = from_id JOIN c b ON b.id = to_id JOIN inc ia ON ia.id = from_id JOIN inc ib ON ib.id = to_id
),
g AS (SELECT DISTINCT chapter_id, (fragment_id // 2)::INT AS group_id, fragment_id FROM c),
m AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY chapter_id, group_id, local_snake_id ORDER BY chunk_id) - 1 AS position,
         chapter_id * 1000000 + group_id * 10 + local_snake_id AS snake_id
  FROM (SELECT chapter_id, (fragment_id // 2)::INT AS group_id, ((sentence_index // 3) % 3)::INT AS local_snake_id, id AS chunk_id FROM c)
),
outer_edges AS (
  SELECT x.id, x.other, x.weight, a.chapter_id, a.fragment_id, b.fragment_id AS other_fragment, a.weight AS cw, sum(x.weight) OVER (PARTITION BY x.id) AS total
  FROM (SELECT from_id AS id, to_id AS other, weight FROM w UNION ALL SELECT to_id, from_id, weight FROM w) x
  JOIN c a ON a.id = x.id JOIN c b ON b.id = x.other WHERE (a.chapter_id, a.fragment_id) <> (b.chapter_id, b.fragment_id)
),
incision AS MATERIALIZED (
  SELECT f.chapter_id, f.fragment_id, coalesce(sum(CASE WHEN other_fragment < o.fragment_id THEN cw / total * weight END), 0.0)::DOUBLE AS start_incision,
         coalesce(sum(CASE WHEN other_fragment >= o.fragment_id THEN cw / total * weight END), 0.0)::DOUBLE AS end_incision
  FROM (SELECT DISTINCT chapter_id, fragment_id FROM c) f LEFT JOIN outer_edges o ON o.chapter_id = f.chapter_id AND o.fragment_id = f.fragment_id GROUP BY 1, 2
),
totals AS MATERIALIZED (
  SELECT snake_id, any_value(m.chapter_id) AS chapter_id, any_value(group_id) AS group_id, count(*)::INT AS size, arg_min(label, position) AS first_label,
         arg_max(label, position) AS last_label, sum(tokens)::BIGINT AS tokens, sum(weight) AS weight
  FROM m JOIN c ON c.id = m.chunk_id GROUP BY 1
)
"""
