"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source the rows get a seeded random order; a row's fractional rank is its place in that order
over the source's size. All rows sorted by fractional rank form one sequence in which any stretch holds every
source in its share, so cutting it into equal stretches gives shards that match the mixture and whose row
counts differ by one at most (law ``rows``).

Both rankings are distributed: a row number inside a narrow range of the sort key plus the number of rows in
the ranges before it. A source with a third of all rows is spread over as many ranges as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, shuffle_partitions, table_of

#: Rows in a range of a ranking, about; the ranges also number RANGES_A_PARTITION for each shuffle partition at least.
RANGE_ROWS = 20_000
RANGES_A_PARTITION = 4
_KEY_BITS = 60


def interleave_shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Defined cases: a null text has size 8 and the crc32 of nothing (0); a null source is a source of its own;
    a null id counts as the word ``null``; rows that share an id, or have none, are told apart by their texts;
    repeated rows are separate rows, each with a slot of its own;
    an empty table gives no rows; with fewer rows than shards some shards stay empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary")))), 1, _KEY_BITS // 4), 16, 10).cast("long")
    rows = table_of(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("stratum"),
            key.alias("key"),
        ),
        "shard-rows",
    )
    ranges = max(RANGES_A_PARTITION * shuffle_partitions(spark), rows.count() // RANGE_ROWS)
    ties = ["key", "doc_id", "size", "text_crc32"]

    ranged = rows.withColumn("range", F.expr(f"key div {(1 << _KEY_BITS) // ranges + 1}"))
    by_source = Window.partitionBy("stratum")
    before = (
        ranged.groupBy("stratum", "range").agg(F.count("*").alias("n"))
        .select("stratum", "range",
                (F.sum("n").over(by_source.orderBy("range")) - F.col("n")).alias("before"),
                F.sum("n").over(by_source).alias("total"))
    )
    within = ranged.withColumn("place", F.row_number().over(Window.partitionBy("stratum", "range").orderBy(*ties)) - 1)
    placed = table_of(
        within.join(before, ["stratum", "range"])
        .withColumn("fraction", (2 * (F.col("before") + F.col("place")) + 1) / (2.0 * F.col("total")))
        .select("doc_id", "size", "text_crc32", "stratum", "key", "fraction", F.floor(F.col("fraction") * ranges).alias("stretch")),
        "shard-fractions",
    )

    whole = Window.partitionBy()  # one row for each stretch, not for each document
    ahead = placed.groupBy("stretch").agg(F.count("*").alias("n")).select(
        "stretch", (F.sum("n").over(whole.orderBy("stretch")) - F.col("n")).alias("ahead"), F.sum("n").over(whole).alias("all_rows"))
    in_stretch = Window.partitionBy("stretch").orderBy("fraction", "stratum", *ties)
    ranked = placed.withColumn("place", F.row_number().over(in_stretch) - 1).join(ahead, "stretch").withColumn("rank", F.col("ahead") + F.col("place"))
    return (
        ranked.withColumn("shard", F.expr(f"(rank * {n_shards}) div all_rows").cast("int"))
        .withColumn("slot", F.col("rank") - F.expr(f"(shard * all_rows + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10_interleaved_shards(spark, sf_dir):
    return interleave_shards(read_table(spark, sf_dir, "documents"))


#: CRC-32 is spelled out, as DuckDB has no function for it.
ORACLE_SQL = {
    "op10_interleaved_shards": """
WITH RECURSIVE bits AS (
  SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
base AS (
  SELECT doc_id, coalesce("text", '') AS body, coalesce('=' || source, 'null') AS stratum,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce("text", ''))), 1, 15))::BIGINT AS k
  FROM documents
),
octets AS (
  SELECT *, hex(encode(body)) AS h FROM base
),
summed AS (
  SELECT doc_id, length(h) // 2 + 8 AS size, stratum, k,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM octets, crc_table
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, size, text_crc32) - 1 AS place,
         count(*) OVER (PARTITION BY stratum) AS total, count(*) OVER () AS all_rows
  FROM summed
),
spread AS (
  SELECT *, row_number() OVER (ORDER BY (2 * place + 1) / (2.0::DOUBLE * total), stratum, k, doc_id, size, text_crc32) - 1 AS r
  FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
       (r * 24 // all_rows)::INTEGER AS shard,
       (r - ((r * 24 // all_rows) * all_rows + 23) // 24)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM spread
""",
}

QUERIES = {"op10_interleaved_shards": op10_interleaved_shards}
