"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jvm_dir.get() if jvm_dir.isDefined() else None
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="loomtext-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def table_of(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, lost executors only reread files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_ids(classes: DataFrame, name: str) -> DataFrame:
    """classes (one row for each digest_a, digest_b) as a written table with a number in ``id`` that no two of them share.

    The number is the digest's first half; classes that have it in common with another one, some hundreds in 10^11, get a
    hash of both halves instead.
    """
    classes = table_of(classes, name)
    shared = table_of(classes.groupBy("digest_a").agg(F.count("*").alias("n")).where("n > 1").select("digest_a", F.lit(True).alias("shared")), f"{name}-clashes")
    if shared.isEmpty():
        return classes.withColumn("id", F.col("digest_a"))
    number = F.when(F.col("shared"), F.xxhash64("digest_a", "digest_b")).otherwise(F.col("digest_a"))
    return table_of(classes.join(shared, "digest_a", "left").withColumn("id", number).drop("shared"), name)


def id_crc(col: str | Column) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary"))


def in_fold(col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) mod modulus is remainder; a null id is in no fold."""
    return F.coalesce(id_crc(col) % modulus == remainder, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes in an Arrow batch of texts: whole texts are long, and a batch is held several times over on its way to Python and back.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def with_small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_ROWS rows and BATCH_BYTES bytes (or one row) at most; for tables of whole texts that go to Python."""
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        of = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(df.sparkSession.conf.get(of)) <= bound:
            df.sparkSession.conf.set(of, bound)
    return df


def _bytes(value: str) -> int:
    """A setting's number; a size with a letter other than b counts as not set."""
    digits = value.lower().removesuffix("b")
    return int(digits) if digits.lstrip("-").isdigit() else 0


def by_bytes(batches, column: str, limit: int = 1 << 20):
    """Cut record batches so that each has about limit bytes in a text column at most (or one row)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        part = (ends - 1).clip(0) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def carried(docs: DataFrame, held_out: Column, carry: tuple[str, ...], run, schema: str) -> DataFrame:
    """mapInArrow of run over doc_id, text, held_out and the columns of docs to carry, named carry_ and their name on the way."""
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    return with_small_batches(rows).mapInArrow(run, ", ".join([schema, *[f"`carry_{c}` {kinds[c]}" for c in carry]]))


#: Keys that hold more than this share of all rows are broadcast by join_counted.
HOT_SHARE = 1 << 13


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], total: int, share: int = HOT_SHARE) -> DataFrame:
    """rows joined with table, which has one row a key and the number of rows that hold it in ``weight``; a hot key goes to no single task.

    Keys with more than a share-th of total rows are fewer than share * sum(weight) / total, so they are broadcast; of the
    others none has more than total / share rows, and they are joined by a shuffle.
    """
    hot = F.broadcast(table.where(F.col("weight") * share > total))
    cold = table.where(F.col("weight") * share <= total)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))
