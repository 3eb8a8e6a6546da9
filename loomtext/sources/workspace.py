"""A workspace: the graph tables as Parquet folders, their files sorted by chapter where they have one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.cluster import kept
from loomtext.operators.relations import first_wins
from loomtext.schemas import KEYS, TABLES, schema


@dataclass
class Workspace:
    spark: SparkSession
    path: str

    def exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)

    def read(self, table: str) -> DataFrame:
        """A table; an empty one if it was never written. Files hold ranges of chapters in order, so filters on chapter_id skip most row groups."""
        if table not in TABLES:
            raise ValueError(f"no such table: {table}")
        if not self.exists(table):
            return self.spark.createDataFrame([], schema(table))
        return self.spark.read.schema(schema(table)).parquet(f"{self.path}/{table}")

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows whose key is new; of several with one key the first by the table's first column. Keys lie within chapters, so
        only the chapters that rows has are read."""
        names = schema(table).fieldNames()
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema(table)])
        stored = self.read(table)
        if "chapter_id" in names:
            stored = stored.join(typed.select("chapter_id").distinct(), "chapter_id", "left_semi")
        new = first_wins(stored, typed, KEYS[table], names[0])
        if "chapter_id" in names:
            new = new.repartitionByRange("chapter_id").sortWithinPartitions("chapter_id")
        new.write.mode("append").parquet(f"{self.path}/{table}")

    def require(self) -> Workspace:
        if not self.exists("chunks"):
            raise FileNotFoundError(f"no workspace at {self.path}")
        return self

    def chapter_ids(self) -> DataFrame:
        return self.read("fragment_groups").select("chapter_id").distinct().orderBy("chapter_id")

    def group_ids(self, chapter_id: int) -> DataFrame:
        return self.read("fragment_groups").where(F.col("chapter_id") == chapter_id).select("group_id").distinct().orderBy("group_id")

    def group_fragments(self, chapter_id: int, group_id: int) -> DataFrame:
        rows = self.read("fragment_groups").where((F.col("chapter_id") == chapter_id) & (F.col("group_id") == group_id))
        return rows.select("fragment_id").orderBy("fragment_id")

    def snakes(self, chapter_id: int, group_id: int) -> DataFrame:
        return self.read("snakes").where((F.col("chapter_id") == chapter_id) & (F.col("group_id") == group_id)).orderBy("id")


#: What an edge without a weight is stored with.
EDGE_WEIGHT = 0.1


def save_graph(work: Workspace, chunks: DataFrame, edges: DataFrame, covered: DataFrame | None = None) -> None:
    """Store chunks, the sentences that they cover (chunk_id and the sentence's keys) and edges (from_id, to_id, strength, weight).

    Defined cases: a chunk without a weight has 0, an edge without one EDGE_WEIGHT; a chunk that covers no sentence covers its
    own; an edge is stored with the chapter of the chunk it leads from, and left out if that chunk is neither new nor stored;
    what is stored already stays as it is; empty tables add nothing.
    """
    sid = ["chapter_id", "fragment_id", "sentence_index"]
    new = chunks.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    own = new.select(F.col("id").alias("chunk_id"), *sid)
    if covered is not None:
        given = covered.select("chunk_id", *sid).join(own.select("chunk_id"), "chunk_id", "left_semi")
        own = given.unionByName(own.join(given.select("chunk_id"), "chunk_id", "left_anti"))
    of = new.select("id", "chapter_id").unionByName(work.read("chunks").select("id", "chapter_id"))
    of = of.groupBy(F.col("id").alias("from_id")).agg(F.min("chapter_id").alias("chapter_id"))
    placed = edges.select("from_id", "to_id", "strength", F.coalesce("weight", F.lit(EDGE_WEIGHT)).alias("weight")).join(of, "from_id")
    # an append reads its rows several times: for their chapters, for the ranges of its files, and to write them
    work.append("chunk_sentences", kept(own))
    work.append("knowledge_edges", kept(placed))
    work.append("chunks", new)  # last, so that a save that broke off is found missing and done again


def save_groups(work: Workspace, groups: DataFrame) -> None:
    """Store groups (chapter_id, group_id, fragment_ids), a row for each fragment."""
    work.append("fragment_groups", groups.select("chapter_id", "group_id", F.explode("fragment_ids").alias("fragment_id")))


def save_chains(work: Workspace, members: DataFrame, chunks: DataFrame, edges: DataFrame) -> None:
    """Number the chains of members (chapter_id, group_id, local_snake_id, chunk_id, position) after the stored ones and store them."""
    from loomtext.operators.chains import chain_graph, chain_totals

    after = work.read("snakes").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    local = members.select("chapter_id", "group_id", "local_snake_id").distinct()
    per_chapter = local.groupBy("chapter_id").agg(F.count("*").alias("n"))
    stretch = F.expr("chapter_id div 65536")
    per_stretch = per_chapter.groupBy(stretch.alias("stretch")).agg(F.sum("n").alias("n"))  # a row for 65,536 chapters
    before = per_stretch.select("stretch", (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("stretch").orderBy("chapter_id")) - F.col("n")
    ahead = per_chapter.withColumn("stretch", stretch).withColumn("within", within).join(before, "stretch").select("chapter_id", (F.col("before") + F.col("within")).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("chapter_id").orderBy("group_id", "local_snake_id"))
    ids = kept(local.withColumn("r", number).join(ahead, "chapter_id").select("chapter_id", "group_id", "local_snake_id", (F.lit(after) + F.col("ahead") + F.col("r")).alias("snake_id")))
    rows = kept(members.join(ids, ["chapter_id", "group_id", "local_snake_id"]))
    totals = chain_totals(rows, chunks).withColumnRenamed("snake_id", "id")
    work.append("snakes", kept(totals.join(ids.withColumnRenamed("snake_id", "id"), "id")))
    work.append("snake_chunks", rows.select("snake_id", "chunk_id", "position", "chapter_id"))
    chapters = ids.select(F.col("snake_id").alias("from_snake_id"), "chapter_id")
    work.append("snake_edges", kept(chain_graph(rows, chunks, edges).join(chapters, "from_snake_id")))


def read_fragment_json(spark: SparkSession, path: str, synopsis_field: str = "synopsis") -> DataFrame:
    """path, synopsis, sentence_index, text, token_count of fragment files; the older layout is a bare list without synopsis.

    synopsis_field: how the files call the synopsis.
    """
    kind = "array<struct<text:string,token_count:int>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    new = F.from_json("value", f"`{synopsis_field}` string, sentences {kind}")
    bare = F.ltrim("value").startswith("[")
    rows = raw.select("path", F.when(bare, F.lit("")).otherwise(F.coalesce(new[synopsis_field], F.lit(""))).alias("synopsis"), F.when(bare, F.from_json("value", kind)).otherwise(new["sentences"]).alias("s"))
    return rows.select("path", "synopsis", F.posexplode("s").alias("sentence_index", "x")).select("path", "synopsis", "sentence_index", "x.text", "x.token_count")


def fragment_json(sentences: DataFrame, synopses: DataFrame, synopsis_field: str = "synopsis") -> DataFrame:
    """chapter_id, fragment_id, value: each fragment as a JSON text of its synopsis (empty without one) and its sentences in order."""
    keys = ["chapter_id", "fragment_id"]
    listed = F.array_sort(F.collect_list(F.struct("sentence_index", "text", "token_count")))
    rows = sentences.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["token_count"].alias("token_count"))).alias("s"))
    whole = F.to_json(F.struct(F.coalesce("synopsis", F.lit("")).alias(synopsis_field), F.col("s").alias("sentences")))
    return rows.join(synopses.select(*keys, "synopsis"), keys, "left").select(*keys, whole.alias("value"))


def write_fragment_json(sentences: DataFrame, synopses: DataFrame, path: str, synopsis_field: str = "synopsis") -> None:
    """A JSON file for each fragment under chapter_id=.../fragment_id=..., as read_fragment_json reads them."""
    rows = fragment_json(sentences, synopses, synopsis_field).repartition("chapter_id", "fragment_id")
    rows.write.partitionBy("chapter_id", "fragment_id").option("maxRecordsPerFile", 1).text(path)


def chains_json(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """chapter_id, group_id, snake_id, value: each chain as a JSON text of its chunks in order."""
    rows = members.join(chunks.select(F.col("id").alias("chunk_id"), "label", "content"), "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("position", "chunk_id", "label", "content")))
    chunk = lambda x: F.struct(x["chunk_id"].alias("id"), x["label"].alias("label"), x["content"].alias("content"))
    made = rows.groupBy("chapter_id", "group_id", "snake_id").agg(F.transform(listed, chunk).alias("chunks"))
    return made.select("chapter_id", "group_id", "snake_id", F.to_json(F.struct("snake_id", F.size("chunks").alias("size"), "chunks")).alias("value"))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a graph file {"nodes": [...], "edges": [{"from", "to"}]}."""
    whole = spark.read.schema("nodes array<struct<id:long,sentence_id:long,label:string,content:string>>, edges array<struct<`from`:long,`to`:long>>").json(path, multiLine=True)
    return whole.select(F.inline("nodes")), whole.select(F.inline("edges")).toDF("from_id", "to_id")
