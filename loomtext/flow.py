"""The whole way from chapters to a shorter text of each, as written stages that a later call goes on from.

Chapters come in batches. A batch is a folder of stage tables: a stage that was written whole is read, any other is computed
(again), so a run that stops anywhere goes on where it stopped, and a batch that is done is not touched. Chapters that a workspace
knows are not taken again. Levels of incisions are measured over all chapters so far, as chapters came.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.cluster import kept, scratch
from loomtext.functions.sentences import FRAGMENT_TOKENS, fragment_totals, sentences
from loomtext.operators import chains, clues, compression, extraction, grouping, markup, reviewing, weights
from loomtext.operators.requests import Client, stub_client

IDS = 1_000_000
_SID = ["chapter_id", "fragment_id", "sentence_index"]


@dataclass(frozen=True)
class Settings:
    """What a run may be told: budgets, the extraction passes, the model's client and prompts, and how the text is shown to the compressor."""

    fragment_tokens: int = FRAGMENT_TOKENS
    group_tokens: int = grouping.GROUP_TOKENS
    snake_tokens: int = chains.SNAKE_TOKENS
    max_clues: int = clues.MAX_CLUES
    max_iterations: int = 10
    ratio: float = 0.2
    mode: str = "full"
    extractor: extraction.Extractor = extraction.stub_extractor
    second_pass: extraction.SecondPass | None = None
    client: Client = stub_client
    compress_prompt: str = "Shorten the text to {{ target }} characters, {{ at_least }} to {{ at_most }} at the outside."
    reviewer_prompt: str = "Say what a reviewer must look for: [{{ label }}] {{ content }}"


@dataclass
class Flow:
    """A workspace of batches under path, which driver and executors share."""

    spark: SparkSession
    path: str
    settings: Settings = field(default_factory=Settings)

    # -- stages

    def _paths(self, pattern: str) -> list[str]:
        jvm = self.spark._jvm
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = glob.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(glob)
        return sorted(str(f.getPath().toString()) for f in found or [])

    def batches(self) -> list[int]:
        return sorted(int(p.rsplit("=", 1)[1]) for p in self._paths("batch=*"))

    def done(self, batch: int, name: str) -> bool:
        return bool(self._paths(f"batch={batch}/{name}/_SUCCESS"))

    def stage(self, batch: int, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        at = f"{self.path}/batch={batch}/{name}"
        if not self.done(batch, name):
            with scratch(self.spark):
                build().write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.parquet(at)

    def table(self, name: str) -> DataFrame | None:
        """A stage's rows of all batches that have it."""
        at = [f"{self.path}/batch={b}/{name}" for b in self.batches() if self.done(b, name)]
        return self.spark.read.parquet(*at) if at else None

    # -- runs

    def take(self, chapters: DataFrame) -> None:
        """Store chapters (chapter_id, text) that the workspace does not know as a batch of its own."""
        known = self.table("chapters")
        new = chapters.select(F.col("chapter_id").cast("long").alias("chapter_id"), F.coalesce("text", F.lit("")).alias("text")).where("chapter_id is not null")
        new = new.groupBy("chapter_id").agg(F.min("text").alias("text"))
        new = new if known is None else new.join(known.select("chapter_id"), "chapter_id", "left_anti")
        batch = max(self.batches(), default=-1) + 1
        if not new.isEmpty():
            self.stage(batch, "chapters", lambda: new)

    def run(self, chapters: DataFrame | None = None) -> DataFrame:
        """chapter_id, text of every chapter of the workspace, after taking the new ones and going on with batches that are not done.

        Defined cases: rows without an id are left out, of rows with one id the first text counts, once for all; a chapter that is
        null, empty or without chunks has an empty text; an empty table changes nothing.
        """
        if chapters is not None:
            self.take(chapters)
        out = None
        for batch in self.batches():
            if self.done(batch, "chapters"):
                texts = self._texts(batch)
                out = texts if out is None else out.unionByName(texts)
        return out if out is not None else self.spark.createDataFrame([], "chapter_id long, text string")

    def _texts(self, batch: int) -> DataFrame:
        if self.done(batch, "texts"):
            return self.stage(batch, "texts", lambda: None)
        s = self.settings
        stage = lambda name, build: self.stage(batch, name, build)
        chapters = stage("chapters", lambda: None)
        sents = stage("sentences", lambda: sentences(chapters, budget=s.fragment_tokens))
        found = stage("extracted", lambda: extraction.extract(sents, s.extractor, IDS, s.second_pass))
        chunks = stage("chunks", lambda: self._chunks(found, sents))
        edges = stage("edges", lambda: weights.with_edge_weights(chunks, found.where("kind = 'edge'").select(F.col("id").alias("from_id"), F.col("other_id").alias("to_id"), "strength", "ord")))
        stage("incisions", lambda: weights.fragment_incisions(chunks, edges))
        groups = stage("groups", lambda: self._groups(batch, sents))
        members = stage("members", lambda: self._members(chunks, edges, groups))
        merged = stage("clues", lambda: self._clues(members, chunks))
        marked = stage("marked", lambda: self._marked(merged, chunks, sents, groups, found))
        best = stage("compressed", lambda: self._compressed(merged, chunks, marked, sents, groups))
        return stage("texts", lambda: self._joined(chapters, best))

    @staticmethod
    def _chunks(found: DataFrame, sents: DataFrame) -> DataFrame:
        rows = found.where("kind = 'chunk'").select("id", "generation", *_SID, "label", "content", "retention", "importance")
        counted = rows.join(sents.select(*_SID, F.col("token_count").alias("tokens")), _SID, "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        return weights.with_node_weights(counted)

    def _groups(self, batch: int, sents: DataFrame) -> DataFrame:
        so_far = self.spark.read.parquet(*[f"{self.path}/batch={b}/incisions" for b in self.batches() if b <= batch and self.done(b, "incisions")])
        own = sents.select("chapter_id").distinct()
        levels = weights.incision_levels(so_far).join(own, "chapter_id", "left_semi")
        return grouping.fragment_groups(levels, fragment_totals(sents), self.settings.group_tokens)

    def _members(self, chunks: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
        """Members of chains; a chain's id counts through its chapter, so no batch needs another's numbers."""
        rows = chains.chains(chunks, edges, groups, self.settings.snake_tokens)
        number = F.dense_rank().over(Window.partitionBy("chapter_id").orderBy("group_id", "local_snake_id"))
        return rows.withColumn("snake_id", F.col("chapter_id") * IDS + number - 1)

    def _clues(self, members: DataFrame, chunks: DataFrame) -> DataFrame:
        totals = chains.chain_totals(members, chunks)
        named = totals.select("snake_id", F.concat("first_label", F.lit(" → "), "last_label").alias("label"), "weight")
        placed = members.join(named, "snake_id").join(chunks.select(F.col("id").alias("chunk_id"), "fragment_id", "sentence_index"), "chunk_id")
        return clues.merge_clues(placed, ["chapter_id", "group_id"], self.settings.max_clues)

    @staticmethod
    def _group_key() -> Column:
        return (F.col("chapter_id") * IDS + F.col("group_id")).alias("group_key")

    def _marked(self, merged: DataFrame, chunks: DataFrame, sents: DataFrame, groups: DataFrame, found: DataFrame) -> DataFrame:
        """group_key, marked: the fragments with chunks of a group's clues, their spans marked, and the synopses of what lies between them."""
        keyed = groups.select("chapter_id", "fragment_id", self._group_key())
        rekeyed = lambda rows: rows.join(keyed, ["chapter_id", "fragment_id"]).drop("chapter_id").withColumnRenamed("group_key", "chapter_id")
        used = merged.select(F.explode("chunk_ids").alias("id")).distinct()
        shown = rekeyed(chunks.join(used, "id"))
        covered = markup.coverage(shown, shown.select(F.col("id").alias("chunk_id"), *_SID))
        touched = shown.select("chapter_id", "fragment_id").distinct()
        spans = markup.islands(rekeyed(sents).join(touched, ["chapter_id", "fragment_id"], "left_semi").select(*_SID, "text"), covered)
        synopses = rekeyed(found.where("kind = 'synopsis'").select("chapter_id", "fragment_id", F.col("content").alias("synopsis")))
        text = markup.marked_text(markup.marked_fragments(spans, self.settings.mode), markup.gap_synopses(touched, synopses))
        return text.select(F.col("chapter_id").alias("group_key"), F.col("text").alias("marked"))

    def _compressed(self, merged: DataFrame, chunks: DataFrame, marked: DataFrame, sents: DataFrame, groups: DataFrame) -> DataFrame:
        s = self.settings
        fragments = sents.groupBy("chapter_id", "fragment_id").agg(F.sum(F.length("text") + 1).alias("n")).join(groups, ["chapter_id", "fragment_id"])
        own = fragments.groupBy(self._group_key()).agg((F.sum("n") - 1).alias("n_chars"))  # the sentences a blank apart
        members = merged.select(self._group_key(), "clue_id", "weight", "label", F.posexplode("chunk_ids").alias("place", "id")).join(chunks.select("id", "content"), "id")
        content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "\n")
        listed = members.groupBy("group_key", "clue_id", "weight", "label").agg(content.alias("content"))
        # every round reads the groups' lengths and their reviewers
        reviewers = kept(reviewing.reviewer_texts(kept(listed), s.reviewer_prompt, s.client))
        own = kept(own.join(marked.select("group_key"), "group_key", "left_semi"))
        compressor = compression.Compressor(marked, s.compress_prompt, s.client, ratio=s.ratio)
        return compression.compress(own, compressor, reviewing.Reviews(reviewers, s.client), s.max_iterations)

    @staticmethod
    def _joined(chapters: DataFrame, best: DataFrame) -> DataFrame:
        """A chapter's groups in order, two line ends apart."""
        rows = best.select(F.floor(F.col("group_key") / IDS).cast("long").alias("chapter_id"), (F.col("group_key") % IDS).alias("group_id"), F.col("text").alias("part"))
        whole = rows.groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "part"))), lambda x: x["part"]), "\n\n").alias("text"))
        return chapters.select("chapter_id").join(whole, "chapter_id", "left").select("chapter_id", F.coalesce("text", F.lit("")).alias("text"))
