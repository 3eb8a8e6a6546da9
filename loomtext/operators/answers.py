"""From raw answers of a language model to chunks, links, notes and synopses, as tables.

An answer is parsed once to a VARIANT, which keeps what a schema would lose: a link's end is a number (the id of a chunk
that exists) or a text (the name of a chunk of this answer), and only its type tells which. Everything after that is
joins and aggregates over all answers at once. An answer that can't be used gives a row with the reason instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.cluster import cut
from loomtext.functions.json_text import object_text, repair_json
from loomtext.operators import matching
from loomtext.operators.relations import normalised_edge
from loomtext.operators.requests import RETRY_WAIT_S, Client, Options, ask

# The keys an answer must have, by the level that its chunks carry, and the spellings of the field with quotations.
REQUIRED = {"retention": ("fragment_summary", "chunks", "links"), "importance": ("importance_annotations", "chunks", "links")}
QUOTED_FIELDS = ("source_sentences", "source_sences", "source_sentances")
_KEYS = ["chapter_id", "fragment_id"]


def _get(of: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({of}, '$.{path}', '{kind}')")


def _has_type(of: str, path: str, kind: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get({of}, '$.{path}', 'variant'))") == kind


def _json_kind(of: str, path: str, out: str) -> Column:
    """The field as text if it is one, as number if it is a whole one."""
    sql = "string" if out == "STRING" else "bigint"
    return F.when(_has_type(of, path, out), _get(of, path, sql))


@dataclass(frozen=True)
class Parsed:
    """Tables by chapter_id and fragment_id: chunks (pos, name, label, content, retention, importance, quotes), links (pos, from_name, from_id,
    to_name, to_id, strength), notes (pos, chunk_id, importance), synopses (synopsis) and failed (reason)."""

    chunks: DataFrame
    links: DataFrame
    notes: DataFrame
    synopses: DataFrame
    failed: DataFrame


def parsed(answers: DataFrame, level: str = "retention", repair: bool = False) -> Parsed:
    """answers: chapter_id, fragment_id, answer (text around one JSON object).

    level says which pass asked: retention for the first, importance for the second. repair mends broken JSON first.
    Defined cases: a null answer, one without an object, with broken JSON, without a required key, or whose chunks or links are no
    list, is in failed and in no other table; a chunk's label and content are empty where they are missing; a single text in place of a
    list of quotations counts as a list of one; of misspelt fields the first that is not empty counts; an end of a link that is neither
    a text nor a whole number is null.
    """
    found = F.when(F.col("object") != "", F.col("object")).otherwise(F.col("answer"))
    rows = answers.withColumn("object", object_text("answer")).select(*_KEYS, "answer", F.try_parse_json(found).alias("v"))
    if repair:
        rows = cut(rows)
        mended = rows.where("v is null and answer is not null").select(*_KEYS, "answer", F.try_parse_json(repair_json("answer")).alias("v"))
        rows = rows.where("v is not null or answer is null").unionByName(mended)
    reason = F.when(F.col("answer").isNull(), "no answer").when(F.col("v").isNull(), "no JSON object")
    for key in REQUIRED[level]:
        reason = reason.when(_get("v", key, "variant").isNull(), f"no {key}")
    for key in ("chunks", "links"):
        reason = reason.when(_get("v", key, "array<variant>").isNull(), f"{key} is no list")
    # parsed once and written: a filter on the reason, pushed down, would make answers and parse them again for each key
    rows = cut(rows.withColumn("reason", reason).select(*_KEYS, F.when(F.col("reason").isNull(), F.col("v")).alias("v"), "reason"))
    good = rows.where("reason is null")
    each = good.select(*_KEYS, F.posexplode(_get("v", "chunks", "array<variant>")).alias("pos", "c"))
    quotes = F.array().cast("array<string>")
    for field in reversed(QUOTED_FIELDS):
        listed = F.coalesce(_get("c", field, "array<string>"), F.array(F.when(_has_type("c", field, "STRING"), _get("c", field, "string"))))
        listed = F.filter(listed, lambda q: q.isNotNull())
        quotes = F.when(F.size(listed) > 0, listed).otherwise(quotes)
    levels = [(_get("c", k, "string") if k == level else F.lit(None).cast("string")).alias(k) for k in ("retention", "importance")]
    chunks = each.select(*_KEYS, "pos", _json_kind("c", "temp_id", "STRING").alias("name"), F.coalesce(_get("c", "label", "string"), F.lit("")).alias("label"), F.coalesce(_get("c", "content", "string"), F.lit("")).alias("content"), *levels, quotes.alias("quotes"))
    links = good.select(*_KEYS, F.posexplode(_get("v", "links", "array<variant>")).alias("pos", "l"))
    ends = [_json_kind("l", end, kind).alias(f"{end}_{out}") for end in ("from", "to") for kind, out in (("STRING", "name"), ("BIGINT", "id"))]
    notes = good.select(*_KEYS, F.posexplode(F.coalesce(_get("v", "importance_annotations", "array<variant>"), F.array().cast("array<variant>"))).alias("pos", "x"))
    return Parsed(
        chunks,
        links.select(*_KEYS, "pos", *ends, _get("l", "strength", "string").alias("strength")),
        notes.select(*_KEYS, "pos", _json_kind("x", "chunk_id", "BIGINT").alias("chunk_id"), _get("x", "importance", "string").alias("importance")),
        good.select(*_KEYS, F.coalesce(_get("v", "fragment_summary", "string"), F.lit("")).alias("synopsis")),
        rows.where("reason is not null").select(*_KEYS, "reason"),
    )


def placed(chunks: DataFrame, sentences: DataFrame, match=matching.match_cascade) -> DataFrame:
    """chunks with sentence_ids (indexes, in the order of the quotations), sentence_index (the first of them) and tokens (their sum).

    sentences: chapter_id, fragment_id, sentence_index, text, token_count. A chunk none of whose quotations is found gets the
    first sentence of its fragment, index 0 and no tokens in a fragment without sentences.
    """
    sources = chunks.select(*_KEYS, "pos", F.posexplode("quotes").alias("nth", "text")).withColumn("source_id", F.col("pos").cast("long") * (1 << 24) + F.col("nth"))
    found = match(sources.select(*_KEYS, "source_id", "text"), sentences.select(*_KEYS, "sentence_index", "text"))
    found = found.where("stage <> 'fallback'") if "stage" in found.columns else found
    tokens = sentences.select(*_KEYS, "sentence_index", "token_count")
    once = found.select(*_KEYS, F.shiftright("source_id", 24).cast("int").alias("pos"), "source_id", "sentence_index").groupBy(*_KEYS, "pos", "sentence_index").agg(F.min("source_id").alias("q"))
    listed = once.join(tokens, [*_KEYS, "sentence_index"]).groupBy(*_KEYS, "pos").agg(F.array_sort(F.collect_list(F.struct("q", "sentence_index"))).alias("s"), F.sum("token_count").cast("long").alias("sum"))
    first = sentences.groupBy(*_KEYS).agg(F.min(F.struct("sentence_index", "token_count")).alias("first"))
    met = chunks.join(listed, [*_KEYS, "pos"], "left").join(first, _KEYS, "left")
    ids = F.when(F.col("s").isNotNull(), F.transform("s", lambda x: x["sentence_index"])).otherwise(F.array(F.coalesce("first.sentence_index", F.lit(0))))
    return met.withColumn("sentence_ids", ids).withColumn("sentence_index", F.col("sentence_ids")[0]).withColumn("tokens", F.coalesce("sum", "first.token_count", F.lit(0)).cast("long")).drop("s", "sum", "first", "quotes")


def numbered(chunks: DataFrame, ids_a_chapter: int = 1_000_000) -> DataFrame:
    """chunks with id, counted through each chapter from its own first id, and generation, counted by fragments that gave an answer with chunks."""
    order = Window.partitionBy("chapter_id").orderBy("fragment_id", "pos")
    by_fragment = Window.partitionBy("chapter_id").orderBy("fragment_id")
    return chunks.withColumn("id", F.col("chapter_id") * ids_a_chapter + F.row_number().over(order) - 1).withColumn("generation", F.dense_rank().over(by_fragment) - 1)


def resolved(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """from_id, to_id, strength of the edges that links make, by the numbered chunks: the larger id first, each edge once, with its first strength.

    A name means a chunk of the same answer (of several with one name the last), a number one of this or an earlier fragment of the
    chapter. A link with an end that is neither is left out.
    """
    names = chunks.where("name is not null").groupBy(*_KEYS, "name").agg(F.max_by("id", "pos").alias("id"))
    known = chunks.select("chapter_id", "id", F.col("fragment_id").alias("since"))
    rows = links
    for end in ("from", "to"):
        by_name = names.select(*_KEYS, F.col("name").alias(f"{end}_name"), F.col("id").alias(f"{end}_n"))
        by_id = known.select("chapter_id", F.col("id").alias(f"{end}_id"), F.col("since").alias(f"{end}_since"))
        rows = rows.join(by_name, [*_KEYS, f"{end}_name"], "left").join(by_id, ["chapter_id", f"{end}_id"], "left")
        rows = rows.withColumn(end, F.coalesce(f"{end}_n", F.when(F.col(f"{end}_since") <= F.col("fragment_id"), F.col(f"{end}_id"))))
    whole = rows.where("`from` is not null and `to` is not null").select(*normalised_edge(F.col("from"), F.col("to")), F.struct("fragment_id", "pos").alias("at"), "strength")
    return whole.groupBy("from_id", "to_id").agg(F.min_by("strength", "at").alias("strength"))


@dataclass(frozen=True)
class Graph:
    """Chunks and edges are computed when they are first asked for; synopses and failures need neither."""

    build: Callable[[], DataFrame]
    links: DataFrame
    synopses: DataFrame
    failed: DataFrame

    @cached_property
    def _made(self) -> DataFrame:
        return self.build()

    @property
    def chunks(self) -> DataFrame:
        return self._made.drop("pos", "name")

    @property
    def edges(self) -> DataFrame:
        return resolved(self.links, self._made)


def graph_of(answers: DataFrame, sentences: DataFrame, second: DataFrame | None = None, ids_a_chapter: int = 1_000_000, repair: bool = False, match=matching.match_cascade) -> Graph:
    """Chunks, edges, synopses and failures of the answers to the first pass over all fragments and, if given, to the second.

    Chunks of a fragment's second pass come after those of its first; its notes set the importance of chunks (the last one counts), and
    are left out with a second answer that brings no chunks.
    """
    one = parsed(answers, "retention", repair)
    chunks, links, failed = one.chunks, one.links, one.failed.withColumn("level", F.lit("retention"))
    notes = None
    if second is not None:
        two = parsed(second, "importance", repair)
        later = F.col("pos") + (1 << 20)  # more than an answer has chunks
        chunks, links = chunks.unionByName(two.chunks.withColumn("pos", later)), links.unionByName(two.links.withColumn("pos", later))
        notes = two.notes.join(two.chunks.select(*_KEYS).distinct(), _KEYS, "left_semi")
        failed = failed.unionByName(two.failed.withColumn("level", F.lit("importance")))

    def build() -> DataFrame:
        made = cut(numbered(placed(cut(chunks), sentences, match), ids_a_chapter))
        if notes is None:
            return made
        last = notes.where("chunk_id is not null").groupBy(*_KEYS, F.col("chunk_id").alias("id")).agg(F.max_by("importance", "pos").alias("rated"))
        return made.join(last, [*_KEYS, "id"], "left").withColumn("importance", F.coalesce("rated", "importance")).drop("rated")

    return Graph(build, links, one.synopses, failed)


def model_extractor(client: Client, prompt: str, options: Options = Options(), wait: float = RETRY_WAIT_S) -> Callable[[str, list[str], list[dict]], dict]:
    """An extractor for the chapter loop that asks a model, with retries, and reads its raw answer by the rules above.

    The prompt is the system message; {{ memory }} in it stands for the recalled chunks. What can't be used raises ValueError, which the loop records.
    """

    def extract(text: str, sentences: list[str], memory: list[dict]) -> dict:
        seen = "\n".join(f"{c['id']}. [{c['label']}] - {c['content']}" for c in memory) or "(empty)"
        answer = ask(client, [{"role": "system", "content": prompt.replace("{{ memory }}", seen)}, {"role": "user", "content": text}], vars(options), wait=wait)
        if answer is None:
            raise ValueError("no answer")
        payload = json.loads(answer[answer.find("{") : answer.rfind("}") + 1] or "null")
        if not isinstance(payload, dict):
            raise ValueError("no JSON object")
        if missing := [k for k in REQUIRED["retention"] if k not in payload]:
            raise ValueError(f"no {missing[0]}")
        if not all(isinstance(payload[k], list) and all(isinstance(x, dict) for x in payload[k]) for k in ("chunks", "links")):
            raise ValueError("chunks or links is no list of objects")
        return payload

    return extract
