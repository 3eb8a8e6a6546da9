"""Read operators over the graph tables: lookups, neighbours, subgraphs, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """Rows of a key; fails on use if there is none."""
    rows = table.where(F.col(key) == value)
    if rows.isEmpty():
        raise ValueError(f"{key} {value} not found")
    return rows


def neighbours(chunks: DataFrame, edges: DataFrame, near: str = "from_id", far: str = "to_id") -> DataFrame:
    """Edges with the label of the chunk at the far end; swap near and far for incoming edges."""
    return edges.join(chunks.select(F.col("id").alias(far), F.col("label").alias("far_label")), far).select(F.col(near).alias("id"), F.col(far).alias("other_id"), "strength", "far_label")


def chain_edges(chains: DataFrame, edges: DataFrame, incoming: bool = False) -> DataFrame:
    """id, other_id, weight of each chain's edges to other chains, or from them, with the other chain's size and labels."""
    near, far = ("to_snake_id", "from_snake_id") if incoming else ("from_snake_id", "to_snake_id")
    other = chains.select(F.col("id").alias(far), F.col("size").alias("other_size"), F.col("first_label").alias("other_first"), F.col("last_label").alias("other_last"))
    return edges.join(other, far).select(F.col(near).alias("id"), F.col(far).alias("other_id"), "weight", "other_size", "other_first", "other_last")


def edges_with_chunks(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    a = chunks.select(F.col("id").alias("from_id"), F.col("label").alias("from_label"))
    b = chunks.select(F.col("id").alias("to_id"), F.col("label").alias("to_label"))
    return edges.join(a, "from_id").join(b, "to_id")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def boundary_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with exactly one end in nodes."""
    starts, ends = nodes.select(F.col("id").alias("from_id")), nodes.select(F.col("id").alias("to_id"))
    out = edges.join(starts, "from_id", "left_semi").join(ends, "to_id", "left_anti").withColumn("side", F.lit("out"))
    into = edges.join(ends, "to_id", "left_semi").join(starts, "from_id", "left_anti").withColumn("side", F.lit("in"))
    return out.unionByName(into)


def group_edges(chunks: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges inside a fragment group: both ends' groups by equi-join."""
    of = chunks.join(groups, ["chapter_id", "fragment_id"]).select("id", F.struct("chapter_id", "group_id").alias("g"))
    joined = edges.join(of.toDF("from_id", "ga"), "from_id").join(of.toDF("to_id", "gb"), "to_id").where("ga = gb")
    return joined.select(*edges.columns, F.col("ga.chapter_id").alias("chapter_id"), F.col("ga.group_id").alias("group_id"))


def sentence_ids(chunk_sentences: DataFrame) -> DataFrame:
    """Ordered sentence ids of each chunk."""
    sid = F.struct("chapter_id", "fragment_id", "sentence_index")
    return chunk_sentences.groupBy("chunk_id").agg(F.array_sort(F.collect_list(sid)).alias("sentence_ids"))


def chunk_tokens(chunk_sentences: DataFrame, sentences: DataFrame) -> DataFrame:
    """Tokens of each chunk's sentences; a sentence that is missing counts 0."""
    keys = ["chapter_id", "fragment_id", "sentence_index"]
    return chunk_sentences.join(sentences.select(*keys, "token_count"), keys, "left").groupBy("chunk_id").agg(F.sum(F.coalesce("token_count", F.lit(0))).cast("long").alias("tokens"))


def normalised_edge(a: Column, b: Column) -> list[Column]:
    """Edges always lead from the larger id to the smaller."""
    return [F.greatest(a, b).alias("from_id"), F.least(a, b).alias("to_id")]


def resolve_links(links: DataFrame, names: DataFrame, visible: DataFrame) -> DataFrame:
    """links: chapter_id, src, dst (text; a number is an id, anything else a name), strength.

    names: chapter_id, name, id; visible: chapter_id, id. A link with an end that resolves to nothing is dropped.
    """

    def end(df: DataFrame, col: str, out: str) -> DataFrame:
        by_name = names.select("chapter_id", F.col("name").alias(col), F.col("id").alias(f"{out}_n"))
        by_id = visible.select("chapter_id", F.col("id").cast("string").alias(col), F.col("id").alias(f"{out}_v"))
        both = df.join(by_name, ["chapter_id", col], "left").join(by_id, ["chapter_id", col], "left")
        return both.withColumn(out, F.when(F.col(col).rlike(r"^\d+$"), F.col(f"{out}_v")).otherwise(F.col(f"{out}_n"))).drop(f"{out}_n", f"{out}_v")

    ended = end(end(links, "src", "a"), "dst", "b").where("a is not null and b is not null")
    return ended.select("chapter_id", *normalised_edge(F.col("a"), F.col("b")), "strength")


def link_strength(edges: DataFrame, links: DataFrame, as_built: bool = False) -> DataFrame:
    """Strength of the first link (pos) of each edge; as_built: only a link that has the edge's own direction counts."""
    direct = links.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "strength", "pos")
    if not as_built:
        direct = links.select(*normalised_edge(F.col("src"), F.col("dst")), "strength", "pos")
    first = direct.groupBy("from_id", "to_id").agg(F.min_by("strength", "pos").alias("strength"))
    return edges.select("from_id", "to_id").join(first, ["from_id", "to_id"], "left")


def annotated(chunks: DataFrame, annotations: DataFrame) -> DataFrame:
    """importance set by annotations (chunk_id, importance, pos); the last one wins."""
    last = annotations.groupBy(F.col("chunk_id").alias("id")).agg(F.max_by("importance", "pos").alias("new"))
    return chunks.join(last, "id", "left").withColumn("importance", F.coalesce("new", "importance")).drop("new")


def first_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What of incoming is inserted: the first row of a key that existing does not have."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return incoming.join(existing, keys, "left_anti").withColumn("r", rank).where("r = 1").drop("r")


def with_links(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """chunks (id, links, ...) with the ids that edges lead from added to the links of the chunk they lead to, each once.

    Links so far keep their places, new ones follow in order of id; null links count as none; edges to no chunk are left out.
    """
    new = edges.where("from_id is not null").groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_set("from_id")).alias("new"))
    none = F.array().cast("array<bigint>")
    return chunks.join(new, "id", "left").withColumn("links", F.array_union(F.coalesce("links", none), F.coalesce("new", none))).drop("new")


def next_ids(table: DataFrame, *cols: str) -> DataFrame:
    return table.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)).alias(f"next_{c}") for c in cols])


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out_degree"))


def temporal_edges(chunks: DataFrame) -> DataFrame:
    """Edges between chunks that follow each other in a chapter."""
    order = Window.partitionBy("chapter_id").orderBy("fragment_id", "sentence_index", "id")
    return chunks.select("chapter_id", F.col("id").alias("from_id"), F.lead("id").over(order).alias("to_id")).where("to_id is not null")


def prompt_lines(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks of a key as lines "id. [label] - content", in order of id."""
    line = F.struct("id", F.format_string("%d. [%s] - %s", "id", "label", "content").alias("line"))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"))
