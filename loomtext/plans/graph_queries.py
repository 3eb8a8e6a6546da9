"""Registered queries of the graph operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomtext.cluster import kept, shared_dir
from loomtext.functions.sentences import fragment_totals, joined_text
from loomtext.operators import chains, clues, diffusion, markup, memory, relations, review, weights
from loomtext.plans import derived as d
from loomtext.plans.derived import BASE
from loomtext.sources import workspace

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name; sql follows the common tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = BASE + sql
        return f

    return register


def r6(col: str | Column) -> Column:
    return F.round(col, 6)


@query("SELECT chapter_id, fragment_id, sentence_index, text, token_count FROM s")
def sentences(spark, sf_dir):
    return d.sentence_rows(spark, sf_dir)


@query("SELECT chapter_id, sentence_index, fragment_id FROM s")
def fragments_pack(spark, sf_dir):
    return d.sentence_rows(spark, sf_dir).select("chapter_id", "sentence_index", "fragment_id")


@query("SELECT chapter_id, fragment_id, count(*) AS n_sentences, sum(token_count)::BIGINT AS token_count FROM s GROUP BY 1, 2")
def fragment_tokens(spark, sf_dir):
    return fragment_totals(d.sentence_rows(spark, sf_dir))


@query("SELECT chapter_id, fragment_id, string_agg(text, '' ORDER BY sentence_index) AS text FROM s GROUP BY 1, 2")
def fragment_text(spark, sf_dir):
    return joined_text(d.sentence_rows(spark, sf_dir), ["chapter_id", "fragment_id"])


@query("SELECT chunk_id, sum(coalesce(token_count, 0))::BIGINT AS tokens FROM cs LEFT JOIN s USING (chapter_id, fragment_id, sentence_index) GROUP BY 1")
def chunk_tokens(spark, sf_dir):
    return relations.chunk_tokens(d.chunk_sentence_rows(spark, sf_dir), d.sentence_rows(spark, sf_dir))


@query("SELECT chunk_id, count(*) AS n, min(sentence_index) AS first_index, max(sentence_index) AS last_index FROM cs GROUP BY 1")
def chunk_sentence_ids(spark, sf_dir):
    ids = relations.sentence_ids(d.chunk_sentence_rows(spark, sf_dir))
    return ids.select("chunk_id", F.size("sentence_ids").cast("long").alias("n"), F.col("sentence_ids")[0]["sentence_index"].alias("first_index"), F.element_at("sentence_ids", -1)["sentence_index"].alias("last_index"))


@query("SELECT id, weight FROM c")
def node_weight(spark, sf_dir):
    return d.chunk_rows(spark, sf_dir).select("id", "weight")


@query("SELECT from_id, to_id, strength, round(weight, 6) AS weight FROM w")
def edge_weight(spark, sf_dir):
    return d.weighted_edges(spark, sf_dir).select("from_id", "to_id", "strength", r6("weight").alias("weight"))


@query("SELECT id, total FROM inc")
def incident_strength(spark, sf_dir):
    return weights.incident_strength(d.edge_rows(spark, sf_dir))


@query("SELECT chapter_id, fragment_id, count(*) AS n, round(sum(weight), 6) AS weight FROM outer_edges GROUP BY 1, 2")
def external_edges(spark, sf_dir):
    found = weights.external_edges(d.chunk_rows(spark, sf_dir), d.weighted_edges(spark, sf_dir))
    return found.groupBy("place").agg(F.count("*").alias("n"), r6(F.sum("weight")).alias("weight")).select("place.chapter_id", "place.fragment_id", "n", "weight")


@query("SELECT from_id, to_id, strength FROM e WHERE from_id IN (SELECT id FROM c WHERE retention = 'verbatim' OR importance = 'critical') AND to_id IN (SELECT id FROM c WHERE retention = 'verbatim' OR importance = 'critical')")
def induced_subgraph(spark, sf_dir):
    return relations.induced_subgraph(d.edge_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir).where("retention = 'verbatim' or importance = 'critical'"))


@query("""SELECT from_id, to_id, strength, CASE WHEN from_id IN (SELECT id FROM c WHERE retention = 'verbatim' OR importance = 'critical') THEN 'out' ELSE 'in' END AS side FROM e
WHERE (from_id IN (SELECT id FROM c WHERE retention = 'verbatim' OR importance = 'critical')) <> (to_id IN (SELECT id FROM c WHERE retention = 'verbatim' OR importance = 'critical'))""")
def boundary_edges(spark, sf_dir):
    return relations.boundary_edges(d.edge_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir).where("retention = 'verbatim' or importance = 'critical'"))


@query("""SELECT e.from_id, e.to_id, e.strength, ga.chapter_id, ga.group_id FROM e JOIN c a ON a.id = from_id JOIN c b ON b.id = to_id
JOIN g ga ON ga.chapter_id = a.chapter_id AND ga.fragment_id = a.fragment_id JOIN g gb ON gb.chapter_id = b.chapter_id AND gb.fragment_id = b.fragment_id
WHERE ga.chapter_id = gb.chapter_id AND ga.group_id = gb.group_id""")
def group_edges(spark, sf_dir):
    return relations.group_edges(d.chunk_rows(spark, sf_dir), d.edge_rows(spark, sf_dir), d.group_rows(spark, sf_dir))


@query("SELECT chapter_id, fragment_id, round(start_incision, 6) AS start_incision, round(end_incision, 6) AS end_incision FROM incision")
def fragment_incision(spark, sf_dir):
    found = weights.fragment_incisions(d.chunk_rows(spark, sf_dir), d.weighted_edges(spark, sf_dir))
    return found.select("chapter_id", "fragment_id", r6("start_incision").alias("start_incision"), r6("end_incision").alias("end_incision"))


_LEVEL = "CASE WHEN {v} <= 0 THEN 0 WHEN low IS NULL OR {v} >= threshold THEN 10 ELSE least(greatest(round_even(1 + (ln({v}) - ln(low)) / CASE WHEN ln(high) - ln(low) = 0 THEN 1 ELSE ln(high) - ln(low) END * 9, 0), 1), 10) END::INT"


@query(f""", rounded AS (SELECT chapter_id, fragment_id, round(start_incision, 9) AS a, round(end_incision, 9) AS b FROM incision),
vals AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM (SELECT unnest([a, b]) AS v FROM rounded) WHERE v > 0),
top AS (SELECT v AS threshold FROM vals WHERE r = least(floor(n * 0.98)::BIGINT, n - 1)),
facts AS (SELECT min(v) AS low, max(v) AS high FROM vals, top WHERE v < threshold)
SELECT chapter_id, fragment_id, {_LEVEL.format(v="a")} AS start_level, {_LEVEL.format(v="b")} AS end_level FROM rounded LEFT JOIN top ON true LEFT JOIN facts ON true""")
def incision_level(spark, sf_dir):
    return _levels(spark, sf_dir, "corpus")


#: Levels whose facts belong to a chapter; scope tells which chapters o count for chapter q.
_SCOPED = """, rounded AS (SELECT chapter_id, fragment_id, round(start_incision, 9) AS a, round(end_incision, 9) AS b FROM incision),
own AS (SELECT chapter_id, unnest([a, b]) AS v FROM rounded),
vals AS (SELECT q.chapter_id, v, row_number() OVER (PARTITION BY q.chapter_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY q.chapter_id) AS n
  FROM (SELECT DISTINCT chapter_id FROM rounded) q JOIN own o ON o.chapter_id {scope} q.chapter_id WHERE v > 0),
top AS (SELECT chapter_id, v AS threshold FROM vals WHERE r = least(floor(n * 0.98)::BIGINT, n - 1)),
facts AS (SELECT vals.chapter_id, min(v) AS low, max(v) AS high FROM vals JOIN top ON top.chapter_id = vals.chapter_id WHERE v < threshold GROUP BY 1)
SELECT rounded.chapter_id, fragment_id, {a} AS start_level, {b} AS end_level FROM rounded LEFT JOIN top ON top.chapter_id = rounded.chapter_id LEFT JOIN facts ON facts.chapter_id = rounded.chapter_id"""


def _levels(spark, sf_dir, scope: str):
    c = d.chunk_table(spark, sf_dir)
    found = weights.fragment_incisions(c, kept(weights.with_edge_weights(c, d.edge_rows(spark, sf_dir, c))))
    return weights.incision_levels(found, scope=scope).select("chapter_id", "fragment_id", "start_level", "end_level")


@query(_SCOPED.format(scope="<=", a=_LEVEL.format(v="a"), b=_LEVEL.format(v="b")))
def incision_level_prefix(spark, sf_dir):
    return _levels(spark, sf_dir, "prefix")


@query(_SCOPED.format(scope="=", a=_LEVEL.format(v="a"), b=_LEVEL.format(v="b")))
def incision_level_chapter(spark, sf_dir):
    return _levels(spark, sf_dir, "chapter")


def _graph(spark, sf_dir):
    """Chunks without their texts, edges and groups, all from one written table."""
    c = d.chunk_table(spark, sf_dir)
    return c, d.edge_rows(spark, sf_dir, c), d.group_rows(spark, sf_dir, c)


@query(""", und AS (SELECT from_id AS a, to_id AS b FROM e JOIN c x ON x.id = from_id JOIN c y ON y.id = to_id WHERE x.fragment_id // 2 = y.fragment_id // 2
  UNION ALL SELECT to_id, from_id FROM e JOIN c x ON x.id = from_id JOIN c y ON y.id = to_id WHERE x.fragment_id // 2 = y.fragment_id // 2),
reach AS (SELECT id, id AS r FROM c UNION SELECT reach.id, und.b FROM reach JOIN und ON reach.r = und.a)
SELECT id, min(r) AS component FROM reach GROUP BY 1""")
def components(spark, sf_dir):
    return chains.group_components(*_graph(spark, sf_dir))


@query("""SELECT source_id, id, round(sum(ink), 9) AS ink FROM (
  SELECT a AS source_id, b AS id, weight / sum(weight) OVER (PARTITION BY a) * 0.75 AS ink FROM (SELECT from_id AS a, to_id AS b, weight FROM w UNION ALL SELECT to_id, from_id, weight FROM w)) GROUP BY 1, 2""")
def ink_fingerprint_layer1(spark, sf_dir):
    return chains.first_layer(d.weighted_edges(spark, sf_dir)).select("source_id", "id", F.round("ink", 9).alias("ink"))


#: Edges within groups, weighed alone; then a layer of ink for each step, the last layer carried along as it closes vertices too.
_INK = """, ge AS (SELECT from_id, to_id, st FROM e JOIN c a ON a.id = from_id JOIN c b ON b.id = to_id WHERE a.chapter_id = b.chapter_id AND a.fragment_id // 2 = b.fragment_id // 2),
ginc AS (SELECT id, sum(st) AS total FROM (SELECT from_id AS id, st FROM ge UNION ALL SELECT to_id, st FROM ge) GROUP BY 1),
gw AS MATERIALIZED (SELECT ge.*, greatest(a.weight * st / ia.total + b.weight * st / ib.total, 0.1::DOUBLE) AS weight
  FROM ge JOIN c a ON a.id = from_id JOIN c b ON b.id = to_id JOIN ginc ia ON ia.id = from_id JOIN ginc ib ON ib.id = to_id),
near AS MATERIALIZED (SELECT id, other, sum(weight) AS weight FROM (SELECT from_id AS id, to_id AS other, weight FROM gw UNION ALL SELECT to_id, from_id, weight FROM gw) WHERE id <> other GROUP BY 1, 2),
flow AS (
  SELECT id AS source_id, id, 1.0::DOUBLE AS ink, 0 AS layer, 0 AS step FROM c
  UNION ALL
  (WITH given AS (
     SELECT f.source_id, near.other AS id, f.ink * near.weight / sum(near.weight) OVER (PARTITION BY f.source_id, f.id) * 0.75 AS ink, f.step
     FROM flow f JOIN near ON near.id = f.id
     WHERE f.layer = f.step AND NOT EXISTS (SELECT 1 FROM flow o WHERE o.source_id = f.source_id AND o.id = near.other)),
   fresh AS (SELECT source_id, id, sum(ink) AS ink, step + 1 AS layer, step + 1 AS step FROM given GROUP BY source_id, id, step)
   SELECT * FROM fresh UNION ALL SELECT source_id, id, ink, layer, step + 1 FROM flow WHERE layer = step AND source_id IN (SELECT source_id FROM fresh))
),
spread AS MATERIALIZED (SELECT source_id, id, ink FROM flow WHERE layer = step),
print AS MATERIALIZED (SELECT source_id, id, ink / sum(ink) OVER (PARTITION BY source_id) AS ink FROM spread)
"""


@query(_INK + "SELECT source_id, id, round(ink, 9) AS ink FROM print")
def ink_fingerprint(spark, sf_dir):
    found = chains.fingerprints(*_graph(spark, sf_dir))
    return found.select("source_id", "id", F.round("ink", 9).alias("ink"))


@query(_INK + "SELECT source_id, id, layer, round(ink, 9) AS ink FROM flow WHERE layer = step")
def ink_layers(spark, sf_dir):
    found = diffusion.inner_layers(*_graph(spark, sf_dir))
    return found.select("source_id", "id", "layer", F.round("ink", 9).alias("ink"))


@query(_INK + """SELECT from_id, to_id, round(sqrt(sum(x * x)), 6) AS distance FROM (
  SELECT from_id, to_id, id, sum(ink) AS x FROM (
    SELECT p.from_id, p.to_id, print.id, ink FROM (SELECT DISTINCT from_id, to_id FROM ge) p JOIN print ON source_id = from_id
    UNION ALL SELECT p.from_id, p.to_id, print.id, -ink FROM (SELECT DISTINCT from_id, to_id FROM ge) p JOIN print ON source_id = to_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def ink_distance(spark, sf_dir):
    found = diffusion.inner_distances(*_graph(spark, sf_dir))
    return found.select("from_id", "to_id", r6("distance").alias("distance"))


@query()
def snakes(spark, sf_dir):
    return chains.chains(*_graph(spark, sf_dir), limit=150)


@query("SELECT chapter_id, group_id, local_snake_id, chunk_id, position::INT AS position FROM m")
def snake_members(spark, sf_dir):
    return d.member_rows(spark, sf_dir).select("chapter_id", "group_id", "local_snake_id", "chunk_id", "position")


@query("SELECT snake_id, size, first_label, last_label, tokens, round(weight, 6) AS weight FROM totals")
def snake_totals(spark, sf_dir):
    return chains.chain_totals(d.member_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir)).withColumn("weight", r6("weight"))


@query(""", start AS (SELECT snake_id, min(chunk_id) AS k FROM m GROUP BY 1)
SELECT CASE WHEN sa.k < sb.k THEN sa.snake_id ELSE sb.snake_id END AS from_snake_id, CASE WHEN sa.k < sb.k THEN sb.snake_id ELSE sa.snake_id END AS to_snake_id, round(sum(w.weight), 6) AS weight
FROM w JOIN m a ON a.chunk_id = from_id JOIN m b ON b.chunk_id = to_id JOIN start sa ON sa.snake_id = a.snake_id JOIN start sb ON sb.snake_id = b.snake_id
WHERE a.snake_id <> b.snake_id GROUP BY 1, 2""")
def snake_graph(spark, sf_dir):
    found = chains.chain_graph(d.member_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir), d.weighted_edges(spark, sf_dir))
    return found.withColumn("weight", r6("weight"))


@query()
def wave_forward(spark, sf_dir):
    return memory.forward_scores(d.chunk_rows(spark, sf_dir), d.edge_rows(spark, sf_dir))


@query()
def wave_topk(spark, sf_dir):
    return memory.recall(d.chunk_rows(spark, sf_dir), d.edge_rows(spark, sf_dir))


def _clues(spark, sf_dir, chunks=None):
    m = d.member_rows(spark, sf_dir, chunks)
    totals = chains.chain_totals(m, d.chunk_rows(spark, sf_dir) if chunks is None else chunks)
    return m.select("chapter_id", "group_id", "snake_id").distinct().join(totals, "snake_id").select("chapter_id", "group_id", F.col("snake_id").alias("clue_id"), "weight", F.concat("first_label", F.lit(" → "), "last_label").alias("label"))


@query("SELECT chapter_id, snake_id AS clue_id, first_label || ' → ' || last_label AS label, round(CASE WHEN sum(weight) OVER p > 0 THEN weight / sum(weight) OVER p ELSE weight END, 6) AS weight FROM totals WINDOW p AS (PARTITION BY chapter_id)")
def clue_weight_norm(spark, sf_dir):
    return clues.normalised_weights(_clues(spark, sf_dir), "chapter_id").select("chapter_id", "clue_id", "label", r6("weight").alias("weight"))


@query("SELECT * FROM (SELECT chapter_id, snake_id AS clue_id, (row_number() OVER (PARTITION BY chapter_id ORDER BY weight DESC, snake_id) - 1)::INT AS rank FROM totals) WHERE rank >= 3")
def clue_tail(spark, sf_dir):
    return clues.tail(_clues(spark, sf_dir), ["chapter_id"], max_clues=4).select("chapter_id", "clue_id", "rank")


@query(""", late AS MATERIALIZED (SELECT * FROM (SELECT chapter_id, snake_id, row_number() OVER (PARTITION BY chapter_id ORDER BY weight DESC, snake_id) - 1 AS rank FROM totals) WHERE rank >= 4),
frs AS MATERIALIZED (SELECT DISTINCT l.chapter_id, l.snake_id, l.rank, c.fragment_id FROM late l JOIN m ON m.snake_id = l.snake_id JOIN c ON c.id = m.chunk_id)
SELECT a.chapter_id, a.snake_id AS clue_a, b.snake_id AS clue_b, count(*) AS overlap
FROM frs a JOIN frs b ON a.chapter_id = b.chapter_id AND a.fragment_id = b.fragment_id AND a.rank < b.rank GROUP BY 1, 2, 3""")
def clue_overlap(spark, sf_dir):
    of = d.member_rows(spark, sf_dir).join(d.chunk_rows(spark, sf_dir).select(F.col("id").alias("chunk_id"), "fragment_id"), "chunk_id")
    return clues.overlaps(clues.tail(_clues(spark, sf_dir), ["chapter_id"], max_clues=6), of.select(F.col("snake_id").alias("clue_id"), "fragment_id"), ["chapter_id"])


@query("""SELECT chapter_id, group_id, snake_id, snake_id AS parsed_id, size::BIGINT AS n, first_label, last_label FROM totals""")
def chains_to_json(spark, sf_dir):
    made = workspace.chains_json(d.member_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir))
    parsed = F.from_json("value", "snake_id long, size long, chunks array<struct<id:long,label:string,content:string>>")
    rows = made.withColumn("x", parsed)
    return rows.select("chapter_id", "group_id", "snake_id", F.col("x.snake_id").alias("parsed_id"), F.col("x.size").alias("n"), F.col("x.chunks")[0]["label"].alias("first_label"), F.element_at("x.chunks", -1)["label"].alias("last_label"))


@query("SELECT chapter_id, fragment_id, 'fragment ' || fragment_id AS synopsis, count(*) AS n, sum(token_count)::BIGINT AS tokens, string_agg(text, '' ORDER BY sentence_index) AS text FROM s GROUP BY 1, 2")
def fragment_to_json(spark, sf_dir):
    rows = d.sentence_rows(spark, sf_dir)
    synopses = rows.select("chapter_id", "fragment_id").distinct().withColumn("synopsis", F.concat(F.lit("fragment "), F.col("fragment_id").cast("string")))
    made = workspace.fragment_json(rows, synopses).withColumn("x", F.from_json("value", "synopsis string, sentences array<struct<text:string,token_count:long>>"))
    tokens = F.aggregate("x.sentences", F.lit(0).cast("long"), lambda a, y: a + y["token_count"])
    return made.select("chapter_id", "fragment_id", "x.synopsis", F.size("x.sentences").cast("long").alias("n"), tokens.alias("tokens"), F.array_join("x.sentences.text", "").alias("text"))


@query()
def clue_merge(spark, sf_dir):
    c = d.chunk_table(spark, sf_dir)
    members = d.member_rows(spark, sf_dir, c).select("snake_id", "chunk_id")
    rows = members.join(c.select(F.col("id").alias("chunk_id"), "chapter_id", "fragment_id", "sentence_index"), "chunk_id").join(_clues(spark, sf_dir, c).select(F.col("clue_id").alias("snake_id"), "label", "weight"), "snake_id")
    return clues.merge_clues(rows.withColumn("group_id", (F.col("fragment_id") / 8).cast("int")), ["chapter_id", "group_id"], max_clues=6)


_COVER = """, cover AS (
  SELECT chapter_id, fragment_id, sentence_index, arg_max(label, r * 1000 + i) AS label, arg_max(retention, r) AS retention, arg_max(importance, i) AS importance
  FROM (SELECT cs.*, label, retention, importance, CASE retention WHEN 'verbatim' THEN 27 WHEN 'detailed' THEN 9 WHEN 'focused' THEN 3 WHEN 'relevant' THEN 1 ELSE 0 END AS r,
          CASE importance WHEN 'critical' THEN 9 WHEN 'important' THEN 3 WHEN 'helpful' THEN 1 ELSE 0 END AS i FROM cs JOIN c ON c.id = cs.chunk_id) GROUP BY 1, 2, 3
), spans AS (
  SELECT chapter_id, fragment_id, span, count(*) AS n, any_value(label) AS label, arg_min(retention, sentence_index) FILTER (retention IS NOT NULL AND first_of) AS retention,
         arg_min(importance, sentence_index) FILTER (importance IS NOT NULL AND first_of) AS importance, string_agg(text, ' ' ORDER BY sentence_index) AS text
  FROM (SELECT *, begins = 1 AS first_of, sum(begins) OVER (PARTITION BY chapter_id, fragment_id ORDER BY sentence_index) - 1 AS span
        FROM (SELECT s.*, label, retention, importance, CASE WHEN label IS NULL OR lag(label) OVER o IS NULL OR label <> lag(label) OVER o THEN 1 ELSE 0 END AS begins
              FROM s LEFT JOIN cover USING (chapter_id, fragment_id, sentence_index) WINDOW o AS (PARTITION BY chapter_id, fragment_id ORDER BY sentence_index))) GROUP BY 1, 2, 3
)
"""


def _covered(spark, sf_dir):
    return markup.coverage(d.chunk_rows(spark, sf_dir), d.chunk_sentence_rows(spark, sf_dir))


def _spans(spark, sf_dir):
    return markup.islands(d.sentence_rows(spark, sf_dir), _covered(spark, sf_dir))


@query(_COVER + "SELECT chapter_id, fragment_id, sentence_index, label, retention, importance FROM cover")
def coverage_attrs(spark, sf_dir):
    return _covered(spark, sf_dir)


@query(_COVER + "SELECT chapter_id, fragment_id, span::BIGINT AS span, n, label, text FROM spans")
def label_islands(spark, sf_dir):
    return _spans(spark, sf_dir).select("chapter_id", "fragment_id", "span", "n", "label", "text")


_GAPS = """, syn AS (SELECT chapter_id, fragment_id, CASE WHEN fragment_id % 5 = 1 THEN '' ELSE 'synopsis ' || fragment_id END AS synopsis FROM s GROUP BY 1, 2),
used AS (SELECT DISTINCT chapter_id, fragment_id FROM s WHERE fragment_id % 3 = 0),
gaps AS (SELECT u.chapter_id, u.fragment_id, string_agg(y.synopsis, ' ' ORDER BY y.fragment_id) AS synopses
  FROM (SELECT *, lag(fragment_id) OVER (PARTITION BY chapter_id ORDER BY fragment_id) AS prev FROM used) u
  JOIN syn y ON y.chapter_id = u.chapter_id AND y.fragment_id > u.prev AND y.fragment_id < u.fragment_id WHERE y.synopsis <> '' GROUP BY 1, 2)
"""


def _gaps(spark, sf_dir):
    frs = d.sentence_rows(spark, sf_dir).select("chapter_id", "fragment_id").distinct()
    synopsis = F.when(F.col("fragment_id") % 5 == 1, "").otherwise(F.concat(F.lit("synopsis "), F.col("fragment_id").cast("string")))
    return markup.gap_synopses(frs.where("fragment_id % 3 = 0"), frs.withColumn("synopsis", synopsis))


@query(_GAPS + "SELECT * FROM gaps")
def gap_synopses(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(_COVER + _GAPS + """, shown AS (SELECT chapter_id, fragment_id, string_agg(CASE WHEN label IS NULL THEN text ELSE '<chunk label="' || label || '"' || coalesce(' retention="' || retention || '"', '')
  || coalesce(' importance="' || importance || '"', '') || '>' || text || '</chunk>' END, ' ' ORDER BY span) AS t FROM spans GROUP BY 1, 2)
SELECT chapter_id, string_agg(coalesce(synopses || chr(10) || chr(10), '') || t, chr(10) || chr(10) ORDER BY fragment_id) AS text
FROM shown JOIN used USING (chapter_id, fragment_id) LEFT JOIN gaps USING (chapter_id, fragment_id) GROUP BY 1""")
def marked_text(spark, sf_dir):
    shown = markup.marked_fragments(_spans(spark, sf_dir)).where("fragment_id % 3 = 0")
    return markup.marked_text(shown, _gaps(spark, sf_dir))


@query("SELECT chapter_id, (fragment_id // 2)::INT AS group_id, string_agg(text, ' ' ORDER BY sentence_index) AS text FROM s GROUP BY 1, 2")
def group_text(spark, sf_dir):
    rows = d.sentence_rows(spark, sf_dir).withColumn("group_id", (F.col("fragment_id") / 2).cast("int"))
    return joined_text(rows, ["chapter_id", "group_id"], " ")


@query("SELECT snake_id, 100.0::DOUBLE * count(retention) / count(*) AS ratio FROM m JOIN c ON c.id = m.chunk_id GROUP BY 1")
def retention_ratio(spark, sf_dir):
    return review.retention_ratios(d.member_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir), "snake_id")


@query(""", ratios AS (SELECT m.chapter_id, m.group_id, snake_id, 100.0::DOUBLE * count(retention) / count(*) AS ratio FROM m JOIN c ON c.id = m.chunk_id GROUP BY 1, 2, 3)
SELECT chapter_id, group_id, count(*) AS n, count(*) FILTER (ratio = 0) AS none, count(*) FILTER (ratio > 0 AND ratio < 30) AS low, count(*) FILTER (ratio >= 30 AND ratio < 70) AS middle,
       count(*) FILTER (ratio >= 70 AND ratio < 100) AS high, count(*) FILTER (ratio = 100) AS all_kept, round(count(*) FILTER (ratio = 0 OR ratio = 100) / count(*), 6) AS extremes,
       CASE WHEN count(*) FILTER (ratio = 0 OR ratio = 100) / count(*) >= 0.7 THEN 'strong' WHEN count(*) FILTER (ratio = 0 OR ratio = 100) / count(*) >= 0.5 THEN 'weak' ELSE 'none' END AS verdict
FROM ratios GROUP BY ROLLUP (chapter_id, group_id)""")
def retention_histogram(spark, sf_dir):
    ratios = review.retention_ratios(d.member_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir), "chapter_id", "group_id", "snake_id")
    return review.ratio_histogram(ratios).withColumn("extremes", r6("extremes"))


@query(""", listed AS (SELECT m.chapter_id, m.group_id, snake_id, string_agg("left"(content, 60), ' | ' ORDER BY position) AS previews FROM m JOIN c ON c.id = m.chunk_id GROUP BY 1, 2, 3)
SELECT l.snake_id, l.chapter_id, l.group_id, previews, round(weight, 6) AS weight, first_label || ' → ' || last_label AS label,
       row_number() OVER (PARTITION BY l.chapter_id, l.group_id ORDER BY round(weight, 6) DESC, l.snake_id)::INT AS line FROM listed l JOIN totals t ON t.snake_id = l.snake_id""")
def hierarchy_report(spark, sf_dir):
    m, c = d.member_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir)
    return review.hierarchy_lines(m, c, chains.chain_totals(m, c))


@query("SELECT id, CASE greatest(CASE WHEN retention IN ('verbatim', 'detailed') THEN 3 WHEN retention = 'focused' THEN 2 WHEN retention = 'relevant' THEN 1 ELSE 0 END, CASE importance WHEN 'critical' THEN 3 WHEN 'important' THEN 2 WHEN 'helpful' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS tier FROM c")
def tier_map(spark, sf_dir):
    return d.chunk_rows(spark, sf_dir).select("id", review.tier().alias("tier"))


@query("SELECT e.from_id AS id, e.to_id AS other_id, e.strength, c.label AS far_label FROM e JOIN c ON c.id = e.to_id")
def out_edges(spark, sf_dir):
    return relations.neighbours(d.chunk_rows(spark, sf_dir), d.edge_rows(spark, sf_dir))


@query("SELECT e.to_id AS id, e.from_id AS other_id, e.strength, c.label AS far_label FROM e JOIN c ON c.id = e.from_id")
def in_edges(spark, sf_dir):
    return relations.neighbours(d.chunk_rows(spark, sf_dir), d.edge_rows(spark, sf_dir), "to_id", "from_id")


@query("SELECT e.from_id, e.to_id, e.strength, a.label AS from_label, b.label AS to_label FROM e JOIN c a ON a.id = from_id JOIN c b ON b.id = to_id")
def edges_with_chunks(spark, sf_dir):
    return relations.edges_with_chunks(d.chunk_rows(spark, sf_dir), d.edge_rows(spark, sf_dir))


@query("SELECT from_id AS id, count(*) AS out_degree FROM e GROUP BY 1")
def out_degree(spark, sf_dir):
    return relations.out_degrees(d.edge_rows(spark, sf_dir))


@query("SELECT chapter_id, id AS from_id, nxt AS to_id FROM (SELECT chapter_id, id, lead(id) OVER (PARTITION BY chapter_id ORDER BY fragment_id, sentence_index, id) AS nxt FROM c) WHERE nxt IS NOT NULL")
def temporal_edges(spark, sf_dir):
    return relations.temporal_edges(d.chunk_rows(spark, sf_dir))


@query("SELECT chapter_id, fragment_id, string_agg(id || '. [' || label || '] - ' || content, chr(10) ORDER BY id) AS prompt FROM c GROUP BY 1, 2")
def prompt_projection(spark, sf_dir):
    return relations.prompt_lines(d.chunk_rows(spark, sf_dir), ["chapter_id", "fragment_id"])


@query("SELECT greatest(to_id, from_id) AS from_id, least(to_id, from_id) AS to_id, strength FROM e")
def edge_direction(spark, sf_dir):
    return d.edge_rows(spark, sf_dir).select(*relations.normalised_edge(F.col("to_id"), F.col("from_id")), "strength")


@query("""SELECT a.chapter_id, greatest(e.from_id, e.to_id) AS from_id, least(e.from_id, e.to_id) AS to_id, e.strength FROM e JOIN c a ON a.id = e.from_id JOIN c b ON b.id = e.to_id
WHERE a.fragment_id > 0 OR a.sentence_index % 2 = 0""")
def link_resolve(spark, sf_dir):
    c = d.chunk_rows(spark, sf_dir)
    e = d.edge_rows(spark, sf_dir).join(c.select(F.col("id").alias("from_id"), "chapter_id", "fragment_id", "sentence_index"), "from_id")
    dst = F.when((F.col("fragment_id") > 0) | (F.col("sentence_index") % 2 == 0), F.col("to_id").cast("string")).otherwise("nowhere")
    links = e.select("chapter_id", F.concat(F.lit("t"), F.col("from_id").cast("string")).alias("src"), dst.alias("dst"), "strength")
    return relations.resolve_links(links, c.select("chapter_id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"), "id"), c.select("chapter_id", "id"))


@query("SELECT from_id, to_id, strength FROM e")
def link_strength(spark, sf_dir):
    e = d.edge_rows(spark, sf_dir)
    links = e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "strength", F.lit(1).alias("pos")).unionByName(e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("late").alias("strength"), F.lit(2).alias("pos")))
    return relations.link_strength(e, links)


@query("SELECT id, CASE WHEN tokens % 6 = 1 THEN 'important' WHEN tokens % 3 = 1 THEN 'critical' ELSE importance END AS importance FROM c")
def annotation_update(spark, sf_dir):
    c = d.chunk_rows(spark, sf_dir)
    notes = c.where("tokens % 3 = 1").select(F.col("id").alias("chunk_id"), F.lit("critical").alias("importance"), F.lit(0).alias("pos")).unionByName(c.where("tokens % 6 = 1").select(F.col("id").alias("chunk_id"), F.lit("important").alias("importance"), F.lit(1).alias("pos")))
    return relations.annotated(c, notes).select("id", "importance")


@query("SELECT from_id, to_id, strength FROM e WHERE from_id % 2 = 1")
def edge_first_wins(spark, sf_dir):
    e = d.edge_rows(spark, sf_dir)
    twice = e.withColumn("n", F.lit(0)).unionByName(e.withColumn("n", F.lit(1)).withColumn("strength", F.lit("late")))
    return relations.first_wins(e.where("from_id % 2 = 0"), twice, ["from_id", "to_id"], "n").select("from_id", "to_id", "strength")


@query("SELECT max(id) + 1 AS next_id, max(chapter_id) + 1 AS next_chapter_id FROM c")
def next_ids(spark, sf_dir):
    return relations.next_ids(d.chunk_rows(spark, sf_dir), "id", "chapter_id")


@query("SELECT DISTINCT chapter_id, group_id FROM g")
def group_ids(spark, sf_dir):
    return d.group_rows(spark, sf_dir).select("chapter_id", "group_id").distinct()


@query("SELECT snake_id, chapter_id, group_id FROM totals WHERE chapter_id = 7")
def snakes_of_chapter(spark, sf_dir):
    return d.member_rows(spark, sf_dir).where("chapter_id = 7").select("snake_id", "chapter_id", "group_id").distinct()


@query("SELECT id, round(weight * pow(0.5, generation), 6) AS score FROM c")
def generation_decay(spark, sf_dir):
    return d.chunk_rows(spark, sf_dir).select("id", r6(memory.decayed("weight", "generation")).alias("score"))


@query("""SELECT from_id, to_id, round((1 - d / 2) * (st + CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN ia IS NOT NULL AND ib IS NOT NULL THEN 3 ELSE 0 END), 6) AS value FROM (
  SELECT e.*, a.retention AS ra, b.retention AS rb, a.importance AS ia, b.importance AS ib, abs(a.tokens - b.tokens) / (1.0::DOUBLE + a.tokens + b.tokens) AS d FROM e JOIN c a ON a.id = from_id JOIN c b ON b.id = to_id)""")
def edge_merge_value(spark, sf_dir):
    return chains.merge_values(d.edge_rows(spark, sf_dir), d.chunk_rows(spark, sf_dir)).withColumn("value", r6("value"))


@query("""SELECT chapter_id, fragment_id, (sum(token_count) OVER (PARTITION BY chapter_id ORDER BY fragment_id) // 1000)::INT AS part FROM (SELECT chapter_id, fragment_id, sum(token_count) AS token_count FROM s GROUP BY 1, 2)""")
def running_budget(spark, sf_dir):
    totals = fragment_totals(d.sentence_rows(spark, sf_dir))
    run = F.sum("token_count").over(Window.partitionBy("chapter_id").orderBy("fragment_id"))
    return totals.select("chapter_id", "fragment_id", F.floor(run / 1000).cast("int").alias("part"))


@query("""SELECT c.id, to_json(coalesce(list_distinct(list(e.from_id) FILTER (e.from_id IS NOT NULL)).list_sort(), []))::VARCHAR AS links FROM c LEFT JOIN e ON e.to_id = c.id GROUP BY 1""")
def link_append(spark, sf_dir):
    edges = d.edge_rows(spark, sf_dir)
    chunks = d.chunk_rows(spark, sf_dir).select("id", F.lit(None).cast("array<bigint>").alias("links"))
    return relations.with_links(chunks, edges.unionByName(edges)).select("id", F.to_json("links").alias("links"))


def _new_workspace(spark):
    return workspace.Workspace(spark, f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex}")


def _saved_graph(spark, sf_dir):
    """Saved in two calls that overlap: some chunks and edges have no weight, odd chunks cover nothing."""
    work, c = _new_workspace(spark), kept(d.chunk_rows(spark, sf_dir))
    covered = kept(d.chunk_sentence_rows(spark, sf_dir, c).where("chunk_id % 2 = 0"))
    e = kept(weights.with_edge_weights(c, d.edge_rows(spark, sf_dir, c)).withColumn("weight", F.when(F.col("from_id") % 5 != 0, F.col("weight"))))
    c = c.withColumn("weight", F.when(F.col("tokens") % 7 != 0, F.col("weight")))
    early = c.where("fragment_id < 3")
    workspace.save_graph(work, early, e.join(early.select(F.col("id").alias("from_id")), "from_id", "left_semi"), covered)
    workspace.save_graph(work, c, e, covered)
    return work


@query("SELECT chapter_id, from_id, to_id, strength, round(CASE WHEN from_id % 5 = 0 THEN 0.1 ELSE w.weight END, 6) AS weight FROM w JOIN c ON c.id = from_id")
def saved_edges(spark, sf_dir):
    return _saved_graph(spark, sf_dir).read("knowledge_edges").withColumn("weight", r6("weight"))


@query("""SELECT id, c.chapter_id, round(CASE WHEN tokens % 7 = 0 THEN 0 ELSE weight END, 6)::DOUBLE AS weight, count(*) AS n_sentences
FROM c JOIN cs ON cs.chunk_id = c.id AND (id % 2 = 0 OR cs.sentence_index = c.sentence_index) GROUP BY id, c.chapter_id, tokens, weight""")
def saved_chunks(spark, sf_dir):
    work = _saved_graph(spark, sf_dir)
    covered = work.read("chunk_sentences").groupBy(F.col("chunk_id").alias("id")).agg(F.count("*").alias("n_sentences"))
    return work.read("chunks").join(covered, "id").select("id", "chapter_id", r6("weight").alias("weight"), "n_sentences")


@query("SELECT chapter_id, group_id, fragment_id, row_number() OVER (PARTITION BY chapter_id, group_id ORDER BY fragment_id)::INT AS place FROM g")
def saved_groups(spark, sf_dir):
    work = _new_workspace(spark)
    listed = d.group_rows(spark, sf_dir).groupBy("chapter_id", "group_id").agg(F.collect_list("fragment_id").alias("fragment_ids"))
    workspace.save_groups(work, listed)
    workspace.save_groups(work, listed)
    return work.read("fragment_groups").withColumn("place", F.row_number().over(Window.partitionBy("chapter_id", "group_id").orderBy("fragment_id")))


@query(""", n AS (SELECT snake_id, row_number() OVER (ORDER BY chapter_id, group_id, snake_id) AS id FROM totals),
first_at AS (SELECT snake_id, min((c.fragment_id, c.sentence_index)) AS at FROM m JOIN c ON c.id = chunk_id GROUP BY 1),
crossing AS (
  SELECT CASE WHEN fa.at < fb.at THEN a.snake_id ELSE b.snake_id END AS x, CASE WHEN fa.at < fb.at THEN b.snake_id ELSE a.snake_id END AS y, sum(w.weight) AS weight
  FROM w JOIN m a ON a.chunk_id = w.from_id JOIN m b ON b.chunk_id = w.to_id JOIN first_at fa ON fa.snake_id = a.snake_id JOIN first_at fb ON fb.snake_id = b.snake_id
  WHERE a.snake_id <> b.snake_id GROUP BY 1, 2)
SELECT 'out' AS side, nx.id, ny.id AS other_id, round(crossing.weight, 6) AS weight, t.size AS other_size, t.first_label AS other_first, t.last_label AS other_last
FROM crossing JOIN n nx ON nx.snake_id = x JOIN n ny ON ny.snake_id = y JOIN totals t ON t.snake_id = y
UNION ALL
SELECT 'in', ny.id, nx.id, round(crossing.weight, 6), t.size, t.first_label, t.last_label
FROM crossing JOIN n nx ON nx.snake_id = x JOIN n ny ON ny.snake_id = y JOIN totals t ON t.snake_id = x""")
def saved_chain_edges(spark, sf_dir):
    """Chains stored under numbers of their own, then each one's edges with the chain at the other end."""
    work, c = _new_workspace(spark), d.chunk_table(spark, sf_dir)
    e = kept(weights.with_edge_weights(c, d.edge_rows(spark, sf_dir, c)))
    members = kept(d.member_rows(spark, sf_dir, c).drop("snake_id"))
    workspace.save_chains(work, members, c, e)
    stored, edges = work.read("snakes"), work.read("snake_edges")
    out = relations.chain_edges(stored, edges).withColumn("side", F.lit("out"))
    return out.unionByName(relations.chain_edges(stored, edges, incoming=True).withColumn("side", F.lit("in"))).withColumn("weight", r6("weight"))
