"""Hand-computed cases and properties of the graph and text operators."""

import hashlib
import json
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions.json_text import repaired
from loomtext.functions.sentences import fragment_numbers, sentences
from loomtext.operators import chains, clues, extraction, grouping, matching, memory, relations, requests, review, weights
from loomtext.schemas import schema
from loomtext.sources.epub import epub_bytes, read_epub_sentences, spine_documents
from loomtext.sources.html import lenient_pieces, strict_pieces
from loomtext.sources.workspace import Workspace, read_fragment_json, save_chains, save_graph, save_groups


def test_packing(spark):
    df = spark.createDataFrame([([300, 400, 200, 500, 900, 10],)], "n array<int>")
    assert df.select(fragment_numbers(F.col("n"), 800)).first()[0] == [0, 0, 1, 1, 2, 3]


def test_sentences_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two!\nthree")], "chapter_id long, text string")
    assert [(r.chapter_id, r.text) for r in sentences(df).orderBy("chapter_id", "sentence_index").collect()] == [(3, "One."), (3, "Two!"), (3, "three")]


def _graph(spark):
    c = spark.createDataFrame(
        [(1, 0, 7, 0, 0, "A", "a", "detailed", None, 10, 9.0), (2, 0, 7, 0, 1, "B", "b", "focused", None, 10, 3.0)],
        schema("chunks"),
    )
    return c, spark.createDataFrame([(2, 1, "important")], "from_id long, to_id long, strength string")


def test_weights(spark):
    c, e = _graph(spark)
    assert weights.with_edge_weights(c, e).first()["weight"] == 12.0
    one = spark.createDataFrame([("verbatim", "critical")], "retention string, importance string")
    assert one.select(weights.node_weight()).first()[0] == 36
    bare = c.withColumn("weight", F.lit(0.0))
    assert weights.with_edge_weights(bare, e).first()["weight"] == 0.1


def test_unknown_level(spark):
    odd = spark.createDataFrame([("great", None)], "retention string, importance string")
    assert odd.select(weights.node_weight()).first()[0] == 0
    with pytest.raises(Exception, match="unknown level"):
        odd.select(weights.node_weight(strict=True)).collect()


def test_ink_on_a_path():
    raw = np.array([1, 0.75, 0.5625])
    assert np.allclose(chains.ink([1, 2, 3], [(1, 2, 1.0), (2, 3, 1.0)])[0], raw / raw.sum())


def plain_ink(ids, edges):
    """One source at a time, straight from the definition."""
    near = {v: {} for v in ids}
    for u, v, w in edges:
        if u != v:
            near[u][v] = near[u].get(v, 0) + w
            near[v][u] = near[v].get(u, 0) + w
    out = []
    for s in ids:
        conc, seen, front = {s: 1.0}, {s}, [s]
        while front:
            got = {}
            for v in front:
                room = {x: w for x, w in near[v].items() if x not in seen}
                for x, w in room.items():
                    got[x] = got.get(x, 0) + conc[v] * w / sum(room.values()) * 0.75
            conc |= got
            seen |= set(got)
            front = list(got)
        out.append([conc.get(v, 0) / sum(conc.values()) for v in ids])
    return np.array(out)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 12), st.integers(0, 10**6))
def test_ink_and_chains_on_random_graphs(n, seed):
    dice = random.Random(seed)
    ids = list(range(n))
    links = {(i, dice.randrange(i)): dice.choice(["critical", "important", None]) for i in range(1, n)}
    edges = [(u, v, s) for (u, v), s in sorted(links.items())]
    nodes = [{"id": i, "chapter_id": 0, "fragment_id": 0, "sentence_index": i, "tokens": dice.randrange(1, 300), "retention": dice.choice(["verbatim", None]), "importance": None} for i in ids]
    w = [(u, v, x) for (u, v, _), x in zip(edges, chains.local_weights(nodes, edges), strict=True)]
    shares = chains.ink(ids, w)
    assert np.allclose(shares, plain_ink(ids, w))
    assert np.allclose(shares.sum(axis=1), 1)
    assert all(np.linalg.norm(a - b) <= 2**0.5 + 1e-9 for a in shares for b in shares)
    found = chains.greedy_chains(nodes, edges, 700)
    assert sorted(x for c in found for x in c) == ids
    tokens = {x["id"]: x["tokens"] for x in nodes}
    assert all(len(c) == 1 or sum(tokens[x] for x in c) <= 700 for c in found)


def test_components(spark):
    v = spark.createDataFrame([(i,) for i in range(12)], "id long")
    e = spark.createDataFrame([(i + 1, i) for i in range(8)] + [(10, 11)], "from_id long, to_id long")
    got = {r.id: r.component for r in chains.components(v, e).collect()}
    assert got == {**{i: 0 for i in range(9)}, 9: 9, 10: 10, 11: 10}


def test_wave():
    # 3 -> 2 -> 1 and 3 -> 1
    assert memory.wave([3], [(3, 2), (3, 1), (2, 1)], reflect=False) == {3: 1.0, 2: 0.5, 1: 1.0}
    assert memory.recalled([(1, 0), (2, 0), (3, 1)], [], [], 2) == [(1, 0.0), (2, 0.0)]


def test_incision_sums(spark):
    from loomtext.plans import derived as d

    sf = "/root/testdata/sf0.001"
    c, e = d.chunk_rows(spark, sf), d.weighted_edges(spark, sf)
    got = weights.fragment_incisions(c, e).agg(F.sum(F.col("start_incision") + F.col("end_incision"))).first()[0]
    outer = weights.external_edges(c, e).select("id").distinct()
    assert abs(got - c.join(outer, "id").agg(F.sum("weight")).first()[0]) < 1e-6


def test_one_incision_value_is_level_ten(spark):
    df = spark.createDataFrame([(0, 0, 5.0, 0.0)], "chapter_id long, fragment_id int, start_incision double, end_incision double")
    assert weights.incision_levels(df).select("start_level", "end_level").first() == (10, 0)


def test_grouping_covers_and_respects_the_budget():
    dice = random.Random(3)
    tokens = [dice.randrange(1, 500) for _ in range(60)]
    levels = [dice.randrange(11) for _ in tokens]
    groups = grouping.cut_places(tokens, levels, levels, 900)
    assert groups == sorted(groups) and set(groups) == set(range(max(groups) + 1))
    assert all(sum(t for t, g in zip(tokens, groups, strict=True) if g == k) <= 900 for k in set(groups))


def test_clue_merge():
    def clue(i, w, f):
        return {"clue_id": i, "label": str(i), "weight": w, "chunks": [((0, x, 0), i * 10 + x) for x in f], "fragments": {(0, x) for x in f}, "sources": [i]}

    got = clues.merged([clue(1, 9, [1]), clue(2, 8, [2]), clue(3, 7, [3]), clue(4, 2, [5, 6]), clue(5, 1, [5, 6])], 4)
    assert [c["clue_id"] for c in got] == [1, 2, 3, -1]
    assert abs(sum(c["weight"] for c in got) - 1) < 1e-12 and got[-1]["sources"] == [4, 5]


def _normal(text: str) -> str:
    """The normal form a character at a time."""
    text, kept, out = re.sub(r"\s+", " ", text).strip(), [], []
    for i, c in enumerate(text):
        if c != " ":
            kept.append(c)
        elif matching.is_latin(text[i + 1]):
            if len(kept) >= 2 and kept[-1] in "‐‑‒–—―" and matching.is_latin(kept[-2]):
                kept.pop()
            elif kept and matching.is_latin(kept[-1]):
                kept.append(c)
    for c in kept:
        if not (c in "^`|~" or (unicodedata.category(c)[0] == "P" and c not in "“”‘’")):
            out.append(matching.plain_letter(c) if matching.is_latin(c) else c)
    return "".join(out)


def test_normal_form(spark):
    dice = random.Random(5)
    pool = list("abÉéÅİıŉſǅøßªʰ  \t\n\x0b\x1c\x85\u00a0\u2003\u3000") + list("‐–—-'“”‘’\"^`|~$+<=>.,!?_«»¿。、「」中文Σйé1²½😀\u0301\u200b")
    texts = ["", " ", "Été  inter‐ national, 中 文 a b", "a‐ b‐ c", "a - b", "‐ a", "a" * 50 + " b" * 20_000 + "‐ c" * 20_000]
    texts += ["".join(dice.choices(pool, k=dice.randint(1, 40))) for _ in range(4000)]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, t string").select("id", matching.normalize_text("t").alias("n")).collect()
    assert {r.id: r.n for r in rows} == {**{i: _normal(t) for i, t in enumerate(texts)}, -1: None}


def test_key_is_the_one_of_a_sorted_json_text(spark):
    odd = ["plain", "", 'quote " and \\ back \\" / slash', "\x00\x01\x0b\x1f\x7f\b\f\n\r\t", "é 中 😀 \u2028", "\\u000B \\n"]
    rows = [(i, [("system", t), ("user", odd[-1 - i])]) for i, t in enumerate(odd)]
    asked = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: r.key for r in requests.with_keys(asked, requests.Options(model='m"1', temperature=0.5, top_p=1.0)).collect()}
    for i, messages in rows:
        data = {"messages": [{"role": r, "content": c} for r, c in messages], "temperature": 0.5, "top_p": 1.0, "model": 'm"1'}
        assert got[i] == hashlib.sha512(json.dumps(data, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_normalize_and_match(spark):
    assert matching.shares_a_run("abcdefgh", "xxcdefyy", 4) and not matching.shares_a_run("abcdefgh", "xxcdefyy", 5)
    t = spark.createDataFrame([(0, 0, 0, "The first sentence stands here."), (0, 0, 1, "Another thing was said at length.")], "chapter_id long, fragment_id int, sentence_index int, text string")
    s = spark.createDataFrame(
        [(0, 0, 1, "The first sentence stands here."), (0, 0, 2, "ANOTHER thing was said at length"), (0, 0, 3, "thing was said at"), (0, 0, 4, "Another...at length."), (0, 0, 5, "zzz")],
        "chapter_id long, fragment_id int, source_id long, text string",
    )
    got = {(r.source_id, r.sentence_index, r.stage) for r in matching.match_cascade(s, t).collect()}
    assert got == {(1, 0, "exact"), (2, 1, "normalized"), (3, 1, "contained"), (4, 1, "ellipsis"), (5, 0, "fallback")}


def test_links(spark):
    links = spark.createDataFrame([(0, "A", "5", "critical"), (0, "A", "nowhere", None), (0, "5", "99", None)], "chapter_id long, src string, dst string, strength string")
    names = spark.createDataFrame([(0, "A", 9)], "chapter_id long, name string, id long")
    visible = spark.createDataFrame([(0, 5)], "chapter_id long, id long")
    assert [tuple(r) for r in relations.resolve_links(links, names, visible).collect()] == [(0, 9, 5, "critical")]
    with pytest.raises(ValueError):
        relations.lookup(visible, "id", 77)


def test_review(spark):
    df = spark.createDataFrame([("x", "Critical", 0.6, 0), ("x", "minor", 0.4, 1), ("x", None, 0.4, 2)], "k string, severity string, weight double, issue_index int")
    assert abs(review.scores(df, "k").first()["score"] - 6.2) < 1e-12
    assert [r.issue_index for r in review.ranked_issues(df, ["k"], 2).orderBy("rank").collect()] == [0, 1]


def test_requests(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(messages, options):
        calls.add(1)
        return messages[-1]["content"].upper()

    rows = spark.createDataFrame([(1, [("user", "a")]), (2, [("user", "a")]), (3, [("user", "b")])], "id long, messages array<struct<role:string,content:string>>")
    done, new = requests.answers(rows, spark.createDataFrame([], "key string, answer string"), client)
    assert {r.id: r.answer for r in done.collect()} == {1: "A", 2: "A", 3: "B"} and calls.value == 2
    assert requests.answers(rows, new.cache(), client)[1].count() == 0
    tries = []

    def flaky(messages, options):
        tries.append(1)
        raise OSError("Connection lost")

    assert requests.ask(flaky, [], {}, retries=2, wait=0) is None and len(tries) == 3


def test_json_repair():
    assert repaired("```json\n{\"a\": [1, 2,],}\n```") == '{"a": [1, 2]}'
    assert repaired("{'a': 1") == '{"a": 1}' and repaired("no json") is None and repaired(None) is None


def test_html():
    assert strict_pieces("<p>a<b>c<i>d</i>e</b>f</p>") == ["a", "c", "f", "d", "e"]
    assert strict_pieces("<p>a<br>") == [] and strict_pieces(None) == []
    assert lenient_pieces("<p>a<br>b<script>x</script>&amp;") == ["a", "b", "&"]


def test_epub_round_trip(spark, tmp_path):
    book = epub_bytes([("One", "First line. More.\n\n  Second <line>.  "), ("Two", "Third.")], "Title", "Author")
    assert [name for name, _ in spine_documents(book)] == ["chapter_0.xhtml", "chapter_1.xhtml"]
    (tmp_path / "b.epub").write_bytes(book)
    got = [r.text for r in read_epub_sentences(spark, str(tmp_path / "b.epub")).where("chapter_id = 0").orderBy("sentence_index").collect()]
    assert got[-1].endswith("Second <line>.")


def test_workspace(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"))
    with pytest.raises(FileNotFoundError):
        work.require()
    c, e = _graph(spark)
    work.append("chunks", c)
    work.append("chunks", c)
    assert work.require().read("chunks").count() == 2
    members = spark.createDataFrame([(7, 0, 0, 1, 0), (7, 0, 1, 2, 0)], "chapter_id long, group_id int, local_snake_id int, chunk_id long, position int")
    save_chains(work, members, c, weights.with_edge_weights(c, e))
    assert [(r.id, r.first_label) for r in work.snakes(7, 0).collect()] == [(1, "A"), (2, "B")]
    assert work.read("snake_edges").collect()[0][:2] == (1, 2)


def test_saved_graph_has_defaults_and_keeps_what_is_stored(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"))
    c, e = _graph(spark)
    none = c.withColumn("weight", F.lit(None).cast("double"))
    bare = e.select("from_id", "to_id", "strength", F.lit(None).cast("double").alias("weight"))
    odd = spark.createDataFrame([(99, 1, None, 1.0), (2, 98, "helpful", 2.0)], "from_id long, to_id long, strength string, weight double")
    save_graph(work, none.where("false"), bare.where("false"))
    assert work.read("knowledge_edges").isEmpty()
    save_graph(work, none.where("id = 1"), bare.where("false"))
    save_graph(work, none, bare.unionByName(odd), spark.createDataFrame([(2, 7, 0, 5), (2, 7, 0, 6), (50, 7, 0, 1)], "chunk_id long, chapter_id long, fragment_id int, sentence_index int"))
    save_graph(work, c.withColumn("weight", F.lit(5.0)), odd.withColumn("weight", F.lit(9.0)))
    assert {(r.id, r.weight) for r in work.read("chunks").collect()} == {(1, 0.0), (2, 0.0)} and work.read("chunks").count() == 2
    edges = {(r.from_id, r.to_id): (r.weight, r.chapter_id) for r in work.read("knowledge_edges").collect()}
    assert edges == {**{(r.from_id, r.to_id): (0.1, 7) for r in e.collect()}, (2, 98): (2.0, 7)}
    own = c.where("id = 1").first().sentence_index
    assert {(r.chunk_id, r.sentence_index) for r in work.read("chunk_sentences").collect()} >= {(1, own), (2, 5), (2, 6)}
    save_groups(work, spark.createDataFrame([(7, 0, [2, 1]), (7, 1, [])], "chapter_id long, group_id int, fragment_ids array<int>"))
    assert [r.fragment_id for r in work.group_fragments(7, 0).collect()] == [1, 2] and work.group_fragments(7, 1).isEmpty()


def test_fragment_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"gist": "S", "sentences": [{"text": "x", "token_count": 1}]}')
    (tmp_path / "b.json").write_text('[{"text": "y", "token_count": 2}]')
    assert sorted((r.synopsis, r.text) for r in read_fragment_json(spark, str(tmp_path), "gist").collect()) == [("", "y"), ("S", "x")]


def test_second_pass_rates_and_links_what_the_first_one_found(spark):
    flat = spark.createDataFrame([(1, f, i, f"s{f}{i} word.") for f in range(3) for i in range(4)], "chapter_id long, fragment_id int, sentence_index int, text string")

    def second(text, sentences, seen, chunks):
        if text.startswith("s1"):
            return {"importance_annotations": [{"chunk_id": chunks[0]["id"], "importance": "critical"}], "chunks": [], "links": []}
        if text.startswith("s2"):
            raise ValueError("no answer")
        return extraction.stub_second_pass(text, sentences, seen, chunks)

    rows = extraction.extract(flat, second_pass=second).collect()
    chunks = {r.id: r for r in rows if r.kind == "chunk"}
    first = 1_000_000
    assert [(chunks[i].fragment_id, chunks[i].generation) for i in sorted(chunks)] == [(0, 0)] * 3 + [(1, 1)] * 2 + [(2, 2)] * 2
    assert chunks[first].importance is not None and chunks[first + 2].importance == "critical" and chunks[first + 3].importance is None
    edges = {(r.id, r.other_id) for r in rows if r.kind == "edge"}
    assert {(first + 2, first), (first + 2, first + 1)} <= edges and all(a > b for a, b in edges)
    assert [(r.fragment_id, r.content) for r in rows if r.kind == "failed"] == [(2, "ValueError: no answer")]


def test_chains_are_numbered_across_chapters(spark, tmp_path):
    from loomtext.sources.workspace import Workspace, save_chains

    chapters = [1, 2, 70_000, 200_000]
    chunks = [(c * 10 + k, 0, c, 0, k, f"l{k}", f"t{k}", "focused", None, 3, 1.0) for c in chapters for k in range(4)]
    work = Workspace(spark, str(tmp_path / "w"))
    work.append("chunks", spark.createDataFrame(chunks, "id long, generation int, chapter_id long, fragment_id int, sentence_index int, label string, content string, retention string, importance string, tokens int, weight double"))
    members = spark.createDataFrame([(c, 0, k // 2, c * 10 + k, k % 2) for c in chapters for k in range(4)], "chapter_id long, group_id int, local_snake_id int, chunk_id long, position int")
    edges = spark.createDataFrame([(c * 10 + 3, c * 10, "helpful", 1.0) for c in chapters], "from_id long, to_id long, strength string, weight double")
    save_chains(work, members, work.read("chunks"), edges)
    assert [(r.id, r.chapter_id) for r in work.read("snakes").orderBy("id").collect()] == [(k + 1, chapters[k // 2]) for k in range(8)]


def test_waves_of_many_chapters_run_in_batches(spark):
    chunks = spark.createDataFrame([(c, c * 10 + k, k // 2, k // 2) for c in (1, 2, 3) for k in range(5)], "chapter_id long, id long, fragment_id int, generation int")
    pairs = [(4, 3), (4, 0), (3, 1), (0, 2), (2, 4)]
    edges = spark.createDataFrame([(c * 10 + a, c * 10 + b, n) for c in (1, 2) for n, (a, b) in enumerate(pairs)], "from_id long, to_id long, ord int")
    found = memory.forward_scores(chunks, edges)
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # no Python group a chapter
    want = {(c, i, s) for c in (1, 2, 3) for i, s in memory.wave([c * 10 + 4], [(c * 10 + a, c * 10 + b) for a, b in pairs if c < 3], reflect=False).items()}
    assert {tuple(r) for r in found.collect()} == want
    top = [tuple(r) for r in memory.recall(chunks, edges, capacity=2).collect()]
    nodes = [(k, k // 2) for k in range(5)]
    assert sorted(top) == sorted((c, c * 10 + i, s, r) for c in (1, 2) for r, (i, s) in enumerate(memory.recalled(nodes, [4], pairs, 2)))


def test_chapters_are_extracted_in_batches(spark):
    rows = [(c, f, 10 * f + k, f"Sentence {k} of fragment {f} in {c}.") for c in (2, 1) for f in (1, 0) for k in (2, 0, 1)]
    found = extraction.extract(spark.createDataFrame(rows, "chapter_id long, fragment_id int, sentence_index int, text string"))
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # no Python group a chapter
    got = found.collect()
    assert sorted((r.id, r.generation, r.fragment_id, r.sentence_index) for r in got if r.kind == "chunk") == [(c * 1_000_000 + f, f, f, 10 * f) for c in (1, 2) for f in (0, 1)]
    assert sorted((r.id, r.other_id, r.ord) for r in got if r.kind == "edge") == []


def test_groups_of_many_chapters_are_cut_in_batches(spark):
    tokens, start, end = [30, 50, 40, 60, 20], [0, 3, 1, 2, 5], [4, 1, 1, 0, 2]
    rows = [(c, f, start[f], end[f]) for c in (1, 2) for f in (3, 1, 4, 0, 2)]
    levels = spark.createDataFrame(rows, "chapter_id long, fragment_id int, start_level int, end_level int")
    totals = spark.createDataFrame([(c, f, tokens[f]) for c in (1, 2) for f in range(5)], "chapter_id long, fragment_id int, token_count long")
    found = grouping.fragment_groups(levels, totals, budget=100)
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # no Python group a chapter
    want = grouping.cut_places(tokens, start, end, 100)
    assert sorted(tuple(r) for r in found.collect()) == [(c, want[f], f) for c in (1, 2) for f in range(5)]


def test_saving_appends_written_rows(spark, tmp_path, monkeypatch):
    """An append reads its rows several times, so what it is given is a table and not the joins that made it."""
    plans, append = {}, Workspace.append

    def recorded(self, table, rows):
        plans[table] = rows._jdf.queryExecution().optimizedPlan().toString()
        append(self, table, rows)

    monkeypatch.setattr(Workspace, "append", recorded)
    chunks = spark.createDataFrame([(k, 1, 0, k, "l", "t", "verbatim", None, 5, 1.0, 0) for k in range(4)], "id long, chapter_id long, fragment_id int, sentence_index int, label string, content string, retention string, importance string, tokens int, weight double, generation int")
    edges = spark.createDataFrame([(k, k - 1, "critical", 1.0) for k in range(1, 4)], "from_id long, to_id long, strength string, weight double")
    work = Workspace(spark, str(tmp_path / "work"))
    save_graph(work, chunks, edges, spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 1)], "chunk_id long, chapter_id long, fragment_id int, sentence_index int"))
    members = spark.createDataFrame([(1, 0, k % 2, k, k // 2) for k in range(4)], "chapter_id long, group_id int, local_snake_id int, chunk_id long, position int")
    save_chains(work, members, chunks, edges)
    assert {"chunk_sentences", "knowledge_edges", "snakes", "snake_edges"} <= plans.keys()
    assert not [t for t in ("chunk_sentences", "knowledge_edges", "snakes", "snake_edges") if "Join" in plans[t]]
    assert work.read("chunk_sentences").count() == 5 and work.read("knowledge_edges").count() == 3 and work.read("snakes").count() == 2 and work.read("snake_edges").count() == 1
