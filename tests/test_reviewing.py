"""Guidance, reviewers, reviews with history and links, on small tables with a client that counts what it is told."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import compression, relations, requests, reviewing


def test_rendered(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(reviewing.rendered("{{ x }}-{{y}}-{{x}}!", x="x", y="y")).first()[0] == "a--a!"
    with pytest.raises(KeyError):
        reviewing.rendered("{{ z }}", x="x")


def test_guidance_of_null_and_without_answer(spark):
    rows = spark.createDataFrame([(1, "i"), (2, "i"), (3, None)], "id int, intention string")
    got = {r.id: r.guidance for r in reviewing.with_guidance(rows, "{{ intention }}", lambda m, o: m[-1]["content"] + str(o["temperature"])).collect()}
    assert got == {1: "i0.3", 2: "i0.3", 3: None}
    with pytest.raises(Exception, match="no answer"):
        reviewing.with_guidance(rows, "{{ intention }}", lambda m, o: "").collect()


@pytest.fixture()
def critic():
    def answer(messages, options):
        """One issue less with every earlier round; the system message names the severity."""
        left = 2 - sum(m["role"] == "assistant" for m in messages)
        return "```json\n" + json.dumps({"issues": [{"severity": messages[0]["content"], "problem": messages[-1]["content"], "suggestion": ""}] * left}) + "\n```"

    return answer


def test_reviews_keep_their_history(spark, critic):
    reviewers = spark.createDataFrame([(1, 1, 0.5, "major"), (1, 2, 0.25, "critical"), (2, 3, 1.0, "minor")], "group_key long, clue_id long, weight double, reviewer string")
    versions = spark.createDataFrame([(1, "v"), (2, "w")], "group_key long, version string")
    reviews = reviewing.Reviews(reviewers, critic)
    first = reviews(versions, 1)
    assert sorted((r.group_key, r.clue_id, r.issue_index, r.severity, r.problem) for r in first.collect()) == [(1, 1, 0, "major", "v"), (1, 1, 1, "major", "v"), (1, 2, 0, "critical", "v"), (1, 2, 1, "critical", "v"), (2, 3, 0, "minor", "w"), (2, 3, 1, "minor", "w")]
    assert reviews(versions.where("group_key = 1"), 2).count() == 2
    assert {(r.clue_id, len(r.past)) for r in reviews.history.collect()} == {(1, 4), (2, 4), (3, 2)}

    groups = spark.createDataFrame([(1, "long text"), (2, "other")], "group_key long, text string")
    best = compression.compress(groups, lambda rows, k: rows.withColumn("version", F.concat(F.lit(f"{k}:"), "text")), reviewing.Reviews(reviewers, critic))
    assert sorted((r.group_key, r.iteration, r.score, r.text) for r in best.collect()) == [(1, 3, 0.0, "3:long text"), (2, 3, 0.0, "3:other")]


def test_links_are_appended_once(spark):
    chunks = spark.createDataFrame([(1, [9]), (2, None), (3, [])], "id long, links array<long>")
    edges = spark.createDataFrame([(3, 1), (2, 1), (3, 1), (9, 1), (3, 2), (4, 7)], "from_id long, to_id long")
    assert {r.id: r.links for r in relations.with_links(chunks, edges).collect()} == {1: [9, 2, 3], 2: [3], 3: []}


def test_a_request_is_made_once(spark):
    """A request that would come out otherwise when it is made again still gets its answer."""
    import uuid

    other = F.udf(lambda: uuid.uuid4().hex, "string").asNondeterministic()
    rows = spark.range(6).select("id", F.array(F.struct(F.lit("user").alias("role"), other().alias("content"))).alias("messages"))
    got, new = requests.answers(rows, spark.createDataFrame([], "key string, answer string"))
    assert new.count() == 6 and sorted((r.id, r.answer is not None) for r in got.collect()) == [(i, True) for i in range(6)]
