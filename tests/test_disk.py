"""What operators leave in the shared folder, in bytes, against what they were given."""

import json
import os
import random

from loomtext import flow
from loomtext.operators import compression, reviewing


def stored(spark):
    at = spark.conf.get("spark.checkpoint.dir")
    return {f"{r}/{f}": os.path.getsize(f"{r}/{f}") for r, _, fs in os.walk(at) for f in fs}


def noise(n, seed):
    return "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))


def test_a_version_is_stored_once_and_not_for_each_reviewer(spark):
    """Twenty reviewers, two rounds; what is stored grows with the versions, so it stays under eight times the text."""
    groups = spark.createDataFrame([(k, noise(20_000, k)) for k in range(8)], "group_key long, text string")
    reviewers = spark.createDataFrame([(k, c, 0.5, f"{k} {c}") for k in range(8) for c in range(20)], "group_key long, clue_id long, weight double, reviewer string")

    def critic(messages, options):
        assert len(messages) == 2 + 2 * sum(m["role"] == "assistant" for m in messages)
        return json.dumps({"issues": [{"severity": "major", "problem": "p", "suggestion": "s"}] * (len(messages) < 4)})

    def shorter(messages, options):
        return messages[1]["content"][: 20_000 - len(messages)]

    before = stored(spark)
    compressor = compression.Compressor(groups.withColumnRenamed("text", "marked"), "{{ target }}", shorter)
    best = compression.compress(groups, compressor, reviewing.Reviews(reviewers, critic)).collect()
    assert sorted((r.group_key, r.iteration, len(r.text)) for r in best) == [(k, 2, 20_000 - 4) for k in range(8)]
    made = sum(size for path, size in stored(spark).items() if path not in before)
    assert made < 8 * 2 * 8 * 20_000, made  # a round, a group


def test_a_request_of_many_groups_is_asked_once(spark, tmp_path):
    """Groups with one text and reviewers alike: as many questions as texts and kinds of reviewers, each group with its own issues."""
    groups = spark.createDataFrame([(k, "one" if k < 30 else f"text {k}") for k in range(40)], "group_key long, text string")
    reviewers = spark.createDataFrame([(k, 10 * k + c, 1.0, f"reviewer {c}") for k in range(40) for c in range(1 + k % 3)], "group_key long, clue_id long, weight double, reviewer string")
    log = str(tmp_path / "asked")

    def critic(messages, options):
        with open(log, "a") as f:
            f.write(json.dumps(messages) + "\n")
        return json.dumps({"issues": [{"severity": "major", "problem": messages[-1]["content"], "suggestion": messages[0]["content"]}]})

    found = reviewing.Reviews(reviewers, critic)(groups.withColumnRenamed("text", "version"), 1).collect()
    assert len(found) == sum(1 + k % 3 for k in range(40))
    assert all(r.problem == ("one" if r.group_key < 30 else f"text {r.group_key}") and r.suggestion == f"reviewer {r.clue_id % 10}" for r in found)
    asked = open(log).read().splitlines()
    assert len(asked) == len(set(asked)) == 3 + sum(1 + k % 3 for k in range(30, 40))


def test_a_stage_leaves_its_table_only(spark, tmp_path):
    before = stored(spark)
    chapters = spark.createDataFrame([(1, "One here. Two here. Three here. Four here. Five here."), (2, None)], "chapter_id long, text string")
    assert flow.Flow(spark, str(tmp_path / "flow"), flow.Settings(max_iterations=2)).run(chapters).count() == 2
    assert not [p for p in stored(spark) if p not in before and ("kept-" in p or "scratch-" in p)]
