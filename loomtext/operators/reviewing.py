"""Guidance, reviewers and their reviews as table operators: each is a column of messages that is asked once for each distinct request."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.cluster import kept
from loomtext.operators.requests import Client, Options, answers, answers_by_id, stub_client
from loomtext.operators.review import fenced_json

MESSAGES = "array<struct<role:string,content:string>>"
ISSUES = "issues array<struct<severity:string,problem:string,suggestion:string>>"
GUIDANCE = Options(temperature=0.3)


def rendered(template: str, **values: Column | str) -> Column:
    """template with each {{ name }} replaced by a column; a null value is empty, a name without a value is an error."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    if unknown := set(parts[1::2]) - set(values):
        raise KeyError(f"the template names {sorted(unknown)}, which have no value")
    return F.concat(*[F.coalesce((F.col(values[p]) if isinstance(values[p], str) else values[p]).cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content") if isinstance(content, Column) else F.col(content).alias("content"))


def answered(rows: DataFrame, messages: Column, out: str, client: Client, options: Options, what: str) -> DataFrame:
    """rows with the answer as out; a request that stays without an answer ends the job."""
    empty = rows.sparkSession.createDataFrame([], "key string, answer string")
    got, _ = answers(rows.withColumn("messages", messages), empty, client, options)
    return got.withColumn(out, given("answer", what)).drop("messages", "key", "answer")


def with_guidance(rows: DataFrame, template: str, client: Client = stub_client, options: Options = GUIDANCE) -> DataFrame:
    """rows with a column guidance for their column intention, asked once for each distinct intention."""
    one = rows.select("intention").where("intention is not null").distinct()
    made = answered(one, F.array(message("user", rendered(template, intention="intention"))), "guidance", client, options, "an intention")
    return rows.join(made, "intention", "left")


def with_reviewers(clues: DataFrame, template: str, client: Client = stub_client, options: Options = GUIDANCE) -> DataFrame:
    """clues (group_key, clue_id, weight, label, content) with the text that tells the clue's reviewer what to look for, as reviewer."""
    return answered(clues, F.array(message("user", rendered(template, label="label", content="content"))), "reviewer", client, options, "a clue's reviewer")


def reviewer_texts(clues: DataFrame, template: str, client: Client = stub_client, options: Options = GUIDANCE) -> DataFrame:
    """with_reviewers for clues that are written, whose group_key and clue_id name a row: group_key, clue_id, weight, reviewer."""
    ids = ["group_key", "clue_id"]
    made = F.array(message("user", rendered(template, label="label", content="content")))

    def requests(but: DataFrame | None) -> DataFrame:
        return (clues if but is None else clues.join(but, ids, "left_anti")).select(*ids, made.alias("messages"))

    got = answers_by_id(requests, ids, client, options).select(*ids, given("answer", "a clue's reviewer").alias("reviewer"))
    return clues.select(*ids, "weight").join(got, ids)


def given(answer: str, what: str) -> Column:
    """The answer; without one the job ends."""
    return F.coalesce(answer, F.raise_error(F.lit(f"no answer for {what}")))


class Reviews:
    """A step of the compression loop: every clue's reviewer reads each version, with its own earlier rounds as history.

    reviewers: group_key, clue_id (which name a row), weight, reviewer. Of each round the versions, once a group, and the reviews are kept in
    the shared folder; a reviewer's messages are made of them in the task that asks.
    """

    reads = ("group_key", "version")

    def __init__(self, reviewers: DataFrame, client: Client = stub_client, options: Options = Options()):
        self.reviewers, self.client, self.options = reviewers, client, options
        self._rounds: list[tuple[DataFrame, DataFrame]] = []  # versions and reviews

    def __call__(self, versions: DataFrame, round_: int) -> DataFrame:
        """group_key, clue_id, weight, issue_index, severity, problem, suggestion. An answer that holds no issues gives no rows."""
        now = kept(versions.select(*self.reads))
        ids, reviewer = ["group_key", "clue_id"], F.array_sort(F.collect_list(F.struct("clue_id", "reviewer"))).alias("reviewers")
        told = self.reviewers.groupBy("group_key").agg(reviewer).join(now, "group_key")
        said, reviewed = (_in_rounds([r[k] for r in self._rounds], now, *columns) for k, columns in enumerate((["version"], ["clue_id", "review"])))
        told = kept(told.join(said.toDF("group_key", "said"), "group_key", "left").join(reviewed.toDF("group_key", "reviewed"), "group_key", "left"))

        def requests(but: DataFrame | None) -> DataFrame:
            rows, left = told, F.col("reviewers")
            if but is not None:
                rows = told.join(but.groupBy("group_key").agg(F.collect_list("clue_id").alias("but")), "group_key", "left")
                left = F.filter("reviewers", lambda x: ~F.coalesce(F.array_contains("but", x["clue_id"]), F.lit(False)))
            each = rows.select("group_key", "version", "said", "reviewed", F.explode(left).alias("r")).select("*", "r.clue_id", "r.reviewer")
            review = lambda x: F.filter("reviewed", lambda y: (y["clue_id"] == F.col("clue_id")) & (y["round"] == x["round"]))[0]["review"]
            past = F.flatten(F.transform("said", lambda x: F.array(message("user", x["version"]), message("assistant", review(x)))))
            asked = F.concat(F.array(message("system", "reviewer")), F.coalesce(past, F.array().cast(MESSAGES)), F.array(message("user", "version")))
            return each.select(*ids, asked.alias("messages"))

        got = kept(answers_by_id(requests, ids, self.client, self.options).select(*ids, given("answer", "a review").alias("review")))
        self._rounds.append((now, got))
        found = F.from_json(fenced_json("review"), ISSUES)["issues"]
        issues = got.join(self.reviewers.select(*ids, "weight"), ids).select(*ids, "weight", F.posexplode(found).alias("issue_index", "issue"))
        return issues.select(*ids, "weight", "issue_index", "issue.severity", "issue.problem", "issue.suggestion")

    @property
    def history(self) -> DataFrame | None:
        """group_key, clue_id, past: the messages of each reviewer's rounds so far; none before the first."""
        whole = None
        for k, (versions, reviews) in enumerate(self._rounds):
            rows = reviews.join(versions, "group_key").withColumn("round", F.lit(k))
            whole = rows if whole is None else whole.unionByName(rows)
        if whole is None:
            return None
        turns = F.array_sort(F.collect_list(F.struct("round", "version", "review")))
        past = F.flatten(F.transform(turns, lambda x: F.array(message("user", x["version"]), message("assistant", x["review"]))))
        return whole.groupBy("group_key", "clue_id").agg(past.alias("past"))


def _in_rounds(tables: list[DataFrame], now: DataFrame, *columns: str) -> DataFrame:
    """group_key and an array of round and columns over the tables of all rounds, for the groups of now."""
    rows = [t.select("group_key", F.lit(k).alias("round"), *columns) for k, t in enumerate(tables)]
    whole = rows[0] if rows else now.select("group_key", F.lit(0).alias("round"), *[F.lit(None).cast("long" if c == "clue_id" else "string").alias(c) for c in columns]).limit(0)
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole.join(now.select("group_key"), "group_key", "left_semi").groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("round", *columns))).alias("rounds"))
