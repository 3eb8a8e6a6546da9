"""The compression loop: all groups go round by round; a group leaves when its version has no issues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.cluster import cut, kept
from loomtext.operators.requests import Client, Options, answers_by_id, stub_client
from loomtext.operators.review import best_version, compressed_text, feedback_text, scores, target_lengths, without_chunk_tags
from loomtext.operators.reviewing import MESSAGES, given, message, rendered

Step = Callable[[DataFrame, int], DataFrame]
COMPRESSION = Options(temperature=0.5)


class Compressor:
    """The compressing side of the loop, with a dialogue for each group: the marked text, then its own attempts and the feedback on them.

    marked: group_key, marked (the text with its spans). The prompt may hold {{ target }}, {{ at_least }} and {{ at_most }}, lengths
    of the group's own text. Answers and feedback of each round are kept in the shared folder; dialogues are made of them and the marked
    text, of the groups that are still open.
    """

    def __init__(self, marked: DataFrame, prompt: str, client: Client = stub_client, options: Options = COMPRESSION, ratio: float = 0.2, top: int = 9):
        self.marked, self.prompt, self.client, self.options, self.ratio, self.top = marked, prompt, client, options, ratio, top
        self.begun: DataFrame | None = None
        self._rounds: list[DataFrame] = []

    def _asked(self, groups: DataFrame) -> DataFrame:
        """group_key, system, marked and turns, the rounds so far that had feedback."""
        if self.begun is None:
            lengths = target_lengths("text" if "text" in groups.columns else F.col("n_chars"), self.ratio)
            self.begun = kept(groups.select("group_key", *lengths).select("group_key", rendered(self.prompt, target="target", at_least="at_least", at_most="at_most").alias("system")))
        rows = groups.select("group_key").join(self.begun, "group_key").join(self.marked.select("group_key", "marked"), "group_key")
        if not self._rounds:
            return rows.withColumn("turns", F.array().cast("array<struct<round:int,answer:string,feedback:string>>"))
        turns = None
        for k, told in enumerate(self._rounds):
            more = told.where("feedback <> ''").select("group_key", F.struct(F.lit(k).alias("round"), "answer", "feedback").alias("turn"))
            turns = more if turns is None else turns.unionByName(more)
        return rows.join(turns.groupBy("group_key").agg(F.array_sort(F.collect_list("turn")).alias("turns")), "group_key", "left")

    def __call__(self, groups: DataFrame, round_: int) -> DataFrame:
        """groups (group_key, text or its length as n_chars) with answer and version: the answer's section of compressed text without its tags."""
        asked = kept(self._asked(groups))
        past = F.flatten(F.transform("turns", lambda x: F.array(message("assistant", x["answer"]), message("user", x["feedback"]))))
        dialogue = F.concat(F.array(message("system", "system"), message("user", "marked")), F.coalesce(past, F.array().cast(MESSAGES)))

        def requests(but: DataFrame | None) -> DataFrame:
            return (asked if but is None else asked.join(but, "group_key", "left_anti")).select("group_key", dialogue.alias("messages"))

        got = answers_by_id(requests, ["group_key"], self.client, self.options).select("group_key", given("answer", "a compression").alias("answer"))
        return groups.join(got.withColumn("section", compressed_text("answer")).select("group_key", without_chunk_tags("section").alias("version"), "answer"), "group_key")

    def told(self, versions: DataFrame, issues: DataFrame) -> None:
        """Adds a round to the dialogues: the answers that versions hold, and the feedback that their issues make."""
        feedback = feedback_text(issues, ["group_key"], self.top)
        rows = versions.select("group_key", "answer").join(feedback, "group_key", "left")
        self._rounds.append(kept(rows.select("group_key", "answer", F.coalesce("feedback", F.lit("")).alias("feedback"))))


def compress(groups: DataFrame, compressor: Step | Compressor, reviewer: Step, max_iterations: int = 10) -> DataFrame:
    """group_key, iteration, score, text: the best version of each group, the first on ties.

    groups: group_key, text. compressor(open groups, round) adds version; reviewer(those, round) returns issues
    (group_key, severity, weight). A compressor that can be told the issues of its versions is; a reviewer that names the columns it
    reads gets no others. Every round is one job over all groups that still have issues.
    """
    versions = rounds(groups, compressor, reviewer, max_iterations)
    best = best_version(versions, "group_key")
    return best.join(versions.drop("score"), ["group_key", "iteration"])


def rounds(groups: DataFrame, compressor: Step | Compressor, reviewer: Step, max_iterations: int = 10) -> DataFrame:
    """group_key, iteration, score, text: all versions of all groups."""
    open_, versions = groups, None
    for k in range(1, max_iterations + 1):
        made = compressor(open_, k)
        read = getattr(reviewer, "reads", ("group_key", "text", "version"))
        made = kept(made.select(*[c for c in ("group_key", "text", "version", "answer") if c in made.columns and c in (*read, "version", "answer")]))
        issues = cut(reviewer(made, k))
        found = scores(issues, "group_key")
        rated = kept(made.select("group_key").join(found, "group_key", "left").select("group_key", F.lit(k).alias("iteration"), F.coalesce("score", F.lit(0.0)).alias("score")))
        version = rated.join(made.select("group_key", F.col("version").alias("text")), "group_key")
        versions = version if versions is None else versions.unionByName(version)
        open_ = groups.join(rated.where("score > 0").select("group_key"), "group_key", "left_semi")
        if k == max_iterations or open_.isEmpty():
            break
        if hasattr(compressor, "told"):
            compressor.told(made, issues)
    return versions
