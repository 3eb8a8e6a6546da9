"""Requests to a language model as a table operator: cached answers by key, misses in parallel, retries.

The client is a function (messages, options) -> str that is given; tests and the registered queries use a
deterministic one. Answers are cached by request key, so a request that is repeated or comes again is made once.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.cluster import cut, kept
from loomtext.functions.json_text import cache_key

Client = Callable[[list[dict], dict], str]
RETRY_TIMES, RETRY_WAIT_S = 5, 6.0
_RETRYABLE = re.compile("connection|timeout|network|rate limit")


@dataclass(frozen=True)
class Options:
    model: str = "stub"
    temperature: float = 0.6
    top_p: float = 0.6


def stub_client(messages: list[dict], options: dict) -> str:
    """Answers with a digest of the last message: the same for the same request, anywhere."""
    return "answer " + hashlib.sha256(messages[-1]["content"].encode()).hexdigest()[:16]


def ask(client: Client, messages: list[dict], options: dict, retries: int = RETRY_TIMES, wait: float = RETRY_WAIT_S) -> str | None:
    """The answer, or none after so many retries; errors that retrying cannot mend are raised at once."""
    for attempt in range(retries + 1):
        try:
            return client(messages, options) or None
        except Exception as e:
            if not _RETRYABLE.search(str(e).lower()):
                raise
            if attempt < retries:
                time.sleep(wait)
    return None


def with_keys(requests: DataFrame, options: Options = Options()) -> DataFrame:
    return requests.withColumn("key", cache_key("messages", options.model, F.lit(options.temperature), F.lit(options.top_p)))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requests by key that the cache (key, answer) does not hold."""
    return requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def answers(requests: DataFrame, cache: DataFrame, client: Client = stub_client, options: Options = Options(), wait: float = RETRY_WAIT_S) -> tuple[DataFrame, DataFrame]:
    """requests with their answer, and the new rows of the cache. requests: messages array<struct<role,content>>.

    The requests and the new answers are kept in the shared folder when this is called, so that no later action makes a request or asks again.
    """
    keyed = kept(with_keys(requests, options))
    new = cut(_asked(misses(keyed, cache), ["key"], client, options, wait).where("answer is not null"))
    return keyed.join(cache.select("key", "answer").unionByName(new), "key", "left"), new


def _asked(requests: DataFrame, ids: list[str], client: Client, options: Options, wait: float) -> DataFrame:
    given, kinds = vars(options), dict(requests.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[ids].assign(answer=[ask(client, json.loads(m), given, wait=wait) for m in rows["m"]])

    return requests.select(*ids, F.to_json("messages").alias("m")).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ids) + ", answer string")


def answers_by_id(requests: Callable[[DataFrame | None], DataFrame], ids: list[str], client: Client = stub_client, options: Options = Options(), wait: float = RETRY_WAIT_S) -> DataFrame:
    """ids and answer (null without one) of every request; a request that several ids make is made once.

    requests(but) gives ids, which name a row, and messages, without the rows of but (ids; None: all rows). It is called twice and has to make the
    same messages again, so it reads written tables. Keys and answers are stored, messages are not.
    """
    keyed = kept(with_keys(requests(None), options).select(*ids, F.unhex("key").alias("key")))
    of = F.struct(*ids)
    placed = kept(keyed.join(keyed.groupBy("key").agg(F.min(of).alias("first")), "key").select(*ids, "first"))
    new = kept(_asked(requests(placed.where(of != F.col("first")).select(*ids)), ids, client, options, wait))
    return placed.join(new.select(of.alias("first"), "answer"), "first", "left").select(*ids, "answer")
