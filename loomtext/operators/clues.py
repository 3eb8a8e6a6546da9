"""Clues: chains ranked by weight, the long tail merged."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CLUES, HEAD_SHARE = 10, 0.75
#: How a merged clue is called; n is the number of chains in it.
MERGED_LABEL = "{n} minor threads"


def normalised_weights(clues: DataFrame, *keys: str) -> DataFrame:
    """weight as a share of its key's sum; left as it is where the sum is not positive."""
    total = F.sum("weight").over(Window.partitionBy(*keys))
    return clues.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))


def tail(clues: DataFrame, keys: list[str], max_clues: int = MAX_CLUES) -> DataFrame:
    """Clues from rank floor(0.75 * max_clues) on, heaviest first, ties by clue_id."""
    ranked = clues.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "clue_id")) - 1)
    return ranked.where(F.col("rank") >= int(max_clues * HEAD_SHARE))


def overlaps(clues: DataFrame, members: DataFrame, keys: list[str], shared: str = "fragment_id") -> DataFrame:
    """Pairs of a key's clues that share anything, with how much: keys, clue_a (the heavier), clue_b, overlap.

    clues: keys, clue_id, rank; members: clue_id and what clues may share. An equi-join on the key and what is shared, so
    only pairs with an overlap arise.
    """
    rows = clues.select(*keys, "clue_id", "rank").join(members.select("clue_id", shared).distinct(), "clue_id")
    a = rows.select(*keys, shared, F.col("clue_id").alias("clue_a"), F.col("rank").alias("rank_a"))
    b = rows.select(*keys, shared, F.col("clue_id").alias("clue_b"), F.col("rank").alias("rank_b"))
    return a.join(b, [*keys, shared]).where("rank_a < rank_b").groupBy(*keys, "clue_a", "clue_b").agg(F.count("*").alias("overlap"))


def merged(clues: list[dict], max_clues: int = MAX_CLUES, label: str = MERGED_LABEL) -> list[dict]:
    """Merge the tail pair that shares most fragments until max_clues are left; weights then sum to 1.

    A clue: clue_id, label, weight, chunks (sorted (sentence id, chunk id) pairs), fragments (set), sources. Clues are in order of
    weight, equal ones by clue_id, merged ones after the others; equally good pairs go by that order, and so do pairs that share nothing.

    The order of two clues never changes, so a pair that shares fragments goes into a heap once, when both its clues are in the tail, and
    is skipped later if one is gone. Pairs that share nothing are never made.
    """
    head_size = int(max_clues * HEAD_SHARE)
    order = {c["clue_id"]: (-c["weight"], 0, c["clue_id"]) for c in clues}
    by_id = {c["clue_id"]: c for c in clues}
    ranked = sorted(order.values())
    number = {f: k for k, f in enumerate({f: None for c in clues for f in c["fragments"]})}
    bits = {c["clue_id"]: sum(1 << number[f] for f in c["fragments"]) for c in clues}
    head, late = ranked[:head_size], ranked[head_size:]  # both in order
    near: dict[int, set[int]] = {}  # a tail clue's tail clues with a fragment in common
    heap: list[tuple] = []

    def push(a: int, b: int) -> None:
        first, second = sorted((order[a], order[b]))
        heapq.heappush(heap, (-(bits[a] & bits[b]).bit_count(), first, second))

    def enter(c: int, others: set[int]) -> None:
        near[c] = others
        for o in others:
            near[o].add(c)
            push(c, o)

    def name(key: tuple) -> int:
        return key[2]

    holders: dict = {}
    for key in late:
        c = name(key)
        fragments = by_id[c]["fragments"]
        enter(c, {o for f in fragments for o in holders.get(f, ())})
        for f in fragments:
            holders.setdefault(f, []).append(c)
    made = 0
    while len(head) + len(late) > max_clues and len(late) >= 2:
        while heap and (name(heap[0][1]) not in near or name(heap[0][2]) not in near):
            heapq.heappop(heap)
        first, second = heapq.heappop(heap)[1:] if heap else late[:2]
        a, b = by_id.pop(name(first)), by_id.pop(name(second))
        others = (near.pop(a["clue_id"]) | near.pop(b["clue_id"])) - {a["clue_id"], b["clue_id"]}
        for o in others:
            near[o] -= {a["clue_id"], b["clue_id"]}
        for key in (first, second):
            del late[bisect.bisect_left(late, key)]
        made += 1
        sources = [*a["sources"], *b["sources"]]
        new = {"clue_id": -made, "label": label.format(n=len(sources)), "weight": a["weight"] + b["weight"], "sources": sources, "parts": [*a.get("parts", [a]), *b.get("parts", [b])]}
        key = (-new["weight"], made, -made)
        by_id[-made], order[-made] = new, key
        bits[-made] = bits.pop(a["clue_id"]) | bits.pop(b["clue_id"])
        if head and key < head[-1]:
            bisect.insort(head, key)
            key = head.pop()  # the lightest of the head falls into the tail
            c = name(key)
            others = {o for o in near if bits[o] & bits[c]}
        bisect.insort(late, key)
        enter(name(key), others)
    total = sum(c["weight"] for c in by_id.values())
    out = []
    for c in (by_id[name(key)] for key in head + late):
        parts = c.pop("parts", None)
        if parts:
            c["chunks"] = sorted((x for p in parts for x in p["chunks"]), key=lambda x: x[0])
            c["fragments"] = set().union(*(p["fragments"] for p in parts))
        c["weight"] = c["weight"] / total if total > 0 else c["weight"]
        out.append(c)
    return out


def merge_clues(members: DataFrame, keys: list[str], max_clues: int = MAX_CLUES, overlap_key: str = "fragment", label: str = MERGED_LABEL) -> DataFrame:
    """Clues of each key. members: keys, snake_id, label, weight (of the chain), chunk_id, chapter_id, fragment_id, sentence_index.

    overlap_key: 'fragment' compares fragments, 'chapter' chapters. A key's chains are those of one group and are one row, many of
    them a batch; a task holds a row and the pairs of its tail that share a fragment.
    """
    kinds = dict(members.dtypes)
    names = ["clue_id", "label", "weight", "chunk_ids", "is_merged", "source_snake_ids", "rank"]
    types = [pa.int64(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()), pa.int32()]

    def of_key(rows: list[dict]) -> list[tuple]:
        clues = []
        for snake, found in groupby(rows, key=lambda r: r["snake_id"]):
            r = list(found)
            sids = [(x["chapter_id"], x["fragment_id"], x["sentence_index"]) for x in r]
            clues.append({
                "clue_id": snake, "label": r[0]["label"], "weight": float(r[0]["weight"]), "sources": [snake],
                "chunks": list(zip(sids, (x["chunk_id"] for x in r), strict=True)), "fragments": {s[:2] if overlap_key == "fragment" else s[0] for s in sids},
            })
        return [(c["clue_id"], c["label"], c["weight"], [i for _, i in c["chunks"]], len(c["sources"]) > 1, c["sources"], k) for k, c in enumerate(merged(clues, max_clues, label))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, rows in enumerate(batch.column("members")):
                found = of_key(rows.as_py())
                out += found
                at += [k] * len(found)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*keys, *names])

    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    member = F.struct("snake_id", "chapter_id", "fragment_id", "sentence_index", "chunk_id", "label", "weight")
    listed = members.where("snake_id is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("members"))
    return listed.mapInArrow(run, f"{head}, clue_id long, label string, weight double, chunk_ids array<long>, is_merged boolean, source_snake_ids array<long>, rank int")
