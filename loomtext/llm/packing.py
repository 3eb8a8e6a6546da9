"""Packing of tokenized documents into sequences by a grouping genetic algorithm.

Pieces of documents are dealt to districts of bounded size. A district's pieces are packed by several islands at once,
each a task with a population of packings of its own: two parents are drawn by tournament, crossover
injects whole well-filled bins of one into the other, bins that hold an injected piece twice are removed
and the displaced pieces go where they fit best. After each epoch an island's best packing, its elite, migrates to
the district's other islands through a table. Then the well-filled bins of the district's best packing stay, and the pieces
of its other bins go to new districts, round after round. Only lengths and places travel, never texts or ids.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, read_table, table_of, with_small_batches

CAPACITY = 2048
DISTRICT_PIECES = 4096
ROUNDS, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 2, 2, 6, 12
#: Share of the capacity from which a bin counts as well filled.
WELL_FILLED = 0.998


class ByteBpe:
    """Ids of a byte-level BPE file, as the tokenizers library gives them.

    Merges run in tiktoken, with the ranks of the same file. Texts with the file's special tokens, or with white
    space on which the two libraries' patterns may differ, go to the tokenizers library itself.
    """

    _apart = "\x0b\x0c\x1c-\x1f\x85\u180e\u200b-\u200d\u2028\u2029\ufeff"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        special = [t["content"] for t in spec["added_tokens"]]
        self.needs_whole = re.compile("|".join([*map(re.escape, special), f"[{self._apart}]"]))
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.needs_whole.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def _byte_alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_encoders: dict[str, ByteBpe] = {}


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of whole texts: doc_id, piece, start, length, ids_crc32 and salt (the row's place in its partition and the partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, ByteBpe(tokenizer))
        end, salt = np.array([end_id], "<u4"), TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end])
                cuts = [*range(len(ids), 0, -capacity), 0][::-1]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), salt))
                salt += 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return with_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


Packing = list[list[int]]


def best_fit(packing: Packing, items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Put items, in the order given, into the open bin that they fill best, or into a new one."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(packing))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            packing[k].append(i)
        else:
            left, k = capacity, len(packing)
            packing.append([i])
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))
    return packing


def fitness(packing: Packing, sizes: list[int], capacity: int) -> tuple[int, float]:
    return -len(packing), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in packing)


def crossover(one: Packing, other: Packing, sizes: list[int], capacity: int, dice: random.Random) -> Packing:
    """Inject about half of other's well-filled bins into one."""
    full = WELL_FILLED * capacity
    injected = [b for b in other if dice.random() < 0.5 and sum(sizes[i] for i in b) >= full]
    twice = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in one:
        if twice.isdisjoint(b) and (sum(sizes[i] for i in b) >= full or dice.random() < 0.9):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in twice]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(kept + [list(b) for b in injected], displaced, sizes, capacity)


def evolve(sizes: list[int], capacity: int = CAPACITY, seed: int = 0, elites: list[Packing] | None = None) -> Packing:
    """The best packing after GENERATIONS, from the elites given, best fit by falling size and best fits of disturbed orders.

    A packing that meets the bound given by the total size is the best there is, so it ends the search at once.
    """
    dice, least = random.Random(seed), -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rank = lambda p: fitness(p, sizes, capacity)
    population = [[list(b) for b in p] for p in elites or []] or [best_fit([], order, sizes, capacity)]
    while len(population) < POPULATION and len(population[0]) > least:
        noisy = sorted(order, key=lambda i: -sizes[i] * (1 + 0.3 * dice.random()))
        population.append(best_fit([], noisy, sizes, capacity))
    population.sort(key=rank, reverse=True)
    for _ in range(GENERATIONS):
        if len(population[0]) <= least:
            break
        drawn = [min(dice.sample(range(len(population)), 2)) for _ in range(2)]  # the better of two
        if drawn[0] == drawn[1]:
            drawn[1] = (drawn[0] + 1 + dice.randrange(len(population) - 1)) % len(population)
        child = crossover(population[drawn[0]], population[drawn[1]], sizes, capacity, dice)
        if all(rank(child) != rank(p) for p in population):  # the same packing twice is no population
            population[-1] = child
            population.sort(key=rank, reverse=True)
    return population[0]


_BASE = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, district long"


def _epoch(capacity: int):
    """An island's epoch: rows of a district with the elites' bins; gives them back with this island's own bin."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], ignore_index=True)
        elites = []
        for k in range(len(rows["elites"][0])):
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(rows["elites"]):
                bins.setdefault(b[k], []).append(i)
            elites.append(list(bins.values()))
        sizes, mine = rows["length"].tolist(), np.zeros(len(rows), np.int64)
        best = evolve(sizes, capacity, int(rows["district"][0]) * ISLANDS + int(rows["island"][0]), elites)
        for k, members in enumerate(best):
            mine[members] = k
        bins_, squares = fitness(best, sizes, capacity)
        return rows.drop(columns="elites").assign(bin=mine, bins=-bins_, squares=squares)

    return run


def _places(capacity: int):
    """Offsets in the bins of a district's best packing, and which bins are well filled."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "length", "doc_id", "piece", "salt"], ascending=[True, False, True, True, True], ignore_index=True)
        ends = rows.groupby("bin")["length"].cumsum()
        total = rows.groupby("bin")["length"].transform("sum")
        return rows.assign(offset=ends - rows["length"], filled=total >= WELL_FILLED * capacity)

    return run


def packed_districts(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with district: adds bin, offset and filled by the best packing that the district's islands found."""
    names = [c.split()[0] for c in _BASE.split(", ")]
    current = pieces.select(*names, F.array().cast("array<long>").alias("elites"))
    schema = f"{_BASE}, island int, bin long, bins long, squares double"
    for epoch in range(EPOCHS):
        on_islands = current.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        found = table_of(on_islands.groupBy("district", "island").applyInPandas(_epoch(capacity), schema), f"epoch-{epoch}")
        by_rank = F.transform(F.array_sort(F.collect_list(F.struct("bins", (-F.col("squares")).alias("s"), "island", "bin"))), lambda x: x["bin"])
        current = found.groupBy(*names).agg(by_rank.alias("elites"))  # a piece's bin in each elite, the best first
    best = current.select(*names, F.col("elites")[0].alias("bin"))
    return best.groupBy("district").applyInPandas(_places(capacity), f"{_BASE}, bin long, offset long, filled boolean")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is one piece of the end id alone; a null id stays null; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    """
    pieces = table_of(tokenized_pieces(docs, tokenizer, capacity), "pieces")
    whole = pieces.where(F.col("length") >= capacity)
    done = [whole.select(*pieces.columns[:5], (F.lit(1 << 60) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(F.col("length") < capacity)
    for k in range(ROUNDS):
        districts = max(1, -(-rest.count() // DISTRICT_PIECES))
        dealt = rest.withColumn("district", F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(k)), F.lit(districts)))
        placed = table_of(packed_districts(dealt, capacity), f"packed-{k}")
        last = k == ROUNDS - 1
        stays = placed if last else placed.where("filled")
        done.append(stays.select(*pieces.columns[:5], (F.lit(k << 56) + F.col("district") * (1 << 16) + F.col("bin")).alias("sequence_id"), "offset"))
        rest = placed.where("not filled").select(*pieces.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op6_island_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op6_island_packing": op6_island_packing}
