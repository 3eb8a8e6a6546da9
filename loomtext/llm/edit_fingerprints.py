"""Document fingerprints by a randomised edit embedding.

A shared random walk copies a text's characters to an output, each of them as often as shared random bits say for
the character and the place in the output. After an edit the walks of two texts fall into step again, so edit
distance becomes Hamming distance of the outputs. A fingerprint holds the output's characters at sampled places;
the places of a longer output are a subset of those of a shorter one, so fingerprints of unlike lengths compare on
the places they share. Samples of a fingerprint make band keys, and likeness verifies the pairs that share one.

Documents meet their successor by id: ranges of ids are sorted in tasks of their own, and the first document of a
range is also sent to the range before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import blocks_apart, met_hubs
from .common import by_bytes, read_table, shuffle_partitions, table_of, with_ids, with_small_batches
from .components import components

SAMPLES = 256
#: A pair of likeness s shares no band of a level with probability (1 - s^8)^32: 0.003 at 0.8.
BANDS, BAND_SAMPLES = 32, 8
#: Classes in a block of the residual comparison, about.
BLOCK = 64
_PERIOD, _CLASSES = 4096, 64
_SIGNS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", np.uint8)
_BATCH_CHARS = 3 << 20


def _walk_table() -> np.ndarray:
    """table[c * _PERIOD + j]: how many copies a character of class c makes from output place j on (the walk's next advance)."""
    bits = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2, (_CLASSES, _PERIOD)).astype(bool)
    copies = np.zeros((_CLASSES, _PERIOD), np.int32)
    ahead = np.zeros(_CLASSES, np.int32)
    for j in [*range(_PERIOD - 1, -1, -1), *range(_PERIOD - 1, -1, -1)]:  # twice: places wrap around
        ahead = np.where(bits[:, j], 1, ahead + 1).astype(np.int32)
        copies[:, j] = ahead
    return copies.ravel()


_COPIES = _walk_table()


def _classes(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32)


def _order_of(places: np.ndarray) -> np.ndarray:
    """The level down to which a place is sampled: each level keeps about half of the places."""
    h = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h & (~h + np.uint64(1))).astype(np.float64)
    return np.log2(np.maximum(low, 1)).astype(np.int64)


class Places:
    """Sampled places of each level, as far as asked for."""

    def __init__(self):
        self.upto, self.levels = -1, {}

    def at(self, level: int, length: int) -> np.ndarray:
        if length > self.upto:
            self.upto, self.levels = max(length, 2 * self.upto, 1 << 16), {}
            self._order = _order_of(np.arange(self.upto))
        if level not in self.levels:
            self.levels[level] = np.flatnonzero(self._order >= level)
        p = self.levels[level]
        return p[: np.searchsorted(p, length)]


_places = Places()


class Picks:
    """Which of n places the bands' samples take: each the one that comes first in an order of its own.

    Of two fingerprints on the same level one has the other's places and some more, so a sample takes the same place
    of both as often as the longer one's is among the shared ones: samples agree with the probability likeness.
    """

    def __init__(self):
        self._grow(2 * SAMPLES)

    def _grow(self, size: int) -> None:
        h = np.arange(1, size * BANDS * BAND_SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xAEF17502108EF2D9)
        h = (h ^ (h >> np.uint64(29))).reshape(size, -1)
        lowest = h == np.minimum.accumulate(h, axis=0)
        self._table = np.maximum.accumulate(np.where(lowest, np.arange(size, dtype=np.int32)[:, None], 0), axis=0)

    def of(self, n: int) -> np.ndarray:
        if n > len(self._table):
            self._grow(2 * n)
        return self._table[n - 1]


_picks = Picks()
_BAND_SALTS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)


def level_of(length: int) -> int:
    return max(0, int(np.ceil(np.log2(max(length, 1) / SAMPLES))))


def walk(codes: list[np.ndarray], starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the output place where each character begins, and where the output ends; starts: the first places."""
    order = np.argsort([-len(c) for c in codes], kind="stable")
    lengths = np.array([len(codes[k]) for k in order], np.int64)
    flat = _classes(np.concatenate([codes[k] for k in order])) * _PERIOD if len(codes) else np.zeros(0, np.int32)
    firsts = np.cumsum(lengths) - lengths
    begin = np.zeros(len(flat), np.int32)
    at = starts[order].astype(np.int32)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for t in range(longest):
        n = alive[t]
        place = firsts[:n] + t
        j = at[:n]
        begin[place] = j
        at[:n] = j + _COPIES[flat[place] + (j & (_PERIOD - 1))]
    out: list[np.ndarray] = [begin[:0]] * len(codes)
    ends = np.zeros(len(codes), np.int64)
    for k, a, n, e in zip(order.tolist(), firsts.tolist(), lengths.tolist(), at.tolist(), strict=True):
        out[k], ends[k] = begin[a : a + n], e
    return out, ends


class Fingerprint:
    """Output length and the sampled characters of its level, hashed to one of 64 signs."""

    def __init__(self, codes: np.ndarray, begin: np.ndarray, end: int):
        self.length, self.level = int(end), level_of(int(end))
        places = _places.at(self.level, self.length)
        self.signs = _SIGNS[_classes(codes[np.searchsorted(begin, places, side="right") - 1])] if len(places) else _SIGNS[:0]

    def __str__(self) -> str:
        return f"{self.length:x}." + self.signs.tobytes().decode()

    def at_level(self, level: int) -> np.ndarray:
        if level == self.level:
            return self.signs
        mine = _places.at(self.level, self.length)
        return self.signs[np.isin(mine, _places.at(level, self.length), assume_unique=True)]

    @classmethod
    def parsed(cls, text: str) -> Fingerprint:
        """The fingerprint that str gave."""
        one = cls.__new__(cls)
        length, signs = text.split(".")
        one.length = int(length, 16)
        one.level, one.signs = level_of(one.length), np.frombuffer(signs.encode(), np.uint8)
        return one

    def bands(self) -> np.ndarray:
        """Keys of the samples, BANDS a level; at the next level too, where a slightly longer text may be. None without places."""
        keys = []
        for level in (self.level, self.level + 1):
            signs = self.at_level(level)
            if not len(signs):
                continue
            h = signs[_picks.of(len(signs))].view(np.uint64) + _BAND_SALTS * np.uint64(2 * level + 1)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            keys.append((h ^ (h >> np.uint64(32))).view(np.int64))
        return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the places sampled of both on which they agree; places past the end of the shorter one disagree."""
    level = max(a.level, b.level)
    x, y = a.at_level(level), b.at_level(level)
    most = max(len(x), len(y))
    if not most:
        return 1.0 if a.length == b.length else 0.0
    n = min(len(x), len(y))
    return float(np.count_nonzero(x[:n] == y[:n])) / most


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    codes = [_codes(t) for t in texts]
    begins, ends = walk(codes, np.zeros(len(codes), np.int64))
    return [Fingerprint(c, b, e) for c, b, e in zip(codes, begins, ends.tolist(), strict=True)]


def with_edits(texts: list[str]) -> list[tuple]:
    """For each text but the last: its fingerprint, its edited text's and the next text's, and the edited text's hash.

    The edited text is the text with the last quarter of its characters replaced by the first of the next text. It
    shares the walk over its first three quarters with the text.
    """
    codes = [_codes(t) for t in texts]
    begins, ends = walk(codes, np.zeros(len(codes), np.int64))
    own = [Fingerprint(c, b, e) for c, b, e in zip(codes, begins, ends.tolist(), strict=True)]
    cuts = [len(t) // 4 for t in texts[:-1]]
    tails = [after[:k] for k, after in zip(cuts, codes[1:], strict=True)]
    starts = np.array([b[len(b) - k] if k else e for k, b, e in zip(cuts, begins, ends.tolist(), strict=False)], np.int64)
    tail_begins, tail_ends = walk(tails, starts)
    out = []
    for i, (k, tail, begin, end) in enumerate(zip(cuts, tails, tail_begins, tail_ends.tolist(), strict=True)):
        keep = len(codes[i]) - k
        edited = Fingerprint(np.concatenate([codes[i][:keep], tail]), np.concatenate([begins[i][:keep], begin]), end)
        sha = hashlib.sha256((texts[i][:keep] + texts[i + 1][:k]).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((own[i], edited, own[i + 1], sha))
    return out


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands array<long>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    texts: list[str] = []
    held = 0

    def out() -> pa.RecordBatch:
        rows = with_edits(texts)
        columns = [
            pa.array(ids[: len(rows)], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([r[3] for r in rows], pa.string()),
            pa.array([str(r[0]) for r in rows], pa.string()), pa.array([str(r[1]) for r in rows], pa.string()),
            pa.array([likeness(r[0], r[1]) for r in rows], pa.float64()), pa.array([likeness(r[0], r[2]) for r in rows], pa.float64()),
            pa.array([r[0].bands() for r in rows], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands"])

    here, closed = None, True
    for batch in batches:
        for at, is_next, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "is_next", "doc_id", "text")), strict=True):
            if at != here:
                here, closed = at, False
                ids, texts, held = [], [], 0
            if closed:
                continue  # more rows with the next range's first id
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            closed = is_next
            if closed or held > _BATCH_CHARS:
                yield out()
                ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of docs (doc_id, text) and of its edited text, see with_edits.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and bands.
    Defined cases: a null text is empty; empty texts are alike (1) and unlike any other (0); a null id comes before
    all others; rows with one id follow each other in order of their texts' hash; a single row is its own successor;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = 4 * shuffle_partitions(spark)
    cuts = [k / n for k in range(1, n)]
    found = rows.select("key").agg(F.percentile_approx("key", cuts, 10 * n)).first()[0]
    bounds = sorted(set(found or []))  # as many as ranges, however many documents there are
    steps = max(len(bounds), 1).bit_length()
    listed = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    # binary search: how many bounds are at most the key
    ranged = rows.withColumn("bounds", listed).withColumn(
        "range",
        F.aggregate(
            F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)]), F.lit(0),
            lambda low, step: F.when((low + step <= len(bounds)) & F.coalesce(F.try_element_at("bounds", low + step) <= F.col("key"), F.lit(False)), low + step).otherwise(low),
        ),
    ).drop("bounds")
    firsts = sorted((r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.min("key").alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]  # of the first range: the last
    ahead = F.broadcast(spark.createDataFrame(before, "key long, sent int"))
    sent = ranged.join(ahead, "key", "left").withColumn("to", F.explode(F.when(F.col("sent").isNull(), F.array(F.struct("range", F.lit(False).alias("is_next")))).otherwise(F.array(F.struct("range", F.lit(False).alias("is_next")), F.struct(F.col("sent").alias("range"), F.lit(True).alias("is_next"))))))
    dealt = sent.select("to.range", "to.is_next", "key", "doc_id", "text", F.xxhash64("text").alias("h")).repartition(shuffle_partitions(spark), "range")
    return dealt.sortWithinPartitions("range", "is_next", "key", "h").select("range", "is_next", "doc_id", "text").mapInArrow(_run, _SCHEMA)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 4 * _BATCH_CHARS):
        found = fingerprints([t or "" for t in batch.column("text").to_pylist()])
        names = [str(f) if f.length else None for f in found]
        digests = [xxhash.xxh3_128_digest(x) if x else None for x in names]
        halves = [pa.array([None if d is None else int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests], pa.int64()) for k in (0, 8)]
        columns = [batch.column("doc_id"), *halves, pa.array(names, pa.string()), pa.array([f.bands() for f in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest_a", "digest_b", "fingerprint", "bands"])


def _alike(least: float):
    """Pairs of at least that likeness; b is parsed once where its rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, name, y = [], None, None
            for fa, fb in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True):
                if fb != name:
                    name, y = fb, Fingerprint.parsed(fb)
                keep.append(likeness(Fingerprint.parsed(fa), y) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks_alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for at in range(batch.num_rows):
                left, right = ([(m["id"], m["component"], Fingerprint.parsed(m["payload"])) for m in batch.column(side)[at].as_py()] for side in ("left", "right"))
                for i, ci, x in left:
                    near = [j for j, cj, y in right if cj != ci and likeness(x, y) >= least]
                    a += [i] * len(near)
                    b += near
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_edits(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, component_id, kept of every row of docs (doc_id, text): near duplicates by likeness of fingerprints.

    Documents of at least that likeness are linked; candidates are those that share a band key. component_id is the
    smallest id reachable by links, kept marks it.
    Defined cases: a text that is null or empty is linked with nothing; a null id has no component and is kept; equal
    fingerprints are one node, whatever their rows' ids, and each row gets a row; rows that repeat an id with unlike
    texts are nodes of their own; other columns are ignored; an empty table gives no rows.
    """
    rows = with_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = table_of(rows.mapInArrow(_prints, "doc_id long, digest_a long, digest_b long, fingerprint string, bands array<long>"), "prints")
    classes = prints.where("digest_a is not null and doc_id is not null").groupBy("digest_a", "digest_b").agg(F.min("doc_id").alias("lowest"), F.first("fingerprint").alias("payload"), F.first("bands").alias("bands"))
    classes = with_ids(classes, "classes")
    shared, to_hub = met_hubs(table_of(classes.select("id", F.posexplode("bands").alias("band", "key")), "bands"))
    payloads = classes.select("id", "payload")
    likely = to_hub.join(payloads.toDF("a", "fa"), "a").join(payloads.toDF("b", "fb"), "b")
    links = table_of(likely.select("a", "b", "fa", "fb").mapInArrow(_alike(least), "a long, b long"), "links")
    apart = blocks_apart(shared, components(links), payloads, BLOCK)
    more = table_of(apart.mapInArrow(_blocks_alike(least), "a long, b long").distinct(), "more-links")
    parts = components(links.union(more))

    named = parts.join(classes.select("id", "lowest"), "id").groupBy("component").agg(F.min("lowest").alias("part"))
    class_part = table_of(classes.join(parts.join(named, "component").select("id", "part"), "id", "left").select("digest_a", "digest_b", F.coalesce("part", "lowest").alias("part")), "class-parts")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id"))
    found = prints.select("doc_id", "digest_a", "digest_b").join(class_part, ["digest_a", "digest_b"], "left")
    return found.select("doc_id", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))


def op3_edit_embedding(spark, sf_dir):
    return edit_fingerprints(read_table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op3_edit_embedding": op3_edit_embedding}
