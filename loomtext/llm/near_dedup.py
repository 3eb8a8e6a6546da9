"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Each of REGISTERS buckets keeps the minimum of a hash of its
own over the set, compressed to its count of leading zeros and MANTISSA_BITS bits. Runs of registers are band
keys; documents that share a key are candidates, the Jaccard similarity estimated from the registers (corrected
for registers that agree by chance) drops the hopeless ones, and the rest is confirmed on the full shingle sets.

Groups of any size: equal sets are one class from the start, and buckets are compared as buckets.py says. In blocks, sketches
of the sets (Sketch) bound the similarity from above, so that little more than links is left to confirm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import blocks_of, joined_by_best, met_hubs, stars
from .common import by_bytes, read_table, table_of, with_ids, with_small_batches
from .components import components

REGISTERS, MANTISSA_BITS = 512, 3
BANDS, BAND_WIDTH = 32, 6
#: What the estimate may fall short of the threshold: over 4 standard deviations at 512 registers.
MARGIN = 0.07
#: Classes in a block of the residual comparison, about.
BLOCK = 64
#: Sets of at most NARROW shingles are sketched whole, 16 bits a shingle; larger ones by 32 bits, and those of more than WIDE by a sample of WIDE / 2 to WIDE.
NARROW, WIDE = 2048, 4096
#: What the similarity of two samples may fall short of the threshold: over 4 standard deviations at 2048 shingles.
SAMPLE_MARGIN = 0.035
#: Pages of 2^15 bits of the bitmap of ids that is broadcast (2 MB).
PAGES = 512
#: Shingles of the sets that meet one copy of a hub's set, about.
PART = 4_000_000

_A = np.array([xxhash.xxh32_intdigest(b"a%d" % i) | 1 for i in range(REGISTERS)], np.uint32)[:, None]
_B = np.array([xxhash.xxh32_intdigest(b"b%d" % i) for i in range(REGISTERS)], np.uint32)[:, None]
_MIX = [np.uint64(xxhash.xxh64_intdigest(b"w%d" % i) | 1) for i in range(16)]
_BYTE_HASH = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)
_IS_WORD_BYTE = np.array([i != 0x20 and not 0x09 <= i <= 0x0D for i in range(256)])


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of k words of a text; nothing is kept between texts but powers."""

    def __init__(self, k: int):
        self.k, self._powers = k, np.ones(1, np.uint64)

    def _word_hashes(self, text: str | None) -> np.ndarray:
        """A polynomial hash, mixed, of each word: runs of bytes other than ASCII white space, A-Z in lower case."""
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        inner = _IS_WORD_BYTE[data]
        edges = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        sizes = ends - starts
        if (longest := int(sizes.max())) > len(self._powers):
            self._powers = np.cumprod(np.full(longest, _MIX[3])) * _MIX[4]
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
        h = np.add.reduceat(_BYTE_HASH[data[inner]] * self._powers[place], firsts)
        h = (h ^ (h >> np.uint64(32))) * _MIX[1]
        return h ^ (h >> np.uint64(29))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self._word_hashes(text)
        if not len(h):
            return h
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + n]) * _MIX[i % 16]
            out ^= out >> np.uint64(29)
        out = (out ^ (out >> np.uint64(32))) * _MIX[0]
        return np.unique(out ^ (out >> np.uint64(31)))


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of each bucket's minimum; shingles must not be empty."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 4096):
        low = np.minimum(low, (_A * h[at : at + 4096] + _B).min(axis=1))
    mantissa, exponent = np.frexp(low.astype(np.float64) + 1)  # exact: 33 bits
    zeros = np.minimum(33 - exponent, 31).astype(np.uint8)
    bits = ((mantissa * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.uint8)
    return (zeros << MANTISSA_BITS) | bits


def chance_agreement() -> float:
    """How often registers of unlike sets of like size agree: minima in the same cell of a leading-zero class.

    The minimum of n hashes is about exponential, so the chance that two such minima share both their leading zeros
    and their mantissa bits does not depend on n; its published value is about 0.17 cells.
    """
    return 0.17 / 2**MANTISSA_BITS


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    c = chance_agreement()
    return ((a == b).mean(axis=-1) - c) / (1 - c)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest_a, digest_b (64 bits each), registers (null for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler(words)
        for batch in by_bytes(batches, "text"):
            n, a, b, regs = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles_of(text)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                a.append(int.from_bytes(d[:8], "little", signed=True))
                b.append(int.from_bytes(d[8:], "little", signed=True))
                regs.append(registers_of(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "digest_a", "digest_b", "registers"])

    return with_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest_a long, digest_b long, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            regs = _matrix(batch.column("registers"))[:, : BANDS * BAND_WIDTH].reshape(-1, BANDS, BAND_WIDTH).astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64)[None, :] * _MIX[0]
            for i in range(BAND_WIDTH):
                key = (key ^ regs[:, :, i]) * _MIX[i + 1]
                key ^= key >> np.uint64(31)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(band), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], names=["key", "band", "id"])


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = estimate(_matrix(batch.column("ra")), _matrix(batch.column("rb"))) >= least if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


class Sketch:
    """A set of shingles in short: the high bits of their hashes (of a sample, if it is large), and how many fell together.

    Of whole sets the shingles in common are at most the bits in common and those that fell together in one set, so the similarity is never
    taken for lower than it is.
    """

    def __init__(self, data: bytes):
        self.n, self.shift, self.kept = np.frombuffer(data, np.int32, 3).tolist()
        self.bits = np.frombuffer(data, np.uint16 if self.shift < 0 else np.uint32, offset=12)

    @staticmethod
    def of(shingles: np.ndarray) -> bytes:
        n, high = len(shingles), (shingles >> np.uint64(32)).astype(np.uint32)
        if n <= NARROW:
            shift, kept, bits = -1, n, np.unique((high >> np.uint32(16)).astype(np.uint16))
        else:
            shift = max(0, ((n - 1) // WIDE).bit_length())
            high = high[high.astype(np.int64) < 1 << 32 - shift]
            kept, bits = len(high), np.unique(high)
        return np.array([n, shift, kept], np.int32).tobytes() + bits.tobytes()

    @property
    def lost(self) -> int:
        return self.kept - len(self.bits)

    def at(self, shift: int) -> tuple[np.ndarray, int]:
        """Bits at a coarser level, and how many shingles fell together there at most."""
        if shift == self.shift:
            return self.bits, self.lost
        if shift < 0:
            bits = np.unique((self.bits >> np.uint32(16)).astype(np.uint16))
            return bits, self.kept - len(bits)
        return self.bits[self.bits.astype(np.int64) < 1 << 32 - shift], self.lost

    def most_alike(self, other: Sketch, percent: int) -> tuple[float, bool]:
        """The similarity at most, and whether it may reach the threshold."""
        if 100 * min(self.n, other.n) < percent * max(self.n, other.n):
            return 0.0, False
        shift = max(self.shift, other.shift) if min(self.shift, other.shift) >= 0 else -1
        (x, x_lost), (y, y_lost) = self.at(shift), other.at(shift)
        both = len(np.intersect1d(x, y, assume_unique=True)) + min(x_lost, y_lost)
        if shift <= 0:
            union = self.n + other.n - both
            return both / union, 100 * both >= percent * union
        like = both / max(1, len(x) + len(y) + max(x_lost, y_lost) - both)
        return like, like >= percent / 100 - SAMPLE_MARGIN


class _Block:
    def __init__(self, members: pa.StructArray):
        self.ids, self.components = (members.field(c).to_numpy(zero_copy_only=False) for c in ("id", "component"))
        self.sketches = [Sketch(x) for x in members.field("payload").to_pylist()]
        self.n, self.lost = (np.array([getattr(x, c) for x in self.sketches]) for c in ("n", "lost"))
        narrow = np.array([x.shift < 0 for x in self.sketches])
        self.narrow, self.wide = np.flatnonzero(narrow), np.flatnonzero(~narrow)
        bits = [self.sketches[k].bits for k in self.narrow]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, np.uint16)
        self.starts = np.cumsum([0, *map(len, bits)])[:-1]


def _blocks_compared(percent: int, best: bool = False):
    """Pairs of unlike components that may be links by their sketches; best: for each member of a left block the likest and the smallest id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << 16, np.uint8)
        for batch in batches:
            a, b, likes = [], [], []
            for at in range(batch.num_rows):
                left, right = (_Block(batch.column(c).slice(at, 1).flatten()) for c in ("left", "right"))
                for k, one in enumerate(left.sketches):
                    apart = right.components != left.components[k]
                    if not apart.any():
                        continue
                    like, passed = np.zeros(len(apart)), np.zeros(len(apart), bool)
                    slow = range(len(apart))
                    if one.shift < 0:
                        if len(right.narrow):
                            held[one.bits] = 1
                            both = np.add.reduceat(held[right.bits], right.starts, dtype=np.int64) + np.minimum(one.lost, right.lost[right.narrow])
                            held[one.bits] = 0
                            union = one.n + right.n[right.narrow] - both
                            like[right.narrow], passed[right.narrow] = both / union, 100 * both >= percent * union
                        slow = right.wide.tolist()
                    for j in slow:
                        if apart[j]:
                            like[j], passed[j] = one.most_alike(right.sketches[j], percent)
                    near = np.flatnonzero(passed & apart)
                    if best and len(near) > 1:
                        near = np.unique([near[like[near].argmax()], near[right.ids[near].argmin()]])
                    a += [int(left.ids[k])] * len(near)
                    b += right.ids[near].tolist()
                    likes += like[near].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(likes, pa.float64())], names=["a", "b", "like"])

    return run


def _sets(words: int):
    """The digest's halves, the set of each text, as sorted hashes, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler(words)
        for batch in by_bytes(batches, "text"):
            sets = [shingles_of(t) for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            halves = [pa.array([int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests], pa.int64()) for k in (0, 8)]
            yield pa.RecordBatch.from_arrays([*halves, pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([Sketch.of(x) for x in sets], pa.binary())], names=["digest_a", "digest_b", "shingles", "sketch"])

    return run


def _confirmed(percent: int):
    """Pairs that hold on the full sets; rows come sorted by b, so its set is at hand. Nothing else is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "set_a", 8 << 20):
            keep, at, y = [], None, None
            for k, b in enumerate(batch.column("b").to_pylist()):
                if b != at:
                    at, y = b, np.frombuffer(batch.column("set_b")[k].as_buffer(), np.uint64)
                x = np.frombuffer(batch.column("set_a")[k].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their sets of shingles of so many words
    (a shorter text's whole words are one shingle; A-Z in lower case). component_id is the smallest id reachable
    by links, kept marks it.
    Defined cases: a text that is null or without words has an empty set and is linked with nothing; a null id has
    no component and is kept; equal sets are one node, whatever their rows' ids, and each row gets a row; rows that
    repeat an id with unlike texts are nodes of their own; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = percent / 100 - MARGIN
    sigs = table_of(signatures(docs, words), "signatures")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    # lowest is the smallest id of a class's rows
    classes = full.groupBy("digest_a", "digest_b").agg(F.min("doc_id").alias("lowest"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = with_ids(classes, "classes")
    bands = table_of(classes.select("id", "registers").mapInArrow(_band_rows, "key long, band int, id long"), "bands")
    shared, to_hub = met_hubs(bands)
    # what shares no key is in no pair: from here on only the others' registers, sets and sketches move
    near = table_of(classes.join(shared.select("id").distinct(), "id", "left_semi").select("id", "lowest", "n", "digest_a", "digest_b", "registers"), "near")
    regs = near.select("id", "registers")
    found = docs_of(docs.where("doc_id is not null"), near).mapInArrow(_sets(words), "digest_a long, digest_b long, shingles binary, sketch binary")
    found = found.groupBy("digest_a", "digest_b").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
    stored = table_of(found.join(near.select("id", "digest_a", "digest_b"), ["digest_a", "digest_b"]).select("id", "shingles", "sketch"), "sets")
    sets, payloads = stored.select("id", "shingles"), stored.select("id", F.col("sketch").alias("payload"))

    def linked(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) that hold on the full sets, as a written table. The set of b meets those of all its pairs, in parts of PART shingles."""
        pairs = table_of(pairs, "pairs")
        load = pairs.join(near.select(F.col("id").alias("a"), "n"), "a").groupBy("b").agg(F.expr(f"cast((sum(n) + {PART - 1}) div {PART} as int)").alias("parts"))
        load = table_of(load, "loads")
        placed = table_of(pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part")), "placed")
        left = placed.join(sets.toDF("a", "set_a"), "a")
        right = load.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part")).join(sets.toDF("b", "set_b"), "b")
        met = left.join(right.hint("merge"), ["b", "part"]).select("a", "b", "set_a", "set_b")
        return table_of(met.mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")

    def compared(pairs: DataFrame) -> DataFrame:
        """Links among pairs, as a written table: what the registers make likely is confirmed."""
        likely = pairs.join(regs.toDF("a", "ra"), "a").join(regs.toDF("b", "rb"), "b").select("a", "b", "ra", "rb")
        return linked(likely.mapInArrow(_estimated(least), "a long, b long"))

    def best(blocks: DataFrame) -> DataFrame:
        """Two pairs a member at most; the smallest id is one that many choose, so components grow fast."""
        like = blocks.mapInArrow(_blocks_compared(percent, best=True), "a long, b long, like double")
        two = like.groupBy("a").agg(F.array_distinct(F.array(F.min("b"), F.max_by("b", F.struct("like", -F.col("b"))))).alias("both"))
        return two.select("a", F.explode("both").alias("b"))

    parts, open_, done = joined_by_best(shared, compared(to_hub), likely_pairs(to_hub), payloads, BLOCK, best, linked)

    # what shares a key and is not in one component yet
    rest = blocks_of(open_, payloads, BLOCK).mapInArrow(_blocks_compared(percent), "a long, b long, like double")
    rest = rest.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
    more = linked(rest)
    parts = components(stars(parts).union(more)) if not more.isEmpty() else parts

    named = parts.join(classes.select("id", "lowest"), "id").groupBy("component").agg(F.min("lowest").alias("part"))
    class_part = classes.join(parts.join(named, "component").select("id", "part"), "id", "left").select("digest_a", "digest_b", F.coalesce("part", "lowest").alias("part"))
    class_part = table_of(class_part, "class-parts")
    joined = sigs.select("doc_id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("digest_a", "digest_b")]).join(class_part, ["digest_a", "digest_b"], "left")
    part = F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id"))
    return joined.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))


def docs_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of all rows that have a node's lowest id, and of a few others.

    The ids are looked up in a bitmap of PAGES pages of 4 KB, so that texts are not shuffled to find out.
    """
    bits = 1 << 15
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(PAGES * bits))
    pages = nodes.select(slot("lowest").alias("slot")).groupBy(F.expr(f"slot div {bits}").alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % bits).alias("bits"))
    placed = texts.select("text", slot("doc_id").alias("slot")).withColumn("page", F.expr(f"slot div {bits}"))
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(slot % {bits} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return placed.join(F.broadcast(pages), "page").where(F.getbit(byte, (F.col("slot") % 8).cast("int")) == 1).select("text")


def likely_pairs(to_hub: DataFrame) -> DataFrame:
    """Pairs compared with their bucket's hub before, larger id first."""
    return to_hub.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def op5_hyperminhash(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE_SQL = {
    "op5_hyperminhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
),
sh AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s
  FROM w
),
flat AS (SELECT doc_id, unnest(s) AS x FROM sh),
sizes AS (SELECT doc_id, len(s) AS n FROM sh),
common AS (
  SELECT f.doc_id AS a, g.doc_id AS b, count(*) AS k FROM flat f JOIN flat g ON f.x = g.x AND f.doc_id <> g.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common c JOIN sizes p ON c.a = p.doc_id JOIN sizes q ON c.b = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)
),
reach AS (
  SELECT doc_id, doc_id AS r FROM sizes
  UNION
  SELECT reach.doc_id, l.b FROM reach JOIN links l ON reach.r = l.a
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM sizes s JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m ON s.doc_id = m.doc_id
""",
}
QUERIES = {"op5_hyperminhash": op5_hyperminhash}
