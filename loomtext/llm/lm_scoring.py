"""Language-model scoring by prediction by partial matching (PPM) over bytes.

Training counts every byte after every context of ORDER bytes, over all training texts; shorter contexts follow by
summing. Together they are the trie, level by level, as tables: every context that occurs is a node, however rare. A
symbol is predicted in the longest context that is a node; one that was not seen there escapes (method D: half a count
of each symbol seen goes to the escape) to the next shorter context, where the symbols of the longer ones are excluded.
The model is pretrained and static, so a context and the byte after it (a gram) have one probability.

Most positions of a text are grams that make up at least 2**-GRAM_BITS of all positions in training; they are looked up in a
broadcast table (there are 2**GRAM_BITS at most). All others are counted by text and meet their probabilities in
a join; for grams that training never saw these are found level by level, once for each distinct gram.

The base score is that of single words. Likewise the words that make up at least 2**-SHARE_BITS of all tokens are
looked up in a broadcast table, all others go through the same join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, in_fold, read_table, table_of, with_small_batches

ORDER = 5
SHARE_BITS, GRAM_BITS = 19, 22
_PAD = b"\0" * ORDER  # what stands before a text; a single one ends it
#: Entries that a counting task holds before it passes them on.
HELD_WORDS, HELD_GRAMS = 200_000, 1_000_000
#: How the token of a gram begins in the join; no word holds a blank.
_GRAM = b"  "


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded and ended texts in one array, the places of the symbols to predict, and where each text's places begin."""
    joined = np.frombuffer(b"".join([_PAD + t + b"\0" for t in texts]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    firsts = np.cumsum(lengths) - lengths
    places = np.arange(lengths.sum()) + np.repeat((np.arange(len(texts)) + 1) * ORDER, lengths)
    return joined, places, firsts


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code of every position, ORDER context bytes and the byte after them, and where each text's positions begin."""
    joined, places, firsts = flat(texts)
    code = np.zeros(len(places), np.int64)
    for k in range(ORDER, -1, -1):
        code = code << 8 | joined[places - k]
    return code, firsts


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with counts."""
    return np.unique(codes_of(texts)[0], return_counts=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in held]), minlength=len(codes)).astype(np.int64)

    def out(words: dict, code: np.ndarray, code_n: np.ndarray) -> pa.RecordBatch:
        nothing = [None] * len(code)
        n = np.concatenate([np.fromiter(words.values(), np.int64, len(words)), code_n])
        return pa.RecordBatch.from_arrays([pa.array([*words, *nothing], pa.binary()), pa.array(np.concatenate([np.zeros(len(words), np.int64), code])), pa.array(n)], names=["token", "code", "n"])

    none = np.zeros(0, np.int64)
    for batch in by_bytes(batches, "text"):
        texts = [lowered(t) for t in batch.column("text").to_pylist()]
        for t in texts:
            words.update(t.split())
        words[b""] += len(texts)  # the ends
        held.append(grams(texts))
        if sum(len(c) for c, _ in held) > HELD_GRAMS:
            held = [merged()]
            if len(held[0][0]) > HELD_GRAMS // 2:
                yield out({}, *held[0])
                held = []
        if len(words) > HELD_WORDS:
            yield out(words, none, none)
            words = Counter()
    yield out(words, *(merged() if held else (none, none)))


class GramTable:
    """log10 probabilities by code, looked up for many codes at once: open addressing, at most a quarter of the slots in use."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        bits = max(4, int(4 * max(len(codes), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.logs = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        slot, left, self.probes = self._slots(codes), np.arange(len(codes)), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = codes[left[free]]  # of several, the last stays
            here = self.keys[slot[left]] == codes[left]
            self.logs[slot[left[here]]] = logs[left[here]]
            left = left[~here]
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * self._FACTOR) >> self.shift).astype(np.int64)

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities, 0 where a code is not held, and the places of those."""
        slot = self._slots(codes)
        keys = self.keys[slot]
        out = np.where(keys == codes, self.logs[slot], np.float32(0))
        open_ = np.flatnonzero((keys != codes) & (keys >= 0))
        missing = [np.flatnonzero(keys < 0)]
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (slot[open_] + 1) & self.mask
            slot[open_] = at
            keys = self.keys[at]
            here = keys == codes[open_]
            out[open_[here]] = self.logs[at[here]]
            missing.append(open_[keys < 0])
            open_ = open_[~here & (keys >= 0)]
        return out, np.sort(np.concatenate([*missing, open_]))


class Model:
    """The common grams with their log10 probabilities and the common words with their counts."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray, common: dict[bytes, int]):
        self.codes, self.logs, self.common, self._table = codes, logs, common, None

    def table(self) -> GramTable:
        if self._table is None:
            self._table = GramTable(self.codes, self.logs)
        return self._table

    def __getstate__(self):
        return self.__dict__ | {"_table": None}


def train(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame, int, int]:
    """The model, the tables of words (token, c) and of grams (code, n, logp), and the sums N and V, from all rows of texts (text)."""
    counted = table_of(with_small_batches(texts).select("text").mapInArrow(_counts, "token binary, code long, n long").groupBy("token", "code").agg(F.sum("n").alias("n")), "lm-counts")
    words = counted.where("token is not null and n > 0").select("token", F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = words.where(F.col("c") * (1 << SHARE_BITS) >= total).collect() if total else []
    # the end is a word of its own; it is looked up like a common one however rare it is
    ends = words.where(F.col("token") == F.lit(b"")).collect()
    coded = counted.where("token is null").select("code", "n")
    all_after = F.sum("n").over(Window.partitionBy(F.shiftright("code", 8)))
    seen = table_of(coded.withColumn("logp", F.log10((F.col("n") - 0.5) / all_after)), "lm-grams")
    positions = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = seen.where(F.col("n") * F.lit(1 << GRAM_BITS) >= positions).select("code", F.col("logp").cast("float").alias("logp")).toArrow()  # at most 2**GRAM_BITS
    return Model(got.column("code").to_numpy(), got.column("logp").to_numpy(), {bytes(r.token): r.c for r in [*common, *ends]}), words, seen, int(total), int(distinct)


def unseen_grams(asked: DataFrame, seen: DataFrame) -> DataFrame:
    """code, logp of distinct codes that training never saw, by escapes from level to level. seen: code, n.

    The symbols of a context are among those of each shorter one, so what a level excludes are the symbols of the last
    context that was a node. Contexts that are asked for join level by level; those of one byte at most are broadcast.
    """
    left = table_of(asked.select("code", F.lit(0.0).alias("escape"), F.array().cast("array<int>").alias("known"), F.lit(None).cast("double").alias("logp")), "lm-unseen")
    for k in range(ORDER, -1, -1):
        context, symbol = F.shiftright(F.col("code") % F.lit(1 << 8 * (k + 1)), 8), (F.col("code") % 256).cast("int")
        keyed = left.withColumn("context", context).withColumn("symbol", symbol)
        level = seen.select(context.alias("context"), symbol.alias("s"), "n")
        if k > 1:
            level = level.join(keyed.where("logp is null").select("context").distinct(), "context", "left_semi")
        nodes = level.groupBy("context", "s").agg(F.sum("n").alias("n")).groupBy("context").agg(F.collect_list(F.struct("s", "n")).alias("after"))
        met = keyed.join(nodes if k > 1 else F.broadcast(nodes), "context", "left")  # 256 contexts of 256 symbols at most
        new = F.filter("after", lambda x: ~F.array_contains("known", x["s"]))
        total = F.aggregate("new", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        mine = F.filter("new", lambda x: x["s"] == F.col("symbol"))
        met = met.withColumn("new", F.coalesce(new, F.array().cast("array<struct<s:int,n:bigint>>"))).withColumn("total", total.cast("double")).withColumn("mine", mine)
        logp = F.when(F.col("logp").isNull() & (F.size("mine") > 0), F.col("escape") + F.log10((F.col("mine")[0]["n"] - 0.5) / F.col("total"))).otherwise(F.col("logp"))
        escape = F.when(F.size("new") > 0, F.col("escape") + F.log10(F.size("new") / (2 * F.col("total")))).otherwise(F.col("escape"))
        known = F.when(F.col("after").isNotNull(), F.transform("after", lambda x: x["s"])).otherwise(F.col("known"))
        left = table_of(met.select("code", escape.alias("escape"), known.alias("known"), logp.alias("logp")), "lm-unseen")
    return left.select("code", F.coalesce("logp", F.col("escape") - F.log10(F.greatest(256 - F.size("known"), F.lit(1)))).alias("logp"))


_ROWS = "row long, token binary, n long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double"


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table, common = model.table(), model.common
        row = TaskContext.get().partitionId() << 36
        for batch in by_bytes(batches, "text", 1 << 20):
            texts = [lowered(t) for t in batch.column("text").to_pylist()]
            codes, firsts = codes_of(texts)
            found, missing = table.look_up(codes)
            sums = np.add.reduceat(found.astype(np.float64), firsts)
            owner = np.searchsorted(firsts, missing, side="right") - 1
            order = np.lexsort((codes[missing], owner))
            code, owner = codes[missing][order], owner[order]
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, np.int64)
            gram_n, code, owner = np.diff(np.r_[first, len(code)]), code[first], owner[first]
            grams = [_GRAM + c[2:] for c in np.frombuffer(code.astype(">i8").tobytes(), "V8").tolist()]
            rows, tokens, ns, sizes, known, logs = [], [], [], [], [], []
            for k, t in enumerate(texts):
                counts = Counter(t.split())
                counts[b""] = 1
                n_known, log = 0, 0.0
                for w, n in counts.items():
                    if (c := common.get(w)) is None:
                        rows.append(row + k)
                        tokens.append(w)
                        ns.append(n)
                    else:
                        n_known += n
                        log += n * np.log10(c + 1)
                sizes.append(counts.total())
                known.append(n_known)
                logs.append(log)
            m, own = len(tokens) + len(grams), len(texts)
            pad = lambda column, kind: pa.concat_arrays([column.cast(kind), pa.nulls(m, kind)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([row + np.arange(own), np.array(rows, np.int64), row + owner])), pa.array([None] * own + tokens + grams, pa.binary()),
                pa.array(np.concatenate([np.zeros(own, np.int64), np.array(ns, np.int64), gram_n])), pad(batch.column("doc_id"), pa.int64()), pad(batch.column("held_out"), pa.bool_()),
                pad(pa.array(sizes), pa.int64()), pad(pa.array(known), pa.int64()), pad(pa.array(logs, pa.float64()), pa.float64()), pad(pa.array(sums), pa.float64()),
            ], names=["row", "token", "n", "doc_id", "held_out", "n_tokens", "known", "logs", "score"])
            row += own

    return run


def score_documents(docs: DataFrame, training: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text of docs.

    score is the log10 probability of the text's UTF-8 bytes, A-Z in lower case, and of its end.
    Defined cases: a null or empty text is the end alone; without training texts the model is uniform over bytes, no
    token is known and base_score is 0; repeated rows get a row each; other columns are ignored.
    """
    model, words, seen, total, distinct = train(training)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")).mapInArrow(_scored(sent), _ROWS)
    found = table_of(found, "lm-rows")
    own, rest = found.where("token is null"), found.where("token is not null").select("row", "token", "n")
    is_gram = F.substring("token", 1, 2) == F.lit(_GRAM)
    code_of = F.conv(F.hex(F.substring("token", 3, ORDER + 1)), 16, 10).cast("long")
    token_of = F.concat(F.lit(_GRAM), F.unhex(F.lpad(F.hex("code"), 2 * (ORDER + 1), "0")))
    asked = table_of(rest.where(is_gram).select("token").distinct().select(code_of.alias("code")), "lm-asked")
    known = seen.join(asked, "code").select("code", "logp")
    new = unseen_grams(asked.join(seen, "code", "left_anti"), seen)
    rare = words.where(F.col("c") * (1 << SHARE_BITS) < total) if total else words
    values = rare.select("token", F.log10(F.col("c") + 1).alias("value")).unionByName(known.unionByName(new).select(token_of.alias("token"), F.col("logp").alias("value")))
    part = lambda which, x: F.sum(F.when(which, x).otherwise(0))
    summed = rest.join(values, "token", "left").where("value is not null").groupBy("row").agg(
        part(~is_gram, F.col("n")).alias("more_known"), part(~is_gram, F.col("n") * F.col("value")).alias("more_logs"), part(is_gram, F.col("n") * F.col("value")).alias("more_score"),
    )
    floor = float(np.log10(total + distinct + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("logs") + zero("more_logs") - F.col("n_tokens") * F.lit(floor)
    return own.join(summed, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + zero("more_score")).alias("score"))


def op4_ppm(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 7, 2)
    return score_documents(docs, docs.where(~held_out), held_out)


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op4_ppm": op4_ppm}
