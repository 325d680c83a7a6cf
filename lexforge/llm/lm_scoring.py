"""LM scoring: a hierarchical Pitman-Yor model of words given the word before.

Restaurants of contexts (one for each word before, and one for text starts) share one parent,
the restaurant of single words, whose base is uniform over the training words and one unknown word.
Words are customers; how many tables serve a word in a restaurant is sampled by Gibbs sweeps.

The corpus is cut into chunks. A chunk keeps its words as places in its own sorted list of distinct
word hashes. What chunks must know of each other goes through buckets of the key space: chunks send
sorted distinct keys with their numbers, buckets add up and answer in the same order. So every key
of a chunk is shuffled once, however often it occurs, and a key's row in a bucket is as short for a
hot word as for a rare one. All random numbers come from the keys, so chunks that share a cell
seat it alike without asking.

A Gibbs sweep takes all customers of a cell out, with their tables, and seats them again one after another given all
other cells' tables of the sweep before. Sweeps before the samples are burn-in. Two things are approximate:
cells are seated together and not in turn, and from 32 customers on groups of a sixteenth of those seated come
in together, whatever the table's size. Strengths are 1, discounts come from the counts of counts."""

from __future__ import annotations

import gc
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.bpe import text_runs
from lexforge.llm.common import crc_fold_py, doc_words, dropped, mix64, written

U = np.uint64
#: Words are whole 64-bit hashes, so their counts are exact; cells are the upper 56 bits, and of 10^10 cells some hundred
#: share a key, which moves no count of a word.
KEY = ~U(0xFF)
START, END = U(0x452821E638D01377), U(0xBE5466CF34E90C6C)
CHUNK = 1 << 21  # tokens; a single longer text is a chunk of its own
STRENGTH = 1.0
NO_ID = np.iinfo(np.int64).min
WORDS, CELLS, TABLES = 0, 1, 2


# --- arrays as bytes ----------------------------------------------------------


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress well."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, -1).T).view(dtype).ravel() if len(b) else np.zeros(0, dtype)


def squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def loosen(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def pack_keys(keys: np.ndarray, low: int) -> bytes:
    """Sorted keys as differences; `low` bits of them are 0."""
    return squeeze(planes(np.diff(keys, prepend=U(0)) >> U(low)))


def unpack_keys(b: bytes, low: int) -> np.ndarray:
    return np.cumsum(unplanes(loosen(b), np.uint64), dtype=np.uint64) << U(low)


def low_bits(kind: int) -> int:
    return 8 if kind == CELLS else 0


def pack_numbers(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length of counts from 0 to 2^64 - 1, each as wide as its largest number needs."""
    out = [len(arrays[0]).to_bytes(4, "little")]
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or int(a.max()) < 1 << (8 * w))
        out += [bytes([width]), planes(a.astype(f"<u{width}"))]
    return squeeze(b"".join(out))


def unpack_numbers(b: bytes) -> list[np.ndarray]:
    b = loosen(b)
    n, at, out = int.from_bytes(b[:4], "little"), 4, []
    while at < len(b):
        width = b[at]
        out.append(unplanes(b[at + 1 : at + 1 + n * width], f"<u{width}").astype(np.int64))
        at += 1 + n * width
    return out


# --- chunks ---------------------------------------------------------------------

STATE = "chunk long, ids binary, sizes binary, train binary, words binary, tokens binary"


def chunks(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    def run(batches):
        base, k = TaskContext.get().partitionId() << 24, 0
        ids, sizes, train, parts, total = [], [], [], [], 0

        def flush():
            words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            row = [base + k, np.array(ids, np.int64).tobytes(), np.array(sizes, np.int32).tobytes(), np.array(train, np.uint8).tobytes(), pack_keys(words, 0), squeeze(planes(tokens.astype(np.uint32)))]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["chunk", "ids", "sizes", "train", "words", "tokens"])

        for batch in batches:
            all_ids = batch.column(0).to_pylist()
            for a, b in text_runs(batch.column(1)):
                for first, last, bounds, h, *_ in doc_words(batch.column(1).slice(a, b - a).to_pylist()):
                    for i in range(last - first):
                        own = h[bounds[i] : bounds[i + 1]]
                        if ids and total + len(own) + 1 > CHUNK:
                            yield flush()
                            k += 1
                            ids, sizes, train, parts, total = [], [], [], [], 0
                        doc = all_ids[a + first + i]
                        ids.append(NO_ID if doc is None else doc)
                        sizes.append(len(own) + 1)
                        train.append(doc is None or crc_fold_py(doc, folds) != held_out)
                        parts += [own, [END]]
                        total += len(own) + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, STATE)


def cell_keys(word_keys: np.ndarray, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(word_keys[ctx] * U(3) ^ word_keys[word]) & KEY


class Chunk:
    """A chunk's words and cells. word_keys: sorted hashes, with the text start as a word.
    cell_keys: sorted keys of distinct (context, word) pairs; ctx and word: their places in word_keys."""

    def __init__(self, row, cells: bool = True):
        self.id = int(row["chunk"])
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        words = unpack_keys(row["words"], 0)
        start = int(np.searchsorted(words, START))
        self.word_keys = np.insert(words, start, START)
        tokens = unplanes(loosen(row["tokens"]), np.uint32).astype(np.int64)
        self.tokens = tokens + (tokens >= start)
        self.start = start
        first = np.cumsum(self.sizes) - self.sizes
        ctx = np.empty_like(self.tokens)
        ctx[1:] = self.tokens[:-1]
        ctx[first] = start
        self.learns = np.repeat(self.train, self.sizes)
        if not cells:
            return
        n = len(self.word_keys)
        pair, self.inverse = np.unique(ctx * n + self.tokens, return_inverse=True)
        ctx, word = pair // n, pair % n
        key = cell_keys(self.word_keys, ctx, word)
        order = np.argsort(key)
        self.cell_keys, self.ctx, self.word = key[order], ctx[order], word[order]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.inverse = back[self.inverse]  # cell of each token

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words (of starts: training texts) and of cells."""
        w = np.bincount(self.tokens[self.learns], minlength=len(self.word_keys))
        w[self.start] = self.train.sum()
        return w, np.bincount(self.inverse[self.learns], minlength=len(self.cell_keys))


# --- exchange ---------------------------------------------------------------------

ASKED = "kind int, bucket long, chunk long, keys binary, numbers binary"
TOLD = "chunk long, kind int, bucket long, numbers binary, stats array<double>"


def asked(chunk: int, kind: int, keys: np.ndarray, numbers: list[np.ndarray], bits: int):
    """Rows of ASKED for all buckets with keys of a chunk."""
    at = np.concatenate([np.searchsorted(keys, (np.arange(1 << bits, dtype=np.uint64) << U(64 - bits))), [len(keys)]])
    some = np.flatnonzero(np.diff(at))
    blobs = [pack_keys(keys[at[i] : at[i + 1]], low_bits(kind)) for i in some]
    nums = [pack_numbers([x[at[i] : at[i + 1]] for x in numbers]) for i in some]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array(blobs, pa.binary()), pa.array(nums, pa.binary())], names=["kind", "bucket", "chunk", "keys", "numbers"])


def by_chunk(left: DataFrame, right: DataFrame, parts: int):
    """Both sides' rows of a chunk, in as many tasks as there are chunks: a task does not grow with the corpus."""
    return left.repartition(parts, "chunk").groupBy("chunk").cogroup(right.repartition(parts, "chunk").groupBy("chunk"))


def answered(ask: DataFrame, parts: int, make) -> DataFrame:
    """Adds up the numbers of equal keys of a bucket; make(kind, keys, sums, is_first) gives the answers'
    arrays, one number for each row of the bucket's distinct keys, and the bucket's statistics."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(key[0]), int(key[1])
        frame = frame.sort_values("chunk")
        each = [unpack_keys(b, low_bits(kind)) for b in frame["keys"]]
        sizes = np.array([len(e) for e in each])
        keys = np.concatenate(each)
        nums = [np.concatenate(x) for x in zip(*(unpack_numbers(b) for b in frame["numbers"]), strict=True)]
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        new = np.diff(sorted_keys, prepend=~sorted_keys[:1]) != 0
        starts = np.flatnonzero(new)
        sums = [np.add.reduceat(x[order], starts) for x in nums]
        out, stats = make(kind, sorted_keys[starts], sums)
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        owner = np.zeros(len(keys), np.int64)
        owner[order[starts]] = 1
        cols = [x[group] for x in out]
        if kind == CELLS:
            cols.append(owner)
        at = np.concatenate([[0], np.cumsum(sizes)])
        blobs = [pack_numbers([c[a:b] for c in cols]) for a, b in zip(at[:-1], at[1:], strict=True)]
        rows = pd.DataFrame({"chunk": frame["chunk"], "kind": kind, "bucket": bucket, "numbers": blobs, "stats": None})
        return pd.concat([rows, pd.DataFrame({"chunk": [-1], "kind": [kind], "bucket": [bucket], "numbers": [b""], "stats": [stats]})])

    return ask.repartition(parts, "kind", "bucket").groupBy("kind", "bucket").applyInPandas(run, TOLD)


def told(frame: pd.DataFrame, kind: int, columns: int) -> list[np.ndarray]:
    """A chunk's answers in the order of its keys."""
    mine = [unpack_numbers(b) for b in frame[frame["kind"] == kind].sort_values("bucket")["numbers"]]
    return [np.concatenate([np.zeros(0, np.int64), *(x[c] for x in mine)]) for c in range(columns)]


def totals(answers: DataFrame, kind: int, n: int) -> list[float]:
    row = answers.where((F.col("chunk") == -1) & (F.col("kind") == kind)).agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    return [float(x or 0) for x in row]


# --- the model ---------------------------------------------------------------------


def discount(once: float, twice: float) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once + twice > 0 else 0.5


def seat(keys: np.ndarray, customers: np.ndarray, new: np.ndarray, d: float, sweep: int) -> np.ndarray:
    """Tables for each key's customers, seated one after another: the next one opens a table with the
    odds new : seated - d * tables. new: weight of a new table, given all other restaurants' and words'
    tables of the sweep before. From the 32nd customer on groups of a sixteenth of those seated come
    together, and their expected number of tables is rounded at random, so hot words take few rounds."""
    tables = (customers > 0).astype(np.float64)
    go = np.flatnonzero(customers > 1)
    seated, turn = 1, 0
    while len(go):
        m = np.minimum(max(1, seated // 16), customers[go] - seated)
        t = tables[go]
        p = new[go] / (new[go] + seated - d * t)
        u = (mix64(keys[go] + U((sweep * 1_000_003 + turn) * 2 + 1)) >> U(11)).astype(np.float64) / 2.0**53
        tables[go] = t + np.minimum(np.floor(m * p + u), m)
        seated += max(1, seated // 16)
        turn += 1
        go = go[customers[go] > seated]
    return tables.astype(np.int64)


class Sweep:
    """What all restaurants' tables add up to after a sweep, apart from words' own numbers."""

    def __init__(self, d: float, d0: float, root: float, root_tables: float, kinds: float):
        self.d, self.d0, self.root, self.root_tables, self.kinds = d, d0, root, root_tables, kinds

    def parent(self, customers: np.ndarray, tables: np.ndarray, out=0) -> np.ndarray:
        """P(word) in the shared parent, of which `out` customers have been taken; words without customers get what an
        unknown word gets."""
        base = 1.0 / (self.kinds + 1)
        return (np.maximum(customers - self.d0 * np.minimum(tables, customers), 0) + (STRENGTH + self.d0 * self.root_tables) * base) / (STRENGTH + self.root - out)

    def predict(self, count, tables, total, context_tables, parent):
        """P(word | context); the parent's where the context is new."""
        p = (np.maximum(count - self.d * tables, 0) + (STRENGTH + self.d * context_tables) * parent) / (STRENGTH + total)
        return np.where(total > 0, p, parent)


def lm_score(docs: DataFrame, folds: int = 7, held_out: int = 2, samples: int = 2, burn_in: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are A-Z-lower-cased words and one end. Texts whose crc32 fold is not held_out are learned;
    all are scored: score is the sum of log10 of the probability of each token given the one before,
    averaged over the last `samples` of burn_in + samples Gibbs sweeps after an initial seating of one table for each word of a context;
    base_score is that of add-one single-word counts. Discounts come from the counts of counts. A null
    text is empty and has its end only. Rows that repeat an id count as many texts, whatever their texts are, and each
    has its score; ids must be integers; texts without id are learned. An empty table gives no rows.
    Other columns are ignored, whatever their names. Without training texts all words are unknown and all scores 0.

    Cells are seated all together given the last sweep's sums, so sweeps run in parallel."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession

    def step(make, name):
        out = written(make(), name)
        gc.collect()  # what no plan refers to any more, Spark's cleaner deletes: the shuffle files of this step
        spark.sparkContext._jvm.System.gc()
        return out

    state = step(lambda: chunks(rows, folds, held_out), "lm-chunks")
    parts = max(1, state.count())
    bits = max(4, parts.bit_length() + 1)  # two to four buckets for each chunk, so they do not grow with the corpus

    def ask_counts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                w, n = c.counts()
                yield asked(c.id, WORDS, c.word_keys, [w], bits)
                yield asked(c.id, CELLS, c.cell_keys, [n], bits)

    def add_counts(kind, keys, sums):
        n = sums[0]
        real = n[keys != START] if kind == WORDS else n
        return [n], [float(real.sum()), float((real > 0).sum()), float((real == 1).sum()), float((real == 2).sum())]

    counts = step(lambda: answered(state.mapInArrow(ask_counts, ASKED), parts, add_counts), "lm-counts")
    tokens, kinds, *_ = totals(counts, WORDS, 4)
    _, _, once, twice = totals(counts, CELLS, 4)
    d = discount(once, twice)

    # Chunks learn the counts of their keys; cells with several customers are kept apart, the others
    # have one table and only add to the sums of their word and their context.
    cells_schema = "chunk long, words binary, single binary, cells binary"

    def sums_of(n_words, ctx, word, tables):
        return [np.bincount(word, weights=tables, minlength=n_words).astype(np.int64), np.bincount(ctx, weights=tables, minlength=n_words).astype(np.int64)]

    def learn(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(left.iloc[0])
        count, owner = told(right, CELLS, 2)
        one = (count == 1) & (owner == 1)
        single = sums_of(len(c.word_keys), c.ctx[one], c.word[one], np.ones(int(one.sum())))
        many = count > 1
        order = np.lexsort((c.word[many], c.ctx[many]))  # by context, so that its places are small differences
        ctx, word, count, owner = (x[many][order] for x in (c.ctx, c.word, count, owner))
        return pd.DataFrame([{"chunk": c.id, "words": pack_keys(c.word_keys, 0), "single": pack_numbers(single), "cells": pack_numbers([np.diff(ctx, prepend=0), word, count, owner])}])

    def asking(row, tables, parts_of):
        """What a chunk adds to the sums of its words, given its cells' tables."""
        words, single, ctx, word, owner = parts_of
        own = owner == 1
        now = [s + m for s, m in zip(single, sums_of(len(words), ctx[own], word[own], tables[own]), strict=True)]
        return asked(int(row["chunk"]), WORDS, words, now, bits)

    def opened(row):
        ctx, word, count, owner = unpack_numbers(row["cells"])
        return unpack_keys(row["words"], 0), unpack_numbers(row["single"]), np.cumsum(ctx), word, owner, count

    def first_tables(batches):
        for batch in batches:
            for row in batch.to_pylist():
                *parts_of, count = opened(row)
                yield asking(row, np.ones(len(count)), parts_of)

    own_counts = counts.where("chunk >= 0").drop("stats")
    cells = step(lambda: by_chunk(state, own_counts, parts).applyInPandas(learn, cells_schema), "lm-cells")
    ask = cells.mapInArrow(first_tables, ASKED)

    def add_sums(sweep, d0, weight):
        def make(kind, keys, sums):
            served, of_context = sums
            if sweep == 0:
                tables = (served > 0).astype(np.int64)
            else:
                tables = seat(keys, served, np.full(len(keys), weight), d0, 1000 + sweep)
            return [served, tables, of_context], [float(served.sum()), float(tables.sum()), float((served == 1).sum()), float((served == 2).sum())]

        return make

    def reseat(sweep: int, last: Sweep):
        """The sums that a chunk asks for after the sweep, and a row of its cells' tables."""

        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            row = left.iloc[0]
            *parts_of, count = opened(row)
            words, _, ctx, word, _ = parts_of
            old = right[right["kind"] == TABLES]["numbers"]
            old = unpack_numbers(old.iloc[0])[0] if len(old) else np.ones(len(ctx), np.int64)
            served, root_tables, of_context = told(right, WORDS, 3)
            new = (STRENGTH + last.d * (of_context[ctx] - old)) * last.parent(served[word] - old, root_tables[word], old)
            t = seat(cell_keys(words, ctx, word), count, new, last.d, sweep)
            ask = asking(row, t, parts_of).to_pandas()
            return pd.concat([ask, pd.DataFrame([{"kind": TABLES, "bucket": 0, "chunk": int(row["chunk"]), "keys": b"", "numbers": pack_numbers([t])}])])

        return run

    sweeps: list[Sweep] = []
    held: list[list[DataFrame]] = []
    answers: list[DataFrame] = []  # what chunks are told after a sweep, with the tables that they have made
    for s in range(burn_in + samples + 1):
        tables = []
        if s:
            asks = step(lambda: by_chunk(cells, answers[-1], parts).applyInPandas(reseat(s, sweeps[-1]), ASKED), f"lm-asks{s}")  # noqa: B023
            if s - 1 <= burn_in:
                dropped(*held[-1])  # a sweep that is no sample has been used
            tables = [step(lambda: asks.where(F.col("kind") == TABLES).drop("keys"), f"lm-tables{s}")]  # noqa: B023
            ask = asks.where(F.col("kind") == WORDS)
        before = sweeps[-1] if s else None
        weight = (STRENGTH + before.d0 * before.root_tables) / (kinds + 1) if s else 0.0
        sums = step(lambda: answered(ask, parts, add_sums(s, before.d0 if s else 0.5, weight)), f"lm-sweep{s}")  # noqa: B023
        if s:
            dropped(asks)
        held.append([sums, *tables])
        answers.append(reduce(DataFrame.unionByName, [sums.where("chunk >= 0").drop("stats"), *tables]))
        served, root_tables, r1, r2 = totals(sums, WORDS, 4)
        sweeps.append(Sweep(d, before.d0 if s else discount(r1, r2), served, root_tables, kinds))

    dropped(cells)  # the tables and sums of the sampled sweeps are written; scores need only those and the counts
    everything = own_counts.withColumn("sweep", F.lit(-1))
    for s in range(burn_in + 1, burn_in + samples + 1):
        everything = everything.unionByName(answers[s].withColumn("sweep", F.lit(s)))

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(left.iloc[0])
        by = dict(tuple(right.groupby("sweep")))
        (of_word,) = told(by[-1], WORDS, 1)
        count, _ = told(by[-1], CELLS, 2)
        many = np.flatnonzero(count > 1)
        many = many[np.lexsort((c.word[many], c.ctx[many]))]
        known = np.where(c.word_keys == START, 0, of_word)
        p = np.zeros(len(c.cell_keys))
        for s in range(burn_in + 1, burn_in + samples + 1):
            tables = (count > 0).astype(np.int64)
            (tables[many],) = told(by[s], TABLES, 1)
            served, root_tables, of_context = told(by[s], WORDS, 3)
            parent = sweeps[s].parent(served, root_tables)
            p += sweeps[s].predict(count, tables, of_word[c.ctx], of_context[c.ctx], parent[c.word])
        logp = np.log10(p / samples)
        first = np.cumsum(c.sizes) - c.sizes
        n = c.sizes.astype(np.int64)
        add = lambda x: np.add.reduceat(x, first)
        seen = known[c.tokens]
        return pd.DataFrame(
            {
                "doc_id": pd.Series(c.ids, dtype="Int64").mask(c.ids == NO_ID),
                "held_out": ~c.train,
                "n_tokens": n,
                "n_known": add((seen > 0).astype(np.int64)),
                "train_tokens": int(tokens),
                "base_score": add(np.log10(seen + 1.0)) - n * np.log10(tokens + kinds + 1),
                "score": add(logp[c.inverse]),
            }
        )

    out = by_chunk(state, everything, parts).applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
