"""Toxicity: class-conditional Kneser-Ney models of word pairs with shared backoff counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.bpe import text_runs
from lexforge.llm.common import crc_fold, doc_words, dropped, written

U = np.uint64
#: Stands before the first word of a text.
START = U(0x452821E638D01377)
#: Bias and weights that the calibration starts from, for tables with few labels.
PRIOR = np.array([-9.0, 1.5, 1.0, 0.5, 0.5])
FEATURES = len(PRIOR) - 1


def pair_keys(ids: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """Keys of words with the words before them, from the words' numbers; first: where texts start, after the number `start`."""
    before = np.concatenate([[start], ids[:-1]])
    before[first[first < len(before)]] = start
    return before.astype(np.uint64) << U(32) | ids.astype(np.uint64)


def discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once + twice > 0 else 0.75


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted keys; len(keys) for what is not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    at[keys[at] != wanted] = len(keys)
    return at


class Model:
    """Two interpolated Kneser-Ney models, of toxic (1) and ordinary (0) texts.

    keys: the sorted 64-bit hashes of all words and of the start of a text; a word's number is its place. words: (a0, a1, n0, n1, k0, k1) by
    number, after how many different words a word comes in a class, how often one comes after it, and how many different ones.
    pairs: broadcast pieces, see share(), by the number of the word before, `step` numbers to a piece; the driver holds one at a time.
    sums: by order and class, the numbers of all words or pairs: kinds, once, twice; and for words
    the sum of a. Words back off to the counts of both classes together, so what is rare in a class has about
    its shared probability."""

    def __init__(self, keys: np.ndarray, words: list[np.ndarray], pairs: list, step: int, sums: dict, kinds: int):
        small = np.float32
        d = [discount(*sums["word"][k][1:3]) for k in (0, 1)]
        self.words = keys
        table = np.stack([np.append(x, 0) for x in words]).astype(np.float64)
        base = (table[0] + table[1] + 0.5) / (sums["word"][0][3] + sums["word"][1][3] + 0.5 * (kinds + 1))
        self.word = []  # P(word) of each class; last the unknown word
        for k in (0, 1):
            types, _, _, total = sums["word"][k]
            self.word.append((np.maximum(table[k] - d[k], 0) + d[k] * types * base) / total if total else base)
        self.ratio = np.log(self.word[1] / self.word[0]).astype(small)
        self.word = [x.astype(small) for x in self.word]
        d = pair_discounts(sums)
        n, followers = table[2:4], table[4:6]
        self.total = np.maximum(n, 1).astype(small)
        self.backoff = np.where(n > 0, np.array(d)[:, None] * followers / np.maximum(n, 1), 1.0).astype(small)
        self.pairs, self.step = pairs, step
        self.less = [np.maximum(np.arange(MANY + 1) - x, 0).astype(small) for x in d]
        self.weights = PRIOR

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pairs"}

    def shared(self, spark: SparkSession):
        """(held, get): the broadcast of all but the pairs, and what gives tasks the whole model."""
        held, pairs = spark.sparkContext.broadcast(self), self.pairs

        def get() -> Model:
            model = held.value
            model.pairs = pairs
            return model

        return held, get

    def given(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Numbers of words, and P(word | word before) of ordinary and of toxic texts."""
        word, start = find(self.words, hashes), find(self.words, np.array([START]))[0]
        key = pair_keys(word, first, start)
        before = (key >> U(32)).astype(np.int64)
        part = (before // self.step).astype(np.uint16)
        order, n = np.argsort(part, kind="stable"), np.zeros((2, len(key)), np.float32)
        edges = np.searchsorted(part[order], np.arange(len(self.pairs) + 1))
        for i, piece in enumerate(self.pairs):
            rows = order[edges[i] : edges[i + 1]]
            if piece is None or not len(rows):
                continue
            pairs, *count, many, more0, more1 = piece.value
            pair = find(pairs, key[rows])
            large = np.flatnonzero((count[0][pair] == MANY) | (count[1][pair] == MANY))
            at = find(many, key[rows[large]])
            for k, more in enumerate((more0, more1)):
                n[k, rows] = self.less[k][count[k][pair]]
                n[k, rows[large]] = more[at]
        return word, [n[k] / self.total[k][before] + self.backoff[k][before] * self.word[k][word] for k in (0, 1)]

    def ratios(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln P(word | toxic) - ln P(word | ordinary) of each word, alone and given the word before."""
        word, p = self.given(hashes, first)
        return self.ratio[word], np.log(p[1] / p[0])

    def features(self, texts: list) -> np.ndarray:
        """Length-normalised differences of log-likelihoods: of the most toxic word, of the three most toxic words, of
        the whole text word by word, and of the whole text given the words before. Zeros without words."""
        out = np.zeros((len(texts), FEATURES))
        for first, last, bounds, h, *_ in doc_words(texts):
            if not len(h):
                continue
            own, given = self.ratios(h, bounds[:-1])
            for i in range(first, last):
                a, b = bounds[i - first], bounds[i - first + 1]
                if a < b:
                    x = own[a:b]
                    top = x if b - a <= 3 else np.partition(x, b - a - 3)[b - a - 3 :]
                    out[i] = top.max(), top.mean(), x.mean(), given[a:b].mean()
        return out

    def score(self, texts: list) -> np.ndarray:
        w = self.weights
        return 1 / (1 + np.exp(-np.clip(w[0] + self.features(texts) @ w[1:], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with PRIOR as the mean of its weights. No weight of a
    feature falls below 0: a more toxic likelihood never lowers the score."""
    a, w = np.column_stack([np.ones(len(x)), x]), PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * (w - PRIOR)
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        old = w.copy()
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(w - old).max() < 1e-8:
            break
    return w


def word_keys(labelled: DataFrame) -> np.ndarray:
    """The sorted hashes of all words of (text, toxic), and START. Tasks find those of their own rows."""

    def run(batches):
        for batch in batches:
            for a, b in text_runs(batch.column(0)):
                for _, _, _, h, *_ in doc_words(batch.column(0).slice(a, b - a).to_pylist()):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(np.unique(h).view(np.int64))})

    found = packed(labelled.select("text").mapInArrow(run, "key long").distinct(), F.pmod("key", F.lit(PARTS)), {"key": np.int64})
    return np.unique(np.concatenate([np.array([START]), *(key.view(np.uint64) for _, (key,) in found)]))


def pair_counts(labelled: DataFrame, keys: np.ndarray):
    """The broadcast keys, and (key, n0, n1) of (text, toxic): how often a word comes after another in each class. Tasks count the pairs of their own
    rows; keys are the words' numbers, so a pair is one number."""
    held = labelled.sparkSession.sparkContext.broadcast(keys)

    def count(batches):
        for batch in batches:
            kind = np.array(batch.column(1).to_pylist())
            start = find(held.value, np.array([START]))[0]
            for a, b in text_runs(batch.column(0)):
                for first, last, bounds, h, *_ in doc_words(batch.column(0).slice(a, b - a).to_pylist()):
                    if not len(h):
                        continue
                    toxic = np.repeat(kind[a + first : a + last], np.diff(bounds))
                    some, back = np.unique(pair_keys(find(held.value, h), np.asarray(bounds[:-1]), start), return_inverse=True)
                    n1 = np.bincount(back, toxic, len(some)).astype(np.int64)
                    n0 = np.bincount(back, minlength=len(some)) - n1
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some.view(np.int64), n0, n1)], names=["key", "n0", "n1"])

    got = labelled.select("text", "toxic").mapInArrow(count, "key long, n0 long, n1 long")
    return held, got.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


#: Pieces in which a table comes to the driver, one after the other.
PARTS = 32
#: From this count on a pair's counts do not fit a byte. A text sample of n words has n / MANY such pairs at most.
MANY = 255


def packed(rows: DataFrame, part, columns: dict):
    """(number, columns as arrays) of each piece, sorted by the first column. Executors pack and write them, and they come one by one."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(next(iter(columns)))
        return pd.DataFrame({"part": [key[0]], "n": [len(frame)], "cells": [b"".join(frame[c].to_numpy(np.int64).astype(t).tobytes() for c, t in columns.items())]})

    table = written(rows.withColumn("part", part).groupBy("part").applyInPandas(run, "part long, n long, cells binary"), "tox-pieces")
    for r in table.toLocalIterator():  # PARTS rows
        ends = np.cumsum([r["n"] * np.dtype(t).itemsize for t in columns.values()])
        yield r["part"], [np.frombuffer(r["cells"], t, r["n"], end - r["n"] * np.dtype(t).itemsize) for t, end in zip(columns.values(), ends, strict=True)]
    dropped(table)


def pair_discounts(sums: dict) -> list[float]:
    return [discount(*sums["pair"][k][1:3]) for k in (0, 1)]


def share(pairs: DataFrame, step: int, d: list[float]) -> list:
    """The broadcast pieces of pairs (key, n0, n1), None where there are none. A piece: sorted keys, their counts of each class as bytes, and for
    those with a count of MANY keys and discounted whole counts of each class. Counts end with a 0 for what is not there."""
    out, piece = [None] * PARTS, F.expr(f"(key >> 32) div {step}")
    for i, (key, *n) in packed(pairs, piece, {"key": np.uint64, "n0": np.uint32, "n1": np.uint32}):
        large = (n[0] >= MANY) | (n[1] >= MANY)
        count = [np.append(np.minimum(x, MANY).astype(np.uint8), np.uint8(0)) for x in n]
        more = [np.append(np.maximum(x[large] - y, 0), 0).astype(np.float32) for x, y in zip(n, d, strict=True)]
        out[i] = pairs.sparkSession.sparkContext.broadcast((key, *count, key[large], *more))
    return out


def learn(labelled: DataFrame) -> Model:
    """The models of (text, toxic), with every word and every pair of words that occurs."""
    keys = word_keys(labelled)
    held, counted = pair_counts(labelled, keys)
    pairs = written(counted, "tox-pairs")
    held.destroy()
    some = lambda c: F.count_if(F.col(c) > 0)
    after = pairs.groupBy(F.expr("key & 4294967295").alias("id")).agg(some("n0").alias("a0"), some("n1").alias("a1"))
    context = pairs.groupBy(F.expr("key >> 32").alias("id")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), some("n0").alias("k0"), some("n1").alias("k1"))
    columns = ["a0", "a1", "n0", "n1", "k0", "k1"]
    words = written(after.join(context, "id", "full_outer").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns]), "tox-words")
    counts = lambda c: [F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2), F.sum(c)]
    sums = {kind: (lambda r: [[float(x or 0) for x in r[4 * k : 4 * k + 4]] for k in (0, 1)])(list(df.agg(*counts(f"{c}0"), *counts(f"{c}1")).first())) for kind, df, c in (("word", words, "a"), ("pair", pairs, "n"))}
    kinds = words.where("a0 + a1 > 0").count()
    step = -(-len(keys) // PARTS)
    table = [np.zeros(len(keys), np.uint32) for _ in columns]
    for _, (ids, *found) in packed(words, F.expr(f"id div {step}"), {"id": np.uint32, **dict.fromkeys(columns, np.uint32)}):
        for x, y in zip(table, found, strict=True):
            x[ids] = y
    model = Model(keys, table, share(pairs, step, pair_discounts(sums)), step, sums, kinds)
    dropped(pairs, words)
    return model


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 12_500, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Learns from labelled rows whose fold is not held_out: of each class those with the smallest hashes of their ids,
    about most_rows in all large tables and never more than are there. Four fifths of them are counted, one fifth calibrates,
    each class with the weight of its share among all labelled rows. None without rows of both classes.

    An id with several labels is toxic if any of them is; null labels and labels or texts without id teach nothing; an id
    with several texts teaches the one with the smallest hash; null texts are empty. Other columns are not read."""
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    if folds:
        marked = marked.where(crc_fold(F.col("doc_id"), folds) != held_out)
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    part = {k: min(1 << 32, int(most_rows / n * (1 << 32))) for k, n in sizes.items()}
    low = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1))
    chosen = F.broadcast(marked.where(low < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0])))  # about 2 * most_rows ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "tox-texts")
    apart = F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    model = learn(rows.where(~apart))
    held, get = model.shared(spark)

    def measure(batches):
        for batch in batches:
            x = np.concatenate([np.zeros((0, FEATURES)), *(get().features(batch.column(0).slice(a, b - a).to_pylist()) for a, b in text_runs(batch.column(0)))])
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, k]) for k in range(FEATURES))], names=["toxic", *(f"x{k}" for k in range(FEATURES))])

    got = rows.where(apart).select("text", "toxic").mapInArrow(measure, "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toPandas()
    held.destroy()  # broadcast again with its weights, without the pairs
    dropped(rows)
    y = got["toxic"].to_numpy(float)
    weight = np.ones(len(y))
    for k in (0, 1):
        weight[y == k] = max(1.0, sizes[k] / most_rows)
    model.weights = calibrate(got.iloc[:, 1:].to_numpy(float), y, weight)
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per row of docs, whole texts, no shuffle; only the text is read. Null and empty texts and
    those without words get the score of no evidence; without a model all scores are 0. Rows that repeat an id or have none are
    scored each by itself; an empty table gives no rows. The broadcast model has 36 bytes for each word and 10 for each pair
    of the at most about 25,000 texts that it has learned from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    _, get = model.shared(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in text_runs(batch.column(1)):
                p = get().score(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], names=["doc_id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, limit: float = 0.7) -> DataFrame:
    """Documents that the score rejects go; learned from all labelled rows. Without rows of both classes, all stay. Null texts
    and rows without id are judged like others; columns are kept as they are; an empty table stays empty."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=0)
    if model is None:
        return docs
    (_, get), at = model.shared(spark), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b in text_runs(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(get().score(part.column(at).to_pylist()) < limit))

    return docs.mapInArrow(run, docs.schema)
