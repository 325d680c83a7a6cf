"""Hard-negative mining: exact inner-product search in buckets of falling norm, pruned by the Cauchy-Schwarz bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import dropped, written

#: What finds of a search look like; key tells an anchor's queries apart.
FOUND = "anchor_id long, key long, score long, vec_id long"

#: Up to here sums of products of doubles that are whole numbers are exact in any order.
EXACT = 2.0**53
_TOP = 2**63 - 1
#: Groups of runs whose largest norms the driver holds.
LADDER = 4096
#: Queries that are compared at a time.
CHUNK = 128


def unpack(raw: bytes, dim: int) -> np.ndarray:
    """Rows of whole numbers; the first byte says how wide they are stored."""
    return np.frombuffer(raw, {b"h": "<i2", b"d": "<f8"}[raw[:1]], offset=8).reshape(-1, dim).astype(np.float64) if dim else np.zeros((0, 0))


def pack(x: np.ndarray) -> bytes:
    small = x.size == 0 or np.abs(x).max() < 32768
    return (b"h" if small else b"d").ljust(8) + x.astype("<i2" if small else "<f8").tobytes()


def products(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; those beyond 64 bits stay at the limits."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not len(a) or not len(b) or norm_a.max() * norm_b.max() < EXACT:
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    small = norm_a[:, None] * norm_b[None, :] < EXACT
    i, j = np.flatnonzero(small.any(axis=1)), np.flatnonzero(small.any(axis=0))
    with np.errstate(invalid="ignore"):
        out[np.ix_(i, j)] = (a[i] @ b[j].T).clip(-EXACT, EXACT).astype(np.int64)
    whole = lambda x: [[int(v) for v in r] for r in x]
    i, j = np.flatnonzero(~small.all(axis=1)), np.flatnonzero(~small.all(axis=0))
    big_a, big_b = dict(zip(i, whole(a[i]), strict=True)), dict(zip(j, whole(b[j]), strict=True))
    for k, m in np.argwhere(~small):
        out[k, m] = max(-_TOP - 1, min(_TOP, sum(p * q for p, q in zip(big_a[k], big_b[m], strict=True))))
    return out


def best(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each anchor's first k: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    first = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[rank < k]


class Running:
    """The first k of each query so far. least: the score a query asks for; limit: that, or the k-th score once there are k."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.limit = k, least.copy()
        self.query, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        keep = best(q, s, i, self.k)
        self.query, self.score, self.ids = q[keep], s[keep], i[keep]
        count = np.bincount(self.query, minlength=len(self.limit))
        last = np.full(len(self.limit), _TOP)
        np.minimum.at(last, self.query, self.score)
        full = count >= self.k
        self.limit[full] = np.maximum(self.limit[full], last[full])


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(vec_id, label, x, norm): floor(256 * component) of rows with an id, a label and finite components; rows that share an id count once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    good = rows.where("vec_id is not null and label is not null and x is not null").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    one = good.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")

    def floors(batches):
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                v = np.floor(np.clip(256.0 * np.array(x, np.float64), -1e300, 1e300))
                out.append((v.tolist(), math.hypot(*v) if len(v) else 0.0))
            if out:
                x, norm = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64())), pa.array(norm, pa.float64())], names=["vec_id", "label", "x", "norm"])

    return one.mapInArrow(floors, "vec_id long, label long, x array<double>, norm double")


class Buckets:
    """Rows by falling norm: table (run, place, top, ids, labels, norms, x), a row for `size` vectors at most, `side` of them a run; steps:
    falling norms, LADDER at most, of as many groups of runs."""

    def __init__(self, rows: DataFrame, size: int, side: int):
        total, self.dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
        parts = max(1, -(-total // size))
        runs = -(-parts // side)
        self.groups = min(runs, LADDER)
        order, dim = [F.desc("norm"), F.col("vec_id")], self.dim
        # Ids break ties, so rows of one norm fill many partitions.
        ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

        def cut(batches):
            k = 0
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    b = batch.slice(at, size)
                    x = np.zeros((b.num_rows, dim))
                    for i, v in enumerate(b.column(2).to_pylist()):
                        x[i, : len(v)] = v
                    norm = b.column(3).to_numpy()
                    raw = [*(b.column(c).to_numpy().astype(np.int64).tobytes() for c in (0, 1)), norm.tobytes(), pack(x)]
                    part = b.column(4)[0].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([part // side]), pa.array([(part << 32) + k]), pa.array([float(norm.max())]), *(pa.array([v], pa.binary()) for v in raw)], names=["run", "place", "top", "ids", "labels", "norms", "x"])
                    k += 1

        self.table = written(ranged.mapInArrow(cut, "run long, place long, top double, ids binary, labels binary, norms binary, x binary"), "hard-buckets")
        self.runs = self.table.groupBy("run").agg(F.max("top").alias("top")).withColumn("step", F.floor(F.col("run") * self.groups / runs))
        tops = {r["step"]: r["top"] for r in self.runs.groupBy("step").agg(F.max("top").alias("top")).collect()}  # LADDER at most
        self.steps = np.array([tops.get(i, 0.0) for i in range(self.groups)])


def blocks_of(queries: DataFrame, size: int, dim: int) -> DataFrame:
    """(block, need, anchors, keys, labels, low, high, norms, x): `size` queries at most that need about the same buckets.
    need: the smallest norm of a bucket in which one of them can find what it asks for."""
    bound = F.when(F.col("low") <= 0, F.lit(-1.0)).when(F.col("norm") > 0, F.col("low") * (1 - 1e-9) / F.col("norm")).otherwise(F.lit(float("inf")))
    rows = queries.withColumn("need", bound)
    parts = max(1, -(-queries.count() // size))
    order = ["need", "anchor_id", "key"]
    rows = rows.select("need", "anchor_id", "key", "label", "low", "high", "norm", "x").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id())
    names = ["block", "need", "anchors", "keys", "labels", "low", "high", "norms", "x"]

    def cut(batches):
        k = 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                x = np.zeros((b.num_rows, dim))
                for i, v in enumerate(b.column(7).to_pylist()):
                    x[i, : len(v)] = v
                raw = [*(b.column(c).to_numpy().astype(np.int64).tobytes() for c in range(1, 6)), b.column(6).to_numpy().tobytes(), pack(x)]
                yield pa.RecordBatch.from_arrays([pa.array([(b.column(8)[0].as_py() << 32) + k]), pa.array([b.column(0).to_numpy().min()]), *(pa.array([v], pa.binary()) for v in raw)], names=names)
                k += 1

    return written(rows.mapInArrow(cut, "block long, need double, " + ", ".join(f"{c} binary" for c in names[2:])), "hard-queries")


def _find(dim: int, k: int, same: bool):
    def find(asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(data):
            return pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in FOUND.split(", ")})
        q = asked.iloc[0]
        anchors, keys, labels, low, high = (np.frombuffer(q[c], np.int64) for c in ("anchors", "keys", "labels", "low", "high"))
        norms, x = np.frombuffer(q["norms"], np.float64), unpack(q["x"], dim)
        best_so_far = Running(len(anchors), k, low)
        for r in data.sort_values("place").itertuples():
            live = np.flatnonzero(norms * r.top >= best_so_far.limit * (1 - 1e-9))
            if not len(live):
                continue
            ids, kinds, tops, y = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), np.frombuffer(r.norms, np.float64), unpack(r.x, dim)
            for at in range(0, len(live), CHUNK):
                mine = live[at : at + CHUNK]
                _, one, back = np.unique(anchors[mine], return_index=True, return_inverse=True)  # an anchor's queries share its products
                s = products(x[mine[one]], y, norms[mine[one]], tops)[back]
                fit = (s >= best_so_far.limit[mine, None]) & (s <= high[mine, None]) & ((labels[mine, None] == kinds) == same) & (anchors[mine, None] != ids)
                i, j = np.nonzero(fit)
                best_so_far.add(mine[i], s[i, j], ids[j])
        i = best_so_far.query
        return pd.DataFrame({"anchor_id": anchors[i], "key": keys[i], "score": best_so_far.score, "vec_id": best_so_far.ids})

    return find


def first_k(found: DataFrame, k: int) -> DataFrame:
    """Each query's first k: rank from 1, higher scores first, ties by smaller id."""
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, data: Buckets, k: int, same: bool, block: int) -> DataFrame:
    """(anchor_id, key, score, vec_id, rank): each query's first k rows of its own label, or of others.

    queries: anchor_id, key, label, low, high, x, norm; rows have to score from low to high, and not be the anchor. The run of the largest
    norms comes first; the k-th scores found there raise the lower limits. A bucket can only hold a score
    up to its largest norm times the query's, so of the rest, blocks of queries meet only the runs that reach the limits, which is a
    first part of all runs. Within a task buckets come by falling norm, and each query's k-th score goes on rising."""
    queries = written(queries, "hard-asked")
    blocks = blocks_of(queries, block, data.dim)
    first = blocks.select("block", F.explode(F.array(F.lit(0).cast("long"))).alias("run"))  # no literal, which would make the join a product
    seeds = written(_meet(first, blocks, data, k, same), "hard-seeds")
    kth = first_k(seeds, k).where(F.col("rank") == k).select("anchor_id", "key", F.col("score").alias("kth"))
    raised = queries.join(kth, ["anchor_id", "key"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low"))).drop("kth")
    more = blocks_of(raised, block, data.dim)
    steps = data.steps

    def reach(batches):
        for batch in batches:
            # One step more than the bound asks for does no harm; none is too few, as steps fall.
            last = [int(np.searchsorted(-steps, -need, "right")) for need in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(last, pa.int32())], names=["block", "need", "last"])

    near = more.select("block", "need").mapInArrow(reach, "block long, need double, last int").where("last > 0")
    near = near.select("block", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long") - 1)).alias("step"))
    near = near.join(data.runs.where("run > 0"), "step").where("top >= need").select("block", "run")
    rest = _meet(near, more, data, k, same)
    found = written(first_k(seeds.unionByName(rest), k), "hard-found")
    dropped(queries, blocks, more, seeds)
    return found


def _meet(near: DataFrame, blocks: DataFrame, data: Buckets, k: int, same: bool) -> DataFrame:
    rows = near.join(data.table, "run").select("block", "run", "place", "top", "ids", "labels", "norms", "x")
    asked = near.toDF("_block", "_run").join(blocks, F.col("_block") == F.col("block")).drop("block")
    asked = asked.withColumnsRenamed({"_block": "block", "_run": "run"})
    return asked.groupBy("block", "run").cogroup(rows.groupBy("block", "run")).applyInPandas(_find(data.dim, k, same), FOUND)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, fifths: int = 4, size: int = 2048, side: int = 4, block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors. Scores are inner products of floor(256 * component), exact, in whole numbers; those that pass 64 bits
    stay at the limits, and components end at 1e300. An anchor's positives are its first k rows of its label, higher scores
    first, ties by smaller id; a positive's negatives are the first k rows of other labels that score `fifths` fifths of the positive's score
    or more, and not more than it. A positive below 0 has none.

    Rows without id, label or vector, or with a null or non-finite component, take no part; shorter vectors end in zeros; rows that
    share an id count once, that with the smallest label and vector. Other columns are ignored; without anchors or rows there are
    no rows.

    Every anchor is held against all rows: work grows with anchors times rows where norms differ too little for the bound
    to skip buckets. A task holds `block` queries and `side` buckets of `size` rows."""
    flagged = vectors.withColumns({"_anchor": anchors, "_label": label})
    rows = written(whole_numbers(flagged, id_col, vec_col, F.col("_label")), "hard-rows")
    data = Buckets(rows, size, side)
    ask = flagged.where("_anchor").select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    ask = written(rows.join(ask, "vec_id", "left_semi").withColumnRenamed("vec_id", "anchor_id"), "hard-anchors")
    limits = lambda lo, hi: {"low": F.lit(lo).cast("long"), "high": F.lit(hi).cast("long")}
    positives = search(ask.withColumns({"key": F.lit(0).cast("long"), **limits(-_TOP - 1, _TOP)}), data, k, True, block)
    positives = positives.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("high")).where("high >= 0")
    least = F.expr(f"high - high div 5 * {5 - fifths} - (high % 5 * {5 - fifths}) div 5")
    negatives = search(positives.withColumn("low", least).join(ask, "anchor_id"), data, k, False, block)
    out = negatives.join(positives.select("anchor_id", "key", F.col("high").alias("positive_score")), ["anchor_id", "key"])
    return out.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, label = F.col("vec_id"), F.col("label")
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec % 100 == 0, F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score) WHERE rank <= 5
"""
