"""MinHash near-dedup with SetSketch registers: bands, joint likelihood, exact verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.bpe import text_runs
from lexforge.llm.common import Forest, components, doc_words, dropped, mix64, written

U = np.uint64
WORDS = 5  # words in a shingle
REGISTERS = 120
#: SetSketch: rate and base of the exponential spacing, and the largest register value.
RATE, BASE, LIMIT = 20.0, 1.001, 65535
_draw = np.random.default_rng(171)
_A = _draw.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _draw.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text's words; fewer than five words are one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(n, WORDS)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = h * U(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j]
    return np.unique(mix64(h))


def sketch(items: np.ndarray) -> np.ndarray:
    """Registers floor(1 - log_b of the least of the items' exponential values), cut to 0..65535.

    The register-wise maximum of two sketches is the sketch of the union."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (items >> U(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        part = np.multiply.outer(_A, x[at : at + 2048])
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def layout(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands of which a pair of similarity percent/100 shares none in fewer
    than 1 of 10,000 cases; 20 x 6 at 85 (1 in 13,000), 24 x 5 at 80 (1 in 14,000). Below 8 even
    bands of one row lose more."""
    for rows in range(REGISTERS, 1, -1):
        if REGISTERS % rows == 0 and (1 - (percent / 100) ** rows) ** (REGISTERS // rows) < 1e-4:
            return REGISTERS // rows, rows
    return REGISTERS, 1


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    r = registers.reshape(-1, bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93), r.shape[:2]).copy()
    for j in range(rows):
        h = mix64(h ^ (r[:, :, j] + U(j << 20)))
    return h


def likely_similarity(above: np.ndarray, below: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarities from how many registers of the first sketch are above and below
    the second's, given both set sizes.

    With u and v the sets' shares of n1 + n2, a register is above with probability u - v J, below with
    v - u J, and equal with J, up to the base's closeness to 1; the likelihood's derivative is zero
    at the smaller root of a quadratic."""
    u = n1 / (n1 + n2)
    v = 1 - u
    equal = REGISTERS - above - below
    b = equal * (u * u + v * v) + v * v * above + u * u * below
    return (b - np.sqrt(np.maximum(b * b - 4 * (u * v) ** 2 * REGISTERS * equal, 0))) / (2 * u * v * REGISTERS)


def likely_pairs(sketches: np.ndarray, size: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """[n, n] pairs with a left member whose likely similarity is not 0.2 or more under the limit."""
    n = len(size)
    near = np.zeros((n, n), bool)
    for i in range(n - 1):
        equal = (sketches[i + 1 :] == sketches[i]).sum(axis=1)
        fits = 100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i])
        cand = np.flatnonzero((equal >= 0.5 * REGISTERS) & fits & (left[i + 1 :] | left[i])) + i + 1
        if len(cand):
            above, below = (sketches[i] > sketches[cand]).sum(axis=1), (sketches[i] < sketches[cand]).sum(axis=1)
            near[i, cand] = likely_similarity(above, below, np.full(len(cand), size[i]), size[cand]) >= percent / 100 - 0.2
    return near | near.T


def shared_counts(sets: list[np.ndarray], most_s: float, columns: int = 4096) -> np.ndarray | None:
    """[n, n] sizes of all intersections, from matrix products over the items that two sets or more
    have; None if that takes more than most_s seconds, at about 10^10 products a second."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    some = count[item] > 1
    item, owner = number[item[some]], owner[some]
    kinds = int(number[-1]) + 1 if len(number) else 0
    if n * n * kinds / 1e10 > most_s:
        return None
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, kinds, columns):
        a, b = np.searchsorted(item, (first, first + columns))
        block = np.zeros((n, min(columns, kinds - first)), np.float32)
        block[owner[a:b], item[a:b] - first] = 1
        out += block @ block.T
    return out


def links(sketches: np.ndarray, sets: list[np.ndarray], seed: np.ndarray, left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join everything which similarities of `percent` or more join, as a forest.

    seed: component numbers known already; pairs inside one are not looked at, and pairs need a
    member that is marked left. Likely pairs are verified on the full sets unless their ends are
    joined by then, those of the members with most likely partners first, so copies of one text
    usually need one verification each; where many pairs are likely and the sets are alike, all
    intersections come from matrix products instead."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    near = likely_pairs(sketches, size, left, percent)
    exact = shared_counts(sets, 2e-5 * (near.sum() // 2) * max(1.0, size.mean() / 500)) if near.any() else None
    if exact is not None:
        near &= 100 * exact >= percent * (size[:, None] + size[None, :] - exact)
    forest = Forest(n)
    first: dict = {}
    for i, c in enumerate(seed.tolist()):
        forest.join(first.setdefault(c, i), i)
    out = []
    for i in np.argsort(-near.sum(axis=1), kind="stable"):
        for j in np.flatnonzero(near[i]):
            near[j, i] = False
            if forest.root(i) != forest.root(j):
                if exact is None:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both < percent * (len(sets[i]) + len(sets[j]) - both):
                        continue
                forest.join(i, j)
                out.append((int(i), int(j)))
    return out


def _sets(docs: DataFrame, with_set: bool) -> DataFrame:
    """(doc_id, n, f1, f2, sketch) of whole texts, or (doc_id, sketch, items)."""

    def run(batches):
        for batch in batches:
            for a, b in text_runs(batch.column(1)):
                n, f1, f2, sk, it = [], [], [], [], []
                for first, last, bounds, h, *_ in doc_words(batch.column(1).slice(a, b - a).to_pylist()):
                    for i in range(last - first):
                        s = shingles(h[bounds[i] : bounds[i + 1]])
                        n.append(len(s))
                        sk.append(sketch(s).tobytes() if len(s) else b"")
                        if with_set:
                            it.append(s.tobytes())
                        else:
                            f1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                            f2.append(int(mix64(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                ids = batch.column(0).slice(a, b - a)
                if with_set:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sk, pa.binary()), pa.array(it, pa.binary())], names=["doc_id", "sketch", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sk, pa.binary())], names=["doc_id", "n", "f1", "f2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, sketch binary, items binary" if with_set else "doc_id long, n long, f1 long, f2 long, sketch binary")


def _explode_bands(reps: DataFrame, percent: int) -> DataFrame:
    n, length = layout(percent)

    def run(batches):
        for batch in batches:
            keep = batch.num_rows
            if keep:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(keep, REGISTERS)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs, n, length).view(np.int64).ravel()), pa.array(np.repeat(ids, n))], names=["bucket", "doc_id"])

    return reps.select("doc_id", "sketch").mapInArrow(run, "bucket long, doc_id long")


def _find(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sk = np.frombuffer(b"".join(frame["sketch"]), np.uint16).reshape(len(frame), REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in frame["items"]]
        got = links(sk, sets, frame["component"].to_numpy(), frame["is_left"].to_numpy(), percent)
        ids = frame["doc_id"].to_numpy()
        return pd.DataFrame({"a": [ids[i] for i, _ in got], "b": [ids[j] for _, j in got]}, dtype="int64")

    return run


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = 400) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Links join documents whose sets of five-word shingles have a Jaccard similarity of percent/100 or
    more; component_id is the smallest id that is reachable.

    Texts with equal sets are one representative. Representatives that share a band key are
    candidates; connected candidates make a cluster, whose members meet in one task with their full
    sets. Clusters of more than `block` members are cut into blocks by id, then what is not yet in
    the largest component of a bucket meets all other members of that bucket, block by block: all
    pairs of candidates are looked at, however large the cluster, and only a forest of links comes
    out.

    What is lost: a pair that shares no band key (layout(); about 1 in 14,000 at the threshold, fewer above),
    and one of whose registers fewer than half are equal or whose likely similarity is 0.2 or more under the
    limit: at the limit that is 8 and 5 standard deviations of 120 registers away.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Rows with the
    same id are versions of one document: each has its own n_shingles, and the document is linked with all that any of
    them links with, whatever their order. Rows without id are no documents: component_id is null and
    kept is true for them, and they link nothing. Ids are integers. An empty table gives no rows. Other
    columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = written(_sets(rows, False), "near-sketches")
    real = base.where("n > 0 and doc_id is not null")
    same = written(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "near-same")
    reps = real.join(same.withColumnRenamed("rep", "doc_id"), ["doc_id", "f1", "f2", "n"], "left_semi").dropDuplicates(["doc_id", "f1", "f2", "n"])
    # Ids of several rows, which are rare; those of several sets join what their versions stand for.
    sets_of = F.struct("f1", "f2", "n")
    repeats = real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(sets_of).alias("lo"), F.max(sets_of).alias("hi")).where("rows > 1")
    repeats = written(repeats, "near-repeats")
    versions = real.join(repeats.where("lo <> hi").select("doc_id"), "doc_id", "left_semi").join(same, ["f1", "f2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    repeated = not repeats.isEmpty()
    bands = written(_explode_bands(reps, percent), "near-bands")
    # A bucket's members, and of buckets with the same members only one.
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("who")).where("size > 1")
    buckets = buckets.groupBy("size", "first", "who").agg(F.min("bucket").alias("bucket"))
    members = written(bands.join(buckets.select("bucket", "first"), "bucket"), "near-members")
    cluster = components(members.select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "near-clusters")
    cluster = written(cluster.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster").distinct(), "near-cluster")
    chosen = rows.join(cluster.select("doc_id"), "doc_id", "left_semi")
    if repeated:
        chosen = chosen.withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"]).drop("t")
    sets = written(_sets(chosen, True), "near-sets")
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    placed = cluster.join(sizes, "cluster")
    part = F.when(F.col("size") > block, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / block))).otherwise(0).cast("long")
    todo = placed.select("cluster", part.alias("part"), "doc_id", F.col("doc_id").alias("component"), F.lit(True).alias("is_left"))
    find = _find(percent)
    found = todo.join(sets, "doc_id").groupBy("cluster", "part").applyInPandas(find, "a long, b long")
    found = written(found.unionByName(versions) if repeated else found, "near-links")
    label = components(found, "near-labels")
    # Large clusters: members outside their bucket's largest component against the whole bucket.
    large = placed.where(F.col("size") > block).select("doc_id")
    if not large.isEmpty():
        wide = members.join(large, "doc_id").join(label.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        wide = written(wide.select("bucket", "doc_id", "component"), "near-wide")
        by_part = wide.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        most = by_part.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        most = most.select("bucket", F.col("top.component").alias("top"), F.ceil(F.col("size") / block).alias("rights"), F.ceil((F.col("size") - F.col("top.n")) / block).alias("lefts"))
        wide = wide.join(most, "bucket").withColumn("is_left", F.col("component") != F.col("top"))
        slot = lambda c: F.pmod(F.xxhash64("doc_id", F.lit(c)), F.col(c)).cast("long")
        over = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
        keep = ["bucket", "doc_id", "component", "is_left"]
        lefts = wide.where("is_left").select(*keep, slot("lefts").alias("i"), over("rights").alias("j"))
        rights = wide.select(*keep[:3], F.lit(False).alias("is_left"), over("lefts").alias("i"), slot("rights").alias("j"))
        both = lefts.unionByName(rights).groupBy("bucket", "i", "j", "doc_id", "component").agg(F.max("is_left").alias("is_left"))
        more = both.join(sets, "doc_id").groupBy("bucket", "i", "j").applyInPandas(find, "a long, b long")
        found = written(found.unionByName(more).distinct(), "near-links")
        label = components(found, "near-labels")
        dropped(wide)
    dropped(bands, sets)
    out = base.join(same, ["f1", "f2", "n"], "left").join(label.toDF("rep", "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id; similarity 0.8. Rows without id, and texts
    without words, always stay; so do all rows of an id that stays. An empty table stays empty."""
    gone = near_dedup(docs, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
