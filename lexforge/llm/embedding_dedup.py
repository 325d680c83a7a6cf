"""Embedding near-dedup: epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import components, dropped, written

#: Cells are taken on this many principal dimensions; bounding boxes on as many again and more.
CELL_DIMS, BOX_DIMS = 4, 16


def unit(lists: list) -> np.ndarray:
    x = np.array(lists, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine of two vectors from exactly rounded sums."""
    dot = lambda p, q: math.fsum((p * q).tolist())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def distant(lo1, hi1, lo2, hi2, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return bool((gap * gap).sum() > eps * eps)


def join_intervals(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, same: bool, eps: float, least: float, leaf: int = 256):
    """Boolean matrix of the pairs of two intervals in grid order with cosine >= least.

    x and y: unit vectors; u and v: their coordinates on the leading axes. Intervals are halved until they are provably
    distant, by the boxes of their coordinates, or at most `leaf` long. Then the coordinates alone tell most pairs
    apart, whose squared distance there is over that of the limit already; of the rows and columns
    that are left whole cosines are computed, and those within 1e-12 of the limit once more exactly."""
    mask = np.zeros((len(x), len(y)), bool)
    todo = [(0, len(x), 0, len(y))]
    u32, v32 = u.astype(np.float32), v.astype(np.float32)
    su, sv = (u32 * u32).sum(axis=1), (v32 * v32).sum(axis=1)
    limit = np.float32(eps * eps + 1e-4)
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or (same and d <= a):
            continue
        p, q = u[a:b], v[c:d]
        if distant(p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0), eps):
            continue
        if max(b - a, d - c) <= leaf:
            near = su[a:b, None] + sv[None, c:d] - 2 * (u32[a:b] @ v32[c:d].T) <= limit
            if same and a == c:
                np.fill_diagonal(near, False)
            i, j = np.flatnonzero(near.any(axis=1)) + a, np.flatnonzero(near.any(axis=0)) + c
            if len(i):
                cosine = x[i] @ y[j].T
                found = cosine >= least
                for k, m in np.argwhere(np.abs(cosine - least) < 1e-12):
                    found[k, m] = exact_cosine(x[i[k]], y[j[m]]) >= least
                mask[np.ix_(i, j)] = found
            continue
        m = (a + b) // 2 if b - a > leaf else b
        n = (c + d) // 2 if d - c > leaf else d
        todo += [(a, m, c, n), (m, b, c, n), (a, m, n, d), (m, b, n, d)]
    if same:
        mask = np.triu(mask, 1)
        mask |= mask.T
    return mask


def forest(mask: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges that join what the pairs of mask join; columns count on from the rows unless same."""
    n, m = mask.shape
    off = 0 if same else n
    left_r, left_c = np.ones(n, bool), np.ones(m, bool)
    out = []
    for s in np.flatnonzero(mask.any(axis=1)):
        if not left_r[s]:
            continue
        left_r[s] = False
        if same:
            left_c[s] = False
        queue = [int(s)]
        while queue:
            k = queue.pop()
            if same or k < n:
                new = np.flatnonzero(mask[k] & left_c)
                left_c[new] = False
                if same:
                    left_r[new] = False
                new = new + off
            else:
                new = np.flatnonzero(mask[:, k - n] & left_r)
                left_r[new] = False
            out += [(k, int(i)) for i in new]
            queue += new.tolist()
    return out


def embedding_dedup(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1000, sample: int = 20_000, side: int = 6) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least `least`. Vectors that are null,
    empty, zero or hold null or non-finite components, and those without id, link with nothing; vectors of different
    lengths do not link. Rows of one id and one vector are one vector; rows of one id with other vectors are versions of it: the id
    is linked with all that any of them links with, and n_links adds up. Ids are integers. An empty table
    gives no rows. Other columns are ignored.

    Equal vectors are one, with their number as weight, so copies cost nothing. Unit vectors are rotated to
    principal axes, which are fitted on about `sample` vectors, those with the smallest hashes of their ids, and
    only steer the pruning. Cells are as wide as the Euclidean distance eps that `least` stands for.
    Range partitioning by the cells of four leading axes, then by the coordinates, makes intervals of the grid
    order; partitions are cut into blocks of `block` vectors. Blocks meet if the cells of the two
    leading axes are neighbours and their boxes are not provably distant. `side` blocks that follow each other
    travel together: a task has two such runs, and a block comes once to each task that has a partner of it.
    What a task returns is as long as its blocks: link counts, and a forest of links.

    Where vectors have no leading directions, no order keeps distant ones apart: all pairs of blocks meet, and
    the work is the square of the number of distinct vectors, cut to the leading coordinates."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-9
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0))
    # One row for each vector: `same` holds who has it, `weight` how many do.
    bytes_of = F.transform("x", lambda v: v + F.lit(0.0))  # -0.0 is 0.0
    good = good.select("vec_id", bytes_of.alias("x")).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.reverse("x"))})
    people = written(good.select("vec_id", "h1", "h2").distinct(), "emb-people")
    repeats = people.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = not repeats.isEmpty()
    groups = people.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    # A vector is named by its representative's id, unless one id has several vectors.
    name = (F.xxhash64("h1", "h2", "rep") if several else F.col("rep")).alias("vec_id")
    few = good.groupBy("h1", "h2").agg(F.first("x").alias("x")).join(groups, ["h1", "h2"])
    few = written(few.select(name, "weight", "x", "h1", "h2", "rep"), "emb-vectors")
    found = []
    for dim, total in sorted((r["d"], r["n"]) for r in few.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):
        mine = few.where(F.size("x") == dim).select("vec_id", "weight", "x")
        found.append(_join(spark, mine, principal_axes(mine, dim, total, sample), total, eps, least, block, side))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = reduce(DataFrame.unionByName, [c for c, _ in found]).groupBy("vec_id").agg(F.sum("n").alias("n"))
    edges = reduce(DataFrame.unionByName, [e for _, e in found])
    named = few.select("h1", "h2", "rep", "weight", F.col("vec_id").alias("name"))
    if several:  # links between names become links between ids, and those of an id's versions come in
        of = named.select("name", "rep")
        edges = edges.join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        versions = people.join(repeats.select("vec_id"), "vec_id", "left_semi").join(named, ["h1", "h2"]).select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
        edges = edges.unionByName(versions)
    label = components(edges, "emb-labels").toDF("rep", "component")
    each = people.join(named, ["h1", "h2"]).join(counts.withColumnRenamed("vec_id", "name"), "name", "left").join(label, "rep", "left")
    each = each.groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = rows.select("vec_id").join(each, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def principal_axes(vectors: DataFrame, dim: int, total: int, sample: int) -> np.ndarray:
    """Columns: principal axes of about `sample` unit vectors. Tasks add up products, so nothing but sums travels."""
    low = F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 32) - 1)) < min(1 << 32, int(sample / total * (1 << 32)))

    def sums(batches):
        n, first, second = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(0).to_pylist())
                n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim + 1), pa.int32()), "v": pa.array([*second.tolist(), [*first.tolist(), float(n)]])})

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.stack(frame["v"].tolist()), axis=0).tolist()]})

    got = vectors.where(low).select("x").mapInArrow(sums, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").collect()  # dim + 1 rows
    by = {r["i"]: np.array(r["v"]) for r in got}
    if dim not in by or by[dim][-1] < 2:
        return np.eye(dim)
    n, mean = by[dim][-1], by[dim][:-1] / by[dim][-1]
    return np.ascontiguousarray(np.linalg.eigh(np.stack([by[i] for i in range(dim)]) / n - np.outer(mean, mean))[1][:, ::-1])


def _join(spark, good: DataFrame, axes: np.ndarray, total: int, eps: float, least: float, block: int, side: int):
    """(vec_id, n) link counts and (a, b) forest edges of distinct vectors (vec_id, weight, x), both written. Counts
    add up the partners' weights."""
    dim = len(axes)
    lead = min(BOX_DIMS, dim)
    cells, first = [f"c{k}" for k in range(CELL_DIMS)], min(CELL_DIMS, dim)

    def rotate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = unit(part.column(2).to_pylist())
                y = x @ axes[:, :lead]
                c = np.zeros((len(x), CELL_DIMS), np.int32)
                c[:, :first] = np.floor(y[:, :first] / eps)
                y01 = np.zeros((len(x), 2))
                y01[:, : min(2, dim)] = y[:, :2]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c[:, k]) for k in range(CELL_DIMS)), pa.array(y01[:, 0]), pa.array(y01[:, 1]), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "weight", *cells, "y0", "y1", "x"])

    schema = "vec_id long, weight long, " + ", ".join(f"{c} int" for c in cells) + ", y0 double, y1 double, x binary"
    parts = max(1, -(-total // block))
    order = [*cells, "y0", "y1", "vec_id"]
    ranged = good.mapInArrow(rotate, schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def cut(batches):
        held, n, k, part = [], 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                n += held[-1].num_rows
                while n >= block:
                    one = pa.Table.from_batches(held)
                    yield packed(one.slice(0, block), k)
                    held, n, k = one.slice(block).to_batches(), n - block, k + 1
        if n:
            yield packed(pa.Table.from_batches(held), k)

    def packed(t, k):
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(-1, dim)
        box = x @ axes[:, :lead]
        span = [[int(f(t.column(c).to_numpy()))] for c in ("c0", "c1") for f in (np.min, np.max)]
        part = int(t.column("part")[0].as_py())
        row = [[(part << 32) + k], [part // side], *span, [box.min(axis=0).tolist()], [box.max(axis=0).tolist()], [t.column("vec_id").to_numpy().tobytes()], [t.column("weight").to_numpy().tobytes()], [x.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(row, types, strict=True)], names=names)

    names = ["block", "run", "c0", "d0", "c1", "d1", "lo", "hi", "ids", "weights", "x"]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 3]
    blocks = written(ranged.mapInArrow(cut, "block long, run long, c0 int, d0 int, c1 int, d1 int, lo array<double>, hi array<double>, ids binary, weights binary, x binary"), "emb-blocks")
    meta = blocks.select("block", "run", "c0", "d0", "c1", "d1", "lo", "hi")
    near = meta.select("block", F.col("run").alias("i"), "lo", "hi", F.explode(F.sequence(F.col("c0") - 1, F.col("d0") + 1)).alias("u"), "c1", "d1").withColumn("v", F.explode(F.sequence(F.col("c1") - 1, F.col("d1") + 1)))
    own = meta.select(F.col("block").alias("b"), F.col("run").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence("c0", "d0")).alias("u"), "c1", "d1").withColumn("v", F.explode(F.sequence("c1", "d1"))).drop("c1", "d1")
    gap = F.expr("aggregate(zip_with(zip_with(lo, hi2, (p, q) -> greatest(0D, p - q)), zip_with(lo2, hi, (p, q) -> greatest(0D, p - q)), (p, q) -> p * p + q * q), 0D, (s, v) -> s + v)")
    pairs = near.drop("c1", "d1").join(own, ["u", "v"]).where(F.col("block") <= F.col("b")).where(gap <= eps * eps)
    pairs = pairs.select("i", "j", F.col("block").alias("a"), "b")
    ends = pairs.select("i", "j", F.explode(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("end")), F.struct(F.col("b").alias("block"), F.lit(1).alias("end")))).alias("e")).select("i", "j", "e.*").distinct()
    # Within a run both ends are the same blocks.
    ends = ends.groupBy("i", "j", "block").agg(F.max(F.struct(F.when(F.col("i") == F.col("j"), 0).otherwise(F.col("end")).alias("end")))["end"].alias("end"))

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = [(r.block, r.end, np.frombuffer(r.ids, np.int64), np.frombuffer(r.weights, np.int64), x := np.frombuffer(r.x).reshape(-1, dim), x @ axes[:, :lead]) for r in frame.sort_values("block").itertuples()]
        inside = bool(frame["i"].iloc[0] == frame["j"].iloc[0])
        box = [(p[5].min(axis=0), p[5].max(axis=0)) for p in part]
        for k, (a, enda, i, w, x, u) in enumerate(part):
            for m, (b, endb, j, z, y, v) in enumerate(part):
                if (a > b if inside else (enda, endb) != (0, 1)) or distant(*box[k], *box[m], eps):
                    continue
                same = a == b
                mask = join_intervals(x, y, u, v, same, eps, least)
                per = [(i, mask @ z)] if same else [(i, mask @ z), (j, w @ mask)]
                out += [pd.DataFrame({"vec_id": q[c > 0], "other": q[c > 0], "n": c[c > 0]}) for q, c in per]
                ids = i if same else np.concatenate([i, j])
                if e := forest(mask, same):
                    p = np.array(e)
                    out.append(pd.DataFrame({"vec_id": ids[p[:, 0]], "other": ids[p[:, 1]], "n": 0}))
        return pd.concat(out).astype("int64") if out else pd.DataFrame({"vec_id": [], "other": [], "n": []}, dtype="int64")

    found = ends.join(blocks.select("block", "ids", "weights", "x"), "block").groupBy("i", "j").applyInPandas(find, "vec_id long, other long, n long")
    found = written(found, "emb-found")
    dropped(blocks)
    return found.where("n > 0").select("vec_id", "n"), found.where("n = 0").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN (SELECT node, min(other) AS component_id FROM r GROUP BY node) c ON c.node = e.vec_id
"""
