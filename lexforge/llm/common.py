"""Shared pieces: intermediate tables, packed word hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every text operator here: maximal runs without these six bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a local session gets a folder of its own;
    on a cluster that would be another disk for every machine, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="lexforge-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


#: Paths of written() that still stand, for drop_written().
_standing: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _standing.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexforge_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    if path in _standing:
        _standing.remove(path)


def drop_written(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that operators have written, from the since-th on: to be called when their
    results have been used or stored. An operator's result reads from some of its tables."""
    for path in _standing[since:]:
        delete(spark, path)


def standing() -> int:
    return len(_standing)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read any more."""
    for t in tables:
        path = getattr(t, "_lexforge_path", None)
        if path:
            delete(t.sparkSession, path)


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def crc_fold_py(doc_id, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


# --- words as 64-bit hashes -------------------------------------------------

_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE = 1 << 19
#: The first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LANE = _U(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def lane_hashes(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges st[i]:en[i] of buf, none of them empty.

    Every eight bytes are mixed with their place before they are added up, so words are not linear
    in their bytes, and words built to collide in polynomial hashes stay apart."""
    size = en - st
    lanes = (size + 7) >> 3
    last = np.cumsum(lanes)
    first = last - lanes
    many = len(st) != last[-1]
    k = np.arange(last[-1]) - np.repeat(first, lanes) if many else np.zeros(len(st), np.int64)
    at = (np.repeat(st, lanes) if many else st) + 8 * k
    left = np.minimum((np.repeat(en, lanes) if many else en) - at, 8)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    v = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))[at] & _FIRST[left]  # eight bytes from any place
    v = mix64(mix64(v) + (k.astype(np.uint64) + _U(1)) * _LANE)
    if many:
        v = np.add.reduceat(v, first)
    return mix64(v + size.astype(np.uint64))


def word_hashes(buf: np.ndarray, apart: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a byte array, A-Z taken as a-z. apart: which bytes are in no word.

    Works through slices that end at white space, so temporary arrays stay small."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + _SLICE)
        while to < n and not apart[buf[to]]:  # to the end of the word that is cut
            more = np.flatnonzero(apart[buf[to : to + 4096]])
            to = to + int(more[0]) if len(more) else min(n, to + 4096)
        b = _LOWER[buf[at:to]]
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~apart[b]
        step = np.diff(inside)
        st, en = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(st):
            hashes.append(lane_hashes(b, st, en))
            starts.append(st + at)
            ends.append(en + at)
        at = to
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def text_slices(texts: list, most: int = 1 << 20):
    """(first, last, joined bytes, starts of texts): texts in runs of about `most` bytes, with a line feed between."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else (t or b"")
        if held and size + len(b) > most:
            yield _joined(first, i, held)
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield _joined(first, len(texts), held)


def _joined(first: int, last: int, held: list[bytes]):
    lengths = np.fromiter((len(b) + 1 for b in held), np.int64, len(held))
    return first, last, np.frombuffer(b"\n".join(held), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def doc_words(texts: list, most: int = 1 << 20, apart: np.ndarray = _SEP):
    """(first, last, bounds, hashes, starts, ends, bytes): the words of texts[i] are hashes[bounds[i-first]:bounds[i-first+1]]."""
    for first, last, buf, at in text_slices(texts, most):
        st, en, h = word_hashes(buf, apart)
        yield first, last, np.searchsorted(st, at), h, st, en, buf


# --- connected components ----------------------------------------------------


def components(edges: DataFrame, name: str = "components", jumps: int = 3) -> DataFrame:
    """(node, component): the smallest node that is reachable; edges has columns a and b of longs.

    Each round every node takes the smallest of itself and its neighbours, follows that pointer
    a few times, and edges are contracted to the nodes pointed to. At least half of the
    connected nodes go in a round. Every round is a written table; nothing is collected but
    whether edges are left."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    label = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("v", "w")
        up = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        up = written(up, name)
        for _ in range(jumps):
            over = up.select(F.col("v").alias("m"), F.col("m").alias("m2"))
            new = written(up.join(over, "m").select("v", F.col("m2").alias("m")), name)
            dropped(up)
            up = new
        if label is None:
            new_label = up.select(F.col("v").alias("node"), F.col("m").alias("component"))
        else:
            new_label = label.join(up.withColumnRenamed("v", "component"), "component", "left").select(
                "node", F.coalesce("m", "component").alias("component")
            )
        new_label = written(new_label, name)
        left = edges.join(up.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a")
        left = left.join(up.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b").where("ma <> mb")
        left = written(left.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), name)
        dropped(edges, up, *([label] if label is not None else []))
        label, edges = new_label, left
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


class Forest:
    """Union-find over 0..n-1 within a task; the smaller root wins."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            new = up[up]
            if np.array_equal(new, up):
                return up
            up = new
