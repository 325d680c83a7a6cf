"""Benchmark decontamination: prefix-filtered join of item windows with documents, verified word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.bpe import text_runs
from lexforge.llm.common import doc_words, dropped, mix64, written

U = np.uint64
#: Between words; and the bytes that are in none, once A-Z are a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_APART = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _APART[_first : _last + 1] = False
_ODD = U(0x9E3779B97F4A7C15)
#: The filter of wanted shingles has a 64-bit slot for each, but 2^21 at most: 16 MB.
MOST_SLOTS = 1 << 21
#: Tables of items with this many rows at most are broadcast in joins, some 30 MB; longer ones are shuffled, in SALTS copies.
MOST_BROADCAST = 200_000
SALTS = 16


def words(text: Column) -> Column:
    """The words of a text, A-Z taken as a-z; none for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, GAP), lambda w: w != "")


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each `size` words that follow each other, from the words' hashes."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _ODD + h[k : k + n]
        return mix64(out + U(size))


class Wanted:
    """A blocked Bloom filter: a shingle sets four bits of one slot. Whatever its size, it lets all wanted ones pass."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.shift = U(64 - (len(slots).bit_length() - 1))

    @staticmethod
    def place(n: int) -> int:
        """How many bits of a hash name the slot, for n shingles."""
        return max(10, min(MOST_SLOTS.bit_length() - 1, max(1, n - 1).bit_length()))

    def hits(self, key: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(key), np.uint64)
        for k in range(4):
            mask |= U(1) << (key >> U(6 * k) & U(63))
        return self.slots[(key >> self.shift).astype(np.int64)] & mask == mask


def wanted(keys: DataFrame) -> Wanted:
    """The filter of the distinct longs `key`; tasks set the bits, the driver gets a row for each slot, MOST_SLOTS at most."""
    place = Wanted.place(keys.count())
    bit = lambda k: F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {6 * k}) & 63 AS INT))")
    rows = keys.select(F.expr(f"shiftrightunsigned(key, {64 - place})").alias("slot"), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3)).alias("bits"))
    got = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    slots = np.zeros(1 << place, np.uint64)
    slots[got["slot"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Wanted(slots)


def item_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(win, size, item_id) for each item's windows, and (win, size) once each. win: the window's words with blanks between."""
    w = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    of = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("w"))
    of = of.select(F.array_join("w", " ").alias("win"), F.size("w").alias("size"), "item_id").distinct()
    return of, of.select("win", "size").distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(key, win, size, off): each window's shingles, of all its words if these are fewer."""

    def run(batches):
        for batch in batches:
            held = []
            for win, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (_, _, _, h, *_), *_ = doc_words([win], apart=_APART)
                held += [(int(k), win, size, off) for off, k in enumerate(shingle_hashes(h, min(shingle, size)).view(np.int64))]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["key", "win", "size", "off"])

    return windows.mapInArrow(run, "key long, win string, size int, off int")


def _found(texts: list, held: Wanted, sizes: list[int]):
    """(first, last, bounds, starts, ends, bytes, places and keys of wanted shingles) of runs of texts."""
    for first, last, bounds, h, st, en, buf in doc_words(texts, apart=_APART):
        bounds = np.asarray(bounds)
        of = np.repeat(np.arange(last - first), np.diff(bounds))
        at, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size in sizes:
            k = shingle_hashes(h, size)
            p = np.flatnonzero(held.hits(k))
            p = p[of[p] == of[p + size - 1]]  # of one text
            at.append(p)
            key.append(k[p])
        yield first, last, bounds, of, st, en, buf, np.concatenate(at), np.concatenate(key)


def shingle_counts(docs: DataFrame, text_col: str, keys: Wanted, sizes: list[int]) -> DataFrame:
    """(key, n): how often shingles that pass the filter occur in all texts. Tasks add up their own."""
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        mine: list[np.ndarray] = []
        size = 0

        def out():
            key, n = np.unique(np.concatenate(mine), return_counts=True)
            return pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            for a, b in text_runs(batch.column(0)):
                for *_, key in _found(batch.column(0).slice(a, b - a).to_pylist(), held.value, sizes):
                    mine.append(key)
                    size += len(key)
                    if size > 1 << 20:
                        yield out()
                        mine, size = [], 0
        if size:
            yield out()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, id_col: str, text_col: str, keys: Wanted, sizes: list[int], before: int, after: int) -> DataFrame:
    """A row for each document (row, doc_id, n_words; key null), and one for each place of a wanted shingle: key, the place,
    and the words from `before` words before it to `after` words after its start, as far as the text goes."""
    held = docs.sparkSession.sparkContext.broadcast(keys)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in text_runs(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                for first, last, bounds, of, st, en, buf, at, key in _found(batch.column(1).slice(a, b - a).to_pylist(), held.value, sizes):
                    many = last - first
                    none = lambda t: pa.nulls(many, t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(many)), ids.slice(first, many), pa.array(np.diff(bounds)), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.string())], names=names)
                    for c in range(0, len(at), 8192):
                        p = at[c : c + 8192]
                        doc = of[p]
                        lo, hi = np.maximum(p - before, bounds[doc]), np.minimum(p + after, bounds[doc + 1])
                        near = [b" ".join(buf[st[i] : en[i]].tobytes() for i in range(x, y)).lower() for x, y in zip(lo, hi, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(row + doc), pa.nulls(len(p), ids.type), pa.nulls(len(p), pa.int64()), pa.array(key[c : c + 8192].view(np.int64)), pa.array(p - bounds[doc]), pa.array(p - lo), pa.array(near, pa.binary()).cast(pa.string())], names=names)
                    row += many

    names = ["row", "doc_id", "n_words", "key", "at", "lead", "near"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_words long, key long, at long, lead long, near string")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], n: int, most: int = MOST_BROADCAST) -> DataFrame:
    """left joined with `right` of n rows: broadcast up to `most`; beyond, both are shuffled, and left's rows of a key go to
    SALTS partitions by their place, each of which gets right's rows."""
    if n <= most:
        return left.join(F.broadcast(right), on)
    left = left.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, hits), all from one written scan.

    documents: row, doc_id, n_words, n_hit, n_items, items (their ids joined by commas). spans: row, start, size of each
    window that occurs, in words. hits: row, item_id. `row` names a row of docs.

    A window is `window` words of an item that follow each other, or all of them if there are fewer. Its shingles are ordered by how often they
    occur in all documents; as all of them must occur, the rarest is the prefix that is joined, and windows with one that never
    occurs go. A place where the shingle would stand with less room before or after it than the window needs is no candidate, and what is left is compared word
    by word. Documents are read twice, once to count and once to find; only what passes a filter of the wanted shingles
    is shuffled. Null and empty texts have no words; items without words have no windows; rows that repeat
    an id are documents of their own; rows of one item id are one item; a null item id is an empty one. No items: nothing is hit; no
    documents: no rows. Other columns are ignored."""
    spark = docs.sparkSession
    of, windows = item_windows(items, window, item_col, item_text)
    of = written(of, "decon-windows")
    parts = written(window_shingles(of.select("win", "size").distinct(), shingle), "decon-shingles")
    sizes = sorted({min(shingle, r["size"]) for r in of.select("size").distinct().collect()})  # `window` rows at most
    counts = shingle_counts(docs, text_col, wanted(parts.select("key").distinct()), sizes)
    rare = parts.join(counts, "key").groupBy("win", "size").agg(F.countDistinct("off").alias("there"), F.min(F.struct("n", "key", "off")).alias("r"))
    rare = written(rare.where(F.col("there") == F.col("size") - F.least(F.lit(shingle), "size") + 1).select("win", "size", "r.key", "r.off"), "decon-prefixes")
    found = written(occurrences(docs, id_col, text_col, wanted(rare.select("key").distinct()), sizes, window - 1, window), "decon-places")
    dropped(parts)
    room = (F.col("lead") >= F.col("off")) & (F.col("at") >= F.col("off"))
    same = F.array_join(F.slice(F.split("near", " "), (F.col("lead") - F.col("off") + 1).cast("int"), F.col("size")), " ") == F.col("win")
    places = found.where("key is not null").select("row", "key", "at", "lead", "near")
    hit = checked_join(places, rare, ["key"], rare.count(), most).where(room).where(same)
    hit = written(hit.select("row", (F.col("at") - F.col("off")).alias("start"), "size", "win").distinct(), "decon-hits")
    spans = hit.select("row", "start", F.col("size").cast("long").alias("size"))
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("start") + F.col("size")).over(before), F.lit(0))
    n_hit = spans.select("row", F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", reached)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    hits = checked_join(hit.select("row", "win").distinct(), of.select("win", "item_id"), ["win"], of.count(), most).select("row", "item_id").distinct()
    each = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    out = found.where("key is null").select("row", "doc_id", "n_words").join(n_hit, "row", "left").join(each, "row", "left")
    out = out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"))
    return out, spans, hits


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows, _, _ = decontaminate(table("documents"), table("benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[s + 1:s + l], ' ') AS g FROM (SELECT *, unnest(range(len(w) - l + 1)) AS s FROM b)),
places AS (SELECT doc_id, l, s, array_to_string(w[s + 1:s + l], ' ') AS g FROM (SELECT d.*, x.l, unnest(range(len(w) - x.l + 1)) AS s FROM d JOIN (SELECT DISTINCT l FROM win) x ON len(d.w) >= x.l)),
hit AS (SELECT p.doc_id, p.l, p.s, win.item_id FROM places p JOIN win ON p.l = win.l AND p.g = win.g),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
