"""Line dedup: deletion-neighbourhood join at edit distance 1, earliest line kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.bpe import text_runs
from lexforge.llm.common import dropped, mix64, written
from lexforge.llm.decontamination import wanted

U = np.uint64
SEGMENTS = 8
_SIGN, _PLACE, _PART = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


class Signs:
    """The signs of many lines in one array, with running sums of 64-bit hashes of (sign, place).

    own: places as in the line; back: places one less, as if a sign before were missing. So the hash of a
    line without any of its signs, and that of any start and end, is a difference of sums: the whole
    deletion neighbourhood of a line of n signs takes n steps."""

    def __init__(self, lines: list[str]):
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.at = np.cumsum(self.size) - self.size
        sign = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) * _SIGN
        place = (np.arange(len(sign)) - np.repeat(self.at, self.size)).astype(np.uint64)
        self.own, self.back = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sign + p * _PLACE), dtype=np.uint64)]) for p in (place, place - U(1)))

    def without(self, line: np.ndarray, place: np.ndarray, moved: bool) -> np.ndarray:
        """Hash of a line without the sign at a place; moved: what follows moves up by one."""
        first, end = self.at[line], self.at[line] + self.size[line]
        p = first + place
        sums = self.back if moved else self.own
        return self.own[p] - self.own[first] + sums[end] - sums[p + 1]

    def whole(self, line: np.ndarray) -> np.ndarray:
        return self.own[self.at[line] + self.size[line]] - self.own[self.at[line]]


def _key(kind: int, h: np.ndarray, *parts) -> np.ndarray:
    h = mix64(h + np.full(1, kind + 1, np.uint64) * _PART)
    for p in parts:
        h = mix64(h + p.astype(np.uint64) * _PLACE + U(1))
    return h.view(np.int64)


def segment_keys(lines: list[str], sides: np.ndarray | None = None):
    """(line, key, base, segment): a key for all but one segment of each line, cut as a line of base signs.
    sides: bit 2 less + side of a line says that its start (side 0) or end (1), cut as a line of `less` signs less, is another line's too;
    then an edit can only be in the segments of the other side, and these alone get keys.
    Two lines within one edit have the same key for the segment that holds the edit. base: the length of
    the shorter line of a pair that a line may be in, its own or one less."""
    s = Signs(lines)
    each = np.arange(len(lines))
    for less in (0, 1):
        line = np.repeat(each[s.size >= less], SEGMENTS)
        part = np.tile(np.arange(SEGMENTS), int((s.size >= less).sum()))
        if sides is not None:
            some = (sides[line] >> (2 * less + (part < SEGMENTS // 2)) & 1) == 1
            line, part = line[some], part[some]
        base = s.size[line] - less
        first, last = base * part // SEGMENTS, base * (part + 1) // SEGMENTS
        a, end = s.at[line], s.at[line] + s.size[line]
        tail = s.back if less else s.own
        h = s.own[a + first] - s.own[a] + tail[end] - tail[a + last + less]
        yield line, _key(0, h, base, part), base, part


def variants(lines: list[str], base: np.ndarray, segment: np.ndarray):
    """(line, key, role): each line's deletion neighbourhood within a segment.

    Role 0: the line without the sign at a place, keyed with the place, so equal keys are one
    substitution apart; 1: the whole line, as the shorter one; 2: the line without a sign, as the longer
    one; equal keys of roles 1 and 2 are one deletion apart."""
    s = Signs(lines)
    first, last = base * segment // SEGMENTS, base * (segment + 1) // SEGMENTS
    for role in (0, 2):
        line = np.flatnonzero(s.size == base + role // 2)
        count = last[line] - first[line] + role // 2
        at = np.repeat(line, count)
        place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + first[at]
        if role == 0:
            yield at, _key(1, s.without(at, place, False), base[at], place), 0
            yield line, _key(2, s.whole(line), base[line]), 1
        else:
            yield at, _key(2, s.without(at, place, True), base[at]), 2


def within_one_edit(a: str, b: str) -> bool:
    """In steps in proportion to the lines, where a table of distances takes the square."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same, size = 0, len(a)  # a[:same] == b[:same], and they differ before same + size + 1
    while size:
        half = (size + 1) // 2
        if a[same : same + half] == b[same : same + half]:
            same, size = same + half, size - half
        else:
            size = half - 1
    return a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else a[same:] == b[same + 1 :]


def place_of(id_col: str, text_col: str) -> Column:
    """Sorts rows: those without id last, then by id; rows that repeat an id by a hash of their text."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))


def _h(line: str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), F.reverse(line)).alias("h2")


def passing(rows: DataFrame, some: DataFrame) -> DataFrame:
    """rows (row, ...) without most of those whose row is not in some (row), by a Bloom filter of the rows' hashes: what it stops
    is never shuffled. All rows of some pass, so a join is to tell them from the others."""
    held = rows.sparkSession.sparkContext.broadcast(wanted(some.select(F.xxhash64("row").alias("key")).distinct()))

    @F.pandas_udf("boolean")
    def hit(key: pd.Series) -> pd.Series:
        return pd.Series(held.value.hits(key.to_numpy(np.int64).view(np.uint64)))

    return rows.where(hit(F.xxhash64("row")))


def dropped_lines(docs: DataFrame, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, line_no): lines of at least least_chars signs that an earlier line, by row and place,
    equals or comes within one inserted, deleted or replaced sign of; and shorter lines that an
    earlier line equals, unless they are blank. Lines end at line feeds; row is place_of().

    128-bit hashes stand for lines in every shuffle. Distinct lines meet by hashes of their halves; one
    edit leaves a half as it is, so lines alone with both halves have no partner. Of the others
    the texts are fetched, past a filter that stops most other rows, equal keys for all but an eighth of a line, out of the half that is not shared, narrow the place of the edit,
    and the deletion neighbourhood is emitted for that eighth. Per key only the earliest line of
    each role is kept, so a bucket of any size is one row, and lines join that row; the edit
    distance of the two lines is then verified. A line goes if any earlier line is that near, kept or not."""
    rows = docs.select(place_of(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    lines = rows.select("row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    n = F.length("line")
    lines = lines.where((n >= least_chars) | F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    half = lambda less, side: F.xxhash64(n - less, F.lit(side), F.left("line", F.floor((n - less) / 2).cast("int")) if side == 0 else F.right("line", F.floor((n - less) / 2).cast("int")))
    halves = F.when(n >= least_chars, F.array(half(0, 0), half(0, 1), half(1, 0), half(1, 1)))
    hashed = written(lines.select("row", "line_no", *_h("line"), halves.alias("halves")), "line-hashes")
    where = F.struct("row", "line_no")
    distinct = hashed.groupBy("h1", "h2").agg(F.min(where).alias("at"), F.first("halves").alias("halves"))
    distinct = written(distinct, "line-distinct")
    later = hashed.join(distinct.select("h1", "h2", "at"), ["h1", "h2"]).where(where != F.col("at")).select("row", "line_no")
    halves = distinct.select("h1", F.posexplode("halves").alias("which", "half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    some = halves.join(shared, "half", "left_semi").groupBy("h1").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("which"))).alias("sides"))
    some = distinct.join(some, "h1").select("h1", "h2", F.col("at.row").alias("row"), "at", "sides").dropDuplicates(["h1", "h2"])
    some = written(some, "line-halves")  # read twice with other columns, which would take the halves through two shuffles
    holders = passing(rows, some).join(some.select("row").distinct(), "row", "left_semi")
    found = holders.select(F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select("line", *_h("line"))
    found = written(found.dropDuplicates(["h1", "h2"]).join(some.drop("row"), ["h1", "h2"]), "line-texts")

    def segments(batches):
        for batch in batches:
            for a, b in text_runs(batch.column(0)):
                part = batch.slice(a, b - a)
                h1, h2 = part.column(1), part.column(2)
                for line, key, base, segment in segment_keys(part.column(0).to_pylist(), part.column(3).to_numpy()):
                    at = pa.array(line)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(base), pa.array(segment), h1.take(at), h2.take(at)], names=["key", "base", "segment", "h1", "h2"])

    keys = written(found.select("line", "h1", "h2", "sides").mapInArrow(segments, "key long, base long, segment long, h1 long, h2 long"), "line-segments")
    multi = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    narrowed = keys.join(multi, "key", "left_semi").select("h1", "h2", "base", "segment").distinct()

    def emit(batches):
        for batch in batches:
            for a, b in text_runs(batch.column(0)):
                part = batch.slice(a, b - a)
                base, segment, h1, h2 = (part.column(i) for i in range(1, 5))
                for line, key, role in variants(part.column(0).to_pylist(), base.to_numpy(), segment.to_numpy()):
                    for k in range(0, len(line), 500_000):
                        at = pa.array(line[k : k + 500_000])
                        yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 500_000]), pa.array(np.full(len(at), role)), h1.take(at), h2.take(at)], names=["key", "role", "h1", "h2"])

    near = found.join(narrowed, ["h1", "h2"]).select("line", "base", "segment", "h1", "h2")
    emitted = written(near.mapInArrow(emit, "key long, role long, h1 long, h2 long").distinct(), "line-variants")
    dropped(keys)
    near = emitted.join(found.select("h1", "h2", F.struct("at", "h1", "h2").alias("me")), ["h1", "h2"])
    first = near.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("me"))).alias(f"m{r}") for r in (0, 1, 2)])
    partner = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = near.join(first, "key").select("h1", "h2", "me", partner.alias("p")).where(F.col("p") < F.col("me")).select("h1", "h2", F.col("p.h1").alias("p1"), F.col("p.h2").alias("p2")).distinct()
    text = found.select("h1", "h2", "line")
    pairs = pairs.join(text, ["h1", "h2"]).join(text.toDF("p1", "p2", "other"), ["p1", "p2"])

    def verify(batches):
        for batch in batches:
            near = [within_one_edit(a.as_py(), b.as_py()) for a, b in zip(batch.column(0), batch.column(1), strict=True)]
            yield batch.select([2, 3]).filter(pa.array(near, pa.bool_()))

    gone = pairs.select("line", "other", "h1", "h2").mapInArrow(verify, "h1 long, h2 long").distinct()
    near_gone = hashed.join(gone, ["h1", "h2"], "left_semi").select("row", "line_no")
    out = written(later.unionByName(near_gone).distinct(), "line-dropped")
    dropped(hashed, distinct, some, found, emitted)  # the texts are shuffled next, and these tables are as large
    return out


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "_lines", dropped_col: str = "_dropped") -> DataFrame:
    """docs with the lines of gone (row, line_no) taken out of the text; lines_col and dropped_col count."""
    names, taken = {}, {*docs.columns, lines_col, dropped_col}
    for c in ("row", "gone"):  # names that docs does not have
        while c in taken:
            c += "_"
        names[len(names)] = c
        taken.add(c)
    row, out_of = names[0], names[1]
    per = gone.groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(out_of))
    text = f"`{text_col}`"
    keep = f"array_except(sequence(0, size(l) - 1), `{out_of}`)"
    kept = F.expr(f"transform(array(split({text}, '\\n', -1)), l -> array_join(transform({keep}, i -> l[i]), '\\n'))[0]")
    out = docs.withColumn(row, place_of(id_col, text_col)).join(per, row, "left")
    out = out.withColumns({lines_col: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n", -1))), dropped_col: F.coalesce(F.size(out_of), F.lit(0))})
    return out.withColumn(text_col, F.when(F.col(out_of).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns, lines_col, dropped_col)


def line_dedup(docs: DataFrame, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines of dropped_lines(), plus the counts _lines and _dropped.

    A null text stays null, an empty one empty; a text all of whose lines go becomes empty.
    Rows with the same id and text are one document and lose the same lines; rows with the same id and
    other texts are documents of their own, in an order that hangs on their texts only. Rows
    without id come after all others, rows without id and with the same text are one document. Ids may
    be of any type that sorts. An empty table gives no rows. Columns of docs stay as they are, whatever
    their names but _lines and _dropped, which must be free."""
    return without_lines(docs, dropped_lines(docs, least_chars, id_col, text_col), id_col, text_col)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: Pairs within one edit share the start or the end of a line cut as one of the shorter line's length; then the first place where they differ decides.
OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
u AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS nth FROM l WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT doc_id, line_no, line, length(line) AS n FROM u WHERE nth = 1 AND length(line) >= 20),
k AS (SELECT d.*, n - b AS base, s, CASE s WHEN 0 THEN left(line, (n - b) // 2) ELSE right(line, (n - b) // 2) END AS half FROM d, (VALUES (0), (1)) AS x(b), (VALUES (0), (1)) AS y(s)),
p AS (SELECT DISTINCT a.line AS a, b.line AS b FROM k a JOIN k b ON a.base = b.base AND a.s = b.s AND a.half = b.half AND (a.doc_id, a.line_no) < (b.doc_id, b.line_no)),
q AS (SELECT b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM p),
r AS (SELECT *, coalesce(list_position(list_transform(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1)), true), length(x) + 1) AS f FROM q),
g AS (SELECT DISTINCT b AS line FROM r WHERE CASE WHEN length(x) = length(y) THEN substr(x, f + 1) = substr(y, f + 1) ELSE substr(x, f) = substr(y, f + 1) END),
o AS (SELECT u.doc_id, u.line_no FROM u LEFT JOIN g ON u.line = g.line WHERE u.nth > 1 OR g.line IS NOT NULL),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(o.line_no) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE o.line_no IS NULL), '') AS text FROM l LEFT JOIN o ON l.doc_id = o.doc_id AND l.line_no = o.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(coalesce(t.text, '')) AS n_chars, sha256(coalesce(t.text, '')) AS text_sha256 FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; documents of which nothing is left go, and those that had no text stay.
    Null and repeated ids as in line_dedup(); an empty table stays empty; n_chars is kept in step with the text."""
    got = line_dedup(docs)
    left = (F.col("_dropped") == 0) | (F.length(F.trim(F.translate("text", "\n\t\r", "   "))) > 0)
    return got.where(left).withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)
