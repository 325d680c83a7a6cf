"""Fill in the middle: distinct texts with Elias-Fano lists of their token ends, cut for each document by its seed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.common import dropped, written

#: Prefix, suffix, middle.
SIGNS = ("<P>", "<S>", "<M>")
#: Hot texts are split until a part has this share of all texts at most, so there are as many hot texts at most.
SHARES = 4096
#: A part smaller than this many signs is never split.
LEAST_PART = 1 << 22
#: What a task holds of its output, in signs.
HELD = 1 << 22
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def token_ends(text: str) -> np.ndarray:
    """Code points up to the end of each token: white space and the word after it, or the white space that is left."""
    sign = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(sign):
        return np.zeros(0, np.int64)
    space = (sign == 32) | ((sign >= 9) & (sign <= 13))
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True
    return np.flatnonzero(last) + 1


class EliasFano:
    """Rising numbers up to `most`: low bits as they are, high bits as distances in unary. Two bits and the
    low ones for each number, and one count for 512 bits, so any number is found without unpacking the rest."""

    BLOCK = 64

    def __init__(self, numbers: np.ndarray, most: int):
        self.n = len(numbers)
        self.low = max(0, (most // max(1, self.n)).bit_length() - 1)
        upper = np.zeros((most >> self.low) + self.n + 1, np.uint8)
        upper[(numbers >> self.low) + np.arange(self.n)] = 1
        self.upper = np.packbits(upper, bitorder="little")
        low = np.zeros(self.n * self.low, np.uint8)
        for k in range(self.low):
            low[k :: self.low] = numbers >> k & 1
        self.lower = np.packbits(low, bitorder="little")
        ones = np.add.reduceat(_ONES[self.upper], np.arange(0, len(self.upper), self.BLOCK))
        self.before = np.cumsum(ones) - ones

    def __getitem__(self, k: int) -> int:
        block = int(np.searchsorted(self.before, k, "right")) - 1
        at = block * self.BLOCK
        bits = np.unpackbits(self.upper[at : at + self.BLOCK], bitorder="little")
        high = 8 * at + int(np.flatnonzero(bits)[k - self.before[block]]) - k
        first = k * self.low
        bits = np.unpackbits(self.lower[first >> 3 : (first + self.low + 7) >> 3], bitorder="little")[first & 7 : (first & 7) + self.low]
        return (high << self.low) + sum(int(b) << i for i, b in enumerate(bits))


class Cutter:
    """One distinct text: its token ends once, then a cut for each document that has it."""

    def __init__(self, text: str, signs: tuple[str, str, str] = SIGNS):
        self.text, self.signs = text, signs
        ends = token_ends(text)
        self.n = len(ends)
        self.ends = EliasFano(ends, len(text))
        self.plain = not text or any(s in text for s in signs)

    def end(self, units: int) -> int:
        return self.ends[units - 1] if units else 0

    def cut(self, doc_id, seed: int, rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
        """(form, prefix_chars, middle_chars, output) of a document."""
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        h = [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]
        if self.plain or h[2] % 100 >= rate:
            return "plain", None, None, self.text
        a, b = sorted((h[0] % (self.n + 1), h[1] % (self.n + 1)))
        a, b = self.end(a), self.end(b)
        pre, mid, suf = self.text[:a], self.text[a:b], self.text[b:]
        p, s, m = self.signs
        if h[3] % 100 < spm:
            return "spm", a, b - a, f"{s}{suf}{p}{pre}{m}{mid}"
        return "psm", a, b - a, f"{p}{pre}{s}{suf}{m}{mid}"


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, ids): each distinct text once, with the documents that have it; null counts as empty.

    Rows are grouped by the text itself, its hash only comes first; tasks group their own rows before the shuffle, so a text
    comes once from each. Texts that with all their copies are more than one in SHARES of all signs come in as many parts as bring them under that, so no list of ids
    grows with the input past it; there can be SHARES such texts at most, which is what is broadcast."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    weights = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") + 64).alias("w")), "fim-weights")
    limit = max(LEAST_PART, -(-(weights.agg(F.sum("w")).first()[0] or 0) // SHARES))
    hot = weights.where((F.col("n") > 1) & (F.col("w") > limit)).select("h", F.least("n", F.ceil(F.col("w") / limit)).alias("parts"))
    hot = hot.collect()  # SHARES rows at most
    dropped(weights)
    spread = rows.withColumn("part", F.lit(0).cast("long"))
    if hot:
        few = docs.sparkSession.createDataFrame(hot, "h long, parts long")
        spread = rows.join(F.broadcast(few), "h", "left").withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)))
    return spread.groupBy("h", "part", "text").agg(F.collect_list(F.struct("doc_id")).alias("ids")).select("text", "ids")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, signs: tuple[str, str, str] = SIGNS) -> DataFrame:
    """One row per row of docs: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    A document's cuts come from the sha256 of seed and id. `rate` of 100 documents are cut, `spm` of 100 of these with the
    suffix first. Null texts are empty; empty texts, and those that hold one of the signs, stay plain. Rows that
    repeat an id and a text are cut alike, each by itself; one id's other texts are cut by the same numbers; a null id counts as an empty one. Other
    columns are ignored, an empty table gives no rows.

    All texts are shuffled once, copies met in a task as one. A distinct text's token ends are found once and held as an Elias-Fano list, from
    which each of its documents takes two."""
    index = distinct_texts(docs, id_col, text_col)
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(*f) for f in fields]])
    names, kinds = schema.names, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            kind = ids.type.value_type.field(0).type
            held, size = [], 0
            for i, text in enumerate(batch.column(0)):
                cutter = Cutter(text.as_py(), signs)
                for one in ids[i].as_py():
                    held.append((one["doc_id"], cutter.n, *cutter.cut(one["doc_id"], seed, rate, spm)))
                    size += len(cutter.text) + 64
                    if size >= HELD:
                        yield _batch(held, kind)
                        held, size = [], 0
            if held:
                yield _batch(held, kind)

    def _batch(held, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), [kind, *kinds], strict=True)], names=names)

    return index.mapInArrow(run, schema)


def restored(output: Column, form: Column, signs: tuple[str, str, str] = SIGNS) -> Column:
    """The text that an output was made from. No sign occurs in a text that was cut."""
    p, s, m = map(F.lit, signs)
    head = F.split_part(output, m, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    psm = F.concat(F.substring(F.split_part(head, s, F.lit(1)), len(signs[0]) + 1, 2**31 - 1), middle, F.split_part(head, s, F.lit(2)))
    spm = F.concat(F.split_part(head, p, F.lit(2)), middle, F.substring(F.split_part(head, p, F.lit(1)), len(signs[1]) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
