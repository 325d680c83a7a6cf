"""Exact dedup: 128-bit content hashes, smallest stable id kept, bytes compared inside groups.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import SPACE_CLASS, written


def normalised(text) -> F.Column:
    """Null counts as empty; runs of white space become one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_cols=None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts have the same bytes; the smallest id stays.
    Only 16-byte hashes of all rows are shuffled. Texts are shuffled only for rows whose hash
    occurs twice or more, and then grouped by the text itself, which map-side aggregation does
    before the shuffle: copies of a hot text meet as one row per task. Hashes that stand for
    several texts are resolved by a join on the text.

    Null texts and empty texts are equal to each other. Rows that repeat an id and its text get
    the same flags; a null id is smaller than none and never kept unless all ids are null.
    Other columns of docs are ignored. hash_cols (for tests) replaces the two hash columns,
    given the normalised text."""
    make = hash_cols or (lambda t: (F.xxhash64(F.lit(1), t), F.xxhash64(F.lit(2), F.reverse(t))))
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    h1, h2 = make(F.col("norm"))
    hashed = texts.select("doc_id", h1.alias("h1"), h2.alias("h2"), F.sha2("norm", 256).alias("text_sha256"))
    hashed = written(hashed, "exact-hashes")
    groups = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    multi = groups.where("group_size > 1").select("h1", "h2")
    same = texts.select("doc_id", "norm", h1.alias("h1"), h2.alias("h2")).join(multi, ["h1", "h2"], "left_semi")
    same = same.groupBy("h1", "h2", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    same = written(same.select("h1", "h2", F.sha2("norm", 256).alias("text_sha256"), F.length("norm").alias("chars"), "keep_id", "group_size"), "exact-groups")
    mixed = same.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h1", "h2")
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if mixed.isEmpty():
        single = hashed.join(same.select("h1", "h2", "keep_id", "group_size"), ["h1", "h2"], "left")
        single = single.withColumn("keep_id", F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id"))))
        return single.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))).select(*cols)
    # A hash that stands for several texts: those rows are grouped and joined by the text.
    apart = texts.select("doc_id", "norm", h1.alias("h1"), h2.alias("h2")).join(mixed, ["h1", "h2"], "left_semi")
    exact = apart.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    fixed = apart.join(exact, "norm").withColumn("text_sha256", F.sha2("norm", 256)).select(*cols)
    rest = hashed.join(mixed, ["h1", "h2"], "left_anti").join(groups, ["h1", "h2"]).select(*cols)
    return rest.unionByName(fixed)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
