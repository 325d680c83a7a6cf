"""Terms of blocks, the term catalogue and occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as X


def block_terms(blocks: DataFrame, **lexicons) -> DataFrame:
    """(lang, path, block_index, term, term_type, normalized_term): one row for each normalised term of
    a block; what comes first, lexicon before patterns, gives term and type. All inside the JVM; a block's terms
    are one array, which is shuffled as one row."""
    found = X.terms(F.col("lang"), F.col("text"), **lexicons)
    named = lambda t, i: F.struct(X.normalize_term(t["term"], F.col("lang")).alias("normalized_term"), i.alias("pos"), F.trim(t["term"]).alias("term"), t["term_type"].alias("term_type"))
    rows = blocks.select("lang", "path", "block_index", F.transform(found, named).alias("terms"))
    rows = rows.groupBy("lang", "path", "block_index").agg(F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))
    new = F.filter("terms", lambda t, i: (t["normalized_term"] != "") & ((i == 0) | (F.get("terms", i - 1)["normalized_term"] != t["normalized_term"])))
    return rows.select("lang", "path", "block_index", F.explode(new).alias("t")).select("lang", "path", "block_index", "t.term", "t.term_type", "t.normalized_term")


def term_catalog(found: DataFrame) -> DataFrame:
    """(lang, normalized_term, term, term_type, status): the surface of the first occurrence."""
    first = F.min_by(F.struct("term", "term_type"), F.struct("path", "block_index", "term"))
    return found.groupBy("lang", "normalized_term").agg(first.alias("f")).select("lang", "normalized_term", "f.*", F.lit("active").alias("status"))


def occurrences(found: DataFrame) -> DataFrame:
    return found.select("lang", "normalized_term", "path", "block_index", F.lit("block").alias("source"))
