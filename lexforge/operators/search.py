"""BM25 over documents or blocks: an inverted index in segments with their largest impacts, and top-k that skips segments.

A term adds round(10^6 * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))) to a document, its impact; idf is ln(1 + (n - df +
0.5) / (df + 0.5)). Scores are sums of impacts times whole weights, so no order of rows changes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.plans.scratch import Scratch

#: Runs of Chinese characters and Japanese syllables, which have no blanks between words; and words of other letters and digits.
WIDE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]+"
WORD = rf"{WIDE}|[\p{{L}}\p{{N}}&&[^\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}ー]]+"
#: Query terms up to which they are broadcast; longer tables are shuffled.
MOST_BROADCAST = 100_000


def search_terms(text: Column) -> Column:
    """Lower-cased words of letters and digits; of runs without blanks each two neighbouring signs, or the only one."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    pairs = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array(w))
    return F.flatten(F.transform(found, lambda w: F.when(w.rlike(f"^{WIDE}$"), pairs(w)).otherwise(F.array(w))))


@dataclass(frozen=True)
class Index:
    """blocks: (term, segment, top, postings array<struct<doc, impact>>), the documents of a term in a segment; top: the
    largest impact. n, words: of the whole corpus."""

    blocks: DataFrame
    n: int
    words: int
    scratch: Scratch


def build_index(docs: DataFrame, order: list[str], doc_col: str = "doc", text_col: str = "text", segment: int = 128, k1: float = 1.2, b: float = 0.75) -> Index:
    """docs: one row for each document. `order`: columns by which documents that are alike stand together, so that a query's terms
    meet in few segments; `segment` documents to each at most.

    Documents are range-partitioned once; a term's documents of a segment become one row, so terms that all documents have are many rows and no
    hot key; document frequencies are sums over these rows. Null texts are empty, count as documents and are found by nothing; a null
    document is not."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    keys = [c for c in dict.fromkeys(order) if c != doc_col]
    rows = docs.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("doc"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(text_col).alias("text"))
    by = [*(f"_k{i}" for i in range(len(keys))), "doc"]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    numbered = sorted_rows.select("doc", F.expr(f"(_at >> 33 << 33) + ((_at & 8589934591) div {segment})").alias("segment"), search_terms(F.col("text")).alias("w"))
    each = numbered.select("doc", "segment", F.size("w").cast("long").alias("length"), F.explode("w").alias("term"))
    each = each.groupBy("segment", "doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    lists = scratch.write(each.groupBy("segment", "term").agg(F.collect_list(F.struct("doc", "tf", "length")).alias("of")), "postings")
    n = rows.count()
    words = lists.select(F.explode("of").alias("p")).agg(F.sum("p.tf")).first()[0] or 0
    df = lists.groupBy("term").agg(F.sum(F.size("of")).alias("df"))
    idf = F.ln(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    mean = words / n if n else 1.0
    impact = lambda p: F.round(F.lit(1e6) * F.col("idf") * p["tf"] * F.lit(k1 + 1) / (p["tf"] + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * p["length"] / F.lit(mean or 1.0)))).cast("long")
    rated = lists.join(df, "term").withColumn("idf", idf)
    postings = F.transform("of", lambda p: F.struct(p["doc"].alias("doc"), impact(p).alias("impact")))
    rated = rated.select("term", "segment", postings.alias("postings")).withColumn("top", F.array_max(F.transform("postings", lambda p: p["impact"])))
    blocks = scratch.write(rated.select("term", "segment", "top", "postings"), "index")
    scratch.drop(lists)
    return Index(blocks, n, int(words), scratch)


def _asked(queries: DataFrame, n: int) -> DataFrame:
    return F.broadcast(queries) if n <= MOST_BROADCAST else queries


def score_segments(index: Index, queries: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(query, doc, score) of the documents of chosen (query, segment)."""
    terms = chosen.join(_asked(queries, n), "query")
    met = index.blocks.join(terms, ["term", "segment"]).select("query", "weight", F.explode("postings").alias("p"))
    return met.groupBy("query", F.col("p.doc").alias("doc")).agg(F.sum(F.col("weight") * F.col("p.impact")).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, first: int = 4) -> tuple[DataFrame, DataFrame]:
    """((query, rank, doc, score), (query, segments, scored)): each query's k best documents, ties by document, and how many segments its terms
    occur in and how many of these were scored.

    queries: (query, term, weight long), a term once for a query. A segment can hold no score above the sum of its terms' tops, which
    need no postings. The `first` segments by that bound are scored, and give a k-th score; of the others only those whose bound
    reaches it. Queries without known terms find nothing."""
    scratch = index.scratch
    queries = scratch.write(queries.where("query is not null and term is not null and weight > 0").select("query", "term", F.col("weight").cast("long").alias("weight")), "queries")
    n = queries.count()
    bound = index.blocks.select("term", "segment", "top").join(_asked(queries, n), "term").groupBy("query", "segment").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    place = Window.partitionBy("query").orderBy(F.desc("bound"), "segment")
    bound = scratch.write(bound.withColumn("place", F.row_number().over(place)), "bounds")
    early = scratch.write(top(score_segments(index, queries, bound.where(F.col("place") <= first).select("query", "segment"), n), k), "early")
    kth = early.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    late = bound.where(F.col("place") > first).join(kth, "query", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0)))
    late = scratch.write(late.select("query", "segment"), "late")
    more = score_segments(index, queries, late, n)
    out = top(early.select("query", "doc", "score").unionByName(more), k).select("query", "rank", "doc", "score")
    counts = bound.groupBy("query").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("place") <= first).alias("_early"))
    counts = counts.join(late.groupBy("query").agg(F.count(F.lit(1)).alias("_late")), "query", "left")
    return out, counts.select("query", "segments", (F.col("_early") + F.coalesce("_late", F.lit(0))).alias("scored"))


def query_terms(queries: DataFrame, query_col: str, text_col: str, weight: int = 1000) -> DataFrame:
    """(query, term, weight) of the distinct terms of each query's text."""
    rows = queries.select(F.col(query_col).alias("query"), F.explode(F.array_distinct(search_terms(F.col(text_col)))).alias("term"))
    return rows.distinct().withColumn("weight", F.lit(weight).cast("long"))
