"""Precision, hit rates, reciprocal ranks and approval by band, with intervals from a Poisson bootstrap; samples for review."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probabilities that a Poisson number of mean 1 is 0, at most 1, and so on.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
#: Bands of scores, from the largest.
BANDS = (0.95, 0.85, 0.70)


def uniform(key: Column) -> Column:
    """A number above 0 and below 1 that only depends on the key's text."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def ranking_scores(found: DataFrame, relevant: DataFrame, cuts: tuple = (1, 5)) -> DataFrame:
    """(query, rr, p1, h1, p5, h5) for each query that has relevant documents.

    found: (query, rank, doc); relevant: (query, doc). rr: 1 / rank of the first relevant document; p: relevant ones among the first so
    many, divided by that many; h: whether there is one. A query that finds nothing has zeros."""
    gold = relevant.where("query is not null and doc is not null").select("query", "doc").distinct()
    hit = found.select("query", "doc", "rank").join(gold, ["query", "doc"])
    sums = [F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in cuts]
    each = gold.select("query").distinct().join(hit.groupBy("query").agg(F.min("rank").alias("first"), *sums), "query", "left")
    out = {"rr": F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))}
    for k in cuts:
        out[f"p{k}"] = F.coalesce(F.col(f"n{k}") / F.lit(float(k)), F.lit(0.0))
        out[f"h{k}"] = F.coalesce((F.col(f"n{k}") > 0).cast("double"), F.lit(0.0))
    return each.select("query", *[v.alias(k) for k, v in out.items()])


def intervals(scores: DataFrame, group: list[str], key: str, values: list[str], rounds: int = 200, seed: str = "eval") -> DataFrame:
    """(group, metric, value, low, high): means, and the 2.5th and 97.5th of a hundred of the means of `rounds` resamples.

    A resample counts each row a Poisson number of times that its key and the round alone decide; so all rounds are sums of one pass,
    rows of one key stay together, and any order and partitioning gives the same. Sums are of whole millionths. Resamples without rows say nothing."""
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long")
    each = scores.select(*group, F.col(key).cast("string").alias("_key"), *[micro(c).alias(c) for c in values]).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    drawn = uniform(F.concat_ws(":", F.lit(seed), "_round", "_key"))
    times = F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda p: p < drawn)).cast("long")
    weighted = each.withColumn("_times", F.when(F.col("_round") == 0, F.lit(1).cast("long")).otherwise(times))
    sums = weighted.groupBy(*group, "_round").agg(F.sum("_times").alias("_n"), *[F.sum(F.col(c) * F.col("_times")).alias(c) for c in values]).where("_n > 0")
    long = sums.select(*group, "_round", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), (F.col(c) / F.col("_n")).alias("mean")) for c in values])).alias("m")).select(*group, "_round", "m.*")
    means = F.array_sort(F.collect_list(F.when(F.col("_round") > 0, F.col("mean"))))  # `rounds` numbers
    place = lambda share: F.element_at("_means", F.greatest(F.lit(1), F.ceil(F.size("_means") * F.lit(share)).cast("int")))
    out = long.groupBy(*group, "metric").agg(F.max(F.when(F.col("_round") == 0, F.col("mean"))).alias("value"), means.alias("_means"))
    return out.select(*group, "metric", *[F.round(c / 1e6, 6).alias(n) for n, c in (("value", F.col("value")), ("low", place(0.025)), ("high", place(0.975)))])


def band(score: Column) -> Column:
    out = F.lit("below")
    for b in sorted(BANDS):
        out = F.when(score >= b, f"{b:.2f}").otherwise(out)
    return out


def approval_by_band(concepts: DataFrame, actions: DataFrame) -> DataFrame:
    """(band, reviewed, approved, blocked, rate) of concepts by confidence; a concept's latest approval or block counts, of equal versions the block."""
    last = actions.where(F.col("action").isin("approve", "block")).groupBy(F.col("target_id").alias("concept_id")).agg(F.max_by("action", F.struct("row_version", "action")).alias("action"))
    rows = concepts.select("concept_id", band(F.col("confidence")).alias("band")).join(last, "concept_id")
    out = rows.groupBy("band").agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("action") == "approve").alias("approved"), F.count_if(F.col("action") == "block").alias("blocked"))
    return out.withColumn("rate", F.round(F.col("approved") / F.col("reviewed"), 6))


def review_sample(rows: DataFrame, id_col: str, band_col: str, weight_col: str, n: int, seed: str = "review") -> DataFrame:
    """rows with `place`: of each band n rows drawn without replacement, by weight, in the order drawn.

    A row's key is -ln(u) / weight, with u from the seed and its id alone; the n smallest keys are a weighted sample, the same
    under any partitioning, and a larger n only adds to it. Rows without a positive weight are not drawn; ties by id."""
    key = -F.ln(uniform(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))) / F.col(weight_col)
    drawn = rows.where(F.col(weight_col) > 0).withColumn("_draw", key)
    order = Window.partitionBy(band_col).orderBy("_draw", id_col)
    return drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("_draw")
