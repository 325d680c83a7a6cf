"""How likely a Japanese term is rendered by an English one: word translation probabilities from matched blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.plans.scratch import Scratch


def translation_table(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(ja_norm, en_norm, p): P(English term | Japanese term) after `rounds` rounds of expectation maximisation, from equal probabilities.

    pairs: (ja, en, ja_norm, en_norm), the terms of matched blocks, each combination of a block pair; repeats count once. Each round
    deals an English term of a block pair to the pair's Japanese terms by their probabilities, and adds up. What a pair of terms
    collects is summed in the tasks before the shuffle, and each round is a written table, so lineage stays short."""
    scratch = Scratch(pairs.sparkSession)
    rows = scratch.write(pairs.where("ja_norm is not null and en_norm is not null").select("ja", "en", "ja_norm", "en_norm").distinct(), "combinations")
    table = None
    for _ in range(rounds):
        known = rows.withColumn("p", F.lit(1.0)) if table is None else rows.join(table, ["ja_norm", "en_norm"])
        share = known.withColumn("c", F.col("p") / F.sum("p").over(Window.partitionBy("ja", "en", "en_norm")))
        counts = share.groupBy("ja_norm", "en_norm").agg(F.sum("c").alias("c"))
        total = counts.groupBy("ja_norm").agg(F.sum("c").alias("total"))
        new = scratch.write(counts.join(total, "ja_norm").select("ja_norm", "en_norm", (F.col("c") / F.col("total")).alias("p")), "translation")
        if table is not None:
            scratch.drop(table)
        table = new
    return table
