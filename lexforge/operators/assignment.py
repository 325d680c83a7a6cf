"""One-to-one assignment of pages in rounds of mutual best choice, and the type of each page's match."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.plans.scratch import Scratch


def _best_first(batches):
    """Takes always the best pair that is left; the pairs are a bounded number."""
    if not (batches := list(batches)):
        return
    pairs, used = pa.Table.from_batches(batches).sort_by([("score", "descending"), ("ja", "ascending"), ("en", "ascending")]), (set(), set())
    taken = []
    for at, (ja, en) in enumerate(zip(pairs["ja"].to_pylist(), pairs["en"].to_pylist(), strict=True)):
        if ja not in used[0] and en not in used[1]:
            used[0].add(ja)
            used[1].add(en)
            taken.append(at)
    yield from pairs.take(pa.array(taken, pa.int64())).to_batches()


def assign(candidates: DataFrame, last: int = 50_000) -> DataFrame:
    """(ja, en, score, round) of (ja, en, score): no page twice, and no two pages that would both rather have each other.

    Pages prefer higher scores, then smaller partners; so the pairs are those that taking always the best pair that is left gives, in whatever
    order rounds find them. Each round takes all pairs that are each other's best, and drops what their pages are in.
    Rounds are written tables; a chain of ever lower scores takes a round for every second link, until at most `last` pairs are
    left: these are taken one by one, best first, as the last round. Repeated pairs count once, with
    their best score; rows with a null take no part."""
    scratch = Scratch(candidates.sparkSession)
    left = candidates.where("ja is not null and en is not null and score is not null").groupBy("ja", "en").agg(F.max("score").alias("score"))
    left, done = scratch.write(left, "pairs"), []
    while (n := left.count()) > last:
        choice = lambda own, other: left.groupBy(own).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(other).alias("other"))).alias("c")).select(own, F.col("c.other").alias(other), (-F.col("c.s")).alias("score"))  # noqa: B023, E731
        both = choice("ja", "en").join(choice("en", "ja").select("ja", "en"), ["ja", "en"])
        done.append(scratch.write(both.select("ja", "en", "score", F.lit(len(done) + 1).alias("round")), "chosen"))
        rest = scratch.write(left.join(done[-1].select("ja"), "ja", "left_anti").join(done[-1].select("en"), "en", "left_anti").select("ja", "en", "score"), "pairs")
        scratch.drop(left)
        left = rest
    if n:
        best = left.select("ja", "en", "score").coalesce(1).mapInArrow(_best_first, left.schema)
        done.append(scratch.write(best.withColumn("round", F.lit(len(done) + 1)), "chosen"))
    return reduce(DataFrame.unionByName, done) if done else left.withColumn("round", F.lit(0))


def match_types(pages: DataFrame, candidates: DataFrame, assigned: DataFrame, strong: float = 0.5) -> DataFrame:
    """(lang, page, partner, score, match_type) for every page of (lang, page), of lang ja and en.

    The partner is the page's assigned one, else its best candidate. Among candidates of at least `strong`, a page with one partner
    that has only this page is one_to_one; one Japanese page and several English ones are one_to_many, the other way round many_to_one. Where
    both have several, the assigned pair is one_to_one. Other pages with candidates are weak_candidate, the rest unmatched."""
    edges = candidates.where("ja is not null and en is not null").groupBy("ja", "en").agg(F.max("score").alias("score")).where("score is not null")
    good = edges.where(F.col("score") >= strong)
    degree = lambda side: good.groupBy(side).agg(F.count(F.lit(1)).alias(f"{side}_n"))
    rows = edges.join(degree("ja"), "ja", "left").join(degree("en"), "en", "left").join(assigned.select("ja", "en", F.lit(True).alias("taken")), ["ja", "en"], "left")
    a, b = F.col("ja_n"), F.col("en_n")
    kind = (
        F.when(F.col("score") < strong, "weak_candidate")
        .when((a == 1) & (b == 1), "one_to_one")
        .when((a > 1) & (b == 1), "one_to_many")
        .when((a == 1) & (b > 1), "many_to_one")
        .when(F.col("taken"), "one_to_one")
        .otherwise("weak_candidate")
    )
    rows = rows.withColumns({"match_type": kind, "taken": F.coalesce("taken", F.lit(False))})

    def side(own: str, other: str) -> DataFrame:
        best = F.min(F.struct((~F.col("taken")).alias("t"), (-F.col("score")).alias("s"), F.col(other).alias("partner"), "match_type"))
        return rows.groupBy(F.col(own).alias("page")).agg(best.alias("b")).select(F.lit(own).alias("lang"), "page", "b.partner", (-F.col("b.s")).alias("score"), "b.match_type")

    known = side("ja", "en").unionByName(side("en", "ja"))
    return pages.select("lang", "page").distinct().join(known, ["lang", "page"], "left").withColumn("match_type", F.coalesce("match_type", F.lit("unmatched"))).select("lang", "page", "partner", "score", "match_type")
