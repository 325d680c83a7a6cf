"""Spelling variants: terms within a small edit distance, found by what is left when signs are taken out; very long ones by their rarest q-grams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.plans.scratch import Scratch, spread

#: Before and after a term, so that its ends have pairs of their own.
LEFT, RIGHT = "\x01", "\x02"
#: Distinct pairs of signs up to which their counts are broadcast.
MOST_BROADCAST = 200_000
#: Signs of a shorter term up to which signs are taken out: the strings left of n signs are n (n - 1) / 2.
LONGEST = 24


def allowed(length: Column) -> Column:
    """The edit distance that a term of this length may have: none below 3 signs, one below 6, else two."""
    return F.when(length < 3, 0).when(length < 6, 1).otherwise(2)


def grams(terms: DataFrame) -> DataFrame:
    """(lang, term, gram, pos): each two neighbouring signs of a padded term, as often as they occur in it."""
    kind = terms.schema["lang"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = [LEFT + t + RIGHT for t in part.column(1).to_pylist()]
                at = pa.array([i for i, t in enumerate(texts) for _ in range(len(t) - 1)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([t[p : p + 2] for t in texts for p in range(len(t) - 1)], pa.string()), pa.array([p for t in texts for p in range(len(t) - 1)], pa.int32())], names=["lang", "term", "gram", "pos"])

    return terms.select("lang", "term").mapInArrow(run, f"lang {kind}, term string, gram string, pos int")


def prefixes(terms: DataFrame) -> DataFrame:
    """(lang, term, length, d, gram, pos): a term's 2 d + 1 rarest pairs of signs, in order of rarity, pair and place. d edits
    change 2 d pairs at most and keep the others' order, so two terms within d have a pair in both prefixes, at most d places apart."""
    each = grams(terms.where(F.length("term") >= 3))
    counts = each.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    small = counts.count() <= MOST_BROADCAST
    ranked = each.join(F.broadcast(counts) if small else counts, ["lang", "gram"])
    ordered = F.array_sort(F.collect_list(F.struct("n", "gram", "pos")))
    rows = ranked.groupBy("lang", "term").agg(ordered.alias("g")).withColumn("length", F.length("term")).withColumn("d", allowed(F.col("length")))
    first = F.slice("g", 1, 2 * F.col("d") + 1)
    return rows.select("lang", "term", "length", "d", F.explode(first).alias("x")).select("lang", "term", "length", "d", "x.gram", "x.pos")


def _left(term: str, taken: int) -> set[str]:
    """What is left of a term when `taken` signs, at most two, go."""
    n = len(term)
    if taken == 0:
        return {term}
    if taken == 1:
        return {term[:i] + term[i + 1 :] for i in range(n)}
    return {term[:i] + term[i + 1 : j] + term[j + 1 :] for i in range(n) for j in range(i + 1, n)}


def remainders(terms: DataFrame, longest: int) -> DataFrame:
    """(lang, term, d, rest, shorter, longer): what is left of a term of up to longest + 2 signs without some of its signs; d: the distance
    that it serves, shorter and longer: whether the term stands as the one or the other of a pair.

    Of two terms within d edits, the longer one without d signs is the shorter one without as many as make the lengths equal: a replaced sign goes
    from both, an inserted one from the longer one, and of equal lengths a deletion and an insertion take one sign from each."""
    kind = terms.schema["lang"].dataType.simpleString()

    def of(term: str):
        n = len(term)
        own = (0 if n < 3 else 1 if n < 6 else 2) if n <= longest else 0
        for d in (1, 2):
            longer = 3 <= n <= 6 if d == 1 else n >= 6
            for taken in range(d + 1) if own == d else (d,) if longer else ():
                for rest in _left(term, taken):
                    yield d, rest, own == d, longer and taken == d

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = [(i, *x) for i, t in enumerate(part.column(1).to_pylist()) for x in of(t)]
                at, d, rest, shorter, longer = zip(*rows, strict=True) if rows else ((),) * 5
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(d, pa.int32()), pa.array(rest, pa.string()), pa.array(shorter, pa.bool_()), pa.array(longer, pa.bool_())], names=["lang", "term", "d", "rest", "shorter", "longer"])

    return terms.where(F.length("term") <= longest + 2).select("lang", "term").mapInArrow(run, f"lang {kind}, term string, d int, rest string, shorter boolean, longer boolean")


def spelling_variants(terms: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, term, other, distance) of all pairs of one language's terms that are within the distance allowed for the shorter one.

    terms: (lang, term); repeated rows count once, null and empty terms have no variants. The shorter term comes first, of
    equal lengths the smaller. Where the shorter term has up to `longest` signs, terms meet by what is left of them without one or two
    signs; others have too many such strings and meet by a common rare pair of signs, at nearby places and with
    lengths that fit. Distances are told as pairs come up, so that only variants are made distinct. `longest` chooses the way, not the result."""
    once = terms.where(F.col("lang").isNotNull() & F.col("term").isNotNull()).select("lang", "term").distinct().repartition(spread(terms.sparkSession), "term")  # dealt anew: few bytes become many rows
    rest = remainders(once, longest).select("lang", "term", "d", F.xxhash64("lang", "d", "rest").alias("key"), "shorter", "longer")
    rest = Scratch(terms.sparkSession).write(rest, "remainders")
    short = rest.where("shorter").select("lang", "key", "d", "term")
    near = short.join(rest.where("longer").select("lang", "key", F.col("term").alias("other")).hint("merge"), ["lang", "key"])
    rows = prefixes(once.where(F.length("term") > longest))
    left = rows.withColumn("fit", F.explode(F.sequence("length", F.col("length") + F.col("d")))).withColumn("at", F.explode(F.sequence(F.col("pos") - F.col("d"), F.col("pos") + F.col("d"))))
    right = rows.select("lang", "gram", F.col("length").alias("fit"), F.col("term").alias("other"), F.col("pos").alias("at"))
    near = near.select("lang", "term", "other", "d").unionByName(left.join(right, ["lang", "gram", "fit", "at"]).select("lang", "term", "other", "d"))
    first = (F.length("term") < F.length("other")) | ((F.length("term") == F.length("other")) & (F.col("term") < F.col("other")))
    distance = F.when(F.col("d") == 1, F.levenshtein("term", "other", 1)).otherwise(F.levenshtein("term", "other", 2))
    return near.where(first).select("lang", "term", "other", distance.alias("distance")).where("distance >= 0").distinct()
