"""Concepts that are merged or split: aliases from old ids to new ones, resolved by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.plans.scratch import Scratch


def resolve(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((old, final, steps), (old) without an end) of (old, new): where each id leads in the end.

    Every round an id takes its target's target, so a chain of n links is followed in log n rounds, each a written table; what
    has arrived is not read again. Ids on a cycle, or leading into one, have no end: they are those still on their way when
    the rounds reach further than there are ids. An id with several targets has no single end either and is refused in the same
    way; rows that lead to themselves, or have a null, say nothing."""
    scratch = Scratch(aliases.sparkSession)
    rows = aliases.where("old is not null and new is not null and old <> new").select("old", "new").distinct()
    several = rows.groupBy("old").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("old")
    several = scratch.write(several, "several")
    known = scratch.write(rows.join(several, "old", "left_anti").select("old", F.col("new").alias("to"), F.lit(1).cast("long").alias("steps")), "links")
    n, reach = known.count(), 1
    # what leads to an id with several targets stops there without an end
    while reach <= n:
        over = known.select(F.col("old").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = known.join(over, "to", "left").select("old", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        moved = scratch.write(moved, "links")
        open_ids = moved.join(known.select(F.col("old").alias("to")), "to", "left_semi").isEmpty()
        scratch.drop(known)
        known, reach = moved, reach * 2
        if open_ids:
            break
    lost = known.join(known.select(F.col("old").alias("to")), "to", "left_semi").select("old").unionByName(known.join(several.withColumnRenamed("old", "to"), "to", "left_semi").select("old")).unionByName(several).distinct()
    lost = scratch.write(lost, "lost")
    done = known.join(lost, "old", "left_anti").select("old", F.col("to").alias("final"), "steps")
    return done, lost


def redirected(rows: DataFrame, resolved: DataFrame, column: str = "concept_id") -> DataFrame:
    """rows with old ids of a column replaced by where they lead."""
    to = resolved.select(F.col("old").alias(column), F.col("final").alias("_final"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_final", column)).select(*rows.columns)


def merge_concepts(concepts: DataFrame, concept_terms: DataFrame, evidence: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """concepts, labels and evidence after merges: an old concept's row goes, what hung on it hangs on the one it leads to.

    That one keeps its row and takes the largest confidence; it is safe for a use only if all that it is made of are. A label that both have is one,
    with the larger confidence; evidence keeps its key. A concept whose id leads to one that is not there stays what it is."""
    there = resolved.join(concepts.select(F.col("concept_id").alias("final")), "final", "left_semi")
    flags = [c for c in ("safe_for_query_expansion", "safe_for_answer_generation") if c in concepts.columns]
    parts = redirected(concepts.select("concept_id", "confidence", *flags), there)
    total = parts.groupBy("concept_id").agg(F.max("confidence").alias("_confidence"), *[F.min(F.coalesce(c, F.lit(False))).alias(f"_{c}") for c in flags])
    left = concepts.join(there.select(F.col("old").alias("concept_id")), "concept_id", "left_anti").join(total, "concept_id")
    left = left.withColumns({"confidence": F.col("_confidence"), **{c: F.col(f"_{c}") for c in flags}}).select(*concepts.columns)
    labels = redirected(concept_terms, there)
    keys = [c for c in concept_terms.columns if c not in ("confidence", "role")]
    labels = labels.groupBy(*keys).agg(F.max("confidence").alias("confidence"), *([F.min("role").alias("role")] if "role" in concept_terms.columns else [])).select(*concept_terms.columns)
    return left, labels, redirected(evidence, there)


def split_concept(concepts: DataFrame, concept_terms: DataFrame, evidence: DataFrame, parts: DataFrame | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """concepts, labels and evidence after (evidence_key, part) has been given: such evidence goes to the concept `<old id>/<part>`.
    parts: rows, or a column of evidence, which then is not joined.

    New concepts have the old one's other columns and labels, are candidates, safe for nothing, and as confident as their best positive evidence. A concept
    that has lost all its evidence goes with its labels; others keep what is left. An evidence key in several parts goes to the smallest."""
    if isinstance(parts, Column):
        moved = evidence.withColumn("_part", parts)
    else:
        to = parts.where("evidence_key is not null and part is not null").groupBy("evidence_key").agg(F.min("part").alias("_part"))
        moved = evidence.join(to, "evidence_key", "left")
    moved = moved.withColumn("_new", F.when(F.col("_part").isNotNull(), F.concat_ws("/", "concept_id", "_part")))
    best = F.max(F.when(~F.coalesce("is_negative_evidence", F.lit(False)), F.col("score")))
    sums = Scratch(evidence.sparkSession).write(moved.groupBy("concept_id", "_new").agg(best.alias("_confidence")), "parts")  # all below read them
    made = sums.where("_new is not null")
    left = sums.groupBy("concept_id").agg(F.count_if(F.col("_new").isNull()).alias("n")).where("n = 0").select("concept_id")
    flags = {c: F.lit(False) for c in ("safe_for_query_expansion", "safe_for_answer_generation") if c in concepts.columns}
    new = concepts.join(made, "concept_id").withColumns({"concept_id": F.col("_new"), "confidence": F.coalesce("_confidence", F.lit(0.0)), "status": F.lit("candidate"), **flags})
    labels = concept_terms.join(made.select("concept_id", "_new"), "concept_id").withColumn("concept_id", F.col("_new")).select(*concept_terms.columns)
    keep = lambda df: df.join(left, "concept_id", "left_anti").select(*df.columns)
    evidence_now = moved.withColumn("concept_id", F.coalesce("_new", "concept_id")).select(*evidence.columns)
    return keep(concepts).unionByName(new.select(*concepts.columns)), keep(concept_terms).unionByName(labels), evidence_now
