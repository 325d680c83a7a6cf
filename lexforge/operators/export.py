"""Rows of the review queue and of the dictionaries."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import lexicon as L
from lexforge.functions import text as X
from lexforge.operators.concepts import evidence_key
from lexforge.operators.review import row_versions
from lexforge.plans.scratch import spread

NO_TEXT = "cast(array() as array<string>)"


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """One row per concept: counts, types, best score, ids and anchors by score and key, the first
    evidence's contexts, and source files."""
    order = F.struct((-F.col("score")).alias("s"), F.col("evidence_key").alias("k"))
    of = lambda c: F.transform("_all", lambda r: r[c])
    rows = (
        evidence.withColumn("_anchors", F.to_json("anchors_json"))
        .groupBy("concept_id")
        .agg(
            F.count(F.lit(1)).alias("evidence_count"),
            F.count_if("is_negative_evidence").alias("negative_count"),
            F.max("score").alias("max_score"),
            F.sort_array(F.collect_set("evidence_type")).alias("evidence_types"),
            F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("evidence_key").alias("k"), F.col("_anchors").alias("a")))).alias("_all"),
            F.min_by("ja_context", order).alias("sample_ja_context"),
            F.min_by("en_context", order).alias("sample_en_context"),
            F.array_sort(F.array_union(F.collect_set(F.col("ja.path")), F.collect_set(F.col("en.path")))).alias("source_files"),
        )
    )
    lists = {"evidence_ids": of("k"), "anchors": F.filter(of("a"), lambda a: a.isNotNull())}  # of one list: each piece is held once
    return rows.withColumns(lists).select("concept_id", "evidence_count", "negative_count", "max_score", "evidence_types", *lists, "sample_ja_context", "sample_en_context", "source_files")


def evidence_digests(evidence: DataFrame, matches: DataFrame) -> DataFrame:
    """(concept_id, ids, types, files, n_anchors, sample_ja_context, sample_en_context): what evidence_summary() tells of a concept, with its
    ordered evidence ids as SHA-256 of their text and no anchors, for concepts of any number of pieces.

    evidence: as build_concepts() makes it, so keys follow from the other columns and are not shuffled; matches: (ja, en, ja_context,
    en_context). A concept's pieces pass one task in order, which holds only its files; sorting goes to disk where it must."""
    parts = 16 * spread(evidence.sparkSession)  # a task sorts little at once
    slim = evidence.select("concept_id", "score", "ja", "en", "evidence_type", F.col("anchors_json").isNotNull().alias("anchor")).repartition(parts, "concept_id")
    rows = slim.withColumn("k", evidence_key(F.col("evidence_type"))).sortWithinPartitions("concept_id", -F.col("score"), "k")
    rows = rows.select("concept_id", "k", "evidence_type", "anchor", F.col("ja.path").alias("jp"), F.col("ja.block_index").alias("ji"), F.col("en.path").alias("ep"), F.col("en.block_index").alias("ei"))
    schema = pa.schema([("concept_id", pa.string()), ("ids", pa.string()), ("types", pa.string()), ("files", pa.string()), ("n_anchors", pa.int64()), ("jp", pa.string()), ("ji", pa.int32()), ("ep", pa.string()), ("ei", pa.int32())])

    def run(batches):
        concept, ids, types, paths, n, first = None, None, set(), set(), 0, ()
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, (concept, ids.hexdigest(), " ".join(sorted(types)), " ".join(sorted(paths)), n, *first), strict=True))], schema)
        for batch in batches:
            ends = pc.run_end_encode(batch["concept_id"], run_end_type=pa.int32())
            at = 0
            for end, name in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
                part = batch.slice(at, end - at)
                at = end
                if ids is None or name != concept:
                    if ids is not None:
                        yield done()
                    concept, ids, types, paths, n = name, hashlib.sha256(), set(), set(), 0
                    first = tuple(part[c][0].as_py() for c in ("jp", "ji", "ep", "ei"))
                else:
                    ids.update(b" ")
                ids.update(" ".join(part["k"].to_pylist()).encode())
                types.update(part["evidence_type"].unique().to_pylist())
                paths.update(part["jp"].unique().to_pylist(), part["ep"].unique().to_pylist())
                n += pc.sum(part["anchor"]).as_py() or 0
        if ids is not None:
            yield done()

    found = rows.mapInArrow(run, "concept_id string, ids string, types string, files string, n_anchors long, jp string, ji int, ep string, ei int")
    place = lambda p, i: F.struct(F.col(p).alias("path"), F.col(i).alias("block_index"))
    found = found.select("concept_id", "ids", "types", "files", "n_anchors", place("jp", "ji").alias("ja"), place("ep", "ei").alias("en"))
    texts = matches.select("ja", "en", F.col("ja_context").alias("sample_ja_context"), F.col("en_context").alias("sample_en_context")).dropDuplicates(["ja", "en"])
    return found.join(texts.hint("merge"), ["ja", "en"]).drop("ja", "en")


def concept_labels(concept_terms: DataFrame, catalog: DataFrame) -> DataFrame:
    """(concept_id, ja_terms, en_terms): distinct surfaces by role, then term."""
    rank = F.when(F.col("role") == "primary", 0).when(F.col("role") == "label", 1).otherwise(2)
    rows = concept_terms.join(catalog.select("lang", "normalized_term", "term"), ["lang", "normalized_term"])
    terms = lambda lang: F.array_distinct(F.transform(F.sort_array(F.collect_set(F.when(F.col("lang") == lang, F.struct(rank.alias("r"), F.col("term").alias("t"))))), lambda x: x["t"])).alias(f"{lang}_terms")
    return rows.groupBy("concept_id").agg(terms("ja"), terms("en"))


def review_queue(concepts: DataFrame, concept_terms: DataFrame, catalog: DataFrame, evidence: DataFrame, actions: DataFrame, batch: str, status: str = "review_ready") -> DataFrame:
    """The 23 text columns of the review file for concepts of a status, by confidence, then id."""
    rows = concepts.where(F.col("status") == status).join(evidence_summary(evidence), "concept_id", "left").join(concept_labels(concept_terms, catalog), "concept_id", "left").join(row_versions(actions), "concept_id", "left")
    count, negative = F.coalesce("evidence_count", F.lit(0)), F.coalesce("negative_count", F.lit(0))
    none = F.expr(NO_TEXT)
    joined = lambda c: F.array_join(F.coalesce(c, none), " | ")
    as_json = lambda c: F.to_json(F.coalesce(c, none))
    summary = F.to_json(F.struct(count.alias("count"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"), negative.alias("negative_count"), F.coalesce("evidence_types", none).alias("types")))
    values = {
        "confidence": F.format_string("%.6f", "confidence"),
        "confidence_json": F.col("confidence_json"),
        "ja_terms": joined("ja_terms"),
        "en_terms": joined("en_terms"),
        "evidence_count": count.cast("string"),
        "evidence_ids": as_json("evidence_ids"),
        "evidence_types": joined("evidence_types"),
        "evidence_summary": summary,
        "anchors": F.concat(F.lit("["), F.array_join(F.coalesce("anchors", none), ", "), F.lit("]")),
        "source_files": joined("source_files"),
        "recommended_action": X.recommended_action(F.col("confidence"), count, negative),
        "row_version": F.coalesce("row_version", F.lit(0)).cast("string"),
        "export_batch_id": F.lit(batch),
        **{c: F.lit("") for c in ("action", "reviewer", "reason", "reason_code", "review_note")},
    }
    text = [F.coalesce(values.get(c, F.col(c) if c in rows.columns else F.lit("")), F.lit("")).alias(c) for c in L.REVIEW_COLUMNS]
    return rows.select(*text, F.col("confidence").alias("_c")).orderBy(F.desc("_c"), "concept_id").drop("_c")


def dictionary(concepts: DataFrame, concept_terms: DataFrame, catalog: DataFrame, actions: DataFrame, safe: str | None = None) -> DataFrame:
    """Confirmed concepts with their terms; safe: only those with this safety flag."""
    if safe not in (None, "safe_for_query_expansion", "safe_for_answer_generation"):
        raise ValueError(f"no such safety flag: {safe}")
    wanted = [F.col("status") == "confirmed", *([F.col(safe)] if safe else [])]
    rows = concepts.where(X.all_of(wanted)).join(concept_labels(concept_terms, catalog), "concept_id", "left").join(row_versions(actions), "concept_id", "left")
    none = F.expr(NO_TEXT)
    maybe = lambda c: (F.col(c) if c in concepts.columns else F.lit(None).cast("string")).alias(c)
    return rows.select(
        "canonical_label_en", "canonical_label_ja", "category", "concept_id", "confidence", "confidence_json", maybe("definition_note"),
        F.coalesce("en_terms", none).alias("en_terms"), F.coalesce("ja_terms", none).alias("ja_terms"), maybe("notes"),
        F.coalesce("row_version", F.lit(0)).alias("row_version"), F.col("safe_for_answer_generation").cast("boolean"), F.col("safe_for_query_expansion").cast("boolean"), maybe("scope_note"), "status",
    ).orderBy("concept_id")
