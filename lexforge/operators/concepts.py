"""Concepts from matched blocks, their confidence, and their merge into a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import lexicon as L
from lexforge.functions import text as X
from lexforge.plans.scratch import spread

MICRO = 1_000_000.0


def match_terms(matches: DataFrame, blocks: DataFrame, found: DataFrame, catalog: DataFrame, min_score: float = 0.25) -> DataFrame:
    """(ja, en, score, evidence, ja_context, en_context, ja_terms, en_terms): a row for each match, with both blocks' terms as
    arrays of (norm, term), so that only single rows of matches and blocks are shuffled.

    matches: ja and en as struct<path, block_index>. Blocked matches and blocked terms take no part. Surfaces are looked up
    once for each distinct list of terms. Sizes of tables that are derived from small files are not known to the planner, and
    written ones take many times their size in memory: so these joins are never broadcast."""
    good = matches.where((F.col("score") >= min_score) & (F.coalesce("status", F.lit("candidate")) != "blocked")) if "status" in matches.columns else matches.where(F.col("score") >= min_score)
    listed = found.groupBy("lang", "path", "block_index").agg(F.sort_array(F.collect_list("normalized_term")).alias("norms"))
    each = listed.select("lang", "norms").distinct().select("lang", "norms", F.explode("norms").alias("normalized_term"))
    labels = catalog.where("status <> 'blocked'").select("lang", "normalized_term", "term")
    named = each.join(labels.hint("merge"), ["lang", "normalized_term"]).groupBy("lang", "norms").agg(F.sort_array(F.collect_list(F.struct(F.col("normalized_term").alias("norm"), "term"))).alias("terms"))
    live = listed.join(named.hint("merge"), ["lang", "norms"]).drop("norms").join(blocks.select("lang", "path", "block_index", "text").hint("merge"), ["lang", "path", "block_index"])
    side = lambda lang: live.where(F.col("lang") == lang).select(F.struct("path", "block_index").alias(lang), F.col("terms").alias(f"{lang}_terms"), F.col("text").alias(f"{lang}_context")).hint("merge")
    return good.select("ja", "en", "score", "evidence").join(side("ja"), "ja").join(side("en"), "en")


def each_pair(rows: DataFrame) -> DataFrame:
    """rows of match_terms(), or of lists of terms, times the terms of both sides."""
    out = rows.withColumn("_j", F.explode("ja_terms")).withColumn("_e", F.explode("en_terms"))
    out = out.withColumns({f"{lang}_{c}": F.col(f"_{lang[0]}.{c}") for c in ("norm", "term") for lang in ("ja", "en")})
    return out.withColumn("concept_id", X.concept_id(F.col("ja_norm"), F.col("en_norm"))).drop("_j", "_e", "ja_terms", "en_terms")


def expand_pairs(rows: DataFrame) -> DataFrame:
    """Rows of match_terms() as one row for each pair of terms: the Japanese block's times the English block's. Dealt anew,
    as every row becomes many."""
    return each_pair(rows.repartition(spread(rows.sparkSession), "ja", "en"))


def count_pairs(rows: DataFrame) -> DataFrame:
    """(concept_id, n, best) of rows of match_terms(): a concept's expanded pairs, counted by lists of terms first."""
    lists = rows.groupBy("ja_terms", "en_terms").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    return each_pair(lists).groupBy("concept_id").agg(F.sum("n").alias("n"), F.max("score").alias("best"))


def evidence_key(kind: Column) -> Column:
    """The key of a piece of evidence of a type, from concept_id, ja and en."""
    return F.sha2(F.concat_ws("|", "concept_id", F.col("ja.path"), F.col("ja.block_index"), F.col("en.path"), F.col("en.block_index"), kind), 256)


def build_concepts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """concepts, concept_terms and evidence of rows of match_terms(); one row for each key.

    Matches whose blocks have the same lists of terms are summed up before the lists are expanded; evidence is made
    unique as matches, since two blocks' terms make a concept once."""
    place = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("ja", "en") for c in ("path", "block_index")]
    order = F.struct((-F.col("score")).alias("s"), *place)
    lists = rows.groupBy("ja_terms", "en_terms").agg(F.max("score").alias("score"), F.min_by("evidence", order).alias("evidence"), F.min(order).alias("order"))
    pairs = each_pair(lists)
    best = F.to_json(F.min_by("evidence", "order")).alias("confidence_json")
    concepts = pairs.groupBy("concept_id").agg(F.max("score").alias("confidence"), best, F.min("ja_term").alias("canonical_label_ja"), F.min("en_term").alias("canonical_label_en"))
    concepts = concepts.select("concept_id", F.lit("term_pair").alias("concept_type"), F.lit("unknown").alias("category"), "canonical_label_ja", "canonical_label_en", "confidence", "confidence_json", F.lit("candidate").alias("status"), F.lit(False).alias("safe_for_query_expansion"), F.lit(False).alias("safe_for_answer_generation"))
    both = pairs.select("concept_id", "score", F.explode(F.array(F.struct(F.lit("ja").alias("lang"), F.col("ja_norm").alias("normalized_term")), F.struct(F.lit("en").alias("lang"), F.col("en_norm").alias("normalized_term")))).alias("t"))
    concept_terms = both.groupBy("concept_id", "t.lang", "t.normalized_term").agg(F.max("score").alias("confidence")).withColumn("role", F.lit("label"))
    first = F.min_by(F.struct("score", "evidence", "ja_context", "en_context", "ja_terms", "en_terms"), F.struct((-F.col("score")).alias("s"), F.to_json("evidence").alias("j"), "ja_context", "en_context"))
    once = rows.repartition(spread(rows.sparkSession), "ja", "en").groupBy("ja", "en").agg(first.alias("f")).select("ja", "en", "f.*")
    ids = F.array_distinct(F.flatten(F.transform("ja_terms", lambda j: F.transform("en_terms", lambda e: X.concept_id(j["norm"], e["norm"])))))
    once = once.select(F.explode(ids).alias("concept_id"), "ja", "en", "score", "evidence", "ja_context", "en_context")
    evidence = once.select(evidence_key(F.lit(L.EVIDENCE_TYPE)).alias("evidence_key"), "concept_id", "ja", "en", F.lit(L.EVIDENCE_TYPE).alias("evidence_type"), "score", F.lit(False).alias("is_negative_evidence"), F.col("evidence").alias("anchors_json"), "ja_context", "en_context")
    return concepts, concept_terms, evidence


def merge_concepts(snapshot: DataFrame, new: DataFrame) -> DataFrame:
    """New concepts come in as candidates. Known ones, unless confirmed, take the larger confidence and
    the new explanation if its score is not smaller; everything else of them stays."""
    old = snapshot.select("concept_id", *[F.col(c).alias(f"o_{c}") for c in snapshot.columns if c != "concept_id"])
    both = old.join(new, "concept_id", "full_outer")
    known, fixed = F.col("o_status").isNotNull(), F.col("o_status") == "confirmed"
    raised = known & ~fixed & F.col("confidence").isNotNull()

    def column(c: str) -> Column:
        old_c, new_c = F.col(f"o_{c}"), F.col(c) if c in new.columns else F.lit(None)
        if c == "confidence":
            return F.when(raised, F.greatest(old_c, new_c)).when(known, old_c).otherwise(new_c).alias(c)
        if c == "confidence_json":
            return F.when(raised & (F.col("o_confidence") <= F.col("confidence")), new_c).when(known, old_c).otherwise(new_c).alias(c)
        return F.when(known, old_c).otherwise(new_c).alias(c)

    return both.select("concept_id", *[column(c) for c in snapshot.columns if c != "concept_id"])


def gate_evidence(evidence: DataFrame, actions: DataFrame) -> DataFrame:
    """Evidence of confirmed consistency counts only for concepts that a reviewer has ever approved."""
    approved = actions.where(F.col("action").isin("approve", "confirm") & (F.col("new_status") == "confirmed")).select(F.col("target_id").alias("concept_id")).distinct()
    gated = evidence.where(F.col("evidence_type") == L.GATED_EVIDENCE).join(approved, "concept_id", "left_semi")
    return evidence.where(F.col("evidence_type") != L.GATED_EVIDENCE).unionByName(gated)


def score_evidence(evidence: DataFrame) -> DataFrame:
    """(concept_id, 12 parts, final), all to 6 places: one hash aggregation over a concept's evidence.

    evidence: concept_id, evidence_type, score, is_negative_evidence, has_anchor, has_heading, has_table. Scores count in
    millionths and sums are whole numbers, halves up, so no order of rows and no partitioning changes a figure."""
    neg = F.coalesce("is_negative_evidence", F.lit(False))
    micro = F.round(F.col("score") * MICRO).cast("long")
    flag = lambda c: F.coalesce(F.max(F.when(~neg, F.col(c))), F.lit(False))
    agg = evidence.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.count_if(~neg).alias("n_pos"),
        F.count_if(neg).alias("n_neg"),
        F.coalesce(F.max(F.when(~neg, micro)), F.lit(0)).alias("_best"),
        F.coalesce(F.sum(F.when(~neg, micro)), F.lit(0)).alias("_sum"),
        F.greatest(F.count_if(~neg), F.lit(1)).alias("_n"),
        F.coalesce(F.sum(F.when(neg, micro)), F.lit(0)).alias("_against"),
        F.sort_array(F.collect_set(F.when(~neg, F.col("evidence_type")))).alias("evidence_types"),
        flag("has_anchor").alias("anchor"),
        flag("has_heading").alias("heading"),
        flag("has_table").alias("table"),
    )
    # Parts in hundredths of a millionth; only the lexical one, a tenth of the mean, is a fraction, of _n.
    whole = {
        "section_match_score": "least(30000000L, _best * 55)",
        "anchor_match_score": "if(anchor, 24000000L, 0L)",
        "evidence_diversity_score": "least(22000000L, greatest(0L, size(evidence_types) - 1L) * 22000000)",
        "frequency_score": "least(16000000L, greatest(0L, n_pos - 1) * 8000000)",
        "heading_score": "if(heading, 5000000L, 0L)",
        "table_score": "if(table, 5000000L, 0L)",
        "negative_penalty": "least(45000000L, n_neg * 30000000 + _against * 10)",
        "safety_penalty": "0L",
    }
    lexical = "least(8000000 * _n, _sum * 10)"
    less = ("negative_penalty", "safety_penalty")
    sum_of = " + ".join(f"_{c}" for c in whole if c not in less) + "".join(f" - _{c}" for c in less)
    total = f"greatest(0L, least(100000000 * _n, ({sum_of}) * _n + {lexical}))"
    parts = {c: _millionths(f"_{c}", "100") for c in whole} | {"lexical_score": _millionths(lexical, "(100 * _n)")}
    sums = {"mx": F.col("_best") / MICRO, "mean": _millionths("_sum", "_n")}
    out = agg.withColumns({f"_{c}": F.expr(e) for c, e in whole.items()}).withColumns(sums | parts | {"final": _millionths(total, "(100 * _n)")})
    return out.select("concept_id", "evidence_count", "n_pos", "n_neg", "evidence_types", *sums, *parts, "final")


def _millionths(number: str, over: str) -> Column:
    """number / over to the nearest whole number, halves up, as so many millionths."""
    return F.expr(f"(2 * ({number}) + {over}) div (2 * {over})") / MICRO


def breakdown(scored: DataFrame) -> DataFrame:
    """scored with confidence_json, the parts of a concept's score as JSON, numbers to 6 places, and confidence_version."""
    values = {
        "version": F.lit(L.SCORING_VERSIONS["confidence"]),
        "evidence_count": F.col("n_pos"),
        "negative_evidence_count": F.col("n_neg"),
        "evidence_type_count": F.size("evidence_types"),
        "evidence_types": F.col("evidence_types"),
        **{k: F.col(c) for k, c in L.BREAKDOWN.items()},
    }
    return scored.withColumns({"confidence_json": F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)])), "confidence_version": values["version"]})


def no_breakdown() -> Column:
    """What a concept without evidence has."""
    counts = ["evidence_count", "negative_evidence_count", "evidence_type_count"]
    values = {"version": F.lit(L.SCORING_VERSIONS["confidence"]), "evidence_types": F.array().cast("array<string>"), **dict.fromkeys(counts, F.lit(0)), **dict.fromkeys(L.BREAKDOWN, F.lit(0.0))}
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def with_flags(evidence: DataFrame) -> DataFrame:
    """evidence with has_anchor, has_heading and has_table from its match explanation."""
    a = F.col("anchors_json")
    return evidence.withColumns(
        {
            "has_anchor": F.coalesce(F.exists(F.map_values(a["shared_anchors"]), lambda v: F.size(v) > 0), F.lit(False)),
            "has_heading": F.coalesce(F.size(a["heading_token_overlap"]) > 0, F.lit(False)),
            "has_table": F.coalesce(a["table_shape_match"], F.lit(False)),
        }
    )


def update_confidence(concepts: DataFrame, scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """concepts with new confidence, its breakdown and status. Blocked and confirmed ones stay as they are; a concept
    without evidence falls to 0 and candidate."""
    scored = breakdown(scored).select("concept_id", F.col("final").alias("_new"), F.col("confidence_json").alias("_json"))
    rows = concepts.join(scored, "concept_id", "left")
    frozen = F.col("status").isin("blocked", "confirmed")
    values = {"confidence": F.coalesce("_new", F.lit(0.0)), "confidence_json": F.coalesce("_json", no_breakdown()), "confidence_version": F.lit(L.SCORING_VERSIONS["confidence"])}
    rows = rows.withColumns({c: F.when(frozen, F.col(c) if c in concepts.columns else F.lit(None)).otherwise(v) for c, v in values.items()})
    return rows.withColumn("status", X.status_after_score(F.col("status"), F.col("confidence"), threshold)).drop("_new", "_json")
