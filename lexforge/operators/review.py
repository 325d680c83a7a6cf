"""Review actions: validation with optimistic versions, application, audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import lexicon as L

EVENT_COLUMNS = "target_type, target_id, action, previous_status, new_status, reviewer, reason_code, reason, evidence_ids, row_version, created_at"


def row_versions(actions: DataFrame) -> DataFrame:
    """(concept_id, row_version): how many events a concept has."""
    return actions.where("target_type = 'concept'").groupBy(F.col("target_id").alias("concept_id")).agg(F.count(F.lit(1)).alias("row_version"))


def _text(name: str, columns) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in columns else F.lit("")


def _some(value: Column) -> Column:
    return F.when(value != "", value)


def validate(rows: DataFrame, concepts: DataFrame, actions: DataFrame) -> DataFrame:
    """rows (file_row and text columns of a review file) with import_status, new_status, new_row_version,
    error_message, and what an applied row needs: act, why, code, previous_status, current_version.

    The action column decides if there is one, else recommended_action; blank, inspect and split are
    skipped. A row must name a known concept, give its reviewer and what its action requires, and if it
    has a version, the one that the concept has after the valid rows before it; a row that fails does
    not move that version. The fold runs per concept over the rows of one file, inside the JVM."""
    cols = rows.columns
    named = rows.withColumns(
        {
            "act": F.lower(_text("action" if "action" in cols else "recommended_action", cols)),
            "id": _text("concept_id", cols),
            "who": _text("reviewer", cols),
            "why": F.coalesce(_some(_text("reason", cols)), _some(_text("review_note", cols))),
            "code": _some(_text("reason_code", cols)),
            "given": F.when(F.col("row_version").cast("string") != "", F.col("row_version").cast("string")) if "row_version" in cols else F.lit(None).cast("string"),
        }
    )
    known = concepts.select(F.col("concept_id").alias("id"), F.col("status").alias("previous_status"))
    named = named.join(known, "id", "left").join(row_versions(actions).select(F.col("concept_id").alias("id"), F.col("row_version").alias("base")), "id", "left")
    named = named.withColumn("base", F.coalesce("base", F.lit(0)).cast("long")).withColumn("number", F.expr("try_cast(trim(given) as long)"))
    fixed_error = (
        F.when(~F.col("act").isin(*L.ACTIONS), F.concat(F.lit("unsupported review action: "), "act"))
        .when(F.col("who") == "", "reviewer is required")
        .when((F.col("act") == "approve") & F.col("why").isNull(), "approve requires reason")
        .when((F.col("act") == "block") & F.col("code").isNull(), "block requires reason_code")
        .when((F.col("act") == "defer") & F.col("why").isNull(), "defer requires reason")
        .when(F.col("previous_status").isNull(), F.concat(F.lit("concept not found: "), "id"))
        .when(F.col("given").isNotNull() & F.col("number").isNull(), F.concat(F.lit("invalid row_version: "), "given"))
    )
    named = named.withColumns({"skip": F.col("act").isin(*L.SKIPPED_ACTIONS), "fixed": fixed_error})
    # Rows that fail by themselves move no version, and rows without or with an unknown id are among them.
    per = named.where(~F.col("skip") & F.col("fixed").isNull()).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("file_row", "number", "base"))).alias("rows"))
    folded = per.select(
        "id",
        F.explode(
            F.expr(
                """aggregate(rows, named_struct('v', rows[0].base, 'out', cast(array() as array<struct<file_row:bigint,version:bigint,wrong:string>>)),
                     (s, r) -> named_struct(
                       'v', if(r.number is null or r.number = s.v, s.v + 1, s.v),
                       'out', array_append(s.out, named_struct('file_row', cast(r.file_row as bigint), 'version', s.v, 'wrong',
                         if(r.number is null or r.number = s.v, cast(null as string),
                           concat('row_version mismatch for ', id, ': expected ', s.v, ', got ', r.number))))),
                     s -> s.out)"""
            )
        ).alias("f"),
    )
    out = named.join(folded.select("f.*").withColumnRenamed("file_row", "_row"), F.col("file_row") == F.col("_row"), "left").withColumn("error", F.when(~F.col("skip"), F.coalesce("fixed", "wrong")))
    ok = ~F.col("skip") & F.col("error").isNull()
    new_status = F.create_map(*[x for k, v in L.ACTIONS.items() for x in (F.lit(k), F.lit(v))])[F.col("act")]
    return out.select(
        *cols,
        F.when(F.col("skip"), "skipped").when(ok, "valid").otherwise("error").alias("import_status"),
        F.when(ok, new_status).otherwise("").alias("new_status"),
        F.when(ok, (F.col("version") + 1).cast("string")).otherwise("").alias("new_row_version"),
        F.coalesce("error", F.lit("")).alias("error_message"),
        "act",
        F.col("id").alias("target"),
        "who",
        "why",
        "code",
        "previous_status",
        F.col("version").alias("current_version"),
    )


def apply_valid(validated: DataFrame, concepts: DataFrame, evidence: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, new events) of a batch in which no row has an error. The last row of a concept decides
    its status; an event holds the version before it and the status that the row before it left."""
    from pyspark.sql import Window

    rows = validated.where("import_status = 'valid'")
    last = rows.groupBy(F.col("target").alias("concept_id")).agg(F.max_by("new_status", "file_row").alias("_status"))
    out = concepts.join(last, "concept_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    ids = evidence.groupBy(F.col("concept_id").alias("target")).agg(F.sort_array(F.collect_list("evidence_key")).alias("evidence_ids"))
    before = F.coalesce(F.lag("new_status").over(Window.partitionBy("target").orderBy("file_row")), F.col("previous_status"))
    events = rows.withColumn("previous", before).join(ids, "target", "left")
    events = events.select(
        F.lit("concept").alias("target_type"),
        F.col("target").alias("target_id"),
        F.col("act").alias("action"),
        F.col("previous").alias("previous_status"),
        "new_status",
        F.col("who").alias("reviewer"),
        F.col("code").alias("reason_code"),
        F.col("why").alias("reason"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
        F.col("current_version").alias("row_version"),
        F.lit(now).alias("created_at"),
    )
    return out, events
