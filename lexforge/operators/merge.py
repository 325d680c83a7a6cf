"""Snapshot maintenance: change classes, upserts, inserts of new keys, cascading replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_changes(incoming: DataFrame, snapshot: DataFrame) -> DataFrame:
    """incoming (lang, path, sha256, ...) with state: inserted, updated (other content), metadata_updated
    (same content, no stored source) or unchanged. Documents missing from incoming are nobody's change."""
    old = snapshot.select("lang", "path", F.col("sha256").alias("_sha"), F.col("source_html").isNull().alias("_bare"))
    state = F.when(F.col("_sha").isNull(), "inserted").when(F.col("_sha") != F.col("sha256"), "updated").when(F.col("_bare"), "metadata_updated").otherwise("unchanged")
    return incoming.join(old, ["lang", "path"], "left").withColumn("state", state).drop("_sha", "_bare")


def first_of(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the first by `order`, by all other columns if none is given, so equal inputs give equal results."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    by = F.struct(*(order or []), *[c for c in rest if "map<" not in rows.schema[c].dataType.simpleString()])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_first")).select(*[c if c in keys else F.col("_first")[c].alias(c) for c in rows.columns])


def insert_if_absent(snapshot: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """snapshot plus the first of new's rows for each key that it lacks."""
    return snapshot.unionByName(first_of(new, keys, order).join(snapshot.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(snapshot: DataFrame, new: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the columns in `replaced` are new's and the others stay."""
    old = snapshot.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in snapshot.columns if c not in keys], F.lit(True).alias("_had"))
    both = old.join(new.withColumn("_has", F.lit(True)), keys, "full_outer")

    def column(c: str):
        if c not in new.columns:
            return F.col(f"_old_{c}").alias(c)
        if c in replaced:
            return F.when(F.col("_has"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c)
        return F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*keys, *[column(c) for c in snapshot.columns if c not in keys])


def replace_children(child: DataFrame, new: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """child without the rows of changed parents, plus new ones."""
    return child.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def drop_dangling(matches: DataFrame, changed: DataFrame, sides: dict[str, list[str]]) -> DataFrame:
    """matches without those that touch a changed document on any side; sides: column names of (lang, path)."""
    out = matches
    for lang, columns in sides.items():
        gone = changed.where(F.col("lang") == lang).select(F.col("path").alias(columns[0])).distinct()
        out = out.join(gone, columns, "left_anti")
    return out
