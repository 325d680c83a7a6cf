"""The twelve tables as Parquet snapshots, and the commands over them."""

from __future__ import annotations

import datetime
import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import lexicon as L
from lexforge.operators import concepts as C
from lexforge.operators import export as E
from lexforge.operators import matching as M
from lexforge.operators import merge as G
from lexforge.operators import review as R
from lexforge.operators import terms as T
from lexforge.sources import files, html

BLOCK = "struct<path:string,block_index:int>"
EVIDENCE = "struct<shared_anchors:map<string,array<string>>,heading_token_overlap:array<string>,table_shape_match:boolean,scoring_version:string>"
SCHEMAS = {
    "ingestion_runs": "run_id string, lang string, input_path string, started_at string, completed_at string, documents_seen long, documents_inserted long, documents_updated long, errors long",
    "ingestion_errors": "run_id string, lang string, path string, error string",
    "documents": "lang string, path string, sha256 string, title string, text_excerpt string, source_html string",
    "document_blocks": "lang string, path string, block_index int, block_type string, text string, heading_path string, dom_path string, raw_fragment_hash string",
    "anchors": "lang string, path string, block_index int, anchor_type string, value string, normalized_value string",
    "page_match_candidates": "ja string, en string, score double, match_type string, evidence struct<shared_anchors:map<string,array<string>>,match_scope:string,scoring_version:string>, status string",
    "block_match_candidates": f"ja {BLOCK}, en {BLOCK}, score double, evidence {EVIDENCE}, status string, created_at string",
    "terms": "lang string, normalized_term string, term string, term_type string, status string",
    "term_occurrences": "lang string, normalized_term string, path string, block_index int, source string",
    "concepts": f"concept_id string, concept_type string, category string, canonical_label_ja string, canonical_label_en string, confidence double, confidence_json string, confidence_version string, status string, safe_for_query_expansion boolean, safe_for_answer_generation boolean",
    "concept_terms": "concept_id string, lang string, normalized_term string, confidence double, role string",
    "evidence": f"evidence_key string, concept_id string, ja {BLOCK}, en {BLOCK}, evidence_type string, score double, is_negative_evidence boolean, anchors_json {EVIDENCE}, ja_context string, en_context string",
    "review_actions": "target_type string, target_id string, action string, previous_status string, new_status string, reviewer string, reason_code string, reason string, evidence_ids array<string>, row_version long, created_at string",
}


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")


#: Where a commit keeps the sums of its folders.
MANIFEST = "_manifest"


def _sums(names: list[str]) -> list:
    """Number of rows, and sum and exclusive or of their hashes: the same in any order of rows."""
    row = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("sum"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor")]


def _shown(sums: dict) -> dict:
    return {"rows": int(sums["rows"]), "sum": str(int(sums["sum"])), "xor": int(sums["xor"])}


def _counted(cached: DataFrame) -> int:
    """Rows of a cached table, which is let go."""
    n = cached.count()
    cached.unpersist()
    return n


@dataclass(frozen=True)
class ImportResult:
    rows_seen: int
    actions_valid: int
    actions_applied: int
    skipped: int


class Store:
    """Tables are lists of folders of Parquet files, named by numbered commits. A commit names all
    tables at once, so a command's tables change together or not at all, and what is being read
    is never overwritten. A commit is written under another name and published in one step that fails if its number is
    taken, so there is no number without its whole content, and none is passed over: appended rows are
    added to whatever is newest, and a table that has changed since it was read is not replaced. Old folders stay readable until vacuum()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        #: The folders of each table when it was last read.
        self._seen: dict[str, list[str]] = {}

    def _commits(self) -> list[int]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _tables(self, number: int) -> dict[str, list[str]]:
        if not number:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_commits/{number:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict[str, list[str]]]:
        number = (self._commits() or [0])[-1]
        return number, self._tables(number)

    def _publish(self, number: int, state: dict[str, list[str]]) -> bool:
        """Whether the state has become commit `number`; not if there is one. Local files are linked to their name,
        elsewhere the file system's rename has to refuse a name that exists, as HDFS does."""
        draft = self._path(f"{self.root}/_commits/{uuid.uuid4().hex}.draft")
        final = self._path(f"{self.root}/_commits/{number:09d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if self._fs.getScheme() == "file":
            name = lambda p: p.toUri().getPath()
            try:
                os.link(name(draft), name(final))
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
        done = not self._fs.exists(final) and self._fs.rename(draft, final)
        if not done:
            self._fs.delete(draft, False)
        return done

    def read(self, table: str) -> DataFrame:
        folders = self._newest()[1].get(table, [])
        self._seen[table] = folders
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{table}/{f}" for f in folders])

    def commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None) -> None:
        """Writes the tables' rows, then makes them the newest state in one step."""
        replaced, appended = replaced or {}, appended or {}
        before = self._newest()[1]
        base = {t: self._seen.get(t, before.get(t, [])) for t in replaced}
        new, sums = {}, {}
        for table, df in [*replaced.items(), *appended.items()]:
            new[table] = uuid.uuid4().hex
            names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
            seen = Observation()
            df.select(*names).observe(seen, *_sums(names)).write.parquet(f"{self.root}/{table}/{new[table]}")
            sums[f"{table}/{new[table]}"] = _shown(seen.get)
        while True:
            number, tables = self._newest()
            if any(tables.get(t, []) != base[t] for t in replaced):
                raise RuntimeError("another command has changed the same tables meanwhile; run this one again")
            state = {**tables, **{t: [new[t]] for t in replaced}, **{t: [*tables.get(t, []), new[t]] for t in appended}}
            named = {f"{t}/{f}" for t, folders in state.items() if t != MANIFEST for f in folders}
            state[MANIFEST] = {k: v for k, v in (tables.get(MANIFEST, {}) | sums).items() if k in named}
            if self._publish(number + 1, state):
                self._seen.update({t: state[t] for t in new})
                return

    def write(self, table: str, df: DataFrame) -> DataFrame:
        self.commit({table: df})
        return self.read(table)

    def append(self, table: str, df: DataFrame) -> None:
        self.commit(appended={table: df})

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all commits but the `keep` newest, the folders that none of those names, and what commands that died have
        left. No other command may run meanwhile: what it has written is not named yet."""
        numbers = self._commits()
        used = {(t, f) for n in numbers[-keep:] for t, folders in self._tables(n).items() if t != MANIFEST for f in folders}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_commits/{n:09d}.json"), True)
        for table in SCHEMAS:
            folder = self._path(f"{self.root}/{table}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if (table, s.getPath().getName()) not in used:
                    self._fs.delete(s.getPath(), True)
        self._fs.delete(self._path(f"{self.root}/_staging"), True)
        folder = self._path(f"{self.root}/_commits")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName().endswith(".draft"):
                self._fs.delete(s.getPath(), True)

    def verify(self) -> list[tuple[str, str]]:
        """(table/folder, what is wrong) of the newest state: rows that have changed, are missing or are there twice since they were
        written. Works on a copy of the store as well, as a commit names folders below its root."""
        wrong = []
        for key, want in sorted(self._newest()[1].get(MANIFEST, {}).items()):
            table = key.partition("/")[0]
            names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
            try:
                got = _shown(self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{key}").agg(*_sums(names)).first().asDict())
            except Exception as e:  # a folder or file that is not there or not readable is what this looks for
                wrong.append((key, f"not readable: {type(e).__name__}"))
                continue
            if got != want:
                wrong.append((key, f"{got['rows']} rows for {want['rows']}" if got["rows"] != want["rows"] else "other rows"))
        return wrong

    # --- commands ---

    def ingest(self, lang: str, folder: str) -> dict[str, int]:
        """Reads a folder of pages and replaces what changed, with everything that hangs on it. The run is logged when it
        starts and again when it ends; pages that could not be read are listed in ingestion_errors."""
        run_id, started = str(uuid.uuid4()), now()
        scanned = html.scan_directory(self.spark, folder, lang)
        run = lambda done, *n: self.spark.createDataFrame([(run_id, lang, folder, started, done, *n)], SCHEMAS["ingestion_runs"])
        self.append("ingestion_runs", run(None, 0, 0, 0, 0))
        out, tables, failed, stage = self.merged(html.extract_pages(scanned))
        runs = self.read("ingestion_runs").where(F.col("run_id") != run_id).unionByName(run(now(), out["documents_seen"], out["documents_inserted"], out["documents_updated"], out["errors"]))
        failed = failed.select(F.lit(run_id).alias("run_id"), "lang", "path", "error")
        self.commit({**tables, "ingestion_runs": runs}, {"ingestion_errors": failed} if out["errors"] else {})
        self.unstage(stage)
        return out

    def unstage(self, stage: str) -> None:
        """Deletes the parsed pages of merged(); to be called after its tables are committed."""
        self._fs.delete(self._path(stage), True)

    def merged(self, pages: DataFrame) -> tuple[dict[str, int], dict[str, DataFrame], DataFrame, str]:
        """Counts, the tables that extracted pages change, the pages that failed, and the folder of parsed pages that all these read. What hangs on a changed document goes:
        its blocks, anchors, matches and occurrences. Evidence and concepts stay (see stale_evidence)."""
        keys = ["lang", "path"]
        stage = f"{self.root}/_staging/{uuid.uuid4().hex}"  # parsed once; read by all that follows
        pages.write.parquet(stage)
        pages = self.spark.read.parquet(stage)
        documents, blocks, anchors = html.pages_to_tables(pages.where("error is null"))
        old = self.read("documents")
        state = G.classify_changes(documents, old)
        counts = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
        content = state.where("state in ('inserted', 'updated')").select(*keys)
        changed = state.where("state = 'updated'").select(*keys)
        new_blocks, new_anchors = blocks.join(content, keys, "left_semi"), anchors.join(content, keys, "left_semi")
        block_matches = self.read("block_match_candidates")
        for side in ("ja", "en"):
            gone = changed.where(F.col("lang") == side).select(F.col("path").alias("_p"))
            block_matches = block_matches.join(gone, F.col(f"{side}.path") == F.col("_p"), "left_anti")
        none = self.spark.createDataFrame([], SCHEMAS["term_occurrences"])
        tables = {
            "page_match_candidates": G.drop_dangling(self.read("page_match_candidates"), changed, {"ja": ["ja"], "en": ["en"]}),
            "block_match_candidates": block_matches,
            "term_occurrences": G.replace_children(self.read("term_occurrences"), none, changed, keys),
            "document_blocks": G.replace_children(self.read("document_blocks"), new_blocks, changed, keys),
            "anchors": G.replace_children(self.read("anchors"), new_anchors, changed, keys),
            "documents": G.upsert(old, state.where("state <> 'unchanged'").drop("state"), keys, ["sha256", "title", "text_excerpt", "source_html"]),
        }
        failed = pages.where("error is not null")
        out = {"documents_seen": pages.count(), "documents_inserted": counts.get("inserted", 0), "documents_updated": counts.get("updated", 0) + counts.get("metadata_updated", 0), "blocks_written": new_blocks.count(), "anchors_written": new_anchors.count(), "errors": failed.count()}
        return out, tables, failed, stage

    def stale_evidence(self) -> DataFrame:
        """evidence with is_stale: a block that it names is no longer there, or has another text."""
        blocks = self.read("document_blocks")
        out = self.read("evidence")
        for side in ("ja", "en"):
            now_there = blocks.where(F.col("lang") == side).select(F.struct("path", "block_index").alias(side), F.col("text").alias(f"_{side}"))
            out = out.join(now_there, side, "left")
        fresh = F.col("_ja").eqNullSafe(F.col("ja_context")) & F.col("_en").eqNullSafe(F.col("en_context"))
        return out.withColumn("is_stale", ~fresh).drop("_ja", "_en")

    def match_pages(self, min_score: float = 0.25, k: int = 5) -> int:
        anchors = self.read("anchors").withColumnRenamed("path", "doc")
        new = M.match_pages(anchors, min_score, k, self.read("documents").select("lang", F.col("path").alias("doc"))).withColumn("status", F.lit("candidate")).cache()
        self.write("page_match_candidates", G.upsert(self.read("page_match_candidates"), new, ["ja", "en"], ["score", "match_type", "evidence"]))
        return _counted(new)

    def match_blocks(self, min_score: float = 0.20, k: int = 5) -> int:
        block = F.struct("path", "block_index").alias("block")
        blocks = self.read("document_blocks").select("lang", block, "block_type", "text", "heading_path")
        anchors = self.read("anchors").where("block_index is not null").select("lang", block, "anchor_type", "normalized_value")
        new = M.match_blocks(blocks, anchors, min_score, k).withColumns({"status": F.lit("candidate"), "created_at": F.lit(now())}).cache()
        self.write("block_match_candidates", G.upsert(self.read("block_match_candidates"), new, ["ja", "en"], ["score", "evidence"]))
        return _counted(new)

    def extract_terms(self) -> dict[str, int]:
        found = T.block_terms(self.read("document_blocks")).cache()
        old_terms, old_places = self.read("terms").count(), self.read("term_occurrences").count()
        terms = self.write("terms", G.insert_if_absent(self.read("terms"), T.term_catalog(found), ["lang", "normalized_term"]))
        places = self.write("term_occurrences", G.insert_if_absent(self.read("term_occurrences"), T.occurrences(found), ["lang", "normalized_term", "path", "block_index"]))
        return {"terms_seen": _counted(found), "terms_created": terms.count() - old_terms, "occurrences_created": places.count() - old_places}

    def build_concepts(self, min_score: float = 0.25) -> dict[str, int]:
        pairs = C.match_terms(self.read("block_match_candidates"), self.read("document_blocks"), self.read("term_occurrences"), self.read("terms"), min_score).cache()
        concepts, labels, evidence = C.build_concepts(pairs)
        before = {t: self.read(t).count() for t in ("concepts", "concept_terms", "evidence")}
        labelled = self.read("concept_terms").withColumn("_new", F.lit(0)).unionByName(labels.withColumn("_new", F.lit(1)))
        both = labelled.groupBy("concept_id", "lang", "normalized_term").agg(F.max("confidence").alias("confidence"), F.min_by("role", F.struct("_new", "role")).alias("role"))
        evidence = G.insert_if_absent(self.read("evidence"), evidence, ["evidence_key"], ["score", "ja_context", "en_context"])
        self.commit({"concepts": C.merge_concepts(self.read("concepts"), concepts), "concept_terms": both, "evidence": evidence})
        return {"concepts_seen": C.expand_pairs(pairs).count(), **{f"{t}_created": self.read(t).count() - n for t, n in before.items()}}

    def update_confidence(self, threshold: float = 0.85) -> dict[str, int]:
        evidence = C.gate_evidence(self.read("evidence"), self.read("review_actions"))
        new = self.write("concepts", C.update_confidence(self.read("concepts"), C.score_evidence(C.with_flags(evidence)), threshold))
        by = {r["status"]: r["count"] for r in new.groupBy("status").count().collect()}
        seen = sum(n for status, n in by.items() if status != "blocked")
        return {"concepts_seen": seen, "concepts_updated": seen - by.get("confirmed", 0), "review_ready": by.get("review_ready", 0)}

    def add_evidence(self, rows: DataFrame) -> None:
        self.write("evidence", G.insert_if_absent(self.read("evidence"), rows, ["evidence_key"], ["score", "ja_context", "en_context"]))

    def set_safety_flags(self, concept_id: str, query_expansion: bool, answer_generation: bool) -> None:
        hit = F.col("concept_id") == concept_id
        flags = {"safe_for_query_expansion": query_expansion, "safe_for_answer_generation": answer_generation}
        self.write("concepts", self.read("concepts").withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in flags.items()}))

    def export_review(self, out: str, fmt: str = "csv", status: str = "review_ready", single: bool = False, batch: str | None = None) -> int:
        rows = E.review_queue(*(self.read(t) for t in ("concepts", "concept_terms", "terms", "evidence", "review_actions")), batch or str(uuid.uuid4()), status)
        files.write_rows(rows, out, fmt, single)
        return self.read("concepts").where(F.col("status") == status).count()

    def export_dictionary(self, out: str, fmt: str = "jsonl", safe: str | None = None, single: bool = False) -> int:
        rows = E.dictionary(self.read("concepts"), self.read("concept_terms"), self.read("terms"), self.read("review_actions"), safe)
        files.write_dictionary(rows, out, fmt, single)
        return rows.count()

    def import_review(self, path: str, dry_run: bool = False, report: str | None = None, write_back: str | None = None, single: bool = False) -> ImportResult:
        return self.review(files.read_review_file(self.spark, path), dry_run, report, write_back, single)

    def review(self, rows: DataFrame, dry_run: bool = False, report: str | None = None, write_back: str | None = None, single: bool = False) -> ImportResult:
        """All rows or none: any error raises the first one's message after the report is written."""
        checked = R.validate(rows, self.read("concepts"), self.read("review_actions")).cache()
        n = {r["import_status"]: r["count"] for r in checked.groupBy("import_status").count().collect()}
        shown = [F.col(c) for c in files.report_columns(rows.columns)]
        if report and (dry_run or n.get("error")):
            files.write_rows(checked.orderBy("file_row").select(*shown), report, "csv", single)
        if n.get("error"):
            raise ValueError(checked.where("import_status = 'error'").orderBy("file_row").first()["error_message"])
        valid = n.get("valid", 0)
        if not dry_run and valid:
            concepts, events = R.apply_valid(checked, self.read("concepts"), self.read("evidence"), now())
            self.commit({"concepts": concepts}, {"review_actions": events})
        if not dry_run:
            done = checked.withColumn("import_status", F.when(F.col("import_status") == "valid", "applied").otherwise(F.col("import_status"))).orderBy("file_row").select(*shown)
            for out in filter(None, (report, write_back)):
                files.write_rows(done, out, "csv", single)
        checked.unpersist()
        return ImportResult(sum(n.values()), valid, 0 if dry_run else valid, n.get("skipped", 0))

    def act(self, concept_id: str, action: str, reviewer: str, reason: str | None = None, reason_code: str | None = None, row_version: int | None = None) -> dict:
        """One review action, with what changed."""
        if action.strip().lower() not in L.ACTIONS:
            raise ValueError(f"unsupported review action: {action}")
        row = self.spark.createDataFrame([(1, concept_id, action, reviewer, reason, reason_code, None if row_version is None else str(row_version))], "file_row long, concept_id string, action string, reviewer string, reason string, reason_code string, row_version string")
        before = self.read("concepts").where(F.col("concept_id") == concept_id).first()
        self.review(row)
        version = R.row_versions(self.read("review_actions")).where(F.col("concept_id") == concept_id).first()["row_version"]
        return {"concept_id": concept_id, "action": action, "previous_status": before["status"], "new_status": L.ACTIONS[action.strip().lower()], "row_version": version}
