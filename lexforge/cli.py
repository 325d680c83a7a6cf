"""python -m lexforge.cli COMMAND --db FOLDER ...: the commands over a store."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession

from lexforge.plans.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexforge")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options):
        p = sub.add_parser(name)
        p.add_argument("--db", required=True)
        for flag, how in options:
            p.add_argument(flag, **how)

    need, text, number, whole = {"required": True}, {}, lambda d: {"type": float, "default": d}, lambda d: {"type": int, "default": d}
    command("init-db")
    command("verify")
    command("ingest", ("--lang", {"required": True, "choices": ["ja", "en"]}), ("--input", need))
    command("match-pages", ("--min-score", number(0.25)), ("--top-k", whole(5)))
    command("match-blocks", ("--min-score", number(0.20)), ("--top-k", whole(5)))
    command("extract-terms")
    command("build-concepts", ("--min-score", number(0.25)))
    command("update-confidence", ("--review-ready-threshold", number(0.85)))
    command("export-review", ("--out", need), ("--format", {"choices": ["csv", "jsonl"], "default": "csv"}), ("--status", {"default": "review_ready"}))
    command("import-review", ("--input", need), ("--dry-run", {"action": "store_true"}), ("--report", text), ("--write-back", text))
    one = (("--concept-id", need), ("--reviewer", need), ("--row-version", {"type": int}))
    command("approve", *one, ("--reason", need))
    command("defer", *one, ("--reason", need))
    command("block", *one, ("--reason-code", need), ("--reason", text))
    command("export-dictionary", ("--out", need), ("--format", {"choices": ["jsonl", "csv"], "default": "jsonl"}))
    command("export-query-expansion", ("--out", need))
    command("export-rag-safe", ("--out", need))
    return top


def run(store: Store, a: argparse.Namespace) -> tuple[dict, int]:
    if a.command == "init-db":
        return {"db": a.db}, 0
    if a.command == "verify":
        wrong = store.verify()
        return {"wrong": len(wrong), **dict(wrong)}, int(bool(wrong))
    if a.command == "ingest":
        out = store.ingest(a.lang, a.input)
        return out, int(out["errors"] > 0)
    if a.command == "match-pages":
        return {"page_candidates_written": store.match_pages(a.min_score, a.top_k)}, 0
    if a.command == "match-blocks":
        return {"block_candidates_written": store.match_blocks(a.min_score, a.top_k)}, 0
    if a.command == "extract-terms":
        return store.extract_terms(), 0
    if a.command == "build-concepts":
        return store.build_concepts(a.min_score), 0
    if a.command == "update-confidence":
        return store.update_confidence(a.review_ready_threshold), 0
    if a.command == "export-review":
        batch = str(uuid.uuid4())
        return {"rows_exported": store.export_review(a.out, a.format, a.status, single=True, batch=batch), "out": a.out, "export_batch_id": batch}, 0
    if a.command == "import-review":
        r = store.import_review(a.input, a.dry_run, a.report, a.write_back, single=True)
        return {"rows_seen": r.rows_seen, "actions_valid": r.actions_valid, "actions_applied": r.actions_applied, "skipped": r.skipped, **{k: v for k, v in (("report", a.report), ("write_back", a.write_back)) if v}}, 0
    if a.command in ("approve", "block", "defer"):
        return store.act(a.concept_id, a.command, a.reviewer, a.reason, getattr(a, "reason_code", None), a.row_version), 0
    safe = {"export-dictionary": None, "export-query-expansion": "safe_for_query_expansion", "export-rag-safe": "safe_for_answer_generation"}[a.command]
    return {"rows_exported": store.export_dictionary(a.out, getattr(a, "format", "jsonl"), safe, single=True), "out": a.out}, 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    shown, code = run(Store(spark, a.db), a)
    for k, v in shown.items():
        print(f"{k}={v}")
    return code


if __name__ == "__main__":
    raise SystemExit(main())
