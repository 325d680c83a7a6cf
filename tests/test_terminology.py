"""The commands end to end on small manuals of our own, and the column functions on trap rows."""

import concurrent.futures
import json
import os
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from lexforge import cli
from lexforge.functions import text as X
from lexforge.operators import concepts as C
from lexforge.operators import matching as M
from lexforge.plans.store import SCHEMAS, Store
from lexforge.sources import files
from lexforge.sources.html import parse_page

JA = """<html><head><title>始動</title><style>p{}</style></head><body><h1>始動系</h1>
<p>エンジンがかからない場合、DTC P0A80 を確認。</p><div class="caution">高電圧に注意。</div>
<table><tr><td>補機バッテリー</td><td>12 V</td></tr><tr><td>燃圧</td><td>304 kPa</td></tr></table>
<h2>締付</h2><ol><li>締付トルク 216 N·m で締める</li></ol><img src="img\\Start_A.PNG"></body></html>"""
EN = """<html><head><title>Starting</title><script>var x = "<p>no</p>";</script></head><body><h1>Starting system</h1>
<p>Engine does not start: check DTC P0A80.<div class="warning">WARNING: high voltage</div>
<table><tr><td>Auxiliary battery<td>12.0 V<tr><td>Fuel pressure<td>304 kPa</table>
<h2>Fastening</h2><ul><li>Tightening torque 216 Nm<li>Plain item</ul><img src="a/start_a.png"></body></html>"""


def test_page_parser():
    p = parse_page(EN)
    assert p["title"] == "Starting" and p["headings"] == ["Starting system", "Fastening"] and p["images"] == ["a/start_a.png"]
    kinds = [(b["block_type"], b["text"]) for b in p["blocks"]]
    assert ("warning", "WARNING: high voltage") in kinds and ("table_row", "Auxiliary battery 12.0 V") in kinds
    assert ("list_item", "Plain item") in kinds and not any("var x" in t for _, t in kinds)
    assert p["blocks"][-1]["heading_path"] == "Starting system > Fastening"
    assert [b["block_type"] for b in parse_page(JA)["blocks"]].count("procedure") == 1
    for empty in (None, "", "<div></div>"):
        assert parse_page(empty)["blocks"] == []


def test_anchors(spark):
    rows = ["DTC P0A80 and p0a80. Tightening torque: 216 N·m. Voltage 12.50 V. Part No. 90915-YZZD1. 0.5 L, 304.0 kPa", "P0A80を 12V系", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").withColumn("n", X.normalize_text(F.col("t"))).select(X.anchors(F.col("n"), F.array(F.lit("x\\A.PNG"), F.lit("/"))).alias("a"))
    got = [None if r["a"] is None else {(a["anchor_type"], a["normalized_value"]) for a in r["a"]} for r in df.collect()]
    assert got[0] == {("dtc", "P0A80"), ("torque", "216 Nm"), ("voltage", "12.5 V"), ("part_number", "90915-YZZD1"), ("volume", "0.5 L"), ("pressure", "304 kPa"), ("image_name", "a.png")}
    assert got[1] == {("image_name", "a.png")}


def test_words_of_a_text_are_taken_once(spark):
    """In a lambda an expression is found again for each element, so the patterns' results must come into it as a variable."""
    rows = spark.createDataFrame([("en", "hub nut torque")], "lang string, text string")
    plan = rows.select(X.terms(F.lit("en"), F.col("text")).alias("t"), X.anchors(F.col("text")).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[A-Za-z][A-Za-z-]*") == 1 and plan.count("s*kPa") == 1


def test_terms(spark):
    rows = [("ja", "エンジン始動不良。補機バッテリー電圧を確認し、締付トルクを点検する。"), ("en", "Engine does not start. Check auxiliary battery voltage and tightening torque."), ("en", "hub"), ("en", "")]
    df = spark.createDataFrame(rows, "lang string, text string").select("lang", X.terms(F.col("lang"), F.col("text")).alias("t"))
    got = [None if r["t"] is None else {t["term"] for t in r["t"]} for r in df.collect()]
    assert {"始動不良", "補機バッテリー", "締付トルク"} <= got[0] and {"engine does not start", "auxiliary battery", "tightening torque", "battery voltage and"} <= got[1]
    assert got[2] == set() and got[3] == set()
    for lang in ("fr", None):
        with pytest.raises(Exception, match="lang must be 'ja' or 'en'"):
            spark.createDataFrame([(lang, "x")], "lang string, text string").select(X.terms(F.col("lang"), F.col("text"))).collect()


def test_match_blocks_like_brute_force(spark):
    rng = random.Random(5)
    blocks, anchors = [], []
    for lang in ("ja", "en"):
        for b in range(40):
            kind, words = rng.choice(["table_row", "paragraph"]), rng.randint(1, 4)
            heading = " ".join(rng.sample(["alpha", "beta", "gamma", "delta"], rng.randint(0, 2)))
            blocks.append((lang, b, kind, " ".join(["w"] * words), heading))
            anchors += [(lang, b, t, f"v{rng.randint(0, 4)}") for t in ("dtc", "voltage") if rng.random() < 0.3]
    bdf = spark.createDataFrame(blocks, "lang string, block int, block_type string, text string, heading_path string")
    adf = spark.createDataFrame(anchors, "lang string, block int, anchor_type string, normalized_value string")
    weight = {"dtc": 0.35, "voltage": 0.25}
    for least in (0.25, 0.2, 0.1, 0.0):
        want = set()
        for _, j, k1, t1, h1 in (b for b in blocks if b[0] == "ja"):
            for _, e, k2, t2, h2 in (b for b in blocks if b[0] == "en"):
                va = lambda lang, b, t: {a[3] for a in anchors if a[:3] == (lang, b, t)}
                s = sum(w for t, w in weight.items() if va("ja", j, t) & va("en", e, t))
                s += 0.1 * bool(set(h1.split()) & set(h2.split())) + 0.1 * (k1 == k2 == "table_row" and t1 == t2)
                if round(s, 6) >= least:
                    want.add((j, e, round(s, 6)))
        found = M.match_blocks(bdf, adf, least, 1000).collect()
        assert {(r["ja"], r["en"], r["score"]) for r in found} == want, least
        for r in found:
            va = lambda lang, b, t: {a[3] for a in anchors if a[:3] == (lang, b, t)}
            both = {t: sorted(va("ja", r["ja"], t) & va("en", r["en"], t)) for t in weight}
            assert r["evidence"]["shared_anchors"] == {t: v for t, v in both.items() if v}
        for k, hot, widest in {0.25: [(3, 0, 1024)], 0.2: [(2, 4, 3), (0, 0, 1024)], 0.1: [(3, 0, 0)], 0.0: [(3, 0, 1024)]}[least]:
            ranked = sorted(want, key=lambda w: (w[0], -w[2], w[1]))
            best = {w for i, w in enumerate(ranked) if sum(v[0] == w[0] for v in ranked[:i]) < k}
            got = {(r["ja"], r["en"], r["score"]) for r in M.match_blocks(bdf, adf, least, k, hot=hot, widest=widest).collect()}
            assert got == best, (least, k, hot, widest)
    with pytest.raises(ValueError):
        M.match_blocks(bdf, adf, 0.25, -1)


def test_value_that_all_share(spark):
    """A value of all blocks costs k pairs for each block, and gives the smallest ids."""
    sides = spark.range(4000).select(F.explode(F.array(F.lit("ja"), F.lit("en"))).alias("lang"), F.col("id").alias("block"))
    blocks = sides.select("lang", "block", F.lit("paragraph").alias("block_type"), F.lit("12 V").alias("text"), F.lit(None).cast("string").alias("heading_path"))
    anchors = sides.select("lang", "block", F.lit("voltage").alias("anchor_type"), F.lit("12 V").alias("normalized_value"))
    got = M.match_blocks(blocks, anchors, 0.2, 2).groupBy("en", "score").count().collect()
    assert {(r["en"], r["score"], r["count"]) for r in got} == {(0, 0.25, 4000), (1, 0.25, 4000)}


def test_pages_with_many_common_values(spark, monkeypatch):
    """Pages that share 27 common values of four types: a row meets few segments, and gets what brute force gets."""
    rng = random.Random(12)
    values = {"dtc": 12, "voltage": 6, "torque": 5, "pressure": 4}
    rows = []
    for i in range(2000):
        for lang in ("ja", "en"):
            lacks = rng.choice([None, None, *values])
            rows += [(lang, f"{lang}{i:05d}", t, f"v{j}") for t, n in values.items() if t != lacks for j in range(n)]
    anchors = spark.createDataFrame(rows, "lang string, doc string, anchor_type string, normalized_value string").repartition(4)
    met, intersect = [], M.segment_pairs

    def counted(*a, **kw):
        out = intersect(*a, **kw)
        met.append(out.count())
        return out

    monkeypatch.setattr(M, "segment_pairs", counted)
    got = {(r["ja"], r["en"], r["score"]) for r in M.match_pages(anchors, 0.25, 3).collect()}
    weight = {"dtc": 0.35, "voltage": 0.25, "torque": 0.25, "pressure": 0.25}
    types = {}
    for _, d, t, _ in rows:
        types.setdefault(d, set()).add(t)
    kinds = {}
    for d, t in types.items():
        kinds.setdefault((d[:2], frozenset(t)), []).append(d)
    want = set()
    for (lang, mine), docs in kinds.items():
        if lang == "ja":
            scored = sorted((-round(min(sum(weight[t] for t in mine & other), 1), 6), e) for (side, other), es in kinds.items() if side == "en" for e in sorted(es)[:3])
            want |= {(d, e, -s) for d in docs for s, e in scored[:3]}
    assert got == want and met and sum(met) <= 3 * 2000


def test_segments_by_sets_of_rows(spark):
    """Each row's best of a segment, told by sets of rows: as by brute force, for several segments, rounds and shares of the Japanese rows."""
    rng = random.Random(21)
    weights = [0.35, 0.2, 0.25, 0.25, 0.25, 0.25, 0.25]
    rows = {s: {i: sorted({f"{t}{rng.randint(0, 12)}" for t in rng.sample("abcdefg", 4) for _ in range(rng.randint(1, 4))}) for i in range(n)} for s, n in (("ja", 60), ("en", 400))}
    ja, en = (spark.createDataFrame([(f"{s}{i:04d}", x) for i, x in rows[s].items()], f"{s} string, x array<string>").repartition(3) for s in ("ja", "en"))
    score = lambda b: round(min(sum(w for i, w in enumerate(weights) if b >> i & 1), 1.0), 6)
    bits = lambda a, b: sum({1 << ord(v[0]) - ord("a") for v in set(a) & set(b)})
    for least, k in ((0.25, 5), (0.6, 2), (0.2, 1000)):
        want = set()
        for j, a in rows["ja"].items():
            all_of = sorted((-score(m), e, m) for e, b in rows["en"].items() if (m := bits(a, b)) and score(m) >= least)
            want |= {(f"ja{j:04d}", f"en{e:04d}", m) for _, e, m in all_of[:k]}
        got = [tuple(r) for r in M.segment_pairs(ja, en, weights, least, k, size=70, growth=2, held=25).collect()]
        assert set(got) == want and len(got) == len(want), (least, k)


def test_confidence(spark):
    rows = [("a", "matched_block_terms", 0.55, False, True, False, False)] * 3 + [("b", "x", 0.72, False, True, True, True), ("b", "y", 0.95, True, False, False, False)]
    df = spark.createDataFrame(rows, "concept_id string, evidence_type string, score double, is_negative_evidence boolean, has_anchor boolean, has_heading boolean, has_table boolean")
    got = {r["concept_id"]: r["final"] for r in C.score_evidence(df).collect()}
    assert got["a"] == pytest.approx(0.30 + 0.24 + 0.16 + 0.055, abs=1e-6)
    assert got["b"] == pytest.approx(0.30 + 0.24 + 0.072 + 0.1 - 0.395, abs=1e-6)


def test_commands(spark, tmp_path):
    for lang, page in (("ja", JA), ("en", EN)):
        (tmp_path / lang / "sub").mkdir(parents=True)
        (tmp_path / lang / "sub" / "start.HTML").write_text(page, encoding="utf-8")
    store = Store(spark, str(tmp_path / "db"))
    assert store.ingest("ja", str(tmp_path / "ja"))["documents_inserted"] == 1
    got = store.ingest("en", str(tmp_path / "en"))
    assert got["documents_inserted"] == 1 and got["errors"] == 0
    again = store.ingest("en", str(tmp_path / "en"))
    assert (again["documents_inserted"], again["documents_updated"], again["blocks_written"]) == (0, 0, 0)
    assert store.read("documents").where("lang = 'en'").first()["path"] == "sub/start.HTML"
    assert store.match_pages() == 1 and store.match_blocks() >= 3
    assert store.read("page_match_candidates").first()["score"] == 1.0
    terms = store.extract_terms()
    assert terms["terms_created"] > 5 and store.extract_terms()["terms_created"] == 0
    made = store.build_concepts()
    assert made["concepts_created"] > 0 and store.build_concepts()["evidence_created"] == 0
    store.update_confidence(0.40)
    ready = store.read("concepts").where("status = 'review_ready'")
    assert ready.count() > 0 and ready.where("safe_for_query_expansion or safe_for_answer_generation").count() == 0
    assert store.export_review(str(tmp_path / "queue")) == ready.count()
    back = files.read_review_file(spark, str(tmp_path / "queue"))
    assert len(back.columns) == 24 and back.count() == ready.count()
    concept = ready.orderBy("concept_id").first()["concept_id"]
    store.export_review(str(tmp_path / "queue2"), "jsonl")
    line = next(p for p in (tmp_path / "queue2").iterdir() if p.name.startswith("part")).read_text(encoding="utf-8").splitlines()[0]
    assert list(json.loads(line)) == sorted(json.loads(line))
    row = lambda *r: spark.createDataFrame([(i + 1, *x) for i, x in enumerate(r)], "file_row long, concept_id string, row_version string, action string, reviewer string, reason string")
    assert store.review(row((concept, "0", "approve", "me", "ok"), (concept, "", "inspect", "", "")), dry_run=True).actions_valid == 1
    with pytest.raises(ValueError, match="row_version mismatch"):
        store.review(row((concept, "0", "approve", "me", "ok"), (concept, "999", "defer", "me", "no")))
    assert store.read("review_actions").count() == 0
    got = store.review(row((concept, "0", "defer", "me", "hm"), (concept, "1", "approve", "me", "ok")), report=str(tmp_path / "report"))
    assert got.actions_applied == 2
    events = store.read("review_actions").orderBy("row_version").collect()
    assert [(e["previous_status"], e["new_status"], e["row_version"]) for e in events] == [("review_ready", "candidate", 0), ("candidate", "confirmed", 1)]
    assert store.export_dictionary(str(tmp_path / "dict")) == 1 and store.export_dictionary(str(tmp_path / "dict2"), "csv", "safe_for_query_expansion") == 0
    store.set_safety_flags(concept, True, False)
    assert store.export_dictionary(str(tmp_path / "dict3"), "csv", "safe_for_query_expansion") == 1
    with pytest.raises(ValueError, match="block requires reason_code"):
        store.act(concept, "block", "me")
    (tmp_path / "en" / "sub" / "start.HTML").write_text(EN.replace("P0A80", "P0A81"), encoding="utf-8")
    assert store.ingest("en", str(tmp_path / "en"))["documents_updated"] == 1
    assert store.read("page_match_candidates").count() == 0 and store.read("block_match_candidates").count() == 0
    assert store.read("evidence").count() > 0
    with pytest.raises(ValueError):
        store.export_review(str(tmp_path / "x"), "xml")
    with pytest.raises(FileNotFoundError):
        store.ingest("ja", str(tmp_path / "none"))


def test_store_commits(spark, tmp_path):
    """Tables of one commit come together; of two writers of a table the second fails; stored explanations and files."""
    for lang, page in (("ja", JA), ("en", EN)):
        (tmp_path / "it's" / lang).mkdir(parents=True)
        (tmp_path / "it's" / lang / "a.html").write_text(page, encoding="utf-8")
    (tmp_path / "it's" / "en" / "deep.html").write_text("<div>" * 3000 + "<p>deep</p>", encoding="utf-8")
    store, other = Store(spark, str(tmp_path / "db")), Store(spark, str(tmp_path / "db"))
    for lang in ("ja", "en"):
        store.ingest(lang, str(tmp_path / "it's" / lang))
    assert [r["completed_at"] is not None for r in store.read("ingestion_runs").collect()] == [True, True]
    assert store.read("documents").where("path = 'deep.html'").count() == 1
    store.match_blocks()
    store.extract_terms()
    store.build_concepts()
    store.update_confidence(0.4)
    row = store.read("concepts").where("confidence > 0").first()
    told = json.loads(row["confidence_json"])
    assert len(told) == 17 and told["final_score"] == row["confidence"] and told["version"] == row["confidence_version"]
    assert store.stale_evidence().where("is_stale").count() == 0
    commits = store._commits()
    old = other._newest
    other._newest = lambda: (commits[-1], store._tables(commits[-1]))
    store.write("terms", store.read("terms"))
    other._newest = iter([(commits[-1], store._tables(commits[-1])), old()]).__next__
    with pytest.raises(RuntimeError, match="another command"):
        other.write("terms", store.read("terms"))
    other._newest = old
    before = store.read("review_actions").count()
    event = store.read("review_actions").limit(0)
    other.append("review_actions", event)
    assert other.read("review_actions").count() == before
    store.vacuum(1)
    assert len(store._commits()) == 1 and store.read("evidence").count() > 0
    (tmp_path / "it's" / "en" / "a.html").write_text(EN.replace("12.0 V", "13.0 V"), encoding="utf-8")
    store.ingest("en", str(tmp_path / "it's" / "en"))
    assert 0 < store.stale_evidence().where("is_stale").count()
    concept = row["concept_id"]
    assert cli.run(store, cli.parser().parse_args(["approve", "--db", "x", "--concept-id", concept, "--reviewer", "me", "--reason", "ok"]))[1] == 0
    out = tmp_path / "dictionary.jsonl"
    assert cli.run(store, cli.parser().parse_args(["export-dictionary", "--db", "x", "--out", str(out)]))[0]["rows_exported"] == 1
    text = out.read_text(encoding="utf-8").splitlines()[0]
    assert text == json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True) and json.loads(text)["confidence_json"] == told
    out = tmp_path / "queue.csv"
    cli.run(store, cli.parser().parse_args(["export-review", "--db", "x", "--out", str(out)]))
    assert out.is_file() and files.read_review_file(spark, str(out)).count() == store.read("concepts").where("status = 'review_ready'").count()


def event_rows(spark, *names):
    return spark.createDataFrame([("concept", n, "approve", "candidate", "confirmed", "me", None, None, [], 1, "now") for n in names], SCHEMAS["review_actions"])


def test_no_commit_is_lost(spark, tmp_path):
    """A slow writer, one that dies, several at once, and one that replaces what another has changed since it read it."""
    store, slow, dead = (Store(spark, str(tmp_path / "db")) for _ in range(3))
    publish, between = slow._publish, []

    def late(number, state):
        if not between:
            between.append(number)
            store.append("review_actions", event_rows(spark, "b"))
        return publish(number, state)

    slow._publish = late
    slow.append("review_actions", event_rows(spark, "a"))
    names = lambda: sorted(r["target_id"] for r in store.read("review_actions").collect())
    assert names() == ["a", "b"] and between == [1]

    def dies(*_):
        raise KeyboardInterrupt

    dead._publish = dies
    with pytest.raises(KeyboardInterrupt):
        dead.append("review_actions", event_rows(spark, "never"))
    (tmp_path / "db" / "_commits" / "half.draft").write_text("{")
    store.append("review_actions", event_rows(spark, "c"))
    with concurrent.futures.ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda n: Store(spark, str(tmp_path / "db")).append("review_actions", event_rows(spark, n)), "defghi"))
    assert names() == list("abcdefghi") and len(store._commits()) == 9
    term = lambda t: spark.createDataFrame([("en", t, t, "x", "active")], SCHEMAS["terms"])
    mine = slow.read("terms").unionByName(term("mine"))
    store.write("terms", term("theirs"))
    with pytest.raises(RuntimeError, match="another command"):
        slow.write("terms", mine)
    slow.write("terms", slow.read("terms").unionByName(term("mine")))
    assert store.read("terms").count() == 2
    store.vacuum(1)
    assert names() == list("abcdefghi") and not [f for f in os.listdir(tmp_path / "db" / "_commits") if f.endswith(".draft")]


def test_manifest(spark, tmp_path):
    """A copy with a changed, a lost or a doubled row is found; one as it was written is not."""
    import shutil

    store = Store(spark, str(tmp_path / "db"))
    store.append("review_actions", event_rows(spark, *"abcd").coalesce(2))
    store.append("review_actions", event_rows(spark, "e"))
    store.write("evidence", spark.createDataFrame([("k", "c", ("p", 1), ("q", 2), "t", 0.5, False, ({"dtc": ["P1"], "torque": []}, [], None, "v"), "x", None)], SCHEMAS["evidence"]))
    assert store.verify() == []
    folder = lambda root: next(p for p in (root / "review_actions").iterdir() if spark.read.parquet(str(p)).count() == 4)
    rows = event_rows(spark, *"abcd")
    bad = {"changed": rows.withColumn("reviewer", F.when(F.col("target_id") == "b", "you").otherwise(F.col("reviewer"))), "lost": rows.where("target_id <> 'b'"), "doubled": rows.unionByName(rows.where("target_id = 'b'")), "twice": rows.unionByName(rows)}
    for name, df in bad.items():
        copy = tmp_path / name
        shutil.copytree(tmp_path / "db", copy)
        df.write.mode("overwrite").parquet(str(folder(copy)))
        assert [k.partition("/")[0] for k, _ in Store(spark, str(copy)).verify()] == ["review_actions"], name
    shutil.copytree(tmp_path / "db", tmp_path / "gone")
    shutil.move(str(folder(tmp_path / "gone")), str(tmp_path / "elsewhere"))
    assert "not readable" in Store(spark, str(tmp_path / "gone")).verify()[0][1]
    shutil.copytree(tmp_path / "db", tmp_path / "other")
    rows.orderBy(F.desc("target_id")).coalesce(1).write.mode("overwrite").parquet(str(folder(tmp_path / "other")))
    assert Store(spark, str(tmp_path / "other")).verify() == []  # order and files do not matter
    store.vacuum(1)
    assert store.verify() == [] and cli.run(store, cli.parser().parse_args(["verify", "--db", "x"])) == ({"wrong": 0}, 0)


def test_scores_do_not_depend_on_partitions(spark):
    """Means that end in a five at the seventh place, and many summands, under several partitionings."""
    rows = [(f"c{i % 40}", "x" if i % 3 else "y", round((i * 7919 % 1000) / 1000 + i % 2 / 1e6, 6), i % 11 == 0, i % 5 == 0, i % 7 == 0, False) for i in range(4000)]
    df = spark.createDataFrame(rows, "concept_id string, evidence_type string, score double, is_negative_evidence boolean, has_anchor boolean, has_heading boolean, has_table boolean")
    got = [sorted(tuple(map(str, r)) for r in C.breakdown(C.score_evidence(df.repartition(n))).collect()) for n in (1, 4, 13)]
    assert got[0] == got[1] == got[2]
    for concept in ("c0", "c7", "c33"):
        mine = [(Decimal(str(s)), n) for c, _, s, n, *_ in rows if c == concept]
        scores = [s for s, n in mine if not n]
        mean = (sum(scores) / len(scores)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        assert next(r for r in C.score_evidence(df).collect() if r["concept_id"] == concept)["mean"] == float(mean)


def test_cli_surface():
    names = cli.parser()._subparsers._group_actions[0].choices
    assert len(names) == 16 and cli.parser().parse_args(["match-blocks", "--db", "x"]).min_score == 0.20
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["ingest", "--db", "x", "--lang", "fr", "--input", "y"])


def test_stream(spark, tmp_path):
    from lexforge.streaming import ingest as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text(EN, encoding="utf-8")
    store = Store(spark, str(tmp_path / "db"))
    for _ in range(2):
        S.merge_batches(store, S.distinct_pages(S.page_stream(spark, str(tmp_path / "in"), "en")), str(tmp_path / "cp")).awaitTermination()
    assert store.read("documents").count() == 1 and store.read("anchors").where("anchor_type = 'dtc'").count() == 2


def test_stream_equals_batch(spark, tmp_path, monkeypatch):
    """A folder that comes as a stream makes the same tables as one that is read at once; failed pages are listed in both."""
    from lexforge.sources import html
    from lexforge.streaming import ingest as S

    for name, page in (("a.html", EN), ("sub/b.HTM", EN.replace("12.0 V", "24 V")), ("sub/bad.html", "<p>x</p>"), ("c.txt", EN)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(page, encoding="utf-8")
    extract = html.extract_pages
    failing = lambda pages: extract(pages).withColumn("error", F.when(F.col("path").endswith("bad.html"), "unreadable").otherwise(F.col("error")))
    monkeypatch.setattr(html, "extract_pages", failing)
    batch, stream = Store(spark, str(tmp_path / "batch")), Store(spark, str(tmp_path / "stream"))
    assert batch.ingest("en", str(tmp_path / "in"))["errors"] == 1
    S.merge_batches(stream, S.page_stream(spark, str(tmp_path / "in"), "en", 1), str(tmp_path / "cp")).awaitTermination()
    for table in ("documents", "document_blocks", "anchors"):
        rows = [sorted(map(str, s.read(table).collect())) for s in (batch, stream)]
        assert rows[0] == rows[1] and rows[0]
    errors = [[(r["path"], r["error"]) for r in s.read("ingestion_errors").collect()] for s in (batch, stream)]
    assert errors[0] == errors[1] == [("sub/bad.html", "unreadable")]
    assert not os.path.exists(tmp_path / "batch" / "_staging") or not os.listdir(tmp_path / "batch" / "_staging")


def test_html_udtf(spark):
    from lexforge.sources import html

    html.extract_html_udtf(spark)
    spark.createDataFrame([(1, EN), (2, None), (3, "")], "id int, html string").createOrReplaceTempView("udtf_pages")
    got = spark.sql("SELECT id, b.* FROM udtf_pages, LATERAL extract_html(html) b").collect()
    want = html.parse_page(EN)["blocks"]
    assert [(r["block_index"], r["text"], r["block_type"]) for r in got] == [(b["block_index"], b["text"], b["block_type"]) for b in want] and {r["id"] for r in got} == {1}


def test_html_udtf_tells_a_failure(spark, monkeypatch):
    """Unknown marked sections and numbers of thousands of digits don't take a page's blocks away; a page that fails ends the query."""
    from lexforge.sources import html

    odd = {1: "<p>a</p><![x y]><p>b</p>", 2: "<p>a</p><![?><p>b</p>", 3: f"<p>a</p><p title='&#{'9' * 5000};'>b &#{'0' * 5000}65; &#{'9' * 5000}; &#x{'0' * 5000}42; &#{'0' * 99};</p>"}
    spark.createDataFrame(list(odd.items()), "id int, html string").createOrReplaceTempView("odd_pages")
    html.extract_html_udtf(spark)
    query = "SELECT id, b.text FROM odd_pages, LATERAL extract_html(html) b ORDER BY id, block_index"
    assert [tuple(r) for r in spark.sql(query).collect()] == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b A \ufffd B \ufffd")]
    monkeypatch.setattr(html, "parse_page", lambda page: 1 // 0)
    html.extract_html_udtf(spark)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        spark.sql(query).collect()
    monkeypatch.undo()
    html.extract_html_udtf(spark)


def test_cut_references():
    """A cut character reference stays as it is, in titles, blocks and attributes; whole ones are decoded."""
    page = parse_page('<html><head><title>A &lt;b&gt; C&amp</title></head><body><h1>x &amp; &#39;y&#39; &quot</h1><p>R&D &ampx; &am</p><p>n &#x41; &#39</p><img src="a?b=1&amp;c=&copy"></body></html>')
    assert page["title"] == "A <b> C&amp" and page["images"] == ["a?b=1&c=&copy"]
    assert [b["text"] for b in page["blocks"]] == ["x & 'y' &quot", "R&D &ampx; &am", "n A &#39"]


def test_terms_of_matches(spark):
    """Terms of matched blocks meet in no broadcast table, and concepts, counts and evidence are those of all pairs."""
    blocks = spark.createDataFrame([("ja", "j", 0, "a"), ("ja", "j", 1, "b"), ("en", "e", 0, "c"), ("en", "e", 1, "d")], "lang string, path string, block_index int, text string")
    terms = {("ja", "j", 0): ["x", "y"], ("ja", "j", 1): ["x", "y"], ("en", "e", 0): ["p", "q", "gone"], ("en", "e", 1): ["q"]}
    found = spark.createDataFrame([(lang, t, path, i) for (lang, path, i), ts in terms.items() for t in ts], "lang string, normalized_term string, path string, block_index int")
    catalog = spark.createDataFrame([("ja", t, t.upper(), "active") for t in "xy"] + [("en", t, t.upper(), "blocked" if t == "gone" else "active") for t in ("p", "q", "gone")], "lang string, normalized_term string, term string, status string")
    matches = [(0, 0, 0.5), (1, 0, 0.75), (1, 1, 0.25), (0, 1, 0.125)]
    struct = "struct<path:string,block_index:int>"
    rows = C.match_terms(spark.createDataFrame([(("j", j), ("e", e), s, (f"{j}{e}",)) for j, e, s in matches], f"ja {struct}, en {struct}, score double, evidence struct<k:string>"), blocks, found, catalog)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    want = [(j, e, s, jt, et) for j, e, s in matches if s >= 0.25 for jt in terms["ja", "j", j] for et in terms["en", "e", e] if et != "gone"]
    pairs = C.expand_pairs(rows)
    assert sorted((r["ja"][1], r["en"][1], r["score"], r["ja_norm"], r["en_norm"]) for r in pairs.collect()) == sorted(want)
    names = {(r["ja_norm"], r["en_norm"]): r["concept_id"] for r in pairs.collect()}
    by = {c: [w for w in want if names[w[3:]] == c] for c in names.values()}
    assert {r["concept_id"]: (r["n"], r["best"]) for r in C.count_pairs(rows).collect()} == {c: (len(w), max(x[2] for x in w)) for c, w in by.items()}
    concepts, labels, evidence = C.build_concepts(rows)
    got = {r["concept_id"]: (r["confidence"], json.loads(r["confidence_json"])["k"], r["canonical_label_ja"], r["canonical_label_en"]) for r in concepts.collect()}
    best = {c: min(w, key=lambda x: (-x[2], x[0], x[1])) for c, w in by.items()}
    assert got == {c: (x[2], f"{x[0]}{x[1]}", x[3].upper(), x[4].upper()) for c, x in best.items()}
    assert labels.count() == 2 * len(by)
    assert sorted((r["concept_id"], r["ja"][1], r["en"][1], r["score"], r["ja_context"], r["en_context"]) for r in evidence.collect()) == sorted((names[w[3:]], *w[:3], "ab"[w[0]], "cd"[w[1]]) for w in want)


def test_terms_are_taken_from_texts_once(spark):
    """Dictionaries, queues, merges and splits read their catalogue from the written terms."""
    from lexforge import queries as Q
    from lexforge import search_queries as S

    for catalog in (Q._exported(spark, "/root/testdata/sf0.001")[2], S._dictionary(spark, "/root/testdata/sf0.001")[4]):
        assert "regexp_extract_all" not in catalog._jdf.queryExecution().optimizedPlan().toString()


def test_matches_and_merged_concepts_are_written_before_they_are_read_again(spark):
    """The driver plans few joins at a time: what pairs share is looked up for written pairs, and a merge reads written concepts."""
    from lexforge import queries as Q

    shared = Q.matched(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert shared.count("Join") == 2 and "Union" not in shared and "Window" not in shared
    assert "Aggregate" not in Q.q_concept_merge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_digests(spark):
    """The digests are those of the lists, in batches of a few rows, and no row holds a concept's whole list."""
    import hashlib

    from lexforge.operators import export as E

    term, struct = "array<struct<norm:string,term:string>>", "struct<path:string,block_index:int>"
    rows = [(("j%d" % (i % 5), i), ("e%d" % (i % 3), i), 0.25 + i % 4 / 8, ("a",) if i % 6 else None, f"J{i}", f"E{i}", [("x", "X")] + [("y", "Y")] * (i % 2), [("p", "P")]) for i in range(40)]
    df = spark.createDataFrame(rows, f"ja {struct}, en {struct}, score double, evidence struct<k:string>, ja_context string, en_context string, ja_terms {term}, en_terms {term}")
    _, _, evidence = C.build_concepts(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = E.evidence_digests(evidence, df)
        got = {r["concept_id"]: tuple(r)[1:] for r in d.select("concept_id", "ids", "types", "files", "n_anchors", "sample_ja_context", "sample_en_context").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r["concept_id"]: (hashlib.sha256(" ".join(r["evidence_ids"]).encode()).hexdigest(), " ".join(r["evidence_types"]), " ".join(r["source_files"]), len(r["anchors"]), r["sample_ja_context"], r["sample_en_context"]) for r in E.evidence_summary(evidence).collect()}
    assert got == want and len(got) == 2 and "collect_list" not in d._jdf.queryExecution().optimizedPlan().toString()
    from lexforge import queries as Q

    assert "collect_list" not in Q.q_evidence_lists(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_a_concepts_evidence_is_held_once(spark):
    """Ids and anchors come from one list, ordered by score and key, and anchors that are null are left out."""
    from lexforge.operators import export as E

    place = "struct<path:string,block_index:int>"
    rows = [("c", k, s, False, "t", (a,) if a else None, ("j", 0), ("e", 1), f"J{k}", f"E{k}") for k, s, a in (("k2", 0.5, "x"), ("k1", 0.5, None), ("k3", 0.9, "y"))]
    got = E.evidence_summary(spark.createDataFrame(rows, f"concept_id string, evidence_key string, score double, is_negative_evidence boolean, evidence_type string, anchors_json struct<a:string>, ja {place}, en {place}, ja_context string, en_context string"))
    (row,) = got.collect()
    assert (row["evidence_ids"], row["anchors"], row["sample_ja_context"], row["source_files"]) == (["k3", "k1", "k2"], ['{"a":"y"}', '{"a":"x"}'], "Jk3", ["e", "j"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
