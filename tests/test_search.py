"""Search, expansion, variants, assignment, redirects and evaluation against plain Python."""

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexforge.operators import assignment as A
from lexforge.operators import evaluation as V
from lexforge.operators import expansion as P
from lexforge.operators import redirects as R
from lexforge.operators import search as S
from lexforge.operators import variants as W


def plain_terms(text):
    out = []
    for w in re.findall(r"[぀-ヿ一-鿿]+|[^\W_぀-ヿ一-鿿]+", (text or "").lower()):
        wide = re.match(r"[぀-ヿ一-鿿]", w)
        out += [w[k : k + 2] for k in range(len(w) - 1)] if wide and len(w) > 1 else [w]
    return out


def plain_bm25(docs, queries, k):
    words = {d: plain_terms(t) for d, t in docs}
    mean, n = sum(map(len, words.values())) / len(words), len(words)
    df = collections.Counter(t for w in words.values() for t in set(w))
    out = []
    for q, terms in queries.items():
        scores = collections.Counter()
        for d, w in words.items():
            tf = collections.Counter(w)
            for t, weight in terms.items():
                if tf[t]:
                    idf = math.log(1.0 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    scores[d] += weight * round(1e6 * idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)))
        out += [(q, i, d, s) for i, (s, d) in enumerate(sorted((-s, d) for d, s in scores.items())[:k], 1)]
    return sorted((q, i, d, -s) for q, i, d, s in out)


def test_search(spark):
    rng = random.Random(1)
    vocab = ["brake", "Fluid", "燃圧", "バッテリー", "été", "p0a80", "x1", "of", "of", "of", "トルク 締付"]
    topics = [rng.sample(vocab, 4) for _ in range(6)]
    docs = [(i, i % 6, " ".join(rng.choices(topics[i % 6] + ["of"], k=rng.randint(0, 30)))) for i in range(500)] + [(900, 0, None), (901, 1, ""), (902, 2, "?!"), (903, 3, "rare brake")]
    df = spark.createDataFrame(docs, "doc long, topic int, text string").withColumns({"term": F.lit("clash"), "segment": F.lit(1)})
    texts = {f"q{i}": " ".join(rng.choices(vocab, k=rng.randint(1, 5))) for i in range(25)} | {"none": "nothing", "empty": "", "rare": "rare", "null": None}
    queries = spark.createDataFrame(list(texts.items()), "query string, text string")
    want = plain_bm25([(d, t) for d, _, t in docs], {q: dict.fromkeys(plain_terms(t), 1000) for q, t in texts.items()}, 10)
    for segment, order in ((16, ["topic"]), (10_000, [])):
        index = S.build_index(df, order, segment=segment)
        found, counts = S.search(index, S.query_terms(queries, "query", "text"), 10, first=2)
        assert sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in found.collect()) == want
        total = counts.agg(F.sum("segments"), F.sum("scored")).first()
        if segment == 16:  # documents that are alike stand together: whole segments are never scored
            assert total[1] < 0.6 * total[0]
    got, _ = S.search(index, spark.createDataFrame([("a", "brake", 3), ("a", "fluid", 0), (None, "of", 1)], "query string, term string, weight long"), 3)
    assert {r["query"] for r in got.collect()} == {"a"}
    assert S.search(S.build_index(df.limit(0), []), S.query_terms(queries, "query", "text"))[0].count() == 0


def test_automaton_finds_what_substring_search_finds():
    rng = random.Random(2)
    for _ in range(200):
        terms = {"".join(rng.choices("ab燃圧 ", k=rng.randint(1, 4))) for _ in range(6)}
        text = "".join(rng.choices("ab燃圧 ", k=30))
        every = {(s, s + len(t)) for t in terms for s in range(len(text)) if text.startswith(t, s)}
        automaton = P.Automaton(sorted(terms))
        assert set(automaton.occurrences(text)) == every
        whole = {x for x in every if P.whole_words(text, *x)}
        assert set(automaton.matches(text)) == {x for x in whole if not any(o != x and o[0] <= x[0] and o[1] >= x[1] for o in whole)}


@pytest.mark.parametrize("most", [P.MOST_SIGNS, 0])
def test_find_terms(spark, most):
    rng = random.Random(3)
    terms = {"".join(rng.choices("ab燃圧 ", k=rng.randint(1, 4))) for _ in range(25)} | {"fuel pressure", "pressure"}
    texts = ["".join(rng.choices("ab燃圧 ", k=rng.randint(0, 25))) for _ in range(60)] + ["Fuel pressure, fuel pressures PRESSURE", "", None]
    got = P.find_terms(spark.createDataFrame(list(enumerate(texts)), "query int, text string").repartition(3), spark.createDataFrame([(t,) for t in [*terms, ""]], "normalized_term string"), most)
    automaton = P.Automaton(sorted(terms))
    want = {(i, s, t.lower()[s:e]) for i, t in enumerate(texts) if t for s, e in automaton.matches(t.lower())}
    assert {(r["query"], r["start"], r["normalized_term"]) for r in got.collect()} == want and (60, 0, "fuel pressure") in want


def test_expand_queries(spark):
    concepts = spark.createDataFrame([("c1", "confirmed", True, 0.9), ("c2", "confirmed", True, 0.8), ("c3", "confirmed", False, 0.9), ("c4", "candidate", True, 0.9), ("c5", "confirmed", True, 0.7)], "concept_id string, status string, safe_for_query_expansion boolean, confidence double")
    labels = [("c1", "ja", "燃圧"), ("c1", "en", "fuel pressure"), ("c1", "en", "old name"), ("c2", "ja", "始動不良"), ("c2", "ja", "エンジンがかからない"), ("c2", "en", "no start"), ("c3", "ja", "燃圧"), ("c3", "en", "unsafe"), ("c4", "ja", "燃圧"), ("c4", "en", "unconfirmed"), ("c5", "ja", "始動不良"), ("c5", "en", "stall")]
    label_df = spark.createDataFrame(labels, "concept_id string, lang string, normalized_term string")
    terms = spark.createDataFrame([(lang, t, "blocked" if t == "old name" else "active") for lang, t in {(x[1], x[2]) for x in labels}], "lang string, normalized_term string, status string")
    queries = spark.createDataFrame([(1, "エンジンがかからない 燃圧"), (2, "始動不良"), (3, "始動不良 燃圧"), (4, "Fuel pressure 燃圧"), (5, None)], "query int, text string")
    contexts = spark.createDataFrame([("c5", "燃圧")], "concept_id string, normalized_term string")
    show = lambda df: {(r["query"], r["normalized_term"], r["weight"]) for r in df.collect()}
    # of two meanings none without context; unsafe, unconfirmed and blocked ones never
    assert show(P.expand_queries(queries, concepts, label_df, terms)) == {(1, "fuel pressure", 800), (1, "始動不良", 900), (1, "no start", 800), (3, "fuel pressure", 800)}
    assert show(P.expand_queries(queries, concepts, label_df, terms, contexts)) == {(1, "fuel pressure", 800), (1, "始動不良", 900), (1, "no start", 800), (3, "fuel pressure", 800), (3, "stall", 800)}
    assert show(P.expand_queries(queries, concepts, label_df, terms, contexts, most=1)) == {(1, "始動不良", 900), (3, "fuel pressure", 800)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spelling_variants(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices(alphabet, k=rng.randint(1, 9))) for alphabet in ("ab", "abcde", "締付燃圧é") for _ in range(120)}
    words |= {w[: len(w) // 2] + "x" + w[len(w) // 2 :] for w in list(words)[:40]} | {"ababababab", "abababab", "", "z" * 5000, "z" * 4999 + "y"}
    rows = [("en", w) for w in words] + [("ja", w) for w in list(words)[:50]] + [("en", "abcde"), ("en", None), (None, "abcde")]
    got = W.spelling_variants(spark.createDataFrame(rows, "lang string, term string").withColumn("gram", F.lit("clash")).repartition(3))
    want = set()
    for lang in ("en", "ja"):
        mine = sorted({w for k, w in rows if k == lang and w}, key=lambda w: (len(w), w))
        for a, b in itertools.combinations(mine, 2):
            d = 0 if len(a) < 3 else 1 if len(a) < 6 else 2
            if d and len(b) - len(a) <= d and len(b) < 1000 and (e := edit_distance(a, b)) <= d:
                want.add((lang, a, b, e))
    got = {tuple(r) for r in got.collect()}
    assert {r for r in got if len(r[1]) < 1000} == want and len(want) > 300
    assert {(r[1][:2], r[3]) for r in got if len(r[1]) > 1000 and r[0] == "en"} == {("zz", 1)}


def test_spelling_variants_of_dense_words(spark, monkeypatch):
    """Words of few signs share all their pairs of signs: they meet by what is left of them, and only very long ones by pairs of signs."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(5, 9))) for _ in range(300)}, key=lambda w: (len(w), w))
    want = {(a, b, edit_distance(a, b)) for a, b in itertools.combinations(words, 2) if edit_distance(a, b) <= (1 if len(a) < 6 else 2)}
    df, asked, prefixes = spark.createDataFrame([("en", w) for w in words], "lang string, term string"), [], W.prefixes
    monkeypatch.setattr(W, "prefixes", lambda terms: asked.append(terms.count()) or prefixes(terms))
    for longest in (24, 6, 0):
        got = [tuple(r)[1:] for r in W.spelling_variants(df, longest).collect()]
        assert set(got) == want and len(got) == len(want), longest
    assert asked == [0, sum(len(w) > 6 for w in words), len(words)] and len(want) > 900


def test_assignment_of_a_chain(spark):
    """Ever lower scores, of which a round takes one pair: few pairs left end the rounds, and both ways give the same pairs."""
    chain = [(f"j{(k + 1) // 2:02d}", f"e{k // 2:02d}", 1 - k / 100) for k in range(40)] + [(f"x{k}", f"y{k % 3}", 0.5) for k in range(9)]
    df = spark.createDataFrame(chain, "ja string, en string, score double")
    got = {last: A.assign(df, last).collect() for last in (35, 50_000)}
    assert [max(r["round"] for r in rows) for rows in got.values()] == [4, 1]
    pairs = [{tuple(r)[:3] for r in rows} for rows in got.values()]
    assert pairs[0] == pairs[1] == {(f"j{k:02d}", f"e{k:02d}", 1 - 2 * k / 100) for k in range(20)} | {(f"x{k}", f"y{k}", 0.5) for k in range(3)}
    assert A.assign(df.limit(0), 0).count() == 0


def test_assignment(spark):
    rng = random.Random(5)
    for n, scores in ((12, [0.3, 0.5, 0.5, 0.9]), (40, [0.25])):
        edges = {(f"j{rng.randrange(n):02d}", f"e{rng.randrange(n):02d}"): rng.choice(scores) for _ in range(4 * n)}
        rows = [(j, e, s) for (j, e), s in edges.items()] + [(j, e, s / 2) for (j, e), s in list(edges.items())[:3]] + [(None, "e1", 1.0), ("j1", None, 1.0), ("j00", "e00", None)]
        got = A.assign(spark.createDataFrame(rows, "ja string, en string, score double").repartition(3)).collect()
        want, used = set(), set()
        for (j, e), s in sorted(edges.items(), key=lambda x: (-x[1], x[0])):
            if not {j, e} & used:
                used |= {j, e}
                want.add((j, e, s))
        assert {(r["ja"], r["en"], r["score"]) for r in got} == want
        partner = {p: (s, o) for j, e, s in want for p, o in ((j, e), (e, j))}
        rather = lambda p, s, o: p not in partner or (-s, o) < (-partner[p][0], partner[p][1])
        assert not any(rather(j, s, e) and rather(e, s, j) for (j, e), s in edges.items())  # stable
    none = spark.createDataFrame([], "ja string, en string, score double")
    assert A.assign(none).count() == 0
    pages = spark.createDataFrame([("ja", p) for p in "abcdx"] + [("en", p) for p in "pqrsty"], "lang string, page string")
    found = [("a", "p", 0.9), ("b", "q", 0.8), ("b", "r", 0.7), ("c", "s", 0.6), ("d", "s", 0.9), ("x", "t", 0.3)]
    edges = spark.createDataFrame(found, "ja string, en string, score double")
    kinds = {(r["lang"], r["page"]): (r["partner"], r["match_type"]) for r in A.match_types(pages, edges, A.assign(edges)).collect()}
    assert kinds == {
        ("ja", "a"): ("p", "one_to_one"), ("en", "p"): ("a", "one_to_one"), ("ja", "b"): ("q", "one_to_many"), ("en", "q"): ("b", "one_to_many"), ("en", "r"): ("b", "one_to_many"),
        ("ja", "c"): ("s", "many_to_one"), ("ja", "d"): ("s", "many_to_one"), ("en", "s"): ("d", "many_to_one"), ("ja", "x"): ("t", "weak_candidate"), ("en", "t"): ("x", "weak_candidate"), ("en", "y"): (None, "unmatched"),
    }


def test_redirects(spark, monkeypatch):
    rows = [(f"c{i}", f"c{i - 1}") for i in range(1, 10_001)] + [("x", "c500"), ("x", "c500"), ("y", "y"), (None, "a"), ("a", None)]
    rows += [("k1", "k2"), ("k2", "k3"), ("k3", "k1"), ("into", "k1"), ("two", "c1"), ("two", "c2"), ("to2", "two")]
    written, write = [], R.Scratch.write
    monkeypatch.setattr(R.Scratch, "write", lambda self, df, name: (written.append(name), write(self, df, name))[1])
    done, lost = R.resolve(spark.createDataFrame(rows, "old string, new string").repartition(3))
    got = {r["old"]: (r["final"], r["steps"]) for r in done.collect()}
    assert got == {f"c{i}": ("c0", i) for i in range(1, 10_001)} | {"x": ("c0", 501)}
    assert {r["old"] for r in lost.collect()} == {"k1", "k2", "k3", "into", "two", "to2"} and len(written) <= 18
    assert R.resolve(spark.createDataFrame([], "old string, new string"))[0].count() == 0


def test_merge_and_split(spark):
    concepts = spark.createDataFrame([("a", 0.5, "confirmed", True), ("b", 0.9, "candidate", False), ("c", 0.7, "blocked", True)], "concept_id string, confidence double, status string, safe_for_query_expansion boolean")
    labels = spark.createDataFrame([("a", "ja", "t1", 0.5, "label"), ("b", "ja", "t1", 0.9, "label"), ("b", "en", "t2", 0.8, "label"), ("c", "en", "t3", 0.7, "label")], "concept_id string, lang string, normalized_term string, confidence double, role string")
    evidence = spark.createDataFrame([("e1", "a", 0.5, False), ("e2", "b", 0.9, False), ("e3", "b", 0.4, True), ("e4", "c", 0.7, False)], "evidence_key string, concept_id string, score double, is_negative_evidence boolean")
    resolved, _ = R.resolve(spark.createDataFrame([("b", "a"), ("c", "gone")], "old string, new string"))
    c, t, e = R.merge_concepts(concepts, labels, evidence, resolved)
    assert {tuple(r) for r in c.collect()} == {("a", 0.9, "confirmed", False), ("c", 0.7, "blocked", True)}
    assert {(r["concept_id"], r["normalized_term"], r["confidence"]) for r in t.collect()} == {("a", "t1", 0.9), ("a", "t2", 0.8), ("c", "t3", 0.7)}
    assert {(r["evidence_key"], r["concept_id"]) for r in e.collect()} == {("e1", "a"), ("e2", "a"), ("e3", "a"), ("e4", "c")}
    parts = spark.createDataFrame([("e2", "x"), ("e2", "y"), ("e3", "y"), ("e4", "z"), ("no", "z"), (None, "z")], "evidence_key string, part string")
    c, t, e = R.split_concept(concepts, labels, evidence, parts)
    assert {tuple(r) for r in c.collect()} == {("a", 0.5, "confirmed", True), ("b/x", 0.9, "candidate", False), ("b/y", 0.0, "candidate", False), ("c/z", 0.7, "candidate", False)}
    assert {r["concept_id"] for r in t.collect()} == {"a", "b/x", "b/y", "c/z"} and {(r["evidence_key"], r["concept_id"]) for r in e.collect()} == {("e1", "a"), ("e2", "b/x"), ("e3", "b/y"), ("e4", "c/z")}


def test_evaluation(spark):
    rng = random.Random(6)
    found = [(q, r, rng.randrange(8)) for q in range(60) for r in range(1, 6)]
    found = [x for i, x in enumerate(found) if x[2] not in [y[2] for y in found[:i] if y[0] == x[0]]]
    gold = [(q, rng.randrange(8)) for q in range(70)] * 2 + [(0, 1), (0, 2)]
    scores = V.ranking_scores(spark.createDataFrame(found, "query int, rank int, doc int"), spark.createDataFrame(gold, "query int, doc int"))
    got = {r["query"]: r for r in scores.collect()}
    assert len(got) == 70
    for q, r in got.items():
        ranks = sorted(k for p, k, d in found if p == q and (q, d) in set(gold))
        assert (r["rr"], r["p5"], r["h5"], r["h1"]) == (1 / ranks[0] if ranks else 0.0, len(ranks) / 5, float(bool(ranks)), float(1 in ranks))
    rows = [sorted(map(str, V.intervals(scores.repartition(n), [], "query", ["rr", "h1"], 300).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]
    for r in V.intervals(scores, [], "query", ["rr", "h1"], 300).collect():
        values = [x[r["metric"]] for x in got.values()]
        mean = sum(values) / 70
        wide = 2 * 1.96 * (sum((v - mean) ** 2 for v in values) / 70) ** 0.5 / 70**0.5
        assert abs(r["value"] - mean) < 1e-6 and r["low"] < mean < r["high"] and 0.7 * wide < r["high"] - r["low"] < 1.3 * wide


def test_review_sample(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("band"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("weight"))
    rows = rows.unionByName(spark.createDataFrame([(9001, 0, 0.0), (9002, 0, -1.0), (9003, 0, None)], "id long, band long, weight double"))
    draw = lambda n, parts: [(r["band"], r["place"], r["id"]) for r in V.review_sample(rows.repartition(parts), "id", "band", "weight", n).orderBy("band", "place").collect()]
    small, large = draw(50, 1), draw(200, 7)
    assert small == draw(50, 5) and set(small) <= set(large) and len(large) == 600
    heavy = sum(1 for *_, i in large if i % 2 == 0)
    assert 0.68 < heavy / 600 < 0.80  # three of four draws, while few are drawn
    assert not {i for *_, i in large} & {9001, 9002, 9003}


def test_links(spark):
    from urllib.parse import urldefrag, urljoin

    from lexforge.operators import links as N

    bases = ["http://a.example", "http://a.example/", "https://a.example/x/y.html?q=1#f", "http://a.example/x/../y/", "http://a.example?q"]
    hrefs = ["", "#top", "z", "z.html#k", "./z", "../z", "../../../z", "/z/./w/..", "?n=1", "//b.example/p", "ftp://c/d", "z?x=/../y", "a/b/../../c", ".", "..", "&amp;x", "%20 y"]
    rows = [(i * 100 + j, b, f"<p><a class='k' href=\"{h}\">t</a>") for i, b in enumerate(bases) for j, h in enumerate(hrefs)]
    pages = spark.createDataFrame([*rows, (900, None, "<a href=z>"), (901, "http://a.example/", None), (902, "http://a.example/k", "<!-- <a href='no'> --><script>'<a href=\"no\">'</script><A HREF = 'mailto:x@y'>m</A><a name=n>")], "page_id int, url string, html string")
    got = {(r["page_id"], r["place"]): r["target"] for r in N.page_links(pages).collect()}
    for k, b, _ in rows:
        h = hrefs[k % 100].replace("&amp;", "&").strip()
        want = urldefrag(urljoin(b, h))[0] if h and h != "#top" else urldefrag(b)[0]
        assert got[k, 0] in (want, want + "/", want.replace("example?", "example/?")), (b, h)
    assert got[900, 0] is None and got[902, 0] is None and len(got) == len(rows) + 2
    site = spark.createDataFrame([(1, "http://h/a", "<a href=b>x</a><a href='b#k'>y</a><a href='gone'>z</a>"), (2, "http://h/b#f", "<img src=i alt='A &amp; B'><img alt=''>"), (3, "http://h/b", "")], "page_id int, url string, html string")
    assert {tuple(r) for r in N.link_graph(site, N.page_links(site)).collect()} == {(1, "http://h/b", 2, 2), (1, "http://h/gone", 1, None)}
    assert [tuple(r) for r in N.image_texts(site).collect()] == [(2, 0, "A & B")]


def test_translation_table(spark):
    from lexforge.operators import association as B

    rng = random.Random(8)
    blocks = [(f"j{i}", f"e{i}", rng.sample("abcde", 3), rng.sample("vwxyz", 2)) for i in range(30)]
    rows = [(j, e, a, b) for j, e, xs, ys in blocks for a in xs for b in ys]
    table = collections.defaultdict(lambda: 1.0)
    for _ in range(5):
        counts = collections.Counter()
        for _, _, xs, ys in blocks:
            for b in ys:
                total = sum(table[a, b] for a in xs)
                for a in xs:
                    counts[a, b] += table[a, b] / total
        sums = collections.Counter()
        for (a, _), c in counts.items():
            sums[a] += c
        table = {k: c / sums[k[0]] for k, c in counts.items()}
    got = {(r["ja_norm"], r["en_norm"]): r["p"] for r in B.translation_table(spark.createDataFrame([*rows, *rows[:4], ("j1", "e1", None, "v")], "ja string, en string, ja_norm string, en_norm string")).collect()}
    assert got.keys() == table.keys() and all(abs(got[k] - p) < 1e-9 for k, p in table.items())
    assert all(abs(sum(p for (a, _), p in got.items() if a == x) - 1) < 1e-9 for x in "abcde")


def test_split_by_a_column(spark):
    """Parts that a column gives are those that rows give; the query takes its evidence apart once for the result, and reads written tables else."""
    from lexforge import search_queries as Q

    concepts = spark.createDataFrame([(c, 0.5, "confirmed", True) for c in "xyz"], "concept_id string, confidence double, status string, safe_for_query_expansion boolean")
    labels = spark.createDataFrame([(c, "en", f"t{c}", 0.5, "label") for c in "xyz"], "concept_id string, lang string, normalized_term string, confidence double, role string")
    evidence = spark.createDataFrame([("x", "k1", 0.3, False), ("x", "k2", 0.4, True), ("x", "k3", 0.1, False), ("y", "k4", 0.2, False), ("y", "k5", 0.6, None)], "concept_id string, evidence_key string, score double, is_negative_evidence boolean")
    part = F.when(F.col("evidence_key").isin("k1", "k2", "k4"), "a").when(F.col("evidence_key") == "k5", "b")
    want, got = (R.split_concept(concepts, labels, evidence, p) for p in (evidence.select("evidence_key", part.alias("part")), part))
    for w, g in zip(want, got, strict=True):
        assert sorted(map(str, w.collect())) == sorted(map(str, g.collect()))
    assert {(r["concept_id"], r["confidence"]) for r in got[0].collect()} == {("x", 0.5), ("x/a", 0.3), ("y/a", 0.2), ("y/b", 0.6), ("z", 0.5)}
    plan = Q.q_concept_splits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_queries_of_the_same_terms_are_expanded_once(spark):
    """Many queries that hold the same terms cost one expansion: the last plan reads each query once, and contexts come from lists of terms."""
    from lexforge import search_queries as Q

    plan = Q.q_expand_queries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "MapInArrow" not in plan and plan.count("Relation") == 2
    struct = "array<struct<norm:string,term:string>>"
    rows = spark.createDataFrame([([("j", "J")], [("e", "E"), ("f", "F")])] * 5, f"ja_terms {struct}, en_terms {struct}")
    got = Q._contexts(rows)
    assert got.count() == 6 and {r["normalized_term"] for r in got.collect()} == {"j", "e", "f"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
