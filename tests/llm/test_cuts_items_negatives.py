"""Fill in the middle, benchmark decontamination and hard negatives against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import decontamination, fill_in_middle, hard_negatives

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_cut(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(u), form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, most in ((0, 0), (1, 1), (1, 10**6), (5000, 5000), (3000, 40_000), (700, 10**7)):
        numbers = np.sort(rng.choice(np.arange(1, most + 1), n, replace=False))
        held = fill_in_middle.EliasFano(numbers, most)
        assert [held[k] for k in range(0, n, 7)] == numbers[::7].tolist() and (not n or held[n - 1] == numbers[-1])
        bits = 8 * (len(held.upper) + len(held.lower))
        assert bits <= n * (3 + max(1, most // max(1, n)).bit_length()) + 64


def test_fill_in_middle(spark, monkeypatch):
    rng = random.Random(3)
    odd = [None, "", " ", "\n\t", "x", " x", "x ", "a  b\tc\n", "日本 語　é́ 𝒳𝒴 z", "has <S> in it", "a < S>b <", "<P", "tail <M", "word " * 40_000, "w" * 300_000, " " * 5000]
    texts = [rng.choice(odd) if k % 3 else " ".join(rng.choices(["ab", "c,", "\n", "é", "<", ">"], k=rng.randint(0, 40))) for k in range(300)]
    rows = [*enumerate(texts), (7, texts[7]), (7, "another text of seven"), (None, "no id here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("clash"), "part": F.lit(1), "ids": F.lit(2), "n": F.lit(3), "output": F.lit(None)})
    want = collections.Counter((i, *plain_cut(i, t)) for i, t in rows)
    for share in (fill_in_middle.LEAST_PART, 2000):  # few texts split, then many
        monkeypatch.setattr(fill_in_middle, "LEAST_PART", share)
        monkeypatch.setattr(fill_in_middle, "SHARES", fill_in_middle.SHARES if share > 2000 else 100_000)
        got = fill_in_middle.fill_in_middle(docs.repartition(3))
        got = got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        assert collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == want
        assert all(r["back"] == r["output"] for r in got if r["form"] == "plain")
        texts_of = collections.defaultdict(set)
        for i, t in rows:
            texts_of[i].add(t or "")
        assert all(r["back"] in texts_of[r["doc_id"]] for r in got)
    assert {f for _, _, f, *_ in want} == {"plain", "spm", "psm"}
    names = spark.createDataFrame([("x1", "some words in a row")], "doc_id string, text string")
    assert fill_in_middle.fill_in_middle(names, rate=100).first()["form"] != "plain"
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def plain_hits(rows, items, window):
    out = []
    asked = []
    for item, text in items:
        w = words_of(text)
        asked += [("" if item is None else str(item), tuple(w[k : k + window])) for k in range(max(1, len(w) - window + 1)) if w]
    for i, text in rows:
        w, hit, found = words_of(text), set(), set()
        for item, win in asked:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found))))
    return collections.Counter(out)


@pytest.mark.parametrize("most", [decontamination.MOST_BROADCAST, 0])
def test_decontaminate(spark, most):
    rng = random.Random(4)
    vocab = ["aa", "bb", "Cc", "dd", "É", "é", "日本", "e1", "9"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, k=n))
    passage = [text(n) for n in (14, 30, 10, 9, 5, 4, 1)]
    items = [*enumerate(passage), (3, "aa bb aa bb aa bb aa bb aa bb aa"), (40, passage[1].upper()), (None, "zz Zz zz"), (50, None), (51, ""), (52, "?!"), (60, passage[0] + " x"), (61, "never there at all in any of these documents really")]
    rows = [(k, f"{text(rng.randint(0, 30))} q {rng.choice(passage)} q {text(rng.randint(0, 30))}") for k in range(40)]
    rows += [(100, None), (101, ""), (102, " ,"), (103, "aa bb " * 3000), (104, passage[1].replace(" ", "--")), (5, passage[2]), (5, passage[2]), (None, "zz! zz? ZZ zz"), (105, passage[0].rsplit(" ", 1)[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "key": F.lit(2), "win": F.lit("x"), "n_words": F.lit(0)}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"size": F.lit(1), "w": F.lit("y")})
    got, spans, hits = decontamination.decontaminate(docs, bench, most=most)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in got.collect()]
    want = plain_hits(rows, items, 10)
    assert collections.Counter(got) == want and sum(1 for r in want if r[2]) > 20 and sum(1 for r in want if not r[2]) >= 3
    if most:
        assert spans.where("size not between 1 and 10").isEmpty() and hits.count() == sum(r[3] for r in got)
        assert [r["n_hit"] for r in decontamination.decontaminate(docs, bench.limit(0))[0].collect()] == [0] * len(rows)
        assert decontamination.decontaminate(docs.limit(0), bench)[0].count() == 0
        wide = decontamination.decontaminate(docs, bench, window=6, shingle=3)[0]
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in wide.collect()) == plain_hits(rows, items, 6)


def plain_negatives(rows, every=10, k=5):
    best = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, (label, v)), (label, v))
    vec = {i: (label, [int(np.floor(256.0 * x)) for x in v]) for i, (label, v) in best.items()}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a, (la, x) in vec.items():
        if a % every:
            continue
        scored = sorted((-dot(x, y), i, lb) for i, (lb, y) in vec.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == la][:k]:
            fit = [(t, i) for t, i, lb in scored if lb != la and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_hard_negatives(spark, spread):
    rng = np.random.default_rng(5)
    scale = np.exp(rng.normal(size=400) * spread)  # with spread, the bound skips buckets
    rows = [(i, (rng.normal(size=6) * scale[i] / 3).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[20][1], i % 3) for i in range(120)]  # a hot vector
    rows += [(2000, None, 1), (2010, [], 1), (2020, [0.0] * 6, 1), (2030, [1.0, float("nan")], 1), (2040, [1.0, None], 1), (2050, [1.0] * 6, None), (None, [1.0] * 6, 1), (2060, [0.5, -0.25], 2), (10, rows[10][1], rows[10][2]), (30, rows[31][1], 0), (2070, [-1.0] * 6, 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"x": F.lit(1), "norm": F.lit(2), "key": F.lit(3), "run": F.lit(4)}).repartition(3)
    for block, size, side in ((2048, 2048, 4), (16, 32, 2)):
        got = hard_negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, F.col("label"), block=block, size=size, side=side)
        assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    none = vectors.limit(0)
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert hard_negatives.hard_negatives(vectors, F.lit(False), F.col("label")).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(6)
    a, b = (np.floor(rng.normal(size=(5, 7)) * 10.0 ** rng.integers(1, 14, size=(5, 1))) for _ in range(2))
    a[0] = 1e200
    norm = lambda x: np.array([float(np.linalg.norm(r)) for r in x])
    exact = [[max(-(2**63), min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(r, s, strict=True)))) for s in b] for r in a]
    assert hard_negatives.products(a, b, norm(a), norm(b)).tolist() == exact
    for x in (a, np.floor(rng.normal(size=(3, 4)) * 100), np.zeros((0, 4))):
        assert (hard_negatives.unpack(hard_negatives.pack(x), x.shape[1]) == x).all()


def test_buckets_are_skipped(spark, monkeypatch):
    """With norms that differ, few buckets are read; the result is that of reading all."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * (2.0 if i < 60 else 0.01)).tolist(), i % 2) for i in range(3000)]
    data = hard_negatives.Buckets(hard_negatives.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", F.col("label")), 32, 2)
    asked = spark.createDataFrame([(i, 0, i % 2, -(2**63), 2**63 - 1, [float(np.floor(256 * x)) for x in rows[i][1]]) for i in range(40)], "anchor_id long, key long, label long, low long, high long, x array<double>")
    asked = asked.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))
    met, meet = [], hard_negatives._meet

    def count(near, *more):
        met.append(near.count())
        return meet(near, *more)

    monkeypatch.setattr(hard_negatives, "_meet", count)
    got = hard_negatives.search(asked, data, 5, True, 64)
    vec = {i: np.floor(256 * np.array(v)) for i, v, _ in rows}
    for a in range(40):
        want = sorted((-int(vec[a] @ vec[i]), i) for i in vec if i != a and i % 2 == a % 2)[:5]
        assert [(-r["score"], r["vec_id"]) for r in got.where(F.col("anchor_id") == a).orderBy("rank").collect()] == want
    assert met[0] == 1 and met[1] <= 3 < data.runs.count() // 10
