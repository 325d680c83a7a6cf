"""Language ID: one Bloom filter of n-grams whose slots hold a bit for each language."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.bpe import text_runs
from lexforge.llm.common import crc_fold, dropped, text_slices, written

U = np.uint64
#: Bytes of an n-gram. Long ones tell languages apart even if some texts of a language hold passages of another one; short ones
#: are there for texts of short words.
SIZES = (4, 7)
#: Slots of the filter for each n-gram in it, at least.
SLOTS_PER_GRAM = 8
#: What the filters may fill, in bytes. Past it there are fewer slots for an n-gram and more false hits, which are measured
#: and corrected; no n-gram is left out.
MOST_BYTES = 1 << 28
#: Slots that a task packs at a time.
SLICE = 20
_IN_WORD = np.zeros(256, np.uint8)
_IN_WORD[128:] = np.arange(128, 256)
_IN_WORD[97:123] = np.arange(97, 123)
#: The odd multipliers of the three hash functions, and the bits of each byte.
_ODD = (U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93))
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)
#: What is no letter and would pass for one, being longer than a byte.
_NO_LETTER = regex.compile(r"[^\x00-\x7F\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def plain(text: str | None) -> str:
    """Lower-cased, with a space for each run of signs beyond ASCII that are no letters or marks."""
    text = (text or "").lower()
    return text if text.isascii() else _NO_LETTER.sub(" ", text)


def grams(buf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, n-gram) of the texts of a byte array: `size` bytes of a word, or one less with its end, as a number that also
    tells the size. None reaches over two words or two texts."""
    m = np.zeros(len(buf) + size + 1, np.uint8)
    m[1 : len(buf) + 1] = _IN_WORD[buf]
    many = len(m) - size + 1
    inner = (m[:many] != 0) | (m[size - 1 : size - 1 + many] != 0)
    for k in range(1, size - 1):
        inner &= m[k : k + many] != 0
    at = np.flatnonzero(inner)
    gram = np.full(len(at), size << 56, np.uint64)
    for k in range(size):
        gram |= m[at + k].astype(np.uint64) << U(8 * k)
    return at, gram


def slots_of(gram: np.ndarray, bits: int):
    h = gram.astype(np.uint64) + U(1)
    for odd in _ODD:
        yield (h * odd >> U(64 - bits)).astype(np.int32)


def slot_bits(grams: int, languages: int) -> int:
    """How many bits number the slots: enough for all n-grams, within MOST_BYTES."""
    wanted = max(10, int(np.ceil(np.log2(max(1, grams * SLOTS_PER_GRAM)))))
    return min(wanted, max(10, int(np.log2(MOST_BYTES // -(-max(1, languages) // 8)))))  # at most 28, so slots fit 32 bits


class LanguageFilters:
    """names: languages. planes: an array for each eight languages, with a byte for each slot and a bit for each language; see learn().

    The filter gives all languages of an n-gram and, rarely, others."""

    def __init__(self, names: list[str], planes: list[np.ndarray], default: int = 0):
        self.names, self.default, self.planes = names, default, planes
        if not names:
            return
        self.bits = len(planes[0]).bit_length() - 1
        share = [float(np.mean(planes[i >> 3] >> np.uint8(i & 7) & np.uint8(1))) for i in range(len(names))]
        #: How often an n-gram that a language lacks passes for one of its own.
        self.false = np.array(share) ** len(_ODD)

    def hits(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts' n-grams, [text, language] popcounts)."""
        total, out = np.zeros(len(bounds) - 1, np.int64), np.zeros((len(bounds) - 1, len(self.names)))
        for size in SIZES:
            total += self._add(*grams(buf, size), bounds, out)
        return total, out

    def _add(self, at: np.ndarray, gram: np.ndarray, bounds: np.ndarray, out: np.ndarray) -> np.ndarray:
        cut = np.searchsorted(at, bounds)
        n, slots = np.diff(cut), list(slots_of(gram, self.bits))
        for p, plane in enumerate(self.planes):
            mask = plane[slots[0]]
            for q in slots[1:]:
                mask &= plane[q]
            here = out[:, 8 * p : 8 * p + 8]
            for first in range(0, len(n), 2048):  # how often each set of languages occurs in a text
                last = min(first + 2048, len(n))
                of = np.repeat(np.arange(last - first) << 8, n[first:last]) + mask[cut[first] : cut[last]]
                sets = np.bincount(of, minlength=(last - first) << 8).reshape(-1, 256)
                here[first:last] += sets @ _BITS[:, : here.shape[1]]
        return n

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Language of the largest corrected popcount, and its part of all languages' corrected
        popcounts. und and 0 without letters; the commonest language and 0 without known n-grams."""
        lang, score = [], np.zeros(len(texts))
        for first, last, buf, bounds in text_slices([plain(t) for t in texts]):
            n, hit = self.hits(buf, bounds)
            real = np.maximum((hit - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)), 0)
            total, best = real.sum(axis=1), real.argmax(axis=1)
            for i in range(last - first):
                if not _LETTER.search(texts[first + i] or ""):
                    lang.append("und")
                elif total[i] > 0:
                    lang.append(self.names[best[i]])
                    score[first + i] = real[i, best[i]] / total[i]
                else:
                    lang.append(self.names[self.default])
        return lang, score


def learn(rows: DataFrame) -> LanguageFilters:
    """From all rows of (lang, text) with a language. Null and empty texts have no n-grams; repeated rows count
    each time; no rows give filters without languages. A language has every n-gram that occurs in its texts.
    Tasks find the n-grams of their own rows; the slots' bits are set and packed on executors, and the driver gets nothing but the filters'
    bytes, MOST_BYTES at most."""

    def count(batches):
        held: dict[str, list] = {}

        def merged(parts):
            key = np.concatenate([k for k, _ in parts])
            key, back = np.unique(key, return_inverse=True)
            return key, np.bincount(back, np.concatenate([c for _, c in parts]), len(key)).astype(np.int64)

        for batch in batches:
            kind = np.array(batch.column(0).to_pylist(), object)
            for a, b in text_runs(batch.column(1)):
                texts = [plain(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                own: dict[str, list] = {}
                for first, last, buf, bounds in text_slices(texts):
                    for size in SIZES:
                        at, gram = grams(buf, size)
                        cut = np.searchsorted(at, bounds)
                        for i in range(first, last):
                            own.setdefault(kind[a + i], []).append(gram[cut[i - first] : cut[i - first + 1]])
                for name, parts in own.items():
                    mine = held.setdefault(name, [])
                    mine.append(np.unique(np.concatenate(parts), return_counts=True))
                    if len(mine) >= 16:
                        held[name] = [merged(mine)]
        for name, parts in held.items():
            key, n = merged(parts)
            for k in range(0, len(key), 100_000):
                part = key[k : k + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(part), pa.string()), "gram": pa.array(part), "n": pa.array(n[k : k + 100_000])})

    found = rows.where("lang is not null").select("lang", F.col("text").cast("string")).mapInArrow(count, "lang string, gram long, n long")
    found = written(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    total = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    names = sorted(total)
    if not names:
        return LanguageFilters([], [])
    number, many = {k: i for i, k in enumerate(names)}, -(-len(names) // 8)
    bits = slot_bits(found.select("gram").distinct().count(), len(names))

    def place(batches):
        for batch in batches:
            lang = np.array([number[k] for k in batch.column(0).to_pylist()], np.int64)
            for slot in slots_of(batch.column(1).to_numpy(), bits):
                yield pa.RecordBatch.from_pydict({"plane": pa.array(lang >> 3), "slot": pa.array(slot.astype(np.int64)), "mask": pa.array(np.int64(1) << (lang & 7))})

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << min(SLICE, bits), np.uint8)
        out[frame["slot"].to_numpy() & (len(out) - 1)] = frame["mask"].to_numpy().astype(np.uint8)
        return pd.DataFrame({"plane": [key[0]], "slice": [key[1]], "bytes": [out.tobytes()]})

    slots = found.select("lang", "gram").mapInArrow(place, "plane long, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask"))
    slices = slots.groupBy("plane", F.expr(f"slot >> {SLICE}").alias("slice")).applyInPandas(pack, "plane long, slice long, bytes binary").collect()
    planes = [np.zeros(1 << bits, np.uint8) for _ in range(many)]
    for r in slices:
        part = np.frombuffer(r["bytes"], np.uint8)
        planes[r["plane"]][r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    dropped(found)
    return LanguageFilters(names, planes, max(range(len(names)), key=lambda i: total[names[i]]))


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs; no shuffle. Only the text is read, whatever the other columns
    are called. Null and empty texts, and those without a Unicode letter, get und and 0; without
    learned languages every row does. Rows that repeat an id, or have none, are judged each by itself; an
    empty table gives no rows. The filters are broadcast: about a byte for each slot and eight languages."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not filters.names:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for a, b in text_runs(batch.column(1)):
                lang, score = held.value.predict(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = crc_fold(F.col("doc_id"), 4)
    filters = learn(docs.where((fold != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return identify(docs, filters).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
