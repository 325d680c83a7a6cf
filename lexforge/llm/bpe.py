"""BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Unicode White_Space: what the tokenizer's own patterns take as \s.
WHITE = r"\t-\r \x85\xa0  -     　"
NONE = np.int64(1) << 40
#: Pieces of more bytes are merged rank by rank, so that a round costs what it changes and not the piece's length.
LONG = 256
WORD_END = "</w>"
ENDS = (".", ",", ";", ":", "!", "?")


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizers file of the kind "BPE with word ends".

    Lower-cases sign by sign after NFC, takes special tokens as they stand in the raw text, splits
    by the file's pattern, and merges the byte signs of each piece, lowest rank first."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.final = np.array([vocab[s + WORD_END] for s in signs], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = size
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        first = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(first["pattern"]["Regex"].replace(r"\s", WHITE))
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.white = regex.compile(f"[{WHITE}]+")
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.at, self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # words are what lies between white space; no piece and no special token crosses it

    def words(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these as white space
            return [w for w in self.white.split(text) if w]
        return text.split()

    def word_pieces(self, word: str) -> list:
        """The pieces of a word as bytes, special tokens as ids."""
        low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        if low.isalpha():
            return [low.encode()]
        if low[-1:] in ENDS and low[:-1].isalpha():  # the usual word before a stop
            return [low[:-1].encode(), low[-1:].encode()]
        parts = self.apart.split(word) if self.apart and "<|" in word else [word]
        out: list = []
        for p in parts:
            if p in self.special:
                out.append(self.special[p])
            elif p:
                low = unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()
                out += [x.encode("utf-8", "replace") for x in self.pieces.findall(low)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces after each other, and the number of ids of each."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not len(n):
            return np.zeros(0, np.int64), n
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.inner[raw]
        last = np.cumsum(n) - 1
        sym[last] = self.final[raw[last]]
        owner = np.repeat(np.arange(len(n)), n)
        done_sym, done_owner = [], []
        long = np.repeat(n > LONG, n)
        if long.any():
            done_owner.append(owner[long])
            done_sym.append(sym[long])
            done_sym[0], left = self._merge_by_rank(done_sym[0], done_owner[0])
            done_owner[0] = done_owner[0][left]
            sym, owner = sym[~long], owner[~long]
        rank, at = self._look_up(sym, owner)
        while len(sym):
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, start)
            count = np.diff(np.append(start, len(sym)))
            least = np.repeat(least, count)
            over = least == NONE
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                go = ~over
                sym, owner, rank, at, least = sym[go], owner[go], rank[go], at[go], least[go]
                if not len(sym):
                    break
            hit = rank == least
            where = np.flatnonzero(hit)
            # Of overlapping pairs (one sign repeated) every second one merges, from the left.
            new_run = np.diff(where, prepend=-2) != 1
            run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run_at) % 2 == 0]
            sym[where] = self.made[at[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            now = (np.cumsum(keep) - 1)[where]
            sym, owner, rank, at = sym[keep], owner[keep], rank[keep], at[keep]
            changed = np.zeros(len(sym), bool)  # pairs that start or end with a merged sign
            changed[now] = True
            changed[np.maximum(now - 1, 0)] = True
            redo = np.flatnonzero(changed)
            r, a = self._look_up(sym, owner, redo)
            rank[redo], at[redo] = r, a
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=len(n))

    def _merge_by_rank(self, sym, owner):
        """The ids of long pieces, and the places at which they start.

        A round merges one rank in all pieces, the lowest that is left; only pairs next to a merged sign
        are looked up again. Places are linked, so nothing moves."""
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # place n stands for the end
        rank, at = self._look_up(sym, owner)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places, ranks):
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, p in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else (), np.split(places, cuts), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(p)

        start = np.flatnonzero(rank < NONE)
        wait(start, rank[start])
        while heap:
            least = heapq.heappop(heap)
            where = np.unique(np.concatenate(waiting.pop(least)))
            where = where[rank[where] == least]
            if not len(where):
                continue
            # Of overlapping pairs (one sign repeated) every second one merges, from the left.
            new_run = np.append(True, after[where[:-1]] != where[1:])
            run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run_at) % 2 == 0]
            gone = after[where]
            sym[where], rank[gone] = self.made[at[where]], NONE
            sym[gone] = -1
            after[where] = after[gone]
            before[after[where]] = where
            redo = np.unique(np.concatenate([where, before[where]]))
            redo = redo[redo >= 0]
            follows = after[redo]
            inside = follows < n
            follows = np.minimum(follows, n - 1)
            key = sym[redo] * self.size + sym[follows]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = inside & (self.keys[found] == key) & (owner[redo] == owner[follows])
            rank[redo], at[redo] = np.where(ok, self.ranks[found], NONE), found
            wait(redo[ok], rank[redo[ok]])
        left = np.flatnonzero(sym >= 0)
        return sym[left], left

    def _look_up(self, sym, owner, where=None):
        """Rank of the pair that starts at each place, or NONE, and its place in the sorted keys."""
        i = np.arange(len(sym)) if where is None else where
        j = np.minimum(i + 1, len(sym) - 1)
        key = sym[i] * self.size + sym[j]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (owner[i] == owner[j]) & (i < j)
        return np.where(ok, self.ranks[at], NONE), at

    def learn(self, words: list[str]) -> None:
        """Adds new words to the table of encoded words."""
        seen: dict[bytes, int] = {}
        which, per = [], []  # piece numbers, special tokens as -1 - id
        for word in words:
            got = self.word_pieces(word)
            per.append(len(got))
            which += [seen.setdefault(p, len(seen)) if isinstance(p, bytes) else -1 - p for p in got]
        once, n_once = self.merge(list(seen))
        at_once = np.cumsum(n_once) - n_once
        piece = np.array(which, np.int64)
        fixed = piece < 0
        n = np.ones(len(piece), np.int64)
        n[~fixed] = n_once[piece[~fixed]]
        ends = np.cumsum(n)
        first = np.zeros(len(piece), np.int64)
        first[~fixed] = at_once[piece[~fixed]]
        pool = np.append(once, 0)  # the last place stands in for special tokens
        first[fixed] = len(once)
        flat = pool[np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))].astype(np.int32)
        flat[(ends - 1)[fixed]] = -1 - piece[fixed]
        owner = np.repeat(np.arange(len(words)), np.array(per, np.int64))
        per_word = np.bincount(owner, weights=n, minlength=len(words)).astype(np.int64)
        self.at = np.append(self.at, len(self.flat) + np.cumsum(per_word) - per_word)
        self.n = np.append(self.n, per_word)
        self.flat = np.append(self.flat, flat)
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words)), strict=True))

    def encode(self, texts: list, most_words: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, and the bounds of each text's."""
        if len(self.index) > most_words:
            self._forget()
        held = [self.words(t or "") for t in texts]
        words = [w for h in held for w in h]
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self.learn(new)
        index = self.index
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        n = self.n[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[at] - (ends - n), n) + np.arange(int(n.sum()))]
        word_ends = np.concatenate([[0], np.cumsum([len(h) for h in held], dtype=np.int64)])
        return ids, np.concatenate([[0], ends])[word_ends]

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder: tokens joined by single spaces; ids beyond the vocabulary are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist() if 0 <= i < self.size])


def _tokenizer(held) -> WordBpe:
    """The tokenizer of a broadcast file, built once for each Python worker."""
    text = held.value
    key = hash(text)
    if key not in _cache:
        _cache.clear()
        _cache[key] = WordBpe(text)
    return _cache[key]


_cache: dict = {}


def _file(spark: SparkSession, path: str):
    """The tokenizer file, of fixed size, sent to all executors."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def text_runs(texts: pa.Array, most: int = 1 << 20):
    """(from, to): rows whose texts together have about `most` signs; a longer text stands alone."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, k in enumerate(n):
        if i > at and size + k > most:
            yield at, i
            at, size = i, 0
        size += int(k)
    if at < len(n):
        yield at, len(n)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): whole texts encoded; null and empty texts have no ids.

    No shuffle; a task holds the words of some megabytes of text and at most about 200,000
    encoded words. Repeated rows are encoded alike; other columns are ignored."""
    held = _file(docs.sparkSession, tokenizer_path)

    def run(batches):
        bpe = _tokenizer(held)
        for batch in batches:
            for a, b in text_runs(batch.column(1)):
                ids, at = bpe.encode(batch.column(1).slice(a, b - a).to_pylist())
                arr = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), arr], names=[id_col, "ids"])

    rows = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): tokens of the ids; null or empty ids give the empty text."""
    held = _file(encoded.sparkSession, tokenizer_path)

    def run(batches):
        bpe = _tokenizer(held)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = encoded.select(id_col, ids_col)
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("text", T.StringType())]))


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode, keeping hashes only."""
    held = _file(docs.sparkSession, tokenizer_path)

    def run(batches):
        bpe = _tokenizer(held)
        for batch in batches:
            for a, b in text_runs(batch.column(1)):
                ids, at = bpe.encode(batch.column(1).slice(a, b - a).to_pylist())
                raw = ids.astype("<u4")
                rows = [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(r).encode("utf-8")).hexdigest() for r in rows], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    text = T.StringType()
    schema = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", text), T.StructField("decoded_sha256", text)])
    return rows.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path or default_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the training rows, in the order in which the rows of docs are written: file by file, row by row.
    A plain scan deals files by size and would lose the order of the stage before. Rows that come from no file stay as they are."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        placed = None
    if placed is not None:
        docs = placed.repartitionByRange("_file", "_row").sortWithinPartitions("_file", "_row").select("doc_id", "text")
    return bpe_encode(docs, default_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
