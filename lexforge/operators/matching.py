"""Set-overlap similarity joins of pages and blocks as equi-joins on shared values, and top-k.

A row's features are strings: a letter for the type, then the value. A pair scores the weights of the types of which it
shares a value, at most 1, so its score follows from one bit for each type."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import lexicon as L
from lexforge.functions import text as X
from lexforge.plans.scratch import Scratch

TYPES = sorted(L.ANCHOR_WEIGHTS)
HEADING, TABLE = len(TYPES), len(TYPES) + 1
FIRST = ord("a")
STRINGS = "array<string>"
#: Segments of the English rows, at most.
SEGMENTS = 4096
#: English rows of a value that is joined as it is, at most, where all rows have few choices.
FEW = 32
#: Words of 64 bits that a task's sets of rows take at once, about.
WORDS = 1 << 22


def _feature(kind: int, value: Column) -> Column:
    return F.concat(F.lit(chr(FIRST + kind)), value)


def _of(kind: int, values: Column) -> Column:
    return F.filter(values, lambda v: F.ascii(v) == FIRST + kind)


def _texts(kind: int, values: Column) -> Column:
    return F.transform(_of(kind, values), lambda v: F.substr(v, F.lit(2)))


def _bits(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda b, v: b.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(v) - FIRST)))


def _features(anchors: DataFrame, key: str, rows: DataFrame | None) -> DataFrame:
    """(lang, id, values): the distinct features of each row of `rows` (lang, id, values); of each key if there are no rows."""
    number = F.create_map(*[x for i, t in enumerate(TYPES) for x in (F.lit(t), F.lit(chr(FIRST + i)))])[F.col("anchor_type")]
    feature = F.array(F.concat(number, F.col("normalized_value")))
    found = anchors.select("lang", F.col(key).alias("id"), feature.alias("values"), F.lit(rows is None).alias("known")).where("values[0] is not null")
    if rows is not None:
        found = rows.withColumn("known", F.lit(True)).unionByName(found)
    # no null keys: all readers of this table then ask for the same rows, and share its exchange
    grouped = found.where("lang is not null and id is not null").groupBy("lang", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"), F.max("known").alias("known"))
    return grouped.where("known").select("lang", "id", "values")


def _combinations(pool: Column, weights: list[float]) -> Column:
    """array<struct<key, w, bits>>: every choice of at most one feature of each type, with their weights' sum and bits."""
    types = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(1 << i).alias("bit"), _of(i, pool).alias("values")) for i, w in enumerate(weights)])
    nothing = F.array(F.struct(F.lit("").alias("key"), F.lit(0.0).alias("w"), F.lit(0).alias("bits")))

    def extended(chosen: Column, of: Column) -> Column:
        # lengths keep the keys of different choices apart
        more = lambda c: F.transform(of["values"], lambda v: F.struct(F.concat(c["key"], F.length(v).cast("string"), F.lit(":"), v).alias("key"), (c["w"] + of["w"]).alias("w"), (c["bits"] + of["bit"]).alias("bits")))
        return F.concat(chosen, F.flatten(F.transform(chosen, more)))

    return F.aggregate(types, nothing, extended)


def _score(bits: Column, weights: list[float]) -> Column:
    total = reduce(lambda a, b: a + b, [F.when(bits.bitwiseAND(1 << i) != 0, w).otherwise(0.0) for i, w in enumerate(weights)])
    return F.round(F.least(total, F.lit(1.0)), 6)


def _levels(kinds: tuple[int, ...], weights: list[float], least: float) -> list[tuple[float, list[tuple[int, ...]]]]:
    """Scores of at least `least` that sharing some of these types gives, from the highest on, with the choices of types that give them."""
    out: dict[float, list[tuple[int, ...]]] = {}
    for n in range(1, len(kinds) + 1):
        for some in combinations(kinds, n):
            score = round(min(sum(weights[i] for i in some), 1.0), 6)
            if score >= least:
                out.setdefault(score, []).append(some)
    return sorted(out.items(), reverse=True)


def _first_bits(sets: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit): the first need[row] bits of each row of 64-bit words."""
    row, word = np.nonzero(sets)
    count = np.bitwise_count(sets[row, word]).astype(np.int64)
    before = np.cumsum(count) - count
    first = np.searchsorted(row, row)  # a row's first word
    near = before - before[first] < need[row]
    row, word = row[near], word[near]
    at, bit = np.nonzero(np.unpackbits(sets[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    row, bit = row[at], word[at] * 64 + bit
    keep = np.arange(len(row)) - np.searchsorted(row, row) < need[row]
    return row[keep], bit[keep]


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's row, and the values, of a column of lists."""
    lists = lists.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def best_of_segment(ja: pa.Table, en: pa.Table, weights: list[float], least: float, k: int):
    """(ja row, en row, bits) arrays: for each row of ja (ja_x, kth) the k best rows of en (en_x), in order of ids, that score at least
    `least` and more than its kth. Each value has a set of English rows as bits, so 64 pairs are told in one step."""
    en_row, en_values = _flat(en["en_x"])
    ja_row, ja_values = _flat(ja["ja_x"])
    kth = pc.fill_null(ja["kth"].combine_chunks(), -1.0).to_numpy(zero_copy_only=False)
    step = 4096  # English rows at once: distinct values times rows stay within WORDS
    while step > 64 and np.bincount(en_row // step).max(initial=0) * step // 64 > WORDS:
        step //= 2
    lacks = np.full(len(kth), k)
    for at in range(0, en.num_rows, step):
        mine = np.flatnonzero((en_row >= at) & (en_row < at + step))
        named = en_values.take(pa.array(mine)).dictionary_encode()
        code, row = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), en_row[mine] - at
        wide = -(-min(step, en.num_rows - at) // 64)
        sets = np.zeros((len(named.dictionary), wide), np.uint64)
        np.bitwise_or.at(sets, (code, row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
        kind = np.array([ord(v[0]) - FIRST for v in named.dictionary.to_pylist()], np.int64)
        asked = pc.fill_null(pc.index_in(ja_values, value_set=named.dictionary), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(asked >= 0)
        group = ja_row[known] * len(weights) + kind[asked[known]]
        order = np.argsort(group, kind="stable")
        known, group = known[order], group[order]
        per = max(1, WORDS // max(1, wide))
        lo = 0
        while lo < len(known):  # rows of ja as a whole, about `per` values
            hi = min(len(known), lo + per)
            hi = int(np.searchsorted(ja_row[known], ja_row[known[hi - 1]], "right"))
            starts = lo + np.flatnonzero(np.diff(group[lo:hi], prepend=-1))
            either = np.bitwise_or.reduceat(sets[asked[known[lo:hi]]], starts - lo, axis=0)
            of, kinds = group[starts] // len(weights), group[starts] % len(weights)
            yield from ((j, e + at, bits) for j, e, bits in _best_by_kinds(either, of, kinds, kth, lacks, weights, least))
            lo = hi


def _best_by_kinds(either: np.ndarray, of: np.ndarray, kinds: np.ndarray, kth: np.ndarray, k: np.ndarray, weights: list[float], least: float):
    """The k best of the sets either[i] of rows that share type kinds[i] with row of[i], by rows that have the same types."""
    rows, first = np.unique(of, return_index=True)
    mask = np.bitwise_or.reduceat(1 << kinds, first)
    for m in np.unique(mask):
        here = np.flatnonzero(mask == m)
        types = tuple(i for i in range(len(weights)) if m >> i & 1)
        set_of = {t: either[first[here] + n] for n, t in enumerate(types)}
        lacks, taken = k[rows[here]].copy(), np.zeros_like(either[first[here]])
        for score, choices in _levels(types, weights, least):
            open_ = np.flatnonzero((lacks > 0) & (score > kth[rows[here]]))
            if not len(open_):
                continue
            got = reduce(np.bitwise_or, [reduce(np.bitwise_and, [set_of[t][open_] for t in some]) for some in choices])
            new = got & ~taken[open_]
            taken[open_] |= got
            at, bit = _first_bits(new, lacks[open_])
            lacks[open_] -= np.bincount(at, minlength=len(open_))
            at = open_[at]
            share = [(set_of[t][at, bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(np.int32) << t for t in types]
            yield rows[here[at]], bit, reduce(np.bitwise_or, share)


def segment_pairs(ja: DataFrame, en: DataFrame, weights: list[float], least: float, k: int, size: int = 4096, growth: int = 8, held: int = 8192) -> DataFrame:
    """(ja, en, bits): the k best English rows of each Japanese row by the features of x alone, of those that score at least `least`.

    ja: (ja, x), en: (en, x). English rows stand in segments by id, `size` rows or a part in SEGMENTS of all. No row of a segment can share
    more types than the segment's features do. Segments come in rounds, in order of ids, each round `growth` times as many; a row meets
    only those in which more can be reached than its k-th score, as equal scores of later ids come after. A row that has
    its k rows with all the types that it has itself is done: so values that all rows share end after the first segment.
    A task takes a segment and about `held` Japanese rows, and gives each row's k best of the segment."""
    scratch, spark = Scratch(ja.sparkSession), ja.sparkSession
    parts = max(1, min(SEGMENTS, -(-en.count() // size)))
    rows = scratch.write(en.select("en", F.col("x").alias("en_x")).repartitionByRange(parts, "en").withColumn("segment", F.spark_partition_id()), "segments")
    heads = scratch.write(rows.select("segment", F.explode("en_x").alias("v")).distinct(), "heads")
    left = scratch.write(ja.select("ja", F.col("x").alias("ja_x")).where(_score(_bits(F.col("x")), weights) >= least), "asking")
    left = left.withColumns({"kth": F.lit(None).cast("double"), "ceiling": _score(_bits(F.col("ja_x")), weights)})
    schema = f"ja {ja.schema['ja'].dataType.simpleString()}, en {en.schema['en'].dataType.simpleString()}, bits int"
    best, at, width = None, 0, 1

    def of_segment(asking: pa.Table, segment: pa.Table) -> pa.Table:
        segment = segment.sort_by("en")
        got = list(best_of_segment(asking, segment, weights, least, k))
        j, e, bits = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(3))
        return pa.table([asking["ja"].take(pa.array(j)), segment["en"].take(pa.array(e)), pa.array(bits, pa.int32())], names=["ja", "en", "bits"])

    while at < parts and k > 0:
        here = heads.where(F.col("segment").between(at, min(parts, at + width) - 1))
        met = left.select("ja", "kth", F.explode("ja_x").alias("v")).join(here, "v")
        bound = met.groupBy("ja", "segment").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.ascii("v") - FIRST)).alias("bits"), F.max("kth").alias("kth"))
        worth = bound.withColumn("most", _score(F.col("bits"), weights)).where((F.col("most") >= least) & (F.col("kth").isNull() | (F.col("most") > F.col("kth"))))
        chunks = max(1, -(-left.count() // held))
        pairs = worth.select("ja", "segment").join(left.select("ja", "ja_x", "kth"), "ja").withColumn("chunk", F.pmod(F.xxhash64("ja"), F.lit(chunks)))
        dealt = rows.where(F.col("segment").between(at, min(parts, at + width) - 1)).join(F.broadcast(spark.range(chunks).select(F.col("id").alias("chunk"))))
        found = pairs.groupBy("segment", "chunk").cogroup(dealt.groupBy("segment", "chunk")).applyInArrow(of_segment, schema).withColumn("score", _score(F.col("bits"), weights))
        new = scratch.write(top_k(found if best is None else best.unionByName(found), "ja", k, F.desc("score"), "en"), "best")
        best, at, width = new, at + width, width * growth
        full = best.groupBy("ja").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") == k)
        rest = left.drop("kth").join(full.select("ja", F.col("low").alias("kth")), "ja", "left").where(F.col("kth").isNull() | (F.col("kth") < F.col("ceiling")))
        left = scratch.write(rest.select("ja", "ja_x", "kth", "ceiling"), "asking")
        if left.isEmpty():
            break
    if best is None:
        return ja.select("ja", F.lit(None).alias("en"), F.lit(0).alias("bits")).limit(0).join(en.select("en").limit(0), "en").select("ja", "en", "bits")
    return best.select("ja", "en", "bits")


def best_pairs(features: DataFrame, weights: list[float], direct: int, least: float, k: int, hot: int = 1000, widest: int = 1024) -> DataFrame:
    """(ja, en, score): exactly the k best English rows of each Japanese row that score at least `least`, ties by id.

    Features of the first `direct` types that at most `hot` English rows have are joined as they are. Of the others, hot
    values and all further types, a pair shares some choice of one feature for each type, and of the English
    rows with that choice only the k smallest ids can be among the k best: more with the same choice score no less and come first. So
    each choice that can reach `least` is a key with k English rows, and a value that all rows share costs k pairs for each
    row. Rows with more than `widest` choices of features go through segment_pairs(), against all, and others against
    such English rows. Where no row can have that many, choices cost less than values do, and all values that more than FEW rows
    have are hot. Nothing is dropped: `hot` and `widest` choose the way, not the result."""
    if k < 0:
        raise ValueError("top-k must not be negative")
    could = reduce(lambda a, b: a * b, [1 + F.size(_of(i, F.col("values"))).cast("double") for i in range(len(weights))])
    narrow = features.where(could > widest).isEmpty()
    hot = min(hot, FEW) if narrow else hot
    each = features.select("lang", "id", F.explode("values").alias("v")).where(F.ascii("v") < FIRST + direct)
    common = each.where("lang = 'en'").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("v")
    hots = each.join(common, "v").groupBy("lang", "id").agg(F.array_sort(F.collect_list("v")).alias("hots"))
    rows = features.join(hots.hint("merge"), ["lang", "id"], "left").withColumn("hots", F.coalesce("hots", F.array().cast(STRINGS)))
    extra = F.concat("hots", F.filter("values", lambda v: F.ascii(v) >= FIRST + direct))
    choices = reduce(lambda a, b: a * b, [1 + F.size(_of(i, F.col("extra"))).cast("double") for i in range(len(weights))])
    rows = rows.withColumn("extra", extra).select("lang", "id", "values", "extra", (choices > widest).alias("wide"))
    rows = Scratch(features.sparkSession).write(rows, "rows")  # all ways below read them, and some count them first

    def side(df: DataFrame, lang: str) -> DataFrame:
        return df.where(F.col("lang") == lang).select(F.col("id").alias(lang), F.col("extra").alias(f"{lang}_x"), *[c for c in df.columns if c not in ("lang", "id", "extra")])

    def joined(ja: DataFrame, en: DataFrame) -> DataFrame:
        more = F.when(F.arrays_overlap("ja_x", "en_x"), _bits(F.array_intersect("ja_x", "en_x"))).otherwise(0)
        bits = F.call_function("shiftleft", F.lit(1), F.ascii("v") - FIRST).bitwiseOR(more)
        return ja.select("ja", "ja_x", "v").join(en.select("en", "en_x", "v").hint("merge"), "v").select("ja", "en", bits.alias("bits"))

    rare = rows.select("lang", "id", "extra", F.explode(F.array_except("values", "extra")).alias("v"))
    found = joined(side(rare, "ja"), side(rare, "en"))
    pool = F.when(F.col("wide"), F.array().cast(STRINGS)).otherwise(F.col("extra"))
    chosen = F.filter(_combinations(pool, weights), lambda c: F.round(F.least(c["w"], F.lit(1.0)), 6) >= least)
    keyed = rows.select("lang", "id", F.explode(chosen).alias("c")).select("lang", "id", "c.key", "c.bits")
    first = top_k(keyed.where("lang = 'en'").select(F.col("id").alias("en"), "key"), "key", k, "en")
    found = found.union(keyed.where("lang = 'ja'").select(F.col("id").alias("ja"), "key", "bits").join(first.hint("merge"), "key").select("ja", "en", "bits"))
    for ja_wide, en_wide in () if narrow else (("wide", "true"), ("not wide", "wide")):
        ja = rows.where("lang = 'ja'").where(ja_wide).where(F.size("extra") > 0).select(F.col("id").alias("ja"), F.col("extra").alias("x"))
        en = rows.where("lang = 'en'").where(en_wide).where(F.size("extra") > 0).select(F.col("id").alias("en"), F.col("extra").alias("x"))
        if not ja.isEmpty() and not en.isEmpty():
            found = found.union(segment_pairs(ja, en, weights, least, k))
    # dealt by Japanese row, which serves the sums and the ranks
    pairs = found.repartition(F.col("ja")).groupBy("ja", "en").agg(F.bit_or("bits").alias("bits"))
    scored = pairs.select("ja", "en", _score(F.col("bits"), weights).alias("score")).where(F.col("score") >= least)
    return top_k(scored, "ja", k, F.desc("score"), "en")


def _with_shared(best: DataFrame, features: DataFrame) -> DataFrame:
    """best with what its pairs share. best is written first: one plan of this and of all ways to find it would be planned again
    and again by the driver as its stages end."""
    best = Scratch(best.sparkSession).write(best, "best-pairs")
    for lang in ("ja", "en"):
        best = best.join(features.where(F.col("lang") == lang).select(F.col("id").alias(lang), F.col("values").alias(f"{lang}_values")).hint("merge"), lang)
    return best.withColumn("shared", F.array_sort(F.array_intersect("ja_values", "en_values")))


def _shared_anchors() -> Column:
    by_type = F.array(*[F.struct(F.lit(t).alias("t"), _texts(i, F.col("shared")).alias("values")) for i, t in enumerate(TYPES)])
    return F.map_from_entries(F.filter(by_type, lambda e: F.size(e["values"]) > 0)).alias("shared_anchors")


def top_k(scored: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The k first rows of each group; Spark limits groups before the shuffle."""
    if k < 0:
        raise ValueError("top-k must not be negative")
    return scored.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def match_pages(anchors: DataFrame, min_score: float = 0.25, k: int = 5, documents: DataFrame | None = None, **limits) -> DataFrame:
    """(ja, en, score, match_type, evidence) of the k best English pages of each Japanese page.

    anchors: (lang, doc, anchor_type, normalized_value) of blocks and of whole documents. Pages without
    a shared anchor score 0: they qualify only if min_score is 0 or less, which needs documents (lang, doc)."""
    if min_score <= 0 and documents is None:
        raise ValueError("a minimum score of 0 or less takes pages without anchors and needs their rows")
    rows = documents.select("lang", F.col("doc").alias("id"), F.array().cast(STRINGS).alias("values")) if documents is not None else None
    features = Scratch(anchors.sparkSession).write(_features(anchors, "doc", rows), "features")  # anchors are taken from texts once
    best = _with_shared(best_pairs(features, [L.ANCHOR_WEIGHTS[t] for t in TYPES], len(TYPES), min_score, k, **limits), features)
    evidence = F.struct(_shared_anchors(), F.lit("document").alias("match_scope"), F.lit(L.SCORING_VERSIONS["page"]).alias("scoring_version"))
    return best.select("ja", "en", "score", F.lit(L.PAGE_MATCH_TYPE).alias("match_type"), evidence.alias("evidence"))


def match_blocks(blocks: DataFrame, anchors: DataFrame, min_score: float = 0.20, k: int = 5, **limits) -> DataFrame:
    """(ja, en, score, evidence) of the k best English blocks of each Japanese block.

    blocks: (lang, block, block_type, text, heading_path); anchors: (lang, block, anchor_type, normalized_value).
    Shared anchors add their types' weights, shared heading tokens 0.10, table rows with as many tokens 0.10."""
    tokens = F.transform(X.heading_tokens(F.coalesce("heading_path", F.lit(""))), lambda t: _feature(HEADING, t))
    shape = F.array_compact(F.array(_feature(TABLE, X.table_shape(F.col("block_type"), F.col("text")).cast("string"))))
    own = blocks.select("lang", F.col("block").alias("id"), F.coalesce(F.concat(tokens, shape), F.array().cast(STRINGS)).alias("values"))
    features = Scratch(blocks.sparkSession).write(_features(anchors, "block", own), "features")  # anchors are taken from texts once
    weights = [*(L.ANCHOR_WEIGHTS[t] for t in TYPES), L.HEADING_WEIGHT, L.TABLE_WEIGHT]
    best = _with_shared(best_pairs(features, weights, len(TYPES), min_score, k, **limits), features)
    evidence = F.struct(
        _shared_anchors(),
        _texts(HEADING, F.col("shared")).alias("heading_token_overlap"),
        (F.size(_of(TABLE, F.col("shared"))) > 0).alias("table_shape_match"),
        F.lit(L.SCORING_VERSIONS["block"]).alias("scoring_version"),
    )
    return best.select("ja", "en", "score", evidence.alias("evidence"))
