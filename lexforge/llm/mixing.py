"""Mixing sources to target weights: Pfair windows and earliest deadline first.

DataFrame functions only."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.llm.common import written


def shares(weights: dict[str, float], period: int) -> dict[str, int] | None:
    """Slots of a period for each source, if all weights are whole numbers of 1/period and none is zero."""
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) < 0:
        raise ValueError("target weights must not be negative, and some must be positive")
    wanted = {s: w / total * period for s, w in weights.items()}
    slots = {s: round(x) for s, x in wanted.items()}
    whole = min(slots.values()) > 0 and all(abs(slots[s] - x) < 1e-9 for s, x in wanted.items())
    return slots if whole and sum(slots.values()) == period else None


def pattern(spark: SparkSession, slots_of: dict[str, int], period: int) -> DataFrame:
    """(source, j, release, deadline, slot): one period of the schedule, by SQL's aggregate().

    Block j of a source with q of Q slots may start at slot floor(j Q / q) and must be
    placed before slot ceil((j + 1) Q / q). Each slot goes to the released block with the earliest
    deadline. The weights add up to one, so no deadline is missed, and after every slot each
    source has had less than one block more or less than its share."""
    names = sorted(slots_of)
    one = spark.range(1, numPartitions=1).select(F.array(*[F.lit(n) for n in names]).alias("names"), F.array(*[F.lit(slots_of[n]) for n in names]).alias("q"))
    picked = one.selectExpr(
        "names",
        "q",
        f"""aggregate(sequence(0, {period - 1}),
              named_struct('done', array_repeat(0, size(q)), 'out', cast(array() as array<struct<i:int,j:int,t:int>>)),
              (s, t) -> element_at(transform(
                array(array_min(filter(
                  transform(q, (x, i) -> struct(cast(ceil((s.done[i] + 1) * {period} / x) as int) AS d, i AS i, cast(floor(s.done[i] * {period} / x) as int) AS r)),
                  y -> y.r <= t)).i),
                p -> named_struct(
                  'done', transform(s.done, (x, i) -> if(i = p, x + 1, x)),
                  'out', array_append(s.out, struct(p AS i, s.done[p] AS j, t AS t)))), 1)).out AS out""",
    )
    rows = picked.select("names", "q", F.explode("out").alias("o"))
    q = F.element_at("q", F.col("o.i") + 1)
    return rows.select(
        F.element_at("names", F.col("o.i") + 1).alias("source"),
        q.alias("q"),
        F.col("o.j").alias("j"),
        F.floor(F.col("o.j") * period / q).alias("release0"),
        F.ceil((F.col("o.j") + 1) * period / q).alias("deadline0"),
        F.col("o.t").alias("slot0"),
    )


#: Exact weights are multiples of 2^-28.
UNIT = 1 << 28


def paths(weights: dict[str, float]) -> dict[str, list[tuple[int, int, int]]]:
    """For each source the splits (share, whole, offset) from its leaf up to the root of a Huffman tree.

    Of the first n slots of a node a child gets floor((n share + offset) / whole), half a block off
    its part at most; the two offsets of a node make its children's slots add up to n. A split
    k levels up counts in proportion to the weights of source and node there, and in a Huffman tree
    a node's weight is at least that of the two nodes below it on the path, so a source has never
    had 1.7 blocks more or less than its target, however long the sequence."""
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) < 0:
        raise ValueError("target weights must not be negative, and some must be positive")
    names = sorted(weights)
    units = [max(1, round(weights[s] / total * UNIT)) for s in names]
    above: dict[int, tuple[int, tuple[int, int, int]]] = {}
    heap = [(u, i) for i, u in enumerate(units)]
    heapq.heapify(heap)
    for new in range(len(names), 2 * len(names) - 1):
        (x, i), (y, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i], above[j] = (new, (x, x + y, (x + y) // 2)), (new, (y, x + y, x + y - 1 - (x + y) // 2))
        heapq.heappush(heap, (x + y, new))
    out = {}
    for i, s in enumerate(names):
        out[s], node = [], i
        while node in above:
            node, split = above[node]
            out[s].append(split)
    return out


def exact_slot(path: str, j: str) -> Column:
    """Slot of a source's block j: at each split the last of the fewest slots of which the child gets j + 1."""
    count = "(n + 1) % s.share * s.whole - s.offset"
    up = f"(n + 1) div s.share * s.whole + if({count} > 0, ({count} + s.share - 1) div s.share, -((-({count})) div s.share))"
    return F.expr(f"aggregate({path}, cast({j} as bigint), (n, s) -> {up} - 1)")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, tempering: float = 0.9, block_rows: int = 8, period: int = 1000, bin_rows: int = 1024, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, block, release, deadline, slot, position, in_mix.

    weights: target weight of each source (null as the empty string); a source without one gets
    weight 0, and so the least share. By default the weight is the source's row count to the power
    `tempering`. Weights that are whole numbers of 1/period have a schedule that repeats: pattern(), earliest deadline first,
    less than one block off the target anywhere. Others never repeat: they are taken to 2^-28, at least one unit
    each, and the sources are split two by two down a tree, every split a Pfair schedule of its
    two sides in closed form (paths()), which adds up to less than 1.7 blocks off the target; a slot may be that far
    outside of its window. A source's rows,
    in order of the md5 of their ids, make blocks of block_rows; the last one may be short.
    Slot: the block's place in the mix. position: the row's place. in_mix: the slot comes before
    the first one whose source has run out, up to which the mix has its target weights.

    No source meets in one task: rows are numbered inside bins of about bin_rows rows, cut by the
    md5, plus the sizes of the bins before. The pattern has `period` rows and repeats, so it
    is broadcast. Repeated ids follow each other in any order; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as weights
    if not counts:
        return rows.selectExpr("doc_id", "source", "0L AS block", "0L AS release", "0L AS deadline", "0L AS slot", "0L AS position", "false AS in_mix")
    wanted = {s: (weights.get(s, 0.0) if weights is not None else n**tempering) for s, n in counts.items()}
    slots = shares(wanted, period)
    if slots is None:
        of = paths(wanted)
        whole = next((p[-1][1] for p in of.values() if p), 1)
        share = {s: max(1, round(w / sum(wanted.values()) * UNIT)) if of[s] else 1 for s, w in wanted.items()}
        plan = spark.createDataFrame(
            [(s, share[s], of[s], -(-n // bin_rows), -(-n // block_rows)) for s, n in counts.items()],
            "source string, q long, path array<struct<share:long,whole:long,offset:long>>, bins long, end long",
        )
        plan = written(plan, "mix-paths")
        bins = F.broadcast(plan.select("source", "q", "bins"))
    else:
        plan = written(pattern(spark, slots, period), "mix-pattern")
        bins = F.broadcast(plan.where("j = 0").select("source", "q", F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(-(-n // bin_rows)))])[F.col("source")].alias("bins")))
    placed = rows.join(bins, "source").withColumn("bin", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("bins") / F.lit(1 << 32)))
    sizes = placed.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("size"))
    # Rows before a bin: those of the thousands of bins before, and of the bins before in its own thousand.
    thousand = F.floor(F.col("bin") / 1000)
    sums = lambda keys: F.sum("size").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col("size")
    large = sizes.groupBy("source", thousand.alias("k")).agg(F.sum("size").alias("size")).select("source", "k", sums(["source", "k"]).alias("first"))
    before = sizes.withColumn("k", thousand).select("source", "k", "bin", sums(["source", "k", "bin"]).alias("before")).join(large, ["source", "k"])
    before = before.select("source", "bin", (F.col("before") + F.col("first")).alias("before"))
    numbered = placed.withColumn("within", F.row_number().over(Window.partitionBy("source", "bin").orderBy("h", "doc_id")) - 1).join(before, ["source", "bin"])
    rank = F.col("before") + F.col("within")
    numbered = numbered.select("doc_id", "source", "q", rank.alias("rank"), F.floor(rank / block_rows).alias("block"))
    if slots is None:
        horizon = plan.agg(F.min(exact_slot("path", "end"))).first()[0]
        out = numbered.join(F.broadcast(plan.select("source", "path")), "source").withColumn("slot", exact_slot("path", "block"))
        return out.select(
            "doc_id",
            "source",
            F.col("block").cast("long").alias("block"),
            F.expr(f"block * {whole}L div q").alias("release"),
            F.expr(f"((block + 1) * {whole}L + q - 1) div q").alias("deadline"),
            "slot",
            (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"),
            (F.col("slot") < horizon).alias("in_mix"),
        )
    numbered = numbered.withColumns({"j": (F.col("block") % F.col("q")).cast("int"), "round": F.floor(F.col("block") / F.col("q"))})
    out = numbered.join(F.broadcast(plan.drop("q")), ["source", "j"])
    at = lambda c: (F.col("round") * period + F.col(c)).cast("long")
    # The first block that a source lacks: all slots before the earliest of those are filled as wanted.
    ends = {s: -(-n // block_rows) for s, n in counts.items()}
    lacking = plan.withColumn("end", F.create_map(*[x for s, n in ends.items() for x in (F.lit(s), F.lit(n))])[F.col("source")])
    lacking = lacking.where("j = end % q").select((F.floor(F.col("end") / F.col("q")) * period + F.col("slot0")).alias("slot"))
    horizon = lacking.agg(F.min("slot")).first()[0]
    return out.select(
        "doc_id",
        "source",
        F.col("block").cast("long").alias("block"),
        at("release0").alias("release"),
        at("deadline0").alias("deadline"),
        at("slot0").alias("slot"),
        (at("slot0") * block_rows + F.col("rank") % block_rows).alias("position"),
        (at("slot0") < horizon).alias("in_mix"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: `edf` is the schedule that repeats, `up` the splits; `f` says which of them the weights take.
OP2_SQL = """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT source, n, row_number() OVER (ORDER BY source) - 1 AS i, pow(n, 0.9) / sum(pow(n, 0.9)) OVER () AS w, greatest(1, round(pow(n, 0.9) / sum(pow(n, 0.9)) OVER () * 268435456))::BIGINT AS u FROM n),
f AS (SELECT bool_and(round(w * 1000) > 0 AND abs(w * 1000 - round(w * 1000)) < 1e-9) AND sum(round(w * 1000)) = 1000 AS repeats, count(*) AS k, sum(u)::BIGINT AS units FROM w),
l AS (SELECT list(round(w * 1000)::BIGINT ORDER BY i) AS qs, list(0::BIGINT ORDER BY i) AS zero FROM w HAVING (SELECT repeats FROM f)),
edf AS (
  SELECT -1 AS t, zero AS done, NULL::BIGINT AS i, NULL::BIGINT AS j FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda v, p: CASE WHEN p = pick THEN v + 1 ELSE v END), pick, done[pick]
  FROM (SELECT t, done, list_min(list_transform(list_filter(range(1, len(qs) + 1), lambda p: done[p] * 1000 // qs[p] <= t + 1),
      lambda p: {'d': ((done[p] + 1) * 1000 + qs[p] - 1) // qs[p], 'p': p})).p AS pick FROM edf, l WHERE t < 999)),
tree AS (
  SELECT count(*) AS node, list_sort(list({'u': u, 'i': i})) AS heap, NULL::STRUCT(u BIGINT, i BIGINT) AS a, NULL::STRUCT(u BIGINT, i BIGINT) AS b FROM w HAVING NOT (SELECT repeats FROM f)
  UNION ALL
  SELECT node + 1, list_sort(list_append(heap[3:], {'u': heap[1].u + heap[2].u, 'i': node})), heap[1], heap[2] FROM tree WHERE len(heap) > 1),
split AS (
  SELECT a.i AS child, node - 1 AS parent, a.u AS share, a.u + b.u AS whole, (a.u + b.u) // 2 AS shift FROM tree WHERE a IS NOT NULL
  UNION ALL
  SELECT b.i, node - 1, b.u, a.u + b.u, a.u + b.u - 1 - (a.u + b.u) // 2 FROM tree WHERE a IS NOT NULL),
blocks AS (SELECT *, unnest(range(0, (n + 7) // 8 + 1)) AS block FROM w),
up AS (
  SELECT i, i AS node, block, block AS slot FROM blocks
  UNION ALL
  SELECT i, parent, block, (slot + 1) // share * whole - 1
    + CASE WHEN (slot + 1) % share * whole > shift THEN ((slot + 1) % share * whole - shift + share - 1) // share ELSE -((shift - (slot + 1) % share * whole) // share) END
  FROM up JOIN split ON up.node = split.child),
plan AS (
  SELECT b.source, b.block, b.n, round(b.w * 1000)::BIGINT AS q, 1000 AS whole, b.block // round(b.w * 1000)::BIGINT * 1000 + edf.t AS slot FROM blocks b JOIN edf ON edf.i = b.i + 1 AND edf.j = b.block % round(b.w * 1000)::BIGINT
  UNION ALL
  SELECT b.source, b.block, b.n, b.u, f.units, up.slot FROM blocks b JOIN up ON up.i = b.i AND up.block = b.block, f WHERE up.node = 2 * f.k - 2 AND NOT f.repeats),
r AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank FROM documents),
h AS (SELECT min(slot) AS horizon FROM plan WHERE block = (n + 7) // 8)
SELECT doc_id, r.source, block, block * whole // q AS release, ((block + 1) * whole + q - 1) // q AS deadline, slot, slot * 8 + rank % 8 AS position, slot < horizon AS in_mix
FROM r JOIN plan ON r.source = plan.source AND plan.block = r.rank // 8, h
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix. Past the first slot whose source has run out, the slots of
    sources that have run out are empty and the others follow each other as planned."""
    placed = mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.min("position").alias("_position"))
    return docs.join(placed, F.col("doc_id").eqNullSafe(F.col("_id"))).repartitionByRange(F.col("_position")).sortWithinPartitions("_position").select(*docs.columns)
