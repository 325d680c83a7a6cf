"""URL filters: allow and block rules, then a ratio of character models for the rest.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Letters, one sign for digits, punctuation, other, start and end: 40 at most, so that a model of
#: order 3 has no more than 40^4 = 2,560,000 entries, however many URLs there are.
OTHER = r"[^a-z0./:?#=&_%\-]"
ORDER, SYMBOLS = 3, 40
#: Labelled URLs whose md5 starts with a lower digit set the threshold and are not counted.
HELD_OUT = "3"


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host after the first ://, A-Z lower-cased, and path; both empty for null or without ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host, path, rules) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, as written, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def symbols(url) -> F.Column:
    """What the models read: the URL from its host on, over the small alphabet, with start and end signs."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    plain = F.regexp_replace(F.translate(rest, UPPER + "123456789", LOWER + "0" * 9), OTHER, "*")
    return F.concat(F.lit("^" * ORDER), plain, F.lit("$"))


def gram_ratios(grams: DataFrame, strength: float = 4.0) -> DataFrame:
    """(gram, ratio): ln P(last sign | others) of the blocked model minus that of the allowed one.

    grams: (gram, allow, block), counts of the longest grams; grams that no labelled URL has
    come with zeros. Each order is smoothed with `strength` times the next lower one, down to the
    uniform distribution, so contexts that are rare or new fall back to shorter ones."""
    sums = lambda df, key: df.groupBy(key.alias("key")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    tables = {ORDER + 1: grams.select(F.col("gram").alias("key"), "allow", "block")}
    for n in range(ORDER, 0, -1):
        tables[n] = sums(tables[n + 1], F.substring("key", 2, n))
    lower = None
    for n in range(1, ORDER + 2):
        own = tables[n]
        ctx = sums(own, F.substring("key", 1, n - 1) if n > 1 else F.lit("")).toDF("ctx", "all_allow", "all_block")
        step = own.withColumn("ctx", F.substring("key", 1, n - 1) if n > 1 else F.lit("")).join(ctx, "ctx")
        if lower is None:
            step = step.withColumn("la", F.lit(1.0 / SYMBOLS)).withColumn("lb", F.lit(1.0 / SYMBOLS))
        else:
            step = step.withColumn("tail", F.substring("key", 2, n - 1)).join(lower.toDF("tail", "la", "lb"), "tail")
        p = lambda c, s=strength: (F.col(c) + s * F.col("l" + c[0])) / (F.col("all_" + c) + s)
        lower = step.select("key", p("allow").alias("a"), p("block").alias("b"))
    return lower.select(F.col("key").alias("gram"), (F.ln("b") - F.ln("a")).alias("ratio"))


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, ratio.

    URLs that a rule decides are the labelled rows. By the md5 of the URL three sixteenths of them
    are held out; two Markov models of order 3 with all shorter orders below are counted over the
    others. A URL without a rule is blocked when its length-normalised log-likelihood difference is over a
    threshold: the point between the held-out classes' means that is as many standard deviations from either.
    Where no URL of a class is held out, the counted ones of that class stand in. Without labelled URLs of
    both kinds the method allows everything. A null or empty URL has no host and no path and is
    judged as the empty string. Repeated rows are judged alike; other columns are ignored.

    The model is counted with map-side aggregation and bounded by the alphabet, and is the only
    broadcast."""
    host, path = host_and_path(F.col(url_col))
    held = F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 1) < HELD_OUT
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"), symbols(F.col("url")).alias("signs"), held.alias("held"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": verdict})
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("signs") - ORDER), lambda i: F.substr("signs", i, F.lit(ORDER + 1))))
    is_a = lambda kind: F.sum((F.col("by_rule").eqNullSafe(kind) & ~F.col("held")).cast("long")).alias(kind)
    counts = written(base.select("by_rule", "held", grams.alias("gram")).groupBy("gram").agg(is_a("allow"), is_a("block")), "url-grams")
    ratios = written(gram_ratios(counts), "url-ratios")
    row = base.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", "rule", "by_rule", "held", grams.alias("gram"))
    scored = row.join(F.broadcast(ratios), "gram").groupBy("row", "page_id", "host", "path", "rule", "by_rule", "held").agg(F.avg("ratio").alias("ratio"))
    scored = written(scored.drop("row"), "url-scores")
    of = F.when(F.col("held"), F.col("ratio"))
    spread = lambda f: F.coalesce(f(of), f("ratio"))
    stats = {r["by_rule"]: r for r in scored.groupBy("by_rule").agg(spread(F.avg).alias("mean"), spread(F.stddev_pop).alias("dev")).collect()}
    a, b = stats.get("allow"), stats.get("block")
    if a is None or b is None:
        by_method = F.lit("allow")
    else:
        both = a["dev"] + b["dev"]
        limit = (a["mean"] * b["dev"] + b["mean"] * a["dev"]) / both if both > 0 else (a["mean"] + b["mean"]) / 2
        by_method = F.when(F.col("ratio") > limit, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.round("ratio", 6).alias("ratio"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rule_sql(value: int) -> str:
    fits = lambda t: f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')"
    return "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[value]}'" for r in sorted(RULES, key=lambda r: (len(r[1]), r[1]), reverse=True)) + " END"


def _levels_sql() -> str:
    out = []
    for n in range(ORDER, 0, -1):
        out.append(f"t{n} AS (SELECT substr(key, 2, {n}) AS key, sum(allow) AS allow, sum(block) AS block FROM t{n + 1} GROUP BY 1)")
    for n in range(1, ORDER + 2):
        context = f"substr(key, 1, {n - 1})"
        both = f"SELECT key, (allow + 4.0::DOUBLE * la) / (sum(allow) OVER (PARTITION BY {context}) + 4.0::DOUBLE) AS a, (block + 4.0::DOUBLE * lb) / (sum(block) OVER (PARTITION BY {context}) + 4.0::DOUBLE) AS b"
        lower = f"(SELECT *, 1.0::DOUBLE / {SYMBOLS} AS la, 1.0::DOUBLE / {SYMBOLS} AS lb FROM t1)" if n == 1 else f"(SELECT t{n}.*, p.a AS la, p.b AS lb FROM t{n} JOIN p{n - 1} p ON p.key = substr(t{n}.key, 2, {n - 1}))"
        out.append(f"p{n} AS ({both} FROM {lower})")
    return ", ".join(out)


OP7_SQL = f"""
WITH h AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS by_rule, row_number() OVER () AS row,
  '{"^" * ORDER}' || regexp_replace(translate(regexp_replace(url, '(?s)^.*?://', ''), '{UPPER}123456789', '{LOWER}{"0" * 9}'), '{OTHER}', '*', 'g') || '$' AS signs FROM (SELECT *, substr(md5(url), 1, 1) < '{HELD_OUT}' AS held FROM h)),
g AS (SELECT row, by_rule, held, unnest(list_transform(range(1, length(signs) - {ORDER - 1}), lambda i: substr(signs, i, {ORDER + 1}))) AS key FROM r),
t{ORDER + 1} AS (SELECT key, count(*) FILTER (WHERE by_rule = 'allow' AND NOT held) AS allow, count(*) FILTER (WHERE by_rule = 'block' AND NOT held) AS block FROM g GROUP BY key),
{_levels_sql()},
s AS (SELECT row, avg(ln(b) - ln(a)) AS ratio FROM g JOIN p{ORDER + 1} USING (key) GROUP BY row),
z AS (SELECT r.*, s.ratio FROM r JOIN s USING (row)),
k AS (SELECT by_rule, coalesce(avg(ratio) FILTER (WHERE held), avg(ratio)) AS m, coalesce(stddev_pop(ratio) FILTER (WHERE held), stddev_pop(ratio)) AS d FROM z GROUP BY by_rule),
c AS (SELECT max(m) FILTER (WHERE by_rule = 'allow') AS ma, max(d) FILTER (WHERE by_rule = 'allow') AS da,
  max(m) FILTER (WHERE by_rule = 'block') AS mb, max(d) FILTER (WHERE by_rule = 'block') AS db FROM k)
SELECT page_id, host, path, rule, round(ratio, 6) AS ratio, coalesce(by_rule, CASE WHEN ratio > CASE WHEN da + db > 0 THEN (ma * db + mb * da) / (da + db) ELSE (ma + mb) / 2 END THEN 'block' ELSE 'allow' END) AS verdict
FROM z, c
"""
