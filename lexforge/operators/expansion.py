"""Expansion of user queries with confirmed terms: an Aho-Corasick automaton over all of them, longest matches, limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.plans.scratch import Scratch

#: Signs of all terms together up to which the automaton is built and broadcast, some hundred bytes a sign; a longer
#: dictionary is joined with the substrings of the queries.
MOST_SIGNS = 2_000_000
#: Weights, in thousandths, of terms of the matched term's language and of the other one.
SAME, OTHER = 900, 800
SOURCE = "confirmed_dictionary"


class Automaton:
    """A trie of terms with failure links: all occurrences of all terms in one pass over a text."""

    def __init__(self, terms):
        self.next: list[dict[str, int]] = [{}]
        self.size = [0]  # of the term that ends at a node, or 0
        for term in terms:
            at = 0
            for c in term:
                to = self.next[at].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[at][c] = to
                    self.next.append({})
                    self.size.append(0)
                at = to
            self.size[at] = len(term)
        self.fail = [0] * len(self.next)
        #: The nearest node on the way of failure links at which a term ends, 0 if none.
        self.ends = [0] * len(self.next)
        queue = list(self.next[0].values())
        for at in queue:
            up = self.fail[at]
            self.ends[at] = up if self.size[up] else self.ends[up]
            for c, to in self.next[at].items():
                back = up
                while back and c not in self.next[back]:
                    back = self.fail[back]
                to_fail = self.next[back].get(c, 0)
                self.fail[to] = to_fail if to_fail != to else 0
                queue.append(to)

    def occurrences(self, text: str):
        """(start, end) of every occurrence."""
        at = 0
        for i, c in enumerate(text, 1):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            node = at if self.size[at] else self.ends[at]
            while node:
                yield i - self.size[node], i
                node = self.ends[node]

    def matches(self, text: str) -> list[tuple[int, int]]:
        """Occurrences that start and end where a word does, and stand inside no longer one."""
        found = sorted((s, -e) for s, e in self.occurrences(text) if whole_words(text, s, e))
        out, reach = [], -1
        for s, e in found:
            if -e > reach:
                out.append((s, -e))
                reach = -e
        return out


def _latin(c: str) -> bool:
    return c.isascii() and c.isalnum()


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether neither end of a part of a text cuts through ASCII letters or digits."""
    cut = lambda k: 0 < k < len(text) and _latin(text[k - 1]) and _latin(text[k])
    return not cut(start) and not cut(end)


def find_terms(queries: DataFrame, terms: DataFrame, most_signs: int = MOST_SIGNS) -> DataFrame:
    """(query, start, normalized_term) of (query, text): the longest occurrences of terms (normalized_term) in lower-cased texts.

    The dictionary's size is summed up before it is collected: within most_signs it becomes an automaton that every task
    gets; beyond, texts are cut into their substrings of the lengths that terms have, and joined with the terms."""
    terms = terms.where(F.length("normalized_term") > 0).select("normalized_term").distinct()
    rows = queries.select("query", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    kind = rows.schema["query"].dataType.simpleString()
    size = terms.agg(F.coalesce(F.sum(F.length("normalized_term")), F.lit(0))).first()[0]
    if size > most_signs:
        return _joined(rows, terms)
    held = queries.sparkSession.sparkContext.broadcast(sorted(r[0] for r in terms.collect()))

    def run(batches):
        automaton = Automaton(held.value)
        for batch in batches:
            out = [(q, s, text[s:e]) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s, e in automaton.matches(text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.column(0).type, pa.int64(), pa.string()), strict=True)], names=["query", "start", "normalized_term"])

    return rows.mapInArrow(run, f"query {kind}, start long, normalized_term string")


def _joined(rows: DataFrame, terms: DataFrame) -> DataFrame:
    lengths = terms.select(F.length("normalized_term").alias("n")).groupBy().agg(F.array_sort(F.collect_set("n"))).first()[0]  # no more than the longest term has signs
    starts = lambda n: F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - n + 1)).otherwise(F.array().cast("array<int>"))
    parts = F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.transform(starts(n), lambda s: F.struct((s - 1).cast("long").alias("start"), F.substr("text", s, n).alias("normalized_term"), F.substr("text", s - 1, F.lit(1)).alias("left"), F.substr("text", s + n, F.lit(1)).alias("right")))))
    # substr from 0 starts at the first sign: nothing stands left of it
    latin, inside = "[A-Za-z0-9]", lambda c: F.col(f"p.{c}")
    cut = (inside("start") > 0) & inside("left").rlike(latin) & inside("normalized_term").rlike(f"^{latin}") | inside("right").rlike(latin) & inside("normalized_term").rlike(f"{latin}$")
    found = rows.select("query", F.explode(parts).alias("p")).where(~cut).select("query", "p.start", "p.normalized_term").join(terms, "normalized_term")
    found = found.withColumn("end", F.col("start") + F.length("normalized_term"))
    before = Window.partitionBy("query").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    longest = found.withColumn("reach", F.max("end").over(before)).where("reach is null or end > reach")
    return longest.select("query", "start", "normalized_term")


def expand_queries(queries: DataFrame, concepts: DataFrame, concept_terms: DataFrame, terms: DataFrame, contexts: DataFrame | None = None, most: int = 10, most_signs: int = MOST_SIGNS) -> DataFrame:
    """(query, lang, normalized_term, weight, source): what each query is expanded with, `most` terms at most.

    queries: (query, text). Only confirmed concepts that are safe for query expansion are used, and terms that are not blocked. A term
    of several such concepts is ambiguous: it brings only those with a context term, (concept_id, normalized_term) of contexts, among
    the query's other matches. A concept's other terms come with the larger of their weights, by weight, then the best concept's
    confidence, then term; terms that the query holds are not repeated. Null texts find nothing.

    Queries that hold the same terms are expanded alike: so distinct lists of terms are, and each query takes its list's."""
    scratch = Scratch(queries.sparkSession)
    live = concepts.where("status = 'confirmed' and safe_for_query_expansion").select("concept_id", "confidence")
    usable = terms.where("status <> 'blocked'").select("lang", "normalized_term")
    held = scratch.write(concept_terms.select("concept_id", "lang", "normalized_term").distinct().join(live, "concept_id").join(usable, ["lang", "normalized_term"]), "held")
    asked = find_terms(queries, held, most_signs).groupBy("query").agg(F.array_sort(F.collect_set("normalized_term")).alias("terms"))
    asked = scratch.write(asked, "asked")  # texts are searched once
    found = asked.select("terms").distinct().select("terms", F.explode("terms").alias("normalized_term"))
    hit = found.join(held, "normalized_term").select("terms", "concept_id", "confidence", "lang", "normalized_term")
    meanings = held.groupBy("normalized_term").agg(F.countDistinct("concept_id").alias("n")).where("n > 1").select("normalized_term")
    clear = hit.join(meanings, "normalized_term", "left_anti")
    used = clear
    if contexts is not None:
        # of a concept's context terms in a query the first and the last tell whether one is there beside the matched term
        near = contexts.select("concept_id", "normalized_term").distinct().join(held.select("concept_id"), "concept_id", "left_semi")
        beside = found.join(near, "normalized_term").groupBy("terms", "concept_id").agg(F.min("normalized_term").alias("_first"), F.max("normalized_term").alias("_last"))
        vague = hit.join(meanings, "normalized_term", "left_semi").join(beside, ["terms", "concept_id"]).where("_first <> normalized_term or _last <> normalized_term")
        used = clear.unionByName(vague.select(*clear.columns)).distinct()
    other = held.select("concept_id", F.col("lang").alias("to_lang"), F.col("normalized_term").alias("to"))
    new = used.join(other, "concept_id").where("not array_contains(terms, to)").withColumn("weight", F.when(F.col("to_lang") == F.col("lang"), SAME).otherwise(OTHER))
    new = new.groupBy("terms", F.col("to_lang").alias("lang"), F.col("to").alias("normalized_term")).agg(F.max("weight").cast("long").alias("weight"), F.max("confidence").alias("confidence"))
    order = Window.partitionBy("terms").orderBy(F.desc("weight"), F.desc("confidence"), "normalized_term", "lang")
    best = new.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).groupBy("terms").agg(F.collect_list(F.struct("lang", "normalized_term", "weight")).alias("new"))
    best = scratch.write(best, "expansions")
    return asked.join(best, "terms").select("query", F.explode("new").alias("n")).select("query", "n.*", F.lit(SOURCE).alias("source"))
