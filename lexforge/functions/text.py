"""Text features as Column expressions: normalised text, anchors, heading tokens, terms, block types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions import lexicon as L

WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
#: Word edges that do not depend on the Java version: letters, digits and _ of any script.
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
NUMBER = r"\d+(?:\.\d+)?"
#: What a match starts with is told first, which is cheaper than its edge.
DIGIT = rf"(?=\d){LEFT}"
PATTERNS = {
    "dtc": rf"(?i)(?=[PCBU]){LEFT}[PCBU][0-9A-F]{{4}}{RIGHT}",
    "torque": rf"(?i){DIGIT}{NUMBER}\s*N\s*[·.\- ]?\s*m{RIGHT}",
    "voltage": rf"(?i){DIGIT}{NUMBER}\s*V{RIGHT}",
    "part_number": rf"(?i){DIGIT}\d{{5}}-[A-Z0-9]{{4,6}}{RIGHT}",
    "pressure": rf"(?i){DIGIT}{NUMBER}\s*kPa{RIGHT}",
    "volume": rf"(?i){DIGIT}{NUMBER}\s*L{RIGHT}",
}
UNITS = {"torque": "Nm", "voltage": "V", "pressure": "kPa", "volume": "L"}
ANCHOR_TYPE = "array<struct<anchor_type:string,value:string,normalized_value:string>>"


def _once(value: Column, of) -> Column:
    """of(value), where value is found once: as a variable of a lambda, since inside other lambdas an expression is found again for each element."""
    return F.transform(F.array(value), of)[0]


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def normalize_text(text: Column) -> Column:
    """NFKC, then collapse(). Null stays null. Spark takes the call into ICU as nondeterministic, so
    write the column before filtering on it."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.isNotNull(), collapse(composed))


def plain_number(text: Column) -> Column:
    """Zeros after a decimal point go, and the point if nothing is left behind it."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def anchors_of(kind: str, text: Column) -> Column:
    """array<struct<anchor_type, value, normalized_value>> of one type; the first of equal normalised values."""
    raw = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    norm = (lambda v: F.concat(plain_number(F.regexp_extract(v, NUMBER, 0)), F.lit(" " + UNITS[kind]))) if kind in UNITS else F.upper
    return _first_of_equal(F.transform(raw, lambda v: F.struct(F.lit(kind).alias("anchor_type"), v.alias("value"), norm(v).alias("normalized_value"))))


def image_anchors(images: Column) -> Column:
    name = lambda v: F.lower(F.element_at(F.split(F.regexp_replace(F.replace(v, F.lit("\\"), F.lit("/")), r"/+$", ""), "/"), -1))
    all_of = F.transform(F.filter(images, lambda v: v.isNotNull()), lambda v: F.struct(F.lit("image_name").alias("anchor_type"), v.alias("value"), name(v).alias("normalized_value")))
    return _first_of_equal(F.filter(all_of, lambda a: ~a["normalized_value"].isin("", ".")))


def _first_of_equal(found: Column) -> Column:
    return _once(found, lambda f: F.filter(f, lambda a, i: F.array_position(F.transform(f, lambda b: b["normalized_value"]), a["normalized_value"]) == i + 1))


def anchors(text: Column, images: Column | None = None) -> Column:
    """All anchors of a normalised text and of image paths, sorted by type, value and normalised value."""
    parts = [anchors_of(k, text) for k in PATTERNS]
    if images is not None:
        parts.append(F.coalesce(image_anchors(images), F.array().cast(ANCHOR_TYPE)))
    return F.array_sort(F.concat(*parts))


def heading_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: F.length(w) >= 2))


def table_shape(block_type: Column, text: Column) -> Column:
    """White-space-separated tokens of a table row; null for other blocks."""
    return F.when(block_type == "table_row", F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def safety_type(classes: Column, text: Column) -> Column:
    """By class, then by how the text starts; of several classes warning, caution, note, prohibition."""
    out = F.lit(None).cast("string")
    for kind, starts in reversed(L.SAFETY_STARTS):
        out = F.when(text.rlike("(?i)^(" + "|".join(starts) + ")"), kind).otherwise(out)
    for kind in reversed([k for k, _ in L.SAFETY_STARTS]):
        names = [n for n, k in L.SAFETY_CLASSES.items() if k == kind]
        out = F.when(F.arrays_overlap(F.transform(classes, F.lower), F.array(*map(F.lit, names))), kind).otherwise(out)
    return out


def block_type(tag: Column, classes: Column, text: Column, in_ordered_list: Column) -> Column:
    plain = (
        F.when(tag.rlike("^h[1-6]$"), "heading")
        .when(tag == "tr", "table_row")
        .when(tag == "li", F.when(in_ordered_list, "procedure").otherwise("list_item"))
        .when(tag == "p", "paragraph")
        .otherwise("block")
    )
    return F.coalesce(safety_type(classes, text), plain)


def normalize_term(term: Column, lang: Column) -> Column:
    """For text that is normalised already: lower case if English, and without outer punctuation."""
    return F.btrim(F.when(lang == "en", F.lower(term)).otherwise(term), F.lit(L.TERM_STRIP))


def _terms(found: Column, kind: str) -> Column:
    return F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("term_type")))


def lexicon_terms(text: Column, phrases, lang: str) -> Column:
    by_length = sorted(phrases, key=len, reverse=True)
    low = F.lower(text)
    hits = [F.when(text.contains(p) if lang == "ja" else low.contains(p) & low.rlike(LEFT + p.replace("-", r"\-") + RIGHT), p) for p in by_length]
    return F.array_compact(F.array(*hits))


def compound_terms(text: Column, suffixes=L.JA_SUFFIXES) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[一-龥ァ-ヴーA-Za-z0-9]{{2,}}(?:{'|'.join(suffixes)})"), F.lit(0))


def ngram_terms(text: Column, keywords=L.EN_KEYWORDS, sizes=(2, 3, 4)) -> Column:
    """Windows of 2 to 4 English words of a block with a keyword in them, in order of size and place."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z][A-Za-z-]*"), F.lit(0))
    keys = F.array(*map(F.lit, keywords))

    def windows(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: F.slice(w, i, n)), lambda x: F.arrays_overlap(x, keys))

    return _once(words, lambda w: F.transform(F.concat(*[windows(w, n) for n in sizes]), lambda x: F.array_join(x, " ")))


def terms(lang: Column, text: Column, ja_phrases=L.JA_PHRASES, en_phrases=L.EN_PHRASES, keywords=L.EN_KEYWORDS) -> Column:
    """array<struct<term, term_type>> of a normalised text: phrases of the lexicon first, then what
    patterns find. Another language is an error."""
    ja = F.concat(_terms(lexicon_terms(text, ja_phrases, "ja"), "domain_phrase"), _terms(compound_terms(text), "regex_phrase"))
    en = F.concat(_terms(lexicon_terms(text, en_phrases, "en"), "domain_phrase"), _terms(ngram_terms(text, keywords), "regex_phrase"))
    other = F.raise_error(F.concat(F.lit("lang must be 'ja' or 'en', not "), F.coalesce(lang.cast("string"), F.lit("null")))).cast("array<struct<term:string,term_type:string>>")
    return F.when(lang == "ja", ja).when(lang == "en", en).otherwise(other)


def concept_id(ja: Column, en: Column, category: str = "unknown") -> Column:
    return F.concat(F.lit(f"concept:{category}:"), F.left(F.sha1(F.concat(F.lit(f"{category}|ja:"), ja, F.lit("|en:"), en)), F.lit(12)))


def recommended_action(confidence: Column, evidence: Column, negative: Column) -> Column:
    return F.when(negative > 0, "inspect").when((confidence >= 0.85) & (evidence > 0), "approve").otherwise("inspect")


def status_after_score(status: Column, confidence: Column, threshold: float) -> Column:
    """Confirmed and blocked stay; others are ready for review from the threshold on, else candidates."""
    return F.when(status.isin("confirmed", "blocked"), status).when(confidence >= threshold, "review_ready").otherwise("candidate")


def all_of(predicates) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
