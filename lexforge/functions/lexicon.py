"""Phrases, stop words, weights and labels of the terminology model."""

#: fixed values
JA_PHRASES = (
    "エンジン始動不良", "始動不良", "エンジンがかからない", "補機バッテリー", "バッテリー電圧", "締付トルク", "フロントハブナット",
    "ハブナット", "ブレーキフルード", "指定フルード", "リザーバ容量", "エア抜き順序", "再使用不可部品", "燃圧",
)
JA_SUFFIXES = ("トルク", "不良", "電圧", "容量", "順序", "部品", "フルード", "バッテリー", "ナット", "燃圧")
EN_PHRASES = (
    "engine does not start", "auxiliary battery", "battery voltage", "tightening torque", "front hub nut", "hub nut", "brake fluid",
    "specified fluid", "reservoir capacity", "bleeding order", "fuel pressure", "non-reusable parts",
)
EN_KEYWORDS = ("engine", "battery", "voltage", "torque", "fuel", "pressure", "hub", "nut", "fluid", "reservoir", "capacity")
TERM_STRIP = " .,:;()[]{}"

#: fixed values: how much one shared value of a type adds to a match
ANCHOR_WEIGHTS = {"dtc": 0.35, "torque": 0.25, "voltage": 0.25, "part_number": 0.25, "pressure": 0.25, "volume": 0.25, "image_name": 0.20}
HEADING_WEIGHT, TABLE_WEIGHT = 0.10, 0.10

#: fixed values
BLOCK_TAGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr", "div"})
SAFETY_CLASSES = {"warning": "warning", "caution": "caution", "note": "note", "prohibition": "prohibition", "prohibited": "prohibition"}
SAFETY_STARTS = (("warning", ("警告", "WARNING")), ("caution", ("注意", "CAUTION")), ("note", ("参考", "NOTE")), ("prohibition", ("禁止", "PROHIBITED", "PROHIBITION")))

#: fixed values
SCORING_VERSIONS = {"block": "block_matcher_mvp_0.1", "page": "page_matcher_mvp_0.1", "confidence": "confidence_mvp_0.1"}
#: fixed values: numbers of a stored confidence, and the columns that hold them here
BREAKDOWN = {
    "max_evidence_score": "mx", "average_evidence_score": "mean", "anchor_score": "anchor_match_score", "section_score": "section_match_score",
    "lexical_score": "lexical_score", "frequency_score": "frequency_score", "diversity_score": "evidence_diversity_score", "heading_score": "heading_score",
    "table_alignment_score": "table_score", "negative_evidence_penalty": "negative_penalty", "safety_penalty": "safety_penalty", "final_score": "final",
}
EVIDENCE_TYPE, GATED_EVIDENCE, PAGE_MATCH_TYPE = "matched_block_terms", "confirmed_consistency", "supplemental_anchor_score"
ACTIONS = {"approve": "confirmed", "block": "blocked", "defer": "candidate"}
SKIPPED_ACTIONS = ("", "inspect", "split")
REVIEW_COLUMNS = (
    "concept_id", "category", "confidence", "confidence_json", "status", "ja_terms", "en_terms", "evidence_count", "evidence_ids",
    "evidence_types", "evidence_summary", "sample_ja_context", "sample_en_context", "anchors", "source_files", "recommended_action",
    "action", "reviewer", "reason", "reason_code", "review_note", "row_version", "export_batch_id",
)
DICTIONARY_CSV_COLUMNS = (
    "concept_id", "category", "canonical_label_ja", "canonical_label_en", "ja_terms", "en_terms", "confidence", "status",
    "safe_for_query_expansion", "safe_for_answer_generation", "row_version",
)
