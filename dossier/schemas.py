"""Explicit schemas of the supplied tables and of the engine's own records."""

from __future__ import annotations


# Supplied tables.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

PAGE_RANGE = "struct<lo:bigint,hi:bigint>"

SECTIONS = (
    "seq bigint, source string, chapter string, chapter_page_start int, section string, subsection string, text string, "
    f"page_range {PAGE_RANGE}, word_count int, has_essentials_box boolean, essentials_text string"
)
CHUNKS = (
    "chunk_id string, source string, chapter string, section string, subsection string, text string, "
    f"page_range {PAGE_RANGE}, word_count int, chunk_type string"
)
FLAGGED = (
    "chapter string, section string, page bigint, font string, word string, residual_chars array<string>, context string"
)
CORRECTIONS = (
    "corr_id bigint, font string, original string, corrected string, chapter string, section string, page bigint, "
    "context string, residual_chars array<string>"
)
SPANS = (
    "page bigint, block bigint, line int, span int, font string, size double, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>, page_width double, text string"
)
GOLD_QUERIES = (
    "query string, expected_chapter string, accepted_chapters array<string>, expected_section string, category string"
)
STRUCTURED_RECORD = (
    "symptom string, body_systems array<string>, essential_questions array<string>, "
    "red_flags array<struct<flag:string,implication:string,urgency:string>>, "
    "differential_diagnosis array<struct<condition:string,key_features:array<string>,likelihood_context:string>>, "
    "urgency_rules array<struct<criteria:string,urgency:string,action:string>>, specialty_routing array<string>, "
    "key_history_points array<string>, key_exam_findings array<string>, initial_workup array<string>, "
    "when_to_admit array<string>, when_to_refer array<string>, treatment_overview array<string>, "
    "etiology array<string>, epidemiology string"
)
REVIEW_CASE = (
    "case_id string, patient_name string, timestamp string, symptoms array<string>, urgency string, review_status string, "
    "doctor_decision string, doctor_diagnosis string, doctor_notes string, reviewed_at string, system_primary_diagnosis string, "
    "report string, clinical_picture string, retrieved_chunks string"
)
MESSAGES = ("session_id bigint, sender string, content string, message_type string, created_at timestamp")
SEARCH_RESULT = (
    "request_id bigint, seq bigint, title string, url string, snippet string, domain string, "
    "published_or_updated_date string, error string"
)
PROFILE_UPDATE = (
    "patient string, session_ts timestamp, demographics map<string,string>, "
    "known_conditions array<struct<name:string,detail:string>>, medications array<struct<name:string,detail:string>>, "
    "allergies array<struct<name:string,detail:string>>, family_history array<struct<name:string,detail:string>>, "
    "surgical_history array<struct<name:string,detail:string>>, smoking_history map<string,string>, "
    "substance_use map<string,string>, symptoms array<string>, urgency string, diagnosis string, summary string"
)

# Allowed words of the string-typed enumerations.
DECISIONS = ("accept", "accept_with_caution", "reject")
CONFIDENCES = ("high", "moderate", "low")
REVIEW_STATES = ("pending", "confirmed", "rejected")
