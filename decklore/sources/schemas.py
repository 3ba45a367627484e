"""Explicit schemas of the tables; nothing is inferred from files."""

PAGES = "doc_id string, page_no int, title string, section_id string, page_hash string, layout_error string"
BLOCKS = (
    "doc_id string, page_no int, block_ord int, id string, kind string, role string, content string, "
    "polygon array<struct<x: double, y: double>>, provenance string, structure_provenance string, "
    "cells array<array<string>>, caption string, urls array<string>, hrefs array<struct<text: string, url: string>>, why_empty string"
)
SECTIONS = "doc_id string, section_id string, title string, start_page int, end_page int, source string, confidence double"
FLAGS = "doc_id string, kind string, severity string, page_no int, block_id string, detail string"
CHUNKS = (
    "chunk_id string, doc_id string, page_no int, page_hash string, section_id string, section_title string, vector_role string, "
    "content_type string, text_raw string, text_enriched string, token_count int, block_ids array<string>, provenance map<string, int>"
)
VECTORS = "chunk_id string, model_id string, text_key string, embedding array<float>"
EVAL_QUERIES = "qid int, q string, pages array<int>, anchors array<string>, need string, type string, by string, why string"
SENTENCES = "doc_id string, page_no int, sent_ord int, kind string, text string, ref string, syllables int, emphasis array<string>, pause_before_ms int, speed double"
TERMS = "term string, say string, mode string, `by` string"
