"""Declared schemas of every table that passes between stages."""

from __future__ import annotations

SECTIONS = "array<struct<heading: string, text: string>>"
RAW_PAGE = f"title string, url string, summary string, sections {SECTIONS}, infobox map<string,string>, categories array<string>, outlinks array<string>, crawl_depth int"
PROCESSED = (
    "title string, url string, summary string, summary_sentences array<string>, "
    "sections array<struct<heading: string, text: string, sentences: array<string>>>, "
    "infobox map<string,string>, categories array<string>, outlinks array<string>, crawl_depth int"
)
MENTION = "mention: string, type: string, start: int, end: int, source: string"
LINKED = f"{MENTION}, wikidata_qid: string, wikidata_label: string, wikidata_description: string, link_confidence: double"
ENTITIES = f"doc string, entities array<struct<{LINKED}>>"
CANDIDATE = (
    "doc string, sentence string, section string, head string, head_type string, head_start int, head_end int, head_qid string, "
    "tail string, tail_type string, tail_start int, tail_end int, tail_qid string"
)
TRIPLE = "head string, head_qid string, relation string, tail string, tail_qid string, confidence double, sentence string, doc string, provenance string"
MERGED = "head string, head_qid string, relation string, tail string, tail_qid string, confidence double, provenance string, doc_ids array<string>, sentence string"
NODE = "id string, label string, type string, wikidata_qid string, description string"
EDGE = "source string, target string, relation string, confidence double, sentence string, doc string, provenance string"
GRAPH = f"nodes array<struct<{', '.join(f.replace(' ', ': ', 1) for f in NODE.split(', '))}>>, edges array<struct<{', '.join(f.replace(' ', ': ', 1) for f in EDGE.split(', '))}>>"
