"""Schemas of the evidence lake's tables, and its enumerations (fixed values)."""

from __future__ import annotations

DOCUMENTS = "doc_id string, path string, filename string, title string, section string, journal string, year int, lang string, source_type string, geography_hint string, n_pages int, n_chunks int, extract_method string, status string, wave int, ingested_at timestamp, sensitivity string, sha256 string"
CHUNKS = "chunk_id string, doc_id string, seq int, text string, n_tokens int, page_from int, page_to int, lang string, section_title string"
MANIFEST = "sha256 string, path string, origin string, doc_id string, section string, wave int, docstatus string, error string, updated_at timestamp, n_chunks int, extract_method string"
NODES = "id string, type string, name string, name_en string, aliases array<string>, concept_id string, props map<string,string>, confidence double, source_docs array<string>"
EDGES = "edge_id string, src string, dst string, type string, props map<string,string>, source_doc string, chunk_id string, confidence double, method string, extracted_at date, created_by string"
CONDITIONS = "param string, op string, value double, value2 double, unit string, unit_canonical string, value_canonical double, value2_canonical double, span struct<start:int,end:int>, quote string, qualitative string"
PAYLOAD = "entities array<struct<name:string,name_en:string,type:string,subtype:string>>, relations array<struct<src:string,dst:string,type:string>>, assertions array<struct<statement:string,confidence:string,quote:string>>, conditions array<struct<param:string,op:string,value:string,value2:string,unit:string,kind:string,quote:string>>"
AUDIT = "id long, ts timestamp, role string, endpoint string, action string, params string, took_ms int, result_counts string"

# Fixed values of the data model.
NODE_PREFIXES = {
    "Material": "mat", "Process": "proc", "Equipment": "eq", "Parameter": "param", "Condition": "cond", "Measurement": "meas",
    "Publication": "pub", "Expert": "person", "Organization": "org", "Location": "loc", "Assertion": "assert",
}
EDGE_TYPES = (
    "uses_material", "uses_equipment", "operates_at_condition", "produces_output", "measured", "described_in", "validated_by",
    "contradicts", "supersedes", "authored_by", "expert_in", "works_at", "located_in", "about", "related",
)
OPS = ("=", "<", ">", "<=", ">=", "range", "approx")
CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}
REVIEW_STATES = ("auto", "confirmed", "disputed", "rejected")
GEOGRAPHIES = ("RU", "foreign", "global")
