"""Row shapes. Missing and null fields are one thing here: readers fill both with the documented default."""

from __future__ import annotations

from pyspark.sql import DataFrame

COMPLAINT = "tag string, title string, body string, forced_unit string"
VALIDATION = "is_valid boolean, cleaned_value string, errors array<string>, warnings array<string>"
LOCATION_HIT = "district string, matched_text string, source string, confidence double, category string"
LOCATION = f"district string, confidence double, method string, places array<struct<{LOCATION_HIT.replace(' ', ':', 1)}>>"
ALIAS_DICTIONARY = "map<string,array<string>>"
ALIAS_CATALOG = "alias string, district string, category string, confidence double, source string"
PLACE_RECORD = "name string, district string, category string, source string, source_url string, address string, location string, adcode string"
PURIFIED_POI = "name string, district string, location string, address string, source string"
VENDOR_POI = "uid string, name string, district string, address string, location string, province string, source string"
GRID_POI = "uid string, name string, type string, address string, district string, location string, source string, scan_center string"
ROAD_BINDING = "road string, district string, township string, high_precision_zone string"
CORPUS_DOC = "id string, title string, doc_type string, district string, source string, content string, issue_type string, unit string, tags array<string>, applicable_tags array<string>"
CRAWLED_DOC = "id string, title string, doc_type string, district string, source string, source_url string, crawl_time timestamp, content string, tags array<string>"
RETRIEVAL_HIT = "doc_id string, title string, doc_type string, district string, source string, score double, snippet string, matched_terms array<string>"
UNIT_PREDICTION = "unit string, confidence double"
FEEDBACK = (
    "id bigint, timestamp string, tag string, title string, body string, reply string, unit string, district string, is_helpful int, feedback_type string,"
    " comments string, client_ip string, user_agent string, processing_time double, created_at timestamp"
)
CRAWL_STATE = "district string, keyword string, count int, total_pages int, crawled_pages array<int>, empty_pages array<int>"
TRAINING_ROW = "tag string, title string, body string, unit string, reply string"
LABEL_MAP = "label_id int, unit string"
LOG_EVENT = "timestamp string, level string, message string, module string, function string, line int"
PROMPT = "array<struct<role:string,content:string>>"


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that ``df`` lacks, in order; an empty list means the shape is right."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """``df`` itself; an error that names the missing columns otherwise."""
    if lacking := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df
