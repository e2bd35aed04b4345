"""Shapes of the domain tables, and the values their enumerations allow."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

TEXT, DAY, YES_NO, AMOUNT, WHOLE, COUNT = StringType(), DateType(), BooleanType(), DoubleType(), IntegerType(), LongType()
TEXTS = ArrayType(StringType())


def _shape(*fields: tuple) -> StructType:
    """Fields as (name, type) or (name, type, True) where null is allowed."""
    return StructType([StructField(f[0], f[1], len(f) > 2 and f[2]) for f in fields])


def _opt(name: str, kind: DataType) -> tuple:
    return (name, kind, True)


SECTIONS = _shape(
    ("section_id", TEXT), ("official_name", TEXT), ("display_name", TEXT), ("kind", TEXT),
    ("aliases", TEXTS), ("budget_codes", TEXTS), ("source_url", TEXT),
)
TENURES = _shape(
    ("tenure_id", TEXT), ("person_name", TEXT), ("role", TEXT), ("section_id", TEXT),
    _opt("start_date", DAY), _opt("end_date", DAY), ("source_url", TEXT),
)
BUDGET_ITEMS = _shape(
    ("item_id", TEXT), ("section_id", TEXT), ("fiscal_year", WHOLE), ("code", TEXT), _opt("parent_code", TEXT),
    ("title", TEXT), ("path", TEXTS), ("level", WHOLE), ("is_leaf", YES_NO), _opt("original", AMOUNT),
    _opt("updated", AMOUNT), _opt("actual", AMOUNT), _opt("estimated", AMOUNT), _opt("rate", AMOUNT),
    ("currency", TEXT), ("unit", TEXT), ("status", TEXT), ("source_url", TEXT), ("notes", TEXT),
)
REGULATIONS = _shape(
    ("section_id", TEXT), ("code", TEXT), ("title", TEXT), ("year", WHOLE), _opt("econ2", TEXT),
    _opt("allocated", AMOUNT), _opt("revised", AMOUNT), _opt("executed", AMOUNT),
)
USAGE = _shape(
    ("section_id", TEXT), ("fiscal_year", WHOLE), ("econ1", TEXT), ("econ2", TEXT), _opt("allocated", AMOUNT),
    _opt("revised", AMOUNT), _opt("executed", AMOUNT), ("line_count", COUNT),
)
ACTIVITIES = _shape(
    ("id", TEXT), ("section_id", TEXT), _opt("date", DAY), ("title", TEXT), ("summary", TEXT), ("source_type", TEXT),
    ("url", TEXT), ("topics", TEXTS), ("people", TEXTS), ("organizations", TEXTS), ("notes", TEXT),
)
SOURCES = _shape(
    ("id", TEXT), ("title", TEXT), ("publisher", TEXT), ("url", TEXT), ("source_type", TEXT),
    ("section_ids", TEXTS), ("fiscal_years", ArrayType(IntegerType())), ("reliability", TEXT),
    ("retrieval_status", TEXT), _opt("checksum", TEXT),
)
ENTRIES = _shape(
    ("entry_id", TEXT), ("dataset_id", TEXT), ("subject", TEXT), _opt("date", DAY), _opt("start_time", TEXT),
    _opt("end_time", TEXT), _opt("location", TEXT), _opt("participants", TEXT), ("method", TEXT),
    ("category", TEXT), _opt("matched_keyword", TEXT), _opt("matched_confidence", TEXT), _opt("inferred_from", TEXT),
)
PUBLICATIONS = _shape(
    ("dataset_id", TEXT), ("title", TEXT), ("url", TEXT), _opt("section_id", TEXT), _opt("person_label", TEXT),
    ("person_role", TEXT), ("role_label", TEXT), _opt("period_label", TEXT), ("readable_entries", COUNT),
    ("unreadable_files", TEXTS),
)
CONTRACTS = _shape(
    ("section_id", TEXT), ("seq", TEXT), _opt("supplier", TEXT), _opt("entity_id", TEXT), _opt("entity_kind", TEXT),
    _opt("purpose", TEXT), _opt("volume", AMOUNT), _opt("executed", AMOUNT), _opt("order_date", DAY),
    _opt("method", TEXT), _opt("budget_code", TEXT), _opt("budget_title", TEXT),
)
ATTEMPTS = _shape(
    ("url", TEXT), ("purpose", TEXT), ("outcome", TEXT), _opt("http_status", WHOLE), _opt("bytes", COUNT),
    ("attempted_at", TEXT),
)

# What the enumerated columns may hold.
ALLOWED = {
    "status": ("final", "partial", "estimate", "unavailable"),
    "kind": ("ministry", "other"),
    "source_type": (
        "calendar", "ministry_news", "government_page", "committee_protocol", "policy_document", "other_official",
    ),
    "reliability": ("primary_official", "secondary_helper"),
    "retrieval_status": ("retrieved", "not_retrieved_egress_blocked", "not_retrieved_error"),
    "method": ("datastore", "spreadsheet", "pdf_text", "pdf_ocr"),
    "person_role": ("minister", "deputy_minister", "director_general", "other_senior"),
    "matched_confidence": ("high", "medium", "low"),
    "inferred_from": ("name_cooccurrence", "name_without_field"),
    "outcome": ("ok", "http_error", "network_error", "blocked", "parse_error"),
    "currency": ("ILS",),
    "unit": ("ILS", "ILS_thousands"),
}
