"""Schemas of the tables that come from outside: model outputs, runs of styled text, events."""

from __future__ import annotations

EXTRACT_FIELDS = (
    "identity STRUCT<name: STRING, emails: ARRAY<STRING>, phones: ARRAY<STRING>, urls: ARRAY<STRING>, "
    "locations: ARRAY<STRING>>, "
    "roles ARRAY<STRUCT<title: STRING, company_raw: STRING, company_descriptor: STRING, start_raw: STRING, "
    "end_raw: STRING, bullets: ARRAY<STRING>>>, "
    "education ARRAY<STRUCT<degree_field: STRING, institution_raw: STRING, certifications: ARRAY<STRING>>>, "
    "summary_raw STRING, skills_raw ARRAY<STRING>, relocation_statement STRING"
)
EXTRACT = "doc_id STRING, " + EXTRACT_FIELDS

DIMENSION_RUN = (
    "STRUCT<score: INT, evidence_status: STRING, evidence: ARRAY<STRUCT<quote: STRING, primary: BOOLEAN>>, "
    "confidence: STRING, rationale: STRING>"
)
QUALIFIER_RUN = "STRUCT<value: BOOLEAN, quote: STRING>"
SCORER_OUTPUT = (
    f"dimensions MAP<STRING, {DIMENSION_RUN}>, d7_qualifiers MAP<STRING, {QUALIFIER_RUN}>, "
    "role_types ARRAY<STRUCT<role_index: INT, type: STRING, quote: STRING>>"
)
BRIEF = (
    "why_ranked_here STRING, top_strengths ARRAY<STRING>, top_gaps ARRAY<STRING>, "
    "interview_probes ARRAY<STRING>, invite_line STRING, what_would_change_this_score STRING"
)

RUN_DIM = (
    "doc_id STRING, run_ix INT, dim STRING, score INT, evidence_status STRING, "
    "evidence ARRAY<STRUCT<quote: STRING, primary: BOOLEAN>>, confidence STRING, rationale STRING"
)
RUN_QUALIFIER = "doc_id STRING, run_ix INT, qualifier STRING, value BOOLEAN, quote STRING"
RUN_ROLE_TYPE = "doc_id STRING, run_ix INT, role_index INT, type STRING, quote STRING"
TEXT_RUN = "doc_id STRING, part STRING, para INT, run INT, text STRING, vanish BOOLEAN, color STRING"
LABELS = (
    "hires ARRAY<STRUCT<file: STRING, label: STRING, joined: STRING, reference: STRUCT<D1: INT, D2: INT, "
    "D3: INT, D4: INT, D5: INT, D6: INT, core: DOUBLE>>>"
)
DELIVERY_EVENT = "event_id STRING, provider_id STRING, type STRING, at TIMESTAMP"
COMMAND = "evaluation_id STRING, seq BIGINT, command STRING, refusal STRING"
