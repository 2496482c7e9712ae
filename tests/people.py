"""Invented documents: nobody in them exists."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from sieveline import schemas

AS_OF = "2026-09-28"


def extract(doc_id="d1", **changes):
    # One trap a line: who is named, where, when, how, and what no reader of a profile may learn.
    newer = [
        "“He turns a fault report into a fix overnight” (plant review, Aug 2024)",
        "Replaced Glasswing's paper pick lists; the dock at Mundra copied them",
        "Took a sabbatical before this job",
        "Audited night shifts together with Mrs. Tanvi Deshmukh in Nagpur",
        "Questions go to Ruben: ruben.castellan@example.org, +91 80000 12345",
    ]
    older = ["Counted stock for 1998 customers and 2040 orders", "CPI 9.2, earned beside the job"]
    base = {
        "doc_id": doc_id,
        "summary_raw": "Ruben keeps stock honest. Speaks Tamil. Marital status: single.",
        "skills_raw": ["SQL", "Tamil", "Languages: Rust, Tamil, Zig"],
        "education": [{"degree_field": "B.Sc., Statistics", "institution_raw": "Riverbend Institute", "certifications": ["Six Sigma, NIT Trichy 2020"]}],
        "relocation_statement": None,
        "identity": {
            "name": "Ruben Castellan", "emails": ["ruben.castellan@example.org"], "phones": ["+91 80000 12345"], "urls": ["castellan.example.org/ruben"], "locations": ["Nagpur"],
        },
        "roles": [
            {"title": "Systems Manager", "company_raw": "Glasswing Industries LLP", "company_descriptor": "robotics maker with two sites", "start_raw": "Feb 2022", "end_raw": "Present", "bullets": newer},
            {"title": "Stock Analyst", "company_raw": "Pennywhistle Retail Group", "company_descriptor": "retail chain", "start_raw": "Sep 2018", "end_raw": "Jan 2022", "bullets": older},
        ],
    }
    out = copy.deepcopy(base)
    for key, value in changes.items():
        out[key] = value
    return out


def frame(spark, extracts, as_of=AS_OF):
    """Extract rows through their JSON form, as they arrive."""
    rows = [(e["doc_id"], json.dumps({k: v for k, v in e.items() if k != "doc_id"})) for e in extracts]
    df = spark.createDataFrame(rows, "doc_id string, payload string")
    return df.select(
        "doc_id", F.lit(as_of).cast("timestamp").alias("as_of"), F.from_json("payload", schemas.EXTRACT_FIELDS).alias("x")
    ).select("doc_id", "as_of", "x.*")
