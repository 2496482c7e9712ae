"""Model outputs read as tables: extracts, scoring runs, briefs.

``from_json`` reads any shape; ranges and required parts are checked by ``operators.validity``, and rows
that fail are routed to review, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed, schemas
from sieveline.functions.bind import bind


def read_extracts(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON extracts → typed columns, missing arrays read as empty; ``readable`` tells the ones that parse."""
    parsed = raw.withColumn("_x", F.from_json(payload, schemas.EXTRACT_FIELDS))
    x = F.col("_x")

    def texts(values: Column) -> Column:
        return F.coalesce(values, F.array().cast("array<string>"))

    identity = F.struct(
        x["identity"]["name"].alias("name"),
        *[texts(x["identity"][k]).alias(k) for k in ("emails", "phones", "urls", "locations")],
    )
    types = dict(parsed.select("_x.*").dtypes)
    roles = F.transform(
        F.coalesce(x["roles"], F.array().cast(types["roles"])),
        lambda r: F.struct(
            *[r[k].alias(k) for k in ("title", "company_raw", "company_descriptor", "start_raw", "end_raw")],
            texts(r["bullets"]).alias("bullets"),
        ),
    )
    education = F.transform(
        F.coalesce(x["education"], F.array().cast(types["education"])),
        lambda e: F.struct(
            e["degree_field"].alias("degree_field"), e["institution_raw"].alias("institution_raw"),
            texts(e["certifications"]).alias("certifications"),
        ),
    )
    kept = [c for c in raw.columns if c != payload]
    return parsed.select(
        *kept,
        (x.isNotNull() & x["identity"].isNotNull() & x["roles"].isNotNull()).alias("readable"),
        identity.alias("identity"),
        roles.alias("roles"),
        education.alias("education"),
        x["summary_raw"].alias("summary_raw"),
        texts(x["skills_raw"]).alias("skills_raw"),
        x["relocation_statement"].alias("relocation_statement"),
    )


def parse_runs(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(doc_id, run_ix, JSON) → the parsed scoring run in column ``run``."""
    return raw.withColumn("run", F.from_json(payload, schemas.SCORER_OUTPUT)).drop(payload)


def run_dims(runs: DataFrame) -> DataFrame:
    """One row per (document, run, dimension); dimensions nobody knows are left to the validity report."""
    rows = runs.select("doc_id", "run_ix", F.explode("run.dimensions").alias("dim", "d"))
    none = F.array().cast("array<struct<quote:string,primary:boolean>>")
    return rows.filter(F.col("dim").isin(*fixed.SCORED_DIMS)).select(
        "doc_id", "run_ix", "dim", "d.score", "d.evidence_status", F.coalesce("d.evidence", none).alias("evidence"),
        "d.confidence", "d.rationale",
    )


def run_qualifiers(runs: DataFrame) -> DataFrame:
    rows = runs.select("doc_id", "run_ix", F.explode("run.d7_qualifiers").alias("qualifier", "q"))
    return rows.select("doc_id", "run_ix", "qualifier", "q.value", "q.quote")


def run_role_types(runs: DataFrame) -> DataFrame:
    rows = runs.select("doc_id", "run_ix", F.posexplode("run.role_types").alias("position", "t"))
    return rows.select("doc_id", "run_ix", "position", "t.role_index", "t.type", "t.quote")


def run_parts(runs: DataFrame) -> DataFrame:
    """One row per (document, run, part, name): the rows of run_dims, run_qualifiers and run_role_types as numbers.

    ``value`` is a score, 1 for a true qualifier or a role's index; ``quotes`` counts what stands for it. A run is
    parsed once for its three parts. Qualifiers without value and quote are left out.
    """
    none = F.array().cast("array<struct<part:string,name:string,value:bigint,quotes:bigint>>")

    def rows(values: Column, part: str, name, value, quotes) -> Column:
        made = F.transform(
            values,
            lambda x: F.struct(F.lit(part).alias("part"), name(x).alias("name"), value(x).cast("bigint").alias("value"), quotes(x).cast("bigint").alias("quotes")),
        )
        return F.coalesce(made, none)

    def opened(run: Column) -> Column:
        dims = F.filter(F.map_entries(run["dimensions"]), lambda e: e["key"].isin(*fixed.SCORED_DIMS))
        known = lambda q: q["quote"].isNotNull() | q["value"].isNotNull()
        asked = F.filter(F.map_entries(run["d7_qualifiers"]), lambda e: known(e["value"]))
        n_quotes = lambda e: F.when(e["value"]["evidence"].isNull(), 0).otherwise(F.size(e["value"]["evidence"]))
        return F.concat(
            rows(dims, "dimension", lambda e: e["key"], lambda e: e["value"]["score"], n_quotes),
            rows(asked, "qualifier", lambda e: e["key"], lambda e: F.coalesce(e["value"]["value"].cast("int"), F.lit(0)), lambda e: e["value"]["quote"].isNotNull()),
            rows(run["role_types"], "role", lambda t: t["type"], lambda t: t["role_index"], lambda t: t["quote"].isNotNull()),
        )

    # Outer: a plain inline would ask beforehand whether there are rows, and parse the run twice.
    parts = runs.select("doc_id", "run_ix", F.inline_outer(bind(F.col("run"), opened)))
    return parts.filter("part is not null")


def read_briefs(raw: DataFrame, payload: str = "payload") -> DataFrame:
    kept = [c for c in raw.columns if c != payload]
    return raw.withColumn("_b", F.from_json(payload, schemas.BRIEF)).select(*kept, "_b.*")
