"""Queries over model outputs: JSON written from the tables, read back, checked and opened into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.operators import validity
from sieveline.operators.skew import spread
from sieveline.plans.bindings import query, table, text_table
from sieveline.session import materialise
from sieveline.sources import model_outputs

# A line item is a scoring run. What is wrong with it follows from its numbers.
_SCORE_SQL = "CASE WHEN l_partkey % 11 = 0 THEN 7 ELSE CAST(floor((l_quantity - 1) / 10) AS INTEGER) END"
_CUT_SQL = "(l_partkey % 17 = 0)"
_MISSING_SQL = "(l_linenumber = 7)"


def scoring_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, run_ix, payload): a run as its model would write it, some cut short, some lacking parts."""
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", per_core=4)
    # Written as to_json writes it: a field without a value is left out. The fields that may lack one end in a comma.
    field = lambda name, value: F.coalesce(F.concat(F.lit(f'"{name}":'), value.cast("string"), F.lit(",")), F.lit(""))
    score = F.when(F.col("l_partkey") % 11 == 0, 7).otherwise(F.floor((F.col("l_quantity") - 1) / 10).cast("int"))
    n = F.col("l_suppkey") % 5
    quote = lambda i: f'{"," * (i > 1)}{{"quote":"quote {i}","primary":{"true" if i == 1 else "false"}}}'
    quotes = F.concat(F.lit("["), *[F.when(n >= i, quote(i)).otherwise("") for i in range(1, 5)], F.lit("]"))
    flag, tax = F.col("l_returnflag"), F.col("l_tax")
    status = F.when(flag == "A", "absent").when(flag == "N", "weak").otherwise("present")
    sure = F.when(F.col("l_discount") >= 0.07, "low").when(F.col("l_discount") >= 0.02, "high").otherwise("sure")
    dimension = F.concat(
        F.lit("{"), field("score", score), F.lit('"evidence_status":"'), status, F.lit('",'),
        F.when(F.col("l_discount") == 0.05, "").otherwise(F.concat(F.lit('"evidence":'), quotes, F.lit(","))),
        F.lit('"confidence":"'), sure, F.when(tax == 0.03, '"}').otherwise('","rationale":"because it says so"}'),
    )
    rest = F.concat(
        F.lit('"d7_qualifiers":{"built_from_zero":{'), field("value", F.col("l_quantity") > 25), F.lit('"quote":"q"},"early_stage_exposure":{'),
        F.when(tax != 0.06, '"value":true,').otherwise(""), F.lit('"quote":"q"}'),
        F.when(tax != 0.07, ',"senior_pm_layer_above":{"value":false}').otherwise(""), F.lit('},"role_types":[{'),
        field("role_index", (F.col("l_linenumber") - 1).cast("int")),
        F.when(F.col("l_shipdate") < "1995-01-01", '"type":"CEO",').otherwise('"type":"PM",'),
        F.lit('"quote":"q"},{"role_index":2,"type":"OTHER","quote":"r"}]}'),
    )
    # The dimensions of a run read alike: one is rendered, and written under each name.
    li = li.withColumn("_dimension", dimension)
    dims = [d for d in fixed.SCORED_DIMS if d != "D9"]
    listed = [x for at, d in enumerate(dims) for x in (F.lit(f'{"," * (at > 0)}"{d}":'), F.col("_dimension"))]
    last = F.when(F.col("l_linenumber") != 7, F.concat(F.lit(',"D9":'), F.col("_dimension"))).otherwise("")
    whole = F.concat(F.lit('{"dimensions":{'), *listed, last, F.lit("},"), rest)
    payload = F.when(F.col("l_partkey") % 17 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("run_ix"), payload.alias("payload"))


_PROBLEMS_SQL = f"""SELECT l_orderkey AS doc_id, l_linenumber AS run_ix, unnest(CASE WHEN {_CUT_SQL} THEN ['parsed', 'all_dimensions', 'score_range',
    'evidence_status', 'confidence', 'evidence_count', 'evidence_shape', 'rationale', 'qualifiers', 'role_index', 'role_type'] ELSE list_filter([
    CASE WHEN {_MISSING_SQL} THEN 'all_dimensions' END, CASE WHEN {_SCORE_SQL} NOT BETWEEN 0 AND 4 THEN 'score_range' END,
    CASE WHEN l_discount < 0.02 THEN 'confidence' END, CASE WHEN l_discount = 0.05 OR l_suppkey % 5 > 3 THEN 'evidence_count' END,
    CASE WHEN l_discount = 0.05 THEN 'evidence_shape' END, CASE WHEN l_tax = 0.03 THEN 'rationale' END,
    CASE WHEN l_tax IN (0.06, 0.07) THEN 'qualifiers' END, CASE WHEN l_linenumber = 1 THEN 'role_index' END,
    CASE WHEN l_shipdate < DATE '1995-01-01' THEN 'role_type' END], lambda x: x IS NOT NULL) END) AS problem FROM lineitem"""


@query("run_problems", f"SELECT doc_id, problem, count(*) AS n_runs FROM ({_PROBLEMS_SQL}) GROUP BY doc_id, problem")
def run_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a scoring run's JSON breaks, counted per document."""
    checked = validity.run_problems(model_outputs.parse_runs(scoring_payloads(spark, sf_dir)))
    # Outer: a plain explode would ask beforehand whether there are problems, and parse the run twice.
    named = checked.select("doc_id", F.explode_outer("problems").alias("problem")).filter("problem is not null")
    return named.groupBy("doc_id", "problem").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "invalid_outputs",
    f"SELECT DISTINCT doc_id, 'R' AS tier, 'invalid_output' AS tier_reason FROM ({_PROBLEMS_SQL})",
)
def invalid_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that go to review because one of their runs is not valid."""
    return validity.invalid_documents(model_outputs.parse_runs(scoring_payloads(spark, sf_dir)))


@query(
    "run_rows",
    f"""WITH ok AS (SELECT * FROM lineitem WHERE NOT {_CUT_SQL}),
      d AS (SELECT l_orderkey AS doc_id, 'dimension' AS part, d AS name, count(*) AS n, sum({_SCORE_SQL}) AS total,
              sum(CASE WHEN l_discount = 0.05 THEN 0 ELSE l_suppkey % 5 END) AS quotes
            FROM ok, (SELECT unnest({[*fixed.SCORED_DIMS]!r}) AS d) WHERE NOT (d = 'D9' AND {_MISSING_SQL}) GROUP BY ALL),
      q AS (SELECT l_orderkey AS doc_id, 'qualifier' AS part, q AS name, count(*) AS n,
              sum(CASE q WHEN 'built_from_zero' THEN CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END WHEN 'early_stage_exposure' THEN CASE WHEN l_tax <> 0.06 THEN 1 ELSE 0 END ELSE 0 END) AS total,
              sum(CASE q WHEN 'senior_pm_layer_above' THEN 0 ELSE 1 END) AS quotes
            FROM ok, (SELECT unnest({[*fixed.QUALIFIERS]!r}) AS q) WHERE NOT (q = 'senior_pm_layer_above' AND l_tax = 0.07) GROUP BY ALL),
      r AS (SELECT doc_id, 'role' AS part, name, count(*) AS n, sum(ix) AS total, count(*) AS quotes
            FROM (SELECT l_orderkey AS doc_id, CASE WHEN l_shipdate < DATE '1995-01-01' THEN 'CEO' ELSE 'PM' END AS name, l_linenumber - 1 AS ix FROM ok
                  UNION ALL SELECT l_orderkey, 'OTHER', 2 FROM ok) GROUP BY doc_id, name)
      SELECT doc_id, part, name, n, CAST(total AS BIGINT) AS total, CAST(quotes AS BIGINT) AS quotes FROM (SELECT * FROM d UNION ALL SELECT * FROM q UNION ALL SELECT * FROM r)""",
)
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring runs read from JSON and opened: dimensions, qualifiers and role types, added up per document."""
    parts = model_outputs.run_parts(model_outputs.parse_runs(scoring_payloads(spark, sf_dir)))
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("total"), F.sum("quotes").alias("quotes")]
    return parts.groupBy("doc_id", "part", "name").agg(*sums)


# ---- extracts ----


@query(
    "extract_rows",
    r"""WITH d AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls, doc_id % 13 = 0 AS cut, doc_id % 7 = 0 AS nobody, doc_id % 5 = 0 AS bare FROM documents)
        SELECT doc_id, NOT cut AND NOT nobody AS readable, CASE WHEN NOT cut AND NOT nobody THEN source END AS name, CASE WHEN cut THEN 0 ELSE 1 END AS n_roles,
               CASE WHEN cut OR bare THEN 0 ELSE len(ls) END AS n_bullets, CASE WHEN cut OR bare THEN 0 ELSE list_sum(list_transform(ls, lambda l: length(l))) END AS bullet_chars,
               CASE WHEN cut THEN 0 ELSE 1 END AS n_skills, CASE WHEN cut THEN NULL ELSE lang END AS statement FROM d""",
)
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' extracts written as JSON (some cut short, without a person, or without bullets) and read back."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text", "lang", "source"])
    number = F.col("doc_id")
    person = F.struct(F.col("source").alias("name"), F.array(F.lit("a@example.net")).alias("emails"))
    role = F.struct(F.lit("PM").alias("title"), F.col("lang").alias("company_raw"), F.when(number % 5 != 0, F.split("text", "\n")).alias("bullets"))
    whole = F.to_json(
        F.struct(F.when(number % 7 != 0, person).alias("identity"), F.array(role).alias("roles"), F.array(F.col("lang")).alias("skills_raw"), F.col("lang").alias("relocation_statement"))
    )
    raw = docs.select("doc_id", F.when(number % 13 == 0, F.substring(whole, 1, 5)).otherwise(whole).alias("payload"))
    read = model_outputs.read_extracts(materialise(raw))
    bullets = F.flatten(F.transform("roles", lambda r: r["bullets"]))
    return read.select(
        "doc_id", "readable", F.col("identity.name").alias("name"), F.size("roles").cast("long").alias("n_roles"), F.size(bullets).cast("long").alias("n_bullets"),
        F.aggregate(bullets, F.lit(0).cast("long"), lambda a, b: a + F.length(b)).alias("bullet_chars"), F.size("skills_raw").cast("long").alias("n_skills"),
        F.col("relocation_statement").alias("statement"),
    )


# ---- briefs ----

_TOKENS_SQL = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"


@query(
    "brief_problems",
    rf"""WITH d AS (SELECT doc_id, {_TOKENS_SQL} AS n, length(text) AS chars, len(list_filter(string_split(text, chr(10)), lambda l: l = '')) AS blank, len(string_split(text, chr(10))) AS lines FROM documents),
        p AS (SELECT doc_id, unnest(list_filter([CASE WHEN chars = 0 OR n > 60 THEN 'why_words' END, CASE WHEN doc_id % 3 <> 0 THEN 'three_strengths' END,
          CASE WHEN doc_id % 4 = 0 OR doc_id % 4 > 3 THEN 'gaps' END, CASE WHEN lines NOT BETWEEN 3 AND 5 OR blank > 0 THEN 'probes' END,
          CASE WHEN chars = 0 OR n > 30 THEN 'invite_words' END, CASE WHEN doc_id % 9 = 0 THEN 'one_change' END], lambda x: x IS NOT NULL)) AS problem FROM d)
        SELECT doc_id, problem FROM p""",
)
def brief_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs written as JSON from the documents, read back, with the rules they break."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    number = F.col("doc_id")
    three = F.when(number % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(number % 3 == 1, F.array(F.lit("a"), F.lit(""), F.lit("c"))).otherwise(F.array(F.lit("a")))
    gaps = F.when(number % 4 != 0, F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit(1), (number % 4).cast("int")))
    payload = F.to_json(
        F.struct(
            F.col("text").alias("why_ranked_here"), three.alias("top_strengths"), gaps.alias("top_gaps"), F.split("text", "\n").alias("interview_probes"),
            F.col("text").alias("invite_line"), F.when(number % 9 != 0, F.lit("more of it")).alias("what_would_change_this_score"),
        )
    )
    briefs = model_outputs.read_briefs(materialise(docs.select("doc_id", payload.alias("payload"))))
    return validity.brief_problems(briefs).select("doc_id", F.explode("problems").alias("problem"))
