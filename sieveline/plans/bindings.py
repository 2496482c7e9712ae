"""The operators run over the driver's tables: each query with the SQL that must give the same rows.

The tables hold no applications, so columns stand in for them: an order is a document, a line item a
scoring run of one dimension, an event a command, and so on. The stand-ins are set out in one place per
query, the work is the library's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import config as cfg
from sieveline import fixed
from sieveline.operators import combine, evidence, rank, reports
from sieveline.operators.skew import spread
from sieveline.session import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str]) -> DataFrame:
    """A table of texts, spread over the cores when it comes in too few pieces."""
    return spread(table(spark, sf_dir, name).select(key, *columns), key)


def long_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts as 64-bit numbers, the type the SQL gives them."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


NOW = "2024-02-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


# ---- line items as scoring runs ----

RUNS_SQL = """
runs AS (
  SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 7 THEN 'D8' ELSE 'D' || l_linenumber END AS dim,
         CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS raw_score,
         CASE l_returnflag WHEN 'A' THEN 'absent' WHEN 'N' THEN 'weak' ELSE 'present' END AS evidence_status,
         CASE WHEN l_discount >= 0.07 THEN 'low' WHEN l_discount >= 0.03 THEN 'medium' ELSE 'high' END AS raw_confidence,
         l_tax >= 0.08 AS bad_quote, CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS n_quotes,
         l_linestatus = 'O' AND l_tax <= 0.02 AS capped_only,
         l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
)"""
CHECKED_SQL = RUNS_SQL + """,
checked AS (
  SELECT *, bad_quote OR (raw_score >= 2 AND n_quotes = 0) AS failed,
         CASE WHEN evidence_status = 'absent' THEN least(raw_score, 1) ELSE raw_score END AS kept
  FROM runs
), scored AS (
  SELECT *, CASE WHEN failed THEN 0 WHEN kept > 1 AND n_quotes > 0 AND capped_only THEN 1 ELSE kept END AS score,
         CASE WHEN failed OR evidence_status = 'absent' THEN 'low' ELSE raw_confidence END AS confidence
  FROM checked
), medians AS (
  SELECT doc_id, dim, list_sort(list(score))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median,
         max(score) - min(score) AS spread
  FROM scored GROUP BY doc_id, dim
), chosen AS (
  SELECT s.*, m.median, m.spread,
         row_number() OVER (PARTITION BY s.doc_id, s.dim ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM scored s JOIN medians m ON s.doc_id = m.doc_id AND s.dim = m.dim AND s.score = m.median
), dims AS (
  SELECT doc_id, dim, median AS score, spread, failed AS quote_mismatch, evidence_status, confidence FROM chosen WHERE rn = 1
)"""


def lineitem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(F.col("l_linenumber") == 7, "D8").otherwise(F.concat(F.lit("D"), F.col("l_linenumber").cast("string"))).alias("dim"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("score"),
        F.when(flag == "A", "absent").when(flag == "N", "weak").otherwise("present").alias("evidence_status"),
        F.when(F.col("l_discount") >= 0.07, "low").when(F.col("l_discount") >= 0.03, "medium").otherwise("high").alias("confidence"),
        (F.col("l_tax") >= 0.08).alias("bad_quote"),
        F.when(F.col("l_tax") > 0, 1).otherwise(0).alias("n_quotes"),
        ((F.col("l_linestatus") == "O") & (F.col("l_tax") <= 0.02)).alias("capped_only"),
        "l_partkey", "l_suppkey", "l_extendedprice",
    )


RUN_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice"]


def lineitem_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined dimensions of every order, after the per-run quote rules."""
    runs = lineitem_runs(spark, sf_dir)
    checked = runs.withColumns(
        evidence.apply_quote_rules(F.col("bad_quote"), F.col("n_quotes"), F.col("capped_only"))
    ).withColumnRenamed("quote_failed", "quote_mismatch")
    return combine.combine_dims(
        checked, ["doc_id", "dim"], F.struct(*RUN_ORDER), ["evidence_status", "confidence", "quote_mismatch"]
    )


@query(
    "run_median",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_runs,
       list_sort(list(CAST(floor((l_quantity - 1) / 10) AS INTEGER)))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median,
       max(CAST(floor((l_quantity - 1) / 10) AS INTEGER)) - min(CAST(floor((l_quantity - 1) / 10) AS INTEGER)) AS spread
       FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
def run_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("score")
    )
    # Only the counters are asked for, so Catalyst prunes the earliest-run states away.
    out = combine.combine_dims(runs, ["l_orderkey", "l_linenumber"], F.col("l_partkey"), ["l_partkey"])
    return out.select("l_orderkey", "l_linenumber", "n_runs", F.col("score").alias("median"), "spread")


@query(
    "lowest_run_evidence",
    f"""WITH {RUNS_SQL}, m AS (
       SELECT doc_id, dim, list_sort(list(raw_score))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS score FROM runs GROUP BY doc_id, dim
     ), c AS (
       SELECT r.doc_id, r.dim, m.score, l_partkey, l_suppkey, evidence_status, raw_confidence AS confidence,
              row_number() OVER (PARTITION BY r.doc_id, r.dim ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn
       FROM runs r JOIN m ON r.doc_id = m.doc_id AND r.dim = m.dim AND r.raw_score = m.score)
     SELECT doc_id, dim, score, l_partkey, l_suppkey, evidence_status, confidence FROM c WHERE rn = 1""",
)
def lowest_run_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = lineitem_runs(spark, sf_dir)
    out = combine.combine_dims(
        runs, ["doc_id", "dim"], F.struct(*RUN_ORDER), ["l_partkey", "l_suppkey", "evidence_status", "confidence"]
    )
    return out.select("doc_id", "dim", "score", "l_partkey", "l_suppkey", "evidence_status", "confidence")


@query(
    "quote_rules",
    f"""WITH {CHECKED_SQL}
     SELECT dim, score, confidence, failed AS quote_failed,
            NOT failed AND kept > 1 AND n_quotes > 0 AND capped_only AS capped, count(*) AS n
     FROM scored GROUP BY ALL""",
)
def quote_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = lineitem_runs(spark, sf_dir)
    checked = runs.withColumns(
        evidence.apply_quote_rules(F.col("bad_quote"), F.col("n_quotes"), F.col("capped_only"))
    )
    return checked.groupBy("dim", "score", "confidence", "quote_failed", "capped").agg(F.count(F.lit(1)).alias("n"))


def _weights_sql(role: str, config: dict) -> str:
    return " + ".join(
        f"coalesce(s_{d.lower()}, 0) / 4.0 * {w}" for d, w in config["weights"][role].items() if d != "D7"
    )


def _doc_sql() -> str:
    cells = [f"max(CASE WHEN dim = '{d}' THEN score END) AS s_{d.lower()}" for d in fixed.SCORED_DIMS]
    for role, dims in fixed.COUNTED_DIMS.items():
        member = "dim IN (" + ", ".join(f"'{d}'" for d in dims) + ")"
        low = role.lower()
        cells += [
            f"count(*) FILTER (WHERE {member} AND quote_mismatch) AS mismatches_{low}",
            f"count(*) FILTER (WHERE {member} AND evidence_status = 'absent') AS absent_{low}",
            f"count(*) FILTER (WHERE {member} AND evidence_status <> 'absent' AND confidence <> 'low') AS evidenced_{low}",
            f"count(*) FILTER (WHERE {member} AND score = 4) AS fours_{low}",
            f"max(CASE WHEN {member} THEN spread END) AS spread_{low}",
        ]
    return f"docs AS (SELECT doc_id, {', '.join(cells)} FROM dims GROUP BY doc_id)"


@query(
    "weighted_totals",
    f"""WITH {CHECKED_SQL}, {_doc_sql()}
     SELECT doc_id, CAST({_weights_sql('PM', fixed.DEFAULT_CONFIG)} AS DOUBLE) AS pm_total,
            CAST({_weights_sql('SPM', fixed.DEFAULT_CONFIG)} AS DOUBLE) AS spm_total,
            CAST({_weights_sql('CORE', fixed.DEFAULT_CONFIG)} AS DOUBLE) AS core_score FROM docs""",
)
def weighted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.document_row(lineitem_dims(spark, sf_dir), ["doc_id"])
    config = cfg.literal(fixed.DEFAULT_CONFIG)
    return rows.select(
        "doc_id", *[rank.weighted_total(r, config).alias(n) for r, n in (("PM", "pm_total"), ("SPM", "spm_total"), ("CORE", "core_score"))]
    )


# An order's priority is the role applied for, its price the years, its status the state of its dates.
FACTS_SQL = """
facts AS (
  SELECT o_orderkey AS doc_id, o_orderdate,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SPM' WHEN o_orderpriority = '3-MEDIUM' THEN 'NOT_SURE' ELSE 'PM' END AS role_applied,
         floor(o_totalprice / 40000 * 4 + 0.5) / 4 AS years,
         o_orderstatus = 'P' AND o_totalprice < 60000 AS unparseable_dates,
         o_orderstatus = 'F' AS built, o_orderstatus = 'O' AS early, o_totalprice > 300000 AS senior,
         o_totalprice BETWEEN 100000 AND 110000 AS copies
  FROM orders
)"""


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    priority, price, status = F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("doc_id"), "o_orderdate",
        F.when(priority.isin("1-URGENT", "2-HIGH"), "SPM").when(priority == "3-MEDIUM", "NOT_SURE").otherwise("PM").alias("role_applied"),
        (F.floor(price / 40000 * 4 + 0.5) / 4).alias("pm_relevant_years"),
        ((status == "P") & (price < 60000)).alias("unparseable_dates"),
        (status == "F").alias("built_from_zero"), (status == "O").alias("early_stage_exposure"),
        (price > 300000).alias("senior_pm_layer_above"),
        price.between(100000, 110000).alias("copies_reference"),
    )


def _rank_sql(config: dict) -> str:
    t = config["tiers"]
    d7_pm = "CASE WHEN years <= 0 THEN 0 WHEN years < 1.5 THEN 1 WHEN years < 2 THEN 2 WHEN years < 4 THEN CASE WHEN built THEN 4 ELSE 3 END WHEN years < 6 THEN 2 ELSE 1 END"
    d7_spm = "CASE WHEN years <= 0 THEN 0 WHEN years < 4 THEN 1 WHEN years < 5 THEN 2 WHEN years < 8 THEN CASE WHEN NOT senior AND early THEN 4 ELSE 3 END WHEN years < 10 THEN 2 ELSE 1 END"
    floor_pm, floor_spm = config["pmExperienceFloorYears"], config["spmExperienceFloorYears"]
    return f"""
d7 AS (SELECT docs.*, facts.* EXCLUDE (doc_id), {d7_pm} AS d7_pm, {d7_spm} AS d7_spm FROM docs JOIN facts USING (doc_id)),
totals AS (
  SELECT *, CAST({_weights_sql('PM', config)} + d7_pm / 4.0 * {config['weights']['PM']['D7']} AS DOUBLE) AS pm_total,
         CAST({_weights_sql('SPM', config)} + d7_spm / 4.0 * {config['weights']['SPM']['D7']} AS DOUBLE) AS spm_total,
         CAST({_weights_sql('CORE', config)} AS DOUBLE) AS core_score FROM d7
), roles AS (
  SELECT *, CASE WHEN spm_total > pm_total THEN 'SPM' ELSE 'PM' END AS best_fit_role,
         CASE WHEN role_applied = 'NOT_SURE' THEN CASE WHEN spm_total > pm_total THEN 'SPM' ELSE 'PM' END ELSE role_applied END AS role_used
  FROM totals
), picked AS (
  SELECT *, CASE role_used WHEN 'PM' THEN pm_total ELSE spm_total END AS total,
         CASE role_used WHEN 'PM' THEN mismatches_pm ELSE mismatches_spm END AS mismatches,
         CASE role_used WHEN 'PM' THEN absent_pm ELSE absent_spm END AS absents,
         CASE role_used WHEN 'PM' THEN evidenced_pm ELSE evidenced_spm END AS evidenced,
         CASE role_used WHEN 'PM' THEN fours_pm ELSE fours_spm END AS fours,
         coalesce(CASE role_used WHEN 'PM' THEN spread_pm ELSE spread_spm END >= {config['unstableSpread']}, false) AS unstable,
         CASE role_used WHEN 'PM' THEN years < {floor_pm} ELSE years < {floor_spm} END AS below,
         CASE role_used WHEN 'PM' THEN d7_pm ELSE d7_spm END AS d7
  FROM roles
), reviewed AS (
  SELECT *, array_to_string(list_filter([CASE WHEN unparseable_dates THEN 'unparseable_dates' END, CASE WHEN unstable THEN 'unstable_score' END,
           CASE WHEN mismatches >= 3 THEN 'quote_mismatch' END, CASE WHEN absents >= 3 THEN 'absent_evidence' END], lambda x: x IS NOT NULL), ', ') AS review,
         array_to_string(list_filter([CASE WHEN below AND role_used = 'PM' THEN 'capped_pm_experience_floor' END,
           CASE WHEN below AND role_used = 'SPM' THEN 'capped_spm_experience_floor' END,
           CASE WHEN {str(config['experienceBandStrict']).lower()} AND d7 <= 2 THEN 'capped_experience_band' END,
           CASE WHEN {str(config['d1GateForTierA']).lower()} AND coalesce(s_d1, 0) < 2 THEN 'capped_d1_gate' END], lambda x: x IS NOT NULL), ', ') AS caps
  FROM picked
), tiered AS (
  SELECT *, CASE WHEN review <> '' THEN 'R' WHEN total < {t['C']} THEN CASE WHEN evidenced >= 4 THEN 'D' ELSE 'R' END
         WHEN total >= {t['A']} THEN CASE WHEN caps <> '' THEN 'B' ELSE 'A' END WHEN total >= {t['B']} THEN 'B' ELSE 'C' END AS tier,
         CASE WHEN review <> '' THEN review WHEN total < {t['C']} AND evidenced < 4 THEN 'insufficient_evidence'
         WHEN total >= {t['A']} AND caps <> '' THEN caps END AS tier_reason,
         list_filter([CASE WHEN coalesce(s_d1,0) <= 2 AND coalesce(s_d2,0) >= 3 AND coalesce(s_d3,0) >= 3 AND coalesce(s_d4,0) >= 3 THEN 'WILDCARD' END,
           CASE WHEN fours > 0 THEN 'VERIFY_CLAIM' END, CASE WHEN mismatches > 0 THEN 'QUOTE_MISMATCH' END,
           CASE WHEN unstable THEN 'UNSTABLE_SCORE' END, CASE WHEN copies THEN 'INTEGRITY_CHECK' END,
           CASE WHEN below THEN 'BELOW_EXPERIENCE_BAND' END,
           CASE WHEN role_applied = 'PM' AND years > 5 AND coalesce(s_d3,0) >= 3 THEN 'CONSIDER_SPM' END,
           CASE WHEN role_applied = 'SPM' AND years < 4 THEN 'CONSIDER_PM' END,
           CASE WHEN role_applied = 'SPM' AND years > 10 THEN 'LEVEL_CHECK' END], lambda x: x IS NOT NULL) AS flags
  FROM reviewed
)"""


RANKED_SQL = f"WITH {CHECKED_SQL}, {_doc_sql()}, {FACTS_SQL}, {_rank_sql(fixed.DEFAULT_CONFIG)}"


def ranked_orders(spark: SparkSession, sf_dir: str, config: dict[str, Column] | None = None) -> DataFrame:
    rows = rank.document_row(lineitem_dims(spark, sf_dir), ["doc_id"]).join(order_facts(spark, sf_dir), "doc_id")
    return rank.rank_rows(rows, config or cfg.literal(fixed.DEFAULT_CONFIG))


@query(
    "tier_ladder",
    RANKED_SQL + " SELECT doc_id, role_used, best_fit_role, d7_pm, d7_spm, pm_total, spm_total, core_score, tier, tier_reason FROM tiered",
)
def tier_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_orders(spark, sf_dir).select(
        "doc_id", "role_used", "best_fit_role", "d7_pm", "d7_spm", "pm_total", "spm_total", "core_score", "tier", "tier_reason"
    )


@query(
    "flag_arrays",
    RANKED_SQL
    + """ SELECT doc_id, array_to_string(list_sort(flags), ',') AS flags,
          array_to_string(list_sort(list_distinct(list_concat(CASE WHEN early THEN ['LEGACY'] ELSE ['INTEGRITY_CHECK'] END, flags))), ',') AS merged
          FROM tiered""",
)
def flag_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("early_stage_exposure"), F.array(F.lit("LEGACY"), F.lit("WILDCARD"))).otherwise(
        F.array(F.lit("INTEGRITY_CHECK"), F.lit("UNSTABLE_SCORE"))
    )
    return ranked_orders(spark, sf_dir).select(
        "doc_id",
        F.array_join(F.array_sort("flags"), ",").alias("flags"),
        F.array_join(F.array_sort(rank.merge_flags(old, F.col("flags"))), ",").alias("merged"),
    )


@query(
    "shortlist_sections",
    RANKED_SQL
    + """, listed AS (
       SELECT doc_id, o_orderdate, total, unnest(list_concat([tier], CASE WHEN list_contains(flags, 'WILDCARD') THEN ['WILDCARD'] ELSE [] END)) AS section,
              CASE WHEN role_used = 'PM' AND spm_total - pm_total >= 10 THEN 'SPM' WHEN role_used = 'SPM' AND pm_total - spm_total >= 10 THEN 'PM' END AS better_fit
       FROM tiered)
     SELECT section, doc_id, total AS ranked_total, better_fit,
            row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'R' THEN 0 ELSE -total END, o_orderdate, doc_id) AS section_rank
     FROM listed""",
)
def shortlist_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked_orders(spark, sf_dir).select(
        "doc_id", F.col("o_orderdate").alias("created_at"), rank.eval_status(F.col("tier")).alias("status"), "tier", "flags",
        "role_applied", "role_used", "pm_total", "spm_total",
    )
    # The ranks are read three times to number them, so they are written once, as a stage would be.
    return reports.shortlist_sections(materialise(rows)).select("section", "doc_id", "ranked_total", "better_fit", "section_rank")


WHAT_IF = {
    "default": fixed.DEFAULT_CONFIG,
    "strict": {**fixed.DEFAULT_CONFIG, "experienceBandStrict": True, "d1GateForTierA": True, "tiers": {"A": 60, "B": 45, "C": 30}},
    "steady": {**fixed.DEFAULT_CONFIG, "unstableSpread": 4, "tiers": {"A": 50, "B": 35, "C": 20}, "spmExperienceFloorYears": 1},
}


@query(
    "rescore_whatif",
    " UNION ALL ".join(
        f"(WITH {CHECKED_SQL}, {_doc_sql()}, {FACTS_SQL}, {_rank_sql(c)} SELECT '{n}' AS config_id, tier, count(*) AS n FROM tiered GROUP BY tier)"
        for n, c in WHAT_IF.items()
    ),
)
def rescore_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.document_row(lineitem_dims(spark, sf_dir), ["doc_id"]).join(order_facts(spark, sf_dir), "doc_id")
    # The fan-out comes after the runs are combined: one row per document and configuration.
    fanned = rows.withColumn("config_id", F.explode(F.array(*[F.lit(n) for n in WHAT_IF])))
    joined = fanned.join(cfg.config_frame(spark, WHAT_IF, key="config_id"), "config_id")
    return rank.rank_rows(joined, cfg.from_frame()).groupBy("config_id", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reuse_limit",
    """WITH u AS (
      SELECT l_linestatus, l_partkey, CASE l_linenumber WHEN 7 THEN 'D8' ELSE 'D' || l_linenumber END AS dim, l_linenumber,
             l_returnflag = 'R' AS is_primary, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS score,
             row_number() OVER (PARTITION BY l_linestatus, l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey, l_extendedprice) AS rn
      FROM lineitem
    ), f AS (
      SELECT *, CASE dim WHEN 'D1' THEN 20 WHEN 'D6' THEN 5 WHEN 'D8' THEN 0 ELSE 15 END AS weight FROM u WHERE rn = 1
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY l_linestatus, l_partkey ORDER BY is_primary DESC, score DESC, weight DESC, l_linenumber) AS use_rank FROM f
    ), k AS (
      SELECT l_linestatus, l_partkey, string_agg(dim, ' and ' ORDER BY use_rank) AS kept FROM r WHERE use_rank <= 2 GROUP BY ALL
    ) SELECT r.l_linestatus, r.l_partkey, r.dim, r.score, CAST(r.use_rank AS INTEGER) AS use_rank, r.use_rank > 2 AS over_limit, k.kept
      FROM r JOIN k ON r.l_linestatus = k.l_linestatus AND r.l_partkey = k.l_partkey""",
)
def reuse_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spread(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", "l_suppkey").select(
        "l_linestatus", "l_partkey", "l_orderkey", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_linenumber") == 7, "D8").otherwise(F.concat(F.lit("D"), F.col("l_linenumber").cast("string"))).alias("dim"),
        (F.col("l_returnflag") == "R").alias("primary"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("score"),
    )
    first = F.min_by(F.struct("primary", "score"), F.struct("l_orderkey", "l_suppkey", "l_extendedprice")).alias("f")
    uses = runs.groupBy("l_linestatus", "l_partkey", "dim").agg(first).select("l_linestatus", "l_partkey", "dim", "f.*")
    weight = cfg.weight_of(cfg.literal(fixed.DEFAULT_CONFIG), F.lit("PM"), F.col("dim"))
    limited = combine.limit_reuse(uses.withColumn("weight", weight), ["l_linestatus"], "l_partkey")
    return limited.select(
        "l_linestatus", "l_partkey", "dim", "score", "use_rank", "over_limit", F.array_join("kept_dims", " and ").alias("kept")
    )


# ---- votes ----


@query(
    "majority_vote",
    """WITH v AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS pm, count(*) FILTER (WHERE role = 'assistant') AS po,
         count(*) FILTER (WHERE role = 'system') AS ot, count(*) AS n,
         count(*) FILTER (WHERE length(text) > 400) AS yes, bool_or(length(text) > 400 AND role = 'assistant') AS quoted
       FROM conversations GROUP BY conv_id)
     SELECT conv_id, CASE WHEN pm > po AND pm > ot THEN 'PM' WHEN po > pm AND po > ot THEN 'PRODUCT_OWNING' ELSE 'OTHER' END AS type,
            yes * 2 > n AND quoted AS qualified FROM v""",
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    long = F.length("text") > 400
    votes = turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("pm"),
        F.count_if(F.col("role") == "assistant").alias("po"),
        F.count_if(F.col("role") == "system").alias("ot"),
        combine.strict_majority(long, F.col("role") == "assistant", F.count(F.lit(1))).alias("qualified"),
    )
    counts = {"PM": F.col("pm"), "PRODUCT_OWNING": F.col("po"), "OTHER": F.col("ot"), "INTERNSHIP": F.lit(0).cast("bigint")}
    return votes.select("conv_id", combine.vote(counts, F.lit(0), "OTHER").alias("type"), "qualified")


@query(
    "event_vote",
    """WITH v AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) FILTER (WHERE event_type = 'signup') AS b,
         count(*) FILTER (WHERE event_type IN ('view', 'error')) AS c, count(*) FILTER (WHERE event_type = 'click') AS e FROM events GROUP BY ALL)
     SELECT user_id, CAST(d AS VARCHAR) AS day, CASE WHEN a > b AND a > c AND a > e THEN 'PM' WHEN b > a AND b > c AND b > e THEN 'PRODUCT_OWNING'
       WHEN e > a AND e > b AND e > c THEN 'INTERNSHIP' ELSE 'OTHER' END AS type FROM v""",
)
def event_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    votes = events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(
        F.count_if(kind == "purchase").alias("a"), F.count_if(kind == "signup").alias("b"),
        F.count_if(kind.isin("view", "error")).alias("c"), F.count_if(kind == "click").alias("e"),
    )
    counts = {"PM": F.col("a"), "PRODUCT_OWNING": F.col("b"), "OTHER": F.col("c"), "INTERNSHIP": F.col("e")}
    return votes.select("user_id", "day", combine.vote(counts, F.lit(0), "OTHER").alias("type"))
