"""Queries over orders, customers and events: experience, reports, decisions, outbox, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline import config as cfg
from sieveline import fixed
from sieveline.functions import dates, text as tx
from sieveline.operators import decisions, experience, outbox, reports, retention, validity
from sieveline.operators.skew import latest_per_key
from sieveline.plans.bindings import NOW, long_counts, now, query, table
from sieveline.sources import stages

TS = "TIMESTAMP '%s'" % NOW
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]


def pools_of(spark: SparkSession, names: list[str]) -> DataFrame:
    """The values of a column as pools, all under the default configuration."""
    return cfg.config_frame(spark, {name: fixed.DEFAULT_CONFIG for name in names})


def minutes_sql(ts: str) -> str:
    return f"CAST(floor(epoch_us({ts}) / 60000000) AS BIGINT)"


def minutes(ts: Column) -> Column:
    return F.floor(dates.micros(ts) / 60_000_000).cast("bigint")


# ---- experience ----


@query(
    "experience_years",
    """WITH r AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS first, CAST(left(o_orderpriority, 1) AS INTEGER) * 4 AS months,
         CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END AS rate FROM orders),
       m AS (SELECT o_custkey, unnest(range(first, first + months)) AS month, rate FROM r WHERE rate > 0),
       b AS (SELECT o_custkey, month, max(rate) AS rate FROM m GROUP BY ALL),
       y AS (SELECT o_custkey, floor(CAST(sum(rate) AS DOUBLE) / 12 * 4 + 0.5) / 4 AS years FROM b GROUP BY ALL)
       SELECT o_custkey, years,
         CASE WHEN years <= 0 THEN 0 WHEN years < 1.5 THEN 1 WHEN years < 2 THEN 2 WHEN years < 4 THEN 3 WHEN years < 6 THEN 2 ELSE 1 END AS d7_pm,
         CASE WHEN years <= 0 THEN 0 WHEN years < 4 THEN 1 WHEN years < 5 THEN 2 WHEN years < 8 THEN 4 WHEN years < 10 THEN 2 ELSE 1 END AS d7_spm FROM y""",
)
def experience_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dates.month_index(F.col("o_orderdate"))
    months = F.substring("o_orderpriority", 1, 1).cast("int") * 4
    kind = F.when(F.col("o_orderstatus") == "F", "PM").when(F.col("o_orderstatus") == "O", "PRODUCT_OWNING").otherwise("OTHER")
    spans = table(spark, sf_dir, "orders").select(
        "o_custkey", first.alias("first"), (first + months - 1).alias("last"), experience.rate_of(kind).alias("rate")
    )
    years = experience.years_from_spans(spans, ["o_custkey"])
    no, yes = F.lit(False), F.lit(True)
    return years.select(
        "o_custkey", "years",
        experience.band_score("PM", F.col("years"), no, yes, no).alias("d7_pm"),
        experience.band_score("SPM", F.col("years"), no, yes, no).alias("d7_spm"),
    )


@query(
    "raw_dates",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS p, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders),
       s AS (SELECT o_orderkey, CASE p WHEN '4-NOT SPECIFIED' THEN y * 12 WHEN '5-LOW' THEN NULL ELSE y * 12 + m - 1 END AS first FROM o)
       SELECT o_orderkey, first, CASE WHEN first IS NULL THEN NULL ELSE 2024 * 12 + 1 - first + 1 END AS months,
         CASE WHEN first IS NULL THEN 'duration unknown'
              WHEN 24290 - first < 12 THEN (24290 - first) || 'm' WHEN (24290 - first) % 12 = 0 THEN (24290 - first) // 12 || 'y'
              ELSE (24290 - first) // 12 || 'y ' || (24290 - first) % 12 || 'm' END AS duration FROM s""",
)
def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written out in five ways, the last of them unreadable, read back as roles still held."""
    day, priority = F.col("o_orderdate"), F.col("o_orderpriority")
    written = (
        F.when(priority == "1-URGENT", F.date_format(day, "MMM yyyy"))
        .when(priority == "2-HIGH", F.date_format(day, "MM/yyyy"))
        .when(priority == "3-MEDIUM", F.date_format(day, "yyyy-MM"))
        .when(priority == "4-NOT SPECIFIED", F.date_format(day, "yyyy"))
        .otherwise(F.concat(F.lit("some time in "), F.date_format(day, "yyyy")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.role_span(written, F.lit(None).cast("string"), now()).alias("span"))
    months = F.col("span.months")
    result = rows.select("o_orderkey", F.col("span.first").alias("first"), months.alias("months"), dates.duration_text(months).alias("duration"))
    return long_counts(result, "first", "months")


@query(
    "clocks",
    f"""SELECT event_id, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS local_day,
        CAST(floor((epoch_us({TS}) - epoch_us(ts)) / 86400000000) AS INTEGER) AS days,
        epoch_us({TS}) - epoch_us(ts) >= 3 * 86400000000 AS nudge_age,
        CAST(greatest(0, floor((epoch_us(TIMESTAMP '2024-03-31 18:29:59') - epoch_us(ts)) / 604800000000)) AS INTEGER) AS weeks_left,
        CASE WHEN event_id % 11 BETWEEN 1 AND 8 THEN CAST(least(30 * power(2, event_id % 11 - 1), 900) AS INTEGER) END AS backoff,
        day(ts) || ' ' || monthname(ts) || ' ' || year(ts) AS long_day, {minutes_sql("ts + INTERVAL 10 MINUTE")} AS window_ends FROM events""",
)
def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", dates.local_date(ts).cast("string").alias("local_day"), dates.whole_days(ts, now()).alias("days"),
        dates.older_than(ts, F.lit(3), now()).alias("nudge_age"),
        dates.weeks_left(F.lit("2024-03-31").cast("date"), ts).alias("weeks_left"),
        dates.backoff_seconds(F.col("event_id") % 11).alias("backoff"),
        dates.long_date(ts).alias("long_day"),
        minutes(decisions.undo_window_ends(ts, F.lit(10), F.lit(None).cast("string"))).alias("window_ends"),
    )


@query(
    "person_names",
    """SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS first_name, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, 'CV ' || left(CAST(c_custkey AS VARCHAR), 8)) AS shown,
       replace(replace('<' || c_name || ' & ''co''>', '&', '&amp;'), '<', '&lt;') AS half_escaped, floor(c_acctbal * 10 + 0.5) / 10 AS rounded FROM customer""",
)
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    odd = F.concat(F.lit("<"), F.col("c_name"), F.lit(" & 'co'>"))
    return c.select(
        "c_custkey", tx.first_name(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "), F.col("c_name"))).alias("first_name"),
        reports.display_name(F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.lit(None).cast("string"), F.col("c_custkey").cast("string")).alias("shown"),
        F.replace(F.replace(tx.html_escape(odd), F.lit("&gt;"), F.lit(">")), F.lit("&#39;"), F.lit("'")).alias("half_escaped"),
        dates.half_up(F.col("c_acctbal"), 1).alias("rounded"),
    )


# ---- reports ----


@query(
    "last_event",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return latest_per_key(events, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type", "event_id", "value"])


@query(
    "pool_rows",
    """WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, 'CV ' || left(CAST(o_orderkey AS VARCHAR), 8)) AS name,
              e.event_type AS last_kind FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN e ON e.user_id = o_orderkey AND rn = 1
       WHERE o_orderstatus = 'F' AND lower(coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, 'CV ' || left(CAST(o_orderkey AS VARCHAR), 8))) LIKE '%omer#0000%'""",
)
def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluations = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderstatus").alias("pool_id")
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("candidate_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("display_name"),
        F.lit(None).cast("string").alias("file_name"), F.lit(False).alias("no_contact"),
    )
    emails = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("evaluation_id"), F.col("event_id").alias("email_id"), F.col("event_type").alias("kind"),
        F.lit("sent").alias("status"), F.col("ts").alias("created_at"),
    )
    rows = reports.shortlist_filter(reports.pool_rows(evaluations, people, emails, "F"), name_part=" OMER#0000 ")
    return rows.select(F.col("doc_id").alias("o_orderkey"), "name", F.col("last_email.kind").alias("last_kind"))


STATUS_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'offer' WHEN 'O' THEN 'interviewed' ELSE 'booked' END
  WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'declined' WHEN 'O' THEN 'withdrawn' ELSE 'hold' END
  WHEN '3-MEDIUM' THEN 'advanced' WHEN '4-NOT SPECIFIED' THEN 'scored' END"""


def order_status() -> Column:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    pick = lambda f, o, p: F.when(status == "F", f).when(status == "O", o).otherwise(p)
    return (
        F.when(priority == "1-URGENT", pick("offer", "interviewed", "booked"))
        .when(priority == "2-HIGH", pick("declined", "withdrawn", "hold"))
        .when(priority == "3-MEDIUM", "advanced")
        .when(priority == "4-NOT SPECIFIED", "scored")
    )


@query(
    "status_counts",
    f"""WITH s AS (SELECT year(o_orderdate) AS pool_id, {STATUS_SQL} AS st FROM orders) SELECT pool_id, """
    + ", ".join(f"count(*) FILTER (WHERE st = '{s}') AS n_{s}" for s in fixed.PIPELINE_STATUSES)
    + " FROM s GROUP BY pool_id",
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("pool_id"), order_status().alias("pipeline_status"))
    result = reports.pipeline_counts(rows, ["pool_id"])
    return long_counts(result, "pool_id")


@query(
    "status_order",
    f"""WITH s AS (SELECT o_orderkey AS doc_id, {STATUS_SQL} AS st, CAST(floor((epoch_us({TS}) - epoch_us(o_orderdate)) / 86400000000) AS INTEGER) AS days FROM orders)
       SELECT doc_id, coalesce(st, 'queued') AS shown_status, days AS days_in_status,
       coalesce(list_position(['offer','interviewed','booked','advanced','hold','scored','declined','withdrawn'], st) - 1, 99) AS status_rank FROM s""",
)
def status_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), order_status().alias("pipeline_status"), F.lit("queued").alias("status"),
        F.col("o_orderdate").alias("pipeline_status_at"),
    )
    return reports.pipeline_table(rows, now()).select("doc_id", "shown_status", "days_in_status", "status_rank")


@query(
    "progress_chips",
    """SELECT CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'redacted · waiting to be scored' WHEN o_orderstatus = 'O' THEN 'queued'
         WHEN o_orderstatus = 'F' THEN 'scored · tier ' || left(o_orderpriority, 1) ELSE 'needs review · ' || o_orderpriority END AS chip, count(*) AS n
       FROM orders GROUP BY chip""",
)
def progress_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.when(status == "O", "queued").when(status == "F", "scored").otherwise("needs_review").alias("status"),
        (F.col("o_totalprice") > 200000).alias("prepared"), F.substring("o_orderpriority", 1, 1).alias("tier"),
        F.col("o_orderpriority").alias("tier_reason"),
    )
    return rows.select(reports.progress_chip().alias("chip")).groupBy("chip").agg(F.count(F.lit(1)).alias("n"))


@query(
    "decision_overrides",
    """WITH d AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'advance' WHEN 'O' THEN 'decline' ELSE 'hold' END AS action,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' WHEN '4-NOT SPECIFIED' THEN 'D' ELSE 'R' END AS tier,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_totalprice > 50000),
       g AS (SELECT tier, CASE tier WHEN 'A' THEN action = 'advance' WHEN 'C' THEN action = 'hold' WHEN 'D' THEN action = 'decline' END AS agreed FROM d WHERE rn = 1)
       SELECT tier AS recommended_tier, count(*) AS n, count(*) FILTER (WHERE agreed) AS n_agreed, avg(CAST(agreed AS INTEGER)) AS agreement FROM g GROUP BY tier""",
)
def decision_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions, the cheap ones undone: the newest that stands per customer against its tier."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    tier = F.translate(F.substring(priority, 1, 1), "12345", "ABCDR")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("evaluation_id"),
        F.when(status == "F", "advance").when(status == "O", "decline").otherwise("hold").alias("action"),
        tier.alias("recommended_tier"), F.col("o_orderdate").alias("decided_at"),
        F.when(F.col("o_totalprice") <= 50000, F.col("o_orderdate")).alias("undone_at"),
    )
    return reports.decision_overrides(rows)


@query(
    "reason_words",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'The three scoring runs disagreed too much. Three or more dimensions had quotes not found in the CV.'
         WHEN 'O' THEN 'no such reason' ELSE 'Capped at B: D1 below 2 (D1 gate is on).' END AS reason_text FROM orders""",
)
def reason_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    reason = F.when(status == "F", "unstable_score, quote_mismatch").when(status == "O", "no such reason").otherwise("capped_d1_gate")
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.reason_text(reason).alias("reason_text"))


EVENT_ROWS_SQL = """ev AS (SELECT event_id AS doc_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, ts,
  CASE event_type WHEN 'view' THEN 'scored' WHEN 'click' THEN 'advanced' WHEN 'signup' THEN 'booked' WHEN 'purchase' THEN 'interviewed' ELSE 'offer' END AS st,
  value, user_id FROM events)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "scored").when(kind == "click", "advanced").when(kind == "signup", "booked")
        .when(kind == "purchase", "interviewed").otherwise("offer")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), dates.local_date(F.col("ts")).cast("string").alias("pool_id"),
        status.alias("pipeline_status"), F.when(F.col("value") > 1, "scored").otherwise("queued").alias("status"),
        F.lit(None).cast("timestamp").alias("pipeline_status_at"), F.col("ts").alias("created_at"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), "value",
        F.when(F.col("value") > 150, F.array(F.lit("BOUNCED"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


@query(
    "digest_row",
    f"""WITH {EVENT_ROWS_SQL} SELECT CAST(day AS VARCHAR) AS pool_id, count(*) FILTER (WHERE st = 'scored' AND value > 1) AS n_waiting,
        coalesce(max(CAST(floor((epoch_us({TS}) - epoch_us(ts)) / 86400000000) AS INTEGER)) FILTER (WHERE st = 'scored' AND value > 1), 0) AS oldest_days,
        count(*) FILTER (WHERE st = 'advanced') AS n_advanced, count(*) FILTER (WHERE st = 'booked') AS n_booked,
        count(*) FILTER (WHERE st = 'interviewed') AS n_interviewed, count(*) FILTER (WHERE st = 'offer') AS n_offer FROM ev GROUP BY day""",
)
def digest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.digest_counts(event_rows(spark, sf_dir), now(), ["pool_id"])


@query(
    "digest_lists",
    f"""WITH {EVENT_ROWS_SQL}, i AS (
         SELECT CAST(day AS VARCHAR) AS pool_id, 'interviewed' AS section, doc_id, 'user ' || user_id AS name FROM ev WHERE st = 'interviewed'
         UNION ALL SELECT CAST(day AS VARCHAR), 'not_booked', doc_id, 'user ' || user_id || CASE WHEN value > 90 THEN ' (nudged)' ELSE '' END FROM ev WHERE st = 'advanced'
         UNION ALL SELECT CAST(day AS VARCHAR), 'bounced', doc_id, 'user ' || user_id FROM ev WHERE value > 150)
       SELECT pool_id, section, count(*) OVER (PARTITION BY pool_id, section) AS n,
              row_number() OVER (PARTITION BY pool_id, section ORDER BY doc_id, name) AS position, name FROM i""",
)
def digest_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    nudged = rows.filter("value > 90").select(
        F.lit("nudge").alias("kind"), F.lit("sent").alias("status"), F.col("doc_id").alias("evaluation_id")
    )
    holds = rows.limit(0).select(
        F.lit("hold").alias("action"), F.col("created_at").alias("undone_at"), F.to_date("created_at").alias("hold_until"), F.col("doc_id").alias("evaluation_id")
    )
    return reports.digest_lists(reports.digest_items(rows, holds, nudged, F.to_date(now())))


@query(
    "holds_due",
    """SELECT 'y' || year(o_orderdate) AS pool_id, 'holds_due' AS section, o_orderkey AS doc_id, 'order ' || o_orderkey AS name FROM orders
       WHERE o_orderstatus = 'P' AND o_totalprice > 20000 AND CAST(o_orderdate AS DATE) + 21 <= DATE '1999-06-30'""",
)
def holds_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders put on hold for three weeks, the cheap holds undone, read on one day."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("pool_id"),
        F.when(F.col("o_orderstatus") == "P", "hold").otherwise("scored").alias("pipeline_status"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.array().cast("array<string>").alias("flags"),
    )
    held = o.select(
        F.col("o_orderkey").alias("evaluation_id"), F.lit("hold").alias("action"),
        F.when(F.col("o_totalprice") <= 20000, F.col("o_orderdate")).alias("undone_at"),
        decisions.default_hold(F.lit(21), F.col("o_orderdate")).alias("hold_until"),
    )
    none = o.limit(0).select(F.lit("").alias("kind"), F.lit("").alias("status"), F.col("o_orderkey").alias("evaluation_id"))
    return reports.digest_items(rows, held, none, F.lit("1999-06-30").cast("date"))


@query(
    "gate_pools",
    """SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND l.l_orderkey = o.o_orderkey AND l.l_linenumber = CAST(left(o.o_orderpriority, 1) AS INTEGER))""",
)
def gate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("rubric_hash"), F.substring("o_orderpriority", 1, 1).cast("int").alias("config_hash")
    )
    runs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("rubric_hash"), F.col("l_linenumber").alias("config_hash"),
        F.col("l_linestatus").alias("model_id"), (F.col("l_returnflag") == "R").alias("passed"),
    )
    return reports.calibration_gate(pools, runs, "F").select("o_orderkey")


# ---- validity ----


@query(
    "config_validity",
    """WITH w AS (SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'CORE' WHEN 'N' THEN 'PM' ELSE 'SPM' END AS role, 'D' || l_linenumber AS dim,
         CAST(floor(sum(l_quantity) / 20) AS DOUBLE) AS weight, l_linenumber FROM lineitem GROUP BY ALL),
       g AS (SELECT l_suppkey, role, count(*) FILTER (WHERE role = 'CORE' AND l_linenumber > 6) AS unknown,
         count(*) FILTER (WHERE NOT weight BETWEEN 0 AND 30) AS out_of_range, sum(weight) AS total,
         count(*) FILTER (WHERE NOT (role = 'CORE' AND l_linenumber > 6)) AS seen FROM w GROUP BY ALL),
       p AS (SELECT l_suppkey, role, unnest([CASE WHEN unknown > 0 THEN 'unknown_dimension' END, CASE WHEN out_of_range > 0 THEN 'weight_range' END,
         CASE WHEN total <> 100 THEN 'sum_100' END, CASE WHEN seen <> CASE role WHEN 'PM' THEN 7 WHEN 'SPM' THEN 9 ELSE 6 END THEN 'all_dimensions' END]) AS rule FROM g)
       SELECT * FROM p WHERE rule IS NOT NULL""",
)
def config_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pools: the quantities of their line items as weights."""
    flag = F.col("l_returnflag")
    weights = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            "l_suppkey", F.when(flag == "A", "CORE").when(flag == "N", "PM").otherwise("SPM").alias("role"),
            F.concat(F.lit("D"), F.col("l_linenumber").cast("string")).alias("dim"),
        )
        .agg(F.floor(F.sum("l_quantity") / 20).cast("double").alias("weight"))
    )
    return validity.weight_problems(weights, key="l_suppkey")


@query(
    "config_keys",
    """SELECT c_custkey, 'colour' AS path FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT c_custkey, 'tiers.D' FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT c_custkey, 'weights.PM.D9' FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def config_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pools: configurations as JSON, some with keys that there are none of."""
    one = F.lit(1)
    weights = F.struct(F.struct(one.alias("D1"), F.when(F.col("c_mktsegment") == "BUILDING", 1).alias("D9")).alias("PM"))
    tiers = F.struct(one.alias("A"), one.alias("B"), F.when(F.col("c_acctbal") < 0, 1).alias("D"))
    payload = F.to_json(F.struct(weights.alias("weights"), tiers.alias("tiers"), one.alias("runsPerCv"), F.when(F.col("c_nationkey") % 2 == 0, 1).alias("colour")))
    return validity.unknown_config_keys(table(spark, sf_dir, "customer"), payload, key="c_custkey")


@query(
    "constraint_report",
    """WITH e AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'scored' WHEN 'O' THEN 'needs_review' ELSE 'lost' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'R' WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN 'X' ELSE 'D' END AS tier FROM orders)
       SELECT 'needs_review_is_tier_r' AS rule, count(*) FILTER (WHERE status = 'needs_review' AND tier IS DISTINCT FROM 'R') AS n FROM e
       UNION ALL SELECT 'status_domain', count(*) FILTER (WHERE status = 'lost') FROM e
       UNION ALL SELECT 'role_applied_domain', 0 FROM e HAVING true
       UNION ALL SELECT 'tier_domain', count(*) FILTER (WHERE tier = 'X') FROM e
       UNION ALL SELECT 'pipeline_status_domain', 0 FROM e HAVING true""",
)
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        F.when(status == "F", "scored").when(status == "O", "needs_review").otherwise("lost").alias("status"),
        F.when(priority == "1-URGENT", "A").when(priority == "2-HIGH", "R").when(priority == "4-NOT SPECIFIED", "X")
        .when(priority == "5-LOW", "D").alias("tier"),
        F.lit("PM").alias("role_applied"), order_status().alias("pipeline_status"),
    )
    return validity.violation_counts(rows, validity.evaluation_rules())


@query(
    "config_edits",
    """WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
       SELECT o_orderkey, CASE WHEN first <= o_orderdate THEN 'locked' WHEN c_acctbal < 0 AND TIMESTAMP '1998-01-01' <= o_orderdate THEN 'closed'
         WHEN o_orderpriority = c_mktsegment OR left(o_orderpriority, 1) = '1' THEN 'unchanged' ELSE 'accepted' END AS verdict
       FROM orders o JOIN customer ON c_custkey = o.o_custkey LEFT JOIN f ON f.o_custkey = o.o_custkey""",
)
def config_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pools, orders as wishes to edit them, filled orders as their decisions."""
    o = table(spark, sf_dir, "orders")
    pools = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pool_id"), F.lit(None).cast("timestamp").alias("locked_at"),
        F.when(F.col("c_acctbal") < 0, F.lit("1998-01-01").cast("timestamp")).alias("closed_at"), F.lit("1").alias("config_hash"),
    )
    edits = o.select(
        "o_orderkey", F.col("o_custkey").alias("pool_id"), F.col("o_orderdate").alias("edited_at"),
        F.substring("o_orderpriority", 1, 1).alias("new_hash"),
    )
    made = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("evaluation_id"), F.col("o_orderdate").alias("decided_at"))
    ev = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("pool_id"))
    first = decisions.lock_times(pools, made, ev).select("pool_id", "first_decided_at")
    return validity.config_edits(edits, pools, first).select("o_orderkey", "verdict")


# ---- decisions ----

COMMANDS_SQL = """cmd AS (SELECT ev, seq, command, no_contact, rn,
    CASE WHEN command IN ('hold', 'decline') AND value < 1 THEN 'hold_date_not_future' WHEN command = 'advance' AND value < 1 THEN 'not_finished'
         WHEN command = 'advance' AND value < 2 THEN 'not_scheduled' END AS refusal,
    CASE WHEN command IN ('undo', 'release', 'fail') THEN CASE WHEN value < 12 THEN max(CASE WHEN command IN ('advance', 'hold', 'decline') THEN seq END) OVER earlier
                               WHEN value < 18 THEN max(CASE WHEN command IN ('hold', 'decline') THEN seq END) OVER earlier END END AS target
  FROM (SELECT user_id AS ev, event_id AS seq, value,
    CASE event_type WHEN 'signup' THEN 'advance' WHEN 'error' THEN 'undo' WHEN 'view' THEN CASE WHEN value < 5 THEN 'fail' ELSE 'release' END
      WHEN 'click' THEN CASE WHEN value < 15 THEN 'hold' ELSE 'decline' END
      ELSE CASE WHEN value < 8 THEN 'booked' WHEN value < 16 THEN 'interviewed' WHEN value < 40 THEN 'offer' ELSE 'withdrawn' END END AS command,
    user_id > 100 AS no_contact, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
  WINDOW earlier AS (PARTITION BY ev ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands; undo, release and fail name the newest decision asked for, the newest hold or decline, or none."""
    kind, value = F.col("event_type"), F.col("value")
    moves = F.when(value < 8, "booked").when(value < 16, "interviewed").when(value < 40, "offer").otherwise("withdrawn")
    command = (
        F.when(kind == "signup", "advance").when(kind == "error", "undo")
        .when(kind == "view", F.when(value < 5, "fail").otherwise("release"))
        .when(kind == "click", F.when(value < 15, "hold").otherwise("decline"))
        .otherwise(moves)
    )
    refusal = (
        F.when((kind == "click") & (value < 1), "hold_date_not_future").when((kind == "signup") & (value < 1), "not_finished")
        .when((kind == "signup") & (value < 2), "not_scheduled")
    )
    earlier = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    newest = lambda *kinds: F.max(F.when(kind.isin(*kinds), F.col("event_id"))).over(earlier)
    target = F.when(kind.isin("error", "view"), F.when(value < 12, newest("signup", "click")).when(value < 18, newest("click")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("evaluation_id"), F.col("event_id").alias("seq"), command.alias("command"), refusal.alias("refusal"),
        (F.col("user_id") > 100).alias("no_contact"), target.alias("target"),
    )


# The fold as a recursive query: one step per command, the active decisions as a list, the latest last.
_LEGAL = "CASE command " + " ".join(
    f"WHEN '{c}' THEN status IN ({', '.join(repr(s) for s in sources)})"
    for c, sources in {**fixed.DECISION_MOVES, **fixed.STATUS_MOVES}.items()
) + " END"
_IS_DECISION = "command IN ('advance', 'hold', 'decline')"
_TO = "CASE {0} WHEN 'advance' THEN 'advanced' WHEN 'decline' THEN 'declined' ELSE {0} END"
_STEP_LEGAL = _LEGAL.replace("command", "c.command", 1).replace("status", "f.status")
FOLD_SQL = f"""WITH RECURSIVE {COMMANDS_SQL}, fold AS (
  SELECT ev, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS command, CAST(NULL AS VARCHAR) AS reason, 'scored' AS status,
         CAST([] AS STRUCT(id BIGINT, action VARCHAR, before VARCHAR, phase VARCHAR)[]) AS active
  FROM (SELECT DISTINCT ev FROM cmd)
  UNION ALL
  SELECT ev, rn, seq, command, reason,
    CASE WHEN reason IS NOT NULL THEN status WHEN {_IS_DECISION} OR command IN ('booked', 'interviewed', 'offer', 'withdrawn') THEN {_TO.format("command")}
         WHEN command = 'undo' AND status = {_TO.format("meant.action")} THEN meant.before ELSE status END,
    CASE WHEN reason IS NOT NULL THEN active
         WHEN {_IS_DECISION} THEN list_append(active, {{'id': seq, 'action': command, 'before': status, 'phase': CASE WHEN no_contact THEN 'window' ELSE 'scheduled' END}})
         WHEN command = 'undo' THEN active[1:len(active) - 1]
         WHEN command IN ('release', 'fail') THEN list_transform(active, lambda d: CASE WHEN d.id = meant.id THEN {{'id': d.id, 'action': d.action, 'before': d.before,
           'phase': CASE WHEN command = 'fail' THEN 'failed' WHEN d.phase = 'scheduled' THEN 'gone' ELSE 'closed' END}} ELSE d END)
         ELSE active END
  FROM (SELECT f.ev, c.rn, c.seq, c.command, c.no_contact, f.status, f.active, f.meant,
      CASE WHEN {_IS_DECISION.replace('command', 'c.command')} THEN
             CASE WHEN c.refusal = 'not_finished' THEN c.refusal WHEN NOT ({_STEP_LEGAL}) THEN 'illegal_move'
                  WHEN len(f.active) > 0 AND f.active[-1].phase = 'scheduled' THEN 'email_in_flight' WHEN c.refusal = 'not_scheduled' AND c.no_contact THEN NULL ELSE c.refusal END
           WHEN c.command IN ('booked', 'interviewed', 'offer', 'withdrawn') THEN CASE WHEN NOT ({_STEP_LEGAL}) THEN 'illegal_move' END
           WHEN f.meant IS NULL THEN CASE WHEN c.command = 'undo' THEN 'not_found' ELSE 'nothing_waiting' END
           WHEN c.command = 'undo' THEN CASE WHEN f.meant.id <> f.active[-1].id THEN 'too_late' WHEN f.meant.phase = 'gone' THEN 'already_sent' WHEN f.meant.phase = 'closed' THEN 'too_late' END
           WHEN c.command = 'release' THEN CASE WHEN f.meant.phase NOT IN ('scheduled', 'window') THEN 'nothing_waiting' END
           ELSE CASE WHEN f.meant.phase <> 'scheduled' THEN 'nothing_waiting' END END AS reason
    FROM (SELECT fold.*, CASE WHEN n.target IS NULL THEN active[-1] ELSE list_filter(active, lambda d: d.id = n.target)[1] END AS meant
          FROM fold JOIN cmd n ON n.ev = fold.ev AND n.rn = fold.rn + 1) f
    JOIN cmd c ON c.ev = f.ev AND c.rn = f.rn + 1) step
)"""


@query(
    "decision_fold",
    FOLD_SQL + " SELECT ev AS evaluation_id, seq, command, reason IS NULL AS accepted, reason, status AS status_after, len(active) AS n_active FROM fold WHERE rn > 0",
)
def decision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.fold(event_commands(spark, sf_dir))


@query(
    "decision_state",
    FOLD_SQL
    + """ SELECT ev AS evaluation_id, arg_max(status, rn) AS pipeline_status, count(*) FILTER (WHERE reason IS NULL) AS n_accepted,
          count(*) FILTER (WHERE reason IS NOT NULL) AS n_refused FROM fold WHERE rn > 0 GROUP BY ev""",
)
def decision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.current_status(decisions.fold(event_commands(spark, sf_dir)))


# ---- outbox ----


@query(
    "outbox_plan",
    f"""WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'advance' WHEN 'O' THEN 'decline' ELSE 'hold' END AS kind, o_orderdate, o_totalprice, o_custkey FROM orders)
       SELECT o_orderkey || ':' || kind AS idempotency_key, o_orderkey AS decision_id, kind,
              {minutes_sql("o_orderdate + CASE kind WHEN 'decline' THEN INTERVAL 1440 MINUTE ELSE INTERVAL 10 MINUTE END")} AS scheduled_minute
       FROM d JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'view')""",
)
def outbox_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order decided on; people in the red have no address; what was viewed was planned before. Each wish comes twice."""
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "advance").when(status == "O", "decline").otherwise("hold")
    o = table(spark, sf_dir, "orders").withColumn("kind", kind)
    made = o.select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_orderkey").alias("evaluation_id"), F.col("kind").alias("action"),
        F.lit(None).cast("timestamp").alias("undone_at"), F.lit(None).cast("date").alias("hold_until"),
        F.lit("").alias("invite_line_final"), F.col("o_orderdate").alias("decided_at"),
    )
    evaluations = o.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("pool_id"),
        F.lit("scored").alias("pipeline_status"), F.lit("PM").alias("role_applied"), F.lit("PM").alias("role_title_final"),
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("display_name"),
        F.when(F.col("c_acctbal") >= 0, F.lit("a@example.net")).alias("email"), F.lit(False).alias("no_contact"),
        F.lit(False).alias("legacy"), F.lit("unstated").alias("eligibility"),
    )
    wish = o.select(F.col("o_orderkey").alias("asked_decision_id"), "kind")
    planned = (
        table(spark, sf_dir, "events").filter("event_type = 'view'").join(o, F.col("event_id") == F.col("o_orderkey"))
        .select(F.concat_ws(":", F.col("event_id").cast("string"), "kind").alias("idempotency_key"))
    )
    guarded = outbox.guard(wish.unionByName(wish), made, evaluations, people)
    rows = outbox.plan(guarded, planned, pools_of(spark, PRIORITIES))
    return rows.select("idempotency_key", "decision_id", "kind", minutes(F.col("scheduled_at")).alias("scheduled_minute"))


SEND_GUARD_SQL = """WITH d AS (SELECT o_custkey, arg_max(struct_pack(k := o_orderkey, s := o_orderstatus, p := o_orderpriority, t := o_totalprice), struct_pack(a := o_orderdate, b := o_orderkey)) AS o FROM orders GROUP BY o_custkey),
       w AS (SELECT c_custkey, c_acctbal, c_mktsegment, o, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'nudge' WHEN 'BUILDING' THEN 'decline' WHEN 'FURNITURE' THEN 'hold' ELSE 'advance' END AS kind,
         CASE o.s WHEN 'F' THEN 'advance' WHEN 'O' THEN 'decline' ELSE 'hold' END AS action FROM customer LEFT JOIN d ON o_custkey = c_custkey)
       SELECT c_custkey, kind, CASE WHEN o IS NULL THEN 'no_decision' WHEN o.t < 60000 THEN 'decision_undone'
         WHEN kind = 'nudge' AND action <> 'advance' THEN 'wrong_kind' WHEN kind = 'nudge' AND o.p <> '3-MEDIUM' THEN 'not_eligible'
         {invited}WHEN kind <> 'nudge' AND action <> kind THEN 'wrong_kind'
         WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'no_contact' END AS refusal FROM w"""


def guarded_wishes(spark: SparkSession, sf_dir: str, at_send_time: bool) -> DataFrame:
    """A wish for every customer about their newest order, with or without one."""
    newest = latest_per_key(
        table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")],
        ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"],
    )
    status, segment = F.col("o_orderstatus"), F.col("c_mktsegment")
    made = newest.select(
        F.col("o_custkey").alias("decision_id"), F.col("o_custkey").alias("evaluation_id"),
        F.when(status == "F", "advance").when(status == "O", "decline").otherwise("hold").alias("action"),
        F.when(F.col("o_totalprice") < 60000, F.col("o_orderdate")).alias("undone_at"), F.lit(None).cast("date").alias("hold_until"),
        F.lit("").alias("invite_line_final"), F.col("o_orderdate").alias("decided_at"),
    )
    evaluations = newest.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("pool_id"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "advanced").otherwise("booked").alias("pipeline_status"),
        F.lit("PM").alias("role_applied"), F.lit("PM").alias("role_title_final"),
    )
    customers = table(spark, sf_dir, "customer")
    people = customers.select(
        F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("display_name"),
        F.when(F.col("c_acctbal") >= 0, F.lit("a@example.net")).alias("email"), (F.col("c_acctbal") > 9000).alias("no_contact"),
        F.lit(False).alias("legacy"), F.lit("unstated").alias("eligibility"),
    )
    invites = newest.select(
        F.col("o_custkey").alias("decision_id"), F.lit("advance").alias("kind"),
        F.when(F.col("o_totalprice") >= 200000, "delivered").otherwise("scheduled").alias("status"),
    )
    kind = F.when(segment == "AUTOMOBILE", "nudge").when(segment == "BUILDING", "decline").when(segment == "FURNITURE", "hold").otherwise("advance")
    wishes = customers.select(F.col("c_custkey").alias("asked_decision_id"), kind.alias("kind"))
    out = outbox.guard(wishes, made, evaluations, people, invites, at_send_time)
    return out.select(F.col("asked_decision_id").alias("c_custkey"), "kind", "refusal")


@query("send_guard", SEND_GUARD_SQL.format(invited="WHEN kind = 'nudge' AND o.t < 200000 THEN 'not_eligible' "))
def send_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded_wishes(spark, sf_dir, at_send_time=False)


@query("guard_at_send", SEND_GUARD_SQL.format(invited=""))
def guard_at_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same wishes once more when they are due: whether the invitation arrived isn't asked again."""
    return guarded_wishes(spark, sf_dir, at_send_time=True)


def event_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("email_id"), F.col("event_id").alias("decision_id"), F.col("user_id").alias("evaluation_id"),
        F.when(kind == "signup", "scheduled").when(kind == "view", "pending").when(kind == "click", "sent")
        .when(kind == "error", "bounced").otherwise("delivered").alias("status"),
        F.when(F.col("value") > 20, F.col("event_id").cast("string")).alias("provider_id"), F.col("ts").alias("scheduled_at"), "value",
    )


@query(
    "due_emails",
    """SELECT event_id AS email_id, epoch_us(ts) AS scheduled_us FROM events WHERE (event_type = 'signup' AND ts <= TIMESTAMP '2024-01-16')
         OR (event_type = 'view' AND value <= 20 AND ts < TIMESTAMP '2024-01-15 23:50:00')""",
)
def due_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything due at one moment, oldest first: a sender takes batches off the top."""
    due = outbox.due_emails(event_emails(spark, sf_dir), F.lit("2024-01-16").cast("timestamp"), limit=None)
    return due.select("email_id", dates.micros(F.col("scheduled_at")).alias("scheduled_us"))


@query(
    "due_batch",
    """SELECT event_id AS email_id FROM events WHERE (event_type = 'signup' AND ts <= TIMESTAMP '2024-01-16')
         OR (event_type = 'view' AND value <= 20 AND ts < TIMESTAMP '2024-01-15 23:50:00') ORDER BY ts, event_id LIMIT 25""",
)
def due_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sender's batch: the 25 oldest due e-mails (the limit is the feature)."""
    return outbox.due_emails(event_emails(spark, sf_dir), F.lit("2024-01-16").cast("timestamp"), limit=25).select("email_id")


@query(
    "retry_due",
    """SELECT o_orderkey AS doc_id FROM orders WHERE (o_orderstatus = 'O' AND (o_totalprice < 50000 OR o_orderdate <= TIMESTAMP '1998-06-01'))
         OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-05-31 23:54:00')""",
)
def retry_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(status == "O", "queued").when(status == "P", "processing").otherwise("scored").alias("status"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_orderdate")).alias("next_attempt_at"), F.col("o_orderdate").alias("claimed_at"),
        F.col("o_orderdate").alias("created_at"),
    )
    return outbox.retry_due(rows, F.lit("1998-06-01").cast("timestamp")).select("doc_id")


@query(
    "mail_counts",
    """SELECT user_id AS evaluation_id, count(*) FILTER (WHERE event_type IN ('signup', 'view')) AS n_in_flight FROM events
       GROUP BY user_id HAVING count(*) FILTER (WHERE event_type IN ('signup', 'view')) > 0""",
)
def mail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.in_flight(event_emails(spark, sf_dir))


@query(
    "stopped_emails",
    """SELECT e.event_id AS email_id FROM events e WHERE event_type = 'signup' AND value <= 20 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id AND o_orderstatus = 'F')""",
)
def stopped_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    undone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("decision_id"))
    return outbox.cancel(event_emails(spark, sf_dir), undone).select("email_id")


_STATUS_OF = "CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'delivered' WHEN 'error' THEN 'bounced' WHEN 'purchase' THEN 'failed' END"


@query(
    "status_reduce",
    f"""WITH e AS (SELECT user_id || '@' || CAST(ts AS DATE) AS provider_id, {_STATUS_OF} AS st, ts, event_id FROM events WHERE event_type <> 'signup'),
       r AS (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY CASE st WHEN 'sent' THEN 2 WHEN 'delivered' THEN 3 ELSE 4 END DESC, ts, event_id) AS rn FROM e)
       SELECT provider_id, st AS status FROM r WHERE rn = 1""",
)
def status_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    typed = F.when(kind == "view", "email.sent").when(kind == "click", "email.delivered").when(kind == "error", "email.bounced").when(
        kind == "purchase", "email.failed"
    ).otherwise("email.complained")
    events = table(spark, sf_dir, "events").select(
        F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("provider_id"),
        outbox.event_status(typed).alias("status"), "ts", "event_id",
    )
    return outbox.reduce_statuses(events.filter(F.col("status").isNotNull()), ["provider_id"], [F.col("ts"), F.col("event_id")])


@query(
    "delivery_sync",
    """SELECT e.event_id AS email_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'delivered' WHEN '2-HIGH' THEN 'bounced' WHEN '3-MEDIUM' THEN 'failed' ELSE 'delivered' END AS status
       FROM events e JOIN orders ON o_orderkey = e.event_id WHERE event_type = 'click' AND value > 20 AND ts < TIMESTAMP '2024-01-31 23:50:00' AND o_orderpriority <> '5-LOW'""",
)
def delivery_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = F.element_at(
        F.create_map(*[F.lit(x) for x in ("1-URGENT", "opened", "2-HIGH", "bounced", "3-MEDIUM", "suppressed", "4-NOT SPECIFIED", "complained", "5-LOW", "queued")]),
        F.col("o_orderpriority"),
    )
    snapshot = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("provider_id"), news.alias("last_event"))
    return outbox.sync_statuses(event_emails(spark, sf_dir), snapshot, now()).select("email_id", "status")


@query(
    "bounce_semi",
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'LEGACY,BOUNCED' ELSE 'BOUNCED' END AS flags FROM customer c
       WHERE c_mktsegment <> 'BUILDING' AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error')""",
)
def bounce_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(
        F.array(F.when(F.col("c_acctbal") > 5000, F.lit("LEGACY")), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("BOUNCED")))
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), flags.alias("flags"))
    out = outbox.flag_bounces(people, event_emails(spark, sf_dir))
    return out.select(F.col("doc_id").alias("c_custkey"), F.array_join("flags", ",").alias("flags"))


@query(
    "nudge_due",
    f"""WITH l AS (SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last FROM events GROUP BY user_id)
       SELECT e.event_id AS decision_id, e.user_id AS evaluation_id, {minutes_sql('e.ts')} AS invited_minute FROM events e JOIN l ON l.user_id = e.user_id
       WHERE e.event_type = 'signup' AND e.value >= 2 AND l.last <> 'purchase' AND epoch_us({TS}) - epoch_us(e.ts) >= 3 * 86400000000
         AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id AND o_orderstatus = 'F')""",
)
def nudge_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as invitations; a last purchase means booked; a filled order of the same number, nudged before."""
    events = table(spark, sf_dir, "events")
    made = events.filter("event_type = 'signup'").select(
        F.col("event_id").alias("decision_id"), F.col("user_id").alias("evaluation_id"), F.lit("advance").alias("action"),
        F.lit(None).cast("timestamp").alias("undone_at"),
    )
    last = latest_per_key(events, ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type"])
    evaluations = last.select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("pool_id"),
        F.when(F.col("event_type") == "purchase", "booked").otherwise("advanced").alias("pipeline_status"),
    )
    invites = events.select(
        F.col("event_id").alias("decision_id"), F.lit("advance").alias("kind"), F.when(F.col("value") >= 2, "sent").otherwise("failed").alias("status"),
        F.lit(None).cast("timestamp").alias("scheduled_at"), F.col("ts").alias("created_at"),
    )
    before = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("decision_id"), F.lit("nudge").alias("kind"), F.lit("sent").alias("status"),
        F.lit(None).cast("timestamp").alias("scheduled_at"), F.col("o_orderdate").alias("created_at"),
    )
    out = outbox.nudges(made, evaluations, invites.unionByName(before), pools_of(spark, EVENT_TYPES), now())
    return out.select(F.col("asked_decision_id").alias("decision_id"), "evaluation_id", minutes(F.col("invited_at")).alias("invited_minute"))


@query(
    "attempt_outcomes",
    f"""WITH a AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'transient' WHEN 'click' THEN 'transient' WHEN 'error' THEN 'error' ELSE 'invalid' END AS r, CAST(ts AS DATE) AS d, value FROM events),
       g AS (SELECT user_id || '@' || d AS doc_id, arg_max(struct_pack(r := r, ts := ts, v := value), struct_pack(a := ts, b := event_id)) AS l, count(*) FILTER (WHERE r = 'transient') AS t, count(*) FILTER (WHERE r <> 'transient') AS n FROM a GROUP BY ALL),
       o AS (SELECT *, CASE WHEN l.r = 'ok' AND l.v > 50 THEN 'needs_review' WHEN l.r = 'ok' THEN 'scored' WHEN l.r = 'invalid' THEN 'needs_review'
         WHEN l.r = 'transient' THEN CASE WHEN t > 8 THEN 'failed' ELSE 'requeued' END WHEN n >= 3 THEN 'failed' ELSE 'requeued' END AS outcome FROM g)
       SELECT doc_id, outcome, t AS transient_retries, n AS real_attempts,
         CASE WHEN outcome = 'requeued' THEN epoch_us(l.ts) + 1000000 * CASE WHEN l.r = 'transient' THEN CAST(least(30 * power(2, t - 1), 900) AS BIGINT) ELSE 60 END END AS next_us FROM o""",
)
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    result = F.when(kind == "purchase", "ok").when(kind.isin("view", "click"), "transient").when(kind == "error", "error").otherwise("invalid")
    attempts = table(spark, sf_dir, "events").select(
        F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("doc_id"), F.col("event_id").alias("attempt"),
        result.alias("result"), F.col("ts").alias("at"), F.when(F.col("value") > 50, "R").otherwise("A").alias("tier"),
    )
    out = outbox.attempt_outcomes(attempts)
    return out.select("doc_id", "outcome", "transient_retries", "real_attempts", dates.micros(F.col("next_attempt_at")).alias("next_us"))


HOUSE = {
    "company": "the company", "signature": "The hiring team", "short_name": "The team", "booking_url": "https://book.example.net",
    "footer": "Every decision is made by a person.", "legacy_opening": "Sorry for the wait. ",
    "relocation_question": "Would you consider relocating?",
}


@query(
    "declined_letters",
    """SELECT c_custkey, 'Your application for ' || CASE c_mktsegment WHEN 'BUILDING' THEN 'Senior Product Manager' ELSE 'Product Manager' END || ' at the company' AS subject,
       'Hi ' || CASE WHEN c_acctbal < 0 THEN 'there' ELSE left(c_name, 1) || lower(substr(c_name, 2)) END || ',' || chr(10) || chr(10) || CASE WHEN c_acctbal > 5000 THEN 'Sorry for the wait. ' ELSE '' END ||
       'Thank you for taking the time to apply for the ' || CASE c_mktsegment WHEN 'BUILDING' THEN 'Senior Product Manager' ELSE 'Product Manager' END ||
       ' role at the company. We''ve reviewed your application carefully and have decided not to move forward with it for this role.' || chr(10) || chr(10) ||
       'We appreciate your interest in the company and wish you the very best in your search.' || chr(10) || chr(10) || 'The hiring team' || chr(10) || chr(10) || 'Every decision is made by a person.' AS text FROM customer""",
)
def declined_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("decline").alias("kind"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("display_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "SPM").alias("role_title_final"), F.lit("PM").alias("role_applied"),
        (F.col("c_acctbal") > 5000).alias("legacy"), F.lit(None).cast("string").alias("invite_line_final"),
        F.lit(None).cast("date").alias("hold_until"), F.lit("unstated").alias("eligibility"),
    )
    return outbox.render(rows, HOUSE).select("c_custkey", "subject", "text")


LETTER_KIND_SQL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'nudge' WHEN 'BUILDING' THEN 'decline' WHEN 'FURNITURE' THEN 'hold' ELSE 'advance' END"


@query(
    "letters",
    f"""WITH c AS (SELECT c_custkey, {LETTER_KIND_SQL} AS kind, CASE WHEN c_nationkey % 2 = 0 THEN 'Senior Product Manager' ELSE 'Product Manager' END AS title,
         'Hi ' || CASE WHEN c_acctbal < 0 THEN 'there' ELSE left(c_name, 1) || lower(substr(c_name, 2)) END || ',' AS hi, chr(10) || chr(10) AS gap,
         CASE WHEN c_acctbal > 5000 THEN 'Sorry for the wait. ' ELSE '' END AS opening, CASE WHEN c_custkey % 3 = 0 THEN ' We liked order ' || c_custkey || '.' ELSE '' END AS invite,
         CASE WHEN c_acctbal < 1000 THEN 'Would you consider relocating?' || chr(10) || chr(10) ELSE '' END AS ask,
         strftime(DATE '2024-03-01' + CAST(c_custkey % 60 AS INTEGER), '%-d %B %Y') AS day, 'Every decision is made by a person.' AS footer FROM customer)
       SELECT c_custkey, kind, CASE kind WHEN 'advance' THEN 'Next step: ' WHEN 'decline' THEN 'Your application for ' WHEN 'hold' THEN 'Update on your application: ' ELSE 'Re: Next step: ' END
              || title || ' at the company' AS subject,
         CASE kind
           WHEN 'advance' THEN hi || gap || opening || 'Thanks for applying for the ' || title || ' role at the company.' || invite || gap
             || 'I''d like to set up a conversation. Please pick a time that works for you here: https://book.example.net' || gap || ask || 'Looking forward to it,' || chr(10) || 'The hiring team' || gap || footer
           WHEN 'decline' THEN hi || gap || opening || 'Thank you for taking the time to apply for the ' || title
             || ' role at the company. We''ve reviewed your application carefully and have decided not to move forward with it for this role.' || gap
             || 'We appreciate your interest in the company and wish you the very best in your search.' || gap || 'The hiring team' || gap || footer
           WHEN 'hold' THEN hi || gap || opening || 'Thank you for applying for the ' || title || ' role. We''re still reviewing applications and will get back to you by ' || day || '.' || gap
             || 'The hiring team' || gap || footer
           ELSE hi || ' just checking this reached you. If you''d still like to talk, you can pick a time here: https://book.example.net. The team' || gap || footer END AS text
       FROM c""",
)
def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of letter: a customer's segment says which."""
    segment = F.col("c_mktsegment")
    kind = F.when(segment == "AUTOMOBILE", "nudge").when(segment == "BUILDING", "decline").when(segment == "FURNITURE", "hold").otherwise("advance")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", kind.alias("kind"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("display_name"),
        F.when(F.col("c_nationkey") % 2 == 0, "SPM").otherwise("PM").alias("role_title_final"), F.lit("PM").alias("role_applied"),
        (F.col("c_acctbal") > 5000).alias("legacy"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  We liked order "), F.col("c_custkey").cast("string"), F.lit(". \n"))).alias("invite_line_final"),
        F.date_add(F.lit("2024-03-01").cast("date"), (F.col("c_custkey") % 60).cast("int")).alias("hold_until"),
        F.when(F.col("c_acctbal") < 1000, "unstated").otherwise("stated_yes").alias("eligibility"),
    )
    return outbox.render(rows, HOUSE).select("c_custkey", "kind", "subject", "text")


# ---- retention, snapshots ----


@query(
    "retention_strip",
    f"""SELECT c_custkey, CASE WHEN p THEN NULL ELSE c_name END AS display_name, c_acctbal, CASE WHEN p THEN 0 ELSE 1 END AS n_urls, p AS purged
       FROM (SELECT *, c_nationkey % 5 = 0 AS p FROM customer)""",
)
def retention_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as pools, the ones of one region closed long ago; names go, balances stay."""
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    pools = nations.select(
        F.col("n_nationkey").cast("string").alias("pool_id"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("2023-06-01").cast("timestamp")).otherwise(now()).alias("closed_at"),
    )
    configs = pools.select("pool_id", F.lit(fixed.DEFAULT_CONFIG["retentionDays"]).alias("retention_days"))
    people = customers.select(
        F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("display_name"), "c_acctbal",
        F.array(F.lit("a link")).alias("urls"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    evaluations = customers.select(
        F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey").cast("string").alias("pool_id"),
        F.lit("a path").alias("file_path"),
    )
    due = retention.due_candidates(evaluations, people, pools, configs, now())
    out = retention.purge_candidates(people, due, now())
    return out.select(
        F.col("candidate_id").alias("c_custkey"), "display_name", "c_acctbal", F.size("urls").alias("n_urls"),
        F.col("deleted_at").isNotNull().alias("purged"),
    )


@query("open_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def open_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return stages.insert_new(known, table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


@query(
    "keyed_update",
    """SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN c_acctbal ELSE total END AS c_acctbal, c_mktsegment FROM customer
       LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    current = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return stages.keyed_update(current, changes, "c_custkey")


@query(
    "audit_entries",
    """SELECT o_orderkey AS target_id, 'decision.' || lower(o_orderstatus) AS action, 'operator' AS actor FROM orders""",
)
def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    action = F.concat(F.lit("decision."), F.lower("o_orderstatus"))
    return stages.audit_rows(o, action, "operator", "o_orderkey", F.col("o_orderdate")).select("target_id", "action", "actor")
