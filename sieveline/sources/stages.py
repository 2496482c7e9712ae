"""Stage tables: every stage is written before the next one reads it.

A table is a folder of numbered versions and a log of the versions that are complete. A new version is
written first and logged after, so a reader sees the old one or the new one, and a job that died
half-way leaves the old one in force.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _log(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}/_versions"


def current_version(spark: SparkSession, root: str, name: str) -> int:
    """Number of the newest complete version; 0 when there is none."""
    try:
        log = spark.read.schema("version bigint").json(_log(root, name))
        return log.agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def write_stage(df: DataFrame, root: str, name: str, partition_by: str | None = None) -> int:
    """Write a new version (partitioned, if asked, by the column reads are filtered on) and log it."""
    spark = df.sparkSession
    version = current_version(spark, root, name) + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{root.rstrip('/')}/{name}/v{version:08d}")
    spark.range(1).select(F.lit(version).cast("bigint").alias("version")).write.mode("append").json(_log(root, name))
    return version


def read_stage(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current_version(spark, root, name)
    if not version:
        raise FileNotFoundError(f"stage {name} has no complete version under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/v{version:08d}")


def keyed_update(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The next snapshot: a changed column takes the change where there is one, else stays."""
    columns = [c for c in changes.columns if c != key]
    renamed = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = current.join(renamed, key, "left")
    out = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in current.columns
    ]
    return joined.select(*out)


def insert_new(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not there yet, one per key: an insert that does nothing on conflict."""
    return rows.dropDuplicates(key).join(current.select(*key), key, "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def audit_rows(targets: DataFrame, action: str | Column, actor: str, target_col: str, now) -> DataFrame:
    """Audit entries for the targets of an action."""
    return targets.select(
        F.lit(actor).alias("actor"), (F.lit(action) if isinstance(action, str) else action).alias("action"), F.col(target_col).alias("target_id"), now.alias("at")
    )


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)
