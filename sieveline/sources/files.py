"""Raw files and lists: documents by path, their kind, term lists, reference texts, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import fixed, schemas
from sieveline.functions.hashing import text_hash
from sieveline.functions.text import js_trim, token_count

# The shape of a stored path, and the extensions taken.
PATH_PATTERN = r"^[0-9a-f-]{36}/[0-9a-f-]{36}\.(docx|pdf)$"
EXTENSIONS = ["docx", "pdf"]


def read_binary(spark: SparkSession, folder: str, glob: str = "*.{docx,pdf}") -> DataFrame:
    """Files with their bytes. Select without ``content`` to list them without reading them."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def file_kind(content: Column) -> Column:
    """docx or pdf by the first bytes, else null."""
    return F.when(F.substring(content, 1, 2) == F.unhex(F.lit("504B")), "docx").when(
        F.substring(content, 1, 4) == F.unhex(F.lit("25504446")), "pdf"
    )


def intake(
    files: DataFrame, registered: DataFrame, open_pools: DataFrame, max_bytes: int = fixed.MAX_FILE_BYTES
) -> DataFrame:
    """New rows for uploaded files: an allowed extension and size, an issued path in an open pool, once per path.

    ``files`` hold (path, length, file_name, role_applied, legacy) with the path relative to the store.
    """
    good = files.filter(
        F.col("path").rlike(PATH_PATTERN)
        & F.col("length").between(1, max_bytes)
        & F.lower(F.substring_index("file_name", ".", -1)).isin(*EXTENSIONS)
        & F.length("file_name").between(1, 255)
        & F.col("role_applied").isin(*fixed.ROLES_APPLIED)
    ).withColumn("pool_id", F.substring_index("path", "/", 1))
    fresh = good.join(registered.select(F.col("file_path").alias("path")), "path", "left_anti")
    return (
        fresh.dropDuplicates(["path"])
        .join(open_pools.filter(F.col("closed_at").isNull()).select("pool_id"), "pool_id", "left_semi")
        .select("pool_id", F.col("path").alias("file_path"), "file_name", "role_applied", "legacy", F.lit("queued").alias("status"))
    )


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """One term per line; blank lines and # comments dropped."""
    term = js_trim(F.col("value"))
    return spark.read.text(path).select(term.alias("term")).filter((F.col("term") != "") & ~F.startswith("term", F.lit("#")))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """A reference document as one row (text, hash)."""
    whole = spark.read.text(path, wholetext=True)
    text = F.regexp_replace("value", "\\r\\n?", "\n")
    return whole.select(text.alias("text"), text_hash(F.col("value")).alias("hash"))


def reference_section(text: Column, number: int) -> Column:
    """From the numbered second-level heading to the next one; null when there is none."""
    section = F.regexp_extract(text, rf"(?ms)^## {number}\. .*?(?=^## |\z)", 0)
    return F.nullif(js_trim(section), F.lit(""))


def reference_cells(section: DataFrame, text_col: str = "section", min_words: int = fixed.SHINGLE_WORDS) -> DataFrame:
    """Cells of the scored table rows (| **n** | …) that are at least ``min_words`` long, as rows."""
    lines = F.filter(F.split(text_col, "\n"), lambda line: line.rlike(r"^\|\s*\*\*\d\*\*\s*\|"))
    rows = section.select(F.explode(F.transform(lines, lambda line: F.split(line, r"\|"))).alias("row"))
    inner = rows.select(F.explode(F.slice("row", F.lit(3), F.greatest(F.size("row") - 3, F.lit(0)))).alias("cell"))
    text = js_trim(F.replace("cell", F.lit("**"), F.lit("")))
    return inner.select(text.alias("text")).filter(token_count(F.col("text")) >= min_words)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled documents from a nested JSON file."""
    hires = spark.read.schema(schemas.LABELS).json(path, multiLine=True).select(F.explode("hires").alias("h"))
    return hires.select(
        F.col("h.file").alias("doc_id"), F.col("h.label").alias("label"), F.to_date("h.joined").alias("joined"), "h.reference"
    )
