"""Pool configurations as data: columns for the rules, rows for the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions.hashing import config_hash

# Configuration keys outside the nested groups, and the column each becomes.
SCALARS = {
    "d1GateForTierA": ("d1_gate", "boolean"),
    "pmExperienceFloorYears": ("pm_floor", "double"),
    "spmExperienceFloorYears": ("spm_floor", "double"),
    "experienceBandStrict": ("band_strict", "boolean"),
    "runsPerCv": ("runs_per_doc", "int"),
    "unstableSpread": ("unstable_spread", "int"),
    "holdDefaultDays": ("hold_default_days", "int"),
    "nudgeAfterDays": ("nudge_after_days", "int"),
    "retentionDays": ("retention_days", "int"),
    "offerTargetDate": ("offer_target_date", "date"),
}


def config_cells(config: dict) -> dict[str, tuple[object, str]]:
    """Flat (value, type) per column of one configuration."""
    cells = {column: (config[key], kind) for key, (column, kind) in SCALARS.items()}
    cells |= {f"tier_{t.lower()}": (float(v), "double") for t, v in config["tiers"].items()}
    cells |= {f"delay_{k}": (float(v), "double") for k, v in config["sendDelayMinutes"].items()}
    for role, dims in fixed.WEIGHT_DIMS.items():
        for dim in dims:
            cells[f"w_{role}_{dim}".lower()] = (float(config["weights"][role].get(dim, 0)), "double")
    return cells


def literal(config: dict) -> dict[str, Column]:
    """One configuration as literal columns: the rules need no join."""
    return {name: F.lit(value).cast(kind) for name, (value, kind) in config_cells(config).items()}


def config_frame(spark: SparkSession, configs: dict[str, dict], key: str = "pool_id") -> DataFrame:
    """One row per configuration. It is made on the driver, so its size is known: broadcast up to 10,000 rows."""
    rows, schema = [], [f"{key} string", "config_hash string"]
    for name, config in configs.items():
        cells = config_cells(config)
        rows.append((name, config_hash(config), *[v if k != "date" else str(v) for v, k in cells.values()]))
    cells = config_cells(next(iter(configs.values())))
    schema += [f"{n} {'string' if k == 'date' else k}" for n, (_, k) in cells.items()]
    rows = [tuple(float(v) if s.endswith(" double") else v for v, s in zip(row, schema)) for row in rows]
    frame = spark.createDataFrame(rows, ", ".join(schema))
    frame = frame.withColumns({n: F.col(n).cast("date") for n, (_, k) in cells.items() if k == "date"})
    return F.broadcast(frame) if len(configs) <= 10_000 else frame


def from_frame() -> dict[str, Column]:
    """The rule columns of a frame that was joined with ``config_frame``."""
    return {name: F.col(name) for name in config_cells(fixed.DEFAULT_CONFIG)}


def weight_rows(spark: SparkSession, configs: dict[str, dict], key: str = "pool_id") -> DataFrame:
    """(pool, role, dim, weight) rows, unknown roles and dimensions included, for the validity report."""
    rows = [
        (name, role, dim, float(weight))
        for name, config in configs.items()
        for role, dims in config["weights"].items()
        for dim, weight in dims.items()
    ]
    return spark.createDataFrame(rows, f"{key} string, role string, dim string, weight double")


def weight_of(config: dict[str, Column], role: Column, dim: Column) -> Column:
    """Weight of a dimension for a role column (PM or SPM)."""
    ladder = F.when(F.lit(False), F.lit(0.0))
    for name, dims in fixed.WEIGHT_DIMS.items():
        if name != "CORE":
            for d in dims:
                ladder = ladder.when((role == name) & (dim == d), config[f"w_{name}_{d}".lower()])
    return F.coalesce(ladder, F.lit(0.0))
