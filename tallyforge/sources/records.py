"""Evaluation records: the fact table of every query.

``records`` reads them from the ``events`` table by a fixed rule, so that any SQL engine can derive the same rows;
``RECORDS_SQL`` is that rule in DuckDB's SQL. ``json_records`` (sources/json_files.py) reads real verdict files into the
same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the data model.
STATUSES = ("PASS", "BUILD_FAIL", "RUN_FAIL", "VERIFY_FAIL", "EXTRACTION_FAIL")
DIRECTIONS = ("cuda-to-omp", "omp-to-cuda", "cuda-to-opencl", "opencl-to-cuda", "omp-to-opencl", "opencl-to-omp")
APIS = ("cuda", "omp", "opencl")
MODELS = ("m0", "m1", "m2")
STANDARD = ("cuda-to-omp", "omp-to-cuda", "cuda-to-opencl", "opencl-to-cuda")
INELIGIBLE = tuple(f"{unit}-{api}" for unit in ("suite0-k0", "suite1-k1") for api in APIS)
_STATUS_OF = {"purchase": "PASS", "signup": "EXTRACTION_FAIL", "error": "BUILD_FAIL", "click": "RUN_FAIL", "view": "VERIFY_FAIL"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _div(name: str, by: int) -> Column:
    return F.expr(f"{name} div {by}")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: identity, direction, level, sample, status, tokens. Projection only, so scans stay pruned."""
    events = table(spark, sf_dir, "events")
    unit = _div("user_id", 3)
    direction = F.element_at(F.array(*map(F.lit, DIRECTIONS)), (_div("event_id", 3) % 6 + 1).cast("int"))
    status = F.create_map(*[F.lit(x) for pair in _STATUS_OF.items() for x in pair])
    base = events.select(
        F.col("event_id").alias("record_id"), "ts",
        F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"),
        F.concat(F.lit("suite"), unit % 5).alias("suite"),
        F.concat(F.lit("k"), unit).alias("kernel"),
        direction.alias("direction"),
        (_div("event_id", 18) % 5).cast("int").alias("augment_level"),
        (_div("event_id", 90) % 3).cast("int").alias("sample_id"),
        status[F.col("event_type")].alias("overall_status"),
        (F.col("event_id") % 4096 + 1).alias("prompt_tokens"),
        F.round(F.col("value") * 100).cast("long").alias("completion_tokens"),
        "value", "props",
    )
    out = base.withColumns({"source_api": F.substring_index("direction", "-to-", 1), "target_api": F.substring_index("direction", "-to-", -1)})
    return out.withColumns(
        {"source_spec": F.concat_ws("-", "suite", "kernel", "source_api"), "target_spec": F.concat_ws("-", "suite", "kernel", "target_api"), "passed": F.col("overall_status") == "PASS"}
    )


def eligible(df: DataFrame) -> DataFrame:
    """FLT-02: rows that touch no excluded specification, on either side."""
    return df.where(~F.col("source_spec").isin(*INELIGIBLE) & ~F.col("target_spec").isin(*INELIGIBLE))


RECORDS_SQL = f"""WITH base AS (
  SELECT event_id AS record_id, ts, 'm' || (event_id % 3) AS model, 'suite' || ((user_id // 3) % 5) AS suite, 'k' || (user_id // 3) AS kernel,
         [{', '.join(f"'{d}'" for d in DIRECTIONS)}][((event_id // 3) % 6 + 1)::INT] AS direction,
         ((event_id // 18) % 5)::INT AS augment_level, ((event_id // 90) % 3)::INT AS sample_id,
         CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'signup' THEN 'EXTRACTION_FAIL' WHEN 'error' THEN 'BUILD_FAIL'
                         WHEN 'click' THEN 'RUN_FAIL' WHEN 'view' THEN 'VERIFY_FAIL' END AS overall_status,
         event_id % 4096 + 1 AS prompt_tokens, CAST(round(value * 100) AS BIGINT) AS completion_tokens, value, props
  FROM events),
allrec AS (
  SELECT *, split_part(direction, '-to-', 1) AS source_api, split_part(direction, '-to-', 2) AS target_api,
         suite || '-' || kernel || '-' || split_part(direction, '-to-', 1) AS source_spec,
         suite || '-' || kernel || '-' || split_part(direction, '-to-', 2) AS target_spec, overall_status = 'PASS' AS passed
  FROM base),
rec AS (
  SELECT * FROM allrec
  WHERE source_spec NOT IN ({', '.join(f"'{x}'" for x in INELIGIBLE)}) AND target_spec NOT IN ({', '.join(f"'{x}'" for x in INELIGIBLE)}))
"""
