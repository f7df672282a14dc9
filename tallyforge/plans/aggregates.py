"""Aggregations (SURVEY AGG)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators.collapse import any_sample, leave_one_out
from tallyforge.plans.joins import CELLS_SQL
from tallyforge.plans.projections import PRICES_SQL, attempt_status, attempts, oracle_shape, priced, strategies
from tallyforge.plans.registry import query
from tallyforge.sources.records import INELIGIBLE, RECORDS_SQL, STANDARD, STATUSES, eligible, records, table

Z = stats.Z95


def wilson_sql(c: str = "c", n: str = "n") -> str:
    p = f"({c}::DOUBLE / {n})"
    s = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4.0 * {n} * {n})))"
    m, k = f"({p} + {Z * Z} / (2.0 * {n}))", f"(1 + {Z * Z} / {n})"
    return f"round({p}, 6) AS rate, round(greatest(0, ({m} - {s}) / {k}), 6) AS lower, round(least(1, ({m} + {s}) / {k}), 6) AS upper"


def with_wilson(df: DataFrame) -> DataFrame:
    """rate, lower and upper of the counts c of n."""
    rate, lower, upper = stats.wilson(F.col("c"), F.col("n"))
    return df.withColumns({"rate": F.round(rate, 6), "lower": F.round(lower, 6), "upper": F.round(upper, 6)})


def counts():
    """n and c: records and passes."""
    return F.count("*").alias("n"), F.count_if("passed").alias("c")


_PIVOT = ", ".join(f"count(*) FILTER (WHERE overall_status = '{s}') AS {s.lower()}" for s in STATUSES)


@query("agg01_status_breakdown", RECORDS_SQL + f"SELECT model, count(*) AS n, {_PIVOT}, round(avg(passed::INT), 4) AS rate FROM rec GROUP BY 1")
def status_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each status by model, zeros filled in."""
    by = [F.count_if(F.col("overall_status") == s).alias(s.lower()) for s in STATUSES]
    return eligible(records(spark, d)).groupBy("model").agg(F.count("*").alias("n"), *by, F.round(F.avg(F.col("passed").cast("int")), 4).alias("rate"))


@query("agg02_direction_rates", RECORDS_SQL + f"""
, g AS (SELECT direction, CASE WHEN direction IN ('cuda-to-opencl', 'opencl-to-cuda', 'omp-to-opencl', 'opencl-to-omp') AND direction NOT IN ({', '.join(f"'{x}'" for x in STANDARD)}) THEN 'case-study' ELSE 'standard' END AS stratum, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec WHERE augment_level = 0 GROUP BY 1, 2)
SELECT direction, stratum, n, c, {wilson_sql()} FROM g""")
def direction_rates(spark: SparkSession, d: str) -> DataFrame:
    """Level-0 rates by direction with Wilson intervals; directions of neither stratum count as standard."""
    case_study = F.col("direction").isin("omp-to-opencl", "opencl-to-omp")
    g = eligible(records(spark, d)).where("augment_level = 0").groupBy("direction", F.when(case_study, "case-study").otherwise("standard").alias("stratum")).agg(*counts())
    return with_wilson(g)


def _slice_sql(where: str = "") -> str:
    parts = [f"SELECT '{k}' AS dimension, CAST({k} AS VARCHAR) AS value, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec {where} GROUP BY {k}" for k in ("model", "suite", "direction", "kernel", "augment_level")]
    return " UNION ALL ".join(parts)


DIMENSIONS = ("model", "suite", "direction", "kernel", "augment_level")


def slices(df: DataFrame) -> DataFrame:
    """Counts by each of the dimensions, in one pass: grouping sets over rows reduced to the full key first."""
    cube = df.groupBy(*DIMENSIONS).agg(*counts())
    named = [F.when(F.grouping(k) == 0, F.lit(k)) for k in DIMENSIONS]
    values = [F.when(F.grouping(k) == 0, F.col(k).cast("string")) for k in DIMENSIONS]
    sets = [[F.col(k)] for k in DIMENSIONS]
    return cube.groupingSets(sets, *DIMENSIONS).agg(F.coalesce(*named).alias("dimension"), F.coalesce(*values).alias("value"), F.sum("n").alias("n"), F.sum("c").alias("c")).drop(*DIMENSIONS)


@query("agg03_dimension_slices", RECORDS_SQL + f", g AS ({_slice_sql()}) SELECT dimension, value, n, c, {wilson_sql()} FROM g")
def dimension_slices(spark: SparkSession, d: str) -> DataFrame:
    """Pass rates by model, suite, direction, kernel and level."""
    return with_wilson(slices(eligible(records(spark, d))))


@query("agg04_any_sample_collapse", RECORDS_SQL + CELLS_SQL + """
, f AS (SELECT model, suite, kernel, direction, overall_status, count(*) AS k, min(record_id) AS first FROM rec WHERE NOT passed GROUP BY ALL),
 w AS (SELECT *, row_number() OVER (PARTITION BY model, suite, kernel, direction ORDER BY k DESC, first) AS r FROM f)
SELECT model, suite, kernel, direction, CASE WHEN passed THEN 'PASS' ELSE overall_status END AS status, n, n < 3 AS few FROM cell LEFT JOIN (SELECT * FROM w WHERE r = 1) USING (model, suite, kernel, direction)""")
def any_sample_collapse(spark: SparkSession, d: str) -> DataFrame:
    """One status for each cell: PASS if any sample passed, else the commonest failure, the first seen on a tie."""
    key = ["model", "suite", "kernel", "direction"]
    by = eligible(records(spark, d)).groupBy(*key, "overall_status").agg(F.count("*").alias("k"), F.min("record_id").alias("first"))
    best = F.max_by("overall_status", F.struct(F.when(F.col("overall_status") == "PASS", 1).otherwise(0), "k", -F.col("first")))
    return by.groupBy(*key).agg(best.alias("status"), F.sum("k").alias("n")).withColumn("few", F.col("n") < 3)


@query("agg05_dual_pass_at_1", RECORDS_SQL + """
, c AS (SELECT kernel, direction, augment_level, model, count(*) AS n, count(*) FILTER (WHERE passed) AS p FROM rec GROUP BY 1, 2, 3, 4)
SELECT augment_level, count(*) AS cells, round(avg((p > 0)::INT), 6) AS of_any, round(avg(p::DOUBLE / n), 6) AS mean, round(avg((p > 0)::INT) - avg(p::DOUBLE / n), 6) AS divergence FROM c GROUP BY 1""")
def dual_pass(spark: SparkSession, d: str) -> DataFrame:
    """pass@1 as any sample and as the mean of samples, averaged by level from unrounded values."""
    c = any_sample(eligible(records(spark, d)), ("kernel", "direction", "augment_level", "model"))
    any_, mean = F.avg(F.col("passed").cast("int")), F.avg(F.col("c") / F.col("n"))
    return c.groupBy("augment_level").agg(F.count("*").alias("cells"), F.round(any_, 6).alias("of_any"), F.round(mean, 6).alias("mean"), F.round(any_ - mean, 6).alias("divergence"))


def pass_at_k_sql(k: int, small: str) -> str:
    miss = " * ".join(f"((n - c - {i})::DOUBLE / (n - {i}))" for i in range(k))
    return f"CASE WHEN n < {k} THEN {small} WHEN c = 0 THEN 0 WHEN n - c < {k} THEN 1 ELSE 1 - {miss} END"


@query("agg06_pass_at_k_tasks", RECORDS_SQL + f"""
, t AS (SELECT source_spec, target_spec, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec GROUP BY 1, 2)
SELECT source_spec, target_spec, n, c, round({pass_at_k_sql(1, 'NULL')}, 6) AS pass_1, round({pass_at_k_sql(3, 'c::DOUBLE / n')}, 6) AS pass_3, round({pass_at_k_sql(5, 'NULL')}, 6) AS pass_5,
 CASE WHEN c = n THEN 'always_pass' WHEN c = 0 THEN 'hard_fail' ELSE 'noisy_fail' END AS class FROM t""")
def pass_at_k_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Unbiased pass@k of each task, and its class (AGG-07)."""
    t = eligible(records(spark, d)).groupBy("source_spec", "target_spec").agg(*counts())
    n, c = F.col("n"), F.col("c")
    kind = F.when(c == n, "always_pass").when(c == 0, "hard_fail").otherwise("noisy_fail")
    return t.withColumns({"pass_1": F.round(stats.pass_at_k(n, c, 1), 6), "pass_3": F.round(stats.pass_at_k(n, c, 3, "pass1"), 6), "pass_5": F.round(stats.pass_at_k(n, c, 5), 6), "class": kind})


@query("agg06_08_macro_pass_at_k", RECORDS_SQL + f"""
, t AS (SELECT kernel, direction, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec WHERE augment_level = 0 GROUP BY 1, 2), v AS (SELECT direction, CASE WHEN n >= 3 THEN {pass_at_k_sql(3, 'NULL')} WHEN c > 0 THEN 1 ELSE 0 END AS p FROM t)
SELECT direction, count(*) AS tasks, round(avg(p), 6) AS mean, round(greatest(0, avg(p) - 1.96 * coalesce(stddev_samp(p), 0) / sqrt(count(*))), 6) AS lower, round(least(1, avg(p) + 1.96 * coalesce(stddev_samp(p), 0) / sqrt(count(*))), 6) AS upper FROM v GROUP BY 1""")
def macro_pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Macro mean of pass@min(n, 3) over level-0 tasks by direction, with a normal interval."""
    t = eligible(records(spark, d)).where("augment_level = 0").groupBy("kernel", "direction").agg(*counts())
    p = stats.pass_at_k(F.col("n"), F.col("c"), 3, "clip")
    half = 1.96 * F.coalesce(F.stddev_samp("p"), F.lit(0.0)) / F.sqrt(F.count("*"))
    low, high = F.greatest(F.lit(0.0), F.avg("p") - half), F.least(F.lit(1.0), F.avg("p") + half)
    return t.withColumn("p", p).groupBy("direction").agg(F.count("*").alias("tasks"), F.round(F.avg("p"), 6).alias("mean"), F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


@query("agg07_task_classes", RECORDS_SQL + CELLS_SQL + "SELECT suite, count(*) FILTER (WHERE c = n) AS always_pass, count(*) FILTER (WHERE c = 0) AS hard_fail, count(*) FILTER (WHERE c > 0 AND c < n) AS noisy_fail FROM cell GROUP BY 1")
def task_classes(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that always, never and sometimes pass."""
    c, n = F.col("c"), F.col("n")
    return any_sample(eligible(records(spark, d))).groupBy("suite").agg(F.count_if(c == n).alias("always_pass"), F.count_if(c == 0).alias("hard_fail"), F.count_if((c > 0) & (c < n)).alias("noisy_fail"))


@query("agg09_self_repair", RECORDS_SQL + """
SELECT direction, count(*) AS n, count(*) FILTER (WHERE passed) AS first_passes, count(*) FILTER (WHERE NOT passed AND record_id % 3 = 0) AS repaired, round(avg(CASE WHEN NOT passed AND record_id % 3 = 0 THEN 2 ELSE 1 END), 6) AS mean_attempts FROM rec GROUP BY 1""")
def self_repair(spark: SparkSession, d: str) -> DataFrame:
    """First-attempt passes, repaired records and mean attempts by direction."""
    r = eligible(records(spark, d)).withColumn("attempts", attempts())
    first, last = attempt_status(F.col("attempts")[0]) == "PASS", attempt_status(F.element_at("attempts", -1)) == "PASS"
    return r.groupBy("direction").agg(F.count("*").alias("n"), F.count_if(first).alias("first_passes"), F.count_if(~first & last).alias("repaired"), F.round(F.avg(F.size("attempts")), 6).alias("mean_attempts"))


def with_old_status(df: DataFrame) -> DataFrame:
    """The preceding record's status of the same model as the old one. Ordered by time within (model, kernel), so a
    window holds one unit's history and not a model's."""
    w = Window.partitionBy("model", "kernel").orderBy("record_id")
    return df.withColumn("old_status", F.coalesce(F.lag("overall_status").over(w), F.col("overall_status")))


OLD_SQL = ", tr AS (SELECT *, coalesce(lag(overall_status) OVER (PARTITION BY model, kernel ORDER BY record_id), overall_status) AS old_status FROM rec)"


@query("agg10_transition_matrix", RECORDS_SQL + OLD_SQL + """
SELECT 'all' AS dimension, 'all' AS value, old_status || '->' || overall_status AS transition, count(*) AS n FROM tr GROUP BY 3
UNION ALL SELECT 'model', model, old_status || '->' || overall_status, count(*) FROM tr GROUP BY 2, 3 UNION ALL SELECT 'suite', suite, old_status || '->' || overall_status, count(*) FROM tr GROUP BY 2, 3
UNION ALL SELECT 'direction', direction, old_status || '->' || overall_status, count(*) FROM tr GROUP BY 2, 3""")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Old against new status, in all and by model, suite and direction."""
    tr = with_old_status(eligible(records(spark, d))).withColumn("transition", F.concat_ws("->", "old_status", "overall_status"))
    dims = ("model", "suite", "direction")
    sets = [[F.col("transition")], *[[F.col(k), F.col("transition")] for k in dims]]
    g = tr.groupingSets(sets, *dims, "transition")
    name = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in dims], F.lit("all"))
    value = F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k)) for k in dims], F.lit("all"))
    return g.agg(name.alias("dimension"), value.alias("value"), F.count("*").alias("n")).select("dimension", "value", "transition", "n")


@query("agg11_micro_macro", RECORDS_SQL + """
, s AS (SELECT model, suite, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec GROUP BY 1, 2)
SELECT model, round(sum(c)::DOUBLE / sum(n), 6) AS micro, round(avg(c::DOUBLE / n), 6) AS macro, round(100 * (avg(c::DOUBLE / n) - sum(c)::DOUBLE / sum(n)), 6) AS delta_pp FROM s GROUP BY 1""")
def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    """Rates over records against the mean of suites' rates."""
    s = eligible(records(spark, d)).groupBy("model", "suite").agg(*counts())
    micro, macro = F.sum("c") / F.sum("n"), F.avg(F.col("c") / F.col("n"))
    return s.groupBy("model").agg(F.round(micro, 6).alias("micro"), F.round(macro, 6).alias("macro"), F.round(100 * (macro - micro), 6).alias("delta_pp"))


@query("agg12_leave_one_out", RECORDS_SQL + """
, v AS (SELECT NULL AS x UNION ALL SELECT DISTINCT suite FROM rec)
SELECT CASE WHEN x IS NULL THEN 'FULL' ELSE 'minus_' || x END AS variant, count(*) AS n, count(*) FILTER (WHERE passed) AS c, count(*) FILTER (WHERE augment_level = 0) AS n_l0, count(*) FILTER (WHERE augment_level = 0 AND passed) AS c_l0,
 round(count(*) FILTER (WHERE passed) / count(*)::DOUBLE, 6) AS rate FROM rec, v WHERE x IS NULL OR suite <> x GROUP BY 1""")
def leave_one_suite_out(spark: SparkSession, d: str) -> DataFrame:
    """Headline numbers over everything and without each suite."""
    l0 = F.col("augment_level") == 0
    out = leave_one_out(eligible(records(spark, d)), "suite", {"n": F.count("*"), "c": F.count_if("passed"), "n_l0": F.count_if(l0), "c_l0": F.count_if(l0 & F.col("passed"))})
    return out.withColumn("rate", F.round(F.col("c") / F.col("n"), 6))


@query("agg13_numeric_summary", RECORDS_SQL + """
, o AS (SELECT model, completion_tokens AS x, row_number() OVER (PARTITION BY model ORDER BY completion_tokens) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM rec)
SELECT model, count(*) AS n, round(avg(x), 1) AS mean, round(median(x), 1) AS median, round(stddev_pop(x), 1) AS std, min(x) AS min, max(x) AS max, CAST(sum(x) AS BIGINT) AS total,
 max(x) FILTER (WHERE r = n // 2) AS upper_median, max(x) FILTER (WHERE r = CAST(floor(n * 0.95) AS BIGINT)) AS p95 FROM o GROUP BY 1""")
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of completion tokens; the upper median and p95 are elements of the sorted values.

    Values are counted first. Counts of 256 cells of a group's range tell in which cells the wanted places are; only the
    values of these cells are put in order.
    """
    counts = eligible(records(spark, d)).groupBy("model", F.col("completion_tokens").alias("x")).agg(F.count("*").alias("k"))
    x, k = F.col("x").cast("double"), F.col("k")
    total = counts.groupBy("model").agg(F.sum("k").alias("n"), F.sum(F.col("x") * k).alias("total"), F.sum(x * x * k).alias("squares"), F.min("x").alias("min"), F.max("x").alias("max"))
    cell = F.least(F.floor((F.col("x") - F.col("min")) * 256 / F.greatest(F.col("max") - F.col("min"), F.lit(1))), F.lit(255))
    placed = counts.join(total.select("model", "n", "min", "max"), "model").withColumn("cell", cell)
    w = Window.partitionBy("model").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("model", "cell", "n").agg(F.sum("k").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    places = {"low": F.expr("(n - 1) div 2"), "upper_median": F.expr("n div 2"), "p95": F.floor(F.col("n") * 0.95)}
    wanted = F.exists(F.array(*[p.cast("long") for p in places.values()]), lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("m")))
    few = cells.where(wanted).select("model", "cell", "before")  # three rows a model at most; Spark broadcasts what proves small
    inside = Window.partitionBy("model", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.join(few, ["model", "cell"]).withColumn("from", F.col("before") + F.coalesce(F.sum("k").over(inside), F.lit(0)))
    found = near.groupBy("model").agg(*[F.max(F.when((F.col("from") <= p) & (p < F.col("from") + k), F.col("x"))).alias(name) for name, p in places.items()])
    mean = F.col("total") / F.col("n")
    return total.join(found, "model").select(
        "model", "n", F.round(mean, 1).alias("mean"), F.round((F.col("low") + F.col("upper_median")) / 2, 1).alias("median"), F.round(F.sqrt(F.col("squares") / F.col("n") - mean * mean), 1).alias("std"),
        "min", "max", "total", "upper_median", "p95",
    )


@query("agg14_token_cost_rollup", RECORDS_SQL + f"""
, c AS (SELECT rec.*, (prompt_tokens * price_in + completion_tokens * price_out) / 1e6 AS cost FROM rec LEFT JOIN {PRICES_SQL} ON p.model = rec.model)
SELECT model, suite, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion, CASE WHEN bool_or(cost IS NULL) THEN NULL ELSE round(sum(cost), 4) END AS cost,
 CASE WHEN bool_or(cost IS NULL) THEN NULL ELSE round(sum(cost) / nullif(count(*) FILTER (WHERE passed), 0), 4) END AS per_pass FROM c GROUP BY 1, 2""")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and cost by model and suite; no cost where a record has no price."""
    cost = F.when(~F.bool_or(F.col("cost").isNull()), F.sum("cost"))
    return priced(eligible(records(spark, d))).groupBy("model", "suite").agg(F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.round(cost, 4).alias("cost"), F.round(F.try_divide(cost, F.count_if("passed")), 4).alias("per_pass"))


@query("agg15_extraction_reliability", RECORDS_SQL + """
SELECT model, CAST(sum(1 + record_id % 3) AS BIGINT) AS expected, CAST(sum(CASE WHEN overall_status = 'EXTRACTION_FAIL' THEN 0 ELSE 1 + record_id % 3 END) AS BIGINT) AS extracted, count(*) FILTER (WHERE overall_status = 'EXTRACTION_FAIL') AS mismatches FROM rec GROUP BY 1""")
def extraction(spark: SparkSession, d: str) -> DataFrame:
    """Files expected and extracted."""
    expected = F.transform(F.sequence(F.lit(0).cast("long"), F.col("record_id") % 3), lambda i: F.concat(F.lit("f"), i))
    r = eligible(records(spark, d)).withColumn("expected", expected).withColumn("got", F.when(F.col("overall_status") == "EXTRACTION_FAIL", F.array().cast("array<string>")).otherwise(F.col("expected")))
    return r.groupBy("model").agg(F.sum(F.size("expected")).alias("expected"), F.sum(F.size("got")).alias("extracted"), F.count_if(F.size("expected") != F.size("got")).alias("mismatches"))


@query("agg16_suite_api_crosstab", RECORDS_SQL + """
SELECT suite, count(DISTINCT kernel) FILTER (WHERE source_api = 'cuda') AS cuda, count(DISTINCT kernel) FILTER (WHERE source_api = 'omp') AS omp, count(DISTINCT kernel) FILTER (WHERE source_api = 'opencl') AS opencl, count(DISTINCT kernel) AS total FROM rec GROUP BY 1""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Distinct kernels of each suite by API."""
    units = eligible(records(spark, d)).groupBy("suite", "kernel").agg(*[F.bool_or(F.col("source_api") == a).alias(a) for a in ("cuda", "omp", "opencl")])
    return units.groupBy("suite").agg(*[F.count_if(a).alias(a) for a in ("cuda", "omp", "opencl")], F.count("*").alias("total"))


@query("agg17_frequency_distribution", """
SELECT coalesce(r_name, 'all') AS suite, coalesce(l_linestatus, 'all') AS api, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(l_quantity) AS least, max(l_quantity) AS most
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((), (r_name), (l_linestatus), (r_name, l_linestatus))""")
def frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Counts overall, by suite, by API and by both, over a join of four tables."""
    t = lambda x: table(spark, d, x)
    place = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    j = t("lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    cell = j.groupBy("r_name", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    g = cell.cube("r_name", "l_linestatus").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"), F.min("least").alias("least"), F.max("most").alias("most"))
    return g.select(F.coalesce("r_name", F.lit("all")).alias("suite"), F.coalesce("l_linestatus", F.lit("all")).alias("api"), "n", "lines", "least", "most")


@query("agg18_small_groups", RECORDS_SQL + "SELECT model, kernel, direction, count(*) AS n FROM rec GROUP BY 1, 2, 3 HAVING count(*) < 10")
def small_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of model, kernel and direction too small to report."""
    return eligible(records(spark, d)).groupBy("model", "kernel", "direction").agg(F.count("*").alias("n")).where("n < 10")


@query("agg20_units_with_lineage", RECORDS_SQL + OLD_SQL + """
, c AS (SELECT model, suite, kernel, direction, bool_or(old_status = 'PASS') AS old, bool_or(passed) AS new, count(*) AS n FROM tr GROUP BY 1, 2, 3, 4)
SELECT c.*, record_id AS contributor, row_number() OVER (PARTITION BY model, suite, kernel, direction ORDER BY record_id) AS place FROM c JOIN tr USING (model, suite, kernel, direction)""")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Old and new state of every cell, with the records that it comes from in order, one to a row, so that a cell may have any number."""
    key = ["model", "suite", "kernel", "direction"]
    tr = with_old_status(eligible(records(spark, d)))
    w = Window.partitionBy(*key)
    place = F.row_number().over(w.orderBy("record_id"))
    cells = tr.groupBy(*key).agg(F.bool_or(F.col("old_status") == "PASS").alias("old"), F.bool_or("passed").alias("new"), F.count("*").alias("n"))
    return cells.join(tr.select(*key, F.col("record_id").alias("contributor"), place.alias("place")), key)


@query("agg22_run_fail_mechanism", RECORDS_SQL + OLD_SQL + """
SELECT model, count(*) FILTER (WHERE record_id % 3 = 0) AS timeout, count(*) FILTER (WHERE record_id % 3 = 1) AS fail, count(*) FILTER (WHERE record_id % 3 = 2) AS other FROM tr WHERE old_status = 'PASS' AND overall_status = 'RUN_FAIL' GROUP BY 1""")
def run_fail_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """Records that went from PASS to RUN_FAIL, by how they failed."""
    how = F.element_at(F.array(*map(F.lit, ("timeout", "fail", "other"))), (F.col("record_id") % 3 + 1).cast("int"))
    tr = with_old_status(eligible(records(spark, d))).where("old_status = 'PASS' and overall_status = 'RUN_FAIL'")
    return tr.withColumn("how", how).groupBy("model").pivot("how", ["timeout", "fail", "other"]).count().na.fill(0)


def content_hashes(files: DataFrame, group: str) -> DataFrame:
    """AGG-23: (group, hash, files) of rows (group, path, sha256): the SHA-256 over lines of path and digest, sorted by path.

    A group's lines are read in order and hashed as they come, so no list of them is held; the digest is one sequence by
    its definition, so the groups, not their lines, are what runs side by side. Rows are reduced to path and digest before.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, n, digest = None, 0, None
        for frame in frames:
            out = []
            for key, path, sha in frame.itertuples(index=False):
                if digest is None or key != current:
                    if digest is not None:
                        out.append((current, digest.hexdigest(), n))
                    current, n, digest = key, 0, hashlib.sha256()
                digest.update(f"{path}\t{sha}\n".encode())
                n += 1
            if out:
                yield pd.DataFrame(out, columns=[group, "hash", "files"])
        if digest is not None:
            yield pd.DataFrame([(current, digest.hexdigest(), n)], columns=[group, "hash", "files"])

    rows = files.select(group, "path", "sha256").repartition(group).sortWithinPartitions(group, "path")
    return rows.mapInPandas(run, f"`{group}` {dict(files.dtypes)[group]}, hash string, files long")


@query("agg23_content_hash", "SELECT source, sha256(string_agg('doc' || doc_id || chr(9) || sha256(text) || chr(10), '' ORDER BY 'doc' || doc_id)) AS hash, count(*) AS files FROM documents GROUP BY 1")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each tree's (path, content hash) pairs that does not depend on the order of reading."""
    files = table(spark, d, "documents").select("source", F.concat(F.lit("doc"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return content_hashes(files, "source")


@query("agg24_determinism", "SELECT l_orderkey, bool_and(l_returnflag = 'N') AND count(*) > 0 AS stable FROM lineitem GROUP BY 1")
def determinism(spark: SparkSession, d: str) -> DataFrame:
    """Whether all runs of a unit passed."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.bool_and(F.col("l_returnflag") == "N") & (F.count("*") > 0)).alias("stable"))


@query("agg25_levels_by_direction", RECORDS_SQL + f", g AS (SELECT direction, augment_level, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec GROUP BY 1, 2) SELECT direction, augment_level, n, c, {wilson_sql()} FROM g")
def levels_by_direction(spark: SparkSession, d: str) -> DataFrame:
    """Raw augmentation curves."""
    return with_wilson(eligible(records(spark, d)).where("overall_status <> 'UNKNOWN'").groupBy("direction", "augment_level").agg(*counts()))


@query("agg26_oracle_shape_rates", RECORDS_SQL + f"""
, g AS (SELECT CASE WHEN regexp_extract(kernel, '[0-9]+')::INT % 5 IN (0, 3) THEN 'numeric/hash' WHEN regexp_extract(kernel, '[0-9]+')::INT % 5 = 1 THEN 'self-checking' ELSE 'banner-only' END AS shape, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec WHERE augment_level = 0 GROUP BY 1) SELECT shape, n, c, {wilson_sql()} FROM g""")
def shape_rates(spark: SparkSession, d: str) -> DataFrame:
    """Level-0 rates by the shape of the target's oracle."""
    rec = eligible(records(spark, d)).where("augment_level = 0")
    number = F.regexp_extract("kernel", "([0-9]+)", 1).cast("int")
    specs = rec.select("target_spec", oracle_shape(strategies(number)).alias("shape")).distinct()
    return with_wilson(rec.join(specs, "target_spec").groupBy("shape").agg(*counts()))


@query("clm01_claim_table", RECORDS_SQL + """
SELECT 'pass_rate.' || model AS claim_id, '$.models.' || model || '.rate' AS json_path, round(avg(passed::INT), 6) AS value FROM rec GROUP BY model UNION ALL SELECT 'records.' || model, '$.models.' || model || '.n', count(*)::DOUBLE FROM rec GROUP BY model""")
def claim_table(spark: SparkSession, d: str) -> DataFrame:
    """Claims flattened from a nested metric document; a missing number stops the query."""
    m = eligible(records(spark, d)).groupBy("model").agg(F.struct(F.round(F.avg(F.col("passed").cast("int")), 6).alias("rate"), F.count("*").cast("double").alias("n")).alias("metrics"))
    need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"missing {what}")).cast("double"))
    row = lambda claim, key: F.struct(F.concat(F.lit(claim), "model").alias("claim_id"), F.concat(F.lit("$.models."), "model", F.lit(f".{key}")).alias("json_path"), need(F.col(f"metrics.{key}"), key).alias("value"))
    return m.select(F.explode(F.array(row("pass_rate.", "rate"), row("records.", "n"))).alias("x")).select("x.*")


@query("clm03_model_discovery", RECORDS_SQL + "SELECT count(DISTINCT model) AS models, count(DISTINCT model) = 3 AS as_expected FROM rec")
def model_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Models found in file names, held against how many there should be."""
    path = F.concat(F.lit("results/"), "model", F.lit("/"), "target_spec", F.lit(".json"))
    m = eligible(records(spark, d)).select(F.regexp_extract(path, r"results/([^/]+)/", 1).alias("m")).distinct()
    return m.agg(F.count("*").alias("models"), (F.count("*") == 3).alias("as_expected"))


@query("clm04_scope_routing", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'records' WHEN 1 THEN 'tasks' ELSE 'not_applicable' END AS scope FROM part")
def scope_routing(spark: SparkSession, d: str) -> DataFrame:
    """The population that a claim is about, by its prefix; a claim derived from records must have one."""
    claim = F.concat(F.element_at(F.array(*map(F.lit, ("rec.", "task.", "doc."))), F.col("p_size") % 3 + 1), "p_partkey")
    scope = F.when(claim.startswith("rec."), "records").when(claim.startswith("task."), "tasks").otherwise("not_applicable")
    checked = F.when(claim.startswith("rec.") & (scope == "not_applicable"), F.raise_error(F.lit("a record claim needs a population")).cast("string")).otherwise(scope)
    return table(spark, d, "part").select("p_partkey", checked.alias("scope"))


@query("clm06_independent_recomputation", RECORDS_SQL + "SELECT model, count(*) FILTER (WHERE passed) AS c, true AS agrees FROM rec GROUP BY 1")
def recomputation(spark: SparkSession, d: str) -> DataFrame:
    """Passes counted twice, from records and from cells; both must agree."""
    rec = eligible(records(spark, d))
    a = rec.groupBy("model").agg(F.count_if("passed").alias("c"))
    b = any_sample(rec).groupBy("model").agg(F.sum("c").alias("again"))
    return a.join(b, "model").select("model", "c", (F.col("c") == F.col("again")).alias("agrees"))


@query("clm07_search_patterns", RECORDS_SQL + "SELECT model, '\\b' || replace(printf('%.1f', round(100 * avg(passed::INT), 1)), '.', '\\.') || '\\s*\\\\?%' AS pattern FROM rec GROUP BY 1")
def search_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The spelling of a rate that a text is searched for."""
    v = F.format_string("%.1f", F.round(100 * F.avg(F.col("passed").cast("int")), 1))
    return eligible(records(spark, d)).groupBy("model").agg(F.concat(F.lit("\\b"), F.replace(v, F.lit("."), F.lit("\\.")), F.lit("\\s*\\\\?%")).alias("pattern"))


@query("clm08_run_metadata", RECORDS_SQL + "SELECT (SELECT count(*) FROM allrec) AS total, count(*) AS valid, count(*) FILTER (WHERE augment_level = 0) AS canonical, 'results' AS namespace FROM rec")
def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Populations of a run, in one pass."""
    ok = ~F.col("source_spec").isin(*INELIGIBLE) & ~F.col("target_spec").isin(*INELIGIBLE)
    return records(spark, d).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(ok & (F.col("augment_level") == 0)).alias("canonical"), F.lit("results").alias("namespace"))


#: What may begin the line of a definition, and what linkers say.
DEFINITION = r"^\s*(?:__global__|__device__|__host__|static|inline|extern|void|int|float|double|unsigned|long|short|char|size_t|auto|bool|template\s*<[^>]*>)\s+.*?\b(\w+)\s*\("
UNDEFINED, DOUBLE = r"undefined reference to [`'](\w+)'", r"(?:multiple definition of|duplicate symbol) [`'](\w+)'"


def linker_hints(failures: DataFrame, sources: DataFrame) -> DataFrame:
    """PRJ-18: (failure, symbol, problem, file, line, hint) for (failure, log) and (failure, position, name, content).

    Names that lines of a source define are looked up by an equi-join; the first file of a failure that defines a symbol counts,
    at the first such line.
    """
    both = lambda pattern, what: F.transform(F.array_distinct(F.regexp_extract_all("log", F.lit(pattern), 1)), lambda s: F.struct(s.alias("symbol"), F.lit(what).alias("problem")))
    named = failures.select("failure", F.inline(F.concat(both(UNDEFINED, "undefined"), both(DOUBLE, "duplicate"))))
    lines = sources.select("failure", "position", "name", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    defined = lines.withColumn("symbol", F.explode(F.regexp_extract_all("text", F.lit(DEFINITION), 1)))
    first = defined.groupBy("failure", "symbol").agg(F.min(F.struct("position", (F.col("at") + 1).alias("line"), "name")).alias("d"))
    j = named.join(first, ["failure", "symbol"], "left")
    there = (F.col("problem") == "undefined") & F.col("d").isNotNull()
    hint = F.when(F.col("problem") == "duplicate", "keep in one file").when(there, "include the definition").otherwise("not found in source files")
    return j.select("failure", "symbol", "problem", F.when(there, F.col("d.name")).alias("file"), F.when(there, F.col("d.line")).alias("line"), hint.alias("hint"))


@query("prj18_linker_symbols", """
SELECT p_partkey AS failure, 'fn_' || (p_size % 7) AS symbol, 'undefined' AS problem, CASE WHEN p_size % 7 < 3 THEN 'a.c' WHEN p_size % 7 < 5 THEN 'b.cu' END AS file, CASE WHEN p_size % 7 < 3 THEN p_size % 7 + 2 WHEN p_size % 7 < 5 THEN 2 END AS line,
 CASE WHEN p_size % 7 < 5 THEN 'include the definition' ELSE 'not found in source files' END AS hint FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 'dup_' || (p_size % 3), 'duplicate', NULL, NULL, 'keep in one file' FROM part WHERE p_size % 3 <> 1""")
def linker_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Undefined and doubly defined symbols named in linker messages, with the source and line that defines them."""
    k, p = F.col("p_size") % 7, table(spark, d, "part")
    one = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/usr/bin/ld: main.o: undefined reference to `fn_"), k, F.lit("'\nx.o: undefined reference to 'fn_"), k, F.lit("'\n"))).otherwise("")
    two = F.when(F.col("p_size") % 3 != 1, F.concat(F.lit("ld: multiple definition of `dup_"), F.col("p_size") % 3, F.lit("'; a.o"))).otherwise("collect2: error")
    failures = p.select(F.col("p_partkey").alias("failure"), F.concat(one, two).alias("log"))
    entry = lambda i, name, text: F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), text.alias("content"))
    a = F.lit("// fn_9(\nint fn_0(int x) { return fn_4(x); }\n  static float fn_1 (void);\nvoid *fn_2(\n")
    b = F.concat(F.lit("x = fn_6(1);\n__global__ void fn_"), k, F.lit("(int a) {}\nint fn_3(void); int fn_4(void)\n"))
    sources = p.select(F.col("p_partkey").alias("failure"), F.inline(F.array(entry(0, "a.c", a), entry(1, "b.cu", F.when(k < 5, b).otherwise("int other(void)")))))
    return linker_hints(failures, sources)
