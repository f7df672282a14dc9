"""Statistics, windows and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators.collapse import all_pairs, any_sample
from tallyforge.plans.aggregates import Z, counts, wilson_sql, with_wilson
from tallyforge.plans.joins import CELLS_SQL
from tallyforge.plans.registry import query
from tallyforge.sources.records import RECORDS_SQL, eligible, records, table
from tallyforge.streaming.campaign import Protocol, budgeted


def erfc_sql(z: str) -> str:
    """A published rational fit of erfc for z >= 0 (error below 1.2e-7): another way than the engine's series."""
    t = f"(1 / (1 + 0.5 * ({z})))"
    coefficients = (1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = "0"
    for c in reversed(coefficients):
        poly = f"({t} * ({c} + {poly}))"
    return f"({t} * exp(-({z}) * ({z}) - 1.26551223 + {poly}))"


@query("sta01_wilson", RECORDS_SQL + f", g AS (SELECT kernel, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec GROUP BY 1) SELECT kernel, n, c, {wilson_sql()} FROM g")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    """Wilson intervals of kernels' rates."""
    return with_wilson(eligible(records(spark, d)).groupBy("kernel").agg(*counts()))


@query("sta02_normal_quantile", """
SELECT p_partkey, round(CASE WHEN p = 0.5 THEN 0 WHEN p < 0.5 THEN -x ELSE x END, 6) AS z FROM (SELECT p_partkey, p, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS x
 FROM (SELECT p_partkey, p, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM (SELECT p_partkey, p_size / 51.0::DOUBLE AS p FROM part)))""")
def quantile(spark: SparkSession, d: str) -> DataFrame:
    """Normal quantiles by a rational approximation."""
    return table(spark, d, "part").select("p_partkey", F.round(stats.normal_quantile(F.col("p_size") / 51.0), 6).alias("z"))


@query("sta03_cohens_h", RECORDS_SQL + """
, g AS (SELECT suite, avg(passed::INT) FILTER (WHERE model = 'm0') AS a, avg(passed::INT) FILTER (WHERE model = 'm1') AS b FROM rec GROUP BY 1), h AS (SELECT suite, 2 * asin(sqrt(a)) - 2 * asin(sqrt(b)) AS h FROM g)
SELECT suite, round(h, 6) AS h, CASE WHEN abs(h) < 0.2 THEN 'negligible' WHEN abs(h) < 0.5 THEN 'small' WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END AS four, CASE WHEN abs(h) < 0.2 THEN 'small' WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END AS three FROM h""")
def cohens_h(spark: SparkSession, d: str) -> DataFrame:
    """Effect sizes between two models by suite, with both tables of labels."""
    share = lambda m: F.avg(F.when(F.col("model") == m, F.col("passed").cast("int")))
    h = eligible(records(spark, d)).groupBy("suite").agg(stats.cohens_h(share("m0"), share("m1")).alias("h"))
    return h.select("suite", F.round("h", 6).alias("h"), stats.effect_label(F.col("h")).alias("four"), stats.effect_label(F.col("h"), stats.THREE_LABELS).alias("three"))


@query("sta04_chi_squared", RECORDS_SQL + """
, o AS (SELECT model, passed, count(*)::DOUBLE AS o FROM rec GROUP BY 1, 2), e AS (SELECT o, sum(o) OVER (PARTITION BY model) * sum(o) OVER (PARTITION BY passed) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM o),
 x AS (SELECT sum((o - e) * (o - e) / e) AS x2, max(n) AS n, min(e) AS least FROM e)
SELECT round(x2, 6) AS x2, 2 AS dof, round(exp(-x2 / 2), 5) AS p, round(sqrt(x2 / n), 6) AS v, least < 5 AS low_expected FROM x""")
def chi_squared(spark: SparkSession, d: str) -> DataFrame:
    """Pass or fail by model: Pearson's chi-squared, its p and Cramer's V. Windows run over a table of six cells."""
    o = eligible(records(spark, d)).groupBy("model", "passed").agg(F.count("*").cast("double").alias("o"))
    total = F.sum("o").over(Window.partitionBy())
    e = o.withColumn("n", total).withColumn("e", F.sum("o").over(Window.partitionBy("model")) * F.sum("o").over(Window.partitionBy("passed")) / F.col("n"))
    x = e.agg(F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2.0)) / F.col("e")).alias("x2"), F.max("n").alias("n"), F.min("e").alias("least"), ((F.countDistinct("model") - 1) * (F.countDistinct("passed") - 1)).cast("int").alias("dof"))
    return x.select(F.round("x2", 6).alias("x2"), "dof", F.round(stats.chi2_p(F.col("x2"), F.col("dof")), 5).alias("p"), F.round(F.sqrt(F.col("x2") / F.col("n")), 6).alias("v"), (F.col("least") < 5).alias("low_expected"))


def _two_by_two(df: DataFrame, by: str) -> DataFrame:
    n = lambda m, ok: F.count_if((F.col("model") == m) & (F.col("passed") == ok))
    return df.where("model in ('m0', 'm1')").groupBy(by).agg(n("m0", True).alias("a"), n("m0", False).alias("b"), n("m1", True).alias("c"), n("m1", False).alias("d"))


TABLE_SQL = ", t AS (SELECT suite, count(*) FILTER (WHERE model = 'm0' AND passed) AS a, count(*) FILTER (WHERE model = 'm0' AND NOT passed) AS b, count(*) FILTER (WHERE model = 'm1' AND passed) AS c, count(*) FILTER (WHERE model = 'm1' AND NOT passed) AS d FROM rec WHERE augment_level = 0 AND direction = 'cuda-to-omp' GROUP BY 1)"


def _choose_sql(n: str, k: str) -> str:
    return f"(lgamma(({n})::DOUBLE + 1) - lgamma(({k})::DOUBLE + 1) - lgamma((({n}) - ({k}))::DOUBLE + 1))"


@query("sta05_fisher_exact", RECORDS_SQL + TABLE_SQL + f"""
, x AS (SELECT suite, a, a + b AS r, a + c AS k, a + b + c + d AS n, unnest(generate_series(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c))) AS i FROM t),
 p AS (SELECT suite, exp({_choose_sql('k', 'i')} + {_choose_sql('n - k', 'r - i')} - {_choose_sql('n', 'r')}) AS p, exp({_choose_sql('k', 'a')} + {_choose_sql('n - k', 'r - a')} - {_choose_sql('n', 'r')}) AS seen FROM x)
SELECT suite, round(least(1, sum(p) FILTER (WHERE p <= seen * (1 + 1e-7))), 6) AS p FROM p GROUP BY 1""")
def fisher(spark: SparkSession, d: str) -> DataFrame:
    """Fisher's exact test of two models by suite."""
    t = _two_by_two(eligible(records(spark, d)).where("augment_level = 0 and direction = 'cuda-to-omp'"), "suite")
    return t.select("suite", F.round(stats.fisher(*map(F.col, "abcd")), 6).alias("p"))


@query("sta06_odds_ratio", RECORDS_SQL + TABLE_SQL + f"""
, z AS (SELECT suite, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS k, a, b, c, d FROM t), y AS (SELECT suite, ln((a + k) * (d + k) / ((b + k) * (c + k))) AS l, sqrt(1 / (a + k) + 1 / (b + k) + 1 / (c + k) + 1 / (d + k)) AS s FROM z)
SELECT suite, round(exp(l), 6) AS ratio, round(exp(l - {Z} * s), 6) AS lower, round(exp(l + {Z} * s), 6) AS upper FROM y""")
def odds(spark: SparkSession, d: str) -> DataFrame:
    """Odds ratios of two models by suite with Woolf's intervals."""
    t = _two_by_two(eligible(records(spark, d)).where("augment_level = 0 and direction = 'cuda-to-omp'"), "suite")
    ratio, low, high = stats.odds_ratio(*map(F.col, "abcd"))
    return t.select("suite", F.round(ratio, 6).alias("ratio"), F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


PAIR_SQL = """, k AS (SELECT model, suite, kernel, least(split_part(direction, '-to-', 1), split_part(direction, '-to-', 2)) || '/' || greatest(split_part(direction, '-to-', 1), split_part(direction, '-to-', 2)) AS pair,
        split_part(direction, '-to-', 1) < split_part(direction, '-to-', 2) AS first, passed FROM cell),
 m AS (SELECT a.pair, count(*) FILTER (WHERE a.passed AND NOT b.passed) AS b, count(*) FILTER (WHERE NOT a.passed AND b.passed) AS c, count(*) AS cells, avg(a.passed::INT) - avg(b.passed::INT) AS delta FROM k a JOIN k b USING (model, suite, kernel, pair) WHERE a.first AND NOT b.first GROUP BY 1)"""


@query("sta07_mcnemar", RECORDS_SQL + CELLS_SQL + PAIR_SQL + f"""
SELECT pair, b, c, CASE WHEN b + c = 0 THEN 'none' WHEN b + c < 25 THEN 'exact' ELSE 'chi2' END AS method,
 round(CASE WHEN b + c = 0 THEN 1 WHEN b + c < 25 THEN least(1, 2 * list_sum(list_transform(generate_series(0, least(b, c)), lambda i: exp({_choose_sql('b + c', 'i')} - (b + c) * ln(2)))))
   ELSE {erfc_sql('sqrt((abs(b - c) - 1) * (abs(b - c) - 1) / (2.0 * (b + c)))')} END, 5) AS p FROM m""")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """McNemar's test of every pair of directions; exact below 25 discordant pairs."""
    pairs = all_pairs(any_sample(eligible(records(spark, d))))
    m = pairs.groupBy("pair").agg(F.count_if(F.expr("forward and not backward")).alias("b"), F.count_if(F.expr("not forward and backward")).alias("c"))
    _, p, method = stats.mcnemar(F.col("b"), F.col("c"))
    return m.select("pair", "b", "c", method.alias("method"), F.round(p, 5).alias("p"))


@query("sta08_cochran_armitage", RECORDS_SQL + f"""
, g AS (SELECT direction, augment_level AS x, count(*)::DOUBLE AS n, count(*) FILTER (WHERE passed)::DOUBLE AS c FROM rec GROUP BY 1, 2),
 s AS (SELECT direction, sum(n) AS n, sum(c) AS c, sum(n * x) AS nx, sum(n * x * x) AS nxx, sum(c * x) AS cx FROM g GROUP BY 1),
 z AS (SELECT direction, (cx - c / n * nx) / sqrt(c / n * (1 - c / n) * (nxx - nx * nx / n)) AS z FROM s)
SELECT direction, round(z, 6) AS z, round({erfc_sql('abs(z) / sqrt(2)')}, 5) AS p, CASE WHEN z > 0 THEN 'increasing' WHEN z < 0 THEN 'decreasing' ELSE 'flat' END AS trend FROM z""")
def trend(spark: SparkSession, d: str) -> DataFrame:
    """Cochran-Armitage trend of pass rates over augmentation levels."""
    x = F.col("augment_level").cast("double")
    one = lambda c: F.sum(F.when(F.col("passed"), c).otherwise(0.0))
    s = eligible(records(spark, d)).groupBy("direction").agg(F.count("*").cast("double").alias("n"), one(F.lit(1.0)).alias("c"), F.sum(x).alias("nx"), F.sum(x * x).alias("nxx"), one(x).alias("cx"))
    p = F.col("c") / F.col("n")
    variance = p * (1 - p) * (F.col("nxx") - F.col("nx") * F.col("nx") / F.col("n"))
    s = s.withColumn("z", F.when(variance > 0, (F.col("cx") - p * F.col("nx")) / F.sqrt(variance)))
    way = F.when(F.col("z") > 0, "increasing").when(F.col("z") < 0, "decreasing").otherwise("flat")
    return s.select("direction", F.round("z", 6).alias("z"), F.round(F.coalesce(stats.normal_two_sided(F.col("z")), F.lit(1.0)), 5).alias("p"), way.alias("trend"))


def with_rank(values: DataFrame, group: list[str], x: str, k: str, out: str, cells: int = 256) -> DataFrame:
    """Adds ``out``, the average rank of each distinct ``x`` in its group; ``k`` is how many rows have it.

    The range of a group's values is cut into ``cells``; a small table of their counts gives every cell its first rank, so
    values are ordered within cells alone and no task orders a group.
    """
    ends = values.groupBy(*group).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    cell = F.least(F.floor((F.col(x) - F.col("_lo")) * cells / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))), F.lit(cells - 1))
    placed = values.join(ends, group).withColumn("_cell", cell).drop("_lo", "_hi")
    sizes = placed.groupBy(*group, "_cell").agg(F.sum(k).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*group, "_cell", before.alias("_first"))
    own = F.coalesce(F.sum(k).over(Window.partitionBy(*group, "_cell").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("_own", own).join(starts, [*group, "_cell"])
    return ranked.withColumn(out, F.col("_first") + F.col("_own") + (F.col(k) + 1) / 2).drop("_cell", "_own", "_first")


@query("sta09_spearman", RECORDS_SQL + """
, r AS (SELECT direction, rank() OVER (PARTITION BY direction ORDER BY prompt_tokens) + (count(*) OVER (PARTITION BY direction, prompt_tokens) - 1) / 2.0 AS x,
        rank() OVER (PARTITION BY direction ORDER BY completion_tokens) + (count(*) OVER (PARTITION BY direction, completion_tokens) - 1) / 2.0 AS y FROM rec)
SELECT direction, round(corr(x, y), 4) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's correlation of prompt and completion tokens with average ranks for ties.

    Records are counted by their pair of values once; ranks of either value come from counts of that table.
    """
    pairs = eligible(records(spark, d)).groupBy("direction", "prompt_tokens", "completion_tokens").agg(F.count("*").alias("k"))
    ranked = pairs
    for x, out in (("prompt_tokens", "x"), ("completion_tokens", "y")):
        values = pairs.groupBy("direction", x).agg(F.sum("k").alias("k"))
        ranked = ranked.join(with_rank(values, ["direction"], x, "k", out).select("direction", x, out), ["direction", x])
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    n = F.sum(k)
    sums = ranked.groupBy("direction").agg(n.alias("n"), F.sum(k * x * y).alias("xy"), F.sum(k * x * x).alias("xx"), F.sum(k * y * y).alias("yy"))
    mean = (F.col("n") + 1) / 2
    spread = lambda c: F.col(c) - F.col("n") * mean * mean
    rho = F.when((F.col("n") >= 3) & (spread("xx") > 0) & (spread("yy") > 0), spread("xy") / F.sqrt(spread("xx") * spread("yy")))
    return sums.select("direction", F.round(rho, 4).alias("rho"), "n")


@query("sta10_pearson", RECORDS_SQL + "SELECT model, round(corr(prompt_tokens, completion_tokens), 6) AS r, count(*) AS n, true AS p_in_range FROM rec GROUP BY 1")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    """Pearson's correlation of prompt and completion tokens."""
    g = eligible(records(spark, d)).groupBy("model").agg(F.corr("prompt_tokens", "completion_tokens").alias("r"), F.count("*").alias("n"))
    return g.select("model", F.round("r", 6).alias("r"), "n", stats.pearson_p(F.col("r"), F.col("n")).between(0.0, 1.0).alias("p_in_range"))


@query("sta11_12_suite_asymmetry", RECORDS_SQL + CELLS_SQL + PAIR_SQL + f"""
SELECT pair, cells, round(delta, 6) AS delta, round(0.05 / (SELECT count(*) FROM m), 6) AS alpha,
 round(least(1, (SELECT count(*) FROM m) * CASE WHEN b + c = 0 THEN 1 ELSE {erfc_sql('sqrt((abs(b - c) - 1) * (abs(b - c) - 1) / (2.0 * (b + c)))')} END), 5) AS adjusted FROM m""")
def asymmetry(spark: SparkSession, d: str) -> DataFrame:
    """Asymmetry of every pair of directions, always by the chi-squared form, adjusted for the number of tests."""
    pairs = all_pairs(any_sample(eligible(records(spark, d))))
    m = pairs.groupBy("pair").agg(
        F.count_if(F.expr("forward and not backward")).alias("b"), F.count_if(F.expr("not forward and backward")).alias("c"), F.count("*").alias("cells"),
        (F.avg(F.col("forward").cast("int")) - F.avg(F.col("backward").cast("int"))).alias("delta"),
    )
    _, p, _ = stats.mcnemar(F.col("b"), F.col("c"), exact_below=1)
    tests = F.count("*").over(Window.partitionBy())  # as many rows as pairs of directions
    return m.select("pair", "cells", F.round("delta", 6).alias("delta"), F.round(0.05 / tests, 6).alias("alpha"), F.round(stats.bonferroni(p, tests), 5).alias("adjusted"))


KERNEL_SQL = ", g AS (SELECT kernel, count(*) AS n, avg(passed::INT) AS rate FROM rec GROUP BY 1)"


@query("win01_quartile_tiers", RECORDS_SQL + KERNEL_SQL + """
, o AS (SELECT *, row_number() OVER (ORDER BY rate DESC, kernel) - 1 AS i, count(*) OVER () AS k FROM g)
SELECT kernel, round(rate, 6) AS rate, CASE WHEN i < k // 4 THEN 1 WHEN i < k // 2 THEN 2 WHEN i < 3 * k // 4 THEN 3 ELSE 4 END AS tier, i < 5 AS top, i >= k - 5 AS bottom FROM o""")
def quartiles(spark: SparkSession, d: str) -> DataFrame:
    """Kernels in quarters by rate; ranks are taken over distinct (rate, kernel) of an aggregate, by ranges of the rate."""
    g = eligible(records(spark, d)).groupBy("kernel").agg(F.avg(F.col("passed").cast("int")).alias("rate"))
    # a histogram over 256 cells of the rate gives each cell its first rank, so that no single task orders all kernels
    g = g.withColumn("cell", F.floor((1 - F.col("rate")) * 256))
    cells = g.groupBy("cell").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", before.alias("before"), F.sum("m").over(Window.partitionBy()).alias("k"))
    i = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("rate"), "kernel")) - 1
    o = g.join(cells, "cell").withColumn("i", i)
    k = F.col("k")
    tier = F.when(F.col("i") < F.floor(k / 4), 1).when(F.col("i") < F.floor(k / 2), 2).when(F.col("i") < F.floor(3 * k / 4), 3).otherwise(4)
    return o.select("kernel", F.round("rate", 6).alias("rate"), tier.alias("tier"), (F.col("i") < 5).alias("top"), (F.col("i") >= k - 5).alias("bottom"))


@query("win02_examples_per_category", RECORDS_SQL + "SELECT overall_status, record_id FROM (SELECT overall_status, record_id, row_number() OVER (PARTITION BY overall_status ORDER BY record_id) AS r FROM rec WHERE NOT passed) WHERE r <= 3")
def examples(spark: SparkSession, d: str) -> DataFrame:
    """The first three records of every failure category; a rank limit that Spark applies before the shuffle too."""
    r = F.row_number().over(Window.partitionBy("overall_status").orderBy("record_id"))
    return eligible(records(spark, d)).where("not passed").select("overall_status", "record_id", r.alias("r")).where("r <= 3").drop("r")


@query("win03_adjacent_levels", RECORDS_SQL + """
, g AS (SELECT direction, augment_level, avg(passed::INT) AS rate FROM rec GROUP BY 1, 2), l AS (SELECT *, lag(rate) OVER (PARTITION BY direction ORDER BY augment_level) AS before FROM g)
SELECT direction, augment_level, round(2 * asin(sqrt(rate)) - 2 * asin(sqrt(before)), 6) AS h FROM l WHERE before IS NOT NULL""")
def adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Effect size from each observed level to the next."""
    g = eligible(records(spark, d)).groupBy("direction", "augment_level").agg(F.avg(F.col("passed").cast("int")).alias("rate"))
    g = g.withColumn("before", F.lag("rate").over(Window.partitionBy("direction").orderBy("augment_level"))).where("before is not null")
    return g.select("direction", "augment_level", F.round(stats.cohens_h(F.col("rate"), F.col("before")), 6).alias("h"))


@query("win04_consecutive_failures", RECORDS_SQL + """
, s AS (SELECT model, kernel, record_id, passed, sum(passed::INT) OVER (PARTITION BY model, kernel ORDER BY record_id) AS run FROM rec), r AS (SELECT *, count(*) FILTER (WHERE NOT passed) OVER (PARTITION BY model, kernel, run ORDER BY record_id) AS failures FROM s)
SELECT model, kernel, min(record_id) AS stopped_at FROM r WHERE failures >= 3 GROUP BY 1, 2""")
def consecutive(spark: SparkSession, d: str) -> DataFrame:
    """Where a sweep over a unit would stop after three failures in a row."""
    w = Window.partitionBy("model", "kernel").orderBy("record_id")
    s = eligible(records(spark, d)).select("model", "kernel", "record_id", "passed", F.sum(F.col("passed").cast("int")).over(w).alias("run"))
    failures = F.count_if(~F.col("passed")).over(Window.partitionBy("model", "kernel", "run").orderBy("record_id"))
    return s.withColumn("failures", failures).where("failures >= 3").groupBy("model", "kernel").agg(F.min("record_id").alias("stopped_at"))


@query("win05_level_patterns", RECORDS_SQL + """
, f AS (SELECT model, suite, kernel, direction, augment_level AS l, overall_status AS s, count(*) AS k, min(record_id) AS first FROM rec GROUP BY ALL),
 w AS (SELECT *, row_number() OVER (PARTITION BY model, suite, kernel, direction, l ORDER BY s = 'PASS' DESC, k DESC, first) AS r FROM f),
 g AS (SELECT model, suite, kernel, direction, coalesce(max(s) FILTER (WHERE l = 0), 'UNKNOWN') AS a, coalesce(max(s) FILTER (WHERE l = 1), 'UNKNOWN') AS b, coalesce(max(s) FILTER (WHERE l = 2), 'UNKNOWN') AS c,
   coalesce(max(s) FILTER (WHERE l = 3), 'UNKNOWN') AS d, coalesce(max(s) FILTER (WHERE l = 4), 'UNKNOWN') AS e FROM w WHERE r = 1 GROUP BY 1, 2, 3, 4)
SELECT CASE WHEN a = 'PASS' AND b = 'PASS' AND c = 'PASS' AND d = 'PASS' AND e = 'PASS' THEN 'stable_pass' WHEN a = 'PASS' THEN 'degradation' WHEN 'PASS' IN (b, c, d, e) THEN 'improvement'
 WHEN a = b AND b = c AND c = d AND d = e THEN 'stable_fail' ELSE 'other' END AS pattern, count(*) AS n FROM g GROUP BY 1""")
def level_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by how their collapsed status goes from level 0 to level 4; a missing level is UNKNOWN, which is no pass."""
    key = ["model", "suite", "kernel", "direction"]
    by = eligible(records(spark, d)).groupBy(*key, "augment_level", "overall_status").agg(F.count("*").alias("k"), F.min("record_id").alias("first"))
    rank = F.struct((F.col("overall_status") == "PASS").cast("int"), "k", -F.col("first"))
    level = [F.coalesce(F.max_by(F.when(F.col("augment_level") == n, F.col("overall_status")), F.when(F.col("augment_level") == n, rank)), F.lit("UNKNOWN")) for n in range(5)]
    v = F.col("v")
    good = lambda x: x == "PASS"
    kind = (
        F.when(F.forall(v, good), "stable_pass").when(good(v[0]), "degradation").when(F.exists(v, good), "improvement")
        .when(F.size(F.array_distinct(v)) == 1, "stable_fail").otherwise("other")
    )
    return by.groupBy(*key).agg(F.array(*level).alias("v")).groupBy(kind.alias("pattern")).agg(F.count("*").alias("n"))


@query("win06_07_last_wins", RECORDS_SQL + "SELECT kernel, model, arg_max(overall_status, record_id) AS status, max(record_id) AS record_id FROM rec GROUP BY 1, 2")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last loaded record of each matrix cell; an aggregate, where a window would sort."""
    return eligible(records(spark, d)).groupBy("kernel", "model").agg(F.max_by("overall_status", "record_id").alias("status"), F.max("record_id").alias("record_id"))


@query("top01_top_n", RECORDS_SQL + "SELECT kernel, count(*) AS n FROM rec WHERE passed GROUP BY 1 ORDER BY n DESC, kernel LIMIT 10")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    """Ten kernels with most passes; names break ties."""
    return eligible(records(spark, d)).where("passed").groupBy("kernel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kernel").limit(10)


@query("top02_top_3_first_seen", RECORDS_SQL + "SELECT kernel, count(*) AS n FROM rec WHERE overall_status = 'BUILD_FAIL' GROUP BY 1 ORDER BY n DESC, min(record_id) LIMIT 3")
def top_3(spark: SparkSession, d: str) -> DataFrame:
    """Three kernels with most build failures; the first seen wins a tie."""
    g = eligible(records(spark, d)).where("overall_status = 'BUILD_FAIL'").groupBy("kernel").agg(F.count("*").alias("n"), F.min("record_id").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(3).select("kernel", "n")


@query("top03_extremes", RECORDS_SQL + """
, g AS (SELECT model, direction, count(*) AS n, avg(passed::INT) AS rate FROM rec GROUP BY 1, 2 HAVING count(*) >= 10), f AS (SELECT model, overall_status, count(*) AS k FROM rec WHERE NOT passed GROUP BY 1, 2)
SELECT model, (SELECT direction FROM g x WHERE x.model = g.model ORDER BY rate DESC, direction DESC LIMIT 1) AS easiest, (SELECT direction FROM g x WHERE x.model = g.model ORDER BY rate, direction LIMIT 1) AS hardest,
 (SELECT overall_status FROM f WHERE f.model = g.model ORDER BY k DESC, overall_status DESC LIMIT 1) AS dominant FROM g GROUP BY 1""")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    """Easiest and hardest direction and commonest failure of each model."""
    rec = eligible(records(spark, d))
    g = rec.groupBy("model", "direction").agg(*counts()).where("n >= 10").withColumn("rate", F.col("c") / F.col("n"))
    ends = g.groupBy("model").agg(F.max_by("direction", F.struct("rate", "direction")).alias("easiest"), F.min_by("direction", F.struct("rate", "direction")).alias("hardest"))
    f = rec.where("not passed").groupBy("model", "overall_status").agg(F.count("*").alias("k")).groupBy("model").agg(F.max_by("overall_status", F.struct("k", "overall_status")).alias("dominant"))
    return ends.join(f, "model")


@query("top04_05_matrix_order", RECORDS_SQL + """
, k AS (SELECT kernel, count(*) FILTER (WHERE passed) AS c FROM rec GROUP BY 1 ORDER BY c DESC, kernel LIMIT 20), m AS (SELECT model, avg(passed::INT) AS r FROM rec GROUP BY 1)
SELECT kernel, model, count(*) FILTER (WHERE passed) AS passes FROM rec JOIN k USING (kernel) JOIN m USING (model) GROUP BY kernel, model""")
def matrix_order(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of the twenty kernels with most passes, ordered by passes and names, models by rate."""
    rec = eligible(records(spark, d))
    cell = rec.groupBy("kernel", "model").agg(*counts())
    top = cell.groupBy("kernel").agg(F.sum("c").alias("total")).orderBy(F.desc("total"), "kernel").limit(20)
    rates = cell.groupBy("model").agg((F.sum("c") / F.sum("n")).alias("rate"))
    m = cell.join(F.broadcast(top), "kernel").join(rates, "model")
    return m.orderBy(F.desc("total"), "kernel", F.desc("rate"), "model").select("kernel", "model", F.col("c").alias("passes"))


BUDGET_SQL = """
, o AS (SELECT model || '/' || kernel AS trajectory, record_id AS request, prompt_tokens + 8 AS estimate, prompt_tokens + CASE WHEN record_id % 11 = 0 THEN 9 ELSE 0 END AS prompt, completion_tokens AS completion,
   row_number() OVER (PARTITION BY model, kernel ORDER BY record_id) AS i FROM rec),
 s(trajectory, i, request, decision, cap, used, started) AS (
  SELECT DISTINCT trajectory, 0::BIGINT, NULL::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o
  UNION ALL
  SELECT trajectory, i, request, decision, cap, CASE WHEN decision = 'granted' THEN used + prompt + completion ELSE used END, CASE WHEN decision IN ('granted', 'violation') THEN started + 1 ELSE started END
  FROM (SELECT *, CASE WHEN cap < 2000 OR estimate + cap > left_ THEN 'budget' WHEN started >= 6 THEN 'attempts' WHEN prompt > estimate OR prompt + completion > estimate + cap THEN 'violation' ELSE 'granted' END AS decision
   FROM (SELECT o.trajectory, o.i, o.request, o.estimate, o.prompt, o.completion, s.used, s.started, greatest(0, 100000 - s.used) AS left_, greatest(0, least(30000, greatest(0, 100000 - s.used) - o.estimate)) AS cap
    FROM s JOIN o ON o.trajectory = s.trajectory AND o.i = s.i + 1)))
"""
PROTOCOL = Protocol(budget=100_000, response_limit=30_000, least_response=2_000, attempts=6)


def requests(df: DataFrame) -> DataFrame:
    """Records as requests of trajectories; every eleventh uses more of a prompt than it estimated."""
    over = F.when(F.col("record_id") % 11 == 0, 9).otherwise(0)
    return df.select(F.concat_ws("/", "model", "kernel").alias("trajectory"), F.col("record_id").alias("request"), (F.col("prompt_tokens") + 8).alias("estimate"), (F.col("prompt_tokens") + over).alias("prompt"), F.col("completion_tokens").alias("completion"))


@query("stm02_token_budget", RECORDS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + BUDGET_SQL + "SELECT trajectory, request, decision, cap, used FROM s WHERE i > 0")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a trajectory in turn (the batch form): reserved, then charged; refused ones cost nothing. The SQL is a recursion over requests."""
    return budgeted(requests(eligible(records(spark, d))), PROTOCOL)
