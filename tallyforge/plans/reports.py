"""Data behind reports, archives and campaigns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import stats, transforms
from tallyforge.operators import taxonomy as X
from tallyforge.operators import verify as V
from tallyforge.plans.aggregates import counts, pass_at_k_sql
from tallyforge.plans.projections import attempt_status, attempts
from tallyforge.plans.registry import query
from tallyforge.plans.texts import _BUILD_SQL, snippets, translated
from tallyforge.sources import files as S
from tallyforge.sources.records import RECORDS_SQL, eligible, records, table


def points(df: DataFrame, figure: str, series: Column, x: Column, y: Column) -> DataFrame:
    """Rows of a figure: what is drawn, as (figure, series, x, y)."""
    return df.select(F.lit(figure).alias("figure"), series.cast("string").alias("series"), x.cast("string").alias("x"), F.round(y.cast("double"), 6).alias("y"))


@query("snk05_figure_data", RECORDS_SQL + _BUILD_SQL + f"""
, pk AS (SELECT model, kernel, direction, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec WHERE augment_level = 0 GROUP BY 1, 2, 3),
 two AS (SELECT *, CASE WHEN record_id % 3 = 0 THEN 'PASS' ELSE overall_status END AS final FROM rec WHERE NOT passed AND record_id % 3 = 0)
SELECT 'F2' AS figure, 'repositories' AS series, suite AS x, count(DISTINCT direction)::DOUBLE AS y FROM rec GROUP BY suite UNION ALL SELECT 'F2', 'kernels', suite, count(DISTINCT kernel) FROM rec GROUP BY suite
UNION ALL SELECT 'F3', model, kernel, round(avg(passed::INT), 6) FROM rec GROUP BY model, kernel
UNION ALL SELECT 'F4', model, category, count(*) FROM c GROUP BY model, category
UNION ALL SELECT 'F5', model, '1', round(avg({pass_at_k_sql(1, 'NULL')}), 6) FROM pk GROUP BY model UNION ALL SELECT 'F5', model, '3', round(avg({pass_at_k_sql(3, 'CASE WHEN c > 0 THEN 1 ELSE 0 END')}), 6) FROM pk GROUP BY model
UNION ALL SELECT 'F6', model, suite, round(avg(passed::INT), 6) FROM rec GROUP BY model, suite
UNION ALL SELECT 'F7', direction, augment_level::VARCHAR, round(avg(passed::INT), 6) FROM rec GROUP BY direction, augment_level
UNION ALL SELECT 'C1', overall_status, final, count(*) FROM two GROUP BY overall_status, final
UNION ALL SELECT 'C2', 'repaired', direction, round(avg((final = 'PASS')::INT), 6) FROM two GROUP BY direction
UNION ALL SELECT 'C4', 'stages', '1 all', count(*) FROM allrec UNION ALL SELECT 'C4', 'stages', '2 eligible', count(*) FROM rec UNION ALL SELECT 'C4', 'stages', '3 canonical', count(*) FROM rec WHERE augment_level = 0 UNION ALL SELECT 'C4', 'stages', '4 passing', count(*) FROM rec WHERE augment_level = 0 AND passed""")
def figure_data(spark: SparkSession, d: str) -> DataFrame:
    """What F2 to F7, C1, C2 and C4 draw, in one long table; C3 is ``snk05_transform_frequency``."""
    every = records(spark, d)
    rec = eligible(every)
    c, rate = F.col, F.col("c") / F.col("n")
    cell = rec.groupBy("model", "suite", "kernel", "direction", "augment_level").agg(*counts())  # every figure is of these cells
    by = lambda *keys: cell.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    suites = cell.groupBy("suite").agg(F.count_distinct("direction").alias("repositories"), F.count_distinct("kernel").alias("kernels"))
    out = [points(suites, "F2", F.lit(k), c("suite"), c(k)) for k in ("repositories", "kernels")]
    out += [points(by(a, b), name, c(a), c(b), rate) for name, a, b in (("F3", "model", "kernel"), ("F6", "model", "suite"), ("F7", "direction", "augment_level"))]
    failures = rec.where("overall_status = 'BUILD_FAIL'").select("model", X.primary(X.build_rules(snippets(), c("direction"), translated()), "other_build").alias("category"))
    out.append(points(failures.groupBy("model", "category").agg(F.count("*").alias("n")), "F4", c("model"), c("category"), c("n")))
    tasks = cell.where("augment_level = 0").groupBy("model", "kernel", "direction").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    chance = tasks.groupBy("model").agg(*[F.avg(stats.pass_at_k(c("n"), c("c"), k, "clip")).alias(str(k)) for k in (1, 3)])
    out += [points(chance, "F5", c("model"), F.lit(k), c(k)) for k in ("1", "3")]
    several = rec.select("direction", attempts().alias("a")).where(F.size("a") > 1).select("direction", attempt_status(c("a")[0]).alias("initial"), attempt_status(F.element_at("a", -1)).alias("final"))
    moved = several.where("initial <> 'PASS'").groupBy("direction", "initial", "final").agg(F.count("*").alias("n"))
    out.append(points(moved.groupBy("initial", "final").agg(F.sum("n").alias("n")), "C1", c("initial"), c("final"), c("n")))
    repaired = moved.groupBy("direction").agg((F.sum(F.when(c("final") == "PASS", c("n")).otherwise(0)) / F.sum("n")).alias("rate"))
    out.append(points(repaired, "C2", F.lit("repaired"), c("direction"), c("rate")))
    canonical = by("augment_level").where("augment_level = 0")
    stages = {"1 all": every.agg(F.count("*").alias("y")), "2 eligible": cell.agg(F.sum("n").alias("y")), "3 canonical": canonical.select(c("n").alias("y")), "4 passing": canonical.select(c("c").alias("y"))}
    out += [points(df, "C4", F.lit("stages"), F.lit(name), c("y")) for name, df in stages.items()]
    return reduce(DataFrame.unionByName, out)


@query("snk05_transform_frequency", "SELECT p_brand AS kernel, name AS transform, count(*) AS n FROM part, (VALUES ('ArithmeticTransform'), ('ChangeNames'), ('PointerArithmeticToArrayIndex'), ('SwapCondition')) t(name) WHERE p_size % 5 = 4 GROUP BY 1, 2")
def transform_frequency(spark: SparkSession, d: str) -> DataFrame:
    """C3: how often each transform was applied at level 4, by kernel; the program has nothing for two of the six."""
    code = F.concat(F.lit("int main(void) {\n  int i = 0; int a[9];\n  while (i < "), "p_size", F.lit(") { i += 2; *(a + i) = i; }\n}\n"))
    x = table(spark, d, "part").where("p_size % 5 = 4").select(F.col("p_brand").alias("kernel"), transforms.transform_code(code, F.lit(4), F.col("p_partkey").cast("string")).alias("t"))
    return x.select("kernel", F.explode("t.transforms").alias("transform")).groupBy("kernel", "transform").agg(F.count("*").alias("n"))


def archive_findings(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """SNK-07: (member, finding) where a stored manifest (member, sha256) and the files there differ; none: the archive holds."""
    j = recorded.select("member", F.col("sha256").alias("a")).join(present.select("member", F.col("sha256").alias("b")), "member", "full")
    finding = F.when(F.col("b").isNull(), "missing from archive").when(F.col("a").isNull(), "unexpected in archive").when(F.col("a") != F.col("b"), "hash mismatch")
    return j.select("member", finding.alias("finding")).where("finding is not null")


@query("snk07_archive_check", """
SELECT 'n=' || page_id AS member, CASE WHEN page_id % 7 = 0 THEN 'missing from archive' WHEN page_id % 7 = 1 THEN 'hash mismatch' END AS finding FROM pages WHERE page_id % 7 IN (0, 1) AND page_id < 40 UNION ALL SELECT 'n=extra', 'unexpected in archive'""")
def archive_check(spark: SparkSession, d: str) -> DataFrame:
    """An archive of forty files written, changed and held against its manifest: files are hashed from disk, whole."""
    path = S.workspace(spark, "archive")
    pages = table(spark, d, "pages").where("page_id < 40").select(F.concat(F.lit("n="), "page_id").alias("member"), "page_id", F.concat(F.lit("page "), "url", F.lit("\n")).alias("body"))
    pages.select("member", F.sha2("body", 256).alias("sha256")).write.parquet(f"{path}/manifest")
    changed = F.when(F.col("page_id") % 7 == 1, F.concat(F.lit("x"), "body")).otherwise(F.col("body"))
    kept = pages.where("page_id % 7 <> 0").select(F.expr("substring(member, 3)").alias("n"), changed.alias("body"))
    kept = kept.unionByName(spark.createDataFrame([("extra", "new\n")], "n string, body string"))
    kept.select("n", F.regexp_replace("body", r"\n$", "").alias("value")).repartition("n").write.partitionBy("n").text(f"{path}/files")  # the writer ends the line
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{path}/files")
    present = there.select(F.regexp_extract("path", r"(n=[^/]+)/", 1).alias("member"), F.sha2("content", 256).alias("sha256"))
    return archive_findings(spark.read.schema("member string, sha256 string").parquet(f"{path}/manifest"), present)


# What tells a language's features, in order of tiers, and where sources are looked for.
TIERS = {
    "cuda": {"cuda_basic": ["__global__", "__shared__", "__device__"], "cuda_library": ["thrust::", "cub::"], "cuda_9plus": ["cooperative_groups"]},
    "omp": {"omp_basic": [r"#pragma\s+omp\s+parallel\s+for", r"#pragma\s+omp\s+parallel"], "omp_4.5": [r"#pragma\s+omp\s+simd", r"#pragma\s+omp\s+taskloop"], "omp_target": [r"#pragma\s+omp\s+target"]},
    "opencl": {"opencl_1x": ["clEnqueueNDRangeKernel", "clCreateBuffer"], "opencl_2x": ["clSVMAlloc", r"pipe\s+"]},
}
EXTENSIONS = ("cu", "c", "cpp", "h", "hpp", "cl")
GENERATED = ("build", "CMakeFiles")


def language_features(spark: SparkSession, root: str) -> DataFrame:
    """SRC-18: (unit, api, tier, patterns) of the sources under ``root``/unit: the highest tier of each API, and all its patterns found."""
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(EXTENSIONS)}}}").load(root)
    inside = F.split(F.substring_index("_metadata.file_path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/", -1), "/")
    rows = read.select(F.get(inside, F.lit(0)).alias("unit"), F.slice(inside, 2, F.greatest(F.size(inside) - 1, F.lit(0))).alias("parts"), "value").where(~F.arrays_overlap("parts", F.array(*map(F.lit, GENERATED))))
    listed = [(api, i, tier, p) for api, tiers in TIERS.items() for i, (tier, patterns) in enumerate(tiers.items()) for p in patterns]
    hits = F.array_compact(F.array(*[F.when(F.col("value").rlike(p), F.struct(F.lit(api).alias("api"), F.lit(i).alias("rank"), F.lit(tier).alias("tier"), F.lit(p).alias("pattern"))) for api, i, tier, p in listed]))
    found = rows.select("unit", F.inline(hits)).distinct()
    return found.groupBy("unit", "api").agg(F.max_by("tier", "rank").alias("tier"), F.array_join(F.array_sort(F.collect_set("pattern")), " ").alias("patterns"))  # at most all patterns


@query("src18_source_scan", r"""
SELECT 'u' || k AS unit, api, tier, patterns FROM (SELECT DISTINCT p_size % 6 AS k FROM part) p JOIN (VALUES (0, 'cuda', 'cuda_basic', '__global__'), (1, 'cuda', 'cuda_library', '__device__ thrust::'), (1, 'omp', 'omp_target', '#pragma\s+omp\s+parallel #pragma\s+omp\s+target'),
 (2, 'omp', 'omp_basic', '#pragma\s+omp\s+parallel #pragma\s+omp\s+parallel\s+for'), (3, 'opencl', 'opencl_2x', 'clCreateBuffer pipe\s+'), (5, 'cuda', 'cuda_9plus', '__shared__ cooperative_groups')) t(k, api, tier, patterns) USING (k)""")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sources of several units by extension, without generated build trees, to the highest tier of each API."""
    path = S.workspace(spark, "sources")
    units = {0: {"a.cu": "__global__ void f();"}, 1: {"a/b.cpp": "thrust::sort(x);", "h.hpp": "__device__ int g;\n#pragma  omp parallel\n#pragma omp target"}, 2: {"a.c": "#pragma omp parallel for", "build/b.c": "#pragma omp target", "n.txt": "clSVMAlloc"},
             3: {"k.cl": "pipe int p;", "h.h": "clCreateBuffer("}, 4: {"CMakeFiles/x.c": "__global__", "a.c": "int main;"}, 5: {"a.cu": "__shared__ int s;\ncooperative_groups::x"}}
    there = [r.k for r in table(spark, d, "part").select((F.col("p_size") % 6).alias("k")).distinct().collect()]  # six at most
    jvm = spark._jvm
    for k in there:
        for name, text in units[k].items():
            place = jvm.org.apache.hadoop.fs.Path(f"{path}/tree/u{k}/{name}")
            out = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(place)
            out.write(bytearray(text, "utf-8"))
            out.close()
    return language_features(spark, f"{path}/tree")


def stage_status(exit_code: Column, timed_out: Column, executable: Column | None = None) -> Column:
    """EXE-01, EXE-02: what a build or run came to: a timeout, an error if it has no exit code, else by that; a build has to leave its executable."""
    good = (exit_code == 0) & (F.coalesce(executable, F.lit(False)) if executable is not None else F.lit(True))
    return F.when(timed_out, "TIMEOUT").when(exit_code.isNull(), "ERROR").when(good, "PASS").otherwise("FAIL")


def result_line(unit: Column, build: Column, build_s: Column, runs: Column, verify: Column, strategy: Column, metrics: Column) -> Column:
    """EXE-06: one line for a unit; ``runs`` (name, status, seconds) and ``metrics`` (name, value, unit) are arrays, empty or null if there are none."""
    each = F.transform(runs, lambda r: F.concat(F.lit("RUN("), r["name"], F.lit("): "), F.upper(r["status"]), F.lit(" ("), r["seconds"].cast("string"), F.lit("s)")))
    ran = F.when(F.coalesce(F.size(runs) > 0, F.lit(False)), F.array_join(each, " | ")).otherwise("RUN: —")
    verdict = F.when(verify.isNotNull(), F.concat(F.lit("VERIFY: "), F.upper(verify), F.lit(" ("), strategy, F.lit(")"))).otherwise("VERIFY: —")
    measured = F.when(F.coalesce(F.size(metrics) > 0, F.lit(False)), F.concat(F.lit("METRICS: "), F.array_join(F.transform(metrics, lambda m: F.concat(m["name"], F.lit("="), m["value"].cast("string"), m["unit"])), ", ")))
    return F.concat_ws(" | ", F.concat(F.lit("["), unit, F.lit("]")), F.concat(F.lit("BUILD: "), F.upper(build), F.lit(" ("), build_s.cast("string"), F.lit("s)")), ran, verdict, measured)


@query("exe01_02_06_result_lines", """
SELECT p_partkey, CASE WHEN k = 0 THEN '[u' || p_partkey || '] | BUILD: TIMEOUT (1.5s) | RUN: — | VERIFY: —' WHEN k = 1 THEN '[u' || p_partkey || '] | BUILD: FAIL (1.5s) | RUN: — | VERIFY: —'
 ELSE '[u' || p_partkey || '] | BUILD: PASS (1.5s) | RUN(small): ' || CASE k WHEN 2 THEN 'ERROR' WHEN 3 THEN 'FAIL' ELSE 'PASS' END || ' (0.25s)' || CASE WHEN k = 4 THEN ' | VERIFY: PASS (exit_code) | METRICS: size=' || p_size || '.0MB' ELSE ' | VERIFY: —' END END AS line
FROM (SELECT *, p_size % 5 AS k FROM part)""")
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of builds and runs by exit code, timeout and executable, as one line a unit."""
    k = F.col("p_size") % 5
    build = stage_status(F.when(k == 0, -9).otherwise(0), k == 0, k != 1)
    ran = F.array(F.struct(F.lit("small").alias("name"), stage_status(F.when(k == 3, 1).when(k != 2, 0), F.lit(False)).alias("status"), F.lit(0.25).alias("seconds")))
    metric = F.array(F.struct(F.lit("size").alias("name"), F.col("p_size").cast("double").alias("value"), F.lit("MB").alias("unit")))
    line = result_line(F.concat(F.lit("u"), "p_partkey"), build, F.lit(1.5), F.when(build == "PASS", ran), F.when(k == 4, "pass"), F.lit("exit_code"), F.when(k == 4, metric))
    return table(spark, d, "part").select("p_partkey", line.alias("line"))


@query("stm04_stored_reverification", """
SELECT record, CASE WHEN k = 0 THEN 'PASS' WHEN k = 3 THEN 'ERROR' ELSE 'FAIL' END AS now, stored, CASE WHEN k = 0 THEN 'PASS' WHEN k = 3 THEN 'ERROR' ELSE 'FAIL' END <> stored AS changed
FROM (SELECT p_partkey AS record, p_size % 4 AS k, CASE WHEN p_size % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS stored FROM part)""")
def reverification(spark: SparkSession, d: str) -> DataFrame:
    """Stored outputs judged again by today's strategies, beside what was stored; executing them again is no query."""
    kind = f"array<struct<{V.STRATEGY.replace(' string', ':string').replace(' boolean', ':boolean')}>>"
    k = F.col("p_size") % 4
    pattern = F.when(k == 3, "(").otherwise("total [0-9]+ ok")
    strategies = F.from_json(F.concat(F.lit('[{"type":"exit_code","expected":"0"},{"type":"stdout_pattern","pattern":"'), pattern, F.lit('"}]')), kind)
    out = F.concat(F.lit("total "), "p_size", F.when(k == 1, " bad").otherwise(" ok"))
    runs = table(spark, d, "part").select(F.col("p_partkey").alias("record"), F.when(k == 2, 1).otherwise(0).alias("exit_code"), out.alias("stdout"), F.create_map().cast("map<string,string>").alias("files"), strategies.alias("strategies"))
    stored = table(spark, d, "part").select(F.col("p_partkey").alias("record"), F.when(F.col("p_size") % 3 == 0, "FAIL").otherwise("PASS").alias("stored"))
    j = V.verify(runs, "record").join(stored, "record")
    return j.select("record", F.col("status").alias("now"), "stored", (F.col("status") != F.col("stored")).alias("changed"))


class StepFailed(RuntimeError):
    """A step of a chain did not come to its end; the log tells how far it came."""

    def __init__(self, log: list[dict]) -> None:
        super().__init__(f"step {log[-1]['label']} failed: {log[-1]['error']}")
        self.log = log


def chain(steps: list[tuple[str, Callable[[], DataFrame]]]) -> list[dict]:
    """STM-05: runs steps in turn; each is a query whose rows are written or counted. The first that fails ends the chain."""
    log: list[dict] = []
    for label, step in steps:
        try:
            log.append({"label": label, "rows": step().count(), "error": ""})
        except Exception as e:
            log.append({"label": label, "rows": None, "error": type(e).__name__})
            raise StepFailed(log) from e
    return log


@query("stm05_chain", "SELECT * FROM (VALUES ('good', 1, 'records', (SELECT count(*) FROM events), ''), ('good', 2, 'parts', (SELECT count(*) FROM part), ''), ('bad', 1, 'parts', (SELECT count(*) FROM part), ''), ('bad', 2, 'fails', NULL, 'failed')) t(chain, step, label, rows, error)")
def chained(spark: SparkSession, d: str) -> DataFrame:
    """A chain that comes to its end, and one whose second step fails, so that its third never runs."""
    parts, wrong = (lambda: table(spark, d, "part")), (lambda: table(spark, d, "part").select(F.raise_error(F.lit("stop")).cast("int").alias("x")).where("x = 1"))
    rows = []
    for name, steps in (("good", [("records", lambda: records(spark, d)), ("parts", parts)]), ("bad", [("parts", parts), ("fails", wrong), ("parts", parts)])):
        try:
            log = chain(steps)
        except StepFailed as e:
            log = e.log
        rows += [(name, i, x["label"], x["rows"], "failed" if x["error"] else "") for i, x in enumerate(log, 1)]
    return spark.createDataFrame(rows, "chain string, step int, label string, rows long, error string")
