"""Scans, sinks, streams and transforms (SURVEY SRC, SNK, STM, UDF): each writes files from a table and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import transforms
from tallyforge.functions.stats import wilson
from tallyforge.plans.aggregates import counts, wilson_sql
from tallyforge.plans.registry import query
from tallyforge.plans.statistics import BUDGET_SQL, PROTOCOL, requests
from tallyforge.sources import files as S
from tallyforge.sources.records import RECORDS_SQL, eligible, records, table
from tallyforge.streaming import campaign


def _manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("k"), "p_partkey").alias("kernel_name"), F.element_at(F.array(F.lit("cuda"), F.lit("omp"), F.lit("opencl")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("parallel_api"), F.col("p_brand").alias("source_suite"), F.concat(F.lit("s"), F.col("p_partkey") % 10, F.lit(".json")).alias("spec_file"), F.lit("src").alias("source_dir"), F.col("p_type").alias("category"))


_MANIFEST_SQL = "SELECT 'k' || p_partkey AS kernel_name, ['cuda','omp','opencl'][(p_partkey % 3 + 1)::INT] AS parallel_api, p_brand AS source_suite, 's' || (p_partkey % 10) || '.json' AS spec_file, 'src' AS source_dir, p_type AS category FROM part"


@query("src01_manifest_strict", _MANIFEST_SQL)
def manifest_strict(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines read back with a fixed schema; a malformed line would stop the read."""
    path = S.workspace(spark, "manifest")
    _manifest_rows(spark, d).write.json(path)
    return S.manifest(spark, path)


@query("src02_manifest_lenient", _MANIFEST_SQL + " WHERE p_partkey % 10 < 4")
def manifest_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Malformed lines dropped; of the others those whose specification is on disk."""
    path = S.workspace(spark, "manifest")
    good = _manifest_rows(spark, d).select(F.to_json(F.struct("*")).alias("value"))
    good.unionAll(spark.createDataFrame([("{broken",), ('{"kernel_name": ',)], "value string")).write.text(f"{path}/lines")
    spark.range(4).select(F.concat(F.lit("s"), "id", F.lit(".json")).alias("name"), F.lit("{}").alias("value")).write.partitionBy("name").text(f"{path}/specs")
    return S.existing(S.manifest(spark, f"{path}/lines", strict=False), f"{path}/specs")


def _documents_as_files(df: DataFrame, path: str) -> None:
    """One file for each row of (name, value): files are named by their folder."""
    df.repartition("name").write.partitionBy("name").text(path)


@query("src03_04_spec_index", """
SELECT 'spec' || k AS file, CASE WHEN k IN (3, 4) THEN NULL ELSE 'u' || (k % 8) END AS unique_id, CASE WHEN k = 3 THEN 'malformed' WHEN k = 4 THEN 'missing id' WHEN k >= 8 THEN 'duplicate id' END AS problem FROM range(10) t(k)""")
def spec_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several lines: malformed ones, such without id, repeated ids."""
    path = S.workspace(spark, "specs")
    body = F.when(F.col("id") == 3, "{\n broken").when(F.col("id") == 4, '{\n "identity": {}\n}').otherwise(F.concat(F.lit('{\n "identity": {"unique_id": "u'), F.col("id") % 8, F.lit('"}\n}')))
    _documents_as_files(spark.range(10).select(F.concat(F.lit("spec"), "id").alias("name"), body.alias("value")), path)
    return S.spec_index(spark, path)


def _write_results(spark: SparkSession, d: str, path: str) -> None:
    """Verdicts by model, without what the reader has to fill in from paths and ids."""
    r = records(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    rows = r.select(
        F.col("model").alias("folder"), none("string").alias("model"), "source_spec", "target_spec", none("string").alias("kernel"), none("string").alias("direction"), "augment_level", "sample_id", "overall_status",
        none("double").alias("temperature"), F.when(F.col("record_id") % 2 == 0, F.col("prompt_tokens")).alias("prompt_tokens"), "completion_tokens", F.struct(F.when(F.col("record_id") % 2 == 0, F.col("model")).alias("model"), "overall_status").alias("parent"),
    )
    for m in ("m0", "m1", "m2"):  # one folder for each model, as campaigns leave them
        rows.where(F.col("folder") == m).drop("folder").write.json(f"{path}/{m}")


@query("src05_09_result_scan", RECORDS_SQL + "SELECT model, kernel, direction, augment_level, overall_status, count(*) AS n, 0.0::DOUBLE AS temperature FROM rec GROUP BY 1, 2, 3, 4, 5")
def result_scan(spark: SparkSession, d: str) -> DataFrame:
    """Verdict files of all models, identity filled in from parents, folders and ids, without excluded specifications."""
    path = S.workspace(spark, "results")
    _write_results(spark, d, path)
    return eligible(S.results(spark, path, strict=True)).groupBy("model", "kernel", "direction", "augment_level", "overall_status").agg(F.count("*").alias("n"), F.max("temperature").alias("temperature"))


@query("src06_07_single_model_scan", RECORDS_SQL + "SELECT 'eligible' AS population, count(*) AS n FROM rec WHERE model = 'm1' UNION ALL SELECT 'all', count(*) FROM allrec WHERE model = 'm1'")
def single_model(spark: SparkSession, d: str) -> DataFrame:
    """One model's folder, with and without excluded specifications."""
    path = S.workspace(spark, "results")
    _write_results(spark, d, path)
    rows = S.results(spark, f"{path}/m1", recursive=False)
    return eligible(rows).agg(F.lit("eligible").alias("population"), F.count("*").alias("n")).unionByName(rows.agg(F.lit("all").alias("population"), F.count("*").alias("n")))


@query("src08_token_scan", RECORDS_SQL + "SELECT model, CAST(sum(prompt_tokens) FILTER (WHERE record_id % 2 = 0) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion FROM rec GROUP BY 1")
def token_scan(spark: SparkSession, d: str) -> DataFrame:
    """Token sums of records that have a status."""
    path = S.workspace(spark, "results")
    _write_results(spark, d, path)
    return eligible(S.results(spark, path)).where("overall_status is not null").groupBy("model").agg(F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))


@query("src10_file_classes", RECORDS_SQL + "SELECT CASE WHEN record_id % 3 = 0 THEN 'samples' WHEN augment_level > 0 THEN 'augmented' ELSE 'base' END AS class, count(*) AS n FROM rec GROUP BY 1")
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    """Records by the class of their file name."""
    stem = F.concat("source_spec", F.when(F.col("augment_level") > 0, F.concat(F.lit("-L"), "augment_level")).otherwise(""), F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("-s"), "sample_id")).otherwise(""))
    return eligible(records(spark, d)).groupBy(S.file_class(stem).alias("class")).agg(F.count("*").alias("n"))


@query("src11_three_log_union", RECORDS_SQL + "SELECT source_api AS api, count(*) AS n FROM rec GROUP BY 1")
def log_union(spark: SparkSession, d: str) -> DataFrame:
    """Three files, one for each API, read together and tagged by their folder."""
    path = S.workspace(spark, "logs")
    rec = eligible(records(spark, d)).select("record_id", "overall_status", "source_api")
    for a in ("cuda", "omp", "opencl"):
        rec.where(F.col("source_api") == a).drop("source_api").write.json(f"{path}/eval_{a}")
    rows = spark.read.schema("record_id long, overall_status string").json([f"{path}/eval_{a}" for a in ("cuda", "omp", "opencl")])
    return rows.groupBy(F.regexp_extract("_metadata.file_path", r"eval_(\w+)/", 1).alias("api")).agg(F.count("*").alias("n"))


@query("src12_13_csv_lookups", "SELECT p_brand AS kernel, arg_max(p_type, p_partkey) AS last_wins, arg_min(p_type, p_partkey) AS first_wins FROM part GROUP BY 1")
def csv_lookups(spark: SparkSession, d: str) -> DataFrame:
    """A CSV lookup with repeated keys, by the last and by the first row."""
    path = S.workspace(spark, "lookup")
    table(spark, d, "part").select("p_partkey", "p_brand", "p_type").write.option("header", True).csv(path)
    rows = S.csv_lookup(spark, path, "p_partkey long, p_brand string, p_type string")
    return rows.groupBy(F.col("p_brand").alias("kernel")).agg(F.max_by("p_type", "p_partkey").alias("last_wins"), F.min_by("p_type", "p_partkey").alias("first_wins"))


@query("src14_strict_registry", "SELECT k, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'repeated member' WHEN 2 THEN 'NaN is not allowed' WHEN 3 THEN 'number overflows' WHEN 4 THEN 'number underflows' ELSE 'not JSON' END AS problem FROM range(6) t(k)")
def strict_registry(spark: SparkSession, d: str) -> DataFrame:
    """Documents refused, and why: members named twice and numbers that a double cannot hold are errors, not repairs."""
    texts = ('{"a": 1.5}', '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', '{"a": 1e-999}', "{")
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return rows.select("k", S.strict_json_problem("text").alias("problem"))


@query("src15_frozen_population", """
SELECT sha256('[' || string_agg('["' || suite || '","' || kernel || '"]', ',' ORDER BY suite, kernel) || ']') AS sha256, count(*) AS units FROM (SELECT DISTINCT 'suite' || ((user_id // 3) % 5) AS suite, 'k' || (user_id // 3) AS kernel FROM events)""")
def frozen_population(spark: SparkSession, d: str) -> DataFrame:
    """The hash that a frozen list of units is verified by."""
    return S.population_hash(records(spark, d).select("suite", "kernel"))


@query("src16_commented_jsonl", "SELECT p_partkey, p_name FROM part")
def commented(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines among comments, blank lines and malformed lines."""
    path = S.workspace(spark, "samples")
    good = table(spark, d, "part").select(F.to_json(F.struct("p_partkey", "p_name")).alias("value"))
    good.unionAll(spark.createDataFrame([("// note",), ("",), ("  // more",), ("{bad",)], "value string")).write.text(path)
    return S.commented_jsonl(spark, path, "p_partkey long, p_name string")


@query("src17_path_resolution", "SELECT p_partkey, '/proj/s9/' || p_brand || '/a.cu,/proj/s9/' || p_brand || '/b.h' AS paths FROM part")
def path_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Listed files as absolute paths under a configured root."""
    root = S.resolved({"suite_root": "s9"}, "/proj")["suite_root"]
    listed = F.array(F.lit("a.cu"), F.lit("b.h"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(listed, lambda f: F.concat_ws("/", F.lit(root), "p_brand", f)), ",").alias("paths"))


@query("src19_payload", """
SELECT p_partkey AS key, 'a' AS name, CASE WHEN p_size % 2 = 0 THEN 'int a' || p_size ELSE '<FILE NOT FOUND: a' || p_partkey || '>' END AS content FROM part""")
def payload(spark: SparkSession, d: str) -> DataFrame:
    """Listed files with their contents; a missing one reads as a sentinel."""
    p = table(spark, d, "part")
    name = F.concat(F.lit("a"), "p_partkey")
    files = p.where("p_size % 2 = 0").select(name.alias("name"), F.concat(F.lit("int a"), "p_size").alias("content"))
    listed = p.select(F.col("p_partkey").alias("key"), F.lit(0).alias("position"), name.alias("name"))
    return S.payload(listed, files).select("key", F.explode("payload").alias("name", "content")).withColumn("name", F.lit("a"))


@query("src19_support_files", "SELECT o_orderkey % 50 AS key, 3 AS listed, CASE WHEN (o_orderkey % 50) % 2 = 0 THEN 'big,tiny' ELSE 'small,tiny' END AS names FROM orders GROUP BY 1")
def support_files(spark: SparkSession, d: str) -> DataFrame:
    """Support files admitted in order while they fit; one too large is passed over, later ones may fit."""
    keys = table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("key")).distinct()
    big = F.when(F.col("key") % 2 == 0, 90).otherwise(200)
    entry = lambda i, name, n: F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.repeat(F.lit("x"), n).alias("content"))
    j = keys.select("key", F.inline(F.array(entry(0, "big", big), entry(1, "small", F.lit(50)), entry(2, "tiny", F.lit(5)))))
    return S.admitted(j, 100).select("key", F.lit(3).alias("listed"), F.array_join("names", ",").alias("names"))


@query("snk01_partitioned_upsert", RECORDS_SQL + """
, k AS (SELECT *, replace(model, 'm', 'm/') AS m, record_id % 3 = 0 AS late FROM rec),
 a AS (SELECT m, source_spec, target_spec, augment_level, sample_id, arg_max(overall_status, record_id) AS s, max(record_id) AS r FROM k WHERE NOT late GROUP BY ALL),
 b AS (SELECT m, source_spec, target_spec, augment_level, sample_id, arg_max(overall_status, record_id) AS s, max(record_id) AS r FROM k WHERE late GROUP BY ALL)
SELECT replace(coalesce(b.m, a.m), '/', '_') || '/' || coalesce(b.source_spec, a.source_spec) || '-to-' || coalesce(b.target_spec, a.target_spec) || CASE WHEN coalesce(b.augment_level, a.augment_level) > 0 THEN '-L' || coalesce(b.augment_level, a.augment_level) ELSE '' END
  || '-s' || coalesce(b.sample_id, a.sample_id) || '.json' AS name, coalesce(b.s, a.s) AS overall_status, coalesce(b.r, a.r) AS record_id, coalesce(a.s = 'PASS' AND b.s IS NOT NULL AND b.s <> 'PASS', false) AS lost_pass
FROM a FULL JOIN b USING (m, source_spec, target_spec, augment_level, sample_id)""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two batches written one over the other: what the second lacks stays, what it has replaces; a PASS that is lost is told."""
    rows = eligible(records(spark, d)).withColumn("model", F.replace("model", F.lit("m"), F.lit("m/")))
    name = S.result_name(F.col("model"), F.col("source_spec"), F.col("target_spec"), F.col("augment_level"), F.col("sample_id"), samples=3)
    rows = rows.select("model", name.alias("name"), "overall_status", "record_id")
    path = S.workspace(spark, "upsert")
    S.upsert(rows.where("record_id % 3 <> 0"), path, ["model", "name"], "record_id")
    stored = S.upsert(rows.where("record_id % 3 = 0"), path, ["model", "name"], "record_id")
    return stored.select("name", "overall_status", "record_id", "lost_pass")


@query("snk02_08_csv_and_json", RECORDS_SQL + "SELECT suite, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec GROUP BY 1")
def csv_and_json(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV, read, written as JSON and read again."""
    path = S.workspace(spark, "report")
    eligible(records(spark, d)).groupBy("suite").agg(*counts()).write.option("header", True).csv(f"{path}/csv")
    S.csv_lookup(spark, f"{path}/csv", "suite string, n long, c long").write.json(f"{path}/json")
    return spark.read.schema("suite string, n long, c long").json(f"{path}/json")


@query("snk03_markdown_rows", RECORDS_SQL + "SELECT '| ' || model || ' | ' || count(*) || ' | ' || count(*) FILTER (WHERE passed) || ' |' AS line FROM rec GROUP BY model")
def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a Markdown report."""
    g = eligible(records(spark, d)).groupBy("model").agg(*counts())
    return g.select(S.markdown(g, ["model", "n", "c"]).alias("line"))


@query("snk04_latex_rows", RECORDS_SQL + f", g AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec GROUP BY 1), w AS (SELECT model, n, {wilson_sql()} FROM g) SELECT model || ' & ' || n || ' & ' || printf('%.1f', round(rate * 100, 1)) || ' & $<$0.001 \\\\' AS line FROM w")
def latex_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a LaTeX table."""
    g = eligible(records(spark, d)).groupBy("model").agg(*counts())
    rate = F.round(F.round(wilson(F.col("c"), F.col("n"))[0], 6) * 100, 1)
    return g.select(S.latex_row([F.col("model"), F.col("n"), F.format_string("%.1f", rate), S.p_value(F.lit(0.0001))]).alias("line"))


@query("snk03_04_report_files", """
SELECT 'markdown' AS kind, 5 AS lines, '| model | n |' AS first UNION ALL SELECT 'latex', 9, '\\begin{tabular}{ll}'""")
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """The same aggregate as a Markdown and as a LaTeX file, read back as lines."""
    path = S.workspace(spark, "tables")
    g = eligible(records(spark, d)).groupBy("model").agg(F.count("*").alias("n"))
    out = None
    for kind, write in (("markdown", S.markdown_table), ("latex", S.latex_table)):
        write(g, ["model", "n"], [F.col("model")], f"{path}/{kind}")
        text = spark.read.text(f"{path}/{kind}", wholetext=True)
        lines = F.split(F.regexp_replace("value", r"\n$", ""), "\n")
        found = text.select(F.lit(kind).alias("kind"), F.size(lines).alias("lines"), lines[0].alias("first"))
        out = found if out is None else out.unionByName(found)
    return out


@query("snk05_heatmap_data", RECORDS_SQL + "SELECT kernel, count(*) FILTER (WHERE model = 'm0' AND passed) AS m0, count(*) FILTER (WHERE model = 'm1' AND passed) AS m1, count(*) FILTER (WHERE model = 'm2' AND passed) AS m2 FROM rec GROUP BY 1")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    """The numbers behind the kernel heat map; explicit pivot values need no extra pass."""
    return eligible(records(spark, d)).where("passed is not null").groupBy("kernel").pivot("model", ["m0", "m1", "m2"]).agg(F.count_if("passed")).na.fill(0)


@query("snk06_fragment_rewrite", "SELECT p_partkey, '\\rate{' || p_size || '.0} of \\old{7}' AS line FROM part")
def fragment_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A number inside a fragment replaced, everything around it kept."""
    line = F.lit(r"\rate{12.5} of \old{7}")
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(line, F.lit(r"(?<=\\rate\{)[0-9.]+"), F.format_string("%.1f", F.col("p_size").cast("double"))).alias("line"))


@query("snk07_archive_plan", "SELECT 'doc' || doc_id || '/' || f AS member, sha256(text || f) AS sha256 FROM documents, (VALUES ('a.cu'), ('b.cu')) t(f)")
def archive_plan(spark: SparkSession, d: str) -> DataFrame:
    """Members of an archive, one for each entry of the file maps, with hashes; unsafe names are left out."""
    entry = lambda n: (F.lit(n), F.concat("text", F.lit(n)))
    files = F.create_map(*entry("a.cu"), *entry("b.cu"), *entry("../c.cu"))
    x = table(spark, d, "documents").select("doc_id", F.explode(files).alias("name", "body")).where(~F.col("name").rlike(r"(^/|(^|/)\.\.(/|$))"))
    return x.select(F.concat(F.lit("doc"), "doc_id", F.lit("/"), "name").alias("member"), F.sha2("body", 256).alias("sha256"))


@query("stm01_resumable_stream", RECORDS_SQL + "SELECT DISTINCT model, kernel, direction FROM rec")
def resumable_stream(spark: SparkSession, d: str) -> DataFrame:
    """A file stream that writes every key once, stopped and started again."""
    path = S.workspace(spark, "stream")
    rec = eligible(records(spark, d)).select("model", "kernel", "direction", "record_id")
    kind = "model string, kernel string, direction string, record_id long"
    for part in (0, 1):
        rec.where(F.col("record_id") % 2 == part).write.mode("append").parquet(f"{path}/in")
        campaign.resumable(campaign.record_stream(spark, f"{path}/in", kind), f"{path}/out", f"{path}/checkpoint", ["model", "kernel", "direction"])
    return spark.read.schema(kind).parquet(f"{path}/out").select("model", "kernel", "direction")


@query("stm03_attempt_log", RECORDS_SQL + "SELECT model, CAST(sum(CASE WHEN NOT passed AND record_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS attempts FROM rec GROUP BY 1")
def attempt_log(spark: SparkSession, d: str) -> DataFrame:
    """A retry loop's log as rows: attempts exploded from records."""
    from tallyforge.plans.projections import attempts

    return eligible(records(spark, d)).select("model", F.posexplode(attempts()).alias("attempt", "x")).groupBy("model").agg(F.count("*").alias("attempts"))


def _program(changed: bool = False) -> Column:
    """A program of each part, as it is or as all transforms leave it; every transform finds something in it, and a string has what they look for."""
    n, kind, total, i, a, x, f = F.col("p_size").cast("string"), *(("unsigned int", "v2", "v3", "v4", "v1", "fn1") if changed else ("count_t", "total", "i", "a", "x", "twice"))
    body = [F.lit(f"typedef unsigned int count_t;\nstatic int {f}(int {x}) {{ return {x} * 2; }}\nint main(void) {{\n  {kind} {total} = "), n, F.lit(f";\n  int {i} = 0;\n  int {a}[64];\n")]
    test, add, index, step = (
        ([n, F.lit(f" > {i}")], f"{total} = {total} + ({i})", f"({a})[{i}]", [F.lit(f"{i} += "), n]) if changed else ([F.lit(f"{i} < "), n], f"{total} += {i}", f"*({a} + {i})", [F.lit(f"{i} = {i} + "), n])
    )
    body += [F.lit("  while ("), *test, F.lit(f") {{\n    {add}; // total += 1\n    {index} = {f}({i});\n    "), *step, F.lit(f';\n    printf("total += %d; i < 3 *(a + i) count_t x", {total});\n  }}\n  return 0;\n}}\n')]
    return F.concat(*body)


def _dealt(df: DataFrame) -> DataFrame:
    """The rows over all tasks: a file of few bytes a row is read in one or two, which rewriting a program for each row would keep busy for hours."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_STRING = 'printf("total += %d; i < 3 *(a + i) count_t x",'


@query("udf01_02_transforms", """
SELECT p_partkey, p_size % 5 AS level, [0, 1, 1, 3, 6][p_size % 5 + 1] AS applied, true AS strings_kept, true AS valid, CASE p_size % 5
 WHEN 0 THEN 'typedef unsigned int count_t;' || chr(10) || 'static int twice(int x) { return x * 2; }' || chr(10) || 'int main(void) {' || chr(10) || '  count_t total = ' || p_size || ';' || chr(10) || '  int i = 0;' || chr(10) || '  int a[64];' || chr(10)
  || '  while (i < ' || p_size || ') {' || chr(10) || '    total += i; // total += 1' || chr(10) || '    *(a + i) = twice(i);' || chr(10) || '    i = i + ' || p_size || ';' || chr(10) || '    printf("total += %d; i < 3 *(a + i) count_t x", total);' || chr(10)
  || '  }' || chr(10) || '  return 0;' || chr(10) || '}' || chr(10)
 WHEN 4 THEN 'typedef unsigned int count_t;' || chr(10) || 'static int fn1(int v1) { return v1 * 2; }' || chr(10) || 'int main(void) {' || chr(10) || '  unsigned int v2 = ' || p_size || ';' || chr(10) || '  int v3 = 0;' || chr(10) || '  int v4[64];' || chr(10)
  || '  while (' || p_size || ' > v3) {' || chr(10) || '    v2 = v2 + (v3); // total += 1' || chr(10) || '    (v4)[v3] = fn1(v3);' || chr(10) || '    v3 += ' || p_size || ';' || chr(10) || '    printf("total += %d; i < 3 *(a + i) count_t x", v2);' || chr(10)
  || '  }' || chr(10) || '  return 0;' || chr(10) || '}' || chr(10) END AS code FROM part""")
def code_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Programs at levels 0 (as they are) to 4 (every place of every transform); what levels 1 to 3 choose is told by count."""
    x = _dealt(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", (F.col("p_size") % 5).alias("level"), _program().alias("program"))
    x = x.withColumn("t", transforms.transform_code("program", "level", F.col("p_partkey").cast("string")))
    return x.select("p_partkey", "level", F.size("t.transforms").alias("applied"), F.col("t.code").contains(_STRING).alias("strings_kept"), F.col("t.valid").alias("valid"), F.when(F.col("level").isin(0, 4), F.col("t.code")).alias("code"))


def _singles(spark: SparkSession, d: str) -> DataFrame:
    x = _dealt(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", _program().alias("program"))
    return x.withColumn("t", transforms.one_transform("program", F.col("p_partkey").cast("string")))


@query("udf03_single_transform", "SELECT p_partkey, 1 AS applied, true AS changed, true AS strings_kept, true AS valid FROM part")
def single_transform(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one transform for every program; strings and comments stay."""
    kept = F.col("t.code").contains(_STRING) & F.col("t.code").contains("// total += 1\n")
    return _singles(spark, d).select("p_partkey", F.size("t.transforms").alias("applied"), (F.col("t.code") != F.col("program")).alias("changed"), kept.alias("strings_kept"), F.col("t.valid").alias("valid"))


@query("udf03_validation_report", "SELECT 6::BIGINT AS transforms, count(*) AS programs, count(*) AS changed, count(*) AS valid FROM part")
def validation(spark: SparkSession, d: str) -> DataFrame:
    """The report over all transforms: each was some program's, and all programs changed and have no new faults."""
    x = _singles(spark, d)
    report = transforms.validation_report(x, F.col("t.transforms"), F.col("t.valid"), F.col("t.code") != F.col("program"))
    return report.agg(F.count("*").alias("transforms"), *[F.sum(c).alias(c) for c in ("programs", "changed", "valid")])


@query("stm02_token_budget_stream", RECORDS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + BUDGET_SQL + "SELECT trajectory, decision, count(*) AS n, CAST(sum(cap) AS BIGINT) AS caps, max(used) AS used FROM s WHERE i > 0 GROUP BY 1, 2")
def token_budget_stream(spark: SparkSession, d: str) -> DataFrame:
    """The token budget over a stream, state kept for each trajectory from one batch to the next."""
    path = S.workspace(spark, "budget")
    rows = requests(eligible(records(spark, d)))
    kind = "trajectory string, request long, estimate long, prompt long, completion long"
    middle = rows.agg(F.expr("percentile_approx(request, 0.5)")).first()[0] or 0
    for part in (rows.where(F.col("request") <= middle), rows.where(F.col("request") > middle)):  # two runs of the stream
        part.select(*[F.col(c).cast("long") if c != "trajectory" else c for c in rows.columns]).write.mode("append").parquet(f"{path}/in")
        out = campaign.token_budget(campaign.record_stream(spark, f"{path}/in", kind), PROTOCOL)
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("trajectory", "decision").agg(F.count("*").alias("n"), F.sum("cap").alias("caps"), F.max("used").alias("used"))
