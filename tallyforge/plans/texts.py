"""Text, classification, verification and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import taxonomy as X
from tallyforge.operators import verify as V
from tallyforge.plans.registry import query
from tallyforge.sources.records import APIS, RECORDS_SQL, STATUSES, eligible, records, table


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("prj11_strip_reasoning", """
SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text ELSE '' END AS answer FROM
 (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations)""")
def strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """Answers without reasoning: whole blocks, a lone closing tag, a lone opening one."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    wrapped = (
        F.when(k == 0, F.concat(F.lit("<think>a\nb</think>\n"), "text")).when(k == 1, F.concat(F.lit("so on</think> "), "text"))
        .when(k == 2, F.concat("text", F.lit("<think>cut off"))).otherwise(F.concat(F.lit("<think>"), "text"))
    )
    return messages(spark, d).select("conv_id", "turn", T.strip_reasoning(wrapped).alias("answer"))


@query("prj12_fenced_blocks", """
SELECT conv_id, turn, 'main.cu' AS name, CASE turn % 4 WHEN 1 THEN 'later' ELSE 'int x' || turn || ';' END || chr(10) AS body FROM conversations WHERE turn % 4 <> 2 UNION ALL SELECT conv_id, turn, 'util.h', '#pragma once' || chr(10) FROM conversations WHERE turn % 4 IN (0, 3)""")
def fenced(spark: SparkSession, d: str) -> DataFrame:
    """Files of a response: named fences, with and without a path or quotes; of a name given twice the first counts, a fence without a name is no file."""
    k = F.col("turn") % 4
    head = F.when(k == 0, "cpp filename=src/main.cu").when(k == 3, 'c++ filename="a/b/main.cu"').otherwise("cpp")
    second = F.when((k == 0) | (k == 3), "cpp util.h").otherwise("")
    last = F.when(k == 2, "cpp").otherwise("cpp main.cu")
    said = F.concat(F.lit("Here:\n```"), head, F.lit("\nint x"), "turn", F.lit(";\n```\nand\n```"), second, F.lit("\n#pragma once\n```\n```"), last, F.lit("\nlater\n```\n"))
    return messages(spark, d).select("conv_id", "turn", F.explode(T.fenced_named(said)).alias("name", "body"))


@query("prj12_fenced_near_names", """
SELECT conv_id, turn, 'k.cl' AS name, 'kernel ' || turn || chr(10) AS body FROM conversations WHERE turn % 4 IN (0, 1, 3) UNION ALL SELECT conv_id, turn, 'host.c', 'main ' || turn || chr(10) FROM conversations WHERE turn % 4 = 3""")
def fenced_near(spark: SparkSession, d: str) -> DataFrame:
    """Files of a response whose names stand before their fences, or where one block answers for one target; a name too far away names nothing."""
    k, block = F.col("turn") % 4, F.concat(F.lit("\n```\nkernel "), "turn", F.lit("\n```\n"))
    said = (
        F.when(k == 0, F.concat(F.lit("File `k.cl`:"), block)).when(k == 1, block).when(k == 2, F.concat(F.lit("k.cl "), F.repeat(F.lit("x"), 600), block))
        .otherwise(F.concat(F.lit("`host.c`\n```c\nmain "), "turn", F.lit("\n```\n"), F.repeat(F.lit("y"), 600), F.lit(" k.cl"), block))
    )
    targets = F.when(k < 2, F.array(F.lit("dir/k.cl"))).otherwise(F.array(F.lit("dir/k.cl"), F.lit("host.c")))
    rows = messages(spark, d).select("conv_id", "turn", said.alias("said"), targets.alias("targets"))
    return rows.select("conv_id", "turn", F.explode(T.fenced_for_targets("said", "targets")).alias("name", "body"))


@query("prj13_deanonymise", "SELECT p_partkey, 'bfs.cu' AS name, '#include \"bfs.h\"' || chr(10) || p_name AS body FROM part")
def deanonymise(spark: SparkSession, d: str) -> DataFrame:
    """Real file names put back into a file map and into the bodies."""
    files = F.create_map(F.lit("file1.cu"), F.concat(F.lit('#include "file2.h"\nmake bfs\n'), "p_name"))
    return table(spark, d, "part").select("p_partkey", F.explode(T.renamed(files, {"file1.cu": "bfs.cu", "file2.h": "bfs.h"})).alias("name", "body"))


def _code() -> Column:
    """A program whose comments, strings and characters hold one another's marks; the name stands in a string."""
    name = F.regexp_replace("p_name", "[\"\\\\]", "")
    return F.concat(F.lit('// head "x\nint a = 1; /* x "\n y */ int b;\nchar *s = "// '), name, F.lit(' \\" /*";\n\n/* z */\nchar c = \'"\'; // it\'s\n'))


@query("prj14_strip_comments", """
SELECT p_partkey, chr(10) || 'int a = 1; ' || chr(10) || ' int b;' || chr(10) || 'char *s = "// ' || replace(replace(p_name, chr(34), ''), chr(92), '') || ' ' || chr(92) || '" /*";' || chr(10) || chr(10) || ' ' || chr(10) || 'char c = ''"''; ' || chr(10) AS code FROM part""")
def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    """Source without comments; comment marks inside strings stay."""
    return table(spark, d, "part").select("p_partkey", T.strip_comments(_code()).alias("code"))


@query("prj15_sloc", "SELECT p_partkey, 3 + p_size % 4 + CASE WHEN p_size % 3 = 0 THEN 3 ELSE 1 END AS non_blank_with_comments, 2 + p_size % 4 + CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS physical FROM part")
def sloc(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are not blank, and lines with code outside comments; a block comment may hold what looks like code."""
    tail = F.when(F.col("p_size") % 3 == 0, "/* open\nint f;\n*/\n").otherwise("int f;\n")
    code = F.concat(F.lit("int a; // x\n/* y\n z */ int b;\n\n"), F.repeat(F.lit("int c; /* w */ int e;\n"), F.col("p_size") % 4), F.lit("  \n"), tail)
    return table(spark, d, "part").select("p_partkey", T.non_blank_lines(code).alias("non_blank_with_comments"), T.physical_sloc(code).alias("physical"))


@query("prj15_document_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS n FROM documents")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines of every document."""
    return table(spark, d, "documents").select("doc_id", T.non_blank_lines(F.col("text")).cast("long").alias("n"))


@query("prj16_head_and_tail", "SELECT doc_id, length(CASE WHEN length(text) > 1500 THEN left(text, 750) || chr(10) || '...[truncated]...' || chr(10) || right(text, 750) ELSE text END) AS n, md5(CASE WHEN length(text) > 1500 THEN left(text, 750) || chr(10) || '...[truncated]...' || chr(10) || right(text, 750) ELSE text END) AS h FROM documents")
def head_tail(spark: SparkSession, d: str) -> DataFrame:
    """Long logs cut to head and tail."""
    cut = T.head_and_tail(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("h"))


@query("prj26_27_29_commands_and_output", """
SELECT p_partkey, 'make CC=' || p_brand || ' ARCH=${ARCH}' AS command, CASE WHEN p_size % 2 = 0 THEN round(1.25 + p_size, 6) END AS cpu, CASE p_size % 3 WHEN 0 THEN 'OpenCL kernel build failure: clBuildProgram() => -11' WHEN 1 THEN NULL ELSE 'CUDA error: cudaErrorInvalidValue:' END AS sign FROM part""")
def commands(spark: SparkSession, d: str) -> DataFrame:
    """Variables in commands, CPU time in logs, signs of error in output."""
    p = table(spark, d, "part")
    log = F.concat(F.lit("real 9.0\nuser 1.25\n"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("sys "), "p_size", F.lit("\n"))).otherwise(""))
    out = F.when(F.col("p_size") % 3 == 0, "ERROR: clBuildProgram() => -11\nok").when(F.col("p_size") % 3 == 1, "cudaErrorSuccess: fine").otherwise("got cudaErrorInvalidValue: bad")
    command = T.substituted(F.lit("make CC=${CC} ARCH=${ARCH}"), F.create_map(F.lit("CC"), F.col("p_brand")))
    return p.select("p_partkey", command.alias("command"), F.round(T.cpu_seconds(log), 6).alias("cpu"), T.error_sign(out).alias("sign"))


def snippets() -> Column:
    """A build log by record number."""
    logs = (
        "fatal error: omp.h: No such file or directory", "main.o: undefined reference to `f'\nmain.c: redefinition of 'g'", "error: 'x' was not declared in this scope\nerror: expected ';' before '}'",
        "error: cudaMalloc is undeclared", "something else", "error: unknown type name 'cl_mem'",
    )
    return F.element_at(F.array(*map(F.lit, logs)), (F.col("record_id") % 6 + 1).cast("int"))


def translated() -> Column:
    """Files of a translation: every seventh lacks its target's constructs, every eleventh has none."""
    sign = F.when(F.col("target_api") == "omp", "#pragma omp parallel for").when(F.col("target_api") == "opencl", "__kernel void k()").otherwise("k<<<1, 1>>>();")
    made = F.create_map(F.lit("a.c"), F.lit("int a;"), F.lit("b.c"), F.when(F.col("record_id") % 7 == 0, "int b;").otherwise(sign))
    return F.when(F.col("record_id") % 11 == 0, F.create_map().cast("map<string,string>")).otherwise(made)


_BUILD_SQL = """
, k AS (SELECT *, record_id % 7 = 0 AND record_id % 11 <> 0 AS lacks FROM rec WHERE overall_status = 'BUILD_FAIL'),
 c AS (SELECT *, CASE record_id % 6
   WHEN 3 THEN CASE WHEN target_api <> 'cuda' THEN 'retained_cuda_api' WHEN lacks THEN 'missing_target_api' ELSE 'undeclared_identifier' END
   WHEN 5 THEN CASE WHEN target_api <> 'opencl' THEN 'retained_opencl_api' WHEN lacks THEN 'missing_target_api' ELSE 'undeclared_identifier' END
   ELSE CASE WHEN lacks THEN 'missing_target_api' ELSE ['missing_header', 'linker_error', 'undeclared_identifier', '', 'other_build'][(record_id % 6 + 1)::INT] END END AS category,
  CASE record_id % 6 WHEN 0 THEN CASE WHEN lacks THEN 'missing_header' ELSE '' END WHEN 1 THEN CASE WHEN lacks THEN 'linker_error,redefinition' ELSE 'redefinition' END
   WHEN 2 THEN CASE WHEN lacks THEN 'undeclared_identifier,syntax_error' ELSE 'syntax_error' END WHEN 4 THEN ''
   ELSE CASE WHEN target_api <> (CASE record_id % 6 WHEN 3 THEN 'cuda' ELSE 'opencl' END) THEN CASE WHEN lacks THEN 'missing_target_api,' ELSE '' END || 'undeclared_identifier'
        WHEN lacks THEN 'undeclared_identifier' ELSE '' END END AS also FROM k)"""


@query("cls01_build_taxonomy", RECORDS_SQL + _BUILD_SQL + " SELECT model, category, also, count(*) AS n FROM c GROUP BY 1, 2, 3")
def build_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Build failures by category, with the other categories that apply; some rules depend on the direction or the code."""
    r = eligible(records(spark, d)).where("overall_status = 'BUILD_FAIL'").select("model", "direction", snippets().alias("log"), translated().alias("files"))
    # the same log, direction and files come again and again: rows are counted first, so a rule reads each of them once
    kinds = r.withColumns({"names": F.map_keys("files"), "codes": F.map_values("files")}).groupBy("model", "direction", "log", "names", "codes").agg(F.count("*").alias("n"))
    rules = X.build_rules(F.col("log"), F.col("direction"), F.map_from_arrays("names", "codes"))
    found = kinds.select("model", X.holding(rules).alias("found"), "n").groupBy("model", "found").agg(F.sum("n").alias("n"))
    return found.groupBy("model", X.first_of(F.col("found"), "other_build").alias("category"), F.array_join(X.others_of(F.col("found")), ",").alias("also")).agg(F.sum("n").alias("n"))


@query("cls02_run_taxonomy", RECORDS_SQL + """
SELECT ['timeout', 'segfault', 'abort', 'wrong_args', 'gpu_memory_error', 'wrong_exit_code', 'wrong_checksum', 'other_runtime'][(record_id % 8 + 1)::INT] AS category,
 CASE record_id % 8 WHEN 3 THEN 'data_file_missing' ELSE '' END AS also, count(*) AS n FROM rec WHERE overall_status = 'RUN_FAIL' GROUP BY 1, 2""")
def run_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Run failures by category; an exit code alone is never a secondary."""
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("record_id") % 8 + 1).cast("int"))
    err = pick("killed by timeout", "Segmentation fault", "", "usage: a <b>", "GPUassert: x", "", "", "")
    out = pick("", "", "", "cannot open data", "", "", "invalid checksum", "fine")
    code = pick(-9, 1, -6, 1, 1, 3, 1, 0)
    rules = X.run_rules(code, err, out)
    r = eligible(records(spark, d)).where("overall_status = 'RUN_FAIL'").select(X.holding(rules).alias("found")).groupBy("found").agg(F.count("*").alias("n"))
    return r.groupBy(X.first_of(F.col("found"), "other_runtime").alias("category"), F.array_join(X.others_of(F.col("found"), ("wrong_exit_code",)), ",").alias("also")).agg(F.sum("n").alias("n"))


@query("cls03_extraction_taxonomy", RECORDS_SQL + "SELECT CASE record_id % 3 WHEN 0 THEN 'no_code_blocks' WHEN 1 THEN 'missing_files' ELSE 'malformed_output' END AS category, count(*) AS n FROM rec WHERE overall_status = 'EXTRACTION_FAIL' GROUP BY 1")
def extraction_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Extraction failures by category."""
    said = F.element_at(F.array(F.lit("Response did not contain parseable code"), F.lit("Expected file a.cu"), F.lit("odd")), (F.col("record_id") % 3 + 1).cast("int"))
    return eligible(records(spark, d)).where("overall_status = 'EXTRACTION_FAIL'").groupBy(X.extraction_category(said).alias("category")).agg(F.count("*").alias("n"))


@query("cls04_verify_taxonomy", RECORDS_SQL + """
SELECT ['wrong_numerical_output', 'missing_output', 'verification_error', 'pass_overall_mislabel', 'other_verify'][(record_id % 5 + 1)::INT] AS category, record_id % 5 = 0 AS data_file_error, count(*) AS n FROM rec WHERE overall_status = 'VERIFY_FAIL' GROUP BY 1, 2""")
def verify_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Verification failures by category, and whether a data file was the trouble."""
    k = (F.col("record_id") % 5 + 1).cast("int")
    status = F.element_at(F.array(*map(F.lit, ("fail", "fail", "error", "pass", "skip"))), k)
    out = F.element_at(F.array(*map(F.lit, ("Cannot open x", " \n", "1", "2", "3"))), k)
    r = eligible(records(spark, d)).where("overall_status = 'VERIFY_FAIL'")
    return r.groupBy(X.verify_category(status, out).alias("category"), X.data_file_error(out).alias("data_file_error")).agg(F.count("*").alias("n"))


@query("cls05_expected_errors", "SELECT event_type = 'error' AS expected, count(*) AS n FROM events GROUP BY 1")
def expected_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error lines that are known and those that nobody explained."""
    return table(spark, d, "events").groupBy(X.expected_error(F.col("event_type"), ("err", "warning:")).alias("expected")).agg(F.count("*").alias("n"))


@query("agg19_failure_rollup", RECORDS_SQL + _BUILD_SQL + """
SELECT 'model' AS dimension, model AS value, category, count(*) AS n FROM c GROUP BY 2, 3 UNION ALL SELECT 'suite', suite, category, count(*) FROM c GROUP BY 2, 3 UNION ALL SELECT 'direction', direction, category, count(*) FROM c GROUP BY 2, 3""")
def failure_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Build failure categories by model, suite and direction, by grouping sets."""
    dims = ("model", "suite", "direction")
    c = eligible(records(spark, d)).where("overall_status = 'BUILD_FAIL'").withColumn("category", X.primary(X.build_rules(snippets(), F.col("direction"), translated()), "other_build")).groupBy(*dims, "category").agg(F.count("*").alias("n"))
    g = c.groupingSets([[F.col(k), F.col("category")] for k in dims], *dims, "category")
    name, value = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in dims]), F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k)) for k in dims])
    return g.agg(name.alias("dimension"), value.alias("value"), F.sum("n").alias("n")).select("dimension", "value", "category", "n")


@query("ver01_verify_run", """
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'SKIP' WHEN 4 THEN CASE WHEN p_size BETWEEN 11 AND 29 THEN 'PASS' ELSE 'FAIL' END WHEN 5 THEN 'ERROR' WHEN 6 THEN CASE WHEN p_size = 22 THEN 'PASS' ELSE 'FAIL' END ELSE 'ERROR' END AS status,
 CASE p_size % 8 WHEN 0 THEN 'exit_code+numeric_comparison' WHEN 1 THEN 'exit_code' WHEN 2 THEN 'stdout_pattern' WHEN 3 THEN '' WHEN 5 THEN 'telepathy' ELSE 'numeric_comparison' END AS strategy FROM part""")
def verify_run(spark: SparkSession, d: str) -> DataFrame:
    """Runs judged by all strategies of their oracle in order; the first that does not pass decides. A tolerance that is not given is 0."""
    kind = f"array<struct<{V.STRATEGY.replace(' string', ':string').replace(' boolean', ':boolean')}>>"
    cases = (
        '[{"type":"exit_code","expected":"0"},{"type":"numeric_comparison","pattern":"err=([0-9.]+)","expected":"0.5","tolerance":"0.01"}]', '[{"type":"exit_code","expected":"1"}]', '[{"type":"stdout_pattern","pattern":"(bad"}]',
        "[]", '[{"type":"numeric_comparison","pattern":"size=([0-9.]+)","expected":"20","tolerance":"9"}]', '[{"type":"telepathy"}]',
        '[{"type":"numeric_comparison","pattern":"size=([0-9]+)","expected":"22"}]', '[{"type":"numeric_comparison","pattern":"size=([0-9]+)","expected":"22","tolerance":"-1"}]',
    )
    chosen = F.from_json(F.element_at(F.array(*map(F.lit, cases)), F.col("p_size") % 8 + 1), kind)
    runs = table(spark, d, "part").select("p_partkey", F.lit(0).alias("exit_code"), F.concat(F.lit("done err=0.501 size="), "p_size").alias("stdout"), F.create_map().cast("map<string,string>").alias("files"), chosen.alias("strategies"))
    return V.verify(runs, "p_partkey")


@query("ver02_04_native_checks", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 0 THEN 'PASS' WHEN l_linenumber = 7 THEN 'ERROR' WHEN l_linenumber = 1 THEN 'PASS' ELSE 'FAIL' END AS exit_status,
 CASE WHEN l_tax < 0.02 THEN 'ERROR' WHEN abs(l_discount - 0.05) <= (CASE WHEN l_tax < 0.05 THEN 0 ELSE 0.0200001 END) THEN 'PASS' ELSE 'FAIL' END AS numeric_status FROM lineitem""")
def native_checks(spark: SparkSession, d: str) -> DataFrame:
    """Exit codes and numbers checked without Python where the pattern is known to the plan."""
    expected = F.when(F.col("l_linenumber") == 7, "true").otherwise("1")
    stdout = F.concat(F.lit("residual = "), F.col("l_discount").cast("string"), F.lit(" end"))
    tolerance = F.when(F.col("l_tax") < 0.02, "-1").when(F.col("l_tax") >= 0.05, "0.0200001")  # else none
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.exit_code(expected, F.col("l_linenumber")).alias("exit_status"), V.numeric(stdout, r"residual = ([0-9.E-]+)", F.lit("0.05"), tolerance).alias("numeric_status"))


@query("ver05_file_hash", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ERROR' WHEN doc_id % 5 IN (1, 2) THEN 'FAIL' ELSE 'PASS' END AS status FROM documents")
def file_hash(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes against expected ones: malformed, missing, out of the tree, equal."""
    k = F.col("doc_id") % 5
    own = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", V.file_hash(F.when(k == 0, "xyz").otherwise(own), F.when(k != 1, own), k == 2).alias("status"))


@query("ver06_metrics", "SELECT p_partkey, 'gflops' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'time', round(p_retailprice, 2) FROM part WHERE p_size % 2 = 0")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metrics found in output; one that is absent or no number gives no row."""
    out = F.concat(F.lit("GFLOPS: "), "p_size", F.lit("\n"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("time="), F.round("p_retailprice", 2).cast("string"))).otherwise("time=n/a"))
    return table(spark, d, "part").select("p_partkey", F.inline(V.metrics(out, {"gflops": r"GFLOPS: (\S+)", "time": r"time=(\S+)", "absent": r"watts=(\S+)"})))


@query("ver07_schema_audit", RECORDS_SQL + """
SELECT category, count(*) AS n FROM (SELECT 'enum' AS category FROM rec WHERE record_id % 11 = 0 UNION ALL SELECT 'missing' FROM rec WHERE record_id % 13 = 0 UNION ALL SELECT 'tokens' FROM rec WHERE completion_tokens < 100
 UNION ALL SELECT 'stage' FROM rec WHERE passed AND record_id % 17 = 0) GROUP BY 1""")
def schema_audit(spark: SparkSession, d: str) -> DataFrame:
    """Records against their schema: domain, required fields, positive counts, stages that contradict the status."""
    k = F.col("record_id")
    r = eligible(records(spark, d)).select(
        F.when(k % 11 == 0, "MAYBE").otherwise(F.col("overall_status")).alias("status"), F.when(k % 13 != 0, F.col("target_spec")).alias("target_spec"), "completion_tokens", "passed",
        F.when((k % 17 == 0) & F.col("passed"), "FAIL").otherwise("PASS").alias("run_status"),
    )
    rule = lambda bad, name: F.when(bad, name)
    found = F.array_compact(F.array(rule(~F.col("status").isin(*STATUSES), "enum"), rule(F.col("target_spec").isNull(), "missing"), rule(F.col("completion_tokens") < 100, "tokens"), rule(F.col("passed") & (F.col("run_status") != "PASS"), "stage")))
    return r.select(F.explode(found).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("ver08_append_only", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 7) AS now, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS before, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 100 = 7) AS deleted")
def append_only(spark: SparkSession, d: str) -> DataFrame:
    """A manifest may only grow: lines before, lines now, lines that are gone."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    now, before = o.where("o_orderkey % 100 <> 7"), o.where("o_orderkey % 2 = 0")
    lines = now.withColumn("k", F.lit(1)).unionByName(before.withColumn("k", F.lit(-1))).groupBy("o_orderkey", "o_orderstatus")
    counted = lines.agg(F.count_if(F.col("k") > 0).alias("now"), F.count_if(F.col("k") < 0).alias("before"))
    return counted.agg(F.sum("now").alias("now"), F.sum("before").alias("before"), F.sum(F.greatest(F.col("before") - F.col("now"), F.lit(0))).alias("deleted"))


def spec_problems(spec: dict[str, Column], there: Column) -> Column:
    """VER-08: what is wrong with a specification: required members, APIs, its id against file and fields, paths and file lists.

    ``spec`` has the columns file, unique_id, suite, kernel, api, implementation_api, payload, support, verification and
    targets; ``there`` lists the files of its folder.
    """
    lists = ("payload", "support", "verification")
    empty = F.array().cast("array<string>")
    x = {k: F.coalesce(v, empty) if k in (*lists, "targets") else v for k, v in spec.items()}
    named = F.array_distinct(F.concat(*[x[k] for k in lists]))
    unsafe = lambda f: f.startswith("/") | f.rlike(r"(^|/)\.\.(/|$)")
    rules = {
        "missing member": F.coalesce(*[F.when(x[k].isNull() | (x[k] == ""), True) for k in ("unique_id", "suite", "kernel", "api")], F.lit(False)),
        "unknown api": ~x["api"].isin(*APIS), "id is not the file name": x["unique_id"] != F.regexp_replace(x["file"], r"\.json$", ""), "id is not suite-kernel-api": x["unique_id"] != F.concat_ws("-", x["suite"], x["kernel"], x["api"]),
        "implementation of another api": x["implementation_api"] != x["api"], "unsafe path": F.exists(named, unsafe), "file is not there": F.size(F.array_except(F.filter(named, lambda f: ~unsafe(f)), there)) > 0,
        "file in payload and verification": F.arrays_overlap(x["payload"], x["verification"]), "target not in payload": F.size(F.array_except(x["targets"], x["payload"])) > 0,
        "warning: file in payload and support": F.arrays_overlap(x["payload"], x["support"]), "warning: file in no list": F.size(F.array_except(there, named)) > 0, "warning: target given twice": F.size(x["targets"]) > F.size(F.array_distinct(x["targets"])),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))


@query("ver08_spec_validation", """
SELECT problem, count(*) AS n FROM (SELECT p_size % 13 AS k FROM part), (VALUES (1, 'missing member'), (1, 'id is not the file name'), (1, 'id is not suite-kernel-api'), (2, 'unknown api'), (2, 'id is not suite-kernel-api'), (2, 'implementation of another api'), (3, 'id is not the file name'),
 (4, 'implementation of another api'), (5, 'unsafe path'), (6, 'file is not there'), (7, 'file in payload and verification'), (8, 'target not in payload'), (9, 'warning: file in payload and support'), (10, 'warning: file in no list'), (11, 'warning: target given twice'), (12, 'unsafe path'), (12, 'target not in payload')) t(k, problem)
 WHERE t.k = part.k GROUP BY 1""".replace("(SELECT p_size % 13 AS k FROM part),", "(SELECT p_size % 13 AS k FROM part) part,"))
def spec_validation(spark: SparkSession, d: str) -> DataFrame:
    """Specifications with one fault each, by what is found; a fault may show in more than one rule."""
    p, k = table(spark, d, "part"), F.col("p_size") % 13
    case = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    kernel, api = F.concat(F.lit("k"), "p_partkey"), case(2, F.lit("fortran"), F.lit("cuda"))
    unit = F.concat(F.lit("s-"), kernel, F.lit("-cuda"))
    files = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    spec = {
        "file": case(3, F.lit("other.json"), F.concat(unit, F.lit(".json"))), "unique_id": case(1, F.lit(""), unit), "suite": F.lit("s"), "kernel": kernel, "api": api, "implementation_api": case(4, F.lit("omp"), F.lit("cuda")),
        "payload": F.when(k == 5, files("a.cu", "../b.h")).when(k == 6, files("a.cu", "gone.cu")).when(k == 12, files("/etc/x")).otherwise(files("a.cu", "b.cu")), "support": case(9, files("b.cu", "c.h"), files("c.h")),
        "verification": case(7, files("a.cu"), F.lit(None).cast("array<string>")), "targets": F.when(k == 8, files("c.h")).when(k == 11, files("a.cu", "a.cu")).otherwise(files("a.cu")),
    }
    there = F.when(k == 10, files("a.cu", "b.cu", "c.h", "d.h")).when(k == 5, files("a.cu", "c.h")).when(k == 6, files("a.cu", "c.h")).when(k == 12, files("c.h")).otherwise(files("a.cu", "b.cu", "c.h"))
    return p.select(F.explode(spec_problems(spec, there)).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def freeze_problems(documents: DataFrame, controls: DataFrame, pairs: DataFrame, witnesses: DataFrame, ineligible: list[str]) -> DataFrame:
    """VER-11: (subject, problem) of what a freeze may not be made from.

    ``documents`` (name, schema, expected_schema, complete, sealed, registered): schemas as expected, campaigns complete,
    sealed hashes as registered. ``controls`` (artifact, control_id, outcome, expected): as many as registered, ids unique,
    the same in every artifact, every outcome there. ``pairs`` (source_spec, target_spec) with ``witnesses`` (both, status):
    none ineligible, each with a witness that passes. No rows: the freeze may go on.
    """
    say = lambda cond, what: F.when(F.coalesce(cond, F.lit(True)), what)
    bad = F.array_compact(F.array(say(F.col("schema") != F.col("expected_schema"), "unexpected schema"), say(~F.col("complete"), "incomplete"), F.when(F.col("registered").isNotNull(), say(F.col("sealed") != F.col("registered"), "sealed hash differs"))))
    out = documents.select(F.col("name").alias("subject"), F.explode(bad).alias("problem"))
    counted = controls.groupBy("artifact").agg(F.count("*").alias("n"), F.count_distinct("control_id").alias("ids"), F.max("expected").alias("expected"), F.count_if(F.coalesce("outcome", F.lit("")) == "").alias("open"))
    bad = F.array_compact(F.array(say(F.col("n") != F.col("expected"), "count differs"), F.when(F.col("ids") < F.col("n"), "ids missing or repeated"), F.when(F.col("open") > 0, "an outcome is missing")))
    out = out.unionByName(counted.select(F.col("artifact").alias("subject"), F.explode(bad).alias("problem")))
    artifacts = counted.count()  # a handful
    spread = controls.where("control_id is not null").groupBy("control_id").agg(F.count_distinct("artifact").alias("k")).where(F.col("k") < artifacts)
    out = out.unionByName(spread.select(F.col("control_id").cast("string").alias("subject"), F.lit("control not in every artifact").alias("problem")))
    j = pairs.join(witnesses, ["source_spec", "target_spec"], "left")
    bad = F.array_compact(F.array(F.when(F.col("source_spec").isin(*ineligible) | F.col("target_spec").isin(*ineligible), "ineligible specification"), say(F.col("status") != "pass", "no passing witness")))
    return out.unionByName(j.select(F.concat_ws(" -> ", "source_spec", "target_spec").alias("subject"), F.explode(bad).alias("problem")))


@query("ver11_freeze_inputs", """
SELECT 'host' AS subject, 'incomplete' AS problem UNION ALL SELECT 'labels', 'sealed hash differs' UNION ALL SELECT 'witnesses', 'unexpected schema' UNION ALL SELECT 'result', 'an outcome is missing' UNION ALL SELECT 'labels', 'count differs'
UNION ALL SELECT c_custkey::VARCHAR, 'control not in every artifact' FROM customer WHERE c_custkey % 10 = 3
UNION ALL SELECT 'a' || s_suppkey || ' -> b' || s_suppkey, 'no passing witness' FROM supplier WHERE s_suppkey % 4 IN (1, 2) UNION ALL SELECT 'a5 -> b5', 'ineligible specification'""")
def freeze_inputs(spark: SparkSession, d: str) -> DataFrame:
    """A freeze whose documents, controls and pairs each have faults."""
    documents = spark.createDataFrame(
        [("host", "h1", "h1", False, None, None), ("labels", "l1", "l1", True, "abd", "abc"), ("result", "r1", "r1", True, "abc", "abc"), ("witnesses", "w0", "w1", True, None, None)],
        "name string, schema string, expected_schema string, complete boolean, sealed string, registered string",
    )
    c = table(spark, d, "customer")
    n = c.agg(F.count("*").alias("expected"))
    row = lambda artifact, outcome: c.select(F.lit(artifact).alias("artifact"), F.col("c_custkey").alias("control_id"), outcome.alias("outcome"))
    rows = row("result", F.when(F.col("c_custkey") != 7, "kept")).unionByName(row("labels", F.lit("seen")).where("control_id % 10 <> 3"))
    s = table(spark, d, "supplier")
    pairs = s.select(F.concat(F.lit("a"), "s_suppkey").alias("source_spec"), F.concat(F.lit("b"), "s_suppkey").alias("target_spec"))
    witnesses = s.where("s_suppkey % 4 <> 1").select(F.concat(F.lit("a"), "s_suppkey").alias("source_spec"), F.concat(F.lit("b"), "s_suppkey").alias("target_spec"), F.when(F.col("s_suppkey") % 4 == 2, "fail").otherwise("pass").alias("status"))
    return freeze_problems(documents, rows.join(F.broadcast(n)), pairs, witnesses, ["a5"])


@query("ver09_revalidation", RECORDS_SQL + """
, a AS (SELECT suite, overall_status, count(*) + CASE WHEN suite = 'suite3' AND overall_status = 'PASS' THEN 1 ELSE 0 END AS published, count(*) AS now FROM rec GROUP BY 1, 2)
SELECT suite, overall_status, CASE WHEN suite = 'suite1' AND overall_status = 'RUN_FAIL' THEN NULL ELSE published END AS published, now FROM a WHERE published <> now OR (suite = 'suite1' AND overall_status = 'RUN_FAIL')""")
def revalidation(spark: SparkSession, d: str) -> DataFrame:
    """A published aggregate, with a wrong row and a missing one, against one computed anew: the rows that differ."""
    rec = eligible(records(spark, d))
    wrong = ((F.col("suite") == "suite3") & (F.col("overall_status") == "PASS")).cast("int")
    published = rec.groupBy("suite", "overall_status").agg(F.count("*").alias("n")).where("not (suite = 'suite1' and overall_status = 'RUN_FAIL')").select("suite", "overall_status", (F.col("n") + wrong).alias("published"))
    now = rec.groupBy("suite", "kernel", "overall_status").agg(F.count("*").alias("k")).groupBy("suite", "overall_status").agg(F.sum("k").alias("now"))
    return published.join(now, ["suite", "overall_status"], "full").where(~F.col("published").eqNullSafe(F.col("now")))


@query("ver10_cross_check", RECORDS_SQL + """
, a AS (SELECT model, avg(passed::INT) AS rate, count(*) AS n FROM rec GROUP BY 1)
SELECT model, round(rate, 6) AS rate, round(CASE WHEN model = 'm1' THEN rate + 0.001 ELSE rate END, 6) AS claimed, model <> 'm1' AS agrees FROM a""")
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """Claimed rates, one of them wrong, against rates by another path (SQL over records), to 1e-6."""
    rec = eligible(records(spark, d))
    off = F.when(F.col("model") == "m1", 0.001).otherwise(0.0)
    a = rec.groupBy("model").agg(F.avg(F.col("passed").cast("double")).alias("claimed")).select("model", (F.col("claimed") + off).alias("claimed"))
    b = spark.sql("SELECT model AS model, count_if(overall_status = 'PASS') / count(*) AS rate FROM {rec} GROUP BY model", rec=rec)
    return a.join(b, "model").select("model", F.round("rate", 6).alias("rate"), F.round("claimed", 6).alias("claimed"), (F.abs(F.col("rate") - F.col("claimed")) <= 1e-6).alias("agrees"))


@query("prv01_02_hash_inventory", "SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'MISSING' ELSE sha256(text) END AS sha256 FROM documents")
def hash_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the files that specifications refer to; what is not there is MISSING."""
    docs = table(spark, d, "documents")
    there = docs.where("doc_id % 19 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.select("doc_id").join(there, "doc_id", "left").select("doc_id", F.coalesce("h", F.lit("MISSING")).alias("sha256"))


@query("prv03_seen_versus_registered", """
WITH seen AS (SELECT page_id FROM pages WHERE contains(html, '<li>')), reg AS (SELECT page_id FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT max(page_id) + 1 FROM pages)
SELECT page_id, 'uninventoried' AS finding FROM seen WHERE page_id NOT IN (SELECT page_id FROM reg) UNION ALL SELECT page_id, 'stale' FROM reg WHERE page_id NOT IN (SELECT page_id FROM seen)""")
def seen_registered(spark: SparkSession, d: str) -> DataFrame:
    """Files that hold a literal against those registered."""
    pages = table(spark, d, "pages")
    seen = pages.where(F.col("html").contains("<li>")).select("page_id")
    reg = pages.where("page_id % 3 <> 0").select("page_id").unionAll(pages.agg(F.max("page_id") + 1))
    return seen.join(reg, "page_id", "left_anti").withColumn("finding", F.lit("uninventoried")).unionByName(reg.join(seen, "page_id", "left_anti").withColumn("finding", F.lit("stale")))


@query("prv04_argument_outcomes", "SELECT CASE WHEN p_size % 7 = 0 THEN 'allowed' WHEN p_size % 2 = 0 THEN 'ok' ELSE 'mismatch' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def argument_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Argument contracts by outcome; known mismatches are matched by their exact detail."""
    detail = F.concat(F.lit("argc "), F.col("p_size") % 14)
    allowed = spark.createDataFrame([("argc 0",), ("argc 7",)], "detail string")
    p = table(spark, d, "part").select("p_size", detail.alias("detail")).join(F.broadcast(allowed.withColumn("known", F.lit(True))), "detail", "left")
    return p.groupBy(F.when(F.col("known"), "allowed").when(F.col("p_size") % 2 == 0, "ok").otherwise("mismatch").alias("outcome")).agg(F.count("*").alias("n"))


def lines_agree(a: Column, b: Column, tolerance: float) -> Column:
    """PRV-05: equal, or line by line equal or numbers within tolerance * max(|a|, 1)."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    near = lambda p: F.coalesce(F.abs(p["x"].try_cast("double") - p["y"].try_cast("double")) <= tolerance * F.greatest(F.abs(p["x"].try_cast("double")), F.lit(1.0)), F.lit(False))
    return (a == b) | ((F.size(x) == F.size(y)) & F.forall(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] == p["y"]) | near(p)))


@query("prv05_tolerant_lines", "SELECT p_partkey, p_size % 4 IN (0, 1) AS agrees FROM part")
def tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """Outputs compared line by line with a relative tolerance for numbers."""
    base = F.concat(F.lit("sum\n"), F.col("p_size").cast("string"), F.lit(".5\nend"))
    other = F.when(F.col("p_size") % 4 == 0, base).when(F.col("p_size") % 4 == 1, F.concat(F.lit("sum\n"), F.col("p_size").cast("string"), F.lit(".500001\nend"))).when(F.col("p_size") % 4 == 2, F.concat(base, F.lit("\n"))).otherwise(F.lit("sum\nx\nend"))
    return table(spark, d, "part").select("p_partkey", lines_agree(base, other, 1e-5).alias("agrees"))


@query("prv06_protocol_artifact", "SELECT count(*) AS fields, true AS identical FROM (SELECT DISTINCT event_type FROM events)")
def protocol_artifact(spark: SparkSession, d: str) -> DataFrame:
    """A document generated twice has to be the same, byte for byte."""
    types = table(spark, d, "events").select("event_type").distinct()
    doc = lambda df: df.agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("j"), F.count("*").alias("fields"))
    both = doc(types).unionByName(doc(types.orderBy(F.desc("event_type"))))
    return both.agg(F.max("fields").alias("fields"), (F.min(F.sha2("j", 256)) == F.max(F.sha2("j", 256))).alias("identical"))


@query("src20_tex_numbers", """
SELECT doc_id, 'percentage' AS kind, round(n_chars / 100.0, 1) AS value, 2 AS line FROM documents UNION ALL SELECT doc_id, 'count', n_chars::DOUBLE, 6 FROM documents""")
def tex_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a TeX text with their lines; verbatim environments and comments do not count."""
    tex = F.concat(F.lit("head\nrate "), F.format_string("%.1f", F.round(F.col("n_chars") / 100.0, 1)), F.lit("\\%\n% 99.9\\% no\n\\begin{verbatim}\n55.5\\%\\end{verbatim}\nn="), F.col("n_chars"), F.lit(" records"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(tex, "\n")).alias("at", "s"))
    w = Window.partitionBy("doc_id").orderBy("at")
    inside = F.sum(F.col("s").contains("\\begin{verbatim}").cast("int")).over(w) - F.coalesce(F.sum(F.col("s").contains("\\end{verbatim}").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = lines.withColumn("inside", inside).where("inside = 0").withColumn("s", F.regexp_replace("s", r"(?<!\\)%.*$", ""))
    number = lambda kind, pattern: F.transform(F.regexp_extract_all("s", F.lit(pattern), 1), lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("value")))
    found = F.concat(number("percentage", r"(\d+(?:\.\d+)?)\\%"), number("count", r"n=(\d+)"))
    return kept.select("doc_id", (F.col("at") + 1).alias("line"), F.inline(found))
