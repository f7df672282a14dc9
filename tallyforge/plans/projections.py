"""Projections, row functions and filters (SURVEY PRJ, FLT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import ids
from tallyforge.plans.registry import query
from tallyforge.sources.records import INELIGIBLE, RECORDS_SQL, eligible, records, table


@query("prj01_04_spec_identity", RECORDS_SQL + """
SELECT DISTINCT target_spec, split_part(target_spec, '-', 1) AS suite, 'k' || regexp_extract(target_spec, '-k([0-9]+)-', 1) AS kernel,
       regexp_extract(target_spec, '[^-]+$') AS api, source_api || '-to-' || target_api AS direction FROM rec""")
def spec_identity(spark: SparkSession, d: str) -> DataFrame:
    """Suite, kernel, API and direction parsed from specification ids alone."""
    t = F.col("target_spec")
    found = eligible(records(spark, d)).select("target_spec", ids.suite_of(t).alias("suite"), ids.kernel_of(t).alias("kernel"), ids.api_of(t).alias("api"), ids.direction_of(F.lit(""), F.col("source_spec"), t).alias("direction"))
    return found.distinct()


@query("prj05_level_sample_from_stem", RECORDS_SQL + """
SELECT CASE WHEN augment_level > 0 THEN 'x-L' || augment_level ELSE 'x' END || CASE WHEN record_id % 2 = 0 THEN '-s' || sample_id ELSE '' END AS stem,
       augment_level AS level, CASE WHEN record_id % 2 = 0 THEN sample_id END AS sample, count(*) AS n FROM rec GROUP BY 1, 2, 3""")
def level_sample(spark: SparkSession, d: str) -> DataFrame:
    """Level and sample read back from file stems."""
    stem = F.concat(F.when(F.col("augment_level") > 0, F.concat(F.lit("x-L"), "augment_level")).otherwise("x"), F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("-s"), "sample_id")).otherwise(""))
    rows = eligible(records(spark, d)).select(stem.alias("stem"))
    return rows.select("stem", ids.level_of_stem(F.col("stem")).alias("level"), ids.sample_of_stem(F.col("stem")).alias("sample")).groupBy("stem", "level", "sample").agg(F.count("*").alias("n"))


@query("prj06_07_parent_backfill", RECORDS_SQL + """
, replay AS (SELECT record_id, CASE WHEN record_id % 3 = 0 THEN '' WHEN record_id % 3 = 1 THEN NULL ELSE model END AS top_model, model AS parent_model,
                    CASE WHEN record_id % 2 = 0 THEN prompt_tokens END AS tokens, record_id - record_id % 2 AS input_id FROM rec)
SELECT r.record_id, CASE WHEN coalesce(top_model, '') = '' THEN parent_model ELSE top_model END AS model, coalesce(r.tokens, s.prompt_tokens) AS tokens
FROM replay r LEFT JOIN allrec s ON s.record_id = r.input_id""")
def parent_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Identity promoted from the parent, tokens filled in from the referenced record."""
    rec = records(spark, d)
    replay = eligible(rec).select(
        "record_id", F.when(F.col("record_id") % 3 == 0, "").when(F.col("record_id") % 3 == 2, F.col("model")).alias("top_model"), F.struct("model").alias("parent"),
        F.when(F.col("record_id") % 2 == 0, F.col("prompt_tokens")).alias("tokens"), (F.col("record_id") - F.col("record_id") % 2).alias("input_id"),
    )
    submitted = rec.select(F.col("record_id").alias("input_id"), F.col("prompt_tokens").alias("submitted"))
    return replay.join(submitted, "input_id", "left").select("record_id", ids.first_set(F.col("top_model"), F.col("parent.model")).alias("model"), F.coalesce("tokens", "submitted").alias("tokens"))


def attempts() -> Column:
    """Attempts of a record: what failed first, and for every third record a passing repair."""
    stage = lambda s: F.when(F.col("overall_status") == s, "FAIL").otherwise("PASS")
    first = F.struct((F.col("overall_status") == "EXTRACTION_FAIL").alias("extraction_fail"), stage("BUILD_FAIL").alias("build"), stage("RUN_FAIL").alias("run"), stage("VERIFY_FAIL").alias("verify"))
    repair = F.struct(F.lit(False).alias("extraction_fail"), F.lit("PASS").alias("build"), F.lit("PASS").alias("run"), F.lit("PASS").alias("verify"))
    return F.when((F.col("record_id") % 3 == 0) & ~F.col("passed"), F.array(first, repair)).otherwise(F.array(first))


def attempt_status(a: Column) -> Column:
    """PRJ-08: extraction, then build, run and verification decide an attempt."""
    return (
        F.when(a.isNull(), "UNKNOWN").when(a["extraction_fail"], "EXTRACTION_FAIL").when(a["build"] != "PASS", "BUILD_FAIL")
        .when(a["run"] != "PASS", "RUN_FAIL").when(a["verify"] != "PASS", "VERIFY_FAIL").otherwise("PASS")
    )


@query("prj08_initial_attempt_status", RECORDS_SQL + "SELECT overall_status AS initial_status, count(*) AS n, count(*) FILTER (WHERE record_id % 3 = 0 AND NOT passed) AS repaired FROM rec GROUP BY 1")
def initial_attempt(spark: SparkSession, d: str) -> DataFrame:
    """The status of the first attempt, and how many records a later attempt repaired."""
    rows = eligible(records(spark, d)).withColumn("attempts", attempts())
    first, last = attempt_status(F.col("attempts")[0]), attempt_status(F.element_at("attempts", -1))
    return rows.select(first.alias("initial_status"), ((first != "PASS") & (last == "PASS")).alias("fixed")).groupBy("initial_status").agg(F.count("*").alias("n"), F.count_if("fixed").alias("repaired"))


@query("prj09_17_keys_and_seeds", RECORDS_SQL + """
SELECT record_id, model || '|' || source_spec || '|' || target_spec || '|L' || augment_level || '|s' || sample_id AS key,
       (('0x' || left(sha256(source_spec || '|' || target_spec || '|' || sample_id), 8))::BIGINT & 2147483647) AS seed FROM rec""")
def keys_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Composite record keys and deterministic sampling seeds."""
    c = {x: F.col(x) for x in ("model", "source_spec", "target_spec", "augment_level", "sample_id")}
    return eligible(records(spark, d)).select("record_id", ids.record_key(*c.values()).alias("key"), ids.seed31(c["source_spec"], c["target_spec"], c["sample_id"]).alias("seed"))


@query("prj10_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    """A path of a semi-structured document; a missing one is null."""
    doc = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(doc, "$.k", "bigint").alias("k"), F.try_variant_get(doc, "$.missing", "string").alias("missing"))


@query("prj10_derivations", RECORDS_SQL + """
, m AS (SELECT model, avg(passed::INT) AS rate FROM rec GROUP BY 1)
SELECT (SELECT count(*) FROM m) AS len, (SELECT round(max(rate) - min(rate), 6) FROM m) AS diff,
       (SELECT round(max(abs(rate - (SELECT rate FROM m WHERE model = 'm0'))), 6) FROM m) AS max_abs_gap""")
def derivations(spark: SparkSession, d: str) -> DataFrame:
    """The derivations len, diff and max_abs_gap over an array of entries."""
    m = eligible(records(spark, d)).groupBy("model").agg(F.avg(F.col("passed").cast("int")).alias("rate"))
    entries = m.agg(F.array_sort(F.collect_list(F.struct("model", "rate"))).alias("e"))
    rates = F.transform("e", lambda x: x["rate"])
    return entries.select(F.size("e").cast("long").alias("len"), F.round(F.array_max(rates) - F.array_min(rates), 6).alias("diff"), F.round(F.array_max(F.transform(rates, lambda r: F.abs(r - F.col("e")[0]["rate"]))), 6).alias("max_abs_gap"))


def scalar(doc: Column, path: str) -> Column:
    """PRJ-10: the number at a path, or in the member ``value`` of an object there; null if there is neither."""
    return F.coalesce(F.try_variant_get(doc, f"{path}.value", "double"), F.try_variant_get(doc, path, "double"))


def required(value: Column, what: str) -> Column:
    """PRJ-10: the value; the query stops where it is missing."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"no value: {what}")).cast("double"))


def derived(doc: Column, recipe: dict) -> Column:
    """PRJ-10: a derivation over a document, as text: len, diff, max_abs_gap (a component of the entry, if ``field`` is given), index_field, top_n_items."""
    op, path = recipe["op"], recipe.get("path", "$")
    entries = F.try_variant_get(doc, path, "array<map<string,double>>")
    if op == "len":
        return F.coalesce(F.size(F.try_variant_get(doc, path, "array<variant>")), F.size(F.try_variant_get(doc, path, "map<string,variant>"))).cast("string")
    if op == "diff":
        return F.round(scalar(doc, recipe["minuend"]) - scalar(doc, recipe["subtrahend"]), 6).cast("string")
    if op == "max_abs_gap":
        gap = lambda x: F.abs(x[recipe["forward"]] - x[recipe["reverse"]])
        widest = F.array_max(F.transform(entries, gap))
        best = F.get(F.filter(entries, lambda x: gap(x) == widest), F.lit(0))  # the first of equal ones
        return F.round(best[recipe["field"]] if recipe.get("field") else best[recipe["forward"]] - best[recipe["reverse"]], 6).cast("string")
    if op == "index_field":
        return F.get(entries, F.lit(recipe["index"]))[recipe["field"]].cast("string")
    if op == "top_n_items":
        pairs = F.map_entries(F.try_variant_get(doc, path, "map<string,long>"))
        order = F.array_sort(F.transform(pairs, lambda x: F.struct((-x["value"]).alias("n"), x["key"].alias("k"))))
        return F.array_join(F.transform(F.slice(order, 1, recipe["n"]), lambda x: F.concat(x["k"], F.lit("="), (-x["n"]).cast("string"))), ",")
    raise ValueError(f"unknown derivation op: {op!r}")


@query("prj10_derivation_recipes", """
SELECT p_partkey, op, value FROM (SELECT p_partkey, p_size AS s FROM part), LATERAL (VALUES ('len', '3'), ('diff', CASE WHEN s % 3 = 0 THEN NULL ELSE ((s + 1.5) - s)::DOUBLE::VARCHAR END),
 ('max_abs_gap', (CASE WHEN s >= 20 THEN s::DOUBLE ELSE -20.0::DOUBLE END)::VARCHAR), ('max_abs_gap.field', (CASE WHEN s >= 20 THEN s + 1.0::DOUBLE ELSE 0.0::DOUBLE END)::VARCHAR), ('index_field', (s + 1.0::DOUBLE)::VARCHAR), ('index_field.beyond', NULL),
 ('top_n_items', CASE WHEN s > 7 THEN 'build=' || s || ',alpha=7' WHEN s = 7 THEN 'alpha=7,build=7' ELSE 'alpha=7,run=7' END), ('required', (s + 1.5)::DOUBLE::VARCHAR)) t(op, value)""")
def derivation_recipes(spark: SparkSession, d: str) -> DataFrame:
    """All derivations over a document of each part; metrics may be numbers or objects with a value, and one may be missing."""
    s = F.col("p_size").cast("string")
    second = F.when(F.col("p_size") % 3 == 0, '"b": {"n": 1}').otherwise(F.concat(F.lit('"b": '), s))
    text = F.concat(
        F.lit('{"a": {"value": '), s, F.lit('.0, "n": 2}, "c": {"value": '), (F.col("p_size") + 1.5).cast("string"), F.lit("}, "), second, F.lit(', "gaps": [{"f": '), s, F.lit('.5, "r": 0.5, "p": '), (F.col("p_size") + 1).cast("string"),
        F.lit('}, {"f": 0, "r": 20, "p": 0}, {"f": 3, "r": 3, "p": 9}], "kinds": {"run": 7, "build": '), s, F.lit(', "alpha": 7}}'),
    )
    gap = {"op": "max_abs_gap", "path": "$.gaps", "forward": "f", "reverse": "r"}
    recipes = {
        "len": {"op": "len", "path": "$.gaps"}, "diff": {"op": "diff", "minuend": "$.c", "subtrahend": "$.b"}, "max_abs_gap": gap, "max_abs_gap.field": gap | {"field": "p"},
        "index_field": {"op": "index_field", "path": "$.gaps", "index": 0, "field": "p"}, "index_field.beyond": {"op": "index_field", "path": "$.gaps", "index": 3, "field": "p"}, "top_n_items": {"op": "top_n_items", "path": "$.kinds", "n": 2},
    }
    docs = table(spark, d, "part").select("p_partkey", F.parse_json(text).alias("doc"))
    made = [F.struct(F.lit(k).alias("op"), derived(F.col("doc"), r).alias("value")) for k, r in recipes.items()]
    made.append(F.struct(F.lit("required").alias("op"), required(scalar(F.col("doc"), "$.c"), "c").cast("string").alias("value")))
    return docs.select("p_partkey", F.inline(F.array(*made)))


def token_bound(size: Column, messages: int, bytes_per_token: float = 1.0, overhead: int = 8) -> Column:
    """PRJ-20: no fewer tokens than a prompt of so many UTF-8 bytes can have; a token covers a byte at least."""
    if not 0 < bytes_per_token <= 1 or overhead < 8:
        raise ValueError("more than one byte a token, or less than 8 tokens a message, is no upper bound")
    return F.ceil(size / bytes_per_token).cast("long") + overhead * messages


@query("prj19_20_usage_and_budget", """
SELECT event_id, event_id % 4096 + 1 AS prompt, CAST(round(value * 100) AS BIGINT) AS completion, event_id % 4096 + 1 + CAST(round(value * 100) AS BIGINT) AS total,
       strlen(props) + 16 AS bound, greatest(0, least(2048, 4096 - (event_id % 4096 + 1))) AS cap FROM events""")
def usage(spark: SparkSession, d: str) -> DataFrame:
    """Three providers' usage fields as one shape; token bound of a request and cap of its completion."""
    e = table(spark, d, "events")
    prompt, completion = F.col("event_id") % 4096 + 1, F.round(F.col("value") * 100).cast("long")
    pair = lambda a, b: F.create_map(F.lit(a), prompt, F.lit(b), completion)
    shapes = F.when(F.col("event_id") % 3 == 0, pair("prompt_tokens", "completion_tokens")).when(F.col("event_id") % 3 == 1, pair("input_tokens", "output_tokens")).otherwise(pair("promptTokenCount", "candidatesTokenCount"))
    u = e.select("event_id", "props", shapes.alias("usage"))
    first = lambda *names: F.coalesce(*[F.try_element_at("usage", F.lit(x)) for x in names])
    u = u.select("event_id", "props", first("prompt_tokens", "input_tokens", "promptTokenCount").alias("prompt"), first("completion_tokens", "output_tokens", "candidatesTokenCount").alias("completion"))
    checked = F.when((F.col("prompt") < 0) | F.col("prompt").isNull(), F.raise_error(F.lit("unknown usage shape")).cast("long")).otherwise(F.col("prompt"))
    bound = token_bound(F.octet_length("props"), 2)
    return u.select("event_id", checked.alias("prompt"), "completion", (F.col("prompt") + F.col("completion")).alias("total"), bound.alias("bound"), F.greatest(F.lit(0).cast("long"), F.least(F.lit(2048).cast("long"), 4096 - F.col("prompt"))).alias("cap"))


#: USD per million tokens (input, output).
PRICES = {"m0": (0.6, 3.6), "m1": (1.25, 10.0)}


def priced(df: DataFrame) -> DataFrame:
    """PRJ-21: the cost of each record, null for a model without a price; the price list is a constant of a few rows."""
    prices = df.sparkSession.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, price_in double, price_out double")
    return df.join(F.broadcast(prices), "model", "left").withColumn("cost", (F.col("prompt_tokens") * F.col("price_in") + F.col("completion_tokens") * F.col("price_out")) / 1e6)


PRICES_SQL = "(VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in PRICES.items()) + ") p(model, price_in, price_out)"


@query("prj21_record_cost", RECORDS_SQL + f"SELECT record_id, rec.model, round((prompt_tokens * price_in + completion_tokens * price_out) / 1e6, 8) AS cost FROM rec LEFT JOIN {PRICES_SQL} ON p.model = rec.model")
def record_cost(spark: SparkSession, d: str) -> DataFrame:
    """What each record cost."""
    return priced(eligible(records(spark, d))).select("record_id", "model", F.round("cost", 8).alias("cost"))


@query("prj21_unpriced_models", RECORDS_SQL + f"SELECT model, count(*) AS n FROM rec WHERE model NOT IN (SELECT model FROM {PRICES_SQL}) GROUP BY 1")
def unpriced(spark: SparkSession, d: str) -> DataFrame:
    """Models that no price is known of."""
    rows = eligible(records(spark, d))
    known = spark.createDataFrame([(m,) for m in PRICES], "model string")
    return rows.join(F.broadcast(known), "model", "left_anti").groupBy("model").agg(F.count("*").alias("n"))


@query("prj22_argc_consistency", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'SKIP' WHEN op = '==' AND argc <> n THEN 'MISMATCH' WHEN op = '<' AND argc < n THEN 'MISMATCH'
  WHEN op = '<=' AND argc <= n THEN 'MISMATCH' ELSE 'OK' END AS outcome
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 6 AS n, l_linenumber AS argc, ['==', '<', '<=', '>', '!='][CAST(l_partkey % 5 + 1 AS INT)] AS raw,
             CASE WHEN raw = '!=' THEN '==' ELSE raw END AS op FROM lineitem)""")
def argc(spark: SparkSession, d: str) -> DataFrame:
    """Argument counts that a source text checks for against those that a run passes."""
    ops = F.element_at(F.array(*map(F.lit, ("==", "<", "<=", ">", "!="))), (F.col("l_partkey") % 5 + 1).cast("int"))
    source = F.concat(F.lit("if (argc "), ops, F.lit(" "), F.col("l_quantity").cast("int") % 6, F.lit(") { usage(); }"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", source.alias("source"), F.col("l_linenumber").alias("argc"))
    pattern = r"argc\s*(==|!=|<=|>=|<|>)\s*(\d+)"
    checks = F.arrays_zip(F.regexp_extract_all("source", F.lit(pattern), 1).alias("op"), F.regexp_extract_all("source", F.lit(pattern), 2).alias("n"))
    argc_ = F.col("argc")

    def fails(x: Column) -> Column:
        n = x["n"].cast("int")
        return ((x["op"].isin("==", "!=")) & (argc_ != n)) | ((x["op"] == "<") & (argc_ < n)) | ((x["op"] == "<=") & (argc_ <= n))

    return li.select("l_orderkey", "l_linenumber", F.when(argc_ == 7, "SKIP").when(F.exists(checks, fails), "MISMATCH").otherwise("OK").alias("outcome"))


@query("prj23_resume_disposition", RECORDS_SQL + """
SELECT CASE WHEN record_id % 7 = 0 THEN 'retry-registry' WHEN overall_status = 'EXTRACTION_FAIL' THEN 'retry-status' ELSE 'skip' END AS disposition, count(*) AS n FROM rec GROUP BY 1""")
def resume(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed campaign does with each stored record."""
    registry = F.when(F.col("record_id") % 7 == 0, "old").otherwise("current")
    what = F.when(registry != "current", "retry-registry").when(F.col("overall_status").isin("ERROR", "EXTRACTION_FAIL", "PROVIDER_ERROR"), "retry-status").otherwise("skip")
    return eligible(records(spark, d)).groupBy(what.alias("disposition")).agg(F.count("*").alias("n"))


@query("prj24_28_complexity_and_kernel_only", """
SELECT p_partkey, CASE WHEN s <= 1 AND t <= 1 THEN '1:1' WHEN s <= 1 THEN '1:N' WHEN t <= 1 THEN 'N:1' ELSE 'N:M' END AS complexity, t > 0 AND p_size % 2 = 0 AS kernel_only
FROM (SELECT p_partkey, p_size, p_size % 3 AS s, p_size % 4 AS t FROM part)""")
def complexity(spark: SparkSession, d: str) -> DataFrame:
    """The N:M class of a translation by its file lists, and whether all targets are device files."""
    name = lambda ext: lambda i: F.concat(F.lit("f"), i, ext)
    files = lambda n, ext: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), name(ext))).otherwise(F.array().cast("array<string>"))
    p = table(spark, d, "part").select("p_partkey", files(F.col("p_size") % 3, F.lit(".cu")).alias("s"), files(F.col("p_size") % 4, F.when(F.col("p_size") % 2 == 0, ".cl").otherwise(".cpp")).alias("t"))
    one_s, one_t = F.size("s") <= 1, F.size("t") <= 1
    kind = F.when(one_s & one_t, "1:1").when(one_s, "1:N").when(one_t, "N:1").otherwise("N:M")
    return p.select("p_partkey", kind.alias("complexity"), ((F.size("t") > 0) & F.forall("t", lambda x: x.endswith(".cl"))).alias("kernel_only"))


def strategies(key: Column) -> Column:
    """An oracle's strategies, by a number."""
    made = lambda kind, pattern: F.struct(F.lit(kind).alias("type"), F.lit(pattern).alias("pattern"))
    return (
        F.when(key % 5 == 0, F.array(made("exit_code", None), made("numeric_comparison", r"err=([\d.]+)")))
        .when(key % 5 == 1, F.array(made("exit_code", None), made("stdout_pattern", "(?i)test passed")))
        .when(key % 5 == 2, F.array(made("stdout_exclude_pattern", "PASSED"), made("stdout_pattern", "Kernel time")))
        .when(key % 5 == 3, F.array(made("file_hash", None))).otherwise(F.array(made("exit_code", None)))
    )


#: Fixed value: what a pattern says where a program judges itself.
SELF_CHECK = r"(?i)\bpass\b|passed|verif|correct|match|\bok\b|success"


def oracle_shape(s: Column) -> Column:
    """PRJ-25: numbers or hashes, a program that checks itself (by its first positive pattern), or a banner at most."""
    pattern = F.filter(s, lambda x: (x["type"] == "stdout_pattern") & (x["pattern"] != ""))
    checks = F.coalesce(F.try_element_at(pattern, F.lit(1))["pattern"].rlike(SELF_CHECK), F.lit(False))
    return F.when(F.exists(s, lambda x: x["type"].isin("numeric_comparison", "file_hash")), "numeric/hash").when(checks, "self-checking").otherwise("banner-only")


def oracle_strength(s: Column) -> Column:
    """PRJ-25: an independent comparison, a number that the program reports, or less."""
    has = lambda *kinds: F.exists(s, lambda x: x["type"].isin(*kinds))
    return F.when(has("file_hash", "file_diff"), "strong").when(has("numeric_comparison"), "medium").otherwise("weak")


@query("prj25_oracle_shape", """
SELECT CASE WHEN p_partkey % 5 IN (0, 3) THEN 'numeric/hash' WHEN p_partkey % 5 = 1 THEN 'self-checking' ELSE 'banner-only' END AS shape, CASE p_partkey % 5 WHEN 3 THEN 'strong' WHEN 0 THEN 'medium' ELSE 'weak' END AS strength, count(*) AS n FROM part GROUP BY 1, 2""")
def oracle_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shape and strength of every oracle."""
    s = table(spark, d, "part").select(strategies(F.col("p_partkey")).alias("s"))
    return s.groupBy(oracle_shape(F.col("s")).alias("shape"), oracle_strength(F.col("s")).alias("strength")).agg(F.count("*").alias("n"))


@query("prj30_31_rates_with_provenance", RECORDS_SQL + "SELECT 'pass_rate.' || model AS claim, round(avg(passed::INT), 4) AS value, 'events' AS source, 'count_if(PASS) / count' AS derivation, count(*) AS n FROM rec GROUP BY model")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Values wrapped with their source, derivation and population."""
    made = eligible(records(spark, d)).groupBy("model").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    wrapped = F.struct(F.round(F.coalesce(F.try_divide("c", "n"), F.lit(0.0)), 4).alias("value"), F.lit("events").alias("source"), F.lit("count_if(PASS) / count").alias("derivation"), "n")
    return made.select(F.concat(F.lit("pass_rate."), "model").alias("claim"), wrapped.alias("w")).select("claim", "w.*")


@query("flt01_temperature_split", RECORDS_SQL + "SELECT CASE WHEN coalesce(CASE WHEN record_id % 4 < 2 THEN (record_id % 4)::DOUBLE END, 0) = 0 THEN 'deterministic' ELSE 'stochastic' END AS kind, count(*) AS n FROM rec GROUP BY 1")
def temperature(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic (temperature 0 or none) and stochastic records."""
    t = F.when(F.col("record_id") % 4 < 2, (F.col("record_id") % 4).cast("double"))
    return eligible(records(spark, d)).groupBy(F.when(F.coalesce(t, F.lit(0.0)) == 0, "deterministic").otherwise("stochastic").alias("kind")).agg(F.count("*").alias("n"))


@query("flt02_eligibility", RECORDS_SQL + "SELECT (SELECT count(*) FROM allrec) AS total, (SELECT count(*) FROM rec) AS valid, (SELECT count(*) FROM allrec) - (SELECT count(*) FROM rec) AS excluded")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Records with and without an excluded specification, in one pass."""
    valid = ~F.col("source_spec").isin(*INELIGIBLE) & ~F.col("target_spec").isin(*INELIGIBLE)
    return records(spark, d).agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("excluded"))


def record_filter(df: DataFrame, level: int | None = None, suite: str | None = None, direction: str | None = None, samples_only: bool = False) -> DataFrame:
    """FLT-03: filters that compose; each reaches the scan."""
    if level is not None:
        df = df.where(F.coalesce("augment_level", F.lit(0)) == level)
    if suite:
        df = df.where(F.col("suite") == suite)
    if direction:
        df = df.where(F.col("direction") == direction)
    return df.where("sample_id is not null") if samples_only else df


@query("flt03_05_composed_filters", RECORDS_SQL + "SELECT record_id, model, kernel, overall_status FROM rec WHERE augment_level = 0 AND suite = 'suite2' AND direction = 'cuda-to-omp' AND sample_id IS NOT NULL")
def composed(spark: SparkSession, d: str) -> DataFrame:
    """Level, suite, direction and sample filters together."""
    return record_filter(eligible(records(spark, d)), 0, "suite2", "cuda-to-omp", True).select("record_id", "model", "kernel", "overall_status")


def canonical_l0(df: DataFrame, base: Column) -> DataFrame:
    """FLT-04: base rows of level 0 if there is any, else those of sample 0."""
    l0 = df.where("augment_level = 0").withColumn("_base", base)
    some = l0.agg(F.coalesce(F.bool_or("_base"), F.lit(False)).alias("_some"))
    return l0.crossJoin(F.broadcast(some)).where(F.when(F.col("_some"), F.col("_base")).otherwise(F.col("sample_id") == 0)).drop("_base", "_some")


@query("flt04_canonical_l0", RECORDS_SQL + "SELECT 'fallback' AS kind, count(*) AS n FROM rec WHERE augment_level = 0 AND sample_id = 0 UNION ALL SELECT 'base', count(*) FROM rec WHERE augment_level = 0 AND record_id % 5 = 0")
def canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical level-0 rows, with and without base rows to be found."""
    rec = eligible(records(spark, d))
    without, having = canonical_l0(rec, F.lit(False)), canonical_l0(rec, F.col("record_id") % 5 == 0)
    return without.agg(F.lit("fallback").alias("kind"), F.count("*").alias("n")).unionByName(having.agg(F.lit("base").alias("kind"), F.count("*").alias("n")))


@query("flt06_balanced_subset", RECORDS_SQL + """
SELECT kernel, model, count(*) AS n FROM rec WHERE (kernel, model) IN
 (SELECT kernel, model FROM rec GROUP BY 1, 2 HAVING count(DISTINCT augment_level) = (SELECT count(DISTINCT augment_level) FROM rec)) GROUP BY 1, 2""")
def balanced(spark: SparkSession, d: str) -> DataFrame:
    """Kernel and model groups that have every level there is (relational division)."""
    rec = eligible(records(spark, d))
    every = rec.agg(F.array_sort(F.collect_set("augment_level")).alias("every"))
    own = rec.groupBy("kernel", "model").agg(F.array_sort(F.collect_set("augment_level")).alias("own"), F.count("*").alias("n"))
    return own.join(F.broadcast(every), F.col("own") == F.col("every")).select("kernel", "model", "n")


@query("flt07_sweep_selection", RECORDS_SQL + """
SELECT DISTINCT suite, kernel FROM rec WHERE (suite, kernel) IN (SELECT suite, kernel FROM rec WHERE passed) AND kernel NOT IN ('k2', 'k3')""")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Curated units of a sweep, without known failures."""
    rec = eligible(records(spark, d))
    failing = spark.createDataFrame([("k2",), ("k3",)], "kernel string")
    units = rec.select("suite", "kernel").distinct()
    return units.join(rec.where("passed").select("suite", "kernel").distinct(), ["suite", "kernel"], "left_semi").join(F.broadcast(failing), "kernel", "left_anti")


@query("flt08_path_safety", """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'absolute' WHEN page_id % 4 = 1 THEN 'escapes root' WHEN page_id % 4 = 2 THEN 'sealed' ELSE '' END AS reasons FROM pages""")
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    """Reasons not to write to a path: absolute, outside the root, in a sealed namespace."""
    path = F.element_at(F.array(*map(F.lit, ("/etc/x", "a/../../x", "results/sealed/x", "results/open/x"))), (F.col("page_id") % 4 + 1).cast("int"))
    climbs = F.aggregate(
        F.split("path", "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, s: F.struct((a["depth"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("depth"), F.least(a["least"], a["depth"] + F.when(s == "..", -1).otherwise(0)).alias("least")),
        lambda a: a["least"] < 0,
    )
    why = F.array_compact(F.array(F.when(F.col("path").startswith("/"), "absolute"), F.when(climbs, "escapes root"), F.when(F.col("path").startswith("results/sealed/"), "sealed")))
    return table(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", F.array_join(why, "; ").alias("reasons"))
