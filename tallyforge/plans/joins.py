"""Joins and set operations."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyforge.functions.text import strip_comments, stripped
from tallyforge.operators.collapse import all_pairs, any_sample, paired
from tallyforge.plans.registry import query
from tallyforge.sources.records import DIRECTIONS, MODELS, RECORDS_SQL, eligible, records, table


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Known specifications: (suite, kernel, api), with the repeats that the records give."""
    return records(spark, d).select("suite", "kernel", F.col("source_api").alias("api"))


@query("joi01_ordered_pairs", RECORDS_SQL + """
, m AS (SELECT DISTINCT suite, kernel, source_api AS api FROM allrec)
SELECT a.suite, a.kernel, a.api AS source_api, b.api AS target_api FROM m a JOIN m b ON a.suite = b.suite AND a.kernel = b.kernel AND a.api <> b.api""")
def ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every ordered pair of a unit's APIs; repeated manifest rows give no repeated pairs."""
    return pairs_of_apis(manifest(spark, d))


def pairs_of_apis(entries: DataFrame) -> DataFrame:
    """JOI-01: (suite, kernel, source_api, target_api) of entries (suite, kernel, api)."""
    m = entries.distinct()
    a, b = m.withColumnRenamed("api", "source_api"), m.withColumnRenamed("api", "target_api")
    return a.join(b, ["suite", "kernel"]).where("source_api <> target_api")


@query("joi02_03_classified_pairs", """
WITH s AS (SELECT p_brand AS unit, p_type AS api, min(p_partkey) AS k FROM part GROUP BY 1, 2), f AS (SELECT s.*, p_size FROM s JOIN part ON p_partkey = k)
SELECT a.unit, a.api AS source_api, b.api AS target_api, CASE WHEN a.p_size <= 25 AND b.p_size <= 25 THEN '1:1' WHEN a.p_size <= 25 THEN '1:N' WHEN b.p_size <= 25 THEN 'N:1' ELSE 'N:M' END AS class
FROM f a JOIN f b ON a.unit = b.unit AND a.api <> b.api""")
def classified_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of specifications with their class; of repeated specifications the first counts."""
    first = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    s = table(spark, d, "part").withColumn("r", first).where("r = 1").select(F.col("p_brand").alias("unit"), F.col("p_type").alias("api"), (F.col("p_size") <= 25).alias("one"))
    a, b = s.select("unit", F.col("api").alias("source_api"), F.col("one").alias("a1")), s.select("unit", F.col("api").alias("target_api"), F.col("one").alias("b1"))
    kind = F.when(F.col("a1") & F.col("b1"), "1:1").when(F.col("a1"), "1:N").when(F.col("b1"), "N:1").otherwise("N:M")
    return a.join(b, "unit").where("source_api <> target_api").select("unit", "source_api", "target_api", kind.alias("class"))


@query("joi04_task_expansion", RECORDS_SQL + """
, m AS (SELECT DISTINCT suite, kernel, source_api AS api FROM rec)
SELECT a.suite, a.kernel, 'm' || mo AS model, l AS augment_level, s AS sample_id, a.suite || '-' || a.kernel || '-cuda' AS source_spec, a.suite || '-' || a.kernel || '-omp' AS target_spec
FROM m a JOIN m b USING (suite, kernel), range(3) t1(mo), range(2) t2(l), range(3) t3(s) WHERE a.api = 'cuda' AND b.api = 'omp'""")
def task_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Tasks cuda to omp: units with both APIs x models x levels x samples. The axes are short constants, exploded."""
    m = eligible(records(spark, d)).select("suite", "kernel", F.col("source_api").alias("api")).distinct()
    unit = m.where("api = 'cuda'").join(m.where("api = 'omp'"), ["suite", "kernel"], "left_semi")
    tasks = unit.select("suite", "kernel", F.explode(F.array(*map(F.lit, MODELS))).alias("model"))
    tasks = tasks.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("augment_level")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample_id"))
    return tasks.withColumns({"source_spec": F.concat_ws("-", "suite", "kernel", F.lit("cuda")), "target_spec": F.concat_ws("-", "suite", "kernel", F.lit("omp"))})


@query("joi05_passer_expansion", RECORDS_SQL + """
, m AS (SELECT DISTINCT source_spec AS spec FROM rec)
SELECT DISTINCT source_spec, target_spec, CASE WHEN target_spec IN (SELECT spec FROM m) AND source_spec IN (SELECT spec FROM m) THEN 'task' ELSE 'skipped' END AS disposition
FROM rec WHERE passed AND augment_level = 0""")
def passer_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Passing level-0 entries whose specifications are both in the manifest; the others are reported as skipped."""
    rec = eligible(records(spark, d))
    known = rec.select(F.col("source_spec").alias("spec")).distinct()
    entry = rec.where("passed and augment_level = 0").select("source_spec", "target_spec").distinct()
    ok = entry.join(known, entry.source_spec == known.spec, "left_semi").join(known, F.col("target_spec") == known.spec, "left_semi")
    return ok.withColumn("disposition", F.lit("task")).unionByName(entry.join(ok, ["source_spec", "target_spec"], "left_anti").withColumn("disposition", F.lit("skipped")))


CELLS_SQL = ", cell AS (SELECT model, suite, kernel, direction, bool_or(passed) AS passed, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM rec GROUP BY 1, 2, 3, 4)"


@query("joi06_direction_paired_cells", RECORDS_SQL + CELLS_SQL + """
SELECT f.model, f.suite, f.kernel, f.passed AS forward, r.passed AS backward FROM cell f JOIN cell r USING (model, suite, kernel) WHERE f.direction = 'cuda-to-omp' AND r.direction = 'omp-to-cuda'""")
def paired_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells cuda-to-omp with their reverse."""
    return paired(any_sample(eligible(records(spark, d))), "cuda-to-omp", "omp-to-cuda")


@query("joi07_direction_pairs", RECORDS_SQL + """
SELECT DISTINCT least(a.direction, b.direction) AS forward, greatest(a.direction, b.direction) AS backward
FROM (SELECT DISTINCT direction, source_api s, target_api t FROM rec) a JOIN (SELECT DISTINCT direction, source_api s, target_api t FROM rec) b ON a.s = b.t AND a.t = b.s""")
def direction_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Directions whose reverse exists, once for each pair, forward by the alphabet."""
    x = eligible(records(spark, d)).select("direction", "source_api", "target_api").distinct()
    y = x.select(F.col("direction").alias("other"), F.col("source_api").alias("target_api"), F.col("target_api").alias("source_api"))
    return x.join(y, ["source_api", "target_api"]).select(F.least("direction", "other").alias("forward"), F.greatest("direction", "other").alias("backward")).distinct()


@query("joi08_gap_analysis", RECORDS_SQL + f"""
SELECT kernel, 'm' || m AS model, direction, l AS augment_level FROM (SELECT DISTINCT kernel FROM rec), range(3) t(m), range(5) u(l), (SELECT unnest([{', '.join(f"'{x}'" for x in DIRECTIONS)}]) AS direction)
EXCEPT SELECT kernel, model, direction, augment_level FROM rec""")
def gap_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Expected cells that were never observed: kernels x constant axes, minus what there is."""
    rec = eligible(records(spark, d))
    want = rec.select("kernel").distinct().select("kernel", F.explode(F.array(*map(F.lit, MODELS))).alias("model"))
    want = want.select("*", F.explode(F.array(*map(F.lit, DIRECTIONS))).alias("direction")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("augment_level"))
    return want.join(rec, ["kernel", "model", "direction", "augment_level"], "left_anti")


@query("joi09_matched_augmentation", RECORDS_SQL + """
, c AS (SELECT source_spec, target_spec, augment_level, bool_or(passed) AS passed FROM rec GROUP BY 1, 2, 3)
SELECT * FROM c WHERE (source_spec, target_spec) IN (SELECT source_spec, target_spec FROM c WHERE augment_level >= 1)""")
def matched_augmentation(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed cells of tasks that have any augmented cell."""
    key = ["source_spec", "target_spec"]
    c = eligible(records(spark, d)).groupBy(*key, "augment_level").agg(F.bool_or("passed").alias("passed"))
    return c.withColumn("top", F.max("augment_level").over(Window.partitionBy(*key))).where("top >= 1").drop("top")


@query("joi10_sloc_correlation", """
SELECT round(corr(rate, sloc), 6) AS r, count(*) AS n FROM
 (SELECT source, avg(toxic::DOUBLE) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1) JOIN
 (SELECT source, sum(len(string_split(text, chr(10))))::DOUBLE AS sloc FROM documents GROUP BY 1) USING (source) WHERE sloc > 0""")
def sloc_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Rates by group joined with lines of code, and their correlation."""
    docs = table(spark, d, "documents")
    rates = table(spark, d, "labels").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("toxic").alias("rate"))
    sloc = docs.groupBy("source").agg(F.sum(F.size(F.split("text", "\n"))).cast("double").alias("sloc")).where("sloc > 0")
    return rates.join(sloc, "source").agg(F.round(F.corr("rate", "sloc"), 6).alias("r"), F.count("*").alias("n"))


@query("joi11_spec_lookups", """
SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey IS NULL) AS no_part, count(*) FILTER (WHERE s_suppkey IS NULL) AS no_supplier, count(*) FILTER (WHERE p_partkey IS NULL OR s_suppkey IS NULL) AS unclassified
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def spec_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Facts with both their lookups; unmatched ones are counted, not dropped."""
    part = table(spark, d, "part").where("p_size > 10").select("p_partkey")
    supplier = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    j = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    no_p, no_s = F.col("p_partkey").isNull(), F.col("s_suppkey").isNull()
    return j.agg(F.count("*").alias("n"), F.count_if(no_p).alias("no_part"), F.count_if(no_s).alias("no_supplier"), F.count_if(no_p | no_s).alias("unclassified"))


@query("joi12_cross_model_agreement", RECORDS_SQL + CELLS_SQL + """
SELECT CASE WHEN a.passed IS NULL THEN 'only_m1' WHEN b.passed IS NULL THEN 'only_m0' WHEN a.passed AND b.passed THEN 'both_pass' WHEN a.passed THEN 'm0_only_pass' WHEN b.passed THEN 'm1_only_pass' ELSE 'both_fail' END AS state, count(*) AS n
FROM (SELECT * FROM cell WHERE model = 'm0') a FULL JOIN (SELECT * FROM cell WHERE model = 'm1') b USING (suite, kernel, direction) GROUP BY 1""")
def cross_model(spark: SparkSession, d: str) -> DataFrame:
    """How two models agree on the tasks both have, and the tasks only one has."""
    cells = any_sample(eligible(records(spark, d)))
    key = ["suite", "kernel", "direction"]
    a = cells.where("model = 'm0'").select(*key, F.col("passed").alias("a"))
    b = cells.where("model = 'm1'").select(*key, F.col("passed").alias("b"))
    state = (
        F.when(F.col("a").isNull(), "only_m1").when(F.col("b").isNull(), "only_m0").when(F.col("a") & F.col("b"), "both_pass")
        .when(F.col("a"), "m0_only_pass").when(F.col("b"), "m1_only_pass").otherwise("both_fail")
    )
    return a.join(b, key, "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("joi13_inventory_diff", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'OMISSION' WHEN a.doc_id IS NULL THEN 'ORPHAN' ELSE 'MISMATCH' END AS finding
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 5) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h <> b.h""")
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    """Recorded against present content hashes: what is missing, what is extra, what differs."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    a = docs.where("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("recorded"))
    b = docs.where("doc_id % 11 <> 5").select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("present"))
    found = F.when(F.col("present").isNull(), "OMISSION").when(F.col("recorded").isNull(), "ORPHAN").when(F.col("recorded") != F.col("present"), "MISMATCH")
    return a.join(b, "doc_id", "full").select("doc_id", found.alias("finding")).where("finding is not null")


def _first_near(width: float, at_once: int = 1 << 17):
    """The first entry less than ``width`` away of every asked value; rows come by group (cell and part), listed values before asked ones, in the order of entries.

    A group's listed values within reach of an asked one are a range of them once sorted, found by bisection with the test itself; its
    least place is the lesser of two of a table of minima over powers of two. Only listed values of the last group are held.
    """

    def answered(rows: pa.Table) -> pa.RecordBatch:
        cell, part, value = (rows.column(c).to_numpy() for c in ("cell", "part", "value"))
        asked = rows.column("asked").to_numpy()
        group = np.concatenate(([0], np.cumsum((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
        listed, of = np.flatnonzero(~asked), np.flatnonzero(asked)
        order = np.lexsort((value[listed], group[listed]))
        w, v = value[listed][order], value[of]
        begin, end = (np.searchsorted(group[listed], group[of], side=side) for side in ("left", "right"))

        def first(reached) -> np.ndarray:
            low, high = begin.copy(), end.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                yes = reached(v[open_], w[middle])
                high[open_[yes]] = middle[yes]
                low[open_[~yes]] = middle[~yes] + 1
            return low

        low, high = first(lambda x, y: x - y < width), first(lambda x, y: y - x >= width)
        some = np.flatnonzero(low < high)
        low, high = low[some], high[some]
        level = np.frexp(high - low)[1] - 1  # of the greatest power of two in it
        best, least = np.zeros(len(some), np.int64), order
        for k in range(level.max(initial=-1) + 1):
            now = level == k
            best[now] = np.minimum(least[low[now]], least[high[now] - (1 << k)])
            least = np.minimum(least[: -(1 << k)], least[1 << k :])
        found = np.zeros(len(of), np.int64)
        found[some] = listed[best]
        missing = np.ones(len(of), bool)
        missing[some] = False
        number, entry = (rows.column(c).combine_chunks() for c in ("number", "entry"))
        return pa.RecordBatch.from_arrays([number.take(pa.array(of)), entry.take(pa.array(found, mask=missing))], names=["number", "entry"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in itertools.chain(parts, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if not held or (batch is not None and size < at_once):
                continue
            rows = pa.Table.from_batches(held)
            if not rows.num_rows:
                continue
            yield answered(rows)
            cell, part, asked = (rows.column(c).to_numpy() for c in ("cell", "part", "asked"))
            held, size = rows.take(pa.array(np.flatnonzero((cell == cell[-1]) & (part == part[-1]) & ~asked))).to_batches(), 0

    return run


def matched_claims(found: DataFrame, known: DataFrame, claims: DataFrame, width: float = 0.15, block: int = 1 << 20) -> DataFrame:
    """JOI-14: (number, source, claim) for numbers of a text (number, kind, value) against known values and claims (position, name, kind, value).

    A percentage or interval matches the first known one that lies less than ``width`` away, a count an equal one; known
    values come before claims, and a claim below 1 is a rate and counts a hundredfold. What matches neither is unverified.
    No pairs are made: of equal listed values the first stays, each goes to its own and both neighbouring cells, somewhat wider
    than the band, and an asked value finds its first entry among those of its cell. Cells with more than ``block`` asked values are split.
    """
    listed = known.select(F.lit(0).alias("rank"), "position", "name", "kind", "value").unionByName(
        claims.select(F.lit(1).alias("rank"), "position", "name", "kind", F.when((F.col("kind") != "count") & (F.col("value") < 1), F.col("value") * 100).otherwise(F.col("value")).alias("value"))
    )
    counted, banded = F.col("kind") == "count", (F.col("kind") != "count") & (F.abs("value") < float("inf"))
    cell = F.rint(F.col("value") / (1.25 * width)) + 0.0
    entry = F.struct("rank", "position", "name").alias("entry")
    values = listed.where(counted | banded).select(counted.alias("counted"), F.col("value").cast("double").alias("value"), entry).groupBy("counted", "value").agg(F.min("entry").alias("entry"))

    asked = found.where("number is not null").select("number", "kind", F.col("value").cast("double").alias("value"))
    near = asked.where(banded).select("number", "value", cell.alias("cell"))
    crowded = F.broadcast(near.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("number", "value"), F.col("parts")).cast("int"))
    near = near.join(crowded, "cell", "left").select("cell", part.alias("part"), F.lit(True).alias("asked"), "value", "number", F.lit(None).cast(values.schema["entry"].dataType).alias("entry"))
    within = values.where("not counted").select("value", "entry", F.explode(F.array_distinct(F.array(cell - 1, cell, cell + 1))).alias("cell"))
    within = within.join(crowded, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(False).alias("asked"), "value", F.lit(None).cast(found.schema["number"].dataType).alias("number"), "entry")
    dealt = within.unionByName(near).repartition("cell", "part").sortWithinPartitions("cell", "part", "asked", "entry")
    near = dealt.mapInArrow(_first_near(width), StructType([StructField("number", found.schema["number"].dataType), StructField("entry", values.schema["entry"].dataType)]))

    equal = asked.where(counted).join(values.where("counted").select("value", "entry"), "value", "left").select("number", "entry")
    other = asked.where(~F.coalesce(counted | banded, F.lit(False))).select("number", F.lit(None).cast(values.schema["entry"].dataType).alias("entry"))
    met = near.unionByName(equal).unionByName(other).select("number", F.min("entry").over(Window.partitionBy("number")).alias("entry"))
    met = met.unionByName(found.where("number is null").select("number", F.lit(None).cast(values.schema["entry"].dataType).alias("entry")))
    source = F.when(F.col("entry.rank") == 0, "known").when(F.col("entry.rank") == 1, "claim").otherwise("unverified")
    return met.select("number", source.alias("source"), F.col("entry.name").alias("claim"))


@query("joi14_band_match", """
WITH found AS (SELECT o_orderkey AS number, CASE WHEN o_orderkey % 4 = 0 THEN 'count' ELSE 'percent' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey % 700)::DOUBLE ELSE o_totalprice / 1000 END AS v FROM orders),
 listed AS (SELECT 0 AS rank, p_partkey AS position, 'part' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'count' ELSE 'percent' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE ELSE p_retailprice / 20 END AS v FROM part
  UNION ALL SELECT 1, s_suppkey, 'supp' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'count' ELSE 'ci' END, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey + 50)::DOUBLE WHEN abs(s_acctbal / 10000) < 1 THEN abs(s_acctbal / 10000) * 100 ELSE abs(s_acctbal / 10000) END FROM supplier),
 met AS (SELECT number, rank, position, name FROM found f JOIN listed k ON f.kind <> 'count' AND k.kind <> 'count' AND f.v > k.v - 1 AND f.v < k.v + 1 WHERE abs(f.v - k.v) < 0.15
  UNION ALL SELECT number, rank, position, name FROM found f JOIN listed k ON f.kind = 'count' AND k.kind = 'count' AND f.v = k.v),
 best AS (SELECT number, arg_min((rank, name), (rank, position, name)) AS e FROM met GROUP BY 1)
SELECT found.number, CASE WHEN e IS NULL THEN 'unverified' WHEN e[1] = 0 THEN 'known' ELSE 'claim' END AS source, e[2] AS claim FROM found LEFT JOIN best USING (number)""")
def band_match(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a text matched with the first known value, then with claims; unmatched ones stay."""
    o, p, s = table(spark, d, "orders"), table(spark, d, "part"), table(spark, d, "supplier")
    count = F.col("o_orderkey") % 4 == 0
    found = o.select(F.col("o_orderkey").alias("number"), F.when(count, "count").otherwise("percent").alias("kind"), F.when(count, (F.col("o_custkey") % 700).cast("double")).otherwise(F.col("o_totalprice") / 1000).alias("value"))
    count = F.col("p_partkey") % 3 == 0
    known = p.select(F.col("p_partkey").alias("position"), F.concat(F.lit("part"), "p_partkey").alias("name"), F.when(count, "count").otherwise("percent").alias("kind"), F.when(count, F.col("p_size").cast("double")).otherwise(F.col("p_retailprice") / 20).alias("value"))
    count = F.col("s_suppkey") % 2 == 0
    claims = s.select(F.col("s_suppkey").alias("position"), F.concat(F.lit("supp"), "s_suppkey").alias("name"), F.when(count, "count").otherwise("ci").alias("kind"), F.when(count, (F.col("s_suppkey") + 50).cast("double")).otherwise(F.abs(F.col("s_acctbal") / 10000)).alias("value"))
    return matched_claims(found, known, claims)


def _eights(data: np.ndarray) -> np.ndarray:
    """For each place, the eight bytes from there as a number; after the end come zeros."""
    x = np.concatenate((data, np.zeros(7, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    return x


def _anchors(data: np.ndarray, width: int) -> np.ndarray:
    """For each place, a hash of the first ``width`` bytes from there: below 8, 8 or 24."""
    x = _eights(data)
    if width < 8:
        return x & np.uint64((1 << 8 * width) - 1)
    if width == 8:
        return x
    y = np.concatenate((x, np.zeros(16, np.uint64)))
    return x * np.uint64(0x9E3779B97F4A7C15) + y[8:-8] * np.uint64(0xD6E8FEB86659FD93) + y[16:] * np.uint64(0xC2B2AE3D27D4EB4F)


def contained(docs: DataFrame, items: DataFrame, block: int = 1 << 22) -> DataFrame:
    """(doc_id, item_id) for each row of ``docs`` whose text contains the text of a row of ``items``.

    Snippets go to the scan of the documents in blocks of about ``block`` characters. Each is looked up by its first 24
    or 8 bytes, or all it has if fewer, at every place of a text, and found ones are compared whole.
    """
    asked = items.where("text is not null").select("item_id", "text")
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    out = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        snippets, by = [r.text.encode() for r in rows], defaultdict(list)
        for i, s in enumerate(snippets):
            by[24 if len(s) >= 24 else min(len(s), 8)].append(i)
        tables = []
        for width, own in by.items():
            h = np.array([int(_anchors(np.frombuffer(snippets[i][:width], np.uint8), width)[0]) if width else 0 for i in own], np.uint64)
            order = np.argsort(h, kind="stable")
            tables.append((width, h[order], np.array(own)[order]))
        known = docs.sparkSession.sparkContext.broadcast((snippets, tables))

        def scan(frames: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            snippets, tables = known.value
            for frame in frames:
                for a in range(0, len(frame), 256):
                    part = frame.iloc[a : a + 256]
                    texts = [t.encode() for t in part.text]
                    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
                    hits = set()
                    for width, h, own in tables:
                        if not width:
                            hits.update((t, int(i)) for t in range(len(texts)) for i in own)
                            continue
                        places = _anchors(data, width)
                        lo = np.searchsorted(h, places, "left")
                        at = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == places)
                        for p, t in zip(at, np.searchsorted(ends, at, "right"), strict=True):
                            begin = int(p) - (int(ends[t - 1]) if t else 0)
                            for j in range(int(lo[p]), int(np.searchsorted(h, places[p], "right"))):
                                if texts[t].startswith(snippets[own[j]], begin):
                                    hits.add((int(t), int(own[j])))
                    if hits:
                        yield pd.DataFrame([(part.doc_id.iloc[t], i) for t, i in sorted(hits)], columns=["doc_id", "row"])

        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"row int, item_id {dict(items.dtypes)['item_id']}")
        # ids pass as text: pandas would turn those of a batch with a null into floats
        found = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(scan, "doc_id string, row int")
        found = found.join(F.broadcast(names), "row").select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "item_id")
        out = found if out is None else out.unionByName(found)
    return out


@query("joi15_containment", """
SELECT item_id, list_aggregate(list_sort(list(doc_id)), 'string_agg', ',') AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain a snippet, character for character."""
    met = contained(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return met.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("docs"))


def violations(requests: DataFrame, forbidden: DataFrame, allowed: DataFrame) -> DataFrame:
    """JOI-15: (doc_id, category, item_id, chars) for requests (doc_id, text) that show a forbidden snippet (item_id, category, text).

    A snippet counts as it is and without its comments, both trimmed, whatever its length, unless an allowed text
    (doc_id, text) holds that form. Of two forms that show, the longer is told.
    """
    forms = F.array_distinct(F.array(stripped(F.col("text")), stripped(strip_comments(F.col("text")))))
    listed = forbidden.where("text is not null").select("item_id", "category", F.explode(forms).alias("text")).where("text <> ''").withColumn("form", F.sha2("text", 256))
    distinct = listed.select(F.col("form").alias("item_id"), "text").dropDuplicates(["item_id"])
    held = contained(allowed, distinct).select(F.col("item_id").alias("form")).distinct()
    shown = contained(requests, distinct).withColumnRenamed("item_id", "form").join(held, "form", "left_anti")
    return shown.join(listed, "form").groupBy("doc_id", "category", "item_id").agg(F.max(F.length("text")).alias("chars"))


_SNIPPETS_SQL = r"""
, snip AS (SELECT item_id, 'reference' AS category, text FROM benchmark UNION ALL SELECT item_id + 100000, 'oracle', substr(text, 4, 9) FROM benchmark UNION ALL SELECT 300000, 'oracle', 'the' UNION ALL SELECT 300001, 'oracle', 'xq9'),
 form AS (SELECT item_id, category, regexp_replace(text, '^\s+|\s+$', '', 'g') AS v FROM snip)"""


@query("joi15_visibility", "WITH z AS (SELECT 1)" + _SNIPPETS_SQL + """
SELECT doc_id, category, item_id, max(length(v)) AS chars FROM documents d JOIN form ON contains(d.text, v) WHERE v <> '' AND NOT EXISTS (SELECT 1 FROM conversations c WHERE contains(c.text, v)) GROUP BY 1, 2, 3""")
def visibility(spark: SparkSession, d: str) -> DataFrame:
    """Texts that show what they should not: whole items and short ones that begin within words, but for what conversations hold anyway; half the items are asked for with a comment around them."""
    b = table(spark, d, "benchmark")
    commented = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("/* from here */"), "text", F.lit("// no more"))).otherwise(F.col("text"))
    kind = dict(b.dtypes)["item_id"]
    listed = b.select("item_id", F.lit("reference").alias("category"), commented.alias("text")).unionByName(b.select((F.col("item_id") + 100000).alias("item_id"), F.lit("oracle").alias("category"), F.substring("text", 4, 9).alias("text")))
    listed = listed.unionByName(spark.createDataFrame([(300000, "oracle", "the"), (300001, "oracle", "xq9")], f"item_id {kind}, category string, text string"))
    allowed = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return violations(table(spark, d, "documents").select("doc_id", "text"), listed, allowed)


@query("joi16_registry_anti_join", RECORDS_SQL + """
SELECT DISTINCT source_spec, target_spec FROM rec WHERE (source_spec, target_spec) NOT IN (SELECT source_spec, target_spec FROM allrec WHERE record_id % 50 = 0)""")
def registry_anti(spark: SparkSession, d: str) -> DataFrame:
    """Eligible pairs that the frozen registry lacks."""
    rec = records(spark, d)
    frozen = rec.where("record_id % 50 = 0").select("source_spec", "target_spec").distinct()
    return eligible(rec).select("source_spec", "target_spec").distinct().join(frozen, ["source_spec", "target_spec"], "left_anti")


@query("joi17_contract_finalisation", """
SELECT p_partkey, CASE WHEN w IS NULL AND dt IS NULL THEN 'no witness; not deterministic' WHEN w IS NULL THEN 'no witness' WHEN dt IS NULL THEN 'not deterministic' ELSE '' END AS reasons, w IS NOT NULL AND dt IS NOT NULL AS eligible
FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS w FROM lineitem WHERE l_returnflag = 'R') ON p_partkey = w LEFT JOIN (SELECT l_partkey AS dt FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1) ON p_partkey = dt""")
def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the reasons against each; eligible where there is none."""
    li = table(spark, d, "lineitem")
    witness = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("w")).distinct()
    stable = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.min("l_linestatus") == F.max("l_linestatus")).alias("stable")).where("stable")
    j = table(spark, d, "part").select("p_partkey").join(witness, "p_partkey", "left").join(stable, "p_partkey", "left")
    why = F.array_compact(F.array(F.when(F.col("w").isNull(), "no witness"), F.when(F.col("stable").isNull(), "not deterministic")))
    return j.select("p_partkey", F.array_join(why, "; ").alias("reasons"), (F.size(why) == 0).alias("eligible"))


@query("joi18_manifest_spec_consistency", """
SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, CASE WHEN s.s_nationkey IS NULL THEN 'spec missing' WHEN c.c_nationkey IS NULL THEN 'manifest missing' ELSE 'count differs' END AS problem
FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey WHERE c.n IS DISTINCT FROM s.n""")
def manifest_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Two inventories column by column: rows that one lacks and values that differ."""
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("a"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("b"))
    problem = F.when(F.col("b").isNull(), "spec missing").when(F.col("a").isNull(), "manifest missing").when(F.col("a") != F.col("b"), "count differs")
    return a.join(b, "nation", "full").select("nation", problem.alias("problem")).where("problem is not null")


@query("joi19_census", "SELECT l.label, count(*) AS census, count(*) FILTER (WHERE l.label <> l.vec_id % 10) AS differing FROM embeddings l GROUP BY 1")
def census(spark: SparkSession, d: str) -> DataFrame:
    """A census joined with a fresh scan on id; strengths that differ are counted."""
    scan = table(spark, d, "embeddings").select("vec_id", "label")
    census_ = scan.select("vec_id", (F.col("vec_id") % 10).alias("found"))
    j = scan.join(census_, "vec_id", "left")
    return j.groupBy("label").agg(F.count("*").alias("census"), F.count_if(~F.col("label").eqNullSafe(F.col("found"))).alias("differing"))


@query("joi20_claim_status", RECORDS_SQL + """
, o AS (SELECT kernel, avg(passed::INT) AS v FROM rec WHERE augment_level < 3 GROUP BY 1), n AS (SELECT kernel, avg(passed::INT) AS v FROM rec WHERE augment_level > 0 GROUP BY 1)
SELECT o.kernel AS claim, CASE WHEN n.v IS NULL THEN 'removed' WHEN abs(o.v - n.v) <= 1e-9 THEN 'supported' ELSE 'qualified' END AS status FROM o LEFT JOIN n USING (kernel)""")
def claim_status(spark: SparkSession, d: str) -> DataFrame:
    """Old claims against new values."""
    rec = eligible(records(spark, d))
    v = lambda df, name: df.groupBy(F.col("kernel").alias("claim")).agg(F.avg(F.col("passed").cast("int")).alias(name))
    j = v(rec.where("augment_level < 3"), "old").join(v(rec.where("augment_level > 0"), "new"), "claim", "left")
    return j.select("claim", F.when(F.col("new").isNull(), "removed").when(F.abs(F.col("old") - F.col("new")) <= 1e-9, "supported").otherwise("qualified").alias("status"))


@query("joi21_bag_union", RECORDS_SQL + "SELECT source_api AS api, count(*) AS n, count(*) FILTER (WHERE passed) AS passes FROM rec GROUP BY 1")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    """Three lists by API concatenated without removing repeats."""
    rec = eligible(records(spark, d))
    parts = [rec.where(F.col("source_api") == a).select(F.lit(a).alias("api"), "passed") for a in ("cuda", "omp", "opencl")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("api").agg(F.count("*").alias("n"), F.count_if("passed").alias("passes"))


@query("joi22_parent_binding", "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'hash differs' WHEN doc_id % 17 = 0 THEN 'parent missing' ELSE 'bound' END AS binding FROM documents")
def parent_binding(spark: SparkSession, d: str) -> DataFrame:
    """Replay rows against the files they refer to: identity and content hash must agree."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    parent = docs.where("doc_id % 17 <> 0 or doc_id % 13 = 0").select("doc_id", F.sha2("text", 256).alias("have"))
    replay = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("want"))
    what = F.when(F.col("have").isNull(), "parent missing").when(F.col("have") != F.col("want"), "hash differs").otherwise("bound")
    return replay.join(parent, "doc_id", "left").select("doc_id", what.alias("binding"))


@query("joi23_contract_lookup", RECORDS_SQL + """
SELECT DISTINCT source_spec, target_spec, CASE WHEN (source_spec, target_spec) NOT IN (SELECT source_spec, target_spec FROM allrec WHERE record_id % 3 = 0) THEN 'unresolved' WHEN len(kernel) = 2 THEN 'arguments differ' ELSE 'resolved' END AS outcome FROM rec""")
def contract_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every task needs a contract, and its arguments have to be those of both specifications."""
    rec = records(spark, d)
    args = F.split(F.regexp_replace("kernel", "(.)", "$1 "), " ")
    contract = rec.where("record_id % 3 = 0").select("source_spec", "target_spec", args.alias("declared")).distinct()
    own = F.when(F.length("kernel") == 2, F.array(F.lit("other"))).otherwise(args)
    tasks = eligible(rec).select("source_spec", "target_spec", own.alias("own")).distinct()
    outcome = F.when(F.col("declared").isNull(), "unresolved").when(F.col("declared") != F.col("own"), "arguments differ").otherwise("resolved")
    return tasks.join(contract, ["source_spec", "target_spec"], "left").select("source_spec", "target_spec", outcome.alias("outcome"))


@query("set01_key_sets", RECORDS_SQL + """
, a AS (SELECT DISTINCT kernel, direction FROM rec WHERE model = 'm0'), b AS (SELECT DISTINCT kernel, direction FROM rec WHERE model = 'm1')
SELECT 'common' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'a_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Keys that two models share, and those of one alone."""
    rec = eligible(records(spark, d))
    a, b = (rec.where(F.col("model") == m).select("kernel", "direction") for m in ("m0", "m1"))
    parts = {"common": a.intersect(b), "a_only": a.subtract(b), "b_only": b.subtract(a)}
    out = [x.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, x in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("set02_overlap_checks", """
SELECT p_partkey, p_size % 2 = 0 AS overlap, p_size % 3 <> 0 AS subset, p_size % 5 = 0 AS repeated FROM part""")
def overlap_checks(spark: SparkSession, d: str) -> DataFrame:
    """Set checks over file lists: overlap of prompt and verification files, targets within the prompt, repeats."""
    f = lambda *x: F.array(*map(F.lit, x))
    prompt = F.when(F.col("p_size") % 5 == 0, f("a.cu", "b.cu", "a.cu")).otherwise(f("a.cu", "b.cu"))
    check = F.when(F.col("p_size") % 2 == 0, f("b.cu", "ref.txt")).otherwise(f("ref.txt"))
    target = F.when(F.col("p_size") % 3 == 0, f("a.cu", "z.cu")).otherwise(f("a.cu"))
    p = table(spark, d, "part").select("p_partkey", prompt.alias("prompt"), check.alias("check"), target.alias("target"))
    return p.select("p_partkey", F.arrays_overlap("prompt", "check").alias("overlap"), (F.size(F.array_except("target", "prompt")) == 0).alias("subset"), (F.size("prompt") != F.size(F.array_distinct("prompt"))).alias("repeated"))


@query("set03_model_union", RECORDS_SQL + "SELECT model, count(*) AS n FROM rec GROUP BY 1")
def model_union(spark: SparkSession, d: str) -> DataFrame:
    """All models' records pooled."""
    rec = eligible(records(spark, d))
    a, b, c = (rec.where(F.col("model") == m).select("model", "record_id") for m in MODELS)
    return a.unionByName(b).unionByName(c).groupBy("model").agg(F.count("*").alias("n"))


@query("set04_bag_difference", """
SELECT l_returnflag AS literal, greatest(0, n - m) AS uncovered FROM (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1)
 JOIN (SELECT l_returnflag, count(*) AS m FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) USING (l_returnflag) WHERE n > m""")
def bag_difference(spark: SparkSession, d: str) -> DataFrame:
    """A literal rendered n times needs n covering entries: bag difference, with counts in place of expanded copies."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("literal"), "l_linenumber")
    have = F.count_if(F.col("l_linenumber") <= 5) - F.count_if(F.col("l_linenumber") > 3)
    return li.groupBy("literal").agg(have.alias("uncovered")).where("uncovered > 0")


@query("clm02_entry_index", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS idx FROM part")
def entry_index(spark: SparkSession, d: str) -> DataFrame:
    """The place of the entry whose group or model is the wanted one; null if there is none, never the first."""
    entry = lambda g, m: F.struct(F.lit(g).alias("group"), F.lit(m).alias("model"))
    entries = F.array(entry("x0", None), entry(None, "x1"), entry("x2", "other"))
    at = F.array_position(F.transform(entries, lambda e: F.coalesce(e["group"], e["model"])), F.concat(F.lit("x"), F.col("p_size") % 4))
    return table(spark, d, "part").select("p_partkey", (F.nullif(at, F.lit(0)) - 1).cast("int").alias("idx"))


@query("clm05_ledger_resolution", RECORDS_SQL + """
, v AS (SELECT 'rate.' || model AS id, round(avg(passed::INT), 3) AS v FROM rec GROUP BY 1), l AS (SELECT * FROM (VALUES ('rate.m0'), ('rate.m1'), ('rate.m9')) t(id))
SELECT l.id, v.v AS value, CASE WHEN v.v IS NULL THEN 'unresolved' ELSE 'resolved' END AS state FROM l LEFT JOIN v USING (id)""")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger entries resolved against computed claims."""
    claims = eligible(records(spark, d)).groupBy(F.concat(F.lit("rate."), "model").alias("id")).agg(F.round(F.avg(F.col("passed").cast("int")), 3).alias("value"))
    entries = spark.createDataFrame([("rate.m0",), ("rate.m1",), ("rate.m9",)], "id string")
    return entries.join(claims, "id", "left").withColumn("state", F.when(F.col("value").isNull(), "unresolved").otherwise("resolved"))


@query("agg21_pair_state_matrix", RECORDS_SQL + CELLS_SQL + """
, k AS (SELECT model, suite, kernel, least(split_part(direction, '-to-', 1), split_part(direction, '-to-', 2)) || '/' || greatest(split_part(direction, '-to-', 1), split_part(direction, '-to-', 2)) AS pair,
        split_part(direction, '-to-', 1) < split_part(direction, '-to-', 2) AS first, passed FROM cell)
SELECT a.pair, a.passed AS forward, b.passed AS backward, count(*) AS n FROM k a JOIN k b USING (model, suite, kernel, pair) WHERE a.first AND NOT b.first GROUP BY 1, 2, 3""")
def pair_states(spark: SparkSession, d: str) -> DataFrame:
    """Forward x backward outcomes of every pair of directions."""
    return all_pairs(any_sample(eligible(records(spark, d)))).groupBy("pair", "forward", "backward").agg(F.count("*").alias("n"))
