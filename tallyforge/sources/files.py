"""File scans and sinks over JSON, JSON lines, CSV, text and binary files (SURVEY SRC, SNK).

Every scan is one reader call with a fixed schema, so it splits, prunes and retries like any Spark scan; identity that
lives in paths comes from ``_metadata.file_path``.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyforge.functions import ids

MANIFEST = "kernel_name string, parallel_api string, source_suite string, spec_file string, source_dir string, category string"
RECORD = (
    "model string, source_spec string, target_spec string, kernel string, direction string, augment_level int, sample_id int, overall_status string, temperature double, "
    "prompt_tokens long, completion_tokens long, parent struct<model:string,overall_status:string>, translated_files map<string,string>"
)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder, under that of spark.checkpoint.dir, for files that executors and the driver share; on one machine alone, as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "tallyforge-files")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """SRC-01, SRC-02: one object per line; blank lines are skipped, a malformed one stops the read or is dropped."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def file_name(path: Column) -> Column:
    """A file's name; of a table written by name, that of its folder (name=...)."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/name=([^/]+)/[^/]*$", 1), F.lit("")), F.element_at(F.split(path, "/"), -1))


def existing(entries: DataFrame, path: str) -> DataFrame:
    """SRC-02: entries whose spec_file is the name of a file under ``path``; a listing, no file is opened."""
    there = entries.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = there.select(file_name(F.col("path")).alias("_name")).distinct()
    return entries.join(names, F.element_at(F.split("spec_file", "/"), -1) == F.col("_name"), "left_semi")


def spec_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03, SRC-04: (file, unique_id, problem) of the documents under ``path``, each of several lines.

    Malformed documents, missing ids and repeated ids (the first by name holds) are problems.
    """
    schema = "identity struct<unique_id:string>, _corrupt string"
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = docs.select(file_name(F.col("_metadata.file_path")).alias("file"), F.col("identity.unique_id").alias("unique_id"), F.col("_corrupt").isNotNull().alias("bad"))
    first = named.where("unique_id is not null").groupBy("unique_id").agg(F.min("file").alias("first"))
    problem = F.when(F.col("bad"), "malformed").when(F.col("unique_id").isNull(), "missing id").when(F.col("file") != F.col("first"), "duplicate id")
    return named.join(first, "unique_id", "left").select("file", "unique_id", problem.alias("problem"))


def results(spark: SparkSession, path: str, recursive: bool = True, strict: bool = False, multiline: bool = False) -> DataFrame:
    """SRC-05 to SRC-09: verdict files with what paths and parents add to them.

    Files of batches and summaries are left out; model comes from the folder, level and sample from the file's stem,
    direction and kernel from the ids, wherever the record itself has none. ``strict`` stops at a malformed file.
    """
    reader = spark.read.schema(RECORD).option("recursiveFileLookup", recursive).option("multiLine", multiline).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    parts = F.split("_metadata.file_path", "/")
    rows = reader.json(path).withColumns({"_stem": F.regexp_replace(F.element_at(parts, -1), r"\.json$", ""), "_folder": F.element_at(parts, -2)})
    rows = rows.where(~F.col("_stem").rlike("^(batch_.*|eval_summary)$"))
    s, t = F.col("source_spec"), F.col("target_spec")
    return rows.withColumns(
        {
            "model": F.coalesce(ids.first_set(F.col("model"), F.col("parent.model")), F.col("_folder")),
            "augment_level": F.coalesce("augment_level", ids.level_of_stem(F.col("_stem"))),
            "sample_id": F.coalesce("sample_id", ids.sample_of_stem(F.col("_stem"))),
            "direction": ids.direction_of(F.col("direction"), s, t),
            "kernel": F.coalesce(F.nullif(F.col("kernel"), F.lit("")), ids.kernel_of(s)),
            "temperature": F.coalesce("temperature", F.lit(0.0)),
        }
    ).drop("_folder")


def file_class(stem: Column) -> Column:
    """SRC-10: samples (-sN), augmented (-L1 to -L4) or base."""
    return F.when(stem.rlike(r"-s\d+$"), "samples").when(stem.rlike(r"-L[1-4]$"), "augmented").otherwise("base")


def csv_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-12: a table with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def commented_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-16: JSON lines without blank lines, // lines and malformed lines."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(//.*)?$"))
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"), "value").where(F.try_parse_json("value").isNotNull()).select("x.*")


@F.pandas_udf(StringType())
def strict_json_problem(texts: pd.Series) -> pd.Series:
    """SRC-14: why a document is refused: not JSON, a repeated member, NaN or Infinity, a number that a double cannot hold; else null."""

    def members(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated member")
        return dict(pairs)

    def number(token: str) -> float:
        value = float(token)
        if not math.isfinite(value):
            raise ValueError("number overflows")
        try:
            if value == 0 and Decimal(token) != 0:
                raise ValueError("number underflows")
        except InvalidOperation:
            raise ValueError("not a number") from None
        return value

    def constant(token: str):
        raise ValueError(f"{token} is not allowed")

    def check(text: str | None) -> str | None:
        try:
            json.loads(text or "", object_pairs_hook=members, parse_float=number, parse_constant=constant)
        except json.JSONDecodeError:
            return "not JSON"
        except ValueError as e:
            return str(e)
        return None

    return texts.map(check)


def population_hash(units: DataFrame) -> DataFrame:
    """SRC-15: the SHA-256 of the sorted (suite, kernel) list as compact JSON, one row.

    The digest is one sequence by its definition; distinct pairs are sorted by the cluster, and their text is hashed as it comes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, n = hashlib.sha256(b"["), 0
        for frame in frames:
            for suite, kernel in frame.itertuples(index=False):
                pair = json.dumps([suite, kernel], separators=(",", ":"), ensure_ascii=False)
                digest.update((("," if n else "") + pair).encode())
                n += 1
        digest.update(b"]")
        yield pd.DataFrame([(digest.hexdigest(), n)], columns=["sha256", "units"])

    pairs = units.select("suite", "kernel").distinct()
    return pairs.orderBy("suite", "kernel").coalesce(1).sortWithinPartitions("suite", "kernel").mapInPandas(run, "sha256 string, units long")


def resolved(config: dict[str, str], root: str) -> dict[str, str]:
    """SRC-17: every *_root of a configuration as an absolute path; one that is missing falls back to ``root``."""
    out = {k: str(Path(root, v)) if k.endswith("_root") else v for k, v in config.items()}
    out.setdefault("project_root", root)
    return out


def payload(listed: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-19: (key, name -> content) for listed (key, position, name); a file that is not there reads as a sentinel."""
    j = listed.join(files, "name", "left").withColumn("content", F.coalesce("content", F.concat(F.lit("<FILE NOT FOUND: "), "name", F.lit(">"))))
    return j.groupBy("key").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "content"))), lambda x: F.struct(x["name"], x["content"]))).alias("payload"))


def admitted(j: DataFrame, most: int) -> DataFrame:
    """SRC-19, support files: in order, each that still fits; one that does not is left out and later ones may still fit."""
    entries = F.array_sort(F.collect_list(F.struct("position", "name", F.length("content").alias("n"))))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("names"))
    fits = lambda a, x: a["used"] + x["n"] <= most
    fold = F.aggregate(entries, start, lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["names"], F.array(x["name"])).alias("names"))).otherwise(a), lambda a: a["names"])
    return j.groupBy("key").agg(fold.alias("names"))


def markdown(df: DataFrame, columns: list[str]) -> Column:
    """SNK-03: a row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def p_value(p: Column) -> Column:
    """SNK-04: p as a LaTeX table prints it."""
    return F.when(p < 0.001, "$<$0.001").otherwise(F.format_string("%.3f", p))


def latex_row(columns: list[Column]) -> Column:
    """SNK-04."""
    return F.concat(F.concat_ws(" & ", *[c.cast("string") for c in columns]), F.lit(r" \\"))


def write_lines(head: list[str], rows: DataFrame, line: Column, order: list[Column], path: str, tail: list[str] | None = None) -> None:
    """SNK-03, SNK-04: a report of aggregated rows as one text file, its head first, then rows in order, then its tail."""
    fixed = lambda lines, at: rows.sparkSession.createDataFrame([(at, i, x) for i, x in enumerate(lines)], "part int, at long, value string")
    body = rows.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("at"), line.alias("value"))
    whole = body.unionByName(fixed(head, 0)) if head else body
    whole = whole.unionByName(fixed(tail, 2)) if tail else whole
    whole.coalesce(1).sortWithinPartitions("part", "at").select("value").write.text(path)


def markdown_table(df: DataFrame, columns: list[str], order: list[Column], path: str) -> None:
    """SNK-03: a Markdown table of an aggregate."""
    write_lines(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)], df, markdown(df, columns), order, path)


def latex_table(df: DataFrame, columns: list[str], order: list[Column], path: str) -> None:
    """SNK-04: a LaTeX table of an aggregate."""
    head = [rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", " & ".join(c.replace("_", r"\_") for c in columns) + r" \\", r"\midrule"]
    write_lines(head, df, latex_row([F.col(c) for c in columns]), order, path, [r"\bottomrule", r"\end{tabular}"])


def result_name(model: Column, source: Column, target: Column, level: Column, sample: Column, samples: int = 1) -> Column:
    """SNK-01: a verdict's file: the level is named if it is over 0, the sample if there are several."""
    tags = [F.when(level > 0, F.concat(F.lit("-L"), level)).otherwise("")] + [F.concat(F.lit("-s"), sample)] * (samples > 1)
    return F.concat(F.replace(model, F.lit("/"), F.lit("_")), F.lit("/"), source, F.lit("-to-"), target, *tags, F.lit(".json"))


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions of a stored table, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [x.getPath() for x in fs.listStatus(place)] if fs.exists(place) else []
    done = [str(x.toString()) for x in found if x.getName().startswith("v-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(done, key=lambda x: x.rsplit("/", 1)[-1])


def upsert(df: DataFrame, path: str, key: list[str], order: str) -> DataFrame:
    """SNK-01: new rows over the stored ones by key, by model, as a new version, which is returned.

    Of new rows with one key the last by ``order`` counts; stored rows whose key is not among them stay. ``lost_pass``
    tells rows whose status was PASS in the version before and is no longer. A folder cannot be replaced while it is
    read, so each version is a folder of its own beside the last; one that was not finished does not count.
    """
    spark, known = df.sparkSession, versions(df.sparkSession, path)
    new = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), order).alias("new"))
    if known:
        stored = spark.read.schema(df.schema).parquet(known[-1])
        new = new.join(stored.select(*key, F.struct(*df.columns).alias("old")), key, "full")
    else:
        new = new.withColumn("old", F.lit(None).cast(df.schema))
    lost = (F.col("old.overall_status") == "PASS") & F.col("new").isNotNull() & (F.col("new.overall_status") != "PASS")
    rows = new.select(F.coalesce("new", "old").alias("x"), F.coalesce(lost, F.lit(False)).alias("lost_pass")).select("x.*", "lost_pass")
    version = f"{path}/v-{len(known) + 1:08d}-{uuid.uuid4().hex}"
    rows.write.partitionBy("model").parquet(version)
    return spark.read.schema(rows.schema).parquet(version)
