"""Command line over queries, manifests and stored runs.

    python -m tallyforge.cli list
    python -m tallyforge.cli run agg03_dimension_slices /data/sf0.1 [--out folder]
    python -m tallyforge.cli explain agg03_dimension_slices /data/sf0.1
    python -m tallyforge.cli chain agg01_status_breakdown,sta07_mcnemar /data/sf0.1
    python -m tallyforge.cli pairs manifest.jsonl specs
    python -m tallyforge.cli info specs
    python -m tallyforge.cli verify runs.jsonl

``pairs`` lists the ordered pairs of APIs of manifest entries whose specification is there, ``info`` the ids and problems of a
folder of specifications. ``verify`` judges stored runs (run_id, exit_code, stdout, files, strategies), one to a line, and
fails if one does not pass. A chain ends with its first query that fails.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import verify
from tallyforge.plans import catalog, reports
from tallyforge.plans.joins import pairs_of_apis
from tallyforge.sources import files


def stored_pairs(spark: SparkSession, manifest: str, specs: str) -> DataFrame:
    there = files.existing(files.manifest(spark, manifest, strict=False), specs)
    entries = there.select(F.col("source_suite").alias("suite"), F.col("kernel_name").alias("kernel"), F.col("parallel_api").alias("api"))
    return pairs_of_apis(entries).orderBy("suite", "kernel", "source_api", "target_api")


def judged(spark: SparkSession, runs: str) -> DataFrame:
    strategy = verify.STRATEGY.replace(" string", ":string").replace(" boolean", ":boolean")
    stored = spark.read.schema(f"run_id string, exit_code int, stdout string, files map<string,string>, strategies array<struct<{strategy}>>").option("mode", "FAILFAST").json(runs)
    return verify.verify(stored)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyforge")
    parser.add_argument("action", choices=("list", "run", "explain", "chain", "pairs", "info", "verify"))
    parser.add_argument("name", nargs="?", help="a query, several for a chain, or a file")
    parser.add_argument("data", nargs="?", help="the folder of the tables, or of specifications")
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    if args.action == "list":
        for name, f in sorted(catalog.QUERIES.items()):
            print(f"{name}: {(f.__doc__ or '').strip().splitlines()[0]}")
        return 0
    needed = [args.name] if args.action in ("info", "verify") else [args.name, args.data]
    if None in needed or (args.action in ("run", "explain", "chain") and not set(args.name.split(",")) <= set(catalog.QUERIES)):
        parser.error("give the name of a query and the folder of the tables, or the files that the action reads")
    spark = SparkSession.builder.appName(f"tallyforge {args.action}").getOrCreate()
    if args.action == "chain":
        try:
            log = reports.chain([(name, lambda name=name: catalog.QUERIES[name](spark, args.data)) for name in args.name.split(",")])
        except reports.StepFailed as e:
            log = e.log
        for step in log:
            print(f"{step['label']}: {step['error'] or str(step['rows']) + ' rows'}")
        return int(bool(log[-1]["error"]))
    df = {
        "run": lambda: catalog.QUERIES[args.name](spark, args.data), "explain": lambda: catalog.QUERIES[args.name](spark, args.data), "pairs": lambda: stored_pairs(spark, args.name, args.data),
        "info": lambda: files.spec_index(spark, args.name).orderBy("file"), "verify": lambda: judged(spark, args.name),
    }[args.action]()
    if args.action == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.mode("errorifexists").parquet(args.out)
    else:
        df.show(100, truncate=False)
    return int(args.action == "verify" and not df.where("status not in ('PASS', 'SKIP')").isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
