"""What the operators share: tables written to the cluster's shared folder, and batches as plain numpy."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tables written inside of each open ``scratch``.
_OPEN: list[list[DataFrame]] = []
#: Rows whose doc_id is null get this one where a key is needed.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "tallyforge-checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    return own


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of finished steps now, not at some later collection.

    Shuffle files go when the driver's garbage collector finds their plan gone; a driver with room to spare may not collect for
    half an hour, in which a job's steps would fill the executors' disks one after another.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: the lineage ends there and any executor may be lost.

    ``keep`` spares the table from the ``scratch`` around it, but for one further out. What nothing deletes before goes
    when the program ends: a result may read it till then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tallyforge-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyforge_path = path
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(out)
    place, fs = _place(out)
    fs.deleteOnExit(place)
    release(spark)
    return out


def _place(df: DataFrame):
    """A written table's folder and its file system."""
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tallyforge_path)
    return place, place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, the tables written inside; for steps whose result is written outside of it."""
    _OPEN.append([])
    try:
        yield
    finally:
        discard(*_OPEN.pop())


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that later steps, written themselves, no longer need."""
    for df in tables:
        if hasattr(df, "_tallyforge_path"):
            place, fs = _place(df)
            fs.delete(place, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def batches(frames: Iterator[pd.DataFrame], text: str = "text", most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Cuts Arrow's batches so that each holds about ``most`` characters of text, or a single longer row."""
    for frame in frames:
        if not len(frame):
            continue
        ends = frame[text].str.len().fillna(0).to_numpy().cumsum()
        a = 0
        while a < len(frame):
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(ends.searchsorted(base + most, side="right")))
            yield frame.iloc[a:b]
            a = b


def through_pandas(df: DataFrame, keep: tuple[str, ...], run: Callable, made: str, **extra: Column) -> DataFrame:
    """The kept columns and those that ``run`` adds (``made``, as a schema), by batches of kept and ``extra`` columns.

    Whole numbers pass as text: pandas would turn those of a batch with a null into floats and lose large ids.
    """
    kinds = dict(df.dtypes)
    whole = [c for c in keep if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    chosen = df.select(*[F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in keep], *[v.alias(k) for k, v in extra.items()])
    names = [f"`{c}` {'string' if c in whole else kinds[c]}" for c in keep]
    out = chosen.mapInPandas(run, ", ".join([*names, made]))
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) if c in whole else F.col(c) for c in keep], *out.columns[len(keep) :])


def beside_row(df: DataFrame, row: Column, run: Callable[[pd.DataFrame], pd.DataFrame], made: str, sized: str = "text", most: int = 1 << 20, **extra: Column) -> DataFrame:
    """(_row, columns of ``made``) for every row: ``run`` makes them, row by row, from pieces of the ``extra`` columns that hold about ``most`` characters in column ``sized``.

    ``row`` is any column, a struct say; it passes through Arrow as it is, whatever its fields are called or hold.
    """
    chosen = df.select(row.alias("_row"), *[v.alias(k) for k, v in extra.items()])
    fields = StructType.fromDDL(made)
    kinds, names = to_arrow_schema(fields), list(extra)

    def over(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, at = part.column("_row"), 0
            for frame in batches(iter([part.select(names).to_pandas()]), sized, most):
                out = run(frame.reset_index(drop=True))
                columns = [pa.array(out[f.name], f.type, from_pandas=True) for f in kinds]
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(frame)), *columns], names=["_row", *kinds.names])
                at += len(frame)

    return chosen.mapInArrow(over, StructType([chosen.schema["_row"], *fields.fields]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, share: int = 1000) -> DataFrame:
    """left join-inner right on keys whose number of rows in ``left`` is ``right[n]``, however unevenly they are spread.

    Keys with at least 1/``share`` of the ``total`` rows number at most ``share``; they are broadcast, and only the
    rows of the other keys are dealt by key. ``right`` should be a written table.
    """
    heavy = F.broadcast(right.where(F.col(n) * share >= total))
    few = left.join(heavy, on)
    rest = left.join(heavy.select(*on), on, "left_anti").join(right.where(F.col(n) * share < total), on)
    return few.unionByName(rest)


def ranked(df: DataFrame, group: list[str], order: list[str], tag: str, per_block: int = 1_000_000) -> DataFrame:
    """Adds ``rank`` (long, gapless from 0 within a group) without gathering a group in one task.

    Rows of a group are dealt over hashed blocks; each block numbers its own, and a small table of block sizes gives
    every block its first number. ``df`` has to be a written table and the group columns must not be null. ``order``
    must determine a row up to exact repeats; repeats may swap numbers.
    """
    blocks = max(64, -(-df.count() // per_block))
    rows = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), f"{tag}-starts")
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order)) - 1)
    out = numbered.join(starts, [*group, "_block"])
    return out.select(*df.columns, (F.col("_r") + F.col("_first")).cast("long").alias("rank"))
