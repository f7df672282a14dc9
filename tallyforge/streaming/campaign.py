"""Streams of evaluation records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resumable(stream: DataFrame, sink: str, checkpoint: str, key: list[str], transient: str | None = None) -> None:
    """STM-01: writes records whose key the sink lacks, once each, then stops; a second run goes on where the first ended.

    Keys seen are the stream's own state and the sink's rows, so a lost checkpoint does not write twice either. Records for
    which the expression ``transient`` holds are not final: a key whose stored records are all so is written again.
    """
    spark = stream.sparkSession

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(key)
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            stored = spark.read.parquet(sink)
            fresh = fresh.join((stored.where(f"not coalesce({transient}, false)") if transient else stored).select(*key), key, "left_anti")
        fresh.write.mode("append").parquet(sink)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


@dataclass(frozen=True)
class Protocol:
    """Bounds of a trajectory: tokens in all, tokens of one answer, the least that an answer must be allowed, and attempts."""

    budget: int
    response_limit: int
    least_response: int
    attempts: int


#: What a request reserves and uses: its estimated prompt, then the prompt and completion tokens that it did use.
REQUEST = ("estimate", "prompt", "completion")


def decide(protocol: Protocol, used: int, started: int, estimate: int, prompt: int, completion: int) -> tuple[str, int, int, int]:
    """STM-02: (decision, completion cap, tokens used, attempts started) after a request.

    An answer may have what remains after the estimated prompt, up to the limit of a call. A request is refused by budget
    first, if that is less than the least answer, then by attempts; refused ones are neither charged nor counted. One that
    uses more than it reserved breaks the protocol: it counts as started and is not charged.
    """
    remaining = max(0, protocol.budget - used)
    cap = max(0, min(protocol.response_limit, remaining - estimate))
    if cap < protocol.least_response or estimate + cap > remaining:
        return "budget", cap, used, started
    if started >= protocol.attempts:
        return "attempts", cap, used, started
    if prompt > estimate or prompt + completion > estimate + cap:
        return "violation", cap, used, started + 1
    return "granted", cap, used + prompt + completion, started + 1


_DECISION = "request long, decision string, cap long, used long"


def budgeted(requests: DataFrame, protocol: Protocol) -> DataFrame:
    """The batch form over (trajectory, request, estimate, prompt, completion): (trajectory, request, decision, cap, used).

    Requests are sorted within their trajectory and read in order; only a trajectory's state is held, so it may have any number.
    """
    kind = dict(requests.dtypes)["trajectory"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, started = None, 0, 0
        for frame in frames:
            out = []
            for key, request, *x in frame.itertuples(index=False):
                if key != current:
                    current, used, started = key, 0, 0
                what, cap, used, started = decide(protocol, used, started, *map(int, x))
                out.append((key, request, what, cap, used))
            yield pd.DataFrame(out, columns=["trajectory", "request", "decision", "cap", "used"])

    rows = requests.select("trajectory", "request", *REQUEST)
    return rows.repartition("trajectory").sortWithinPartitions("trajectory", "request").mapInPandas(run, f"trajectory {kind}, {_DECISION}")


def token_budget(stream: DataFrame, protocol: Protocol) -> DataFrame:
    """The stream form: a trajectory's state is what it has used and how many attempts it started; rows of a batch are taken in their order of request."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, started = state.get if state.exists else (0, 0)
        out = []
        for request, *x in pd.concat(list(frames)).sort_values("request")[["request", *REQUEST]].itertuples(index=False):
            what, cap, used, started = decide(protocol, used, started, *map(int, x))
            out.append((key[0], request, what, cap, used))
        state.update((used, started))
        yield pd.DataFrame(out, columns=["trajectory", "request", "decision", "cap", "used"])

    grouped = stream.select("trajectory", "request", *REQUEST).groupBy("trajectory")
    return grouped.applyInPandasWithState(run, f"trajectory string, {_DECISION}", "used long, started long", "append", GroupStateTimeout.NoTimeout)


def record_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).parquet(path)
