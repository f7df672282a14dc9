"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts are indivisible; a group's size is the sum of its documents'. A partial partition is a list
of ``shards`` sums. The two with the largest spread are combined again and again, the largest sum of one with the
smallest of the other, until one is left. Groups are hashed into buckets of bounded number, each differenced in a task
of its own; the buckets' partial partitions are then combined by the same rule, some hundred at a time, level by level.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import discard, ranked, scratch, spread_join, text_or_empty, written

SHARDS = 16
#: Groups in a bucket, about; buckets combined in one task.
PER_BUCKET = 20_000
FAN_IN = 512


def differenced(parts: list[list[tuple[int, int]]], shards: int) -> list[list[int]]:
    """Combines partial partitions to one; each is a list of (sum, mark). Returns the marks in every shard.

    Sums of a partial partition are kept in falling order; missing ones are zero. A combined place keeps the pair it
    was made of, so the marks are read off at the end.
    """
    heap: list = []
    for k, part in enumerate(parts):
        full = sorted(part, key=lambda x: -x[0]) + [(0, None)] * (shards - len(part))
        heap.append((full[-1][0] - full[0][0], k, full))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        spread, _, b = heap[0]
        made = [(x + y, (p, q) if p is not None and q is not None else (q if p is None else p)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        made.sort(key=lambda x: -x[0])
        number += 1
        heapq.heapreplace(heap, (made[-1][0] - made[0][0], number, made))
    out: list[list[int]] = []
    for _, root in heap[0][2] if heap else []:
        marks, todo = [], [root] if root is not None else []
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                marks.append(x)
        out.append(marks)
    return out + [[] for _ in range(shards - len(out))]


def _bucket(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "g1", "g2"], ascending=[False, True, True], ignore_index=True)
        slots = differenced([[(int(x), k)] for k, x in enumerate(rows.bytes)], shards)
        slot = pd.Series(0, index=rows.index, dtype="int32")
        sums = []
        for s, marks in enumerate(slots):
            slot.iloc[marks] = s
            sums.append(int(rows.bytes.iloc[marks].sum()))
        return rows[["g1", "g2", "bucket"]].assign(slot=slot, sums=[sums] + [None] * (len(rows) - 1))

    return run


def _combined(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        parts = [[(int(x), k * shards + s) for s, x in enumerate(sums)] for k, sums in enumerate(rows.sums)]
        moved = [[0] * shards for _ in parts]
        sums = [0] * shards
        for s, marks in enumerate(differenced(parts, shards)):
            for mark in marks:
                moved[mark // shards][mark % shards] = s
                sums[s] += parts[mark // shards][mark % shards][0]
        return rows[["node", "parent"]].assign(moved=moved, sums=[sums] + [None] * (len(rows) - 1))

    return run


def balanced(groups: DataFrame, shards: int = SHARDS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(g1, g2, shard) for a written table of groups (g1 long, g2 long, bytes long)."""
    buckets = max(1, -(-groups.count() // per_bucket))
    dealt = groups.select("g1", "g2", "bytes", F.pmod("g2", F.lit(buckets)).alias("bucket"))
    first = written(dealt.groupBy("bucket").applyInPandas(_bucket(shards), "g1 long, g2 long, bucket long, slot int, sums array<long>"), "slots")
    out = first.select("g1", "g2", "bucket", "slot")
    nodes = first.where("sums is not null").select(F.col("bucket").alias("node"), "sums")
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        up = nodes.withColumn("parent", F.pmod("node", F.lit(buckets)))
        level = written(up.groupBy("parent").applyInPandas(_combined(shards), "node long, parent long, moved array<int>, sums array<long>"), "level")
        step = level.select(F.col("node").alias("bucket"), "parent", "moved")
        out = out.join(step, "bucket").select("g1", "g2", F.col("parent").alias("bucket"), F.element_at("moved", F.col("slot") + 1).alias("slot"))
        nodes = level.where("sums is not null").select(F.col("parent").alias("node"), "sums")
    return out.select("g1", "g2", F.col("slot").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; law ``bytes``: sizes near equal.

    A size is the text's UTF-8 bytes plus 1. Equal texts, null and empty ones among them, share a shard, so a group
    larger than a shard's even part makes its shard the largest, and the others are even. slot numbers a shard's rows
    from 0. Null and repeated ids stay; an empty table gives no rows; other columns do not matter.
    """
    text = text_or_empty()
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.sha2(text, 256)).alias("g2"))
    sized = written(sized, "sizes")
    groups = written(sized.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    with scratch():
        chosen = written(balanced(groups, shards).join(groups.select("g1", "g2", "n"), ["g1", "g2"]), "shards", keep=True)
    dealt = written(spread_join(sized, chosen, ["g1", "g2"], "n", sized.count()).drop("g1", "g2", "n"), "dealt")
    discard(sized, groups, chosen)
    out = ranked(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "shard").withColumnRenamed("rank", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
