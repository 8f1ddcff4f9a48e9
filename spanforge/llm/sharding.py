"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A group (documents of equal text) goes to one shard whole.  Large groups, few
by definition, are differenced first, in one place; their loads form a partial
partition.  The other groups are dealt to buckets by hash; each bucket takes its
proportional part of that partial partition as one more item and differences it
with its own groups: again and again the two partial partitions of largest
spread are combined, the fullest shard of one with the emptiest of the other.
Shards keep their numbers across buckets by the shared item, so buckets work in
parallel and nothing about all groups meets in one place.

A group larger than an equal share leaves its shard to itself, as far as sizes
allow; the other shards are balanced among themselves.

Defined results: null texts form one group (size 16 bytes a row), distinct from
that of empty texts; repeated rows are rows of their own; an empty table gives
an empty result.  Slots number a shard's rows from 0 in an order that does not
depend on the cluster, except between rows of equal doc_id and text.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: A group is large from 1 / (shards * LARGE) of all bytes or rows on: at most 2 * shards * LARGE groups.
LARGE = 50
#: Groups of a bucket, and rows of a numbering block (expected).
BUCKET_GROUPS = 4_000
BLOCK_ROWS = 20_000
OVERHEAD = 16


class _Partial:
    """Loads of shards, ascending, and how they were made: an item, or two partials matched position by position."""

    __slots__ = ("item", "left", "loads", "order", "right")

    def __init__(self, loads: np.ndarray, item: int | None = None, left: _Partial | None = None, right: _Partial | None = None, order: np.ndarray | None = None):
        self.loads, self.item, self.left, self.right, self.order = loads, item, left, right, order


def differencing(sizes: list[int], shards: int, fixed: list[int] | None = None) -> list[int]:
    """A shard for each size. fixed: loads that the shards have already; they keep their numbers."""
    tick = itertools.count()
    heap = []

    def push(p: _Partial) -> None:
        heapq.heappush(heap, (-int(p.loads[-1] - p.loads[0]), next(tick), p))

    for i, s in enumerate(sizes):
        loads = np.zeros(shards, np.int64)
        loads[-1] = s
        push(_Partial(loads, item=i))
    if fixed is not None:
        names = np.argsort(np.array(fixed, np.int64), kind="stable")
        push(_Partial(np.array(fixed, np.int64)[names], item=-1, order=names))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        loads = a.loads + b.loads[::-1]
        order = np.argsort(loads, kind="stable")
        push(_Partial(loads[order], left=a, right=b, order=order))
    out = [0] * len(sizes)
    if not heap:
        return out
    # From the root down: place[k] is the shard of a partial's k-th position.
    names = np.arange(shards)
    stack = [(heap[0][2], names)]
    while stack:
        p, place = stack.pop()
        if p.left is None:
            if p.item == -1:
                names = np.empty(shards, np.int64)
                names[place] = p.order
            else:
                out[p.item] = int(place[-1])
            continue
        own = np.empty(shards, np.int64)
        own[p.order] = place
        stack.append((p.left, own))
        stack.append((p.right, own[::-1]))
    return [int(names[s]) for s in out]


def group_key(text: Column) -> Column:
    """A 128-bit name of a text's group; null has one of its own."""
    return F.md5(F.concat(F.when(text.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(text, F.lit(""))).cast("binary"))


def shard(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        group_key(F.col(text)).alias("key"),
    )
    rows = work.table(rows)
    groups = work.table(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total, n_rows, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    parts = shards * LARGE
    is_large = (F.col("bytes") * parts >= total) | (F.col("rows") * parts >= n_rows)
    large = groups.where(is_large).orderBy(F.desc("bytes"), "key").toPandas()  # at most 2 * shards * LARGE rows
    home = differencing(large["bytes"].tolist(), shards)
    loads = np.zeros(shards, np.int64)
    np.add.at(loads, np.array(home, np.int64), large["bytes"].to_numpy(np.int64))
    rest = int(total) - int(loads.sum())
    buckets = max(1, -(-int(n_groups) // BUCKET_GROUPS))
    fixed = [int(x) for x in loads]

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        own = int(pdf["bytes"].sum())
        part = [x * own // max(1, rest) for x in fixed]
        return pd.DataFrame({"key": pdf["key"], "shard": np.array(differencing(pdf["bytes"].tolist(), shards, part), np.int32)})

    light = groups.where(~is_large).select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    dealt = light.groupBy("bucket").applyInPandas(deal, "key string, shard int")
    homes = spark.createDataFrame(pd.DataFrame({"key": large["key"].astype(str), "shard": np.array(home, np.int32)}), "key string, shard int")
    # Large groups hold all frequent keys: they are few and broadcast; no key of the shuffled join is frequent.
    few = F.broadcast(homes)
    placed = rows.join(few, "key").unionByName(rows.join(F.broadcast(homes.select("key")), "key", "left_anti").join(dealt, "key"))
    return numbered(work.table(placed.drop("key")), int(n_rows))


def numbered(placed: DataFrame, n_rows: int) -> DataFrame:
    """placed (doc_id, size, text_crc32, shard) with slot: each shard's rows from 0 without gaps, numbered in blocks."""
    blocks = max(1, -(-n_rows // BLOCK_ROWS))
    cut = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    counts = cut.groupBy("shard", "block").agg(F.count("*").alias("n"))  # shards * blocks rows
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    own = cut.withColumn("at", F.row_number().over(within) - 1)
    return own.join(base, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).alias("slot"))
