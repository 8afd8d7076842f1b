"""Problem 8: filling fixed-capacity containers with items of varying length.

Method: optimal length buckets. The global histogram of lengths is cut into at most BUCKETS buckets by dynamic programming so that the
padding, the room between a length and the top of its bucket, is least in total. Token-budget batches are then formed on
the bucket tops: the batch is opened by its largest bucket and filled from smaller ones, best fit first, on counts instead of
items, so the plan is made from at most capacity + 1 numbers whatever the corpus. Filling from smaller buckets goes beyond the
method's batches of one bucket, which leave a third of a small container empty (README).

A text longer than the capacity is cut into full parts and a rest. Every part takes its place by its rank within its bucket;
ranks are counted by partition first, so a bucket that holds a third of all texts is no bottleneck. The plan that goes to every
task has at most 2 * BUCKETS ** 2 runs: a step uses up a bucket or a run of containers, and a bucket leaves at most two runs more.

Defined cases: a NULL text isn't an item; an empty text has no tokens and takes a place of size 0 in the first container; equal
texts are items of their own; repeated rows of one id are one item; a capacity below 1 or NULL is refused; without items there
is no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.runtime import cut

BUCKETS = 96
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of that public vocabulary (fixed value)


def count_tokens(documents: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, tokens) under a public tokenizer's vocabulary of ranks, a file that is sent to every executor."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tokens": [len(encoder.encode_ordinary(t)) for t in b["text"]]})

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    kind = dict(documents.dtypes)[doc_id]
    return rows.mapInPandas(run, f"id {kind}, tokens int").groupBy("id").agg(F.max("tokens").alias("tokens")).withColumnRenamed("id", doc_id)


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Tops of the buckets that minimise the total padding, by dynamic programming over the histogram (ascending lengths)."""
    n = len(lengths)
    if n <= buckets:
        return lengths
    number, mass = np.r_[0, np.cumsum(counts)].astype(float), np.r_[0, np.cumsum(counts * lengths)].astype(float)
    # cost of one bucket over lengths i..j-1 is lengths[j-1] * number - mass; it satisfies the quadrangle inequality
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = np.zeros((buckets, n + 1), np.int32)

    def solve(lo: int, hi: int, left: int, right: int, k: int, last: np.ndarray, new: np.ndarray) -> None:
        stack = [(lo, hi, left, right)]
        while stack:
            lo, hi, left, right = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(j, right + 1))
            if len(i):
                cost = last[i] + lengths[j - 1] * (number[j] - number[i]) - (mass[j] - mass[i])
                at = int(cost.argmin())
                new[j], back[k, j] = cost[at], i[at]
            stack += [(lo, j - 1, left, int(back[k, j])), (j + 1, hi, int(back[k, j]), right)]

    for k in range(buckets):
        new = np.full(n + 1, np.inf)
        solve(1, n, 0, n - 1, k, best, new)
        best = new
    tops, j = [], n
    for k in range(buckets - 1, -1, -1):
        tops.append(lengths[j - 1])
        j = int(back[k, j])
        if j == 0:
            break
    return np.array(sorted(set(tops)))


def fill(tops: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit on counts: (bucket, first rank, last rank, container of the first rank); neighbouring ranks take neighbouring containers."""
    free: dict[int, list[tuple[int, int]]] = {capacity: []}  # room: runs of containers, first and number
    made = 0
    plan = []
    for b in range(len(tops) - 1, -1, -1):
        size, left, rank = max(int(tops[b]), 1), int(counts[b]), 0
        while left:
            room = min((r for r in free if r >= size and free[r]), default=None)
            if room is None:
                first, number = made, left if size * 2 > capacity else -(-left * size // capacity)
                made += number
                room = capacity
            else:
                first, number = free[room].pop()
            take = min(number, left)
            plan.append((b, rank, rank + take - 1, first))
            if take < number:
                free.setdefault(room, []).append((first + take, number - take))
            if room - size:
                free.setdefault(room - size, []).append((first, take))
            rank, left = rank + take, left - take
    return plan


def pack(sizes: DataFrame, capacities: list[tuple[int, int]], item: str) -> DataFrame:
    """sizes (item, tokens) to (capacity_id, container, item, part, tokens) for each of (capacity_id, max_tokens)."""
    out = None
    sizes = cut(sizes.select(item, "tokens", F.spark_partition_id().alias("_block")))
    for capacity_id, capacity in capacities:
        if not capacity or capacity < 1:
            raise ValueError(f"a container needs room: {capacity}")
        part = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / capacity).cast("int") - 1, F.lit(0)))
        parts = sizes.select(item, "tokens", "_block", F.explode(part).alias("part")).select(item, "part", "_block", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).alias("tokens"))
        rows = sorted(parts.groupBy("tokens").count().collect())  # at most capacity + 1 rows
        if not rows:
            continue
        lengths, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        tops = optimal_buckets(lengths, counts)
        bucket = np.searchsorted(tops, lengths)
        plan = fill(tops, np.bincount(bucket, counts, len(tops)).astype(int), capacity)
        spark = sizes.sparkSession
        to_bucket = spark.createDataFrame([(int(x), int(b)) for x, b in zip(lengths, bucket, strict=True)], "tokens int, bucket int")
        runs = spark.createDataFrame([tuple(map(int, p)) for p in plan], "bucket int, first long, last long, container long")
        ranked = _rank(parts.join(F.broadcast(to_bucket), "tokens"), "bucket", [item, "part"])
        seated = ranked.join(F.broadcast(runs), "bucket").filter(F.col("rank").between(F.col("first"), F.col("last")))
        one = seated.select(F.lit(capacity_id).alias("capacity_id"), (F.col("container") + F.col("rank") - F.col("first")).alias("container"), item, "part", "tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        kind = dict(sizes.dtypes)[item]
        return sizes.sparkSession.createDataFrame([], f"capacity_id int, container long, {item} {kind}, part int, tokens int")
    return out


def _rank(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """A dense rank from 0 within each group: counted within the partitions (_block) of the stored sizes, which grow in number with the corpus, after the rows of those before."""
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(group, "_block").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order)) - 1
    return rows.withColumn("_i", inside).join(offsets, [group, "_block"]).withColumn("rank", F.col("_i") + F.col("_start")).drop("_block", "_i", "_start")


def pack_documents(documents: DataFrame, capacities: DataFrame, doc_id: str = "doc_id", text: str = "text", *, vocabulary: str) -> DataFrame:
    """Containers of every capacity (a small table of settings) for all documents."""
    sizes = count_tokens(documents, doc_id, text, vocabulary)
    listed = [(r[0], r[1]) for r in capacities.select("capacity_id", "max_tokens").distinct().orderBy("capacity_id").collect()]
    return pack(sizes, listed, doc_id)
