"""Filling fixed-capacity containers (problem 8).

The driver only ever sees a histogram of at most ``units`` sizes.  A configuration linear
program over that histogram is solved by multiplicative weights, each round pricing the best
container content with a knapsack dynamic program.  The fractional solution is rounded down
and the remainder filled greedily, largest first.  The result is a table of container
contents; every document finds its container from its rank among the documents of its size,
so no task ever holds a whole size class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import utf8_size

#: Documents of one size are ranked in this many independent slices.
RANK_SLICES = 256


@dataclass
class Pattern:
    """``count`` containers, each with ``content[unit]`` items of size class ``unit``."""

    count: int
    content: dict[int, int]


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How many items of each size maximise total value within capacity (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(int(sizes[0]), capacity + 1):
        fitting = np.searchsorted(sizes, c, side="right")
        gain = value[:fitting] + best[c - sizes[:fitting]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], choice[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    content = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        content[choice[c]] += 1
        c -= int(sizes[choice[c]])
    return content


def solve_configurations(histogram: dict[int, int], capacity: int, epsilon: float = 0.25, max_rounds: int = 4000) -> list[Pattern]:
    """Container contents that cover ``histogram`` (size in units -> items) exactly.

    Covering LP: minimise the containers so that every size class is covered.  Weights start
    equal and shrink with coverage; each round adds as much of the best-priced content as fills
    its tightest class once.  ``max_rounds`` bounds the driver's work; what is uncovered then is
    left to the greedy rounding, so the result is complete for every setting.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([histogram[int(s)] for s in sizes], dtype=float)
    covered = np.zeros(len(sizes))
    amounts: dict[tuple, float] = {}
    goal = math.log(len(sizes) + 1) / epsilon**2 + 1
    for _ in range(max_rounds):
        weight = np.exp(-epsilon * (covered - covered.min()))
        content = best_pattern(weight / need, sizes, capacity)
        used = content > 0
        step = float((need[used] / content[used]).min())
        covered += step * content / need
        key = tuple(content)
        amounts[key] = amounts.get(key, 0.0) + step
        if covered.min() >= goal:
            break
    scale = max(covered.min(), covered.mean() / 2, 1.0)
    left = need.astype(np.int64)
    patterns: list[Pattern] = []
    for key, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        content = np.array(key)
        used = content > 0
        count = int(min(math.floor(amount / scale), (left[used] // content[used]).min()))
        if count > 0:
            left -= count * content
            patterns.append(Pattern(count, {int(s): int(m) for s, m in zip(sizes, content) if m}))
    while left.any():
        content, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            content[k] = min(left[k], room // sizes[k])
            room -= int(content[k] * sizes[k])
        used = content > 0
        count = int((left[used] // content[used]).min())
        left -= count * content
        patterns.append(Pattern(count, {int(s): int(m) for s, m in zip(sizes, content) if m}))
    return patterns


def split_oversized(df: DataFrame, capacity: int) -> DataFrame:
    """Pieces ``(doc_id, piece_no, size, n_pieces)`` of every document, whole unless it exceeds ``capacity``.

    Longer texts are cut into full pieces between code points; piece_no counts from 0.  A code
    point may take four bytes, so capacities are 4 at least.
    """
    if capacity < 4:
        raise ValueError(f"a container of {capacity} bytes can't hold every code point")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                raw, at, sizes = text.encode(), 0, []
                while at < len(raw):
                    end = min(at + capacity, len(raw))
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    sizes.append(end - at)
                    at = end
                rows += [(doc_id, k, s, len(sizes)) for k, s in enumerate(sizes)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "size", "n_pieces"])

    sized = df.select("doc_id", "text", utf8_size(F.col("text")).alias("size"))
    whole = sized.where(F.col("size") <= capacity).select("doc_id", F.lit(0).alias("piece_no"), "size", F.lit(1).alias("n_pieces"))
    long = sized.where(F.col("size") > capacity).select("doc_id", "text")
    return whole.unionByName(long.mapInPandas(cut, "doc_id bigint, piece_no int, size bigint, n_pieces int")).dropDuplicates(["doc_id", "piece_no"])


def pack(df: DataFrame, capacity: int, unit: int = 32) -> DataFrame:
    """Assign every document of ``df(doc_id, text)`` to containers of ``capacity`` bytes.

    Returns ``doc_id, piece_no, n_pieces, size, container``.  Sizes are rounded up to ``unit``
    bytes for packing, so a container never overflows; a document that fits, but not once it is
    rounded up, has a container of its own.  Null and empty texts count one unit;
    null ids are left out; rows delivered twice count once; an empty table gives an empty result.
    Ties are ordered by doc_id and piece_no, so the result doesn't depend on partitioning.
    """
    unit = max(1, min(unit, capacity))
    capacity_units = capacity // unit
    pieces = split_oversized(df.select("doc_id", "text").where(F.col("doc_id").isNotNull()), capacity)
    pieces = pieces.withColumn("units", F.least(F.lit(capacity_units), F.greatest(F.lit(1), F.ceil(F.col("size") / unit))).cast("int")).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(RANK_SLICES)).cast("int"))
    counts = pieces.groupBy("units", "slice").agg(F.count("*").alias("n"))
    # at most capacity_units * RANK_SLICES rows: bounded by parameters, not by the data
    table = counts.toPandas().sort_values(["units", "slice"])
    histogram = table.groupby("units")["n"].sum()
    patterns = solve_configurations({int(u): int(n) for u, n in histogram.items()}, capacity_units)
    table["before"] = table.groupby("units")["n"].cumsum() - table["n"] if len(table) else 0
    spans, base, at = {}, 0, {}
    for pattern in patterns:
        for u, m in pattern.content.items():
            start = at.get(u, 0)
            at[u] = start + pattern.count * m
            spans.setdefault(u, []).append((start, m, base))
        base += pattern.count
    spark = df.sparkSession
    offsets = spark.createDataFrame([(int(u), int(s), int(b)) for u, s, b in zip(table["units"], table["slice"], table["before"])], "units int, slice int, before bigint")
    # first rank, items a container and first container of each span of a size, in the order of ranks; at most one span a pattern
    shared = spark.sparkContext.broadcast({u: np.array(own, dtype=np.int64) for u, own in spans.items()})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            container = np.zeros(len(batch), dtype=np.int64)
            units, rank = batch["units"].to_numpy(), batch["rank"].to_numpy()
            for u in np.unique(units):
                own, mine = shared.value[int(u)], np.flatnonzero(units == u)
                first, each, start = own[np.searchsorted(own[:, 0], rank[mine], side="right") - 1].T
                container[mine] = start + (rank[mine] - first) // each
            yield batch.drop(columns=["units", "rank"]).assign(container=container)

    local = F.row_number().over(Window.partitionBy("units", "slice").orderBy("doc_id", "piece_no")) - 1
    ranked = pieces.withColumn("local", local).join(F.broadcast(offsets), ["units", "slice"]).select("doc_id", "piece_no", "n_pieces", "size", "units", (F.col("before") + F.col("local")).alias("rank"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece_no int, n_pieces int, size bigint, container bigint")


def container_report(placed: DataFrame, capacity: int) -> DataFrame:
    """Containers by fill: ``fill_percent, containers, items, bytes`` with fill rounded down to whole percents."""
    each = placed.groupBy("container").agg(F.sum("size").alias("size"), F.count("*").alias("items"))
    return each.groupBy(F.floor(F.col("size") * 100 / capacity).cast("int").alias("fill_percent")).agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("size").alias("bytes")
    )
