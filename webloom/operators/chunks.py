"""Chunking by sentences with overlap, and choosing chunks for a bounded context."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.constants import DEFAULTS, LAST_PRIORITY, PAGE_PRIORITY
from webloom.functions.text import strip
from webloom.functions.urls import grounding_key

_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def segments(text: str, size: int) -> list[str]:
    """Sentences of each paragraph; one longer than ``size`` words is wrapped at words."""
    found = []
    for paragraph in _PARAGRAPH.split(text):
        for sentence in filter(None, _SENTENCE.split(paragraph.strip())):
            words = sentence.split()
            found += [sentence] if len(words) <= size else [" ".join(words[k : k + size]) for k in range(0, len(words), size)]
    return found


def split_text(text: str | None, size: int = DEFAULTS["CHUNK_SIZE_TOKENS"], overlap: int = DEFAULTS["CHUNK_OVERLAP_TOKENS"]) -> list[str]:
    """Chunks of whole segments, of about ``size`` words, that share about ``overlap`` words.

    Running sums give each chunk's end: as many segments as fit after the shared tail, and one
    new segment at least (a chunk can exceed ``size`` by its tail).  Blank text gives none.
    """
    if not text or not text.strip():
        return []
    size, overlap = max(1, size), max(0, overlap)
    if overlap >= size:
        overlap = size // 4
    parts = segments(text, size)
    ends = np.cumsum([0] + [len(p.split()) for p in parts]).tolist()
    chunks, start, fresh = [], 0, 0
    while fresh < len(parts):
        stop = max(fresh + 1, bisect_right(ends, ends[start] + size) - 1)
        chunks.append(" ".join(parts[start:stop]))
        # the last segments that together reach the overlap, within this chunk
        shared = max(start, bisect_right(ends, ends[stop] - overlap) - 1) if overlap else stop
        start, fresh = shared, stop
    return chunks


def chunk_pages(pages: DataFrame, size: int = DEFAULTS["CHUNK_SIZE_TOKENS"], overlap: int = DEFAULTS["CHUNK_OVERLAP_TOKENS"]) -> DataFrame:
    """Chunks ``company_id, page_url, page_type, chunk_index, title, text`` of ``pages(company_id, page_url, page_type, title, clean_text)``.

    chunk_index restarts at 0 on each page; pages without text give no chunk.
    """
    schema = "company_id string, page_url string, page_type string, chunk_index int, title string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.itertuples(index=False):
                rows += [(page.company_id, page.page_url, page.page_type, k, page.title, t) for k, t in enumerate(split_text(page.clean_text, size, overlap))]
            yield pd.DataFrame(rows, columns=["company_id", "page_url", "page_type", "chunk_index", "title", "text"])

    known = pages.select("company_id", "page_url", "page_type", "title", "clean_text").where(strip(F.coalesce("clean_text", F.lit(""))) != "")
    return known.mapInPandas(run, schema)


def page_priority(page_type: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(p) for p in PAGE_PRIORITY]), F.lower(page_type)).cast("int") - 1
    return F.when(rank >= 0, rank).otherwise(LAST_PRIORITY)


def select_context(chunks: DataFrame, group: str, seq: str, budget: int = DEFAULTS["LLM_MAX_CONTEXT_CHARS"]) -> DataFrame:
    """Chunks that go into a group's context, with their place: all columns and ``position`` (from 1).

    Pages are read breadth first: first chunks of all pages by priority of type, then second
    chunks, until the next chunk would exceed ``budget`` characters; the first chunk is always
    taken.  ``seq`` orders pages of equal priority and chunks of equal index.  A large group is
    read in slices first: what lies beyond the budget in its slice lies beyond it in the group.
    """
    within = Window.partitionBy(group, "page_url").orderBy("chunk_index", seq)
    page = Window.partitionBy(group, "page_url")
    ranked = (
        chunks.withColumn("depth", F.row_number().over(within))
        .withColumn("first_seen", F.min(seq).over(page))
        .withColumn("priority", page_priority(F.first("page_type").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        .withColumn("size", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    )
    # the budget is reached within few depths: whole depths beyond it never enter the ordered window
    depths = ranked.groupBy(group, "depth").agg(F.sum("size").alias("chars"))
    before = F.coalesce(F.sum("chars").over(Window.partitionBy(group).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = depths.withColumn("before", before).where((F.col("before") <= budget) | (F.col("depth") == 1)).select(group, "depth", "before")
    order = Window.partitionBy(group, "depth").orderBy("priority", "first_seen", "page_url")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sliced = Window.partitionBy(group, "depth", F.pmod(F.xxhash64("page_url"), F.lit(32))).orderBy("priority", "first_seen", "page_url")
    near = ranked.join(reach, [group, "depth"]).withColumn("in_slice", F.sum("size").over(sliced.rowsBetween(Window.unboundedPreceding, 0))).withColumn("slice_rank", F.row_number().over(sliced))
    near = near.where((F.col("before") + F.col("in_slice") <= budget) | (F.col("slice_rank") == 1))
    placed = near.withColumn("running", F.col("before") + running).withColumn("rank", F.row_number().over(order))
    first = (F.col("depth") == 1) & (F.col("rank") == 1)
    kept = placed.where((F.lit(budget) > 0) & (first | (F.col("running") <= budget)))
    position = F.row_number().over(Window.partitionBy(group).orderBy("depth", "rank"))
    return kept.withColumn("position", position).select(*chunks.columns, "position")


def context_text(selected: DataFrame, group: str) -> DataFrame:
    """One context a group: ``group, context, sources``; sources are normalised and distinct."""
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" (title: "), F.col("title"), F.lit(")"))).otherwise("")
    block = F.concat(F.lit("[source: "), F.col("page_url"), F.lit("]"), titled, F.lit("\n"), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("position", block.alias("block"))))
    return selected.groupBy(group).agg(
        F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"), F.array_sort(F.collect_set(grounding_key(F.col("page_url")))).alias("sources")
    )
