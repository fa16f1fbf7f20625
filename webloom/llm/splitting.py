"""Splitting oversized items at natural boundaries (problem 3).

Lexical-cohesion segmentation: the words left and right of every sentence gap are compared
as blocks; a valley of that similarity curve marks a change of topic.  Inside each size
window the gap with the deepest valley is cut, then the next piece starts early enough to
share the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import words

_WORD = re.compile(r"[^ \t\r\n]+")
_SENTENCE_END = re.compile(r"[.!?。！？…]['\"”’»)\]]*$")
_STRIP = re.compile(r"\W+")

#: Words in each of the two blocks compared at a gap.
BLOCK = 60
#: The share of a window in front of which no cut is made while a later boundary exists.
LEAST_FILL = 0.5


def gap_depths(tokens: list[str], gaps: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Depth of the similarity valley at each gap (a gap g lies before word g)."""
    _, ids = np.unique(np.array([_STRIP.sub("", t.lower()) for t in tokens]), return_inverse=True)
    similarity = np.empty(len(gaps))
    for k, g in enumerate(gaps):
        first = max(0, g - block)
        _, near = np.unique(ids[first : g + block], return_inverse=True)
        left, right = np.bincount(near[: g - first], minlength=len(near)), np.bincount(near[g - first :], minlength=len(near))
        norm = np.sqrt(float((left * left).sum()) * float((right * right).sum()))
        similarity[k] = float((left * right).sum()) / norm if norm else 0.0
    depth = np.zeros(len(gaps))
    peak = -np.inf
    left_peak = np.empty(len(gaps))
    for k, s in enumerate(similarity):  # the climb to the left ends where the curve falls again
        peak = max(s, peak) if k and s <= similarity[k - 1] else s
        left_peak[k] = peak
    peak = -np.inf
    for k in range(len(gaps) - 1, -1, -1):
        peak = max(similarity[k], peak) if k + 1 < len(gaps) and similarity[k] <= similarity[k + 1] else similarity[k]
        depth[k] = (left_peak[k] - similarity[k]) + (peak - similarity[k])
    return depth


def split_words(text: str, max_size: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of ``text`` as ``(first_char, past_char, n_words)``.

    Every piece has at most ``max_size`` words, consecutive pieces share at least ``overlap``
    words, and together the pieces cover every word.  An overlap that leaves no room is
    lowered to a quarter of max_size.
    """
    max_size = max(1, max_size)
    overlap = max(0, overlap)
    if overlap >= max_size:
        overlap = max_size // 4
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n == 0:
        return []
    if n <= max_size:
        return [(0, len(text), n)]
    tokens = [text[a:b] for a, b in spans]
    is_gap = np.zeros(n + 1, dtype=bool)
    for k in range(1, n):
        is_gap[k] = "\n" in text[spans[k - 1][1] : spans[k][0]] or bool(_SENTENCE_END.search(tokens[k - 1]))
    gaps = np.flatnonzero(is_gap)
    depth = gap_depths(tokens, gaps)
    pieces, start = [], 0
    while True:
        if n - start <= max_size:
            cut = n
        else:
            least = start + max(overlap + 1, int(max_size * LEAST_FILL))
            low, high = np.searchsorted(gaps, [min(least, start + max_size), start + max_size + 1])
            if low == high:
                low = np.searchsorted(gaps, start + overlap + 1)
            cut = int(gaps[low + int(depth[low:high].argmax())]) if low < high else start + max_size
        pieces.append((0 if start == 0 else spans[start][0], len(text) if cut == n else spans[cut - 1][1], cut - start))
        if cut == n:
            return pieces
        latest = cut - overlap
        before = gaps[(gaps <= latest) & (gaps > max(start, latest - overlap // 2))]
        start = int(before[-1]) if len(before) else latest


def split_items(df: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """Pieces of every item of ``df(item_kind, item_id, text)``.

    Returns ``item_kind, item_id, piece_no, n_pieces, first_char, n_words, text``.  Items within
    the limit come out as one piece; null and blank texts give no piece; null ids are left out;
    repeated rows of one item_kind and item_id count once.  Whole texts are used at any length.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, item, text in zip(batch["item_kind"], batch["item_id"], batch["text"]):
                pieces = split_words(text, max_size, overlap)
                rows += [(kind, item, k, len(pieces), a, n, text[a:b]) for k, (a, b, n) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "n_pieces", "first_char", "n_words", "text"])

    schema = "item_kind string, item_id string, piece_no int, n_pieces int, first_char int, n_words int, text string"
    counted = df.select("item_kind", F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("item_id").isNotNull()).withColumn("n_words", F.size(words(F.col("text"))))
    fitting = counted.where((F.col("n_words") > 0) & (F.col("n_words") <= max_size)).select(
        "item_kind", "item_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("first_char"), "n_words", "text"
    )
    long = counted.where(F.col("n_words") > max_size).select("item_kind", "item_id", "text").mapInPandas(cut, schema)
    return fitting.unionByName(long).dropDuplicates(["item_kind", "item_id", "piece_no"])


def pages_and_chunks(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extracted pages and stored chunks as items ``item_kind, item_id, text``."""
    page = pages.select(F.lit("page").alias("item_kind"), F.col("fetch_id").cast("string").alias("item_id"), F.col("clean_text").alias("text"))
    chunk = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    return page.unionByName(chunk)
