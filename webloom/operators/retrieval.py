"""Exact nearest vectors within one partition key, and page lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.sources.tables import checked_broadcast

#: Base vectors and queries of one key that one task compares; larger keys are cut into slices of both.
SLICE_ROWS, QUERY_ROWS = 20_000, 2_000


def _sliced(df: DataFrame, key: str, rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the number of its slice, and ``key, name`` of the keys of more than one slice: at most one row for each ``rows`` of df."""
    many = checked_broadcast(df.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias(name)).where(F.col(name) > 1))
    numbered = df.join(many, key, "left").withColumn(f"{name}_no", F.pmod(F.xxhash64("id"), F.coalesce(F.col(name), F.lit(1))).cast("int")).drop(name)
    return numbered, many


def nearest(queries: DataFrame, base: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The ``k`` most similar base rows of each query within its key: ``query_id, vec_id, rank, similarity``.

    ``queries`` and ``base`` have vec_id, embedding and key.  A query isn't its own neighbour;
    ties are in the order of vec_id; vectors of length zero or with nulls have no neighbour.
    Every slice of base rows meets every slice of its key's queries as one matrix product; the
    best k of each are merged.
    """
    kind = base.schema["vec_id"].dataType.simpleString()
    known, base_slices = _sliced(base.select(F.col(key).alias("k"), F.col("vec_id").alias("id"), "embedding").where(F.col("embedding").isNotNull()), "k", SLICE_ROWS, "b")
    asked, query_slices = _sliced(queries.select(F.col(key).alias("k"), F.col("vec_id").alias("id"), F.col("embedding").alias("q")).where(F.col("q").isNotNull()), "k", QUERY_ROWS, "a")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    left = asked.join(base_slices, "k", "left").withColumn("b_no", each("b")).select("k", "a_no", "b_no", F.col("id").alias("query_id"), "q")
    right = known.join(query_slices, "k", "left").withColumn("a_no", each("a")).select("k", "a_no", "b_no", F.col("id").alias("vec_id"), "embedding")

    def unit(rows) -> np.ndarray:
        m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "similarity": []}
        if len(left) and len(right):
            ids = right["vec_id"].to_numpy()
            ids = ids.astype(str) if ids.dtype == object else ids
            scores = np.round(unit(left["q"]) @ unit(right["embedding"]).T, 9)
            for q, row in zip(left["query_id"], scores):
                row = np.where((ids == q) | np.isnan(row), -np.inf, row)
                order = np.lexsort((ids, -row))[: k + 1]
                order = order[np.isfinite(row[order])][:k]
                out["query_id"] += [q] * len(order)
                out["vec_id"] += ids[order].tolist()
                out["similarity"] += row[order].tolist()
        return pd.DataFrame({name: pd.Series(values, dtype=None if name == "similarity" or "string" not in kind else object) for name, values in out.items()})

    by = ("k", "a_no", "b_no")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(near, f"query_id {kind}, vec_id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")


def search_chunks(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` stored chunks of the question's company that are nearest to it: ``question_id, rank, similarity`` and all columns of ``chunks``.

    ``chunks`` has chunk_id, company_id and embedding; ``questions`` question_id, company_id and embedding.
    No chunk of another company is ever compared.
    """
    asked = questions.select(F.concat(F.lit("?"), "question_id").alias("vec_id"), "company_id", "embedding")
    found = nearest(asked, chunks.select(F.col("chunk_id").alias("vec_id"), "company_id", "embedding"), "company_id", k)
    return found.select(F.expr("substring(query_id, 2)").alias("question_id"), F.col("vec_id").alias("chunk_id"), "rank", "similarity").join(chunks, "chunk_id")


def page_by_type(pages: DataFrame, company_id: str, page_type: str) -> DataFrame:
    return pages.where((F.col("company_id") == company_id) & (F.col("page_type") == page_type))


def page_by_url(pages: DataFrame, company_id: str, page_url: str) -> DataFrame:
    return pages.where((F.col("company_id") == company_id) & (F.col("page_url") == page_url))
