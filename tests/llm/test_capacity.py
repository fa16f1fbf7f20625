"""Containers whose capacity isn't a multiple of the packing unit."""

from collections import defaultdict

import pytest

from webloom.llm import packing


def test_documents_that_fit_stay_whole(spark):
    rows = [(k, "x" * size) for k, size in enumerate([*range(990, 1001), 1001, 2000, 2500, 7, 0, 400, 500, 31, 32, 33])] + [(100, None)]
    placed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), 1000).collect()
    pieces, held = defaultdict(list), defaultdict(int)
    for r in placed:
        pieces[r["doc_id"]].append(r["size"])
        held[r["container"]] += r["size"]
    assert max(held.values()) <= 1000 and set(pieces) == {k for k, _ in rows}
    for k, text in rows:
        size = len(text or "")
        assert len(pieces[k]) == max(1, -(-size // 1000)) and sum(pieces[k]) == size
    assert sorted(held) == list(range(len(held)))


def test_wide_signs_and_tiny_containers(spark):
    df = spark.createDataFrame([(1, "𝄞" * 5), (2, "é" * 3)], "doc_id bigint, text string")
    got = packing.pack(df, 6).collect()
    assert sorted(r["size"] for r in got) == [4, 4, 4, 4, 4, 6]
    with pytest.raises(ValueError):
        packing.pack(df, 3)
