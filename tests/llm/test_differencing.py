"""What problem 6 finds comes from comparing pages, with and without html."""

import pandas as pd

from webloom.llm import boilerplate
from webloom.sources.tables import table


def test_text_alone_finds_most_of_it(spark, model):
    root = "/root/testdata/sf0.01"
    pages, fetched = table(spark, root, "extracted_pages"), table(spark, root, "fetch_results")
    both = {tuple(r) for r in boilerplate.furniture_lines(pages, fetched, model[0]).collect()}
    alone = {tuple(r) for r in boilerplate.furniture_lines(pages, fetched.limit(0), model[0]).collect()}
    assert len(alone & both) >= 0.9 * len(both) and len(alone & both) >= 0.95 * len(alone)


def block(n, neighbours):
    texts = [["Home", "Shop", f"The {k} hall has {'abcdef'[k]} rooms.", "Print", "Post"] for k in range(n)]
    rows = []
    for k, lines in enumerate(texts):
        parts = [boilerplate._parts(x) for x in lines]
        rows.append((k, boilerplate._pack([boilerplate._hash(x) for x in lines]), boilerplate._pack([p for own in parts for p in own]), b"".join(len(own).to_bytes(4, "little") for own in parts), bytes(map(boilerplate._label, lines)), False, f"/{k}", None, None, False))
    group = pd.DataFrame(rows, columns=["fetch_id", "lines", "parts", "sizes", "labels", "filled", "path", "shown", "kinds", "edge"])
    before, boilerplate.NEIGHBOURS = boilerplate.NEIGHBOURS, neighbours
    try:
        found = boilerplate.difference(group)
    finally:
        boilerplate.NEIGHBOURS = before
    return {(r.fetch_id, r.line_no) for r in found.itertuples() if r.state == boilerplate.FURNITURE}


def test_nothing_is_deleted_without_a_page_to_compare():
    assert block(6, 4) == {(k, n) for k in range(6) for n in (1, 2, 4, 5)}
    assert block(6, 0) == block(1, 4) == set()


def test_known_lines(spark):
    rows = [(1, 1, boilerplate.FURNITURE, 0, [7], "a"), (2, 1, boilerplate.FURNITURE, 0, [7], "b"), (3, 1, boilerplate.OPEN, 0, [7], "c"), (3, 2, boilerplate.OPEN, 0, [8], "c"), (3, 3, boilerplate.DOUBTFUL, 0, [9], "c"), (3, 4, boilerplate.OPEN, 1, [8], "c")]
    rows += [(k, 9, boilerplate.ALONE, -1, [5], h) for k, h in ((1, "a"), (2, "b"), (3, "c"))] + [(k, 8, boilerplate.FURNITURE, 2, [5], h) for k, h in ((1, "a"), (2, "b"))] + [(4, 1, boilerplate.OPEN, 0, [5], "d"), (5, 1, boilerplate.OPEN, -1, [7, 7], "e"), (5, 2, boilerplate.OPEN, -1, [7, 8], "e")]
    judged = spark.createDataFrame(rows, "fetch_id bigint, line_no int, state int, run int, parts array<bigint>, host string")
    assert {tuple(r) for r in boilerplate.known_lines(judged, 2).collect()} == {(3, 1), (3, 2), (5, 1)}
