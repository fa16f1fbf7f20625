"""Blocks of neighbours of large hosts."""

import random

from webloom.llm import boilerplate


def test_large_host_keeps_its_url_neighbours(spark):
    random.seed(9)
    rows = [(k, "a.example", f"/p/{random.randint(0, 300):03d}") for k in range(700)] + [(1000 + k, "b.example", f"/{k}") for k in range(5)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "fetch_id bigint, host string, path string").repartition(8)
    got = boilerplate.url_blocks(df).collect()
    assert sorted(r["fetch_id"] for r in got if not r["edge"]) == sorted(r[0] for r in rows)
    blocks = {}
    for r in got:
        blocks.setdefault((r["host"], r["block"]), []).append(r)
    assert max(map(len, blocks.values())) <= boilerplate.BLOCK_PAGES + 2 * boilerplate.EDGE_PAGES and len(blocks) == 5
    near = set()
    for own in blocks.values():
        own.sort(key=lambda r: (r["path"], r["fetch_id"]))
        near |= {(a["fetch_id"], b["fetch_id"]) for k, a in enumerate(own) for b in own[k + 1 : k + 1 + boilerplate.NEIGHBOURS]}
    for host in ("a.example", "b.example"):
        order = [k for k, h, p in sorted(rows, key=lambda r: (r[1], r[2], r[0])) if h == host]
        assert {(a, b) for k, a in enumerate(order) for b in order[k + 1 : k + 1 + boilerplate.NEIGHBOURS]} <= near


def test_shared_lines_of_url_neighbours_are_deleted(spark, model):
    # every notice stands on two neighbouring pages only, on a host of three blocks
    pages = [(k, f"https://a.example/p/{k:04d}", None, f"Notice number {'abcdefghijklmnopqrstuvwxyz'[k // 2 % 26]} {'abcdefghijklmnopqrstuvwxyz'[k // 52]} of this desk.\nHouse {'xyzuvw'[k % 6]} {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]} has rooms.") for k in range(450)]
    p = spark.createDataFrame(pages, "fetch_id bigint, url string, title string, clean_text string")
    f = spark.createDataFrame([], "fetch_id bigint, html string")
    got = {(r["fetch_id"], r["line_no"]) for r in boilerplate.furniture_lines(p, f, model[0]).collect()}
    assert {(k, 1) for k in range(450)} <= got
