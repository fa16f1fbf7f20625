"""Splitting, packing, mixing and near duplicates."""

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import mixing, neardup, packing, splitting


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["pump", "desk", "plan", "far.", "end!\n", "sea", "\t", "“so”."]), max_size=400), st.integers(1, 40), st.integers(0, 50))
def test_pieces_keep_every_word(words, size, overlap):
    text = " ".join(words)
    own = text.split()
    pieces = splitting.split_words(text, size, overlap)
    shared = overlap if overlap < size else size // 4
    at = 0
    for k, (a, b, n) in enumerate(pieces):
        piece = text[a:b].split()
        assert len(piece) == n <= size
        start = len(text[:a].split())
        assert own[start : start + n] == piece
        if k:
            assert start <= at - shared and start > last
        last, at = start, start + n
    assert at == len(own)


def test_cut_at_the_change_of_topic():
    a, b = "pump water flow pipe. " * 40, "desk chair lamp room. " * 40
    pieces = splitting.split_words(a + b, 200, 10)
    assert (a + b)[: pieces[0][1]].split()[-1] == "pipe." and pieces[0][2] == 160


def test_split_items_edges(spark):
    rows = [("page", "1", "w " * 700), ("page", "1", "w " * 700), ("chunk", "1", "a b"), ("page", "2", ""), ("page", "3", None), ("page", None, "w " * 700), ("page", "4", "w" * 100_000), ("page", "5", "x " * 700)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "item_kind string, item_id string, text string, n_words int")
    got = Counter((r["item_kind"], r["item_id"]) for r in splitting.split_items(df, 600, 80).collect())
    assert got == {("page", "1"): 2, ("chunk", "1"): 1, ("page", "4"): 1, ("page", "5"): 1}
    assert splitting.split_items(df.limit(0), 600, 80).count() == 0


def test_patterns_cover_exactly():
    random.seed(1)
    for _ in range(5):
        histogram = {random.randint(1, 64): random.randint(1, 60) for _ in range(20)}
        patterns = packing.solve_configurations(histogram, 64, max_rounds=300)
        used = Counter()
        for p in patterns:
            assert sum(s * m for s, m in p.content.items()) <= 64
            used.update({s: m * p.count for s, m in p.content.items()})
        assert dict(used) == histogram
        least = sum(s * n for s, n in histogram.items()) / 64
        assert sum(p.count for p in patterns) <= 1.15 * least + 3


def test_pack(spark):
    random.seed(2)
    rows = [(k, "é" * random.randint(0, 300)) for k in range(400)] + [(900, "ü" * 1001), (901, None), (902, ""), (None, "x")]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, units int, slice int")
    got = packing.pack(df, 1000, unit=8).collect()
    fill, seen = defaultdict(int), defaultdict(int)
    for r in got:
        fill[r["container"]] += r["size"]
        seen[r["doc_id"]] += r["size"]
    assert max(fill.values()) <= 1000 and dict(seen) == {k: len((t or "").encode()) for k, t in rows if k is not None} and len(got) == 403 + 2
    assert {r["doc_id"] for r in got if r["n_pieces"] > 1} == {900} and sum(fill.values()) / 1000 / len(fill) > 0.93
    assert packing.container_report(packing.pack(df, 1000), 1000).count() > 0 and packing.pack(df.limit(0), 1000).count() == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, packing.pack(df.repartition(7), 1000, unit=8).collect()))


def test_mix(spark):
    random.seed(4)
    rows = [(k, "x" * random.randint(1, 50), "big" if k % 3 else "small") for k in range(600)] + [(1000, "x", "other"), (1001, None, "big"), (None, "x", "big"), (1002, "x", None)]
    rows.append(rows[5])
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, size int")
    targets = spark.createDataFrame([("big", 0.2, 2), ("small", 0.75, 2), ("none", 0.05, 3), ("big", 0.2, 2)], "source string, target_share double, max_repeats int")
    sizes = {k: (len(t or ""), s) for k, t, s in rows if k is not None}
    available = Counter()
    for n, s in sizes.values():
        available[s] += n
    total = available["big"] + available["small"]
    got = mixing.mix(docs, targets).collect()
    by = Counter()
    for r in got:
        by[r["source"]] += r["size"]
    assert abs(by["big"] - 0.2 * total) <= 50 and by["small"] == 2 * available["small"]
    assert len(got) == len({(r["doc_id"], r["epoch"]) for r in got}) and Counter(r["source"] for r in got).keys() == {"big", "small"}
    placed = sorted((r["position"], r["size"]) for r in got if r["source"] == "small" and r["epoch"] == 1 and r["size"])
    assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:]))
    report = {r["source"]: r for r in mixing.mix_report(docs, targets).collect()}
    assert report["small"]["short"] and report["none"]["short"] and not report["big"]["short"] and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0


def brute(texts, shingle, threshold):
    sets = [{tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} for w in (t.lower().split() for t in texts)]
    return {(i, j) for i in range(len(sets)) for j in range(i) if texts[i].lower().split() == texts[j].lower().split() or (sets[i] | sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]))}


def corpus(n=60, seed=5):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(n):
        base = [random.choice(vocabulary) for _ in range(random.randint(20, 90))]
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 3)):
            other = list(base)
            for _ in range(random.randint(0, 6)):
                other[random.randrange(len(other))] = random.choice(vocabulary)
            texts.append(" ".join(other))
    return texts + [texts[0].upper(), texts[0], "one two", "One  two", "", " "]


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    rows = [(f"p{k:03d}", t) for k, t in enumerate(texts)] + [("p000", texts[0]), ("n", None), (None, texts[0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id string, text string, key int, n int")
    for s in (neardup.Settings(shingle=3, threshold=0.7), neardup.Settings(), neardup.Settings(shingle=3, threshold=0.7, bucket_limit=1), neardup.Settings(shingle=3, threshold=0.7, weighted=False)):
        want = {(f"p{min(i, j):03d}", f"p{max(i, j):03d}") for i, j in brute(texts, s.shingle, s.threshold)}
        found = [tuple(r) for r in neardup.similar_pages(df, s).collect()]
        assert len(found) == len(set(found))
        assert set(found) <= want and len(set(found)) >= 0.98 * len(want)
    assert neardup.similar_pages(df.limit(0)).count() == 0


def test_groups(spark):
    texts = corpus(30, 6)
    df = spark.createDataFrame([(f"p{k:03d}", t) for k, t in enumerate(texts)], "page_id string, text string")
    s = neardup.Settings(shingle=3, threshold=0.7)
    pairs = neardup.similar_pages(df, s).collect()
    parent = {f"p{k:03d}": f"p{k:03d}" for k in range(len(texts))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    got = neardup.groups(df, s).collect()
    assert len(got) == len(texts)
    mine, theirs = defaultdict(set), defaultdict(set)
    for r in got:
        mine[r["group_id"]].add(r["page_id"])
        theirs[find(r["page_id"])].add(r["page_id"])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert all(roots[k] == 0 for k in range(41)) and roots[101] == 100
