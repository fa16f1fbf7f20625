"""Joins without all pairs against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import neardup, truncation


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = []
    for k in range(n):
        words = list(base) if k % 3 else [f"v{rng.randrange(900)}" for _ in range(80)]
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(80)] = f"z{rng.randrange(900)}"
        rows.append((f"p{k:03d}", " ".join(words[: rng.choice([80, 80, 70, 60])])))
    return rows


@pytest.mark.parametrize("similarity,hot", [("sets", 2_000), ("sets", 5), ("weights", 2_000), ("weights", 5)])
def test_crowded_texts_equal_brute_force(spark, monkeypatch, similarity, hot):
    monkeypatch.setattr(neardup, "HOT_TEXTS", hot)
    s = neardup.Settings(shingle=3, threshold=0.7, bucket_limit=6, similarity=similarity)
    df = spark.createDataFrame(near_copies(70, 4), "page_id string, text string")
    classes = neardup.text_classes(df).select("key").distinct()
    sets = neardup.shingle_sets(df, classes, s)
    weights = neardup._weights(neardup.document_frequencies(df, s), df.count(), s.heaviest)
    own = {r["key"]: np.frombuffer(r["shingles"], dtype="<u4") for r in sets.collect()}
    weigh = (lambda h: float(weights[h >> np.uint32(32 - s.df_bits)].sum(dtype=np.float64))) if similarity == "weights" else len
    want = set()
    for a, b in itertools.combinations(sorted(own), 2):
        both = weigh(np.intersect1d(own[a], own[b]))
        if both / (weigh(own[a]) + weigh(own[b]) - both) >= s.threshold:
            want.add((a, b))
    pairs = [tuple(r) for r in neardup.crowded_candidates(sets, classes, weights, s).collect()]
    assert len(pairs) == len(set(pairs)) and want <= set(pairs) and len(want) > 100
    assert {(r["a"], r["b"]) for r in neardup.similar_texts(df.select("text"), s).collect()} == want


def test_evidence_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aбé語") for _ in range(rng.randrange(1, 5)))
    words = {(rng.randrange(3), word()): (rng.randrange(5), rng.randrange(5), rng.randrange(4)) for _ in range(150)}
    suspects = [(rng.randrange(4), word(), rng.randrange(3)) for _ in range(80)]
    grams = spark.createDataFrame([(c, w, *n) for (c, w), n in words.items()], "context int, word string, inside bigint, signed bigint, bare bigint")
    asked = spark.createDataFrame(suspects, "context int, tail string, copy int")
    got = {(r["context"], r["tail"]): (r["t_own"], r["t_whole"], r["t_bare"], r["t_longer"]) for r in truncation._evidence(asked, grams, ["context"], "t").collect()}
    want = {}
    for c, t, _ in suspects:
        own = max(sum(x == (c, t, k) for x in suspects) for k in range(3))
        whole = words.get((c, t), (0, 0, 0))
        longer = sum(n[0] + n[1] for (d, w), n in words.items() if d == c and w.startswith(t) and w != t)
        want[c, t] = (own, whole[0] + whole[1], whole[2], longer)
    assert got == want


def test_long_last_words_keep_their_context(spark):
    tail = "x" * 900
    rows = [(1, "s", f"We sell the old {tail}"), (2, "s", "We sell"), (3, "s", None)]
    ends = {r["doc_id"]: r for r in truncation.ends_of(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert (ends[1]["c1"], ends[1]["c2"], ends[1]["tail"]) == ("the", "old", tail) and ends[2]["tail"] == "sell"
    assert spark.range(1).select(F.lit("\U0010ffff") > F.lit("語")).first()[0]
