"""Closed line sequences against brute force."""

import itertools
import random

from webloom.llm import queries, sitelines


def subsequences(lines):
    return {tuple(lines[k] for k in places) for n in range(1, len(lines) + 1) for places in itertools.combinations(range(len(lines)), n)}


def holds(text, sequence):
    rest = iter(text)
    return all(x in rest for x in sequence)


def test_closed_sequences_equal_brute_force(spark):
    random.seed(8)
    texts = {("a", f"p{k}"): random.choices("uvwxy", k=random.randint(0, 7)) for k in range(25)} | {("b", f"q{k}"): ["top", "m", f"own {chr(97 + k)}", *"cdefgh", "end"][: 10 - k % 2] for k in range(8)}
    rows = [(c, p, "\n".join(t)) for (c, p), t in texts.items()]
    df = spark.createDataFrame(rows + rows[:3] + [("a", "n", None), (None, "m", "u"), ("a", None, "u")], "company_id string, page_id string, clean_text string")
    want = {}
    for source in "ab":
        own = [t for (c, _), t in texts.items() if c == source]
        least = max(5, -(-(len(own) + (source == "a")) // 5))
        supports = {s: sum(holds(t, s) for t in own) for s in set().union(*map(subsequences, own))}
        frequent = {s: n for s, n in supports.items() if n >= least}
        want |= {(source, s): n for s, n in frequent.items() if not any(m == n and len(t) > len(s) and holds(t, s) for t, m in frequent.items())}
    found = [(r["company_id"], tuple(r["sequence"]), r["length"], r["support"]) for r in sitelines.closed_sequences(df).collect()]
    assert len(found) == len(want) and {(c, s): n for c, s, _, n in found} == want and all(len(s) == n for _, s, n, _ in found)
    assert want["b", ("top", "m", *"cdefgh")] == 8
    single = {(c, x) for c, s in want for x in s}
    assert {tuple(r) for r in sitelines.sequence_lines(df).collect()} == single
    assert sitelines.closed_sequences(df.limit(0)).count() == 0 and sitelines.sequence_lines(df.limit(0)).count() == 0


def test_page_with_two_texts_counts_once(spark):
    rows = [("a", f"p{k}", "x\ny") for k in range(5)] + [("a", "p0", "y\nx"), ("a", "p0", "z")]
    df = spark.createDataFrame(rows, "company_id string, page_id string, clean_text string")
    got = {tuple(r["sequence"]): r["support"] for r in sitelines.closed_sequences(df).collect()}
    assert got[("x", "y")] == 5 and set(got.values()) == {5}


def test_registered_queries_mine_sequences(spark, small, monkeypatch):
    runs, mine = [], sitelines._closed
    monkeypatch.setattr(sitelines, "_closed", lambda *a: runs.append(a) or mine(*a))
    for query in (queries.p5_found, queries.p5_sequences, queries.p5_cleaned):
        query(spark, small)
    assert len(runs) == 3
