"""Near duplicates whose sets are similar while their weights are not."""

import random

import numpy as np

from webloom.llm import neardup

S = neardup.Settings(shingle=3, threshold=0.7)


def test_repeated_passages_are_found(spark):
    random.seed(12)
    rows, want = [], set()
    for k in range(120):
        base = [f"w{random.randrange(5000)}" for _ in range(60)]
        rows += [(f"p{k:03d}a", " ".join(base)), (f"p{k:03d}b", " ".join(base * (3, 5, 10)[k % 3]))]
        want.add((f"p{k:03d}a", f"p{k:03d}b"))
    df = spark.createDataFrame(rows, "page_id string, text string")
    assert {tuple(r) for r in neardup.similar_pages(df, S).collect()} == want


def test_bands_find_pairs_at_the_threshold_whatever_their_weights():
    assert 1.2 < S.heaviest < 2 and neardup.Settings().heaviest == 2
    rng = np.random.default_rng(4)
    sampler = neardup.Sampler(S)
    missed = low = 0
    for _ in range(600):
        # 140 shared shingles of the least weight, 30 on either side of the greatest: similarity 0.7
        h = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = np.sort(h[:170]), np.sort(np.concatenate((h[:140], h[170:])))
        heavy = set(h[140:].tolist())
        weight = np.log([S.heaviest if x in heavy else 1.0 for x in [*a.tolist(), *b.tolist()]]).astype(np.float32)
        bands, sketch = sampler.band_hashes(np.concatenate((a, b)), weight, np.array([0, 170, 340]))
        missed += not (bands[0] == bands[1]).any()
        low += (sketch[0] == sketch[1]).sum() < S.least_agreeing
    assert missed <= 6 and low <= 2
