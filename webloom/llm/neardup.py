"""Near-duplicate records with small edits (problem 2).

Word shingles of a text's set are weighted by damped inverse document frequency and sampled by
improved consistent weighted sampling: two texts agree on a sample with the probability of
their weighted Jaccard similarity.  A repeated passage leaves the set as it is, so how often a
shingle stands in a text doesn't count.  The weights are damped so far that bands find any pair
at the threshold.  Bands of samples are hashed to buckets; texts of a bucket are compared
exactly.  Equal texts form
one class from the start and are compared once.  Document frequencies are counted over all
texts, in a table of hashed shingles of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.sources.tables import cut, cut_table

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    """``shingle`` words a shingle; pairs reach ``threshold``; bands * rows samples a text.

    ``df_bits``: size of the hashed document-frequency table, 2**df_bits counters.  Buckets of
    more than ``bucket_limit`` different texts are joined through their rarest shingles instead
    of pair by pair, which finds every pair that reaches the threshold.  Bands miss a pair at
    the threshold, however its weights lie, with a probability of ``most_missed`` at most; pairs
    whose estimate is under ``least_estimate``, or 4 standard deviations under the least
    weighted similarity of such a pair if that is lower, aren't compared.  ``similarity``: pairs
    are verified by the Jaccard similarity of their shingle "sets", or by that of the "weights"
    of their shingles.
    """

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 3
    df_bits: int = 20
    bucket_limit: int = 256
    least_estimate: float = 0.33
    most_missed: float = 0.002
    weighted: bool = True
    similarity: str = "sets"
    seed: int = 11

    @property
    def heaviest(self) -> float:
        """The largest weight, where the least is 1: 2, or less if bands would miss pairs at the threshold of plain sets."""
        if self.similarity == "weights":
            return 2.0
        needed = (1.0 - self.most_missed ** (1.0 / self.bands)) ** (1.0 / self.rows)
        return float(np.clip(self.threshold * (1.0 - needed) / (needed * max(1.0 - self.threshold, 1e-9)), 1.0, 2.0))

    @property
    def least_weighted(self) -> float:
        """The least weighted similarity of two sets at the threshold: what they share weighs 1, the rest ``heaviest``."""
        return self.threshold if self.similarity == "weights" else self.threshold / (self.threshold + (1.0 - self.threshold) * (self.heaviest if self.weighted else 1.0))

    @property
    def least_plain(self) -> float:
        """The least similarity of the plain sets of a pair: of weights at the threshold, what they share may weigh ``heaviest``."""
        return self.threshold if self.similarity == "sets" or not self.weighted else self.threshold / (self.threshold + (1.0 - self.threshold) * self.heaviest)

    @property
    def least_agreeing(self) -> float:
        """Samples on which two texts agree at least to be compared."""
        n, p = self.bands * self.rows, self.least_weighted
        return min(self.least_estimate * n, n * p - 4.0 * (n * p * (1.0 - p)) ** 0.5)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_batch(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, hashes, counts, starts)``: text classes and each text's distinct shingles, sorted by hash.

    Words are lower-cased and split at white space.  ``starts`` has one entry more than texts,
    which are 1024 at most.
    """
    split = [t.lower().split() for t in texts]
    keys = np.array([xxhash.xxh64_intdigest(" ".join(w)) for w in split], dtype=np.uint64).view(np.int64)
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    codes, unique = pd.factorize(np.array([w for ws in split for w in ws], dtype=object)) if sizes.sum() else (np.empty(0, dtype=np.int64), [])
    word = np.array([xxhash.xxh64_intdigest(w) for w in unique], dtype=np.uint64)[codes] if len(unique) else np.empty(0, dtype=np.uint64)
    grams = np.maximum(sizes - shingle + 1, 0)
    doc = np.repeat(np.arange(len(texts)), grams)
    first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(shingle):
        h = _mixed(h * _GOLDEN + word[first + k])
    # one sort orders texts and shingles: the text's number in the upper 10 bits, 54 bits of the hash
    both = np.sort((doc.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10)))
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(both)))
    starts = np.searchsorted(both[at], np.arange(len(texts), dtype=np.uint64) << np.uint64(54))
    return keys, both[at] << np.uint64(10), counts, np.append(starts, len(at))


class Sampler:
    """Consistent weighted samples; a sample's random values come from tables indexed by the shingle's hash."""

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        n = 1 << 16
        self.settings = settings
        r, beta, c = rng.gamma(2.0, 1.0, n), rng.random(n), rng.gamma(2.0, 1.0, n)
        self.r, self.rate, self.beta = r.astype(np.float32), (1.0 / r).astype(np.float32), beta.astype(np.float32)
        self.offset = (np.log(c) + r * (beta - 1.0)).astype(np.float32)
        self.factors = rng.integers(1, 2**63, settings.bands * settings.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def band_hashes(self, hashes: np.ndarray, log_weight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One 64-bit bucket for each text and band, and one byte of each sample; every text must have a shingle."""
        s = self.settings
        sketch = np.empty((len(starts) - 1, s.bands * s.rows), dtype=np.uint8)
        out = np.empty((len(starts) - 1, s.bands), dtype=np.uint64)
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for band in range(s.bands):
            mixed = np.full(len(sizes), band + 1, dtype=np.uint64)
            for row in range(s.rows):
                # the upper 16 bits of the product choose the random values
                at = (hashes * self.factors[band * s.rows + row]).astype("<u8", copy=False).view("<u2")[3::4].astype(np.intp)
                t = np.floor(log_weight * self.rate.take(at) + self.beta.take(at))
                score = self.offset.take(at) - self.r.take(at) * t
                best = np.minimum.reduceat(score, starts[:-1])
                hit = np.flatnonzero(score == best.take(owner))
                first = hit[np.searchsorted(hit, starts[:-1])]
                sample = hashes[first] + t[first].astype(np.int64).view(np.uint64) * _GOLDEN
                sample = _mixed(sample)
                sketch[:, band * s.rows + row] = sample >> np.uint64(56)
                mixed = _mixed(mixed * _GOLDEN + sample)
            out[:, band] = mixed
        return out.view(np.int64), sketch


_CHUNK = 400


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    for k in range(0, len(texts), _CHUNK):
        yield texts[k : k + _CHUNK]


def document_frequencies(pages: DataFrame, settings: Settings) -> np.ndarray:
    """Texts for each hashed shingle, over all texts: 2**df_bits counters, whatever the input's size.

    Each partition adds up its counters first; blocks of them are then summed in a shuffle.
    """
    size, block = 1 << settings.df_bits, 1 << max(0, settings.df_bits - 8)
    shift = np.uint64(64 - settings.df_bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for texts in _chunks(list(batch["text"])):
                _, hashes, _, _ = shingle_batch(texts, settings.shingle)
                total += np.bincount((hashes >> shift).astype(np.int64), minlength=size)
        for k in range(0, size, block):
            part = total[k : k + block]
            if part.any():
                yield pd.DataFrame({"block": [k], "counts": [part.astype("<u4").tobytes()]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, dtype="<u4").astype(np.int64) for c in part["counts"]], axis=0)
        return pd.DataFrame({"block": part["block"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})

    parts = pages.select("text").mapInPandas(count, "block bigint, counts binary")
    frequencies = np.zeros(size, dtype=np.int64)
    for row in parts.groupBy("block").applyInPandas(add, "block bigint, counts binary").collect():  # 256 blocks at most
        frequencies[row["block"] : row["block"] + block] = np.frombuffer(row["counts"], dtype="<i8")
    return frequencies


def _weights(frequencies: np.ndarray, texts: int, heaviest: float) -> np.ndarray:
    """Damped inverse document frequency of each counter, 1 to ``heaviest``."""
    top = np.log(texts + 1.0)
    return (1.0 + (heaviest - 1.0) * np.log((texts + 1.0) / np.maximum(frequencies, 1)).clip(0) / max(top, 1e-9)).astype(np.float32)


def signatures(pages: DataFrame, weights: np.ndarray | None, settings: Settings) -> DataFrame:
    """``key, n, bucket, sketch``: one row for each band of each different text of a partition.

    ``sketch``, a byte of every sample, stands on the first band's row only.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(weights) if weights is not None else None
    shift = np.uint64(64 - settings.df_bits)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, seen = Sampler(settings), set()
        for batch in batches:
            for texts in _chunks(list(batch["text"])):
                keys, hashes, _, starts = shingle_batch(texts, settings.shingle)
                fresh = np.zeros(len(texts), dtype=bool)
                for k, key in enumerate(keys.tolist()):
                    if key not in seen:
                        seen.add(key)
                        fresh[k] = starts[k + 1] > starts[k]
                if not fresh.any():
                    continue
                sizes = np.diff(starts)
                keep = np.repeat(fresh, sizes)
                hashes, sizes, keys = hashes[keep], sizes[fresh], keys[fresh]
                weight = shared.value[(hashes >> shift).astype(np.int64)] if shared is not None else np.ones(len(hashes), dtype=np.float32)
                bands, sketch = sampler.band_hashes(hashes, np.log(weight).astype(np.float32), np.append(0, np.cumsum(sizes)))
                sketches = np.full(bands.size, None, dtype=object)
                sketches[:: settings.bands] = [row.tobytes() for row in sketch]
                yield pd.DataFrame({"key": np.repeat(keys, settings.bands), "n": np.repeat(sizes, settings.bands).astype(np.int32), "bucket": bands.ravel(), "sketch": sketches})

    return pages.select("text").mapInPandas(sign, "key bigint, n int, bucket bigint, sketch binary")


class _Filter:
    """A Bloom filter of fixed size over keys; it may pass other keys, never stops a known one."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        h = _mixed(keys.view(np.uint64) * _GOLDEN)
        return np.stack([(h >> np.uint64(k)) & np.uint64(size - 1) for k in (0, 13, 26)]).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[self.places(keys, len(self.bits))].all(axis=0)


def key_filter(keys: DataFrame, bits: int = 22) -> _Filter:
    """A filter of ``keys(key)``, 2**bits places at any input size; partial filters are merged in two steps."""
    size = 1 << bits

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, group = np.zeros(size, dtype=bool), 0
        for batch in batches:
            own[_Filter.places(batch["key"].to_numpy(), size)] = True
            group = int(batch["key"].iloc[0]) & 15 if len(batch) else group
        if own.any():
            yield pd.DataFrame({"part": [group], "bits": [np.packbits(own).tobytes()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in part["bits"]])
        return pd.DataFrame({"part": part["part"].iloc[:1], "bits": [whole.tobytes()]})

    found = np.zeros(size // 8, dtype=np.uint8)
    for row in keys.select("key").mapInPandas(mark, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect():  # 16 rows at most
        found |= np.frombuffer(row["bits"], dtype=np.uint8)
    return _Filter(np.unpackbits(found).astype(bool))


def shingle_sets(pages: DataFrame, needed: DataFrame, settings: Settings) -> DataFrame:
    """``key, shingles`` of the needed texts: sorted shingle hashes (32 bits each) as one binary value."""
    shared = pages.sparkSession.sparkContext.broadcast(key_filter(needed).bits)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, known = set(), _Filter(shared.value)
        for batch in batches:
            for texts in _chunks(list(batch["text"])):
                keys = np.array([xxhash.xxh64_intdigest(" ".join(t.lower().split())) for t in texts], dtype=np.uint64).view(np.int64)
                wanted = [t for t, ok in zip(texts, known.has(keys)) if ok]
                if not wanted:
                    continue
                keys, hashes, _, starts = shingle_batch(wanted, settings.shingle)
                rows = []
                for k, key in enumerate(keys.tolist()):
                    if key not in seen:
                        seen.add(key)
                        rows.append((key, (hashes[starts[k] : starts[k + 1]] >> np.uint64(32)).astype("<u4").tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "shingles"])

    return pages.select("text").mapInPandas(sets, "key bigint, shingles binary").join(needed, "key", "left_semi").dropDuplicates(["key"])


def _size_fits(a, b, threshold: float):
    return F.least(a, b) >= threshold * F.greatest(a, b)


def _agreeing(settings: Settings):
    least = settings.least_agreeing

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch["x"]), dtype=np.uint8).reshape(len(batch), -1)
                y = np.frombuffer(b"".join(batch["y"]), dtype=np.uint8).reshape(len(batch), -1)
                yield batch.loc[(x == y).sum(axis=1) >= least, ["a", "b"]]

    return agree


def candidates(signed: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` (a < b) of different texts to compare, and the ``key`` of texts in crowded buckets."""
    once = signed.select("bucket", "key").repartition("bucket").dropDuplicates(["bucket", "key"])
    shared = cut(once.withColumn("members", F.count("*").over(Window.partitionBy("bucket"))).where("members > 1"))
    sketches = signed.where(F.col("sketch").isNotNull()).select("key", "n", "sketch").dropDuplicates(["key"])
    member = shared.where(F.col("members") <= settings.bucket_limit).join(sketches, "key").groupBy("bucket").agg(F.collect_list(F.struct("key", "n", "sketch")).alias("m"))
    pairs = member.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.key < y.key").where(_size_fits(F.col("x.n"), F.col("y.n"), settings.least_plain))
    flat = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.sketch").alias("x"), F.col("y.sketch").alias("y"))
    near = flat.mapInPandas(_agreeing(settings), "a bigint, b bigint").distinct()
    return near, shared.where(F.col("members") > settings.bucket_limit).select("key").distinct()


#: Crowded texts of one shingle and length class that one task compares; more are spread over several.
HOT_TEXTS = 2_000


def crowded_candidates(sets: DataFrame, crowded: DataFrame, weights: np.ndarray | None, settings: Settings) -> DataFrame:
    """Every pair ``a, b`` of crowded texts that can reach the threshold, once, by prefix filtering.

    Two sets reach a Jaccard similarity t only if their n - ceil(t * n) + 1 rarest shingles
    meet; shingles are ordered by document frequency, then hash.  A pair comes out at the first
    shingle that both prefixes hold, and only if what follows it can still reach t.  Texts meet
    within their length class and the next one, and those of a hot shingle in slices.
    """
    shared = sets.sparkSession.sparkContext.broadcast(weights) if weights is not None else None
    shift = np.uint32(32 - settings.df_bits)
    t = settings.least_plain

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for key, raw in zip(batch["key"], batch["shingles"]):
                own = np.frombuffer(raw, dtype="<u4")
                rare = -shared.value[own >> shift] if shared is not None else np.zeros(len(own))
                order = np.lexsort((own, rare))[: len(own) - int(np.ceil(t * len(own) - 1e-9)) + 1]
                first = own[order].astype(np.int64)
                parts.append(pd.DataFrame({"key": key, "n": np.int32(len(own)), "place": np.arange(len(first), dtype=np.int32), "shingle": first, "before": [first[:k].tolist() for k in range(len(first))]}))
            if parts:
                yield pd.concat(parts)

    rows = sets.join(crowded, "key", "left_semi").mapInPandas(prefixes, "key bigint, n int, place int, shingle bigint, before array<bigint>")
    rows = cut_table(rows.withColumn("length", F.floor(F.log("n") / -np.log(t) + F.lit(1e-9)).cast("int") if t < 1 else F.col("n")))
    hot = rows.groupBy("shingle", "length").agg(F.count("*").alias("m")).where(F.col("m") > HOT_TEXTS)
    # a class is sliced by the number of its texts and of those one class longer that meet them
    slices = hot.union(hot.select("shingle", F.col("length") - 1, "m")).groupBy("shingle", "length").agg(F.ceil(F.sum("m") / HOT_TEXTS).cast("int").alias("slices"))
    x = rows.join(slices, ["shingle", "length"], "left").withColumn("slice", F.pmod(F.xxhash64("key"), F.coalesce("slices", F.lit(1))))
    y = rows.withColumn("own", F.col("length")).withColumn("length", F.explode(F.array(F.col("length"), F.col("length") - 1)))
    y = y.join(slices, ["shingle", "length"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("slices", F.lit(1)).cast("bigint") - 1)))
    x, y = x.alias("x"), y.alias("y")
    # one order of the two: by class, then by key
    ordered = (F.col("y.own") > F.col("x.length")) | (F.col("x.key") < F.col("y.key"))
    needed = F.lit(t / (1.0 + t)) * (F.col("x.n") + F.col("y.n")) - 1e-9
    reachable = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) - 1 >= needed
    first = ~F.arrays_overlap("x.before", "y.before")
    pairs = x.join(y, ["shingle", "length", "slice"]).where(ordered & _size_fits(F.col("x.n"), F.col("y.n"), t) & reachable & first)
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))


def _verify(settings: Settings, weights):
    """``weights``: the broadcast weight of each counter, or None."""
    shift = np.uint32(32 - settings.df_bits)
    weighed = settings.similarity == "weights" and weights is not None

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            similarity = np.zeros(len(batch))
            for k, (x, y) in enumerate(zip(batch["x"], batch["y"])):
                x, y = np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4")
                common = np.intersect1d(x, y, assume_unique=True)
                if weighed:
                    both, every = (float(weights.value[h >> shift].sum(dtype=np.float64)) for h in (common, np.concatenate((x, y))))
                else:
                    both, every = len(common), len(x) + len(y)
                similarity[k] = both / (every - both) if every > both else 1.0
            keep = similarity >= settings.threshold
            yield pd.DataFrame({"a": batch["a"][keep], "b": batch["b"][keep], "similarity": similarity[keep]})

    return verify


def similar_texts(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pairs ``a, b, similarity`` of different texts (by key, a < b) at or above the threshold.

    ``pages`` has a column ``text``.  Texts with fewer words than a shingle are similar to equal
    texts only.  Similarity is that of the sets of distinct shingles.
    """
    pages = pages.where(F.col("text").isNotNull())
    weights = None
    if settings.weighted:
        frequencies = document_frequencies(pages, settings)
        weights = _weights(frequencies, pages.count(), settings.heaviest)
    signed = cut_table(signatures(pages, weights, settings))
    near, crowded = candidates(signed, settings)
    near, crowded = cut(near), cut(crowded)
    needed = near.select(F.col("a").alias("key")).union(near.select("b")).union(crowded).distinct()
    sets = cut(shingle_sets(pages, cut(needed), settings))
    if not crowded.isEmpty():
        near = near.unionByName(crowded_candidates(sets, crowded, weights, settings)).distinct()
    shared = pages.sparkSession.sparkContext.broadcast(weights) if settings.similarity == "weights" and weights is not None else None
    left = near.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(_verify(settings, shared), "a bigint, b bigint, similarity double")


def text_classes(pages: DataFrame) -> DataFrame:
    """``page_id, key``: equal texts (lower-cased words) share a key; null texts and ids are left out."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = [xxhash.xxh64_intdigest(" ".join(t.lower().split())) for t in batch["text"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "key": np.array(digests, dtype=np.uint64).view(np.int64)})

    known = pages.select("page_id", "text").where(F.col("text").isNotNull() & F.col("page_id").isNotNull())
    return known.mapInPandas(keys, "page_id string, key bigint").dropDuplicates(["page_id"])


def similar_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All pairs ``page_id_a, page_id_b`` (a < b) of ``pages(page_id, text)`` at or above the threshold.

    Equal texts under two ids are pairs too; this expansion is what the result's form asks for.
    """
    classes = cut(text_classes(pages))
    pairs = similar_texts(pages.select("text"), settings)
    a = classes.select(F.col("page_id").alias("pa"), F.col("key").alias("a"))
    b = classes.select(F.col("page_id").alias("pb"), F.col("key").alias("b"))
    across = pairs.join(a, "a").join(b, "b").select("pa", "pb")
    copies = classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    repeated = cut(classes.join(copies, "key"))
    equal = repeated.select(F.col("page_id").alias("pa"), "key").join(repeated.select(F.col("page_id").alias("pb"), "key"), "key").where("pa < pb").select("pa", "pb")
    return across.unionByName(equal).select(F.least("pa", "pb").alias("page_id_a"), F.greatest("pa", "pb").alias("page_id_b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: connected components of ``edges(a, b)``; the root is the smallest node reached.

    Each round hooks every node to the smallest root of its neighbours, then halves the paths;
    rounds end when nothing changes.  Labels live in checkpoints, never on the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        fresh = cut(hooked.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        changed = not fresh.where("root <> old").isEmpty()
        labels = fresh.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def groups(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a page: ``page_id, class_id, links, group_id``.

    class_id: pages of equal text; links: different texts similar to it; group_id: pages joined
    by a chain of similar texts.  Pages with null text are left out; repeated rows count once.
    """
    classes = text_classes(pages)
    edges = cut(similar_texts(pages.select("text"), settings).select("a", "b"))
    degree = edges.select(F.col("a").alias("key")).union(edges.select("b")).groupBy("key").agg(F.count("*").alias("links"))
    roots = components(edges)
    joined = classes.join(degree, "key", "left").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    return joined.select("page_id", F.col("key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("group_id"))
