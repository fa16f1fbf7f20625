"""Missing or wrong document language labels (problem 7).

A sparse multinomial logistic regression over TF-IDF weighted character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled
documents and calibrated by a temperature on held-out sentences.  Every full sentence of a
page is scored; a Viterbi pass joins sentences to segments of one language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm import residue as residues
from webloom.llm.encoding import Plausibility, Repair

BITS = 15
ORDERS = (1, 2, 3)
_SENTENCE = re.compile(r"[^.!?。！？…]+[.!?。！？…]+[\"'”’»)\]]*(?=\s|$)|[^。！？]+?[。！？]+|[^.!?。！？…]+(?:[.!?…](?=\S)[^.!?。！？…]*)*(?:[.!?。！？…]+[\"'”’»)\]]*)?")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?。！？…][\"'”’»)\]]*\s*$")
_MARK, _MARK_INSIDE = re.compile(r"[.!?。！？…]"), re.compile(r"[.!?。！？…]\s")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_DROP = re.compile(r"[\d�]+|\S*[/@]\S*|[(“\"«].{0,80}?[)”\"»]")


def labelled_sample(documents: DataFrame, per_language: int = 400, languages: int = 64, most_signs: int = 50_000) -> list[tuple[str, str]]:
    """``(lang, text)`` of at most ``per_language`` labelled documents of each of the ``languages`` most frequent languages.

    Documents of at most ``most_signs`` signs are chosen by the hash of doc_id; all bounds hold at any input size.
    """
    known = documents.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    named = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    known = known.where(F.length("text") <= most_signs).join(F.broadcast(named), "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).orderBy("lang", "rank").select("lang", "text")
    return [(r["lang"], r["text"]) for r in rows.toLocalIterator()]


def sentences(text: str) -> list[tuple[int, str]]:
    """Full sentences of a text with the number of their line: four words or ten CJK signs and a last sign.

    A line of nine words or thirty CJK signs without any last sign counts as one sentence.
    """
    found = []
    for number, line in enumerate(text.split("\n")):
        if len(line) >= 30 and not _MARK.search(line) and (len(_WORDS.findall(line)) >= 9 or len(_CJK.findall(line)) >= 30):
            found.append((number, line.strip()))
            continue
        if not _ENDS.search(line) and not _MARK_INSIDE.search(line) and "。" not in line:
            continue
        for m in _SENTENCE.finditer(line):
            s = m.group().strip()
            if _ENDS.search(s) and (len(_WORDS.findall(s)) >= 4 or len(_CJK.findall(s)) >= 10):
                found.append((number, s))
    return found


def gram_parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed n-grams of all texts one after another, and how many each text has."""
    cleaned = [f" {_DROP.sub(' ', t.lower())} " for t in texts]
    sizes = np.array([len(t) for t in cleaned])
    code = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # signs left in the text from here
    h = np.zeros(len(code), dtype=np.uint32)
    for k in ORDERS:
        shifted = np.zeros_like(code)
        shifted[: len(code) - k + 1] = code[k - 1 :]
        h = (h * np.uint32(0x01000193)) ^ (shifted * np.uint32(0x9E3779B1))
        mixed = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        yield mixed[rest >= k].astype(np.int32), np.maximum(sizes - k + 1, 0)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all orders, grouped by text, and the first place of each text."""
    parts = list(gram_parts(texts))
    owner = np.concatenate([np.repeat(np.arange(len(texts)), n) for _, n in parts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([f for f, _ in parts])[order], np.searchsorted(owner[order], np.arange(len(texts)))


@dataclass
class Classifier:
    languages: list[str]
    table: np.ndarray  # idf * weight for each feature and language
    bias: np.ndarray
    temperature: float
    foreign: np.ndarray  # share of characters outside ASCII in each language's sample
    spaced: np.ndarray  # share of spaces

    def of_lost_text(self, text: str, label: str | None) -> int:
        """The language of a text whose letters are mostly lost: one that is written outside ASCII.

        The label is believed if it names one; else the share of spaces decides.
        """
        fitting = np.flatnonzero(self.foreign >= 0.5)
        if not len(fitting):
            return int(self.foreign.argmax())
        named = re.split("[-_]", (label or "").lower())[0]
        for k in fitting:
            if self.languages[k] == named:
                return int(k)
        share = text.count(" ") / max(1, len(text))
        return int(fitting[np.abs(self.spaced[fitting] - share).argmin()])

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.languages)))
        out = []
        for k in range(0, len(texts), 500):
            some = texts[k : k + 500]
            z, total = np.zeros((len(some), len(self.languages))), np.zeros(len(some))
            for features, counts in gram_parts(some):
                has = counts > 0
                z[has] += np.add.reduceat(self.table.take(features, axis=0), (np.cumsum(counts) - counts)[has], axis=0)
                total += counts
            out.append(z / np.sqrt(total)[:, None] + self.bias)
        return _log_softmax(np.concatenate(out) / self.temperature)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(sample: list[tuple[str, str]], per_language: int = 700, epochs: int = 2, alpha: float = 0.6, l1: float = 0.05, l2: float = 0.05, seed: int = 5) -> tuple[Classifier, float]:
    """A classifier from ``(lang, text)`` rows, and its accuracy on a held-out tenth of the sentences."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[str]] = {}
    for lang, text in sample:
        by.setdefault(lang.lower(), []).extend(s for _, s in sentences(text))
    languages = sorted(k for k, v in by.items() if v)
    texts, labels = [], []
    for k, lang in enumerate(languages):
        own = by[lang]
        chosen = [own[i] for i in rng.permutation(len(own))[:per_language]]
        # a third of the examples are cut short, so that short sentences are known as well
        texts += [s if i % 3 else s[: max(25, len(s) // 2)] for i, s in enumerate(chosen)]
        labels += [k] * len(chosen)
    if not texts:
        return Classifier(["und"], np.zeros((1 << BITS, 1), dtype=np.float32), np.zeros(1), 1.0, np.zeros(1), np.zeros(1)), 1.0
    order = rng.permutation(len(texts))
    texts, labels = [texts[i] for i in order], np.array(labels)[order]
    held = max(1, len(texts) // 10)
    size, classes = 1 << BITS, len(languages)
    features, starts = grams(texts)
    ends = np.append(starts[1:], len(features))
    df = np.bincount(np.concatenate([np.unique(features[a:b]) for a, b in zip(starts[held:], ends[held:])] or [features]), minlength=size)
    idf = np.log((len(texts) + 1.0) / (df + 1.0)) + 1.0
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(rows):
        zz, nn = z[rows], n[rows]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((1.0 + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(np.arange(held, len(texts))), max(1, (len(texts) - held) // 32)):
            own = np.concatenate([features[starts[i] : ends[i]] for i in batch])
            lengths = ends[batch] - starts[batch]
            row = np.repeat(np.arange(len(batch)), lengths)
            value = idf[own] / np.sqrt(lengths)[row]
            used, inverse = np.unique(own, return_inverse=True)
            x = np.zeros((len(batch), len(used)))
            np.add.at(x, (row, inverse), value)
            w, b = weights(used), weights(np.array([size]))
            p = np.exp(_log_softmax(x @ w + b))
            p[np.arange(len(batch)), labels[batch]] -= 1.0
            for rows, g in ((used, x.T @ p), (np.array([size]), p.sum(axis=0, keepdims=True))):
                old = weights(rows)
                sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
                z[rows] += g - sigma * old
                n[rows] += g * g
    final = weights(np.arange(size + 1))
    joined = ["".join(by[lang][:300]) for lang in languages]
    foreign = np.array([sum(ord(c) > 127 for c in t) / max(1, len(t)) for t in joined])
    spaced = np.array([t.count(" ") / max(1, len(t)) for t in joined])
    model = Classifier(languages, (idf[:, None] * final[:size]).astype(np.float32), final[size], 1.0, foreign, spaced)
    log_p = model.log_probabilities(texts[:held])
    truth = labels[:held]
    accuracy = float((log_p.argmax(axis=1) == truth).mean())
    # calibrated on fragments of the held-out sentences: whole ones leave too few errors to learn from
    log_p = model.log_probabilities([s[a : a + 14] for s, a in zip(texts[:held], rng.integers(0, 40, held) % np.maximum(1, [len(s) - 14 for s in texts[:held]]))])
    grid = np.exp(np.linspace(np.log(0.2), np.log(5.0), 40))
    loss = [-_log_softmax(log_p / t)[np.arange(held), truth].mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model, accuracy


def viterbi(log_p: np.ndarray, stay: float = 0.98) -> np.ndarray:
    """The likeliest languages of consecutive sentences."""
    steps, classes = log_p.shape
    likeliest = log_p.argmax(axis=1)
    if classes == 1 or steps == 0 or (likeliest == likeliest[0]).all():
        return likeliest.astype(np.int64)
    keep, change = np.log(stay), np.log((1 - stay) / (classes - 1))
    score, back = log_p[0].copy(), np.zeros((steps, classes), dtype=np.int64)
    for k in range(1, steps):
        jump = int(score.argmax())
        stayed = score + keep
        jumped = score[jump] + change
        back[k] = np.where(stayed >= jumped, np.arange(classes), jump)
        score = np.maximum(stayed, jumped) + log_p[k]
    path = np.empty(steps, dtype=np.int64)
    path[-1] = int(score.argmax())
    for k in range(steps - 1, 0, -1):
        path[k - 1] = back[k][path[k]]
    return path


def page_segments(pages: DataFrame, model: Classifier, sound: Plausibility) -> DataFrame:
    """Language segments of every page with text.

    ``pages`` has fetch_id, title, language and clean_text.  Returns one row a segment:
    ``fetch_id, label, segment_no, first_line, last_line, lang, confidence, letters, main_lang,
    main_confidence, residue``.  A page without a full sentence is one segment of its whole text.
    Wrongly decoded text is mended before it is read; ``residue`` says that the page is template
    residue or an error page.  Null and blank texts give no row; null ids are left out; repeated
    rows count once.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature, model.foreign, model.spaced, sound.plain()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *parts, plain = shared.value
        model, repair, automaton = Classifier(*parts), Repair(Plausibility.of(plain)), residues.build()
        for batch in batches:
            texts = [repair.text(t)[1] for t in batch["clean_text"]]
            titles = [repair.text(t)[1] if t else t for t in batch["title"]]
            found = [sentences(t) or [(0, t)] for t in texts]
            log_p = model.log_probabilities([s for page in found for _, s in page])
            rows, at = [], 0
            for fetch_id, label, title, text, page in zip(batch["fetch_id"], batch["language"], titles, texts, found):
                own = log_p[at : at + len(page)]
                at += len(page)
                path = viterbi(own)
                if text.count("\ufffd") > sum(map(str.isalnum, text)):
                    path[:] = model.of_lost_text(text, label)
                letters = np.array([(len(s) - s.count(" ")) * (2 if _CJK.search(s) else 1) for _, s in page])
                sure = np.exp(own[np.arange(len(page)), path])
                total = np.bincount(path, weights=letters + 1e-3, minlength=len(model.languages))
                main = int(total.argmax())
                main_sure = float(np.average(sure[path == main], weights=letters[path == main] + 1e-3))
                spots, _ = residues.judge(automaton, title, text)
                cuts = np.flatnonzero(np.diff(path)) + 1
                for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(page)])):
                    sure_here = float(np.average(sure[a:b], weights=letters[a:b] + 1e-3))
                    rows.append((fetch_id, label, k, page[a][0] + 1, page[b - 1][0] + 1, model.languages[path[a]], sure_here, int(letters[a:b].sum()), model.languages[main], main_sure, spots > 0))
            yield pd.DataFrame(rows, columns=names)

    names = ["fetch_id", "label", "segment_no", "first_line", "last_line", "lang", "confidence", "letters", "main_lang", "main_confidence", "residue"]
    schema = "fetch_id bigint, label string, segment_no int, first_line int, last_line int, lang string, confidence double, letters int, main_lang string, main_confidence double, residue boolean"
    known = pages.select("fetch_id", "title", "language", "clean_text").where(F.col("fetch_id").isNotNull() & (F.trim("clean_text") != ""))
    return known.mapInPandas(run, schema).dropDuplicates(["fetch_id", "segment_no"])


def mislabelled(segments: DataFrame) -> DataFrame:
    """``fetch_id, lang``: each language of every page that is mislabelled or mixes languages, residue left out."""
    label = F.lower(F.element_at(F.split(F.coalesce("label", F.lit("")), "[-_]"), 1))
    pages = segments.where(~F.col("residue")).groupBy("fetch_id").agg(F.collect_set("lang").alias("langs"), F.first("main_lang").alias("main"), F.first(label).alias("label"))
    return pages.where((F.col("label") != F.col("main")) | (F.size("langs") > 1)).select("fetch_id", F.explode("langs").alias("lang"))
