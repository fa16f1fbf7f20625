"""Garbled text from wrong character encoding (problem 4).

Each suspicious line starts a best-first search: its neighbours are the texts reached by
encoding it with one character set and decoding it with another, or by undoing escapes.
A plausibility cost, learned from the character pairs of all documents, orders
the queue; texts already seen, by hash, aren't entered again.  The cheapest text reached
replaces the line if it is clearly cheaper.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.sources.tables import cut

# Character sets that texts are wrongly read in, and that they are really in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "iso8859_15")
REALLY = ("utf-8", "cp1252", "cp1251", "koi8_r", "cp932", "euc_jp", "cp1250", "iso8859_2", "mac_roman", "cp866", "cp437", "cp850")

_SPAN = re.compile(r"(?s).[^\x00-\x7f]+")


def _pairs(text: str) -> list[str]:
    """Each character outside ASCII with the one before it."""
    return [a + b for span in _SPAN.findall(" " + text) for a, b in zip(span, span[1:])]


_ESCAPED = re.compile(r"\\u[0-9A-Fa-f]{4}")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}[0-9]{0,2}|#[0-9]{2,6}|#[xX][0-9A-Fa-f]{2,5});")
_LOST = re.compile(r"[\ufffd\x80-\x84\x86-\x9f]")
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = 24.0
#: Signs that stand anywhere in sound texts; a pair that ends in one is never as unlikely as others.
_COMMON_SIGNS = "©®™«»“”„‘’–—…€£°·•½№¿¡"
SIGN = 14.0
#: What an operation costs, and what each place of its character sets in their lists adds: sets are listed by how often texts are wrongly read in them.
STEP_COST, PLACE_COST = 4.0, 0.5


def _step_cost(step: tuple[str, str]) -> float:
    return STEP_COST + (PLACE_COST * (READ_AS.index(step[0]) + REALLY.index(step[1])) if step[0] else 0.0)


def _table(name: str) -> tuple:
    """Maps of a single-byte set for codecs; bytes it leaves open stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    text = "".join(chars)
    return {ord(c): b for b, c in reversed(list(enumerate(text)))}, text


_TABLES = {name: _table(name) for name in {*READ_AS, *REALLY} - {"utf-8", "cp932", "euc_jp"}}


def _encode(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _TABLES[name][0])[0]
    except UnicodeEncodeError:
        return None


def _decode(raw: bytes, name: str) -> str | None:
    if name in _TABLES:
        return codecs.charmap_decode(raw, "strict", _TABLES[name][1])[0]
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        pass
    if name != "utf-8":
        return None
    # a few bytes were lost on the way: keep what is sound, if it is most of it
    text = raw.decode(name, errors="replace")
    lost = text.count("\ufffd")
    sound = sum(c > "\x7f" for c in text) - lost
    return text if lost * 4 <= sound else None


@dataclass
class Plausibility:
    """Cost in bits of character pairs that end in a character outside ASCII."""

    pairs: dict[str, float] = field(default_factory=dict)
    common: frozenset = frozenset()
    good: set = field(default_factory=set)

    @classmethod
    def learn(cls, texts) -> Plausibility:
        counts: Counter = Counter()
        for text in texts:
            counts.update(_pairs(text))
        return cls.counted(counts, sum(counts.values()))

    @classmethod
    def counted(cls, counts: dict[str, int], total: int, rarest: float = 1e-7) -> Plausibility:
        """From how often each pair stands in texts of ``total`` pairs; common are those that stand 3 times and hold a share of ``rarest``."""
        pairs = {p: min(UNKNOWN, math.log2(total / n)) for p, n in counts.items() if n > 1}
        return cls(pairs, frozenset(p for p, n in counts.items() if n >= max(3, rarest * total)))

    def plain(self) -> tuple:
        """What workers need to rebuild the model; plain values need no import there."""
        return self.pairs, sorted(self.common)

    @classmethod
    def of(cls, plain: tuple) -> Plausibility:
        return cls(plain[0], frozenset(plain[1]))

    def cost(self, text: str) -> float:
        get = self.pairs.get
        total = sum(get(p) or (SIGN if p[1] in _COMMON_SIGNS and not p[0].isalpha() and ord(p[0]) < 0x250 else UNKNOWN) for p in _pairs(text))
        total += 12.0 * len(_LOST.findall(text)) + UNKNOWN * len(_ESCAPED.findall(text))
        for word in _WORD.findall(text):  # words that mix scripts or change case inside
            if not word.isascii():
                latin = sum(c < "\u0250" for c in word)
                if 0 < latin < len(word) and any("\u0370" <= c < "\u0530" for c in word):
                    total += UNKNOWN
                total += 6.0 * sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
                if len(word) < 3 and "\u0370" <= word[0] < "\u0530" and re.search("[A-Za-z]{4}", text):
                    total += 12.0
        return total

    def sound(self, text: str) -> bool:
        """A quick test: only common pairs, no escapes, no lost characters."""
        spans = _SPAN.findall(" " + text)
        if not self.good.issuperset(spans):
            for span in spans:
                if span not in self.good:
                    if not self.common.issuperset(a + b for a, b in zip(span, span[1:])):
                        return False
                    if len(self.good) >= 300_000:
                        self.good.clear()
                    self.good.add(span)
        return not _ESCAPED.search(text)


def _neighbours(text: str) -> Iterator[tuple[str, tuple[str, str]]]:
    """Texts one operation away, with the operation."""
    if _ESCAPED.search(text):
        yield re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), html.unescape(text)), ("", "")
    if text.isascii():
        return
    for wrong in READ_AS:
        raw = _encode(text, wrong)
        if raw is None:
            continue
        for right in REALLY:
            if right != wrong and (found := _decode(raw, right)) is not None and found != text:
                yield found, (wrong, right)


#: Bounds of a search: texts whose neighbours are made, operations in a row, and how much a text on the way may cost
#: of what the line costs.  Wider bounds reach sound-looking texts by chance and take sound lines for damaged (README).
MOST_STEPS, DEEPEST, DEAREST = 6, 2, 1.2


def search(text: str, model: Plausibility, most_steps: int = MOST_STEPS, deepest: int = DEEPEST, dearest: float = DEAREST) -> tuple[str, float, float, tuple]:
    """The cheapest text reached from ``text``, its cost, the cost of ``text``, and the operations.

    Texts are taken in the order of their cost, and of their number where that is equal.  The
    search ends at a sound text, when nothing is left within the bounds, or when what is left
    can't be cheaper than the best.
    """
    first = model.cost(text)
    best, best_cost, best_route = text, first, ()
    queue, seen, steps = [(first, 0, (), text)], {hash(text)}, 0
    while queue and steps < most_steps:
        _, _, route, at = heapq.heappop(queue)
        if STEP_COST * (len(route) + 1) >= best_cost:
            continue
        steps += 1
        for found, step in _neighbours(at):
            if hash(found) in seen:
                continue
            seen.add(hash(found))
            reached = model.cost(found) + sum(map(_step_cost, route)) + _step_cost(step)
            if reached < best_cost:
                best, best_cost, best_route = found, reached, (*route, step)
            if len(route) + 1 < deepest and reached < first * dearest:
                heapq.heappush(queue, (reached, len(seen), (*route, step), found))
        if best is not text and model.sound(best):
            break
    return best, best_cost, first, best_route


_PART = re.compile(r"[^\n<>]+")
_RUN = re.compile(r"[^\x00-\x7f]+(?:[ \x00-\x7f]?[^\x00-\x7f]+)*")


def follow(text: str, route: tuple) -> str | None:
    """``text`` after a known sequence of recodings."""
    for wrong, right in route:
        raw = _encode(text, wrong)
        text = _decode(raw, right) if raw is not None else None
        if text is None:
            return None
    return text


class Repair:
    """Finds and mends wrongly decoded lines; results of repeated lines are kept up to a bound.

    A line's result depends on the line alone, and a field's on the field alone.
    """

    def __init__(self, model: Plausibility, kept: int = 200_000):
        self.model, self.kept, self.known = model, kept, {}

    def line(self, line: str) -> tuple[bool, str]:
        """``(damaged, text)`` of one line or tag-free part."""
        return self._read(line)[:2]

    def _read(self, line: str) -> tuple[bool, str, tuple]:
        """``line`` with the recodings that mended it; signs written as entities are read as signs where they are damaged."""
        if line.isascii() and "\\u" not in line:
            if "&" not in line or not _ENTITY.search(line):
                return False, line, ()
            shown = html.unescape(line)
            if shown.isascii():
                return False, line, ()
            damaged, better, route = self._read(shown)
            return (True, better, route) if damaged and better != shown else (False, line, ())
        if line in self.known:
            return self.known[line]
        result = self._judge(line)
        if len(self.known) >= self.kept:
            self.known.clear()
        self.known[line] = result
        return result

    def _judge(self, line: str) -> tuple[bool, str, tuple]:
        lost = bool(_LOST.search(line))
        if not self.model.pairs:  # nothing to compare with: only lost signs tell
            return lost, line, ()
        if not lost and self.model.sound(line):
            return False, line, ()
        pairs = _pairs(line)
        rare = sum(p not in self.model.common for p in pairs)
        if lost or rare >= 3 or 4 * rare >= len(pairs) or "\\u" in line:
            best, cost, first, route = search(line, self.model)
            # what is cheaper must be so because its signs are known, not because it has fewer unknown ones
            if best != line and first - cost >= 10.0 and cost <= 0.72 * first and self._convinces(line, best) and 2 * self._odd(best) < max(self._odd(line), 1):
                return True, best, route if all(step[0] for step in route) else ()
        if not lost and rare < 2:
            return False, line, ()
        # part of the line only: mend each run on its own
        changed, parts, at = lost, [], 0
        for run in _RUN.finditer(line):
            a = run.start()
            while a > at and line[a - 1].isalpha():
                a -= 1
            b = run.end()
            while b < len(line) and line[b].isalpha():
                b += 1
            if a < at:
                continue
            piece = line[a:b]
            if self.model.sound(piece):
                continue
            better, piece_cost, piece_first, _ = search(piece, self.model)
            if better != piece and piece_first - piece_cost >= 14.0 and piece_cost <= 0.6 * piece_first and self._convinces(piece, better):
                parts += [line[at:a], better]
                at, changed = b, True
        return changed, "".join(parts) + line[at:] if parts else line, ()

    def _odd(self, text: str) -> int:
        """Pairs that aren't common, nor end in a sign that stands anywhere, and escapes."""
        return 3 * len(_ESCAPED.findall(text)) + sum(p not in self.model.common and (p[1] not in _COMMON_SIGNS or p[0].isalpha()) for p in _pairs(text))

    def _convinces(self, before: str, after: str) -> bool:
        """Several signs became one, or enough signs changed to rule out chance."""
        if _LOST.search(after):
            return False
        if len(after) < len(before):
            return True
        return sum(a != b for a, b in zip(before, after)) >= 3

    def _doubtful(self, line: str) -> bool:
        if line.isascii():
            return "\\u" in line or ("&" in line and _ENTITY.search(line) is not None)
        return not self.model.sound(line)

    def _mended_by(self, line: str, routes) -> tuple[tuple, str | None]:
        """The first of some recodings that makes the line sound, and the sound line."""
        for route in routes:
            same = follow(line, route)
            if same is not None and same != line and self.model.sound(same) and self._convinces(line, same):
                return route, same
        return (), None

    def _field_route(self, routes: list[tuple], lines: list[str]) -> tuple[tuple, dict[str, str | None]]:
        """Of some recodings the one after which the damaged lines cost least together, and what it makes of each."""
        best, least, mended = (), math.inf, {}
        for route in routes:
            after = {line: follow(line, route) for line in lines}
            cost = sum(map(_step_cost, route)) + sum(self.model.cost(line if x is None else x) for line, x in after.items())
            if cost < least:
                best, least, mended = route, cost, after
        return best, mended

    def text(self, text: str) -> tuple[bool, str]:
        """``(damaged, text)`` of a whole field; markup stays as it is.

        A field was read wrongly in one way mostly: what mended most of its signs is tried first on
        its other unsound lines, which may be too short to tell.
        """
        if text.isascii() and "\\u" not in text and not _ENTITY.search(text):
            return False, text
        unsound = [part for part in _PART.finditer(text) if self._doubtful(part.group())]
        found, gained = {}, Counter()
        for part in sorted(unsound, key=lambda p: (p.start() - p.end(), p.start())):  # the longest tell most
            line = part.group()
            route, same = self._mended_by(line, gained)
            if route:
                found[part.start()] = True, same
            else:
                bad, better, route = self._read(line)
                found[part.start()] = bad, better
            if route:
                gained[route] += len(line)
        best, mended = self._field_route(sorted(gained, key=lambda r: (-gained[r], r))[:8], [part.group() for part in unsound if found[part.start()][0]])
        damaged, parts, at = False, [], 0
        for part in unsound:
            line, (bad, better) = part.group(), found[part.start()]
            if best and not line.isascii():
                same = mended[line] if line in mended else follow(line, best)
                # a line that is damaged in any case may hold signs that no document has
                if same is not None and same != line and self._convinces(line, same) and (self.model.sound(same) or (bad and self.model.cost(same) <= 0.8 * self.model.cost(line))):
                    bad, better = True, same
            damaged |= bad
            if better != line:
                parts += [text[at : part.start()], better]
                at = part.end()
        return damaged, "".join(parts) + text[at:] if parts else text


def corpus_model(documents: DataFrame, most_pairs: int = 1 << 18) -> Plausibility:
    """Counts the character pairs of all ``documents(text)``; null texts hold none.

    Each partition adds up its pairs first; the driver sees the ``most_pairs`` most frequent and the
    total.  An alphabet has a few hundred pairs, Japanese some ten thousand.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        shown = lambda: pd.DataFrame({"pair": pd.Series(list(counts), dtype=object), "n": list(counts.values())})
        for batch in batches:
            spans: Counter = Counter()
            for text in batch["text"]:
                spans.update(_SPAN.findall(f" {text}"))
            for span, n in spans.items():
                for pair in zip(span, span[1:]):
                    counts["".join(pair)] += n
            if len(counts) > 500_000:
                yield shown()
                counts.clear()
        if counts:
            yield shown()

    known = documents.select("text").where(F.octet_length("text") != F.length("text"))
    pairs = cut(known.mapInPandas(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    return Plausibility.counted({r["pair"]: r["n"] for r in pairs.orderBy(F.desc("n"), "pair").limit(most_pairs).collect()}, total)


def sample_model(documents: DataFrame, per_language: int = 400) -> Plausibility:
    """The model of at most ``per_language`` labelled documents of each language, by hash of doc_id; for trying things out on a part of a corpus."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = documents.select("doc_id", "lang", "text").where(F.col("lang").isNotNull())
    return corpus_model(known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language))


def mend(df: DataFrame, key: str, column: str, model: Plausibility) -> DataFrame:
    """``key, damaged, restored`` of every row whose ``column`` was decoded wrongly in any part.

    ``restored`` is the cheapest text reached, or the text as it is where nothing better was
    found.  Sound, null and empty fields give no row; null keys are left out; repeated rows
    count once.  Whole texts are used.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.plain())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(Plausibility.of(shared.value))
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["t"]):
                damaged, restored = repair.text(text)
                if damaged:
                    rows.append((k, restored))
            if rows:
                yield pd.DataFrame(rows, columns=["k", "restored"])

    rows = df.select(F.col(key).alias("k"), F.col(column).alias("t")).where(F.col("k").isNotNull())
    suspicious = rows.where((F.octet_length("t") != F.length("t")) | F.col("t").contains("\\u") | F.col("t").rlike(_ENTITY.pattern))
    return suspicious.mapInPandas(run, f"k {kind}, restored string").dropDuplicates(["k"]).withColumnRenamed("k", key)


def found(fetched: DataFrame, pages: DataFrame, model: Plausibility) -> DataFrame:
    """Damaged fields of both tables: ``fetch_id, field_name, restored``."""
    in_html = mend(fetched, "fetch_id", "html", model).withColumn("field_name", F.lit("html"))
    in_text = mend(pages, "fetch_id", "clean_text", model).withColumn("field_name", F.lit("clean_text"))
    return in_html.unionByName(in_text).select("fetch_id", "field_name", "restored")
