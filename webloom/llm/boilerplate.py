"""Page boilerplate mixed with main content (problem 6).

Pages of a host are put in the order of their URL paths and each is compared with its nearest
neighbours: their lines are aligned by longest common subsequence and shared lines deleted.
A run of labels is deleted where it holds a shared line; what was deleted on several hosts is
deleted where no neighbour showed it.  The html only breaks ties: it tells headings and
running text from labels, and which runs are links, whose texts differ while the place is shared.
Without it, pages are judged by their lines alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm import markup
from webloom.llm import residue as residues
from webloom.llm.encoding import Plausibility, Repair
from webloom.sources.tables import cut

#: Pages of a host in URL order that one task holds; the pages beside a block are read with it.
BLOCK_PAGES = 200
#: Pages read on each side of a block.
EDGE_PAGES = 16
#: Neighbours on each side in URL order.
NEIGHBOURS = 4
_SPLIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\s+(?:[/»>›|·•→]|&gt;)\s+")
_DIGITS = re.compile(r"[0-9]+")
_UNKNOWN = 9


def _hash(text: str) -> int:
    """64-bit hash of a line: inner white space one space, lower case, digits masked."""
    return xxhash.xxh64_intdigest(_DIGITS.sub("#", " ".join(text.lower().split())))


def _parts(text: str) -> list[int]:
    """Hashes of a line's sentences or of the labels of a trail."""
    return [_hash(p) for p in _SPLIT.split(text) if p and p.strip()]


def _pack(values) -> bytes:
    return np.array(values, dtype="<u8").tobytes()


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"/+$", "")


_SIGN = re.compile(r"[.!?。！？…:]\W*$")


_LABEL, _NOTICE = 1, 2


def _label(line: str) -> int:
    """_NOTICE for a copyright line, _LABEL for a few words without a last sign, else 0."""
    if len(line) > 90 or len(line.split()) > 9:
        return 0
    if line.lstrip().startswith(("©", "(c) ", "(C) ", "Copyright ")):
        return _NOTICE
    return _LABEL if len(line) <= 60 and len(line.split()) <= 7 and not _SIGN.search(line) else 0


def page_tokens(pages: DataFrame, model: Plausibility) -> DataFrame:
    """``fetch_id, lines, parts, sizes, labels, filled``: packed hashes of each page's lines, and of their parts.

    sizes: parts of each line (0 for blank lines); labels: lines of a few words and copyright lines; filled:
    residue holds much of the page.  Wrongly decoded lines are mended first.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, repair = residues.build(), Repair(Plausibility.of(shared.value))
        for batch in batches:
            rows = []
            for fetch_id, title, text in zip(batch["fetch_id"], batch["title"], batch["clean_text"]):
                lines, parts, sizes, labels = [], [], [], []
                text = repair.text(text)[1]
                for line in text.split("\n"):
                    labels.append(_label(line))
                    own = _parts(line)
                    lines.append(_hash(line) if line.strip() else 0)
                    parts += own
                    sizes.append(len(own))
                filled = residues.judge(automaton, title, text)[1] >= 0.3
                rows.append((fetch_id, _pack(lines), _pack(parts), np.array(sizes, dtype="<u4").tobytes(), bytes(labels), filled))
            yield pd.DataFrame(rows, columns=["fetch_id", "lines", "parts", "sizes", "labels", "filled"])

    known = pages.select("fetch_id", "title", "clean_text").where(F.col("clean_text") != "")
    return known.mapInPandas(run, "fetch_id bigint, lines binary, parts binary, sizes binary, labels binary, filled boolean")


def layout_tokens(fetched: DataFrame, model: Plausibility) -> DataFrame:
    """``fetch_id, shown, kinds``: hashes and kinds of the lines that the html shows, mended first."""
    shared = fetched.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(Plausibility.of(shared.value))
        for batch in batches:
            rows = []
            for fetch_id, source in zip(batch["fetch_id"], batch["html"]):
                shown = markup.lines(source)
                texts = [t for t, _, _ in shown]
                mended = repair.text("\n".join(texts))[1].split("\n")  # as one field: its lines are damaged alike
                if len(mended) != len(texts):
                    mended = [repair.line(t)[1] for t in texts]
                rows.append((fetch_id, _pack([_hash(t) for t in mended]), bytes(k for _, k, _ in shown)))
            yield pd.DataFrame(rows, columns=["fetch_id", "shown", "kinds"])

    known = fetched.select("fetch_id", "html").where(F.col("fetch_id").isNotNull() & F.col("html").isNotNull())
    return known.mapInPandas(run, "fetch_id bigint, shown binary, kinds binary")


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lines of tokens, as pairs of places (Hunt and Szymanski)."""
    places = defaultdict(list)
    for j, token in enumerate(b):
        places[token].append(j)
    tails: list[int] = []
    nodes: list[tuple] = []
    for i, token in enumerate(a):
        for j in reversed(places.get(token, ())):
            k = bisect_left(tails, j)
            node = (i, j, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k] = j
                nodes[k] = node
    found, node = [], nodes[-1] if nodes else None
    while node:
        found.append((node[0], node[1]))
        node = node[2]
    return found[::-1]


def _numbered(tokens: list[int]) -> list[int]:
    """Tokens with repeats told apart by their number; blank ones match nothing."""
    seen: dict[int, int] = defaultdict(int)
    found = []
    for n, token in enumerate(tokens):
        seen[token] += 1
        found.append(-1 - n if not token else token if seen[token] == 1 else hash((token, seen[token])))
    return found


def line_kinds(lines: list[int], shown: list[int], kinds: bytes) -> list[int]:
    """The kind of each line of text, from the html line it is aligned with, or that stands in its place."""
    result = [_UNKNOWN] * len(lines)
    numbered = [_numbered(lines), _numbered(shown)]
    matched = align(*numbered)
    for i, j in matched:
        result[i] = kinds[j]
    # lines that were damaged in one of the two: equal gaps between matches hold the same lines
    last_i = last_j = -1
    for i, j in [*matched, (len(lines), len(shown))]:
        if i - last_i == j - last_j:
            for k in range(1, i - last_i):
                result[last_i + k] = kinds[last_j + k]
        last_i, last_j = i, j
    by_text = {h: k for h, k in zip(shown, kinds)}
    return [by_text.get(x, k) if k == _UNKNOWN else k for x, k in zip(lines, result)]


def _body(lines: list[int], kinds: list[int], labels: bytes) -> frozenset[int]:
    """Running lines of a page but for copyright lines and texts before a button."""
    answered = [a == markup.TEXT and b == markup.BUTTON for a, b in zip(kinds, [*kinds[1:], None])]
    return frozenset(x for x, k, label, before in zip(lines, kinds, labels, answered) if x and k in (markup.TEXT, _UNKNOWN) and label != _NOTICE and not before)


def copy_test(pages: list[list[int]], running: list[frozenset[int]]) -> Callable[[int, int], bool]:
    """Whether two pages of a block are copies of one page, which share their body.

    Lines that stand on many different pages (at least 3, and a quarter of them; equal pages
    count once) are no body.  Copies are equal pages, or pages with equal bodies, or pages
    that share more than one line and over half of the shorter body.
    """
    different = set(running)
    often = Counter(x for lines in different for x in lines)
    bodies = [frozenset(x for x in lines if often[x] < max(3, len(different) / 4)) for lines in running]

    def copies(x: int, y: int) -> bool:
        a, b = bodies[x], bodies[y]
        both = len(a & b)
        return pages[x] == pages[y] or (both > 0 and a == b) or (both > 1 and both * 2 > min(len(a), len(b)))

    return copies


#: What is said of a line: deleted; open until other hosts are heard; doubtful (the last label before running text
#: may be its heading); alone (a label between two running lines, a heading).
FURNITURE, OPEN, DOUBTFUL, ALONE = 1, 0, 2, 3


@dataclass
class _Page:
    fetch_id: int
    lines: list[int]
    kinds: list[int]
    parts: list[list[int]]
    labels: bytes
    filled: bool
    edge: bool

    def __post_init__(self):
        #: Lines that aren't blank, and the number of the run of labels that each is in (-1: running text or heading).
        self.places = [n for n, x in enumerate(self.lines) if x]
        self.run = [-1] * len(self.lines)
        self.runs: list[list[int]] = []
        before = False
        for n in self.places:
            k = self.kinds[n]
            inside = k in (markup.LINK, markup.BUTTON, markup.LOOSE) or (k == _UNKNOWN and self.labels[n] > 0)
            if inside:
                if not before:
                    self.runs.append([])
                self.run[n] = len(self.runs) - 1
                self.runs[-1].append(n)
            before = inside
        #: Lines that nothing but the text shows to be labels and that may be headings of what follows.
        self.alone, self.doubtful = set(), set()
        for own in self.runs:
            n = own[-1]
            if self.kinds[n] == _UNKNOWN and self.labels[n] == _LABEL and n != self.places[-1]:
                (self.alone if len(own) == 1 else self.doubtful).add(n)

    def links(self, run: list[int]) -> bool:
        return any(self.kinds[n] == markup.LINK for n in run)

    def slots(self) -> list[int]:
        """The place of each run: before, between or after the running lines."""
        running = [n for n in self.places if self.run[n] < 0 and self.kinds[n] != _UNKNOWN]
        return [0 if not running or run[0] < running[0] else 2 if run[0] > running[-1] else 1 for run in self.runs]

    def tokens(self) -> list[int]:
        """What is aligned of each line: its text; headings, blank lines and labels that stand alone match nothing."""
        silent = [n for n, k in enumerate(self.kinds) if k == markup.HEADING or n in self.alone]
        return _numbered([0 if n in silent else x for n, x in enumerate(self.lines)]) if silent else _numbered(self.lines)


def _read_page(row) -> _Page:
    lines = np.frombuffer(row.lines, dtype="<u8").tolist()
    kinds = [_UNKNOWN] * len(lines) if row.shown is None else line_kinds(lines, np.frombuffer(row.shown, dtype="<u8").tolist(), row.kinds)
    cuts = np.concatenate(([0], np.cumsum(np.frombuffer(row.sizes, dtype="<u4"), dtype=np.int64))).tolist()
    parts = np.frombuffer(row.parts, dtype="<u8").tolist()
    return _Page(row.fetch_id, lines, kinds, [parts[a:b] for a, b in zip(cuts, cuts[1:])], row.labels, row.filled, row.edge)


def shared_lines(pages: list[_Page]) -> list[set[int]]:
    """The lines that each page of a block, in URL order, shares with its nearest neighbours that aren't copies of it.

    A page with runs of labels that none of these neighbours shares, say one in another language,
    is aligned with the nearest pages of the block that hold a line of such a run.
    """
    shared: list[set[int]] = [set() for _ in pages]
    tokens = [p.tokens() for p in pages]
    copies = copy_test([p.lines for p in pages], [_body(p.lines, p.kinds, p.labels) for p in pages])
    pairs: set[tuple[int, int]] = set()

    def compare(x: int, y: int) -> None:
        pair = (min(x, y), max(x, y))
        if pair not in pairs:
            pairs.add(pair)
            for i, j in align(tokens[pair[0]], tokens[pair[1]]):
                shared[pair[0]].add(i)
                shared[pair[1]].add(j)

    for x in range(len(pages)):
        for side in (range(x + 1, min(len(pages), x + 1 + EDGE_PAGES)), range(x - 1, max(-1, x - 1 - EDGE_PAGES), -1)):
            for y in islice((y for y in side if not copies(x, y)), NEIGHBOURS):
                compare(x, y)
    holders: dict[int, list[int]] = defaultdict(list)
    for x, page in enumerate(pages):
        for line in {page.lines[n] for run in page.runs for n in run if n not in page.alone}:
            holders[line].append(x)
    for x, page in enumerate(pages):
        for run in page.runs:
            own = [n for n in run if n not in page.alone]
            if own and shared[x].isdisjoint(own):
                near = sorted({y for n in own for y in _nearest(holders[page.lines[n]], x)}, key=lambda y: (abs(x - y), y))
                for y in islice((y for y in near if not copies(x, y)), NEIGHBOURS):
                    compare(x, y)
    return shared


def _nearest(places: list[int], x: int) -> list[int]:
    """Of sorted places, up to NEIGHBOURS on either side of ``x``."""
    k = bisect_left(places, x)
    return places[max(0, k - NEIGHBOURS) : k] + places[k + 1 : k + 1 + NEIGHBOURS]


def judge_page(page: _Page, told: list[bool], seeded: list[bool], deleted: set[int]) -> list[tuple]:
    """Rows ``fetch_id, line_no, state, run, parts`` of one page: what is deleted, and what other hosts may yet show to be furniture.

    ``told``: lines that are shared; ``seeded``: runs that are deleted; ``deleted``: texts of the
    block's shared lines.  Labels of a deleted run go along with its shared lines; what is neither
    shared nor a label stays.  Running text is deleted where it is shared and stands among deleted lines.
    """
    lines, kinds, parts, short = page.lines, page.kinds, page.parts, page.labels
    state = [False] * len(lines)
    for run, sure in zip(page.runs, seeded):
        for n in run:
            state[n] = sure and n not in page.alone and (told[n] or (n not in page.doubtful and (kinds[n] != markup.LOOSE or short[n] > 0 or (len(parts[n]) > 1 and all(p in deleted for p in parts[n])))))
    place = {n: k for k, n in enumerate(page.places)}

    def beside(n: int) -> list[int | None]:
        k = place[n]
        return [page.places[k - 1] if k else None, page.places[k + 1] if k + 1 < len(page.places) else None]

    goes = list(page.run)  # the run that a line goes along with, if other hosts show it to be furniture
    for n in page.places:  # running text: shared, and set among other furniture
        if page.run[n] < 0 and kinds[n] != markup.HEADING:
            before, after = beside(n)
            among = any(m is None or state[m] for m in (before, after))
            if short[n] == _NOTICE:
                state[n] = among
                goes[n] = max(page.run[m] for m in (before, after) if m is not None) if len(page.places) > 1 else -1
            elif not page.filled:
                answered = after is not None and kinds[n] == markup.TEXT and kinds[after] == markup.BUTTON
                state[n] = (answered and state[after]) or (among and told[n])
                goes[n] = page.run[after] if answered else -1
    rows = []
    for n in page.places:
        if state[n]:
            rows.append((page.fetch_id, n + 1, FURNITURE, page.run[n], _signed(parts[n]) if told[n] or page.run[n] < 0 else []))
        elif n in page.alone or kinds[n] == markup.HEADING:
            rows.append((page.fetch_id, n + 1, ALONE, -1, _signed(parts[n])))
        elif n in page.doubtful:
            rows.append((page.fetch_id, n + 1, DOUBTFUL, page.run[n], _signed(parts[n])))
        elif page.run[n] >= 0:
            rows.append((page.fetch_id, n + 1, OPEN, page.run[n] if short[n] or kinds[n] in (markup.LINK, markup.BUTTON) else -1, _signed(parts[n])))
        elif goes[n] >= 0 or (not page.filled and len(parts[n]) <= 4 and any(m is None or state[m] or page.run[m] >= 0 for m in beside(n))):
            rows.append((page.fetch_id, n + 1, OPEN, goes[n], _signed(parts[n])))
    return rows


def difference(group: pd.DataFrame) -> pd.DataFrame:
    """Deleted and open lines of one block of a host: ``fetch_id, line_no, state, run, parts``.

    Pages of the next blocks (``edge``) are compared with the block's own, but give no rows.
    """
    pages = [_read_page(row) for row in group.sort_values(["path", "fetch_id"], kind="stable").itertuples(index=False)]
    shared = shared_lines(pages)
    # the text of a shared line holds for the whole block
    deleted = {p.lines[n] for p, own in zip(pages, shared) for n in own if n not in p.doubtful}
    told = [[n in own or x in deleted for n, x in enumerate(p.lines)] for p, own in zip(pages, shared)]
    # a run of labels is deleted if it holds a shared line, or links in the place of deleted links of other pages
    seeded = [[any(sure[n] and n not in p.alone for n in run) for run in p.runs] for p, sure in zip(pages, told)]
    slots = {slot for p, sure in zip(pages, seeded) for run, slot, yes in zip(p.runs, p.slots(), sure) if yes and p.links(run)}
    only = len(pages) == 1  # a page that is alone on its host can't be compared: its links are judged by the layout
    seeded = [[yes or (p.links(run) and (only or slot in slots)) for run, slot, yes in zip(p.runs, p.slots(), sure)] for p, sure in zip(pages, seeded)]
    rows = [row for k, page in enumerate(pages) if not page.edge for row in judge_page(page, told[k], seeded[k], deleted)]
    return pd.DataFrame(rows, columns=["fetch_id", "line_no", "state", "run", "parts"])


def _signed(values: list[int]) -> list[int]:
    return np.array(values, dtype=np.uint64).view(np.int64).tolist()


def url_ranks(place: DataFrame) -> DataFrame:
    """``place(fetch_id, host, path)`` with ``rank``, from 0, of each page in its host's URL order.

    Pages are sorted by ranges, which cut large hosts; a range's pages are numbered and the
    ranges before it, counted first, are added.
    """
    ranges = cut(place.repartitionByRange("host", "path", "fetch_id").withColumn("slice", F.spark_partition_id()))
    within = ranges.withColumn("number", F.row_number().over(Window.partitionBy("host", "slice").orderBy("path", "fetch_id")))
    before = Window.partitionBy("host").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("host", "slice").agg(F.count("*").alias("n")).select("host", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return within.join(sizes, ["host", "slice"]).select("fetch_id", "host", "path", (F.col("offset") + F.col("number") - 1).alias("rank"))


def url_blocks(place: DataFrame, block: int = BLOCK_PAGES, edge: int = EDGE_PAGES) -> DataFrame:
    """``fetch_id, host, path, block, edge``: each page in its block of neighbours, and as an edge of the blocks beside it."""
    numbers = F.sequence(F.floor((F.greatest(F.col("rank") - edge, F.lit(0))) / block), F.floor((F.col("rank") + edge) / block))
    return url_ranks(place).withColumn("block", F.explode(numbers)).select("fetch_id", "host", "path", "block", (F.col("block") != F.floor(F.col("rank") / block)).alias("edge"))


def furniture_lines(pages: DataFrame, fetched: DataFrame, model: Plausibility, least_hosts: int = 2) -> DataFrame:
    """Lines of page furniture: ``fetch_id, line_no`` (from 1).

    ``pages``: fetch_id, url, title and clean_text; ``fetched``: fetch_id and html.  Null ids and
    empty texts give no row; pages without html are compared by text alone; repeated rows count
    once.  ``least_hosts``: a text deleted on so many hosts is furniture elsewhere too, where it
    stands beside other furniture.
    """
    once = pages.where(F.col("fetch_id").isNotNull())
    place = once.where("clean_text <> ''").select("fetch_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path")).dropDuplicates(["fetch_id"])
    tokens = page_tokens(once, model).dropDuplicates(["fetch_id"])
    layout = layout_tokens(fetched, model).dropDuplicates(["fetch_id"])
    blocked = url_blocks(place).join(tokens, "fetch_id").join(layout, "fetch_id", "left")
    judged = cut(blocked.groupBy("host", "block").applyInPandas(_with_host, "fetch_id bigint, line_no int, state int, run int, parts array<bigint>, host string"))
    deleted = judged.where(F.col("state") == FURNITURE).select("fetch_id", "line_no")
    return deleted.unionByName(known_lines(judged, least_hosts))


def known_lines(judged: DataFrame, least_hosts: int) -> DataFrame:
    """``fetch_id, line_no`` of lines left open on their own host that are known as furniture from others.

    Known is a text that was deleted on ``least_hosts`` hosts, and on no fewer than those where it
    stands alone as a heading.  Open labels go along with a known line of their run.
    """
    heard = judged.where(F.col("state").isin(FURNITURE, ALONE)).select("host", (F.col("state") == ALONE).cast("int").alias("alone"), F.explode("parts").alias("part"))
    hosts = heard.groupBy("part", "host").agg(F.max("alone").alias("alone"), F.max(1 - F.col("alone")).alias("deleted"))
    known = hosts.groupBy("part").agg(F.sum("alone").alias("alone"), F.sum("deleted").alias("deleted")).where((F.col("deleted") >= least_hosts) & (F.col("deleted") >= F.col("alone"))).select("part")
    waiting = judged.where(F.col("state").isin(OPEN, DOUBTFUL)).select("fetch_id", "line_no", "state", "run", "parts")
    parted = waiting.where(F.size("parts") > 0).select("fetch_id", "line_no", "run", F.size("parts").alias("n"), F.explode("parts").alias("part"))
    found = cut(parted.join(known, "part").groupBy("fetch_id", "line_no", "run", "n").agg(F.count("*").alias("found")).where("found = n"))
    runs = found.where("run >= 0").select("fetch_id", "run").distinct()
    along = waiting.where((F.col("state") == OPEN) & (F.col("run") >= 0)).join(runs, ["fetch_id", "run"]).select("fetch_id", "line_no")
    return found.select("fetch_id", "line_no").unionByName(along).distinct()


def _with_host(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    found = difference(group)
    found["host"] = key[0]
    return found


def bodies(pages: DataFrame, fetched: DataFrame, model: Plausibility) -> DataFrame:
    """Each page's body: ``fetch_id, body, removed_lines``; pages with empty text give an empty body."""
    lines = furniture_lines(pages, fetched, model).groupBy("fetch_id").agg(F.collect_set("line_no").alias("removed"))
    once = pages.select("fetch_id", F.coalesce("clean_text", F.lit("")).alias("text")).where(F.col("fetch_id").isNotNull()).dropDuplicates(["fetch_id"])
    joined = once.join(lines, "fetch_id", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i + 1))
    return joined.select("fetch_id", F.array_join(kept, "\n").alias("body"), F.size("removed").alias("removed_lines"))
