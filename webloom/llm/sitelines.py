"""Lines repeated across one site's documents (problem 5).

Every page is a sequence of line identifiers.  PrefixSpan grows frequent sequences from
single lines: the pages that hold a frequent prefix are projected to what follows it, and only
projected rows are counted for the next, longer prefix.  Support is the number of different
pages of the source.  Lines may be skipped between two lines of a sequence, and growth ends
where no longer sequence is frequent; closed sequences come out, and prefixes that can't lead
to one are not grown (BIDE).  Occurrences of frequent sequences are deleted from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.neardup import _Filter, key_filter
from webloom.sources.tables import checked_broadcast, cut, cut_table

_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Pages of a source that meet its lines in one partition; those of a larger source are spread over several.
SOURCE_PAGES = 20_000


def normal_line(line: Column) -> Column:
    """Trimmed, inner white space one space, lower case, each run of digits one #."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, _SPACE, " "))), "[0-9]+", "#")


def page_lines(pages: DataFrame) -> DataFrame:
    """``company_id, page, pos, line_norm``: each non-empty line of ``pages(page_id, company_id, clean_text)``.

    ``page`` is a 64-bit hash of the page_id.
    """
    known = pages.select("page_id", "company_id", "clean_text").where(F.col("page_id").isNotNull() & F.col("company_id").isNotNull() & F.col("clean_text").isNotNull())
    lines = known.select("company_id", F.xxhash64("page_id").alias("page"), F.posexplode(F.split("clean_text", "\n")).alias("pos", "line"))
    return lines.select("company_id", "page", "pos", normal_line(F.col("line")).alias("line_norm")).where("line_norm <> ''")


def least_support(pages: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """``company_id, pages, least``: each source's different pages and the support a sequence needs."""
    known = pages.select("page_id", "company_id").where(F.col("page_id").isNotNull() & F.col("company_id").isNotNull()).distinct()
    counted = known.groupBy("company_id").agg(F.count("*").alias("pages"))
    return counted.withColumn("least", F.greatest(F.lit(least_pages), F.ceil(F.col("pages") * F.lit(least_share) - F.lit(1e-9))).cast("bigint"))


def _salted(rows: DataFrame, lines: DataFrame, page: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a ``salt``, and ``lines`` (a row a source) once for each salt of its source.

    Only sources of more than SOURCE_PAGES rows have several: at most one for each SOURCE_PAGES rows.
    """
    large = checked_broadcast(rows.groupBy("company_id").agg(F.ceil(F.count("*") / SOURCE_PAGES).cast("int").alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    spread = rows.join(large, "company_id", "left").withColumn("salt", F.pmod(page, salts).cast("int")).drop("salts")
    return spread, lines.join(large, "company_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")


def frequent_lines(pages: DataFrame, least_pages: int = 5, least_share: float = 0.2) -> DataFrame:
    """``company_id, line, line_norm, support``: the frequent sequences of one line.

    ``line`` is the 64-bit hash of line_norm.  Counted over distinct pages of the source; a line
    that stands twice on a page, or on a page delivered twice, counts once.
    """
    once = page_lines(pages).select("company_id", "line_norm", "page").distinct()
    support = once.groupBy("company_id", "line_norm").agg(F.count("*").alias("support")).where(F.col("support") >= least_pages)
    needed = least_support(pages, least_pages, least_share)
    return support.join(needed, "company_id").where("support >= least").select("company_id", F.xxhash64("line_norm").alias("line"), "line_norm", "support")


def frequent_sequences(pages: DataFrame, least_pages: int = 5, least_share: float = 0.2, longest: int = 4, max_gap: int = 0) -> DataFrame:
    """Frequent line sequences ``company_id, sequence (array of normalised lines), length, support``.

    A sequence's next line may skip at most ``max_gap`` other frequent lines; infrequent lines
    between do not count, since no frequent sequence holds them.  Growth ends at ``longest``
    lines or when no sequence is frequent any more.
    """
    single = cut(frequent_lines(pages, least_pages, least_share))
    needed = least_support(pages, least_pages, least_share)
    rows = page_lines(pages).withColumn("line", F.xxhash64("line_norm")).drop("line_norm").distinct().join(single.select("company_id", "line"), ["company_id", "line"])
    order = Window.partitionBy("company_id", "page").orderBy("pos")
    # what follows each line on its page: only frequent lines, so its length is bounded by 1 / least_share times the mean page
    suffix = F.collect_list("line").over(order.rowsBetween(1, Window.unboundedFollowing))
    projected = cut_table(rows.select("company_id", "page", F.array("line").alias("prefix"), suffix.alias("suffix")))
    names = F.map_from_entries(F.collect_list(F.struct("line", "line_norm")))
    found = single.select("company_id", F.array("line").alias("prefix"), "support")
    for _ in range(1, longest):
        ahead = projected.select("company_id", "page", "prefix", "suffix", F.posexplode(F.slice("suffix", 1, max_gap + 1)).alias("skip", "next"))
        grown = ahead.select("company_id", "page", F.concat("prefix", F.array("next")).alias("prefix"), F.expr("slice(suffix, skip + 2, size(suffix))").alias("suffix"))
        counted = grown.select("company_id", "prefix", "page").distinct().groupBy("company_id", "prefix").agg(F.count("*").alias("support"))
        kept = cut(counted.join(needed, "company_id").where("support >= least").select("company_id", "prefix", "support"))
        if kept.isEmpty():
            break
        found = found.unionByName(kept)
        projected = cut_table(grown.join(kept.select("company_id", "prefix"), ["company_id", "prefix"]))
    spelled = single.groupBy("company_id").agg(names.alias("names"))
    return found.join(spelled, "company_id").select("company_id", F.transform("prefix", lambda x: F.element_at("names", x)).alias("sequence"), F.size("prefix").alias("length"), "support")


def page_sequences(pages: DataFrame) -> DataFrame:
    """``company_id, page, texts``: one row a page with the line hashes of each of its different texts (null text: no lines)."""
    known = pages.select("page_id", "company_id", "clean_text").where(F.col("page_id").isNotNull() & F.col("company_id").isNotNull())
    normal = F.filter(F.transform(F.split(F.coalesce("clean_text", F.lit("")), "\n"), normal_line), lambda x: x != "")
    rows = known.select("company_id", F.xxhash64("page_id").alias("page"), F.transform(normal, lambda x: F.xxhash64(x)).alias("lines"))
    return rows.groupBy("company_id", "page").agg(F.collect_set("lines").alias("texts"))


def _instances(text: list[int], prefix: list[int]) -> tuple[list[int], list[int], list[int]] | None:
    """Places of the first instance of a prefix, of its last instance, and of the last one within the first; None if the text lacks it."""
    first, at = [], -1
    try:
        for x in prefix:
            at = text.index(x, at + 1)
            first.append(at)
    except ValueError:
        return None
    last, within = [], []
    for found, end in ((last, len(text)), (within, first[-1] + 1)):
        for x in reversed(prefix):
            end -= 1
            while text[end] != x:
                end -= 1
            found.append(end)
        found.reverse()
    return first, last, within


#: Kinds of the lines counted for a prefix: itself, a line after it, in a gap of any instance, in a gap of the first instance.
_SELF, _AFTER, _BETWEEN, _WITHIN = range(4)


def _extensions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines by which the prefix of each row can be extended: ``whole`` is 1 where all the row's texts with the prefix hold the line there."""
    for batch in batches:
        rows = []
        for company, prefix, texts, pages in zip(batch["company_id"], batch["prefix"], batch["texts"], batch["pages"]):
            prefix = list(map(int, prefix))
            each = []
            for text in texts:
                text = list(map(int, text))
                if (places := _instances(text, prefix)) is None:
                    continue
                first, last, within = places
                own = {(_AFTER, 0, x) for x in text[first[-1] + 1 :]}
                for k in range(len(prefix)):
                    start = first[k - 1] + 1 if k else 0
                    own |= {(_BETWEEN, k, x) for x in text[start : last[k]]} | {(_WITHIN, k, x) for x in text[start : within[k]]}
                each.append(own)
            if each:
                rows.append((company, prefix, _SELF, 0, 0, pages, 1))
                common = set.intersection(*each)
                rows += [(company, prefix, *x, pages, int(x in common)) for x in set.union(*each)]
        yield pd.DataFrame(rows, columns=["company_id", "prefix", "kind", "place", "line", "pages", "whole"])


def _closed(pages: DataFrame, least_pages: int, least_share: float) -> tuple[DataFrame, DataFrame]:
    """``company_id, prefix, support`` of the closed frequent sequences of line hashes, and ``company_id, line, holder`` of the frequent lines.

    Pages of one source that hold the same frequent lines in the same order are one row with
    their number.  Every level counts all extensions of its prefixes in one aggregation, so no
    source and no prefix has to fit into one task.
    """
    texts = cut_table(page_sequences(pages))
    needed = texts.groupBy("company_id").agg(F.count("*").alias("n")).select("company_id", F.greatest(F.lit(least_pages), F.ceil(F.col("n") * F.lit(least_share) - F.lit(1e-9))).cast("bigint").alias("least"))
    counted = texts.select("company_id", "page", F.explode(F.array_distinct(F.flatten("texts"))).alias("line")).groupBy("company_id", "line").agg(F.count("*").alias("support"), F.min("page").alias("holder"))
    single = cut(counted.where(F.col("support") >= least_pages).join(needed, "company_id").where("support >= least"))
    least = single.select("company_id", "least").distinct()
    # a source's frequent lines: at most 1 / least_share times the lines of its mean page
    spread, lines = _salted(texts, single.groupBy("company_id").agg(F.collect_set("line").alias("frequent")), F.col("page"))
    joined = spread.join(lines, ["company_id", "salt"])
    reduced = F.array_distinct(F.transform("texts", lambda t: F.filter(t, lambda x: F.array_contains("frequent", x))))
    rows = joined.select("company_id", F.array_sort(F.filter(reduced, lambda t: F.size(t) > 0)).alias("texts")).where(F.size("texts") > 0)
    rows = cut(rows.groupBy("company_id", "texts").agg(F.count("*").alias("pages")))
    projected = rows.select("*", F.explode(F.array_distinct(F.flatten("texts"))).alias("line")).withColumn("prefix", F.array("line")).drop("line")
    found = None
    while True:
        grown = projected.select("company_id", "prefix", "texts", "pages").mapInPandas(_extensions, "company_id string, prefix array<bigint>, kind int, place int, line bigint, pages bigint, whole bigint")
        counts = cut(grown.groupBy("company_id", "prefix", "kind", "place", "line").agg(F.sum("pages").alias("pages"), F.sum("whole").alias("whole")))
        of = counts.where(F.col("kind") == _SELF).select("company_id", "prefix", F.col("pages").alias("support"), F.col("whole").alias("all"))
        held = counts.where(F.col("kind") != _SELF).join(of.select("company_id", "prefix", "all"), ["company_id", "prefix"]).where(F.col("whole") == F.col("all"))
        longer = held.groupBy("company_id", "prefix").agg(F.max((F.col("kind") == _WITHIN).cast("int")).alias("stuck"), F.max((F.col("kind") != _WITHIN).cast("int")).alias("open"))
        state = cut(of.join(longer, ["company_id", "prefix"], "left").select("company_id", "prefix", "support", F.coalesce("stuck", F.lit(0)).alias("stuck"), F.coalesce("open", F.lit(0)).alias("open")))
        closed = state.where("open = 0").select("company_id", "prefix", "support")
        found = closed if found is None else found.unionByName(closed)
        after = counts.where(F.col("kind") == _AFTER).join(state.where("stuck = 0").select("company_id", "prefix"), ["company_id", "prefix"])
        kept = cut(after.join(least, "company_id").where("pages >= least").groupBy("company_id", "prefix").agg(F.collect_list("line").alias("next")))
        if kept.isEmpty():
            return found, single.select("company_id", "line", "holder")
        ahead = projected.join(kept, ["company_id", "prefix"]).select("company_id", "prefix", "texts", "pages", F.explode("next").alias("line"))
        projected = cut_table(ahead.select("company_id", F.concat("prefix", F.array("line")).alias("prefix"), "texts", "pages"))


def _spelled(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``company_id, line, line_norm`` of ``lines(company_id, line, holder)``, read from the pages that hold them."""
    shared = pages.sparkSession.sparkContext.broadcast(key_filter(lines.select(F.col("holder").alias("key"))).bits)

    @F.pandas_udf("boolean")
    def holds(keys: pd.Series) -> pd.Series:
        return pd.Series(_Filter(shared.value).has(keys.to_numpy(dtype=np.int64)))

    held = pages.where(F.col("page_id").isNotNull() & holds(F.xxhash64("page_id")))
    named = page_lines(held).select("company_id", F.xxhash64("line_norm").alias("line"), "line_norm", F.col("page").alias("holder"))
    return named.join(lines, ["company_id", "line", "holder"]).select("company_id", "line", "line_norm").distinct()


def closed_sequences(pages: DataFrame, least_pages: int = 5, least_share: float = 0.2) -> DataFrame:
    """All closed frequent line sequences ``company_id, sequence (array of normalised lines), length, support``.

    A sequence's lines stand on a page in this order, with any lines between; it may have any
    length.  Closed: no longer sequence stands in the same texts, so every frequent sequence is
    part of one that comes out with the same support.  A page delivered with different texts
    counts once where any of them holds the sequence.
    """
    found, lines = _closed(pages, least_pages, least_share)
    names = _spelled(pages, lines).groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "line_norm"))).alias("names"))
    return found.join(names, "company_id").select("company_id", F.transform("prefix", lambda x: F.element_at("names", x)).alias("sequence"), F.size("prefix").alias("length"), "support")


def sequence_lines(pages: DataFrame, least_pages: int = 5, least_share: float = 0.2) -> DataFrame:
    """``company_id, line_norm``: the lines of the mined sequences."""
    found, lines = _closed(pages, least_pages, least_share)
    held = found.select("company_id", F.explode("prefix").alias("line")).distinct()
    return held.join(_spelled(pages, lines), ["company_id", "line"]).select("company_id", "line_norm")


def without_repeated_lines(pages: DataFrame, least_pages: int = 5, least_share: float = 0.2) -> DataFrame:
    """Each page without its source's frequent lines: ``page_id, company_id, clean_text, removed_lines``.

    Every line of a frequent sequence is itself a frequent sequence of one line, so deleting
    the lines of the mined sequences deletes all their occurrences.  Pages of null source or
    text come out unchanged; null ids are left out; repeated rows count once.
    """
    mined = _closed(pages, least_pages, least_share)[0].select("company_id", F.explode("prefix").alias("line"))
    lines = mined.groupBy("company_id").agg(F.collect_set("line").alias("frequent"))
    rows, salted = _salted(pages.select("page_id", "company_id", "clean_text").where(F.col("page_id").isNotNull()), lines, F.xxhash64("page_id"))
    joined = rows.dropDuplicates(["page_id"]).join(salted, ["company_id", "salt"], "left")
    all_lines = F.split("clean_text", "\n")
    kept = F.filter(all_lines, lambda x: ~F.array_contains("frequent", F.xxhash64(normal_line(x))))
    text = F.when(F.col("frequent").isNull(), F.col("clean_text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("frequent").isNull() | F.col("clean_text").isNull(), 0).otherwise(F.size(all_lines) - F.size(kept))
    return joined.select("page_id", "company_id", text.alias("clean_text"), removed.alias("removed_lines"))
