"""Queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import boilerplate, encoding, language, mixing, neardup, packing, residue, sitelines, splitting, truncation
from webloom.llm.common import limit
from webloom.sources.tables import spread, table


def p1_pages(spark: SparkSession, root: str) -> DataFrame:
    model = encoding.corpus_model(spread(table(spark, root, "documents")))
    return residue.residue(spread(table(spark, root, "extracted_pages")), model)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_pages(spark, root).where("spots > 0").select("fetch_id")


#: What TESTDATA.md calls similar in problem 2.
SIMILAR_PAGES = neardup.Settings(shingle=3, threshold=0.7)


def _page_texts(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "scanned_pages")).select("page_id", F.col("clean_text").alias("text"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.similar_pages(_page_texts(spark, root), SIMILAR_PAGES)


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    return neardup.groups(_page_texts(spark, root), SIMILAR_PAGES)


def p2_weighted(spark: SparkSession, root: str) -> DataFrame:
    """Groups by the weighted similarity of runs of five words, 0.8 or more."""
    return neardup.groups(_page_texts(spark, root), neardup.Settings(similarity="weights"))


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    size, overlap = limit(spark, root, "chunk")
    items = splitting.pages_and_chunks(spread(table(spark, root, "extracted_pages")), table(spark, root, "chunks"))
    return splitting.split_items(items, size, overlap)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_pieces(spark, root).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("item_kind", "item_id")


def p4_restored(spark: SparkSession, root: str) -> DataFrame:
    model = encoding.corpus_model(spread(table(spark, root, "documents")))
    return encoding.found(spread(table(spark, root, "fetch_results")), spread(table(spark, root, "extracted_pages")), model)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_restored(spark, root).select("fetch_id", "field_name")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return sitelines.sequence_lines(spread(table(spark, root, "scanned_pages")))


def p5_sequences(spark: SparkSession, root: str) -> DataFrame:
    return sitelines.closed_sequences(spread(table(spark, root, "scanned_pages")))


def p5_cleaned(spark: SparkSession, root: str) -> DataFrame:
    return sitelines.without_repeated_lines(spread(table(spark, root, "scanned_pages")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    model = encoding.corpus_model(spread(table(spark, root, "documents")))
    return boilerplate.furniture_lines(spread(table(spark, root, "extracted_pages")), spread(table(spark, root, "fetch_results")), model)


def p6_bodies(spark: SparkSession, root: str) -> DataFrame:
    model = encoding.corpus_model(spread(table(spark, root, "documents")))
    return boilerplate.bodies(spread(table(spark, root, "extracted_pages")), spread(table(spark, root, "fetch_results")), model)


def p7_segments(spark: SparkSession, root: str) -> DataFrame:
    sample = language.labelled_sample(table(spark, root, "documents"))
    model, _ = language.train(sample)
    sound = encoding.corpus_model(spread(table(spark, root, "documents")))
    return language.page_segments(spread(table(spark, root, "extracted_pages")), model, sound)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return language.mislabelled(p7_segments(spark, root))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(spread(table(spark, root, "documents")), limit(spark, root, "container")[0])


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_containers(spark, root).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("doc_id")


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.container_report(p8_containers(spark, root), limit(spark, root, "container")[0])


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_report(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_report(spark, root).where("short").select("source")


def p10_flags(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated(spread(table(spark, root, "documents")))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_flags(spark, root).where("truncated").select("doc_id")


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncation_rates(p10_flags(spark, root))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_pages, p2_found, p2_groups, p2_weighted, p3_found, p3_pieces, p4_found, p4_restored, p5_found, p5_sequences, p5_cleaned, p6_found, p6_bodies, p7_found, p7_segments, p8_found, p8_containers, p8_fill, p9_found, p9_mixture, p9_report, p10_found, p10_flags, p10_rates]
    return {f.__name__: f for f in named}


_WORDS = r"len(list_filter(string_split_regex({}, '[ \t\r\n]+'), lambda w: w <> ''))"


_BREAKS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def oracle_sql() -> dict[str, str]:
    normal = lambda x: f"regexp_replace(lower(trim(regexp_replace({x}, '{_BREAKS}', ' ', 'g'))), '[0-9]+', '#', 'g')"
    sizes = "(SELECT DISTINCT doc_id, source, coalesce(octet_length(encode(text)), 0) AS size FROM documents)"
    return {
        "p3_found": f"""SELECT DISTINCT 'page' AS item_kind, CAST(fetch_id AS VARCHAR) AS item_id FROM extracted_pages WHERE {_WORDS.format("clean_text")} > 600
            UNION ALL SELECT DISTINCT 'chunk', chunk_id FROM chunks WHERE {_WORDS.format("text")} > 600""",
        "p5_found": r"""WITH p AS (SELECT DISTINCT page_id, company_id, clean_text FROM scanned_pages),
            l AS (SELECT DISTINCT company_id, page_id, regexp_replace(lower(trim(regexp_replace(unnest(string_split(clean_text, chr(10))), '[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line_norm FROM p),
            n AS (SELECT company_id, count(DISTINCT page_id) AS pages FROM p GROUP BY company_id)
            SELECT l.company_id, line_norm FROM l JOIN n USING (company_id) WHERE line_norm <> '' GROUP BY l.company_id, line_norm, pages HAVING count(*) >= 5 AND count(*) >= 0.2 * pages""",
        "p2_found": f"""WITH w AS (SELECT DISTINCT page_id, list_filter(string_split_regex(lower(clean_text), '{_BREAKS}'), lambda x: x <> '') AS w FROM scanned_pages WHERE page_id IS NOT NULL AND clean_text IS NOT NULL),
            t AS (SELECT w, row_number() OVER () AS text FROM (SELECT DISTINCT w FROM w)),
            s AS (SELECT text, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2])))) AS shingle FROM t),
            n AS (SELECT text, count(*) AS n FROM s GROUP BY text),
            c AS (SELECT a.text AS a, b.text AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.text < b.text GROUP BY ALL),
            near AS (SELECT a, b FROM c JOIN n x ON x.text = a JOIN n y ON y.text = b WHERE met >= 0.7 * (x.n + y.n - met)),
            p AS (SELECT page_id, text FROM w JOIN t USING (w))
            SELECT least(x.page_id, y.page_id) AS page_id_a, greatest(x.page_id, y.page_id) AS page_id_b FROM near JOIN p x ON x.text = a JOIN p y ON y.text = b
            UNION ALL SELECT x.page_id, y.page_id FROM p x JOIN p y ON x.text = y.text AND x.page_id < y.page_id""",
        "p5_cleaned": f"""WITH p AS (SELECT DISTINCT ON (page_id) page_id, company_id, clean_text FROM scanned_pages WHERE page_id IS NOT NULL),
            l AS (SELECT DISTINCT company_id, page_id, {normal("unnest(string_split(clean_text, chr(10)))")} AS line_norm FROM p),
            n AS (SELECT company_id, count(*) AS pages FROM p GROUP BY company_id),
            f AS (SELECT company_id, list(line_norm) AS lines FROM (SELECT l.company_id, line_norm FROM l JOIN n USING (company_id) WHERE line_norm <> '' GROUP BY l.company_id, line_norm, pages HAVING count(*) >= 5 AND count(*) >= 0.2 * pages) GROUP BY company_id)
            SELECT page_id, p.company_id, CASE WHEN lines IS NULL THEN clean_text ELSE array_to_string(list_filter(string_split(clean_text, chr(10)), lambda x: NOT list_contains(lines, {normal("x")})), chr(10)) END AS clean_text,
            CASE WHEN lines IS NULL OR clean_text IS NULL THEN 0 ELSE len(list_filter(string_split(clean_text, chr(10)), lambda x: list_contains(lines, {normal("x")}))) END AS removed_lines FROM p LEFT JOIN f USING (company_id)""",
        "p8_found": "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) > (SELECT max_size FROM size_limits WHERE limit_name = 'container')",
        "p9_found": f"""WITH b AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(d.size), 0) AS size FROM mix_targets m LEFT JOIN {sizes} d ON d.source = m.source GROUP BY ALL)
            SELECT source FROM b WHERE target_share * (SELECT sum(size) FROM b) > max_repeats * size""",
    }
