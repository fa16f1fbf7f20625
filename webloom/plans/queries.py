"""Registered queries of the pipeline's operators, each over its whole tables, with SQL for what SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.constants import DEFAULTS, IGNORED_SEGMENTS, IGNORED_SUFFIXES, KNOWN_SCHEMES, LAST_PRIORITY, LINK_WEIGHTS, PAGE_PRIORITY, PAGE_TYPES, URL_WEIGHT
from webloom.functions import text as texts
from webloom.functions import urls
from webloom.operators import chunks as chunking
from webloom.operators import intelligence as intel
from webloom.operators import pages as paging
from webloom.operators import retrieval, store
from webloom.plans import cases
from webloom.plans.engine import Engine
from webloom.sources.tables import once, table

FETCH = ["fetch_id", "company_id", "url", "final_url", "status", "http_status_code", "html", "elapsed_ms", "error_reason"]


def _fetched(spark: SparkSession, root: str) -> DataFrame:
    return once(table(spark, root, "fetch_results").select(*FETCH), "fetch_id")


def _pages(spark: SparkSession, root: str) -> DataFrame:
    columns = ["page_id", "scan_id", "company_id", "page_url", "page_type", "page_title", "clean_text", "created_at"]
    return once(table(spark, root, "scanned_pages").select(*columns), "page_id")


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").dropDuplicates(["chunk_id"])


def _scans(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "website_scans").dropDuplicates(["scan_id"])


def _errors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "scan_errors").dropDuplicates(["error_id"])


def _addresses(spark: SparkSession, root: str) -> DataFrame:
    """Every address of the store once."""
    parts = [table(spark, root, "scanned_pages").select("page_url"), table(spark, root, "website_scans").select("website_url"), table(spark, root, "fetch_results").select("url"), table(spark, root, "fetch_results").select("final_url")]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.toDF("url").distinct()


def census_page_types(spark, root):
    return paging.extract(_fetched(spark, root)).groupBy("page_type").agg(F.count("*").alias("pages"))


def pages_extracted(spark, root):
    return paging.extract(_fetched(spark, root))


def links_discovered(spark, root):
    return paging.discover_links(_fetched(spark, root))


def url_normalized(spark, root):
    return _addresses(spark, root).select(urls.normalize(F.col("url")).alias("n")).select("n.*")


def url_canonical(spark, root):
    u = F.col("url")
    return _addresses(spark, root).select(
        "url", urls.canonical(u).alias("canonical"), urls.site(u).alias("site"), urls.is_homepage(u).alias("is_homepage"), urls.is_irrelevant(u).alias("is_irrelevant"), urls.grounding_key(u).alias("grounding_key"), urls.is_absolute(u).alias("is_absolute")
    )


def url_page_types(spark, root):
    return _addresses(spark, root).select("url", paging.classify(F.col("url")).alias("page_type"))


def link_relevance(spark, root):
    return _pages(spark, root).select("page_id", urls.relevance(F.col("page_url"), F.col("page_title")).alias("score"))


def internal_pages(spark, root):
    """Pages of each scan that are on the scan's own site."""
    scans = _scans(spark, root).select("scan_id", "domain")
    return _pages(spark, root).join(scans, "scan_id").select("page_id", urls.same_site(F.col("page_url"), F.col("domain")).alias("is_internal"), urls.domains_match(urls.host(F.col("page_url")), F.col("domain")).alias("domains_match"))


def title_keywords(spark, root):
    return _pages(spark, root).select("page_id", texts.keyword_text(F.col("page_title")).alias("keywords"))


def normal_texts(spark, root):
    return _pages(spark, root).select("page_id", texts.normal_lines(F.col("clean_text")).alias("text"), texts.word_count(F.col("clean_text")).alias("words"))


def fetch_statuses(spark, root):
    """Status classes recomputed from codes and redirects."""
    status = paging.status_of(F.col("http_status_code"), F.col("url") != F.col("final_url"))
    return _fetched(spark, root).select("fetch_id", status.alias("status"), paging.is_ok(status).alias("is_ok"), paging.is_retryable(status).alias("is_retryable"))


def _rebuilt(spark, root, largest: int):
    responses = _fetched(spark, root).select("url", "final_url", F.col("http_status_code").alias("status_code"), (F.col("url") != F.col("final_url")).cast("int").alias("n_redirects"), F.col("html").alias("body"), "elapsed_ms", F.when(F.col("http_status_code").isNull(), F.coalesce("error_reason", F.lit("no answer"))).alias("error"))
    return paging.fetch_rows(responses, largest=largest)


def fetch_rows(spark, root):
    """Fetch results rebuilt from responses under a small size limit, so that every branch is taken."""
    return _rebuilt(spark, root, 4000).groupBy("status", "error_reason").agg(F.count("*").alias("fetches"), F.count("html").alias("with_html"), F.sum(F.length("html")).alias("signs"))


def fetch_rows_whole(spark, root):
    """One row a fetch, rebuilt from its whole response under the limit used in production."""
    return _rebuilt(spark, root, DEFAULTS["MAX_CONTENT_SIZE_BYTES"])


def page_chunks(spark, root):
    pages = _pages(spark, root).select("company_id", F.col("page_id").alias("page_url"), "page_type", F.col("page_title").alias("title"), "clean_text")
    return chunking.chunk_pages(pages)


def page_sentences(spark, root):
    """Paragraph and sentence segments of each page, counted in SQL expressions."""
    stripped = F.filter(F.transform(F.split("clean_text", r"\n\s*\n"), texts.strip), lambda x: x != "")
    parts = F.filter(F.flatten(F.transform(stripped, lambda x: F.split(x, r"(?<=[.!?])\s+"))), lambda x: x != "")
    return _pages(spark, root).select("page_id", F.size(stripped).alias("paragraphs"), F.size(parts).alias("segments"))


def _context(spark, root):
    chunks = _chunks(spark, root).withColumn("seq", F.col("fetch_id"))
    return chunking.select_context(chunks, "company_id", "seq")


def context_chunks(spark, root):
    return _context(spark, root).select("company_id", "chunk_id", "position")


def context_texts(spark, root):
    return chunking.context_text(_context(spark, root), "company_id")


def chunk_pages_joined(spark, root):
    """Stored chunks with the last stored page of their address."""
    pages = _pages(spark, root).withColumn("seq", F.struct("created_at", "page_id"))
    return store.attach_pages(_chunks(spark, root).select("chunk_id", "page_url"), pages, "seq").select("chunk_id", "page_url", "page_id")


def chunk_orphans(spark, root):
    return store.orphan_chunks(_chunks(spark, root), _pages(spark, root)).select("chunk_id")


def scan_counters(spark, root):
    return store.scan_counters(_scans(spark, root), table(spark, root, "scanned_pages").select("scan_id", "page_id"), table(spark, root, "scan_errors").select("scan_id", "error_id", "page_url"))


def scan_last_errors(spark, root):
    return store.last_errors(_scans(spark, root).select("scan_id", "company_id", "status"), _errors(spark, root))


def latest_scans(spark, root):
    found = store.latest(_scans(spark, root).select("company_id", "scan_id", "status", "started_at"), "company_id", "started_at", "scan_id")
    return found.withColumn("started_at", F.unix_micros("started_at"))


def scans_inserted(spark, root):
    """Finished scans, with all scans inserted where absent."""
    scans = _scans(spark, root).select("scan_id", "company_id", "status")
    done = scans.where("status = 'completed'")
    return store.insert_absent(done, scans.withColumn("status", F.lit("in_progress")), "scan_id", "company_id")


def page_records(spark, root):
    """Extracted pages written as store records, ids from scan and address."""
    pages = table(spark, root, "extracted_pages").dropDuplicates(["fetch_id"]).withColumn("scan_id", F.col("fetch_id").cast("string")).withColumn("company_id", F.lit("c"))
    return store.page_records(pages).select("page_id", "scan_id", "page_url", "page_type", "page_title", F.col("metadata.raw_text_length").alias("raw_text_length"))


def _replies(spark, root):
    """Model replies made from stored pages: prose first, then a fenced object that cites one seen and one unseen page."""
    pages = _pages(spark, root).groupBy("company_id").agg(F.min("page_url").alias("page"), F.max_by("page_title", "page_id").alias("title"))
    field = lambda value, *sources: F.struct(value.alias("value"), F.lit("high").alias("confidence"), F.array(*sources).alias("sources"))
    unseen = F.lit("https://elsewhere.test/")
    body = F.struct(field(F.coalesce("title", F.lit("Company")), F.upper("page"), unseen).alias("company_overview"), field(F.lit("products"), unseen).alias("products_and_services"), field(F.lit("from 5"), F.col("page")).alias("pricing"))
    fenced = F.concat(F.lit("```json\n"), F.to_json(body), F.lit("\n```"))
    return pages.select("company_id", F.explode(F.array(F.struct(F.lit(1).alias("attempt"), F.lit("I can't tell.").alias("raw")), F.struct(F.lit(2).alias("attempt"), fenced.alias("raw")))).alias("r")).select("company_id", "r.*")


def intelligence_grounded(spark, root):
    contexts = _pages(spark, root).groupBy("company_id").agg(F.collect_set(urls.grounding_key(F.col("page_url"))).alias("sources"))
    found = intel.first_valid(_replies(spark, root), contexts, "company_id")
    i = F.col("intelligence")
    return found.select("company_id", i["company_overview"]["value"].alias("overview"), F.size(i["company_overview"]["sources"]).alias("overview_sources"), i["products_and_services"]["value"].alias("products"), intel.has_value(i["pricing"]).alias("has_pricing"), F.array_join(i["missing_information"], ",").alias("missing"), intel.extracted_summary(i)["hasBlog"].alias("has_blog"))


def scan_statuses(spark, root):
    """The status response of every scan, as fields."""
    scans, errors = _scans(spark, root), _errors(spark, root)
    none = spark.createDataFrame([], f"company_id string, scan_id string, created_at timestamp, intelligence {intel.INTELLIGENCE.simpleString()}")
    answered = Engine(spark).scan_status(scans, errors, none)
    get = lambda name: F.get_json_object("response", f"$.{name}").alias(name)
    return answered.select("scan_id", get("companyId"), get("status"), get("errorType"), get("pagesScanned"), get("retryable"), F.get_json_object("response", "$.extractedDataSummary.hasPricing").alias("hasPricing"))


def nearest_vectors(spark, root):
    """The five nearest rows of the same label for every row whose id is divisible by 100."""
    base = table(spark, root, "embeddings").select("vec_id", "embedding", "label")
    found = retrieval.nearest(base.where("vec_id % 100 = 0"), base, "label", 5)
    return found.select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


def chunks_searched(spark, root):
    """The five nearest stored vectors of the same company for questions with the vectors of every row whose id is divisible by 100."""
    vectors = table(spark, root, "embeddings")
    chunks = vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("company_id"), "embedding")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("question_id"), F.col("label").cast("string").alias("company_id"), "embedding")
    return retrieval.search_chunks(chunks, asked, 5).select("question_id", "chunk_id", "rank", F.round("similarity", 5).alias("similarity"))


def pages_looked_up(spark, root):
    """Pages of one company by type and by address, and the pages and the row of one scan."""
    pages = _pages(spark, root)
    first = pages.agg(F.min_by("company_id", "page_id"), F.min_by("page_type", "page_id"), F.min_by("page_url", "page_id"), F.min_by("scan_id", "page_id")).first()
    found = {"type": retrieval.page_by_type(pages, first[0], first[1]), "url": retrieval.page_by_url(pages, first[0], first[2]), "scan": store.rows_of(pages, "scan_id", first[3], "page_id"), "none": store.rows_of(pages, "scan_id", "no such scan", "page_id")}
    rows = [frame.select(F.lit(how).alias("how"), F.col("page_id").alias("id")) for how, frame in found.items()]
    rows.append(store.rows_of(_scans(spark, root), "scan_id", first[3], "started_at").select(F.lit("one scan").alias("how"), F.col("scan_id").alias("id")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every


def prompts_built(spark, root):
    """Both requests to the model for each company's context."""
    contexts = context_texts(spark, root).select("company_id", "context", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    return contexts.select("company_id", "attempt", intel.user_prompt(F.col("context"), F.col("attempt") > 1).alias("prompt"))


def failures_recorded(spark, root):
    """All unfinished scans set to failed, with the errors that are stored for them."""
    scans = _scans(spark, root).select("scan_id", "status", F.unix_micros("completed_at").alias("completed_at"), "error_summary")
    failures = scans.where("status = 'in_progress'").select("scan_id", F.lit("internal_error").alias("error_type"), F.concat(F.lit("Ended: "), F.col("scan_id")).alias("message"), F.lit(None).cast("string").alias("page_url"), F.lit(7).cast("bigint").alias("created_at"))
    failed = store.fail_scans(scans, failures.select("scan_id", "message", F.col("created_at").alias("failed_at")))
    return failed.join(store.error_records(failures).select("scan_id", "error_id", "error_type"), "scan_id", "left")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        census_page_types, pages_extracted, links_discovered, url_normalized, url_canonical, url_page_types, link_relevance, internal_pages, title_keywords, normal_texts, fetch_statuses, fetch_rows, fetch_rows_whole, page_chunks, page_sentences,
        context_chunks, context_texts, chunk_pages_joined, chunk_orphans, scan_counters, scan_last_errors, latest_scans, scans_inserted, page_records, intelligence_grounded, scan_statuses, nearest_vectors,
        chunks_searched, pages_looked_up, prompts_built, failures_recorded,
    ]
    return {f.__name__: f for f in named} | cases.queries()


_R = urls.REFERENCE.replace("'", "''")
_SPACE = texts.SPACE


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _parts(url: str, source: str) -> str:
    """SQL of one row an address with its parts: u, scheme, authority, host, port, path, query."""
    place = "regexp_replace(authority, '^.*@', '')"
    return f"""(SELECT *, lower(regexp_extract({place}, '^([^:/]*)', 1)) AS host, regexp_extract({place}, '^[^:]*:(.*)$', 1) AS port FROM
        (SELECT {url} AS u, lower(regexp_extract({url}, '{_R}', 2)) AS scheme, regexp_extract({url}, '{_R}', 4) AS authority, regexp_extract({url}, '{_R}', 5) AS path, regexp_extract({url}, '{_R}', 7) AS query, * FROM {source}))"""


_ADDRESSES = "(SELECT page_url AS url FROM scanned_pages UNION SELECT website_url FROM website_scans UNION SELECT url FROM fetch_results UNION SELECT final_url FROM fetch_results)"
_SHOWN = "CASE WHEN query <> '' THEN '?' || query ELSE '' END"
_PORT = "CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END"


def _once(name: str, key: str) -> str:
    return f"(SELECT DISTINCT ON ({key}) * FROM {name} WHERE {key} IS NOT NULL)"


def _keywords(column: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({column}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def _url_type_sql() -> str:
    scores = [f"({' + '.join(f'''(contains(k, ' {p} '))::int''' for p in phrases)}) * {URL_WEIGHT}" for phrases in PAGE_TYPES.values()]
    best = " ".join(f"WHEN s[{n + 1}] = m AND m > 0 THEN '{name}'" for n, name in enumerate(PAGE_TYPES))
    return f"""SELECT u AS url, CASE WHEN scheme NOT IN ('http', 'https') OR authority = '' THEN 'unknown' WHEN replace(path, '/', '') = '' THEN 'homepage' {best} ELSE 'unknown' END AS page_type
        FROM (SELECT *, list_max(s) AS m FROM (SELECT *, [{", ".join(scores)}] AS s FROM (SELECT *, ' ' || {_keywords("url_decode(regexp_replace(path || ' ' || query, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)', '%25\\1', 'g'))")} || ' ' AS k FROM {_parts("url", _ADDRESSES)})))"""


_STATUS = """CASE WHEN http_status_code BETWEEN 200 AND 299 THEN CASE WHEN url <> final_url THEN 'redirected' ELSE 'success' END WHEN http_status_code IN (401, 403, 429) THEN 'blocked'
    WHEN http_status_code IN (404, 410) THEN 'not_found' WHEN http_status_code BETWEEN 500 AND 599 THEN 'server_error' ELSE 'failed' END"""
_CONTEXT = f"""(SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY depth, priority, first_seen, page_url) AS position, sum(length(text)) OVER (PARTITION BY company_id ORDER BY depth, priority, first_seen, page_url ROWS UNBOUNDED PRECEDING) AS running FROM
    (SELECT *, coalesce(list_position([{_sql_list(PAGE_PRIORITY)}], lower(first_type)) - 1, {LAST_PRIORITY}) AS priority FROM
    (SELECT *, row_number() OVER p AS depth, min(fetch_id) OVER (PARTITION BY company_id, page_url) AS first_seen, first_value(page_type) OVER p AS first_type FROM {_once("chunks", "chunk_id")} WINDOW p AS (PARTITION BY company_id, page_url ORDER BY chunk_index, fetch_id)))
    QUALIFY running <= 24000 OR position = 1)"""


def oracle_sql() -> dict[str, str]:
    pages, chunks, scans, errors, fetched = _once("scanned_pages", "page_id"), _once("chunks", "chunk_id"), _once("website_scans", "scan_id"), _once("scan_errors", "error_id"), _once("fetch_results", "fetch_id")
    label = urls.LABEL
    normalized = f"""SELECT raw AS original_url, CASE WHEN e IS NULL THEN scheme || '://' || host || {_PORT} || regexp_replace(path, '/+$', '') || {_SHOWN} END AS url, CASE WHEN e IS NULL THEN host END AS domain, e IS NULL AS is_valid, e AS error_reason FROM
        (SELECT *, CASE WHEN t = '' THEN 'URL is empty.' WHEN length(t) > 2048 THEN 'URL exceeds 2048 characters.' WHEN scheme NOT IN ('http', 'https') THEN 'Unsupported URL scheme ''' || scheme || '''. Only http/https are allowed.'
            WHEN contains(authority, '@') THEN 'URLs with embedded credentials are not allowed.' WHEN host = '' THEN 'URL is missing a host.' WHEN port <> '' AND (NOT regexp_full_match(port, '[0-9]+') OR try_cast(port AS BIGINT) > 65535) THEN 'URL has an invalid port.'
            WHEN regexp_matches(host, '{urls.IPV4.replace("(?!9$|10$)", "")}') THEN CASE WHEN regexp_matches(host, '^(0|10|127|169[.]254|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]') THEN '''' || host || ''' is a private/loopback address and cannot be scanned.' END
            WHEN host = 'localhost' THEN '''localhost'' cannot be scanned.' WHEN length(host) > 253 THEN 'Hostname is too long.' WHEN NOT contains(host, '.') THEN '''' || host || ''' is not a valid domain (missing a top-level domain).'
            WHEN NOT regexp_full_match(host, '{label}([.]{label})*') THEN '''' || host || ''' contains invalid characters.' END AS e
        FROM {_parts("f", f'''(SELECT *, CASE WHEN starts_with(t, '//') THEN 'https:' || t WHEN lower(regexp_extract(t, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) IN ({_sql_list(KNOWN_SCHEMES)}) THEN t ELSE 'https://' || t END AS f FROM (SELECT url AS raw, regexp_replace(coalesce(url, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t FROM {_ADDRESSES}))''')})"""
    weights = ", ".join(f"CASE WHEN contains(k, '{k}') THEN {w} ELSE 0 END" for k, w in LINK_WEIGHTS.items())
    collapse = f"trim(regexp_replace(x, '{_SPACE}+', ' ', 'g'))"
    prompt = intel.user_prompt_parts()
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    n_words = lambda x: f"len(list_filter(string_split_regex({x}, '{_SPACE}+'), lambda w: w <> ''))"
    chunked = f"""WITH RECURSIVE s AS (SELECT page_id, company_id, page_type, page_title, flatten(list_transform(list_filter(list_transform(string_split_regex(clean_text, '\\n{_SPACE}*\\n'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> ''),
            lambda x: list_filter(string_split(regexp_replace(x, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda y: y <> ''))) AS sentences FROM {pages}),
        w AS (SELECT * EXCLUDE sentences, flatten(list_transform(sentences, lambda x: CASE WHEN {n_words("x")} <= 600 THEN [x] ELSE list_transform(range(0, {n_words("x")}, 600), lambda k: array_to_string(list_filter(string_split_regex(x, '{_SPACE}+'), lambda v: v <> '')[k + 1:k + 600], ' ')) END)) AS parts FROM s),
        e AS (SELECT *, list_transform(range(0, len(parts) + 1), lambda i: CAST(coalesce(list_sum(list_transform(parts[1:i], lambda x: {n_words("x")})), 0) AS BIGINT)) AS ends FROM w WHERE len(parts) > 0),
        c AS (SELECT page_id, 0 AS chunk_index, CAST(0 AS BIGINT) AS start, greatest(1, len(list_filter(ends, lambda x: x <= ends[1] + 600)) - 1) AS stop FROM e
            UNION ALL SELECT page_id, chunk_index + 1, next, greatest(stop + 1, len(list_filter(ends, lambda x: x <= ends[next + 1] + 600)) - 1) FROM (SELECT c.*, e.ends, e.parts, greatest(c.start, len(list_filter(e.ends, lambda x: x <= e.ends[c.stop + 1] - 80)) - 1) AS next FROM c JOIN e USING (page_id)) WHERE stop < len(parts))
        SELECT company_id, page_id AS page_url, page_type, chunk_index, page_title AS title, array_to_string(parts[start + 1:stop], ' ') AS text FROM c JOIN e USING (page_id)"""
    first = f"(SELECT arg_min(company_id, page_id) AS company_id, arg_min(page_type, page_id) AS page_type, arg_min(page_url, page_id) AS page_url, arg_min(scan_id, page_id) AS scan_id FROM {pages})"
    return cases.oracle_sql() | {
        "page_chunks": chunked,
        "chunks_searched": """SELECT question_id, chunk_id, rank, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank FROM
            (SELECT CAST(q.vec_id AS VARCHAR) AS question_id, CAST(b.vec_id AS VARCHAR) AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings q JOIN embeddings b ON q.label = b.label WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""",
        "pages_looked_up": f"""SELECT 'type' AS how, page_id AS id FROM {pages} JOIN {first} USING (company_id, page_type) UNION ALL SELECT 'url', page_id FROM {pages} JOIN {first} USING (company_id, page_url)
            UNION ALL SELECT 'scan', page_id FROM {pages} JOIN {first} USING (scan_id) UNION ALL SELECT 'one scan', scan_id FROM {scans} JOIN {first} USING (scan_id)""",
        "prompts_built": f"""SELECT company_id, attempt, {quoted(prompt[0])} || context || {quoted(prompt[1])} || CASE WHEN attempt > 1 THEN {quoted(prompt[2])} ELSE '' END AS prompt FROM (SELECT company_id, string_agg('[source: ' || page_url || ']' || CASE WHEN coalesce(title, '') <> '' THEN ' (title: ' || title || ')' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context
            FROM {_CONTEXT} GROUP BY company_id), (SELECT unnest([1, 2]) AS attempt)""",
        "failures_recorded": f"""SELECT scan_id, CASE WHEN open THEN 'failed' ELSE status END AS status, CASE WHEN open THEN 7 ELSE epoch_us(completed_at) END AS completed_at, CASE WHEN open THEN 'Ended: ' || scan_id ELSE error_summary END AS error_summary,
            CASE WHEN open THEN 'error_' || substr(sha256(scan_id || chr(31) || 'internal_error' || chr(31) || 'Ended: ' || scan_id || chr(31) || '' || chr(31) || '7'), 1, 32) END AS error_id, CASE WHEN open THEN 'internal_error' END AS error_type FROM (SELECT *, status = 'in_progress' AS open FROM {scans})""",
        "url_normalized": normalized,
        "url_canonical": f"""SELECT u AS url, CASE WHEN scheme IN ('http', 'https') AND host <> '' AND (port = '' OR (regexp_full_match(port, '[0-9]+') AND try_cast(port AS BIGINT) <= 65535)) THEN scheme || '://' || host || {_PORT} || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || {_SHOWN} END AS canonical,
            regexp_replace(host, '^www[.]', '') AS site, replace(path, '/', '') = '' AS is_homepage,
            regexp_extract(regexp_extract(lower(path), '([^/]*)/*$', 1), '^.+[.]([^.]+)$', 1) IN ({_sql_list(IGNORED_SUFFIXES)}) OR list_has_any(string_split(lower(path), '/'), [{_sql_list(IGNORED_SEGMENTS)}]) AS is_irrelevant,
            regexp_replace(lower(regexp_replace(u, '^{_SPACE}+|{_SPACE}+$', '', 'g')), '/$', '') AS grounding_key, scheme IN ('http', 'https') AND authority <> '' AS is_absolute FROM {_parts("url", _ADDRESSES)}""",
        "url_page_types": _url_type_sql(),
        "link_relevance": f"SELECT page_id, greatest(0, {weights}) AS score FROM (SELECT page_id, replace(replace(lower(path || ' ' || coalesce(page_title, '')), '_', '-'), ' ', '-') AS k FROM {_parts('page_url', pages)})",
        "internal_pages": f"""SELECT page_id, regexp_replace(host, '^www[.]', '') = regexp_replace(lower(domain), '^www[.]', '') AS is_internal, regexp_replace(host, '^www[.]', '') = regexp_replace(lower(trim(domain)), '^www[.]', '') AS domains_match
            FROM {_parts("page_url", f"(SELECT p.page_id, p.page_url, s.domain FROM {pages} p JOIN {scans} s USING (scan_id))")}""",
        "title_keywords": f"SELECT page_id, {_keywords('page_title')} AS keywords FROM {pages}",
        "normal_texts": f"""WITH l AS (SELECT page_id, list_filter(list_transform(string_split_regex(clean_text, '{texts.LINE_END}'), lambda x: {collapse}), lambda x: x <> '') AS l, len(list_filter(string_split_regex(clean_text, '{_SPACE}+'), lambda x: x <> '')) AS words FROM {pages})
            SELECT page_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)) AS text, words FROM l""",
        "fetch_statuses": f"SELECT fetch_id, status, status IN ('success', 'redirected') AS is_ok, status IN ('timeout', 'server_error', 'failed') AS is_retryable FROM (SELECT fetch_id, {_STATUS} AS status FROM {fetched})",
        "fetch_rows": f"""WITH r AS (SELECT *, {_STATUS} AS s, coalesce(octet_length(encode(html)), 0) AS size, http_status_code IS NULL AS bad, coalesce(error_reason, 'no answer') AS why FROM {fetched})
            SELECT CASE WHEN bad THEN CASE WHEN contains(lower(why), 'timeout') THEN 'timeout' ELSE 'failed' END WHEN size > 4000 THEN 'failed' ELSE s END AS status,
            CASE WHEN bad THEN why WHEN size > 4000 THEN 'Content too large (' || size || ' bytes).' WHEN s NOT IN ('success', 'redirected') THEN 'HTTP ' || http_status_code || ' (' || s || ').' END AS error_reason, count(*) AS fetches,
            count(CASE WHEN NOT bad AND size <= 4000 AND s IN ('success', 'redirected') THEN html END) AS with_html, sum(CASE WHEN NOT bad AND size <= 4000 AND s IN ('success', 'redirected') THEN length(html) END) AS signs FROM r GROUP BY ALL""",
        "page_sentences": f"""WITH p AS (SELECT page_id, list_filter(list_transform(string_split_regex(clean_text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS s FROM {pages})
            SELECT page_id, len(s) AS paragraphs, len(list_filter(flatten(list_transform(s, lambda x: string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))), lambda x: x <> '')) AS segments FROM p""",
        "context_chunks": f"SELECT company_id, chunk_id, position FROM {_CONTEXT}",
        "context_texts": f"""SELECT company_id, string_agg('[source: ' || page_url || ']' || CASE WHEN coalesce(title, '') <> '' THEN ' (title: ' || title || ')' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context,
            list_sort(list_distinct(list(regexp_replace(lower(page_url), '/$', '')))) AS sources FROM {_CONTEXT} GROUP BY company_id""",
        "chunk_pages_joined": f"SELECT chunk_id, page_url, page_id FROM {chunks} c JOIN (SELECT page_url, arg_max(page_id, (created_at, page_id)) AS page_id FROM {pages} GROUP BY page_url) p USING (page_url)",
        "chunk_orphans": f"SELECT chunk_id FROM {chunks} WHERE page_url NOT IN (SELECT page_url FROM scanned_pages)",
        "scan_counters": f"""SELECT scan_id, coalesce(p, 0) AS pages_scanned, coalesce(f, 0) AS pages_failed, coalesce(p, 0) + coalesce(f, 0) AS pages_discovered FROM {scans} LEFT JOIN (SELECT scan_id, count(DISTINCT page_id) AS p FROM scanned_pages GROUP BY 1) USING (scan_id)
            LEFT JOIN (SELECT scan_id, count(DISTINCT error_id) AS f FROM scan_errors WHERE page_url IS NOT NULL GROUP BY 1) USING (scan_id)""",
        "scan_last_errors": f"""SELECT scan_id, company_id, status, coalesce(e.error_type, 'internal_error') AS error_type, e.message AS error_message, coalesce(e.error_type, 'internal_error') IN ('website_unreachable', 'timeout', 'ai_extraction_failed', 'internal_error') AS retryable
            FROM {scans} s LEFT JOIN (SELECT DISTINCT ON (scan_id) scan_id, error_type, message FROM {errors} ORDER BY scan_id, created_at DESC, error_id DESC) e USING (scan_id)""",
        "latest_scans": f"SELECT company_id, scan_id, status, epoch_us(started_at) AS started_at FROM {scans} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY started_at DESC NULLS LAST, scan_id DESC) = 1",
        "scans_inserted": f"SELECT scan_id, company_id, CASE WHEN status = 'completed' THEN status ELSE 'in_progress' END AS status FROM {scans}",
        "page_records": f"SELECT 'page_' || substr(sha256(CAST(fetch_id AS VARCHAR) || chr(31) || coalesce(url, '')), 1, 32) AS page_id, CAST(fetch_id AS VARCHAR) AS scan_id, url AS page_url, page_type, title AS page_title, raw_text_length FROM {_once('extracted_pages', 'fetch_id')}",
        "intelligence_grounded": f"""SELECT company_id, coalesce(arg_max_null(page_title, page_id), 'Company') AS overview, 1 AS overview_sources, 'not_available' AS products, true AS has_pricing, 'products and services' AS missing, false AS has_blog FROM {pages} GROUP BY company_id""",
        "scan_statuses": f"""SELECT scan_id, company_id AS "companyId", status, CASE WHEN status = 'failed' THEN coalesce(e.error_type, 'internal_error') END AS "errorType", CASE WHEN status IN ('completed', 'failed') THEN CAST(pages_scanned AS VARCHAR) END AS "pagesScanned",
            CASE WHEN status = 'failed' THEN CAST(coalesce(e.error_type, 'internal_error') IN ('website_unreachable', 'timeout', 'ai_extraction_failed', 'internal_error') AS VARCHAR) END AS retryable, CASE WHEN status = 'completed' THEN 'false' END AS "hasPricing"
            FROM {scans} s LEFT JOIN (SELECT DISTINCT ON (scan_id) scan_id, error_type FROM {errors} ORDER BY scan_id, created_at DESC, error_id DESC) e USING (scan_id)""",
        "nearest_vectors": """SELECT query_id, vec_id, rank, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
            (SELECT q.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""",
    }
