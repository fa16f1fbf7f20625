"""Large sources are spread over several partitions without a change of result."""

from webloom.llm import queries, sitelines


def test_salts_change_nothing(spark, small, monkeypatch):
    pages = spark.read.parquet(f"{small}/scanned_pages.parquet")
    read = lambda: ({tuple(r) for r in sitelines.without_repeated_lines(pages).collect()}, {tuple(r) for r in sitelines.sequence_lines(pages).collect()})
    whole = read()
    monkeypatch.setattr(sitelines, "SOURCE_PAGES", 3)
    assert read() == whole and len(whole[1]) > 0


def test_every_query_without_sql_holds_its_plain_cases(spark, small):
    import duckdb

    at = lambda name: f"'{small}/{name}.parquet'"
    ids = lambda sql: {r[0] for r in duckdb.sql(sql).fetchall()}
    found = lambda name: {tuple(r) for r in queries.queries()[name](spark, small).collect()}
    pages = duckdb.sql(f"SELECT DISTINCT fetch_id, title, clean_text, language FROM {at('extracted_pages')} WHERE clean_text <> ''").fetchall()
    residue = {k for (k,) in found("p1_found")}
    assert ids(f"SELECT fetch_id FROM {at('extracted_pages')} WHERE regexp_matches(clean_text, 'Lorem ipsum dolor|[{{][{{][a-z_.]+[}}][}}]|Page not found|enable JavaScript')") <= residue and 0 < len(residue) < 0.15 * len(pages)
    damaged = found("p4_found")
    assert {(k, "clean_text") for k in ids(f"SELECT fetch_id FROM {at('extracted_pages')} WHERE regexp_matches(clean_text, 'Ã[¤©±³¶¼­]|Ð¾Ð')")} <= damaged and not any(f == "clean_text" and k in {p[0] for p in pages if p[2].isascii()} for k, f in damaged)
    furniture = found("p6_found")
    lines = {(p[0], n): line for p in pages for n, line in enumerate(p[2].split("\n"), 1)}
    named = {k for k, line in lines.items() if line in ("Accept all", "Print", "Most read", "Terms of use") and k[0] not in residue}
    assert len(named) > 10 and len(named - furniture) <= 0.15 * len(named) and not any(len(lines[k]) > 400 for k in furniture)
    mixed = {k for k, _ in found("p7_found")}
    assert {p[0] for p in pages if not p[3]} - residue <= mixed and not mixed & residue
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM {at('documents')}").fetchall())
    cut = {k for (k,) in found("p10_found")}
    assert cut and {k for k, t in texts.items() if t.endswith(("[...]", "[…]", "(more)"))} <= cut
    pieces = {}
    for r in queries.p3_pieces(spark, small).collect():
        pieces.setdefault((r["item_kind"], r["item_id"]), []).append(r["n_words"])
    assert all(n <= 600 for own in pieces.values() for n in own)
    held = {}
    for r in queries.p8_containers(spark, small).collect():
        held[r["container"]] = held.get(r["container"], 0) + r["size"]
    assert max(held.values()) <= 8192
    report = queries.p9_report(spark, small).collect()
    assert abs(sum(r["actual_share"] for r in report) - 1) < 1e-9 and {r["source"] for r in report if r["short"]} == {k for (k,) in found("p9_found")}
