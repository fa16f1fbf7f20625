from pyspark.sql import functions as F

from webloom.functions import text as texts
from webloom.functions.html import page_fields
from webloom.operators import pages

FETCH = "fetch_id bigint, url string, final_url string, status string, http_status_code int, html string, elapsed_ms int, error_reason string"


def fetched(spark, *rows):
    return spark.createDataFrame([(k, u, f, s, 200, h, 1, None) for k, u, f, s, h in rows], FETCH)


def test_fields_of_a_page():
    f = page_fields(
        """<html lang=" EN-gb "><head><title> Our
        plans </title><meta property="og:description" content="og"><meta name="Description" content="  "></head><body><!-- c --><nav><h2>Menu</h2><a href=" /a ">A <b>b</b></a></nav>
        <header>Top</header><main><h1>Pläne</h1><h2>PLÄNE</h2><p>One<br>two<p style="display : none">gone<b>inner</b></p><script>x()</script><div hidden><p>no</p></div><p>three &amp; four</main><footer>end</footer>"""
    )
    assert f["title"] == "Our plans" and f["meta_description"] == "og" and f["html_language"] == "en-gb"
    assert f["headings"] == ["Pläne"] and f["raw_text"].split("\n") == ["Pläne", "PLÄNE", "One", "two", "three & four"]
    assert f["anchors"] == [(0, "/a", "A b")] and "x()" not in f["signal_content"] and "end" in f["signal_content"] and f["signal_headings"] == "Menu Pläne PLÄNE"


def test_content_root_order():
    assert page_fields("<body>x<div class='a content'>c</div><div id=content>i</div></body>")["raw_text"] == "i"
    assert page_fields("<body>x<article>a</article><div role=main>r</div></body>")["raw_text"] == "a"
    assert page_fields("loose <p>text")["raw_text"] == "loose\ntext"
    assert page_fields("")["raw_text"] == ""


def test_extract_keeps_every_fetch(spark):
    df = fetched(
        spark, (1, "https://a.example/pricing", None, "success", "<title>T</title><body><p>a</p><p>a</p> <p> b  c</p>"), (2, "https://a.example/x", "https://a.example/y", "redirected", "<body>hello"),
        (3, "https://a.example/z", None, "failed", None), (4, "https://a.example/q", None, "success", "  "), (1, "https://a.example/pricing", None, "success", "<title>T</title><body><p>a</p><p>a</p> <p> b  c</p>"),
    )
    got = {r["fetch_id"]: r for r in pages.extract(df).collect()}
    assert len(got) == 4
    assert got[1]["clean_text"] == "a\nb c" and got[1]["page_type"] == "pricing" and got[1]["title"] == "T"
    assert got[2]["url"] == "https://a.example/y" and got[2]["page_type"] == "general"
    assert got[3]["clean_text"] == "" and got[3]["headings"] == [] and got[3]["page_type"] == "unknown" and got[4]["raw_text_length"] == 0
    assert pages.extract(df.limit(0)).count() == 0


def test_classify_by_page_and_ties(spark):
    df = fetched(spark, (1, "https://a.example/p1", None, "success", "<title>Frequently asked questions</title><body>x"), (2, "https://a.example/?q=1", None, "success", "<body>x"), (3, "notaurl", None, "success", "<body>pricing"), (4, "https://a.example/legal/privacy%20policy", None, "success", "<body>x"), (5, "https://a.example/%zz_case-studies", None, "success", "<body>"))
    got = {r["fetch_id"]: r["page_type"] for r in pages.extract(df).collect()}
    assert got == {1: "faq", 2: "homepage", 3: "unknown", 4: "privacy_policy", 5: "case_study"}


def test_links(spark):
    anchors = "".join(f'<a href="/page{k:02d}">n</a>' for k in range(20))
    html = f'<body><a href="/about/">About</a><a href="https://www.a.example/about#team">us</a><a href="/">home</a><a href="mailto:x@a.example">m</a><a href="https://b.example/pricing">b</a><a href="/cart/x">c</a><a href="/f.pdf">f</a><a href="http://[x">bad</a><a href="/x">Contact us</a>{anchors}'
    got = pages.discover_links(fetched(spark, (1, "https://a.example", None, "success", html), (2, "https://c.example", None, "success", "<body>none"))).orderBy("rank").collect()
    assert [(r["url"], r["score"]) for r in got[:3]] == [("https://a.example/about", 100), ("https://www.a.example/about", 100), ("https://a.example/x", 65)]
    assert len(got) == 15 and got[3]["url"] == "https://a.example/page00" and {r["fetch_id"] for r in got} == {1}


def test_fetch_rows(spark):
    rows = [("u", "f", 200, 0, "ok", 5, None), ("u", "f", 200, 1, "ok", 5, None), ("u", "f", 404, 0, "x", 5, None), ("u", "f", 500, 0, "x", 5, None), ("u", "f", 302, 0, "", 5, None), ("u", "f", 429, 0, "", 5, None), ("u", "f", 200, 0, "long text", 5, None), ("u", None, None, None, None, 5, "Timeout")]
    df = spark.createDataFrame(rows, "url string, final_url string, status_code int, n_redirects int, body string, elapsed_ms int, error string")
    got = pages.fetch_rows(df, largest=5).collect()
    assert [r["status"] for r in got] == ["success", "redirected", "not_found", "server_error", "failed", "blocked", "failed", "timeout"]
    assert got[0]["html"] == "ok" and got[2]["html"] is None and got[2]["error_reason"] == "HTTP 404 (not_found)." and got[6]["error_reason"] == "Content too large (9 bytes)." and got[7]["final_url"] == "u"


def test_text_expressions(spark):
    df = spark.createDataFrame([("a  b\r\n\n a b c\x1cc\nd",), (None,), ("",)], "t string")
    got = df.select(texts.normal_lines(F.col("t")), texts.word_count(F.col("t")), texts.keyword_text(F.col("t"))).collect()
    assert got[0][0] == "a b\nc\nd" and got[0][1] == 7 and got[1][0] == "" and got[2][1] == 0
