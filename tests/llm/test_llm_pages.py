"""Site lines and page differencing."""

from collections import Counter

from webloom.llm import boilerplate, markup, sitelines


def test_frequent_lines_equal_brute_force(spark):
    rows = [("a", f"p{k}", f"Home  {k}\nBody {chr(97 + k % 26)}{k // 26}x\n" + ("Legal\xa0notice\n" if k % 4 == 0 else "") + ("Rare\n" if k < 4 else "") + "© 2020 A") for k in range(30)] + [("b", "q1", "Home 1\nx")]
    rows += [rows[0], ("a", "n", None), (None, "m", "Home 1"), ("a", None, "Home 1")]
    df = spark.createDataFrame([(c, p, t, "k") for c, p, t in rows], "company_id string, page_id string, clean_text string, line string")
    got = {(r["company_id"], r["line_norm"]): r["support"] for r in sitelines.frequent_lines(df).collect()}
    assert got == {("a", "home #"): 30, ("a", "legal notice"): 8, ("a", "© # a"): 30}
    sequences = {tuple(r["sequence"]): r["support"] for r in sitelines.frequent_sequences(df).collect()}
    assert sequences[("home #", "© # a")] == 22 and sequences[("home #", "legal notice", "© # a")] == 8 and ("legal notice", "home #") not in sequences
    gapped = {tuple(r["sequence"]): r["support"] for r in sitelines.frequent_sequences(df, max_gap=1).collect()}
    assert gapped[("home #", "© # a")] == 30
    clean = {r["page_id"]: r for r in sitelines.without_repeated_lines(df).collect()}
    assert clean["p4"]["clean_text"] == "Body e0x" and clean["p4"]["removed_lines"] == 3 and clean["q1"]["clean_text"] == "Home 1\nx" and clean["n"]["clean_text"] is None and clean["m"]["clean_text"] == "Home 1"
    assert sitelines.frequent_lines(df.limit(0)).count() == 0 and sitelines.frequent_sequences(df.limit(0)).count() == 0


def test_markup_lines():
    got = markup.lines("<title>T</title><ul><li><a href=/>Home</a><li><a href=/x>Shop</a></ul><p>Choose cookies.<button>OK</button><h2>Head</h2><p>Body <b>bold</b> &amp; <a href=/y>link</a> end.</p><div><b>More</b><a href=/1>One</a><br><a>Two</a></div><p>Last.\n<span>Print</span>\n<span>Post</span><script>x</script>")
    assert [(t, k) for t, k, _ in got] == [("Home", 2), ("Shop", 2), ("Choose cookies.", 0), ("OK", 3), ("Head", 1), ("Body bold & link end.", 0), ("More", 4), ("One", 2), ("Two", 2), ("Last.", 0), ("Print", 4), ("Post", 4)]


def test_linked_sentences_are_running_text():
    got = markup.lines("<main><p>We plan. \n<a href=/x>Our desk plans the yearly review.</a></p></main><div><a href=/t>The yearly review</a></div><p>© 2020 A\n<a href=/l>Legal notice</a>")
    assert [(t, k) for t, k, _ in got] == [("We plan.", 0), ("Our desk plans the yearly review.", 0), ("The yearly review", 2), ("© 2020 A", 0), ("Legal notice", 2)]


def test_align_is_a_longest_common_subsequence():
    import itertools
    import random

    random.seed(3)
    for _ in range(200):
        a, b = [random.randint(1, 5) for _ in range(random.randint(0, 8))], [random.randint(1, 5) for _ in range(random.randint(0, 8))]
        got = boilerplate.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))
        best = 0
        table = Counter()
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i, j] = table[i - 1, j - 1] + 1 if a[i] == b[j] else max(table[i - 1, j], table[i, j - 1])
            best = max(best, table[i, j])
        assert len(got) == best


def page(k):
    lines = ["Home", "Shop", "We use cookies here.", "OK", "Our plans", f"Body text number {chr(97 + k)} says this.", "Print", "Post", "Most read", f"Other title {chr(97 + k)}", "© 2020 Pumps"]
    html = f"<ul><li><a href=/>Home</a><li><a href=/s>Shop</a></ul><div><p>We use cookies here.</p><button>OK</button></div><h2>Our plans</h2><p>{lines[5]}</p><span>Print</span>\n<span>Post</span><div><b>Most read</b><a href=/t>{lines[9]}</a></div><p>© 2020 Pumps</p>"
    return "\n".join(lines), html


def test_furniture(spark, model):
    pages, fetched = [], []
    for k in range(6):
        text, html = page(k)
        pages.append((k, f"https://www.a.example/p/{k}", "T", text))
        fetched.append((k, html))
    pages += [pages[0], (7, "https://b.example/", None, "Only a body line.\nSecond line."), (8, None, None, "x y z."), (9, "https://a.example/p/9", None, ""), (10, "https://a.example/p/10", None, None), (None, "https://a.example/", None, "Home")]
    fetched += [fetched[0], (7, None), (9, "<p>x")]
    p = spark.createDataFrame([(*r, 1) for r in pages], "fetch_id bigint, url string, title string, clean_text string, host int")
    f = spark.createDataFrame(fetched, "fetch_id bigint, html string")
    rows = boilerplate.furniture_lines(p, f, model[0]).collect()
    got = {(r["fetch_id"], r["line_no"]) for r in rows}
    assert len(rows) == len(got) == 6 * 9 and got == {(k, n) for k in range(6) for n in (1, 2, 3, 4, 7, 8, 9, 10, 11)}
    body = {r["fetch_id"]: r["body"] for r in boilerplate.bodies(p, f, model[0]).collect()}
    assert body[2] == "Our plans\nBody text number c says this." and body[7] == "Only a body line.\nSecond line." and body[10] == "" and set(body) == {0, 1, 2, 3, 4, 5, 7, 8, 9, 10}
    assert boilerplate.furniture_lines(p.limit(0), f, model[0]).count() == 0 and boilerplate.furniture_lines(p, f.limit(0), model[0]).count() >= 0


def test_very_long_page(spark, model):
    text = "\n".join(["same line"] * 30_000 + [f"line {k} of many." for k in range(100)])
    p = spark.createDataFrame([(k, f"https://a.example/{k}", None, text + f"\nEnd {k}.") for k in range(3)], "fetch_id bigint, url string, title string, clean_text string")
    f = spark.createDataFrame([], "fetch_id bigint, html string")
    assert boilerplate.bodies(p, f, model[0]).count() == 3
