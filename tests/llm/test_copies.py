"""Copies of one page and short pages of one host."""

from webloom.llm import boilerplate

NOTICES = ["We use cookies on this site.", "All prices are without tax."]


def frames(spark, bodies):
    pages, fetched = [], []
    for k, body in enumerate(bodies):
        pages.append((k, f"https://a.example/p/{k:02d}", None, "\n".join(["Home", *NOTICES, *body])))
        fetched.append((k, "<a href=/>Home</a>" + "".join(f"<p>{x}</p>" for x in [*NOTICES, *body])))
    return spark.createDataFrame(pages, "fetch_id bigint, url string, title string, clean_text string"), spark.createDataFrame(fetched, "fetch_id bigint, html string")


def found(spark, bodies, model):
    return {(r["fetch_id"], r["line_no"]) for r in boilerplate.furniture_lines(*frames(spark, bodies), model).collect()}


def test_short_pages_with_shared_notices_are_compared(spark, model):
    bodies = [[f"The {x} hall has rooms for guests.", f"Its {x} door is open."] for x in ("red", "blue", "green", "grey", "white", "black")]
    assert found(spark, bodies, model[0]) == {(k, n) for k in range(6) for n in (1, 2, 3)}


def test_copies_keep_their_body_and_meet_the_next_page(spark, model):
    body = ["The red hall has rooms for guests.", "Its door is open.", "Its roof is high."]
    others = [[f"The {x} yard is wide.", f"Some {x} trees stand there.", f"A {x} wall is old."] for x in ("north", "south", "east", "west")]
    bodies = [body, body, [*body[:2], "Its roof is low."], body, body, body, *others]
    assert found(spark, bodies, model[0]) == {(k, n) for k in range(len(bodies)) for n in (1, 2, 3)}


def test_copy_test():
    pages = [[1, 2, 10, 11], [1, 2, 20, 21], [1, 2, 30, 31], [1, 2, 40], [1, 2, 40, 41], [1, 2, 10, 11, 12]]
    copies = boilerplate.copy_test(pages, [frozenset(p) for p in pages])
    assert copies(0, 0) and copies(0, 5) and not any(copies(x, y) for x in range(5) for y in range(x))
