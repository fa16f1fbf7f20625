from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.operators import chunks

TEN = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9."


def walk(text, size, overlap):
    """Segment by segment, as a check of the running sums."""
    size, overlap = max(1, size), max(0, overlap)
    overlap = size // 4 if overlap >= size else overlap
    done, held, count = [], [], 0
    for part in chunks.segments(text, size):
        n = len(part.split())
        if held and count + n > size:
            done.append(" ".join(held))
            tail, shared = [], 0
            for old in reversed(held if overlap else []):
                tail.insert(0, old)
                shared += len(old.split())
                if shared >= overlap:
                    break
            held, count = tail, shared
        held.append(part)
        count += n
    return done + [" ".join(held)] if held else done


def test_known_sizes():
    assert [len(c.split()) for c in chunks.split_text(" ".join([TEN] * 150))] == [600, 600, 460]
    assert chunks.split_text("  \n ") == [] and chunks.split_text(None) == [] and chunks.split_text("one two") == ["one two"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 25), max_size=40), st.integers(0, 30), st.integers(0, 30))
def test_equals_the_walk(lengths, size, overlap):
    text = " ".join(" ".join(f"s{k}w{j}" for j in range(n)) + "." for k, n in enumerate(lengths))
    assert chunks.split_text(text, size, overlap) == walk(text, size, overlap)


def test_chunk_pages(spark):
    df = spark.createDataFrame([("c", "u1", "blog", None, " ".join([TEN] * 90)), ("c", "u2", "blog", "t", ""), ("c", "u3", "blog", "t", None)], "company_id string, page_url string, page_type string, title string, clean_text string")
    got = chunks.chunk_pages(df).orderBy("chunk_index").collect()
    assert [(r["page_url"], r["chunk_index"]) for r in got] == [("u1", 0), ("u1", 1)]


def test_context(spark):
    rows = [("c", "blog", "b", 0, "t", "x" * 10, 1), ("c", "about", "a", 0, None, "y" * 10, 2), ("c", "about", "a", 1, None, "z" * 10, 3), ("c", "odd", "o", 0, "t", "q" * 3, 4), ("c", "blog", "b", 1, "t", "w", 5), ("d", "blog", "b", 0, "t", "v" * 100, 6)]
    df = spark.createDataFrame([(g, t, f"https://{p}.example/", i, ti, te, s) for g, t, p, i, ti, te, s in rows], "g string, page_type string, page_url string, chunk_index int, title string, text string, seq int")
    got = chunks.select_context(df, "g", "seq", budget=32)
    assert [(r["g"], r["seq"]) for r in got.orderBy("g", "position").collect()] == [("c", 2), ("c", 1), ("c", 4), ("d", 6)]
    text = {r["g"]: r for r in chunks.context_text(got, "g").collect()}
    assert text["c"]["context"].startswith("[source: https://a.example/]\nyyyyyyyyyy\n\n[source: https://b.example/] (title: t)\n") and text["c"]["sources"] == ["https://a.example", "https://b.example", "https://o.example"]
    assert chunks.select_context(df, "g", "seq", budget=0).count() == 0
