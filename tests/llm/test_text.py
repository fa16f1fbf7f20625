"""Residue, encoding, language and truncation."""

import pytest
from pyspark.sql import functions as F

from webloom.llm import encoding, language, residue, truncation

SOUND = ["Die Geschäftsführung prüft größere Mengen für kleine Betriebe.", "Руководство объясняет все открытые вопросы, поэтому отдел расчётов принимает заключение.", "El área de métodos guía la opinión del público según el tamaño.", "この基盤は小さな店舗を同じ午後に引き受けます。"]


@pytest.mark.parametrize("text", SOUND)
@pytest.mark.parametrize("wrong,right", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1251", "utf-8")])
def test_round_trip(model, text, wrong, right):
    chars = encoding._TABLES[wrong][1]
    garbled = "".join(chars[b] for b in text.encode(right))
    damaged, restored = encoding.Repair(model[0]).text(f"Sound line\n{garbled}\nother")
    assert damaged and restored == f"Sound line\n{text}\nother"


def test_twice_garbled_and_single_byte_sets(model):
    chars = encoding._TABLES["cp1252"][1]
    once = "".join(chars[b] for b in SOUND[0].encode())
    twice = "".join(chars[b] for b in once.encode())
    assert encoding.Repair(model[0]).text(twice) == (True, SOUND[0])
    koi = SOUND[1].encode("koi8_r").decode("cp1251")
    assert encoding.Repair(model[0]).text(koi) == (True, SOUND[1])
    assert encoding.Repair(model[0]).text("Voil&agrave; und f\\u00fcr Gr\\u00f6\\u00dfe")[1] == "Voilà und für Größe"


@pytest.mark.parametrize("text", [*SOUND, "Größe ½″ × ¾″ … 30 ₂", "(Ð, Þ, Ã, Ÿ: Schriftmuster)", "plain", "", "20 °C ± 2 · Ø 9 mm", "¿Qué? ¡Sí! «Año» № 7"])
def test_sound_text_stays(model, text):
    assert encoding.Repair(model[0]).text(text) == (False, text)


def test_mend_edges(spark, model):
    rows = [(1, "Größe " * 9 + "gr��er", "x"), (1, "Größe " * 9 + "gr��er", "x"), (2, None, "x"), (3, "", "x"), (None, "Ã©tÃ©", "x"), (4, "a" * 200_000 + " é", "x")]
    df = spark.createDataFrame(rows, "fetch_id bigint, html string, k string")
    got = encoding.mend(df, "fetch_id", "html", model[0]).collect()
    assert [r["fetch_id"] for r in got] == [1]
    assert encoding.mend(df.limit(0), "fetch_id", "html", model[0]).count() == 0
    empty = encoding.sample_model(spark.createDataFrame([], "doc_id bigint, lang string, text string"))
    assert encoding.Repair(empty).text("Größe") == (False, "Größe")


RESIDUE = [
    ("Plans", "Our {{product.price}} desk helps."), ("Plans", "By %%CITYNAME%% we help. More text follows here."), ("undefined - undefined", "A real page about pumps."), ("Plans", "Lorem ipsum dolor sit amet consectetur adipiscing elit."), ("404", "Page not found\nBack"),
    ("x", "You need to enable JavaScript to run this app."), ("x", "ページが見つかりません"), ("x", "Страница не найдена"), ("x", "Some words of a real page about pumps and desks. Text goes here text goes here. More words of a real page about pumps and desks follow it here, and then some more."), ("x", "one [object Object] two"), ("x", "Dear [FIRST NAME] of __COMPANY__"), ("x", "See {0} items"), ("x", "PÃ¡gina no encontrada"),
]
REAL = [
    ("Plans", "A 404 page can still help visitors, so our designers give it a search box and a clear way home."), ("x", "Our front-end course covers JavaScript, style sheets and accessible forms."), ("x", "The set {2, 4, 8} covers most pipe widths [see drawing 7]."), ("x", "See note [3] on the sizes [S, M, L] before you order."),
    ("x", "We reduced the share of page not found errors by a third within two quarters."), ("x", "Strona główna\nPraca"), ("x", "Typesetters used dummy text long before screens existed, and our blog tells that story."), (None, "Plain text."),
]


def test_residue(spark, model):
    rows = [(k, t, x) for k, (t, x) in enumerate([*RESIDUE, *REAL])] + [(0, *RESIDUE[0]), (90, "404 Not Found", ""), (91, None, None), (None, "x", "Lorem ipsum dolor sit amet."), (92, "x", "word " * 50_000)]
    df = spark.createDataFrame([(k, t, x, 1) for k, t, x in rows], "fetch_id bigint, title string, clean_text string, spots int")
    got = {r["fetch_id"]: r for r in residue.residue(df, model[0]).collect()}
    assert {k for k, r in got.items() if r["spots"]} == set(range(len(RESIDUE))) and set(got) == set(range(len(RESIDUE) + len(REAL))) | {92}
    assert got[3]["excluded"] and not got[8]["excluded"] and residue.residue(df.limit(0), model[0]).count() == 0


def test_language_accuracy_and_segments(spark, model):
    sound, classifier, accuracy = model
    assert accuracy >= 0.99 and (classifier.table == 0).mean() > 0.5
    mixed = "Pricing\nOur team plans the yearly review on working days. Each desk records the agreed scope.\n" + SOUND[1] + " " + SOUND[1] + "\nCart"
    rows = [(1, "t", "de", mixed), (2, "t", "DE_at", SOUND[0]), (3, "t", None, SOUND[2]), (3, "t", None, SOUND[2]), (4, "t", "ja", None), (5, "t", "ja", ""), (6, "t", "en", "Menu"), (None, "t", "en", "x"), (7, "404", "de", "Page not found\n" + SOUND[2])]
    df = spark.createDataFrame(rows, "fetch_id bigint, title string, language string, clean_text string")
    segments = language.page_segments(df, classifier, sound)
    got = {(r["fetch_id"], r["segment_no"]): r for r in segments.collect()}
    assert [got[1, k]["lang"] for k in (0, 1)] == ["en", "ru"] and got[1, 1]["first_line"] == 3 and 0.5 < got[1, 0]["confidence"] <= 1
    found = sorted(tuple(r) for r in language.mislabelled(segments).collect() if r["fetch_id"] != 6)
    assert found == [(1, "en"), (1, "ru"), (3, "es")]
    assert language.page_segments(df.limit(0), classifier, sound).count() == 0 and language.train([])[0].languages == ["und"]


def test_lost_letters(model):
    lost = "".join("\ufffd" if ord(c) > 127 else c for c in SOUND[1])
    assert model[1].languages[model[1].of_lost_text(lost, "en")] == "ru" and model[1].languages[model[1].of_lost_text(lost, "ja-jp")] == "ja"


def test_lines_without_last_signs():
    text = "Menu\nOur team plans the yearly review on working days and records it\nshort line here\nOne. Two words. This is a sentence of text."
    assert [(n, s[:8]) for n, s in language.sentences(text)] == [(1, "Our team"), (3, "This is ")]


def test_truncation(spark):
    base = ["The steady pump keeps the agreed scope for most buyers.", "Our desk plans the agreed scope on working days. It opens the agreed doors for most buyers.", "One team plans the agreed scope during the trial.\nSee also: Pumps"] * 4
    cut = ["We say more. The steady pump keeps the agre", "Our desk plans the agreed scope on", "A line.\nOur desk plans the agreed (more)", "One team plans the agreed scope during […]", "The steady pump keeps the agreed scope for most buy &am", "Our desk plans the �"]
    fine = ["All is done.\nSee also: Pumps", "The steady pump keeps the agreed scope for most buyers. :)", "Done. #steady #pump", "It is done.\nhttps://a.example/the-agreed-scope", "- The pump\n- Our desk", "", None, "Is it?”"]
    rows = [(k, t, "s") for k, t in enumerate(base + cut + fine)]
    df = spark.createDataFrame([(*r, 0) for r in [*rows, rows[0], (None, "x", "s")]], "doc_id bigint, text string, source string, n bigint")
    flags = truncation.truncated(df)
    got = {r["doc_id"] for r in flags.where("truncated").collect()}
    assert got == set(range(len(base), len(base) + len(cut)))
    rate = truncation.truncation_rates(flags).collect()
    assert len(rate) == 1 and rate[0]["truncated_documents"] == len(cut)
    assert truncation.truncated(df.limit(0)).count() == 0
    # a copy of a cut text is cut as well, and doesn't speak for its end
    copies = spark.createDataFrame([(100 + k, cut[1], "s") for k in range(5)], "doc_id bigint, text string, source string")
    again = truncation.truncated(df.select("doc_id", "text", "source").union(copies))
    assert again.where("doc_id >= 100 and truncated").count() == 5
    assert truncation.truncated(df.withColumn("source", F.lit(None).cast("string"))).where("truncated").count() == len(cut)
