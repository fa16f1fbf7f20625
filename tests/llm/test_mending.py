"""Fields mended as a whole, entities, and the model of all documents."""

import random

from webloom.llm import encoding

RUSSIAN = ["Войти", "Руководство объясняет все открытые вопросы, поэтому отдел принимает заключение.", "Файлы"]


def test_short_lines_are_mended_as_the_rest_of_their_field(model):
    repair = encoding.Repair(model[0])
    garbled = [x.encode().decode("cp1251") for x in RUSSIAN]
    assert repair.text("\n".join(garbled)) == (True, "\n".join(RUSSIAN))


def test_results_do_not_depend_on_what_was_read_before(model):
    fields = ["\n".join(x.encode().decode("cp1251") for x in RUSSIAN), "© 2020 A", "В© 2020 Pumps", "So lÃ¤uft es ab", "Ð, Þ, Ã, Ÿ: Schriftmuster", "Ôàéëû", "plain"]
    alone = [encoding.Repair(model[0]).text(x) for x in fields]
    random.seed(5)
    for _ in range(5):
        order = random.sample(range(len(fields)), len(fields))
        repair = encoding.Repair(model[0])
        got = {k: repair.text(fields[k]) for k in order}
        assert [got[k] for k in range(len(fields))] == alone
    assert alone[1] == (False, fields[1]) and alone[4] == (False, fields[4]) and alone[6] == (False, "plain") and alone[3] == (True, "So läuft es ab")


def test_damaged_entities(model):
    repair = encoding.Repair(model[0])
    text = "Die Gesch&Atilde;&curren;ftsf&Atilde;&frac14;hrung pr&Atilde;&frac14;ft gr&ouml;&szlig;ere Mengen."
    damaged, better = repair.text("<p>" + text.replace("&ouml;&szlig;", "&Atilde;&para;&Atilde;&#376;") + "</p>")
    assert damaged and better == "<p>Die Geschäftsführung prüft größere Mengen.</p>"
    sound = "Die Gesch&auml;ftsf&uuml;hrung &copy; 2020 &middot; gr&ouml;&szlig;ere Mengen &amp; mehr"
    assert repair.text(sound) == (False, sound)


def test_model_of_all_documents(spark, model):
    texts = ["größere Mengen für alle"] * 5 + ["один раз", None, "plain"]
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, lang int").repartition(3)
    found = encoding.corpus_model(df)
    same = encoding.Plausibility.learn(t for t in texts if t)
    assert found.pairs == same.pairs and found.common == same.common and "rö" in found.common
    assert encoding.corpus_model(df.limit(0)).pairs == {}
