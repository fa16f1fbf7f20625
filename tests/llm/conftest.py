import pytest


@pytest.fixture(scope="session")
def model(spark):
    """Plausibility and language models from the documents of the small tables."""
    from webloom.llm import encoding, language
    from webloom.sources.tables import table

    sample = language.labelled_sample(table(spark, "/root/testdata/sf0.01", "documents"))
    classifier, accuracy = language.train(sample)
    return encoding.Plausibility.learn(t for _, t in sample), classifier, accuracy
