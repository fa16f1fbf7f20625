from pyspark.sql import functions as F

from webloom.plans import queries


def test_whole_fetches_keep_every_html(spark, small):
    fetched = spark.read.parquet(f"{small}/fetch_results.parquet").dropDuplicates(["fetch_id"])
    ok = fetched.where("http_status_code between 200 and 299 and html is not null")
    assert ok.where(F.octet_length("html") > 4000).count() > 0
    rows = queries.fetch_rows_whole(spark, small)
    assert rows.count() == fetched.count()
    got = rows.agg(F.count("html"), F.sum(F.length("html"))).first()
    assert tuple(got) == tuple(ok.agg(F.count("*"), F.sum(F.length("html"))).first())
