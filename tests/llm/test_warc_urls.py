"""Repeated rows of a page keep their own urls, and one of them alone is the response."""

from pyspark.sql import functions as F

from terralog.llm import base, warc


def test_urls_of_repeated_rows(spark):
    rows = [(1, "http://a", "z" * 1500), (1, "http://b", "z" * 1500), (1, "http://b", "z" * 1500), (1, None, "z" * 1500), (2, "http://c", "short"), (2, "http://d", "short"), (0, "http://e", "z" * 1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = base.work_dir(spark) + "-warc"
    warc.write(df, path)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert [text.count(f"WARC-Target-URI: {u}\r\n") for u in ("http://a", "http://b", "http://c", "http://d", "http://e", "about:blank")] == [1, 2, 1, 1, 1, 1]
    got = warc.archive(df).groupBy("page_id", "record_type").agg(F.count("*").alias("n"), F.max("refers_to").alias("refers_to")).collect()
    assert sorted((r.page_id, r.record_type, r.n, r.refers_to) for r in got) == [(0, "revisit", 1, 1), (1, "response", 1, None), (1, "revisit", 3, 1), (2, "response", 2, None)]
