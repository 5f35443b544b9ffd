from pyspark.sql import functions as F

from terramark.llm import warc


def test_urls_of_other_schemes_keep_apart(spark):
    urls = [" ftp://a.org/x ", "dns:b.org", "www.example.com/a", "HTTP://www.c.org:80/p/", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u")).alias("k")).collect()
    assert [r.k for r in got] == ["ftp://a.org/x", "dns:b.org", "www.example.com/a", "c.org/p", None]
