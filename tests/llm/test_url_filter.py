import datetime as dt

from pyspark.sql import functions as F

from slateworks.llm import url_filter

D = dt.date


def test_entries_active_at_fetch_time(spark):
    events = [("bad.example", "block", D(2024, 1, 10)), ("bad.example", "none", D(2024, 2, 1)), ("bad.example", "block", D(2024, 3, 1)), ("ok.bad.example", "allow", D(2024, 1, 1)), ("host.org/news", "block", D(2024, 1, 5)), ("HOST.org", "allow", D(2024, 1, 5)), ("host.org", "allow", D(2024, 1, 5)), (None, "block", D(2024, 1, 1)), ("x.y", None, D(2024, 1, 1)), ("org", "block", D(2000, 1, 1))]
    captures = [(1, "http://www.bad.example/a", D(2024, 1, 9)), (2, "http://www.bad.example/a", D(2024, 1, 10)), (3, "http://www.bad.example/a", D(2024, 2, 1)), (4, "http://www.bad.example/a", D(2025, 1, 1)), (5, "https://user:pw@OK.bad.example:8080", D(2024, 1, 15)), (6, "https://host.org/news/1?x", D(2024, 2, 1)), (7, "https://host.org/sport", D(2024, 2, 1)), (8, None, D(2024, 2, 1)), (9, "not a url", D(2024, 2, 1)), (10, "http://bad.example", None), (None, "http://bad.example", D(2024, 1, 20)), (None, "http://bad.example", D(2024, 1, 20)), (11, "http://a.org/" + "x" * 100_000, D(2024, 1, 1))]
    e = spark.createDataFrame(events, "key string, verdict string, dated date")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").withColumn("key", F.lit("clash"))
    got = {(r.page_id): (r.blocked, r.entry, r.since) for r in url_filter.filter_urls(c, e).collect()}
    block = lambda s: (True, "bad.example", s)
    assert got == {1: (False, None, None), 2: block(D(2024, 1, 10)), 3: (False, None, None), 4: block(D(2024, 3, 1)), 5: (False, "ok.bad.example", D(2024, 1, 1)), 6: (True, "host.org/news", D(2024, 1, 5)), 7: (False, "host.org", D(2024, 1, 5)), 8: (False, None, None), 9: (False, None, None), 10: (False, None, None), None: block(D(2024, 1, 10)), 11: (False, None, None)}
    assert url_filter.filter_urls(c, e).count() == len(captures)
    assert url_filter.filter_urls(c.limit(0), e).count() == 0 and url_filter.filter_urls(c, e.limit(0)).where("blocked").count() == 0


def test_paths_keep_their_case_and_hosts_do_not(spark):
    e = spark.createDataFrame([("Host.ORG/Forum", "block", D(2024, 1, 5)), ("NEWS.example", "block", D(2024, 1, 5))], "key string, verdict string, dated date")
    urls = ["http://host.org/Forum/1", "http://HOST.org/Forum", "http://host.org/forum", "http://news.Example/A", "http://host.org/"]
    c = spark.createDataFrame([(i, u, D(2024, 2, 1)) for i, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    got = {r.page_id: (r.blocked, r.entry) for r in url_filter.filter_urls(c, e).collect()}
    assert got == {0: (True, "host.org/Forum"), 1: (True, "host.org/Forum"), 2: (False, None), 3: (True, "news.example"), 4: (False, None)}
