import random

from pyspark.sql import functions as F

from weft.llm.url_filter import build_cascade, judge_urls, member

URLS = {
    "http://a.example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"),
    "http://www.EXAMPLE.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "x://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://a.net/fr/1": ("a.net", "/fr/1", "net/fr/", "block"),
    "http://a.net/es": ("a.net", "/es", None, "allow"),
    "http://a.com": ("a.com", "", None, "allow"),
    "http://big-casino.org/x": ("big-casino.org", "/x", None, "block"),
    "http://casino.com/x": ("casino.com", "/x", "com/", "allow"),
    "no scheme.com/en/": ("", "", None, "allow"),
    "http://?x": ("", "", None, "allow"),
    "a://b.org/\nc#d://e": ("b.org", "/\nc", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_judge_urls(spark):
    data = [(k, u, "x") for k, u in enumerate(URLS)] + [(0, next(iter(URLS)), "x"), (None, "http://a.net/es/", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, host string")
    for bits in (1 << 20, 64):
        rows = judge_urls(pages, max_bits=bits).collect()
        assert len(rows) == len(data)
        for r in rows:
            if r.page_id is not None:
                assert (r.host, r.path, r.rule, r.verdict) == URLS[data[r.page_id][1]]
    assert judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    rnd = random.Random(7)
    keys = [(f"host{k}", rnd.random() < 0.2) for k in range(3000)]
    universe = spark.createDataFrame(keys, "__key string, __listed boolean")
    levels = build_cascade(universe, rate=0.3)
    assert len(levels) > 2
    assert universe.where(member(levels, F.col("__key")) != F.col("__listed")).count() == 0
    assert build_cascade(universe, max_bits=64) is None
    assert build_cascade(universe.where("not __listed")) == []
