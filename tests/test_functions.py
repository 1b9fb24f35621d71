from pyspark.sql import functions as F

from beaconry.functions import numeric, text, timefns, urls


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_strict_time_needs_a_zone(spark):
    for good, want in [("2024-01-01T08:00:00+08:00", "2024-01-01T00:00:00Z"), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z")]:
        assert one(spark, lambda v: timefns.iso_text(timefns.strict_time(v)), good) == want
    for bad in ("2024-01-01T00:00:00", "2024-01-01", "", "soon", "2024-13-01T00:00:00Z", None):
        assert one(spark, timefns.strict_time, bad) is None
    assert one(spark, lambda v: timefns.iso_text(timefns.lenient_time(v)), "2024-01-01T00:00:00") == "2024-01-01T00:00:00Z"


def test_feed_time_reads_rfc822_and_iso(spark):
    cases = {"Mon, 1 Jan 2024 10:00:00 GMT": "2024-01-01T10:00:00Z", "1 Jan 2024 10:00:00 +0200": "2024-01-01T08:00:00Z",
             "Mon, 01 Jan 2024 10:00:00 EST": "2024-01-01T15:00:00Z", "2024-01-01T10:00:00": "2024-01-01T10:00:00Z",
             "1 Jan 2024 10:00:00": "2024-01-01T10:00:00Z", "1 Jan 2024 10:00 GMT": "2024-01-01T10:00:00Z", "later": None}
    for raw, want in cases.items():
        assert one(spark, lambda v: timefns.iso_text(timefns.feed_time(v)), raw) == want, raw


def test_safe_url_falls_back(spark):
    good = ["https://a.example/x", "HTTP://a.example:80/x"]
    bad = ["ftp://a/x", "https://", "https://u@a/x", "https://a/x y", "https://a:99999/", "https://.../", "https://a\\b", "javascript:x", None]
    for url in good:
        assert one(spark, lambda v: urls.safe_url(v, F.lit("f")), url) == url
    for url in bad:
        assert one(spark, lambda v: urls.safe_url(v, F.lit("f")), url) == "f", url


def test_canonical_url(spark):
    cases = {"HTTPS://A.Example/Path/?utm_source=x&b=2&a=#top": "https://a.example/Path?b=2", "http://a.example": "http://a.example/",
             "http://a.example/x?q=a+b*~": "http://a.example/x?q=a+b%2A~"}
    for raw, want in cases.items():
        assert one(spark, urls.canonical_url, raw) == want


def test_titles_terms_and_rounding(spark):
    assert one(spark, text.clean_title, "  A &amp; B \n C ") == "A & B C"
    assert one(spark, text.clean_title, "bro�ken / whole") == "whole"
    assert one(spark, text.query_tokens, "Find an AI-agent, now") == ["find", "an", "ai", "agent", "now", "ai-agent"]
    assert one(spark, lambda v: text.hits(v, ["cli", "agent"]), "client agents") == ["agent", "cli"]
    assert [one(spark, numeric.score, v, "double") for v in (0.5, 1.5, 2.5, -3.0, 120.0)] == [0, 2, 2, 0, 100]
    assert [one(spark, numeric.half_up_1, v, "double") for v in (0.25, -0.25)] == [0.3, -0.2]


def test_entities_decode_like_the_standard_library(spark):
    import html
    cases = ["&#8217;", "&#x1F600;", "&#X1f600;", "&eacute;", "&amp;lt;", "&nosuch;", "a & b", "&", "&&amp;&", "", "&#0;", "&#xD800;", "&#x110000;", "&#1114112;",
             "&#99999999999;", "&#150;", "&#x80;", "&nbsp;x", "&apos;&quot;", "&#00065;", "&#x0041;", "plain", "&NotEqualTilde;", "line\n&copy;\u2028&reg;"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.d for r in rows.select("i", text.decode_entities(rows.t).alias("d")).collect()}
    assert got == {i: html.unescape(t) for i, t in enumerate(cases)}
    assert one(spark, text.clean_title, "it&#8217;s &eacute;t&eacute;") == "it\u2019s \u00e9t\u00e9"


def test_http_urls_of_plain_and_other_forms(spark):
    good = ["http://a", "https://a.example/x?y=1#z", "HTTPS://u@a:80/x", "https://a.b-c/\u00e9", "http://a:/", "https://-a/", "https://a\\b/", "https://a?x"]
    bad = ["https://", "https:///x", "ftp://a", "http://a:99999/", "http://u@", "http:a", "//a/x", "a", "", "https://a:b", "\nhttps://a", None]
    for url in good:
        assert one(spark, urls.is_http_url, url) is True, url
    for url in bad:
        assert one(spark, urls.is_http_url, url) is False, url
