import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sitelens.functions import urls
from sitelens.operators import evaluation, html_features, knowledge, linkgraph, robots, runtime
from sitelens.sources import artifacts, report


def test_urls():
    assert urls.parse("HTTPS://WWW.X.test:443/a/../b/./c?q=1#f") == ("https", "www.x.test", "/b/c", "?q=1")
    assert urls.parse("../z", "https://x.test/a/b/c") == ("https", "x.test", "/a/z", "")
    assert urls.parse("//y.test/p", "http://x.test/") == ("http", "y.test", "/p", "")
    assert urls.parse("mailto:a@b.c", "https://x.test/") is None and urls.parse("nonsense") is None
    assert urls.key("https://X.test/dir/index.html#a") == "https://x.test/dir" and urls.key("https://x.test/") == "https://x.test/" and urls.key("::") == "::"


def test_depth_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "z")], "src string, dst string")
    pages = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "url string")
    roots = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in linkgraph.click_depth(e, roots, pages).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.url for r in linkgraph.orphans(pages, e, roots).collect()} == {"x"}
    assert linkgraph.click_depth(e.where("false"), roots).count() == 1


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nCrawl-delay: 3\n\nUser-agent: GPTBot\nDisallow: /\nSitemap: https://x/s.xml"
    p = robots.parse(text)
    assert p["disallow"] == ["/a", "/*.pdf$"] and p["crawl_delay"] == 3 and p["sitemaps"] == ["https://x/s.xml"]
    assert [(b["agent"], b["disallow_all"]) for b in p["bots"]] == [("GPTBot", True)] and robots.parse(None)["disallow"] == []
    parsed = robots.parse_files(spark.createDataFrame([("s", text)], "site string, raw string"), "site", "raw")
    t = spark.createDataFrame([("s", x) for x in ("/a", "/a/b", "/x.pdf", "/x.pdf?y", "/")] + [("other", "/a")], "site string, path string")
    got = {(r.site, r.path): r.allowed for r in robots.allowed(t, robots.patterns_of(parsed, "site"), []).collect()}
    assert got == {("s", "/a"): False, ("s", "/a/b"): True, ("s", "/x.pdf"): False, ("s", "/x.pdf?y"): True, ("s", "/"): True, ("other", "/a"): True}


def test_html_features():
    page = """<!doctype html><html lang=de><head><meta charset=utf-8><title> A &amp; B </title><meta name=description content="x > y"><link rel=canonical href="/p/"><script src=a.js></script>
    <script type="application/ld+json">{"@context":"https://schema.org","@type":["Product"],"offers":{"@type":"Offer","price":19.9}}</script><script type='application/ld+json'>{broken "@type": "FAQPage"}</script></head>
    <body><!-- <h1>no</h1> --><h1>Hi <b>x</b></h1><a href='/q/index.html'>mehr</a><a href="https://en.wikipedia.org/x"></a><img src=a.webp><button></button><iframe></iframe></body></html>"""
    got = html_features.extract(page, "https://x.example/p")
    want = {"title": "A & B", "meta_desc": "x > y", "canon_self": "1", "html_lang": "de", "h1": "Hi x", "h1_count": "1", "ld_valid": "0", "ld_types": "Product,Offer,FAQPage", "offer_price": "19.9", "generic_anchor_count": "1", "empty_link_count": "1",
            "unlabeled_control_count": "2", "outlinks_internal": "1", "outlinks_external": "1", "outlinks_authoritative": "1", "img_webp": "1", "img_no_alt": "1", "head_blocking_scripts": "1", "resource_paths": "/a.js"}
    assert {k: got[k] for k in want} == want and got["internal_links"] == ["https://x.example/q"]
    assert html_features.extract(None, "x") == {} and html_features.extract("", "https://x/")["error_code"] == "js-guard:empty-body"
    html_features.extract("<a " + "x" * 60_000, "https://x/")  # an open tag must not take long


def test_knowledge(spark):
    assert knowledge.sections_of("---\nsource: x\n---\nintro\n# A\n```\n# no\n```\n## B\ntext") == [("", "intro"), ("A", "```\n# no\n```"), ("B", "text")]
    assert knowledge.sections_of("") == [("", "")] and knowledge.sections_of("# A\nabc\n# B\nd", 2)[1] == ("B", "bc\nd")
    assert np.isclose(np.linalg.norm(knowledge.embed_text("a b")), 1) and not knowledge.embed_text("äöü").any()
    df = spark.createDataFrame([("---\nsource: s\ndatum: 2026-01\n---\nx",), ("x",)], "t string")
    assert [r.m for r in df.select(knowledge.front_matter("t").alias("m")).collect()] == [{"source": "s", "datum": "2026-01"}, {}]
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "id bigint, vec array<double>")
    got = knowledge.top_k(v, v.where("id = 3"), k=3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(3, 1.0), (8, 1.0), (13, 1.0)]
    store = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    assert {tuple(r) for r in knowledge.upsert(store, spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "id string, v int"), "id", "v").collect()} == {("a", 1), ("b", 3), ("c", 1)}


def test_runtime(spark):
    df = spark.createDataFrame([("::1", "120", "a.x.test"), ("8.8.8.8", "Wed, 01 Jan 2025 00:00:10 GMT", "b.a.x.test"), ("junk", "soon", "x.test")], "ip string, ra string, host string")
    now = F.lit(dt.datetime(2025, 1, 1))
    rows = df.select(runtime.is_private_address("ip").alias("p"), runtime.retry_after_seconds(F.col("ra"), now).alias("s"), runtime.san_matches(F.col("host"), F.array(F.lit("*.x.test"))).alias("m")).collect()
    assert [(r.p, r.s, r.m) for r in rows] == [(True, 120.0, True), (False, 10.0, False), (None, None, False)]
    record = '{"record":{"metrics":{"largest_contentful_paint":{"percentiles":{"p75":"2600"}}}}}'
    assert spark.range(1).select(runtime.crux_record(F.lit(record)).alias("r")).first().r == [("lcp", 2600.0)]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([('a,"b"\nc', None), ("", "x")], "u string, v string")
    artifacts.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in artifacts.read_csv(spark, str(tmp_path / "c"), ["u", "v"]).collect()} == {('a,"b"\nc', ""), ("", "x")}
    hits = spark.createDataFrame([("r:a", "https://x/?a,b")], "rule_id string, url string")
    artifacts.write_affected(hits, str(tmp_path / "h"))
    assert [tuple(r) for r in artifacts.read_affected(spark, str(tmp_path / "h")).collect()] == [("r:a", "https://x/?a,b")]
    found = spark.createDataFrame([("h", "r<1>", "hoch", "c", 3, 1.5, False)], "host string, rule_id string, severity string, category string, hits bigint, pct_of_pages double, small_sample boolean")
    assert "r&lt;1&gt;" in report.render(found, "h")


def test_streaming(spark, tmp_path):
    from sitelens.streaming import incremental
    from tests.test_rules import page

    rows = page(spark, title="").withColumn("ingested_at", F.lit(dt.datetime(2026, 1, 1)))
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    incremental.audit_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("rule_id = 'onpage:title-missing'").count() == 1


def test_leaks(spark):
    key = "AKIA" + "A" * 16
    df = spark.createDataFrame([(1, f"ok\nkey {key}\nme@x.org secretname"), (2, None)], "id bigint, text string")
    import hashlib

    got = {(r.line, r.label) for r in evaluation.leak_scan(df, "id", "text", [hashlib.sha256(b"secretname").hexdigest()]).collect()}
    assert got == {(2, "aws-key"), (3, "email"), (3, "named-token")}
