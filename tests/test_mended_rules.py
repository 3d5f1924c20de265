"""Rules that the driver's tables never fire, or whose bounds are easily got wrong: planted rows, in the
library and in the hand-written SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sitelens.functions.exprs import Spark, address, resolve
from sitelens.operators import evaluation, linkgraph, relations, rules, sites
from sitelens.queries import rules as queries
from sitelens.sources.artifacts import CRAWL_COLUMNS
from tests.test_rules import CELLS

H = "https://a.example"
PAGES = [
    {"url": f"{H}/", "has_favicon": "0", "outlinks_external": "3"},
    {"url": f"{H}/img", "robots_meta": "noimageindex, follow", "outlinks_external": ""},
    {"url": f"{H}/shell", "error_code": "js-guard:empty-body"},
    {"url": f"{H}/gone", "status": "410"},
    {"url": f"{H}/moved", "redirected": "1"},
    {"url": f"{H}/hidden?x=1", "robots_meta": "noindex", "canonical": f"{H}/hidden?x=1"},
    {"url": f"{H}/hidden?x=2", "robots_meta": "noindex", "canonical": f"{H}/hidden?x=1"},
    {"url": f"{H}/old", "canonical": f"{H}/gone", "outlinks_external": "0"},
    {"url": f"{H}/de/", "html_lang": "de-AT", "hreflang_links": f"en={H}/de/|de={H}/gone"},
    {"url": f"{H}/en/", "html_lang": "en", "hreflang_links": f"en={H}/en/|fr={H}/moved"},
    {"url": f"{H}/nostatus", "status": ""},
    {"url": f"{H}/dates", "date_published": "2025-05-03", "date_modified": "2025-04-01T08:00:00Z"},
]
WANT = {
    "onpage:favicon-missing": {0}, "geo:noimageindex": {1}, "crawl:client-rendered": {2}, "geo:missing-citations": {7}, "tech:canonical-target-broken": {6, 7}, "i18n:hreflang-target-broken": {8, 9}, "i18n:html-lang-hreflang-mismatch": {8},
    "schema:date-inconsistent": {11},
}


@pytest.fixture(scope="module")
def crawl(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("mended"))
    made = [(i, "a.example", None, None, *[({c: "" for c in CRAWL_COLUMNS} | CELLS | page)[c] for c in CRAWL_COLUMNS]) for i, page in enumerate(PAGES)]
    spark.createDataFrame(made, "row_no bigint, host string, crawled_at timestamp, ingested_at timestamp, " + ", ".join(f"{c} string" for c in CRAWL_COLUMNS)).write.parquet(f"{at}/crawl.parquet")
    return at


@pytest.mark.parametrize("rule_id", list(WANT))
def test_planted_rows(spark, crawl, rule_id):
    name = rules.query_name(rule_id)
    assert {r.row_no for r in queries.QUERIES[name](spark, crawl).collect()} == WANT[rule_id]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW crawl AS SELECT * FROM '{crawl}/crawl.parquet/*.parquet'")
    assert {r[1] for r in db.sql(f"SELECT host, row_no FROM ({queries.SQL[name]})").fetchall()} == WANT[rule_id]


def test_pages_without_status_are_no_orphans(spark, crawl):
    got = {r.row_no for r in queries.QUERIES["rule_crawl_orphan_page"](spark, crawl).collect()}
    assert got == {11} and 10 not in got  # each eleventh page is not linked; the first is the root


def test_site_rules(spark):
    facts = spark.createDataFrame([("none", True, None), ("bad", True, ["x"]), ("good", True, []), ("unknown", False, None)], "host string, llms_known boolean, llms_problems array<string>")
    assert {r.host: r.status for r in sites.evaluate(facts, ["geo:llms-txt-malformed"]).collect()} == {"none": "finding", "bad": "finding", "good": "positive", "unknown": "positive"}
    sizes = spark.createDataFrame([("a", 50_001, 1), ("b", 50_000, 99_999), ("c", None, 50_001), ("d", None, None)], "host string, largest_sitemap long, sitemap_urls long")
    assert {r.host for r in sites.evaluate(sizes, ["tech:sitemap-scale-limit"]).where("status = 'finding'").collect()} == {"a", "c"}
    urls = ["https://x/%C3%9Cber-uns", "https://x/roundabout", "https://x/de/Reach-Us/", "https://x/firma?x=/legal", "https://x/p?next=/legal", "https://x/%zz/dsgvo", "https://x/a%2Fabout"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.x for r in df.select(sites.plain_path("url").rlike(sites.CONTACT).alias("x")).collect()] == [True, False, True, True, False, True, True]


def test_relative_references(spark):
    d, base = Spark(), "https://A.example:443/x/y.html?q=1#f"
    cases = {
        "https://b/c": "https://b/c", "//c.example/d": "https://c.example/d", "/r": "https://a.example/r", "z": "https://a.example/x/z", "../z": "https://a.example/z", "./": "https://a.example/x/", "../../../k?v": "https://a.example/k?v",
        "?p": "https://a.example/x/y.html?p", "": "https://a.example/x/y.html?q=1", "#g": "https://a.example/x/y.html?q=1#g", "mailto:x@y": "mailto:x@y", "/a/./b/..": "https://a.example/a/",
    }
    df = spark.createDataFrame([(c, base) for c in cases], "ref string, base string")
    assert {r.ref: r.got for r in df.select("ref", F.expr(resolve(d, "ref", "base")).alias("got")).collect()} == cases
    one = spark.sql(f"SELECT {address(d, 'u')} AS a FROM VALUES ('HTTPS://B.example:443/x?q#f'), ('ftp://x') t(u)").collect()
    assert [r.a for r in one] == ["https://b.example/x?q#f", None]


def test_dates_of_several_forms(spark):
    forms = ["2025-03-04", "2025-03-04T10:00:00Z", "Tue, 04 Mar 2025 10:00:00 GMT", "4 Mar 2025", "March 4, 2025", "Mar 4, 2025", "2025/3/4", "3/4/2025", "17.03.2025", "soon", ""]
    df = spark.createDataFrame([(f,) for f in forms], "d string")
    got = [None if r.t is None else r.t.strftime("%m-%d") for r in df.select(F.expr(Spark().ts("d")).alias("t")).collect()]
    assert got == ["03-04"] * 8 + [None] * 3


def test_roots_of_sites(spark):
    pages = spark.createDataFrame([("a", 1, "https://a/x"), ("a", 2, "https://a/"), ("b", 3, "https://b/z"), ("b", 4, "https://b/y")], "site string, row_no long, url string")
    assert {(r.site, r.url) for r in linkgraph.site_roots(pages).collect()} == {("a", "https://a/"), ("b", "https://b/z")}


def test_leaks_are_found(spark):
    key = "sk_" + "live_1"
    df = spark.createDataFrame([(1, f"ok\n{key}\nmail me@x.example"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.line, r.severity) for r in evaluation.leak_scan(df, "doc_id", "text").collect()} == {(1, 2, "error"), (1, 3, "warn")}


def test_relational_rules_are_complete():
    from sitelens.queries import check_sql

    assert set(check_sql.RELATIONS) == set(relations.RELATIONAL) and set(check_sql.SITES) == set(sites.CONDITIONS) and set(check_sql.CONTENT) | set(check_sql.ALL_ROWS) == set(rules.PAGE_RULES)
