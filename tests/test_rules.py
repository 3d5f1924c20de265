import re
from collections import Counter

from pyspark.sql import functions as F

from sitelens.functions.exprs import Spark
from sitelens.operators import relations, rules, sites
from sitelens.plans import audit

CELLS = {"status": "200", "word_count": "500", "redirected": "0", "title": "A fine title that is long enough", "title_len": "32", "https_ok": "1"}


def page(spark, **cells):
    cols = sorted({"host", "url", "error_code", "heading_outline", "ld_types", "robots_meta", "viewport_content", *CELLS, *_columns()})
    row = {c: "" for c in cols} | CELLS | {"host": "h", "url": "https://h/x"} | cells
    return spark.createDataFrame([(1, *[row[c] for c in cols])], "row_no bigint, " + ", ".join(f"{c} string" for c in cols))


def _columns():
    d = Spark()
    text = " ".join(f(d, rules.CATALOGUE[r].params) for r, f in rules.PAGE_RULES.items())
    return set(re.findall(r"coalesce\((\w+), ''\)", text))


def fired(spark, **cells):
    return {r.rule_id for r in audit.page_hits(page(spark, **cells)).collect()}


def test_catalogue_is_complete():
    assert len(rules.CATALOGUE) == 96
    assert Counter(r.severity for r in rules.CATALOGUE.values()) == {"hoch": 14, "mittel": 41, "niedrig": 39, "info": 2}
    assert set(rules.CATALOGUE) == set(rules.PAGE_RULES) | set(relations.RELATIONAL) | set(sites.CONDITIONS) | {"i18n:hreflang-invalid-code"}


def test_predicates(spark):
    assert "onpage:title-long" in fired(spark, title_len="61") and "onpage:title-long" not in fired(spark, title_len="60")
    assert "onpage:heading-skip" in fired(spark, heading_outline="h1,h2,h4") and "onpage:heading-skip" not in fired(spark, heading_outline="h1,h2,h3,h1")
    assert "geo:ai-snippet-suppressed" in fired(spark, robots_meta="max-snippet: 0") and "geo:ai-snippet-suppressed" not in fired(spark, robots_meta="max-snippet:05")
    assert "onpage:viewport-zoom-disabled" in fired(spark, viewport_content="maximum-scale=1.5") and "onpage:viewport-zoom-disabled" not in fired(spark, viewport_content="maximum-scale=2")
    assert "tech:non-2xx" in fired(spark, status="0") and "tech:non-2xx" not in fired(spark, status="")
    assert "onpage:title-missing" not in fired(spark, title="", redirected="1")  # redirect rows show another page
    assert "onpage:h1-missing" in fired(spark, h1_count="1", h1=" ") and "onpage:h1-missing" not in fired(spark, h1_count="")


def test_null_cells_count_as_empty(spark):
    df = page(spark)
    cells = [F.lit(None).cast("string").alias(c) for c in df.columns if c not in ("row_no", "host", "url")]
    nulled = df.select("row_no", "host", "url", *cells)
    assert {r.rule_id for r in audit.page_hits(nulled).collect()} == set()  # no word count: not parsed


def test_samples_and_clusters(spark):
    hits = spark.createDataFrame([("h", i, f"https://h/{'ab'[i % 2]}/{i}", "r") for i in range(25)], "host string, row_no bigint, url string, rule_id string")
    picked = [r.url.rsplit("/")[-1] for r in audit.samples(hits).orderBy("ord").collect()]
    assert picked == [str(int(i * 24 / 9 + 0.5)) for i in range(10)]
    assert [(r.pattern, r.n) for r in audit.clusters(hits).orderBy("ord").collect()] == [("/a/*", 13), ("/b/*", 12)]
    assert audit.samples(hits.where("false")).count() == 0
