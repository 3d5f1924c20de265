"""Extraction checked on pages whose every part follows from a number: Spark builds the markup and runs
the extractor, the SQL computes each feature from the number, without any markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import html_features
from sitelens.session import table

#: linked data by row_no % 5: none, a product, a wrapped graph, a broken block, an array without proper context
LINKED = [
    "",
    '{"@context":"https://schema.org","@type":"Product","offers":{"@type":"Offer","price":9.5,"availability":"https://schema.org/InStock","shippingDetails":{}},'
    '"aggregateRating":{"@type":"AggregateRating","ratingValue":"4.1","reviewCount":7}}',
    '/*<![CDATA[*/ {"@context":"http://schema.org/","@graph":[{"@type":"Organization","sameAs":["x"],"logo":"l"},'
    '{"@type":["WebSite","FAQPage"],"datePublished":"2025-01-02","dateModified":"2025-02-03","x":{"@type":"Offer","price":1}}]} /*]]>*/',
    '{"@type":"Article","author":{"@type":"Person"}',
    '[{"@type":"BreadcrumbList"},{"@context":"https://example.org","@type":"Offer","price":3,"hasMerchantReturnPolicy":{}}]',
]
OUT = [
    "canonical", "canonical_count", "canon_self", "hreflang_count", "hreflang", "hreflang_links", "og_title", "og_image", "og_url", "has_favicon", "head_blocking_scripts", "head_blocking_styles", "resource_paths", "heading_outline", "h1_count",
    "img_total", "img_no_alt", "img_jpg", "img_webp", "img_avif", "img_no_dimensions", "first_img_lazy", "outlinks_internal", "outlinks_external", "outlinks_authoritative", "generic_anchor_count", "empty_link_count", "unlabeled_control_count",
    "dom_node_count", "word_count", "raw_word_count", "error_code", "has_microdata", "has_rdfa", "mixed_content", "ld_types", "ld_valid", "ld_context_ok", "has_product", "has_agg", "has_breadcrumb", "has_org", "has_org_same_as", "has_faq", "has_author",
    "date_published", "date_modified", "offer_price", "availability", "agg_rating_value", "agg_rating_count", "has_shipping_details", "has_return_policy", "has_org_logo", "has_org_contact_point",
]


def page(n: Column) -> Column:
    lit = F.lit
    some = lambda text, times: F.repeat(lit(text), times.cast("int"))
    only = lambda text, when: F.when(when, lit(text)).otherwise(lit(""))
    lazy = only(' loading="lazy"', n % 7 == 0)
    linked = F.when(n % 5 == 0, "").otherwise(F.concat(lit('<script type="application/ld+json">'), F.element_at(F.array(*map(lit, LINKED)), (n % 5 + 1).cast("int")), lit("</script>")))
    return F.concat(
        lit('<html lang="de"><head><meta charset=utf-8><title>T</title><link rel="canonical" href="/a">'), only('<link rel="canonical" href="/b">', n % 5 == 0), some('<link rel="alternate" hreflang="de" href="/de/">', n % 3),
        only('<meta property="og:title" content="t">', n % 4 > 0), only('<meta property="og:image" content="i">', n % 4 > 1), only('<meta property="og:url" content="u">', n % 4 > 2), only('<link rel="shortcut icon" href="/f.ico">', n % 2 == 1),
        some('<script src="/s.js"></script>', n % 3), lit('<script async src="/t.js"></script>'), some("<link rel=stylesheet href='/c.css'>", n % 6), linked, lit("</head><body><!-- <h2>no</h2> --><h1>x</h1>"), some("<h3>y</h3>", n % 3),
        F.repeat(F.concat(lit('<img src="/a.jpg" width=1 height=1 alt="z"'), lazy, lit(">")), (n % 4).cast("int")), some('<img data-x="a>b" src="/b.avif">', n % 3), some('<picture><source type="image/webp" srcset="/q.webp"></picture>', n % 2),
        some('<a href="/in">Seite</a> ', n % 5), some('<a href="https://out.example/x">Quelle</a> ', n % 3), some('<a href="https://de.wikipedia.org/w">Wiki</a> ', n % 2), some('<a href="/g"> Mehr </a> ', n % 2), some('<a href="/e"></a>', n % 3),
        lit('<a href="mailto:a@b.example">Mail</a> '), some("<button> </button>", n % 2), some('<iframe src="/f"></iframe>', n % 2), only('<div itemscope itemtype="https://schema.org/Thing"></div>', n % 4 == 1), only('<p vocab="https://schema.org/">v</p>', n % 4 == 2),
        only('<script src="http://x.example/y.js"></script>', n % 6 == 0), some("<p>eins zwei</p>", n % 4), lit("<p>"), some("漢字", n % 3), lit("</p></body></html>"),
    )


def html_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure, links, images, controls, words and linked data of one page for each row of crawl."""
    n = F.col("row_no")
    pages = table(spark, sf_dir, "crawl", "row_no").select("row_no", F.when(n % 2 == 0, "https://h.example/a/").otherwise("https://h.example/x").alias("url"), page(n).alias("html"))
    return html_features.features(pages, "row_no", "url", "html").select("row_no", *OUT)


def crawl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole crawl rows from fetched pages whose status, hops, headers and markup follow from their number."""
    n = F.col("row_no")
    empty = F.array().cast("array<string>")
    headers = F.map_filter(
        F.create_map(
            F.lit("x-robots-tag"), F.when(n % 5 == 0, "noindex"), F.lit("strict-transport-security"), F.when(n % 2 == 0, "max-age=1"), F.lit("content-security-policy"), F.when(n % 3 == 0, "Frame-Ancestors 'none'").when(n % 3 == 1, "default-src 'self'"),
            F.lit("x-frame-options"), F.when(n % 7 == 0, "DENY"), F.lit("content-encoding"), F.when(n % 4 > 0, "br"), F.lit("x-content-type-options"), F.when(n % 3 == 0, "NoSniff, nosniff").when(n % 3 == 1, "none"),
            F.lit("referrer-policy"), F.when(n % 2 == 1, "origin"), F.lit("permissions-policy"), F.when(n % 5 == 1, "x=()"), F.lit("server"), F.when(n % 4 == 0, "nginx/1.18.0").when(n % 4 == 1, "ECS (dcb/7F83) 2.1"), F.lit("x-powered-by"), F.when(n % 11 == 0, "X"),
        ),
        lambda _, v: v.isNotNull(),
    )
    cookies = F.when(n % 3 == 0, F.array(F.lit("secure=1; HttpOnly; SameSite=Lax"))).when(n % 3 == 1, F.array(F.lit("a=b; Secure; HttpOnly; SameSite"), F.lit("c=d;secure;httponly;samesite=none"))).otherwise(empty)
    fetched = table(spark, sf_dir, "crawl", "row_no").select(
        "row_no", F.lit("http://h.example/x").alias("url"), F.when(n % 2 == 0, "product").alias("page_type"), F.when(n % 6 == 5, 0).otherwise(200).alias("status"), F.when(n % 4 > 0, "https://h.example/x").alias("final_url"),
        F.when(n % 4 > 1, F.array_repeat(F.lit("http://h.example/y"), (n % 4 - 1).cast("int"))).otherwise(empty).alias("hops"), headers.alias("headers"), cookies.alias("set_cookies"), F.when(n % 6 == 5, "timeout").alias("error"), F.when(n % 6 < 4, page(n)).alias("html"),
    )
    return html_features.crawl_rows(fetched).select("row_no", *ROW_OUT)


ROW_OUT = [
    "page_type", "status", "final_url", "redirected", "redirect_chain", "https_ok", "error_code", "x_robots_tag", "hsts_present", "frame_protection", "content_encoding", "nosniff_present", "referrer_policy_present", "permissions_policy_present",
    "csp_present", "cookie_insecure", "version_disclosure", "title", "h1_count", "word_count", "img_total", "mixed_content",
]


def _by_five(*values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][m % 5 + 1]"


_FLAG = "CASE WHEN {} THEN '1' ELSE '0' END"
_WORDS = "1 + m % 3 + m % 5 + m % 3 + m % 2 + m % 2 + 1 + CASE WHEN m % 4 = 2 THEN 1 ELSE 0 END + 2 * (m % 4) + 2 * (m % 3)"
_EXPECTED = {
    "canonical": "'/a'", "canonical_count": "CASE WHEN m % 5 = 0 THEN '2' ELSE '1' END", "canon_self": _FLAG.format("m % 2 = 0"), "hreflang_count": "m % 3", "hreflang": "rtrim(repeat('de,', m % 3), ',')", "hreflang_links": "rtrim(repeat('de=/de/|', m % 3), '|')",
    "og_title": "CASE WHEN m % 4 > 0 THEN 't' ELSE '' END", "og_image": "CASE WHEN m % 4 > 1 THEN 'i' ELSE '' END", "og_url": "CASE WHEN m % 4 > 2 THEN 'u' ELSE '' END", "has_favicon": _FLAG.format("m % 2 = 1"),
    "head_blocking_scripts": "m % 3", "head_blocking_styles": "m % 6", "resource_paths": "concat(CASE WHEN m % 3 > 0 THEN '/s.js|' ELSE '' END, '/t.js', CASE WHEN m % 6 > 0 THEN '|/c.css' ELSE '' END)",
    "heading_outline": "concat('h1', repeat(',h3', m % 3))", "h1_count": "1", "img_total": "m % 4 + m % 3", "img_no_alt": "m % 3", "img_jpg": "m % 4", "img_webp": "m % 2", "img_avif": "m % 3", "img_no_dimensions": "m % 3",
    "first_img_lazy": _FLAG.format("m % 7 = 0 AND m % 4 > 0"), "outlinks_internal": "m % 5 + m % 2 + m % 3", "outlinks_external": "m % 3 + m % 2", "outlinks_authoritative": "m % 2", "generic_anchor_count": "m % 2", "empty_link_count": "m % 3",
    "unlabeled_control_count": "2 * (m % 2)", "word_count": _WORDS, "raw_word_count": _WORDS, "error_code": f"CASE WHEN {_WORDS} < 10 THEN 'js-guard:empty-body' ELSE '' END",
    "dom_node_count": "1 + m % 3 + m % 4 + m % 3 + 2 * (m % 2) + m % 5 + m % 3 + m % 2 + m % 2 + m % 3 + 1 + m % 2 + m % 2 + CASE WHEN m % 4 IN (1, 2) THEN 1 ELSE 0 END + m % 4 + 1",
    "has_microdata": _FLAG.format("m % 4 = 1"), "has_rdfa": _FLAG.format("m % 4 = 2"), "mixed_content": _FLAG.format("m % 6 = 0"),
    "ld_types": _by_five("", "Product,Offer,AggregateRating", "Organization,WebSite,FAQPage,Offer", "Article,Person", "BreadcrumbList,Offer"), "ld_valid": _by_five(*"11101"), "ld_context_ok": _by_five("", "1", "1", "", "0"),
    "has_product": _by_five(*"01000"), "has_agg": _by_five(*"01000"), "has_breadcrumb": _by_five(*"00001"), "has_org": _by_five(*"00100"), "has_org_same_as": _by_five(*"00100"), "has_faq": _by_five(*"00100"), "has_author": _by_five(*"00010"),
    "date_published": _by_five("", "", "2025-01-02", "", ""), "date_modified": _by_five("", "", "2025-02-03", "", ""), "offer_price": _by_five("", "9.5", "", "", "3"), "availability": _by_five("", "https://schema.org/InStock", "", "", ""),
    "agg_rating_value": _by_five("", "4.1", "", "", ""), "agg_rating_count": _by_five("", "7", "", "", ""), "has_shipping_details": _by_five(*"01000"), "has_return_policy": _by_five(*"00001"), "has_org_logo": _by_five(*"00100"), "has_org_contact_point": _by_five(*"00000"),
}

_PAGED = "CASE WHEN m % 6 < 4 THEN CAST({} AS VARCHAR) ELSE '' END"
_ROW_EXPECTED = {
    "page_type": "CASE WHEN m % 2 = 0 THEN 'product' ELSE 'page' END", "status": "CASE WHEN m % 6 = 5 THEN '0' ELSE '200' END", "final_url": "CASE WHEN m % 4 > 0 THEN 'https://h.example/x' ELSE 'http://h.example/x' END", "redirected": _FLAG.format("m % 4 > 1"),
    "redirect_chain": "CASE m % 4 WHEN 2 THEN 'http://h.example/y' WHEN 3 THEN 'http://h.example/y|http://h.example/y' ELSE '' END", "https_ok": _FLAG.format("m % 4 > 0"),
    "error_code": f"CASE WHEN m % 6 = 5 THEN 'timeout' WHEN m % 6 < 4 THEN {_EXPECTED['error_code']} ELSE '' END", "x_robots_tag": "CASE WHEN m % 5 = 0 THEN 'noindex' ELSE '' END", "hsts_present": _FLAG.format("m % 2 = 0"), "frame_protection": _FLAG.format("m % 3 = 0 OR m % 7 = 0"),
    "content_encoding": "CASE WHEN m % 4 > 0 THEN 'br' ELSE '' END", "nosniff_present": _FLAG.format("m % 3 = 0"), "referrer_policy_present": _FLAG.format("m % 2 = 1"), "permissions_policy_present": _FLAG.format("m % 5 = 1"), "csp_present": _FLAG.format("m % 3 < 2"),
    "cookie_insecure": _FLAG.format("m % 3 = 0"), "version_disclosure": _FLAG.format("m % 4 = 0 OR m % 11 = 0"), "title": _PAGED.format("'T'"), "h1_count": _PAGED.format("1"), "word_count": _PAGED.format(_WORDS), "img_total": _PAGED.format(_EXPECTED["img_total"]),
    "mixed_content": _PAGED.format(_FLAG.format("m % 6 = 0 AND m % 4 > 0")),
}

QUERIES = {"html_structure": html_structure, "crawl_rows": crawl_rows}
SQL = {
    "html_structure": "SELECT m AS row_no, " + ", ".join(f"CAST({_EXPECTED[c]} AS VARCHAR) AS {c}" for c in OUT) + " FROM (SELECT row_no AS m FROM crawl)",
    "crawl_rows": "SELECT m AS row_no, " + ", ".join(f"CAST({_ROW_EXPECTED[c]} AS VARCHAR) AS {c}" for c in ROW_OUT) + " FROM (SELECT row_no AS m FROM crawl)",
}
