"""Queries of the audit itself: findings, graph, knowledge base, classifiers, scores, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.exprs import DuckDb, Spark, host, normalized, path, query
from sitelens.operators import evaluation as ev
from sitelens.operators import html_features, knowledge, linkgraph, robots, rules, runtime, sites
from sitelens.plans import audit
from sitelens.queries import check_sql
from sitelens.queries.rules import all_hits, depths, graph, site_status
from sitelens.queries.signals import ROBOTS, patterns
from sitelens.session import table
from sitelens.sources import artifacts, report

D, Q = Spark(), DuckDb()
CHILD_LOCS = robots.MAX_LOCS // robots.MAX_CHILDREN  # pages in each child sitemap


def audit_hits(spark, sf_dir):
    """Every rule over every page and site; a rule about a whole site has no ``row_no``."""
    whole = site_status(spark, sf_dir).where("status = 'finding'").select("rule_id", "host", F.lit(None).cast("bigint").alias("row_no"))
    return all_hits(spark, sf_dir).select("rule_id", "host", "row_no").unionByName(whole)


def audit_findings(spark, sf_dir):
    crawl = table(spark, sf_dir, "crawl")
    return audit.findings(all_hits(spark, sf_dir), crawl, site_status(spark, sf_dir)).select("host", "rule_id", "severity", "hits", "pct_of_pages")


def audit_status(spark, sf_dir):
    crawl = table(spark, sf_dir, "crawl")
    of_pages = [r for r in rules.CATALOGUE if r not in sites.CONDITIONS]
    return audit.statuses(all_hits(spark, sf_dir), crawl, of_pages, site_status(spark, sf_dir))


def audit_samples(spark, sf_dir):
    return audit.samples(all_hits(spark, sf_dir))


def audit_clusters(spark, sf_dir):
    return audit.clusters(all_hits(spark, sf_dir))


def audit_meta(spark, sf_dir):
    crawl = table(spark, sf_dir, "crawl")
    sizes = crawl.where("canonical <> ''").groupBy("host").agg(F.countDistinct("canonical").alias("locs"))
    return audit.site_meta(crawl, sizes)


def thin_ranked(spark, sf_dir):
    """Thin pages per site from the shortest on."""
    thin = audit.page_hits(table(spark, sf_dir, "crawl"), ["onpage:thin"]).select("row_no")
    words = table(spark, sf_dir, "crawl", "host", "row_no", "word_count").withColumn("words", F.expr(D.int("word_count")))
    found = words.join(thin, "row_no").select("host", "row_no", "words", F.expr("row_number() over (partition by host, words order by row_no)").alias("tie"))
    # the pages of each number of words are numbered by themselves and shifted by those with fewer words
    before = found.groupBy("host", "words").agg(F.count(F.lit(1)).alias("n")).select("host", "words", F.expr("sum(n) over (partition by host order by words) - n").alias("before"))
    return found.join(before, ["host", "words"]).select("host", "row_no", "words", (F.col("before") + F.col("tie")).alias("rank"))


def link_edges(spark, sf_dir):
    return graph(spark, sf_dir)[1]


def link_inlinks(spark, sf_dir):
    return linkgraph.inlinks(graph(spark, sf_dir)[1]).select(F.col("dst").alias("url"), "inlinks")


def link_depth(spark, sf_dir):
    return depths(spark, sf_dir)


def link_orphans(spark, sf_dir):
    pages, edges, roots = graph(spark, sf_dir)
    return linkgraph.orphans(pages, edges, roots).select("row_no", "url")


def url_keys(spark, sf_dir):
    c = table(spark, sf_dir, "crawl", "row_no", "url", "final_url")
    return c.select("row_no", F.expr(normalized(D, "url")).alias("norm"), F.expr(host(D, "final_url")).alias("host_part"), F.expr(path(D, "final_url")).alias("path_part"), F.expr(query(D, "final_url")).alias("query_part"))


def robots_verdicts(spark, sf_dir):
    """Is each page's path allowed by its site's robots.txt?"""
    crawl = table(spark, sf_dir, "crawl")
    targets = crawl.select(F.col("host").alias("site"), "row_no", F.expr(f"concat({path(D, 'url')}, {query(D, 'url')})").alias("path"))
    return robots.allowed(targets, patterns(crawl), ["row_no"]).select("row_no", "allowed")


def robots_parsed(spark, sf_dir):
    hosts = table(spark, sf_dir, "crawl", "host").distinct().withColumn("raw", F.element_at(F.array(*map(F.lit, ROBOTS)), (F.length("host") % 4 + 1).cast("int")))
    return robots.parse_files(hosts, "host", "raw").select("host", F.array_join("disallow", " ").alias("disallow"), F.array_join("allow", " ").alias("allow"), F.size("sitemaps").alias("sitemaps"), "crawl_delay")


def robots_bots(spark, sf_dir):
    """The crawlers of AI services that each site's robots.txt names, and what it closes to them."""
    hosts = table(spark, sf_dir, "crawl", "host").distinct().withColumn("raw", F.element_at(F.array(*map(F.lit, ROBOTS)), (F.length("host") % 4 + 1).cast("int")))
    b = robots.parse_files(hosts, "host", "raw").select("host", F.explode("bots").alias("b"))
    return b.select("host", "b.agent", "b.operator", "b.use", "b.disallow_all", F.array_join("b.paths", " ").alias("paths"))


def llms_check(spark, sf_dir):
    """Texts of the knowledge base checked as if they were llms.txt files."""
    return table(spark, sf_dir, "kb_chunks", "chunk_no", "content").select("chunk_no", F.size(robots.llms_problems(F.coalesce("content", F.lit("")))).alias("problems"))


def sitemap_expanded(spark, sf_dir):
    """A sitemap index per site whose children list all pages of the site, in crawl order.

    A child lists ``CHILD_LOCS`` pages, so no cell grows with the site, and the reference's caps on
    children and addresses are reached together.
    """
    c = table(spark, sf_dir, "crawl", "host", "row_no", "url").groupBy("host", "url").agg(F.min("row_no").alias("row_no"))
    placed = audit.ranked(c, ["host"]).withColumn("part", F.floor(F.col("rank") / CHILD_LOCS))
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    listed = F.array_sort(F.collect_list(F.struct("rank", loc.alias("loc"))))
    kids = placed.groupBy("host", "part").agg(F.concat_ws("", F.transform(listed, lambda x: x["loc"])).alias("body"))
    child = lambda p: F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap-"), p.cast("string"), F.lit(".xml"))
    files = kids.select(F.col("host").alias("site"), child(F.col("part")).alias("url"), "body", F.lit(False).alias("is_root"))
    parts = F.transform(F.sequence(F.lit(0), F.col("last")), lambda p: F.concat(F.lit("<sitemap><loc>"), child(p), F.lit("</loc></sitemap>")))
    index = placed.groupBy("host").agg(F.max("part").cast("int").alias("last")).select(
        F.col("host").alias("site"), F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"),
        F.concat(F.lit("<sitemapindex>"), F.concat_ws("", parts), F.lit("<sitemap><loc>https://other.example/s.xml</loc></sitemap></sitemapindex>")).alias("body"), F.lit(True).alias("is_root"),
    )
    return robots.expand_index(files.unionByName(index)).select("site", "loc")


def crawl_frontier(spark, sf_dir):
    c = table(spark, sf_dir, "crawl", "host", "row_no", "url", "canonical", "page_type")
    seeds = c.where("canonical <> ''").select(F.col("host").alias("site"), F.col("row_no").alias("ord"), F.col("canonical").alias("url"))
    return artifacts.frontier(c.select(F.col("host").alias("site"), "url", "page_type"), seeds, artifacts.PROFILES["full"]["max_urls"]).select("site", "no", "url")


def url_types(spark, sf_dir):
    kinds = [("product", "^/(p|shop)/"), ("article", "^/(blog|ratgeber)/"), ("help", "^/help/")]
    return table(spark, sf_dir, "crawl", "row_no", "url").select("row_no", artifacts.classify("url", kinds).alias("kind"))


# Extraction: pages written from the crawl table's own cells must give them back ---------------


def _page(c: dict[str, Column]) -> Column:
    esc = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    lit, cat = F.lit, F.concat
    meta = lambda n, v: F.when(v != "", cat(lit(f'<meta name="{n}" content="'), esc(v), lit('">'))).otherwise(lit(""))
    images = lambda n, ext: F.repeat(lit(f'<img src="/i/x.{ext}" alt="a" width=1 height=1>'), F.coalesce(n, lit(0)))
    return cat(
        lit("<!DOCTYPE html><html"), F.when(c["html_lang"] != "", cat(lit(' lang="'), c["html_lang"], lit('"'))).otherwise(lit("")), lit('><head><meta charset="utf-8"><!-- <title>no</title> --><title>'), esc(c["title"]), lit("</title>"),
        meta("description", c["meta_desc"]), meta("robots", c["robots_meta"]), meta("viewport", c["viewport_content"]), F.when(c["canonical"] != "", cat(lit('<link rel="canonical" href="'), esc(c["canonical"]), lit('">'))).otherwise(lit("")),
        lit('</head><body class="a>b"><script>if (1 < 2) document.write("<h1>no</h1>")</script>'), F.when(c["h1"] != "", cat(lit("<h1>"), esc(c["h1"]), lit("</h1>"))).otherwise(lit("")),
        images(c["jpg"], "jpg"), images(c["webp"], "webp"), F.repeat(lit('<a href="/in/page">text</a> '), F.coalesce(c["links"], lit(0))), lit("</body></html>"),
    )


def html_features_q(spark, sf_dir):
    c = table(spark, sf_dir, "crawl")
    s = lambda x: F.coalesce(F.trim(F.regexp_replace(x, r"[\s\p{Z}\x{FEFF}]+", " ")), F.lit(""))
    count = lambda x: F.expr(D.int(x)).cast("int")
    cells = {x: s(x) for x in ("title", "meta_desc", "h1", "robots_meta", "html_lang", "viewport_content", "canonical")} | {"jpg": count("img_jpg"), "webp": count("img_webp"), "links": count("outlinks_internal")}
    got = html_features.features(c.select("row_no", "url", _page(cells).alias("html")), "row_no", "url", "html")
    return got.select("row_no", "title", "title_len", "meta_desc", "meta_missing", "robots_meta", "html_lang", "viewport_content", "canonical", "h1", "h1_count", "img_total", "img_jpg", "img_webp", "outlinks_internal", "charset_ok", "https_ok")


_SQ = lambda x: f"coalesce(trim(regexp_replace({x}, '[\\s\\pZ﻿]+', ' ', 'g')), '')"
_N = lambda x: f"coalesce({Q.int(x)}, 0)"
_HTML_SQL = f"""SELECT row_no, t AS title, CAST({Q.utf16('t')} AS VARCHAR) AS title_len, m AS meta_desc, CASE WHEN m = '' THEN '1' ELSE '0' END AS meta_missing, {_SQ('robots_meta')} AS robots_meta, {_SQ('html_lang')} AS html_lang,
 {_SQ('viewport_content')} AS viewport_content, {_SQ('canonical')} AS canonical, h AS h1, CASE WHEN h = '' THEN '0' ELSE '1' END AS h1_count, CAST({_N('img_jpg')} + {_N('img_webp')} AS VARCHAR) AS img_total, CAST({_N('img_jpg')} AS VARCHAR) AS img_jpg,
 CAST({_N('img_webp')} AS VARCHAR) AS img_webp, CAST({_N('outlinks_internal')} AS VARCHAR) AS outlinks_internal, '1' AS charset_ok, CASE WHEN starts_with(url, 'https://') THEN '1' ELSE '0' END AS https_ok
 FROM (SELECT *, {_SQ('title')} AS t, {_SQ('meta_desc')} AS m, {_SQ('h1')} AS h FROM crawl)"""


# Knowledge base ---------------------------------------------------------------------------


def kb_sections(spark, sf_dir):
    """Markdown sections of every document."""
    return knowledge.sections(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def kb_embedding(spark, sf_dir):
    """Embedding of each chunk's content: its slots that are not zero."""
    v = knowledge.embed(table(spark, sf_dir, "kb_chunks", "chunk_no", "content"), "chunk_no", "content")
    return v.select("chunk_no", F.posexplode("vector").alias("slot", "weight")).where("weight <> 0").withColumn("weight", F.round("weight", 6))


def kb_search(spark, sf_dir):
    """The four most similar embeddings of every twentieth one."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return knowledge.top_k(e, e.where("id % 20 = 0"), k=4)


def kb_retrieve(spark, sf_dir):
    """Of the ten most similar embeddings of every twentieth one those with a score of 0.3 or more."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return knowledge.top_k(e, e.where("id % 20 = 0"), k=10, min_score=0.3)


def kb_cosine(spark, sf_dir):
    """Cosine of each embedding with the next one."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(knowledge.cosine("embedding", "b"), 6).alias("score"))


def kb_upsert(spark, sf_dir):
    """The store after chunks that were ingested again have replaced their older versions."""
    k = table(spark, sf_dir, "kb_chunks", "chunk_no", "id", "source", "heading", "content", "ingested_at")
    store = k.groupBy("id").agg(F.min_by(F.struct(*k.columns), "chunk_no").alias("r")).select("r.*")
    return knowledge.upsert(store, k, "id", "chunk_no").select("id", "chunk_no")


def kb_allowlist(spark, sf_dir):
    return table(spark, sf_dir, "kb_chunks", "source", "id").select("source", F.regexp_extract("id", "^([^#]*)#", 1).alias("file")).distinct()


# Runtime classifiers -------------------------------------------------------------------------


def runtime_cwv(spark, sf_dir):
    """Event values as if they were field measurements."""
    e = table(spark, sf_dir, "events", "event_id", "value").withColumn("v", F.col("value").cast("double"))
    return e.select("event_id", runtime.cwv_category("lcp", F.col("v") * 50).alias("lcp"), runtime.cwv_category("inp", F.col("v") * 5).alias("inp"), runtime.cwv_category("cls", F.col("v") / 400).alias("cls"))


def runtime_certificates(spark, sf_dir):
    c = table(spark, sf_dir, "crawl", "row_no", "host")
    days = (F.col("row_no") % 60 - 20).cast("double") + 0.5
    names = F.array(F.concat(F.lit("*."), F.regexp_replace("host", r"^www\.", "")), F.lit("x.example"))
    return c.select("row_no", F.array_join(runtime.certificate_issues(days, runtime.san_matches(F.col("host"), names), F.col("row_no") % 7 != 0), "+").alias("issues"))


def runtime_intervals(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    return p.select("p_partkey", runtime.fetch_interval_ms(F.col("p_size").cast("double"), (F.col("p_partkey") % 15).cast("double")).alias("ms"))


# Scores ------------------------------------------------------------------------------------


def _expected(findings: DataFrame) -> DataFrame:
    """What a fixture must find: what its first run cites."""
    return ev.produced(findings.where("run_no = 1")).select("fixture", "rule_id")


def _scores(spark, sf_dir):
    f = table(spark, sf_dir, "findings")
    return f, ev.produced(f), _expected(f)


def eval_rule_ids(spark, sf_dir):
    return ev.rule_ids(ev.flat(table(spark, sf_dir, "findings"))).select("run_key", F.col("f.id").alias("finding_id"), F.array_join("ids", " ").alias("ids"))


def eval_scraped_ids(spark, sf_dir):
    """Rule ids from the evidence text alone."""
    flat = ev.flat(table(spark, sf_dir, "findings")).withColumn("f", F.col("f").withField("rule_ids", F.lit(None).cast("array<string>")))
    return ev.rule_ids(flat).select("run_key", F.col("f.id").alias("finding_id"), F.array_join("ids", " ").alias("ids"))


def eval_recall(spark, sf_dir):
    return ev.recall(*_scores(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


def eval_missed(spark, sf_dir):
    return ev.missed(*_scores(spark, sf_dir)).select("fixture", "run_no", "rule_id")


def eval_citations(spark, sf_dir):
    return ev.citations(table(spark, sf_dir, "findings"), table(spark, sf_dir, "kb_chunks", "source")).withColumn("validity", F.round("validity", 6))


def _fabrications(spark, sf_dir):
    traps = table(spark, sf_dir, "rule_registry").where("retired_at is not null").select("rule_id")
    return ev.fabrications(table(spark, sf_dir, "findings"), traps, table(spark, sf_dir, "affected_urls", "rule_id"))


def eval_fabrications(spark, sf_dir):
    return _fabrications(spark, sf_dir)


def eval_provenance(spark, sf_dir):
    return ev.provenance(table(spark, sf_dir, "findings"))


def eval_faithfulness(spark, sf_dir):
    return ev.faithfulness(table(spark, sf_dir, "judge"), "fixture")


def eval_stability(spark, sf_dir):
    return ev.stability(ev.recall(*_scores(spark, sf_dir)))


def eval_anchor_stability(spark, sf_dir):
    return ev.anchor_stability(*_scores(spark, sf_dir))


def eval_aggregate(spark, sf_dir):
    f = table(spark, sf_dir, "findings")
    return ev.aggregate(ev.recall(*_scores(spark, sf_dir)), ev.citations(f, table(spark, sf_dir, "kb_chunks", "source")), _fabrications(spark, sf_dir), table(spark, sf_dir, "judge"))


def eval_gate(spark, sf_dir):
    return ev.gate(eval_aggregate(spark, sf_dir), {"recall": 0.9, "faithfulness": 0.5, "stability": 0.2}, {"recall": 0.05})


def findings_errors(spark, sf_dir):
    return ev.errors(table(spark, sf_dir, "findings"))


def verdict_errors(spark, sf_dir):
    return ev.verdict_errors(table(spark, sf_dir, "judge"))


def run_ledger(spark, sf_dir):
    analysis = table(spark, sf_dir, "rule_registry", "rule_id")
    return ev.ledger(table(spark, sf_dir, "findings"), analysis).groupBy("run_key", "state").agg(F.count(F.lit(1)).alias("rules"))


def run_handoff(spark, sf_dir):
    """Where each run stands; the lists as texts."""
    h = ev.handoff(table(spark, sf_dir, "findings"), table(spark, sf_dir, "rule_registry", "rule_id"))
    return h.select("run_key", F.array_join("sections", ";").alias("sections"), F.array_join("interpreted", " ").alias("interpreted"), F.array_join("remaining", " ").alias("remaining"))


def run_reports(spark, sf_dir):
    """The report of every run."""
    return report.run_reports(table(spark, sf_dir, "findings"))


def kb_ingest(spark, sf_dir):
    """Documents with a front matter of their own, ingested as files."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source").where("trim(text) <> ''")
    front = F.concat(F.lit("---\nsource: "), F.concat(F.lit("https://kb.example/"), F.col("doc_id").cast("string")), F.lit("\ndatum: 2026-01\n---\n"))
    files = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.when(F.col("doc_id") % 2 == 0, F.concat(front, F.lit("# Kopf\n"), F.regexp_replace("text", r"[#`~]", ""))).otherwise(F.regexp_replace("text", r"[#`~]", "")).alias("text"))
    got = knowledge.ingest(files)
    return got.select("id", "source", "heading", "date", F.length("text").alias("chars"), F.size(F.filter("vector", lambda x: x != 0)).alias("slots"))


def frontier_rewritten(spark, sf_dir):
    """Canonical addresses as a crawl of a test host would fetch them."""
    c = table(spark, sf_dir, "crawl", "row_no", "canonical").where("canonical <> ''").withColumn("origin", F.lit("http://127.0.0.1:8080"))
    return c.select("row_no", artifacts.to_origin("canonical", "origin").alias("url"))


def severity_histogram(spark, sf_dir):
    return ev.severity_histogram(table(spark, sf_dir, "findings"))


def priorities(spark, sf_dir):
    return ev.priorities(table(spark, sf_dir, "findings"))


def leak_scan(spark, sf_dir):
    """Addresses and secrets in documents, and one word known only by its digest."""
    digest = "8c7dd922ad47494fc02c388e12c00eac278d3e8e26a4e5a7c1d3b2f1a3a0c5de"
    return ev.leak_scan(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", [digest])


QUERIES = {
    "audit_hits": audit_hits, "audit_findings": audit_findings, "audit_status": audit_status, "audit_samples": audit_samples, "audit_clusters": audit_clusters, "audit_meta": audit_meta, "thin_ranked": thin_ranked,
    "link_edges": link_edges, "link_inlinks": link_inlinks, "link_depth": link_depth, "link_orphans": link_orphans, "url_keys": url_keys, "robots_verdicts": robots_verdicts, "robots_parsed": robots_parsed, "robots_bots": robots_bots, "llms_check": llms_check,
    "sitemap_expanded": sitemap_expanded, "crawl_frontier": crawl_frontier, "url_types": url_types, "html_features": html_features_q, "kb_sections": kb_sections, "kb_embedding": kb_embedding, "kb_search": kb_search, "kb_retrieve": kb_retrieve, "kb_cosine": kb_cosine,
    "kb_upsert": kb_upsert, "kb_allowlist": kb_allowlist, "runtime_cwv": runtime_cwv, "runtime_certificates": runtime_certificates, "runtime_intervals": runtime_intervals, "eval_rule_ids": eval_rule_ids, "eval_scraped_ids": eval_scraped_ids,
    "eval_recall": eval_recall, "eval_missed": eval_missed, "eval_citations": eval_citations, "eval_fabrications": eval_fabrications, "eval_provenance": eval_provenance, "eval_faithfulness": eval_faithfulness, "eval_stability": eval_stability,
    "eval_anchor_stability": eval_anchor_stability, "eval_aggregate": eval_aggregate, "eval_gate": eval_gate, "findings_errors": findings_errors, "verdict_errors": verdict_errors, "run_ledger": run_ledger, "run_handoff": run_handoff, "run_reports": run_reports, "kb_ingest": kb_ingest, "frontier_rewritten": frontier_rewritten, "severity_histogram": severity_histogram,
    "priorities": priorities, "leak_scan": leak_scan,
}

_FLAT = """s AS (SELECT run_key, fixture, run_no, meta, unnest(sections) AS s FROM findings), fl AS (SELECT run_key, fixture, run_no, meta, unnest(s.findings) AS f FROM s)"""
_GIVEN = "list_sort(list_distinct(list_filter(f.rule_ids, lambda x: x IS NOT NULL AND x <> '')))"
_SCRAPED = "list_sort(list_distinct(flatten(list_transform(regexp_extract_all(f.beleg, 'ruleId=([^;]*)', 1), lambda c: regexp_extract_all(c, '[a-z][a-z0-9]*:[a-z0-9:_-]+')))))"
_IDS = f"CASE WHEN f.rule_ids IS NOT NULL THEN {_GIVEN} ELSE coalesce({_SCRAPED}, []) END"
_CITED = f"{_FLAT}, cited AS (SELECT DISTINCT fixture, run_no, unnest({_IDS}) AS rule_id FROM fl), expected AS (SELECT DISTINCT fixture, rule_id FROM cited WHERE run_no = 1), runs AS (SELECT DISTINCT fixture, run_no FROM findings)"
_RECALL = f"{_CITED}, rec AS (SELECT r.fixture, r.run_no, count(e.rule_id) AS expected, count(c.rule_id) AS covered, CASE WHEN count(e.rule_id) = 0 THEN 1.0 ELSE count(c.rule_id) / count(e.rule_id) END AS recall FROM runs r LEFT JOIN expected e ON e.fixture = r.fixture LEFT JOIN cited c ON c.fixture = r.fixture AND c.run_no = r.run_no AND c.rule_id = e.rule_id GROUP BY 1, 2)"
_CITES = "k AS (SELECT fixture, run_no, trim(x.k.source) AS source FROM (SELECT fixture, run_no, unnest(f.kb_sources) AS k FROM fl) x), cites AS (SELECT r.fixture, r.run_no, count(k.fixture) AS total, count(k.source) FILTER (k.source IN (SELECT trim(source) FROM kb_chunks)) AS valid FROM (SELECT DISTINCT fixture, run_no FROM findings) r LEFT JOIN k ON k.fixture = r.fixture AND k.run_no = r.run_no GROUP BY 1, 2)"
_FAB = f"""c1 AS (SELECT run_key, f.id AS finding_id, unnest({_IDS}) AS rule_id FROM fl), trap AS (SELECT DISTINCT rule_id FROM rule_registry WHERE retired_at IS NOT NULL), pos AS (SELECT DISTINCT run_key, unnest(positives) AS rule_id FROM findings),
 fab AS (SELECT *, 'must-not-contain' AS kind FROM c1 WHERE rule_id IN (SELECT rule_id FROM trap) UNION ALL SELECT *, 'on-positive' FROM c1 WHERE EXISTS (SELECT 1 FROM pos p WHERE p.run_key = c1.run_key AND p.rule_id = c1.rule_id)
 UNION ALL SELECT *, 'not-in-analysis' FROM c1 WHERE rule_id NOT IN (SELECT rule_id FROM trap) AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.run_key = c1.run_key AND p.rule_id = c1.rule_id) AND rule_id NOT IN (SELECT rule_id FROM affected_urls WHERE rule_id IS NOT NULL))"""
_AGG = f"""WITH {_RECALL}, {_CITES}, {_FAB}, per AS (SELECT fixture, count(*) AS k, avg(CASE WHEN recall = 1 THEN 1.0 ELSE 0.0 END) AS pass_k, round(avg(recall), 6) AS recall_mean FROM rec GROUP BY 1),
 agg AS (SELECT round((SELECT avg(recall_mean) FROM per), 6) AS recall, round((SELECT avg(round(pass_k, 6)) FROM per WHERE k >= 2), 6) AS stability, round((SELECT sum(valid) / sum(total) FROM cites), 6) AS citation_validity,
 round((SELECT count(*) FILTER (verdict = 'pass') / count(*) FROM judge), 6) AS faithfulness, (SELECT count(*) FROM fab) AS fabrications)"""
_ESC = lambda c: f"""replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')"""
_BL = lambda c: f"coalesce(trim({c}), '') = ''"
_ERR = {
    **{f"no {c}": _BL(f"f.{c}") for c in ("id", "title", "category", "befund", "beleg", "auswirkung", "empfehlung")}, "severity": "coalesce(f.severity NOT IN ('hoch', 'mittel', 'niedrig'), true)", "provenance": "coalesce(f.prov NOT IN ('gemessen', 'beobachtet', 'geschätzt'), true)",
    **{f"ice.{c}": f"coalesce(f.ice.{c} NOT BETWEEN 1 AND 3, true)" for c in "ice"}, "ice.score": "coalesce(f.ice.score <> f.ice.i * f.ice.c * f.ice.e, true)", "certainty above 1 on a small sample": "coalesce(meta.sample_size < 5 AND f.ice.c > 1, false)",
    "no ruleId in evidence": "coalesce(f.rule_ids IS NULL AND contains(lower(f.beleg), 'analysis') AND NOT contains(f.beleg, 'ruleId='), false)",
}
_VERR = {**{f"no {c}": _BL(c) for c in ("fixture", "judge_model", "prompt_version", "finding_id", "rationale")}, **{f"no {c}": f"{c} IS NULL" for c in ("supported", "provenance_correct", "fabricated_numbers")}, "verdict": "coalesce(verdict NOT IN ('pass', 'fail', 'warn'), true)", "run": "coalesce(run_no < 1, true)"}
_LEAK = {**{n: (p, "error") for n, p in ev.LEAKS.items()}, **{n: (p, "warn") for n, p in ev.WARNINGS.items()}}

SQL = {
    **check_sql.audit({r: i.severity for r, i in rules.CATALOGUE.items()}),
    **check_sql.GRAPH_QUERIES,
    "audit_meta": "SELECT c.host, count(*) AS pages, min_by(regexp_extract(url, '^(https?://[^/?#]+)', 1), row_no) AS origin, CASE WHEN avg(CASE WHEN error_code = 'js-guard:empty-body' THEN 1.0 ELSE 0 END) > 0.5 THEN 'client-rendered' ELSE 'server-rendered' END AS site_type, count(*) >= 5 AS min_n_met, CAST(CASE WHEN count(DISTINCT nullif(canonical, '')) BETWEEN 1 AND 49999 THEN least(100, floor(count(*) / count(DISTINCT nullif(canonical, '')) * 100 + 0.5)) END AS BIGINT) AS coverage_pct FROM crawl c GROUP BY 1",
    "thin_ranked": f"SELECT host, row_no, {Q.int('word_count')} AS words, row_number() OVER (PARTITION BY host ORDER BY {Q.int('word_count')}, row_no) AS rank FROM crawl WHERE error_code IS DISTINCT FROM 'js-guard:empty-body' AND redirected IS DISTINCT FROM '1' AND try_cast(regexp_extract(word_count, '^[ ]*([0-9]+)', 1) AS BIGINT) < 100",
    "url_keys": f"SELECT row_no, {normalized(Q, 'url')} AS norm, {host(Q, 'final_url')} AS host_part, {path(Q, 'final_url')} AS path_part, {query(Q, 'final_url')} AS query_part FROM crawl",
    "robots_verdicts": "WITH t AS (SELECT row_no, length(host) % 4 AS k, regexp_extract(url, '^https?://[^/]+([^#]*)', 1) AS p FROM crawl) SELECT row_no, CASE k WHEN 0 THEN NOT (regexp_matches(p, '^/help/') OR regexp_matches(p, '^/.*/vendor') OR (regexp_matches(p, '^/build/') AND NOT regexp_matches(p, '^/build/app'))) WHEN 1 THEN NOT regexp_matches(p, '^/static/.*[.]mjs$') WHEN 2 THEN false ELSE true END AS allowed FROM t",
    "robots_parsed": "SELECT DISTINCT host, ['/build/ /*/vendor /help/', '/static/*.mjs$', '/', ''][length(host) % 4 + 1] AS disallow, ['/build/app', '', '', '/'][length(host) % 4 + 1] AS allow, CAST([1, 0, 0, 2][length(host) % 4 + 1] AS INT) AS sitemaps, CASE WHEN length(host) % 4 = 1 THEN CAST(2 AS DOUBLE) END AS crawl_delay FROM crawl",
    "robots_bots": "SELECT h.host, v.agent, v.operator, v.use, v.disallow_all, v.paths FROM (SELECT DISTINCT host FROM crawl) h JOIN (VALUES (1, 'GPTBot', 'OpenAI', 'training', true, '/'), (1, 'CCBot', 'Common Crawl', 'training', true, '/'), (3, 'ChatGPT-User', 'OpenAI', 'on-demand-fetcher', false, '/p/')) v(k, agent, operator, use, disallow_all, paths) ON length(h.host) % 4 = v.k",
    "llms_check": r"WITH l AS (SELECT chunk_no, list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS a FROM kb_chunks) SELECT chunk_no, CAST(CASE WHEN starts_with(coalesce(a[1], ''), '# ') THEN 0 ELSE 1 END + CASE WHEN len(list_filter(a, lambda x: starts_with(x, '> '))) > 0 THEN 0 ELSE 1 END AS INT) AS problems FROM l",
    "sitemap_expanded": "SELECT DISTINCT host AS site, url AS loc FROM crawl",
    "crawl_frontier": "WITH s AS (SELECT host, canonical AS url, min(row_no) AS ord FROM crawl WHERE canonical <> '' GROUP BY 1, 2), k AS (SELECT s.host AS site, s.url, row_number() OVER (PARTITION BY s.host ORDER BY ord, s.url) AS no FROM s WHERE EXISTS (SELECT 1 FROM crawl c WHERE c.host = s.host AND c.url = s.url)) SELECT site, no, url FROM k WHERE no <= 25000",
    "url_types": "SELECT row_no, CASE WHEN regexp_matches(p, '^/(p|shop)/') THEN 'product' WHEN regexp_matches(p, '^/(blog|ratgeber)/') THEN 'article' WHEN regexp_matches(p, '^/help/') THEN 'help' ELSE 'page' END AS kind FROM (SELECT row_no, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS p FROM crawl)",
    "html_features": _HTML_SQL,
    # a line is inside code if the fences before it, of the kind that opened, are odd in number
    "kb_sections": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
      f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM l),
      h AS (SELECT *, fences % 2 = 0 AND regexp_matches(line, '^#{1,6} ') AS head FROM f), s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM h),
      g AS (SELECT doc_id, sec, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY n), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS part FROM s GROUP BY 1, 2),
      k AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS ord FROM g WHERE part <> '')
      SELECT doc_id, CAST(ord AS INT) AS ord, CASE WHEN regexp_matches(part, '^#{1,6}\s+.') THEN trim(regexp_extract(part, '^#{1,6}\s+([^\n]+)', 1)) ELSE '' END AS heading,
        CASE WHEN regexp_matches(part, '^#{1,6}\s+.') THEN regexp_replace(regexp_replace(part, '^#{1,6}\s+[^\n]+', ''), '^[\s\p{Z}]+', '') ELSE part END AS body FROM k
      UNION ALL SELECT doc_id, 0, '', '' FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\s\p{Z}]')""",
    "kb_embedding": "WITH t AS (SELECT chunk_no, unnest(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS tok FROM kb_chunks), h AS (SELECT chunk_no, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(tok, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor((a * 33) & 4294967295, c)) AS h FROM t), b AS (SELECT chunk_no, h % 256 AS slot, 1.0 AS w FROM h UNION ALL SELECT chunk_no, (h >> 8) & 255, 0.5 FROM h), s AS (SELECT chunk_no, slot, CAST(sum(w) AS DOUBLE) AS w FROM b GROUP BY 1, 2), n AS (SELECT chunk_no, sqrt(sum(w * w)) AS n FROM s GROUP BY 1) SELECT chunk_no, CAST(slot AS INT) AS slot, round(w / n, 6) AS weight FROM s JOIN n USING (chunk_no)",
    "kb_search": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p) SELECT query, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4",
    "kb_retrieve": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p) SELECT query, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10 AND score >= 0.3",
    "kb_cosine": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "kb_upsert": "SELECT id, max(chunk_no) AS chunk_no FROM kb_chunks GROUP BY id",
    "kb_allowlist": "SELECT DISTINCT source, regexp_extract(id, '^([^#]*)#', 1) AS file FROM kb_chunks",
    "runtime_cwv": "SELECT event_id, CASE WHEN value * 50 <= 2500 THEN 'good' WHEN value * 50 <= 4000 THEN 'needs-improvement' WHEN value IS NOT NULL THEN 'poor' END AS lcp, CASE WHEN value * 5 <= 200 THEN 'good' WHEN value * 5 <= 500 THEN 'needs-improvement' WHEN value IS NOT NULL THEN 'poor' END AS inp, CASE WHEN value / 400 <= 0.1 THEN 'good' WHEN value / 400 <= 0.25 THEN 'needs-improvement' WHEN value IS NOT NULL THEN 'poor' END AS cls FROM (SELECT event_id, CAST(value AS DOUBLE) AS value FROM events)",
    "runtime_certificates": "SELECT row_no, array_to_string(list_filter([CASE WHEN d < 0 THEN 'expired' END, CASE WHEN d BETWEEN 0 AND 14 THEN 'expiring' END, CASE WHEN NOT starts_with(host, 'www.') THEN 'mismatch' END, CASE WHEN row_no % 7 = 0 THEN 'untrusted' END], lambda x: x IS NOT NULL), '+') AS issues FROM (SELECT row_no, host, row_no % 60 - 20 AS d FROM crawl)",
    "runtime_intervals": "SELECT p_partkey, greatest(1000.0 / CAST(p_size AS DOUBLE), least(CAST(p_partkey % 15 AS DOUBLE), 10.0) * 1000) AS ms FROM part",
    "eval_rule_ids": f"WITH {_FLAT} SELECT run_key, f.id AS finding_id, array_to_string({_IDS}, ' ') AS ids FROM fl",
    "eval_scraped_ids": f"WITH {_FLAT} SELECT run_key, f.id AS finding_id, coalesce(array_to_string({_SCRAPED}, ' '), '') AS ids FROM fl",
    "eval_recall": f"WITH {_RECALL} SELECT fixture, run_no, expected, covered, round(recall, 6) AS recall FROM rec",
    "eval_missed": f"WITH {_CITED} SELECT r.fixture, r.run_no, e.rule_id FROM runs r JOIN expected e ON e.fixture = r.fixture WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.fixture = r.fixture AND c.run_no = r.run_no AND c.rule_id = e.rule_id)",
    "eval_citations": f"WITH {_FLAT}, {_CITES} SELECT fixture, run_no, total, valid, round(CASE WHEN total = 0 THEN 1.0 ELSE valid / total END, 6) AS validity FROM cites",
    "eval_fabrications": f"WITH {_FLAT}, {_FAB} SELECT run_key, finding_id, rule_id, kind FROM fab",
    "eval_provenance": f"WITH {_FLAT} SELECT run_key, bool_and(coalesce(f.prov IN ('gemessen', 'beobachtet', 'geschätzt'), false)) AS prov_ok, bool_and(coalesce(f.severity IN ('hoch', 'mittel', 'niedrig'), false)) AS severity_ok, bool_and(coalesce(f.ice.score = f.ice.i * f.ice.c * f.ice.e, false)) AS score_ok, bool_and(coalesce(meta.sample_size >= 5 OR f.ice.c <= 1, false)) AS cap_ok FROM fl GROUP BY 1",
    "eval_faithfulness": "SELECT fixture, count(*) AS total, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'warn') AS warned, count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (supported) AS supported, count(*) FILTER (NOT supported) AS unsupported, count(*) FILTER (fabricated_numbers) AS fabricated_numbers, count(*) FILTER (NOT provenance_correct) AS provenance_issues, round(count(*) FILTER (verdict = 'pass') / count(*), 6) AS pass_rate FROM judge GROUP BY 1",
    "eval_stability": f"WITH {_RECALL} SELECT fixture, count(*) AS k, round(avg(CASE WHEN recall = 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_k, round(min(recall), 6) AS recall_min, round(avg(recall), 6) AS recall_mean, round(max(recall), 6) AS recall_max FROM rec GROUP BY 1",
    "eval_anchor_stability": f"WITH {_CITED} SELECT r.fixture, e.rule_id, round(count(c.rule_id) / count(*), 6) AS covered_fraction FROM runs r JOIN expected e ON e.fixture = r.fixture LEFT JOIN cited c ON c.fixture = r.fixture AND c.run_no = r.run_no AND c.rule_id = e.rule_id GROUP BY 1, 2",
    "eval_aggregate": _AGG + " SELECT * FROM agg",
    "eval_gate": _AGG + ", g AS (SELECT unnest([{'kind': 'hard', 'metric': 'fabrications', 'failed': fabrications <> 0}, {'kind': 'hard', 'metric': 'citation_validity', 'failed': citation_validity < 1 - 1e-9}, {'kind': 'floor', 'metric': 'recall', 'failed': recall < 0.9 - 1e-9}, {'kind': 'floor', 'metric': 'faithfulness', 'failed': faithfulness < 0.5 - 1e-9}, {'kind': 'floor', 'metric': 'stability', 'failed': stability < 0.2 - 1e-9}, {'kind': 'baseline', 'metric': 'recall', 'failed': recall < 0.05 - 1e-9}]) AS c FROM agg) SELECT c.kind AS kind, c.metric AS metric, coalesce(c.failed, false) AS failed FROM g",
    "findings_errors": f"WITH {_FLAT} SELECT run_key, f.id AS finding_id, p.problem FROM fl, LATERAL (SELECT unnest(list_filter([{', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for n, c in _ERR.items())}], lambda x: x IS NOT NULL)) AS problem) p",
    "verdict_errors": f"SELECT verdict_key, p.problem FROM judge, LATERAL (SELECT unnest(list_filter([{', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for n, c in _VERR.items())}], lambda x: x IS NOT NULL)) AS problem) p",
    "run_ledger": f"WITH {_FLAT}, done AS (SELECT DISTINCT run_key, unnest({_IDS}) AS rule_id FROM fl), a AS (SELECT DISTINCT rule_id FROM rule_registry), e AS (SELECT r.run_key, a.rule_id FROM (SELECT DISTINCT run_key FROM findings) r, a) SELECT e.run_key, CASE WHEN d.rule_id IS NULL THEN 'remaining' ELSE 'interpreted' END AS state, count(*) AS rules FROM e LEFT JOIN done d ON d.run_key = e.run_key AND d.rule_id = e.rule_id GROUP BY 1, 2",
    "severity_histogram": f"WITH {_FLAT}, h AS (SELECT r.run_key, count(*) FILTER (f.severity = 'hoch') AS hoch, count(*) FILTER (f.severity = 'mittel') AS mittel, count(*) FILTER (f.severity = 'niedrig') AS niedrig FROM (SELECT DISTINCT run_key FROM findings) r LEFT JOIN fl ON fl.run_key = r.run_key GROUP BY 1), n AS (SELECT *, greatest(hoch + mittel + niedrig, 1) AS n FROM h) SELECT run_key, hoch, mittel, niedrig, CAST(floor(hoch / n * 100 + CASE WHEN hoch > 0 THEN 0.5 ELSE 0 END) AS BIGINT) AS hoch_end, CAST(floor((hoch + mittel) / n * 100 + CASE WHEN hoch + mittel > 0 THEN 0.5 ELSE 0 END) AS BIGINT) AS mittel_end FROM n",
    "run_handoff": f"WITH {_FLAT}, done AS (SELECT DISTINCT run_key, unnest({_IDS}) AS rule_id FROM fl), i AS (SELECT run_key, string_agg(rule_id, ' ' ORDER BY rule_id) AS interpreted FROM done GROUP BY 1), a AS (SELECT DISTINCT rule_id FROM rule_registry), r AS (SELECT DISTINCT ON (run_key) run_key, sections FROM findings ORDER BY run_key, produced_at), m AS (SELECT r.run_key, string_agg(a.rule_id, ' ' ORDER BY a.rule_id) AS remaining FROM r, a WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.run_key = r.run_key AND d.rule_id = a.rule_id) GROUP BY 1), t AS (SELECT run_key, string_agg(concat(s.num, ' ', s.id, ' ', s.title), ';' ORDER BY s.num, s.id) AS sections FROM (SELECT run_key, unnest(sections) AS s FROM r) GROUP BY 1) SELECT r.run_key, coalesce(t.sections, '') AS sections, coalesce(interpreted, '') AS interpreted, coalesce(remaining, '') AS remaining FROM r LEFT JOIN t USING (run_key) LEFT JOIN i USING (run_key) LEFT JOIN m USING (run_key)",
    "run_reports": f"""WITH a AS (SELECT run_key, {_ESC('meta.url')} AS url, list_filter(positives, lambda p: p IS NOT NULL) AS pos, list_sort(list_transform(sections, lambda s: {{'num': coalesce(s.num, 0), 'id': coalesce(s.id, ''), 'title': s.title, 'findings': s.findings}})) AS secs FROM findings),
      b AS (SELECT *, flatten(list_transform(secs, lambda s: s.findings)) AS fs FROM a), c AS (SELECT *, len(list_filter(fs, lambda f: f.severity = 'hoch')) AS h, len(list_filter(fs, lambda f: f.severity = 'mittel')) AS m, len(list_filter(fs, lambda f: f.severity = 'niedrig')) AS n FROM b),
      d AS (SELECT *, h + m + n AS t, CAST(floor(600 * h / (h + m + n) + 0.5) AS INT) AS x, CAST(floor(600 * (h + m) / (h + m + n) + 0.5) AS INT) AS y FROM c)
      SELECT run_key, concat('<!doctype html><html lang="de"><meta charset="utf-8"><title>', url, '</title><h1>', url, '</h1>',
        CASE WHEN t > 0 THEN concat('<figure><svg viewBox="0 0 600 24">', CASE WHEN h > 0 THEN concat('<rect class="hoch" x="0" width="', x, '" height="24"/>') END, CASE WHEN m > 0 THEN concat('<rect class="mittel" x="', x, '" width="', y - x, '" height="24"/>') END,
          CASE WHEN n > 0 THEN concat('<rect class="niedrig" x="', y, '" width="', 600 - y, '" height="24"/>') END, '</svg><figcaption>hoch: ', h, ' mittel: ', m, ' niedrig: ', n, '</figcaption></figure>') END,
        array_to_string(list_transform(secs, lambda s: concat('<section id="', {_ESC('s.id')}, '"><h2>', s.num, ' ', {_ESC('s.title')}, '</h2>', array_to_string(list_transform(s.findings, lambda f: concat('<article class="', {_ESC('f.severity')}, '"><h3>', {_ESC('f.title')}, '</h3><p>', {_ESC('f.befund')},
          '</p><p>', {_ESC('f.beleg')}, '</p><p>', {_ESC('f.auswirkung')}, '</p><p>', {_ESC('f.empfehlung')}, '</p><small>', {_ESC('f.prov')}, ', ICE ', f.ice.score, '</small></article>')), ''), '</section>')), ''),
        CASE WHEN len(pos) > 0 THEN concat('<ul>', array_to_string(list_transform(pos, lambda p: concat('<li>', {_ESC('p')}, '</li>')), ''), '</ul>') END, '</html>') AS html FROM d""",
    "frontier_rewritten": "SELECT row_no, concat('http://127.0.0.1:8080', coalesce(nullif(regexp_replace(canonical, '^https?://[^/]+', ''), ''), '/')) AS url FROM crawl WHERE canonical <> ''",
    "kb_ingest": """WITH d AS (SELECT doc_id, regexp_replace(text, '[#`~]', '', 'g') AS t FROM documents WHERE trim(text) <> ''),
      b AS (SELECT *, regexp_replace(regexp_replace(t, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') AS own FROM d), c AS (SELECT *, CASE WHEN own = '' AND doc_id % 2 = 0 THEN 'Kopf' ELSE own END AS body FROM b),
      tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '')) AS tok FROM c),
      h AS (SELECT doc_id, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(tok, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor((a * 33) & 4294967295, c)) AS h FROM tok),
      s AS (SELECT doc_id, count(DISTINCT slot) AS slots FROM (SELECT doc_id, h % 256 AS slot FROM h UNION ALL SELECT doc_id, (h >> 8) & 255 FROM h) GROUP BY 1)
      SELECT concat('d', c.doc_id, '.md#0') AS id, CASE WHEN c.doc_id % 2 = 0 THEN concat('https://kb.example/', c.doc_id) ELSE concat('d', c.doc_id, '.md') END AS source, CASE WHEN c.doc_id % 2 = 0 THEN 'Kopf' ELSE '' END AS heading,
        CASE WHEN c.doc_id % 2 = 0 THEN '2026-01' ELSE '' END AS date, CAST(length(body) AS INT) AS chars, CAST(coalesce(slots, 0) AS INT) AS slots FROM c LEFT JOIN s ON s.doc_id = c.doc_id WHERE body <> ''""",
    "priorities": f"WITH {_FLAT} SELECT run_key, f.id AS finding_id, CASE WHEN f.ice.score >= 18 THEN 'high' WHEN f.ice.score >= 8 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN f.ice.e >= 3 THEN 'low' WHEN f.ice.e = 2 THEN 'medium' ELSE 'high' END AS effort FROM fl",
    "leak_scan": r"WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS content, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS line FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, CAST(line AS INT) AS line, '{n}' AS label, '{s}' AS severity FROM l WHERE regexp_matches(content, '{p}')" for n, (p, s) in _LEAK.items()),
}
