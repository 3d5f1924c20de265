"""One query per rule of the catalogue, with SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.exprs import Spark, normalized
from sitelens.operators import linkgraph, relations, rules, sites
from sitelens.plans import audit
from sitelens.queries import check_sql, signals
from sitelens.session import stored, table

SPARK = Spark()


def page_rule(rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        where = rules.PAGE_RULES[rule_id](SPARK, rules.CATALOGUE[rule_id].params)
        return table(spark, sf_dir, "crawl").where(F.expr(where)).select("host", "row_no", "url")

    return run


def hreflang_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an hreflang value that is no valid code."""
    return audit.hreflang_hits(table(spark, sf_dir, "crawl"))


def _given(text: str, makers: dict) -> dict:
    """The tables that a SQL text names, made on demand."""
    return {name: make() for name, make in makers.items() if "{" + name + "}" in text}


def relation_rule(rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        crawl = table(spark, sf_dir, "crawl")
        text = relations.build(rule_id, SPARK, patterns="robots_patterns AS (SELECT * FROM {patterns})")
        makers = {"crawl": lambda: crawl, "patterns": lambda: signals.patterns(crawl), "edges": lambda: graph(spark, sf_dir)[1], "roots": lambda: graph(spark, sf_dir)[2], "depths": lambda: depths(spark, sf_dir)}
        given = _given(text, makers)
        return spark.sql(audit.escape(text, given), **given)

    return run


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, row_no, url, rule_id, ord) of every rule that names pages."""
    crawl = table(spark, sf_dir, "crawl")
    _, edges, roots = graph(spark, sf_dir)
    more = {"patterns": stored(signals.patterns(crawl), "patterns"), "edges": stored(edges, "edges"), "roots": stored(roots, "roots"), "depths": lambda: depths(spark, sf_dir)}
    return audit.all_hits(crawl, more)


def site_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, rule_id, status, hits) of the 14 rules about a whole site."""
    return sites.evaluate(signals.facts(table(spark, sf_dir, "crawl")))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, edges, roots) of a link graph over the crawled pages: inside each site every page but each
    eleventh is linked from the page at a third of its place in the crawl."""
    crawl = table(spark, sf_dir, "crawl", "row_no", "host", "url").select("row_no", F.col("host").alias("site"), F.expr(normalized(SPARK, "url")).alias("url"))
    placed = audit.ranked(crawl, ["site"]).select("site", "url", "rank")
    linked = placed.where("rank % 11 <> 0").select("site", F.floor(F.col("rank") / 3).alias("p"), F.col("url").alias("dst"))
    edges = linked.join(placed.select("site", F.col("rank").alias("p"), F.col("url").alias("src")), ["site", "p"]).select("src", "dst").distinct()
    return crawl, edges, linkgraph.site_roots(crawl).select("url").distinct()


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, edges, roots = graph(spark, sf_dir)
    return linkgraph.click_depth(edges, roots, pages)


def site_rule(rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sites.evaluate(signals.facts(table(spark, sf_dir, "crawl")), [rule_id]).select("host", "status", "hits")

    return run


QUERIES, SQL = {}, {}
for _id in rules.CATALOGUE:
    _name = rules.query_name(_id)
    if _id in rules.PAGE_RULES:
        QUERIES[_name], SQL[_name] = page_rule(_id), check_sql.page_rule(_id)
    elif _id in relations.RELATIONAL:
        QUERIES[_name], SQL[_name] = relation_rule(_id), check_sql.relation(_id)
    elif _id in sites.CONDITIONS:
        QUERIES[_name], SQL[_name] = site_rule(_id), check_sql.site_rule(_id)
QUERIES["rule_i18n_hreflang_invalid_code"], SQL["rule_i18n_hreflang_invalid_code"] = hreflang_rule, check_sql.HREFLANG
