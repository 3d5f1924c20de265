"""From crawl rows to an audit: hits of all page rules in one pass, findings, samples, clusters, site facts."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.exprs import Spark, path
from sitelens.functions.ranks import ranked
from sitelens.operators import relations
from sitelens.operators.rules import CATALOGUE, PAGE_RULES, Rule, hreflang_invalid
from sitelens.session import scratch_path, stored

_D = Spark()
SAMPLE, CLUSTERS, SMALL, SITEMAP_CAP, JOBS = 10, 5, 5, 50_000, 2


def page_hits(crawl: DataFrame, rule_ids: list[str] | None = None, catalogue: dict[str, Rule] | None = None) -> DataFrame:
    """(host, row_no, url, rule_id) of every page rule that fires: one scan, no shuffle. ``catalogue``: rules
    with parameters of their own, in place of the built-in ones."""
    known = catalogue or CATALOGUE
    fired = F.array(*[F.expr(f"CASE WHEN {PAGE_RULES[r](_D, known[r].params)} THEN '{r}' END") for r in rule_ids or PAGE_RULES if r in known])
    return crawl.select("host", "row_no", "url", F.explode(F.filter(fired, lambda r: r.isNotNull())).alias("rule_id"))


HREFLANG = "i18n:hreflang-invalid-code"


def iso_codes(spark: SparkSession) -> tuple[list[str], list[str]]:
    """ISO 639-1 languages and ISO 3166-1 regions, as the Java runtime lists them."""
    locale = spark._jvm.java.util.Locale
    renamed = {"iw": "he", "ji": "yi", "in": "id"}
    return [renamed.get(x, x) for x in locale.getISOLanguages() if len(x) == 2], list(locale.getISOCountries())


def hreflang_hits(crawl: DataFrame) -> DataFrame:
    """(host, row_no, url): pages with an hreflang value that is no valid code."""
    return crawl.where(F.expr(hreflang_invalid(*iso_codes(crawl.sparkSession))(_D, {}))).select("host", "row_no", "url")


def escape(text: str, given: dict) -> str:
    """Doubles the braces of regular expressions, which ``spark.sql`` would take for arguments."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in given:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return text


def relation_hits(crawl: DataFrame, more: dict[str, DataFrame | Callable[[], DataFrame]], catalogue: dict[str, Rule] | None = None) -> DataFrame:
    """(host, row_no, url, rule_id, ord) of every cross-page rule that ``more`` has the tables for (patterns,
    edges, roots, depths, sitemap; a table may also be a function that makes it meanwhile); the pages are prepared once for all of them, and each rule is a job of its
    own, ``JOBS`` at a time, so the driver never holds the plans of all and small jobs share the cores.

    ``ord`` is the place in the crawl, for sitemap addresses that in the sitemap. An address that
    is no page has the number of the first page that declares it.
    """
    spark = crawl.sparkSession
    ready = stored(spark.sql(escape(f"WITH {relations.pages(_D)} SELECT * FROM pages", {"crawl": crawl}), crawl=crawl), "pages")
    path = scratch_path(spark, "hits")
    known = catalogue or CATALOGUE
    texts = {r: relations.build(r, _D, patterns="robots_patterns AS (SELECT * FROM {patterns})", ready="{pages}", listed="sitemap" in more, params=known[r].params) for r in relations.RELATIONAL if r in known}
    texts = {r: t for r, t in texts.items() if not any("{" + k + "}" in t for k in ("patterns", "edges", "roots", "depths") if k not in more)}
    if not texts:
        return spark.createDataFrame([], HITS)

    def run(rule_id: str) -> str:
        text = texts[rule_id]
        given = {"pages": ready} | {k: late[k].result() if k in late else v for k, v in more.items() if "{" + k + "}" in text}
        hits = spark.sql(escape(text, given), **given)
        if rule_id == "hygiene:url-inconsistency":  # distinct addresses: each counts with its first live page in a site
            live = ready.where(F.expr(f"redirected <> '1' AND {_D.int('status')} BETWEEN 200 AND 299"))
            hits = live.join(hits, "url", "left_semi").groupBy(F.col("site").alias("host"), "url").agg(F.min("row_no").alias("row_no"))
        at = "ord" if "ord" in hits.columns else "row_no"
        out = hits.select("host", F.col("row_no" if "row_no" in hits.columns else at).alias("row_no"), "url", F.lit(rule_id).alias("rule_id"), F.col(at).alias("ord"))
        own = f"{path}/{rule_id.replace(':', '-')}"
        out.write.parquet(own)
        return own

    with ThreadPoolExecutor(JOBS + 1) as pool:
        late = {k: pool.submit(v) for k, v in more.items() if callable(v)}
        ordered = sorted(texts, key=lambda r: any("{" + k + "}" in texts[r] for k in late))  # what waits comes last
        return spark.read.schema(HITS).parquet(*pool.map(run, ordered))


HITS = "host string, row_no bigint, url string, rule_id string, ord bigint"


def all_hits(crawl: DataFrame, more: dict[str, DataFrame | Callable[[], DataFrame]], catalogue: dict[str, Rule] | None = None) -> DataFrame:
    """(host, row_no, url, rule_id, ord) of every rule that names pages: 64 in one scan, hreflang codes, 17 across pages."""
    codes = hreflang_hits(crawl).withColumn("rule_id", F.lit(HREFLANG))
    hits = page_hits(crawl, catalogue=catalogue).unionByName(codes).withColumn("ord", F.col("row_no")).unionByName(relation_hits(crawl, more, catalogue))
    return hits if catalogue is None else hits.where(F.col("rule_id").isin(list(catalogue)))


def rule_table(spark) -> DataFrame:
    """The catalogue as a table; its size is fixed by the code."""
    return spark.createDataFrame([(r.rule_id, r.category, r.severity, r.scope, {k: float(v) for k, v in r.params.items()}) for r in CATALOGUE.values()], "rule_id string, category string, severity string, scope string, params map<string,double>")


def findings(hits: DataFrame, crawl: DataFrame, site_status: DataFrame | None = None) -> DataFrame:
    """(host, rule_id, severity, category, hits, pct_of_pages, small_sample): one finding per site and
    rule that fires. Shares refer to all pages of the site and are left out for small sites and for
    rules about the whole site (``site_status``: host, rule_id, status, hits), which name no pages."""
    pages = crawl.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    per_rule = hits.groupBy("host", "rule_id").agg(F.count(F.lit(1)).alias("hits")).withColumn("of_pages", F.lit(True))
    if site_status is not None:
        whole = site_status.where("status = 'finding'").select("host", "rule_id", F.col("hits").cast("bigint").alias("hits"), F.lit(False).alias("of_pages"))
        per_rule = per_rule.unionByName(whole)
    rules = rule_table(hits.sparkSession).select("rule_id", "severity", "category")
    small = F.col("pages") < SMALL
    return (
        per_rule.join(pages, "host")
        .join(F.broadcast(rules), "rule_id")
        .select("host", "rule_id", "severity", "category", "hits", F.when(~small & F.col("of_pages"), F.round(F.col("hits") / F.col("pages") * 100, 1)).alias("pct_of_pages"), small.alias("small_sample"))
    )


def statuses(hits: DataFrame, crawl: DataFrame, rule_ids: list[str], site_status: DataFrame | None = None) -> DataFrame:
    """(host, rule_id, status): finding or positive for every site and evaluated rule; the rules
    of ``site_status`` can also be skipped."""
    wanted = crawl.select("host").distinct().withColumn("rule_id", F.explode(F.array(*map(F.lit, rule_ids))))
    fired = hits.select("host", "rule_id").distinct().withColumn("status", F.lit("finding"))
    out = wanted.join(fired, ["host", "rule_id"], "left").withColumn("status", F.coalesce("status", F.lit("positive")))
    return out if site_status is None else out.unionByName(site_status.select("host", "rule_id", "status"))


def samples(hits: DataFrame) -> DataFrame:
    """At most ten evenly spaced hits per site and rule, in crawl order or that of ``ord``: (host, rule_id, ord, url)."""
    r = ranked(hits, ["host", "rule_id"], "ord" if "ord" in hits.columns else "row_no")
    picks = F.when(F.col("total") <= SAMPLE, F.col("rank") < SAMPLE).otherwise(
        reduce(Column.__or__, [F.col("rank") == F.floor(F.lit(i) * (F.col("total") - 1) / (SAMPLE - 1) + 0.5) for i in range(SAMPLE)])
    )
    kept = r.where(picks)
    return kept.select("host", "rule_id", F.expr("row_number() over (partition by host, rule_id order by rank)").alias("ord"), "url")


def clusters(hits: DataFrame) -> DataFrame:
    """The five most frequent first path segments per site and rule: (host, rule_id, ord, pattern, n)."""
    first = F.expr(_D.grab(path(_D, "url"), "^/+([^/]+)"))
    pattern = F.when(F.expr(path(_D, "url")) == "", "(other)").when(first == "", "/").otherwise(F.concat(F.lit("/"), first, F.lit("/*")))
    counted = hits.groupBy("host", "rule_id", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("ord", F.expr("row_number() over (partition by host, rule_id order by n desc, pattern)")).where(F.col("ord") <= CLUSTERS)


def site_meta(crawl: DataFrame, sitemap_sizes: DataFrame | None = None) -> DataFrame:
    """(host, pages, origin, site_type, coverage_pct, min_n_met): facts about each crawled site.

    Coverage is pages fetched over sitemap entries, at most 100, or without a sitemap over the pages that
    links led to (``sitemap_sizes``: host, locs, and discovered if known); null without either or if
    the sitemap reached the cap (its true size is then unknown).
    """
    shell = F.avg(F.when(F.expr(_D.s("error_code")) == "js-guard:empty-body", 1).otherwise(0))
    meta = crawl.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min_by(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), "row_no").alias("origin"), shell.alias("shell"))
    meta = meta.select("host", "pages", "origin", F.when(F.col("shell") > 0.5, "client-rendered").otherwise("server-rendered").alias("site_type"), (F.col("pages") >= SMALL).alias("min_n_met"))
    if sitemap_sizes is None:
        return meta.withColumn("coverage_pct", F.lit(None).cast("bigint"))
    sizes = sitemap_sizes if "discovered" in sitemap_sizes.columns else sitemap_sizes.withColumn("discovered", F.lit(None).cast("bigint"))
    covered = lambda n: F.least(F.lit(100), F.floor(F.col("pages") / F.col(n) * 100 + 0.5))
    share = F.when(F.col("locs") >= SITEMAP_CAP, None).when(F.col("locs") > 0, covered("locs")).when(F.col("discovered") > 0, covered("discovered"))
    return meta.join(sizes, "host", "left").withColumn("coverage_pct", share.cast("bigint")).drop("locs", "discovered")
