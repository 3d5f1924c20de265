"""Rules about a whole site: aggregates over its pages and its signals (robots, llms.txt, http
probe, field data, certificate, safe browsing). Three states: fires, positive, skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.exprs import Spark, path
from sitelens.operators.rules import CATALOGUE, Rule

_D = Spark()
# Beginnings of path steps that tell of contact, about, imprint and privacy pages.
CONTACT = (
    r"/(kontakt|contact|reach-us|get-in-touch|hilfe|ueber-uns|ueber|uber-uns|uber|about|wer-wir-sind|unternehmen|firma"
    r"|impressum|imprint|legal-notice|legal|anbieterkennzeichnung|datenschutz|privacy|data-protection|dsgvo)"
)
# Bounds of good and needs-improvement for the 75th percentile.
CWV_BOUNDS = {"lcp": (2500.0, 4000.0), "inp": (200.0, 500.0), "cls": (0.10, 0.25)}


def plain_path(url: str):
    """The path as it is searched for names: decoded where it can be, lower case, umlauts as two letters;
    of something that is no address the whole."""
    own = path(_D, url)
    text = f"lower(CASE WHEN {own} = '' THEN coalesce({url}, '') ELSE coalesce(try_url_decode(replace({own}, '+', '%2B')), {own}) END)"
    return F.expr(f"replace(replace(replace({text}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')")


def page_facts(crawl: DataFrame, extra_urls: DataFrame | None = None) -> DataFrame:
    """One row per site with what its pages say together (partial aggregation, one shuffle)."""
    d = _D
    plain = plain_path("url")
    any_of = lambda e: F.max(F.coalesce(F.expr(e), F.lit(False)))
    facts = crawl.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        any_of(d.re(d.s("ld_types"), r"(^|,)\s*(FAQPage|HowTo)\s*(,|$)")).alias("faq"),
        any_of("has_org = '1'").alias("org"),
        any_of("has_microdata = '1' OR has_rdfa = '1'").alias("markup"),
        any_of("https_ok = '1'").alias("https"),
        F.max(plain.rlike(CONTACT)).alias("contact"),
    )
    if extra_urls is not None:  # pages that are only linked
        linked = extra_urls.groupBy("host").agg(F.max(plain_path("url").rlike(CONTACT)).alias("linked"))
        facts = facts.join(linked, "host", "left").withColumn("contact", F.col("contact") | F.coalesce("linked", F.lit(False))).drop("linked")
    return facts


#: rule id -> condition over page facts and signals; null: skipped for want of the signal
CONDITIONS = {
    "geo:ai-bot-blocked": "exists(bots, b -> b.disallow_all AND b.use <> 'on-demand-fetcher')",
    "geo:ai-user-fetcher-blocked": "exists(bots, b -> b.use = 'on-demand-fetcher' AND (b.disallow_all OR size(b.paths) > 0))",
    "geo:llms-txt-malformed": "coalesce(llms_known, false) AND (llms_problems IS NULL OR size(llms_problems) > 0)",  # looked for and not there, or not right
    "geo:no-faq-howto": "NOT faq",
    "schema:no-organization": "NOT org AND NOT markup",
    "trust:contact-pages-missing": "NOT contact",
    "tech:robots-site-blocked": "robots_exists AND NOT root_allowed",
    "tech:robots-noindex-directive": r"coalesce(robots_raw RLIKE r'(?im)^[ \t]*noindex[ \t]*:', false)",
    "tech:robots-no-sitemap": "robots_exists AND size(sitemaps) = 0",
    "tech:sitemap-scale-limit": "coalesce(largest_sitemap, sitemap_urls, 0) > {maxLoc}",
    "tech:http-not-redirected": "http_reachable AND NOT http_redirects AND https",
    "perf:cwv-field-fail": "CASE WHEN cwv IS NOT NULL THEN exists(map_values(cwv), c -> c <> 'good') END",
    "tech:tls-cert-expiring": "CASE WHEN tls_issues IS NOT NULL THEN size(tls_issues) > 0 END",
    "tech:safe-browsing-flagged": "flagged",
}
#: how many hits a site-level finding counts
COUNTS = {
    "geo:ai-bot-blocked": "size(filter(bots, b -> b.disallow_all AND b.use <> 'on-demand-fetcher'))",
    "geo:ai-user-fetcher-blocked": "size(filter(bots, b -> b.use = 'on-demand-fetcher' AND (b.disallow_all OR size(b.paths) > 0)))",
}


def evaluate(facts: DataFrame, rule_ids: list[str] | None = None, catalogue: dict[str, Rule] | None = None) -> DataFrame:
    """(host, rule_id, status, hits) for each site and site-level rule; one pass, no shuffle. ``catalogue``:
    rules with parameters of their own."""

    def condition(r: str) -> str:
        text = CONDITIONS[r]
        for name, value in (catalogue or CATALOGUE)[r].params.items():
            text = text.replace("{" + name + "}", str(value))
        return text

    rules = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule_id"),
                F.expr(f"CASE WHEN ({condition(r)}) IS NULL THEN 'skipped' WHEN {condition(r)} THEN 'finding' ELSE 'positive' END").alias("status"),
                F.expr(f"CASE WHEN coalesce({condition(r)}, false) THEN {COUNTS.get(r, '1')} ELSE 0 END").alias("hits"),
            )
            for r in rule_ids or CONDITIONS
        ]
    )
    return facts.select("host", F.explode(rules).alias("r")).select("host", "r.*")
