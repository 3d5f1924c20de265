"""Site signals for the tables at hand.

The data has no robots.txt, llms.txt or runtime measurements, so the queries give each host
one of a few texts by the length of its name. The same choice is written in SQL in the checks,
with the parsed values spelled out there and not parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators import robots, runtime
from sitelens.operators.sites import page_facts

ROBOTS = [
    "User-agent: *\nDisallow: /build/\nDisallow: /*/vendor\nAllow: /build/app\nDisallow: /help/\nSitemap: https://x/sitemap.xml\n",
    "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /static/*.mjs$\nCrawl-delay: 2\n",
    "User-agent: *\nDisallow: /\nNoindex: /x\n",
    "User-agent: ChatGPT-User\nDisallow: /p/\n\nUser-agent: *\nAllow: /\nSitemap: https://x/a.xml\nSitemap: https://x/b.xml\n",
]
LLMS = ["# Title\n\n> Summary\n", "no title\n", None]


def signals(crawl: DataFrame) -> DataFrame:
    """One row of signals for each host."""
    hosts = crawl.select("host").distinct().withColumn("n", F.length("host"))
    raw = hosts.withColumn("robots_raw", F.element_at(F.array(*map(F.lit, ROBOTS)), (F.col("n") % 4 + 1).cast("int"))).withColumn("llms", F.element_at(F.array(*[F.lit(x) for x in LLMS]), (F.col("n") % 3 + 1).cast("int")))
    parsed = robots.parse_files(raw, "host", "robots_raw")
    patterns = robots.patterns_of(parsed, "host")
    root = robots.allowed(parsed.select(F.col("host").alias("site"), F.lit("/").alias("path")), patterns, []).select(F.col("site").alias("host"), F.col("allowed").alias("root_allowed"))
    lcp = (F.col("n") * 200).cast("double")
    measured = F.create_map(F.lit("lcp"), runtime.cwv_category("lcp", lcp), F.lit("cls"), runtime.cwv_category("cls", F.lit(0.05)))
    return (
        raw.join(parsed, "host")
        .join(root, "host")
        .withColumn("robots_exists", F.lit(True))
        .withColumn("llms_problems", F.when(F.col("llms").isNotNull(), robots.llms_problems("llms")))
        .withColumn("llms_known", F.col("n") % 10 != 0)
        .withColumn("largest_sitemap", F.when(F.col("n") % 5 != 0, F.col("n") * 3000))
        .withColumn("sitemap_urls", F.col("n") * 2400)
        .withColumn("http_reachable", F.col("n") % 2 == 0)
        .withColumn("http_redirects", F.col("n") % 3 == 0)
        .withColumn("cwv", F.when(F.col("n") % 4 != 0, measured))
        .withColumn("tls_issues", F.when(F.col("n") % 5 != 0, runtime.certificate_issues((F.col("n") - 20).cast("double"), F.lit(True), F.lit(True))))
        .withColumn("flagged", F.when(F.col("n") % 7 != 0, F.col("n") % 7 == 1))
    )


def facts(crawl: DataFrame) -> DataFrame:
    return page_facts(crawl).join(signals(crawl), "host")


def patterns(crawl: DataFrame) -> DataFrame:
    return robots.patterns_of(robots.parse_files(crawl.select("host").distinct().withColumn("raw", F.element_at(F.array(*map(F.lit, ROBOTS)), (F.length("host") % 4 + 1).cast("int"))), "host", "raw"), "host")
