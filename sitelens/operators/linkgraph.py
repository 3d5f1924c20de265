"""Internal link graph: edges, inlinks, click depth by breadth-first levels, orphans."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import stored


def inlinks(edges: DataFrame) -> DataFrame:
    """Distinct linking pages of each URL; a page's link to itself counts."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("inlinks"))


def site_roots(pages: DataFrame) -> DataFrame:
    """(site, url): where each site's crawl starts: the page at its root if there is one, else the first
    page crawled. ``pages``: site, row_no, url (as the graph knows it)."""
    at_root = F.when(F.col("url").rlike("^[a-z]+://[^/?#]+/?$"), 0).otherwise(1)
    return pages.groupBy("site").agg(F.min_by("url", F.struct(at_root, "row_no")).alias("url"))


def click_depth(edges: DataFrame, roots: DataFrame, crawled: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(url, depth): fewest clicks from a root. Links of pages that were not crawled are not followed.
    Runs until no new page is reached (pages seen before end every cycle), or to ``max_depth`` if given.

    One shuffle join per level; the frontier and the visited set are written to the shared
    folder each level, so the plan stays short and a lost executor costs one level.
    """
    links = edges.select("src", "dst").distinct()
    if crawled is not None:
        links = links.join(crawled.select(F.col("url").alias("src")).distinct(), "src", "left_semi")
    links = stored(links, "links")
    seen = stored(roots.select("url").distinct().withColumn("depth", F.lit(0)), "depth-0")
    frontier = seen
    for level in count(1) if max_depth is None else range(1, max_depth + 1):
        reached = frontier.join(links, frontier.url == links.src).select(F.col("dst").alias("url")).distinct()
        fresh = stored(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(level)), f"depth-{level}")
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
        if level % 32 == 0:  # a long chain would make the union long
            seen = stored(seen, "depths")
    return seen


def orphans(pages: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Crawled pages without any inlink that are no root; ``pages`` has a column ``url``."""
    linked = edges.select(F.col("dst").alias("url")).distinct()
    return pages.join(linked, "url", "left_anti").join(roots.select("url").distinct(), "url", "left_anti")
