"""robots.txt, llms.txt and sitemap files: parsing and path matching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Crawlers of AI services: agent, operator, the use that they announce.
AI_BOTS = [
    ("GPTBot", "OpenAI", "training"),
    ("ClaudeBot", "Anthropic", "training"),
    ("Google-Extended", "Google", "training"),
    ("CCBot", "Common Crawl", "training"),
    ("Applebot-Extended", "Apple", "training"),
    ("Meta-ExternalAgent", "Meta", "training"),
    ("Amazonbot", "Amazon", "training"),
    ("Bytespider", "ByteDance", "training"),
    ("OAI-SearchBot", "OpenAI", "ai-search"),
    ("Claude-SearchBot", "Anthropic", "ai-search"),
    ("PerplexityBot", "Perplexity", "ai-search"),
    ("Claude-User", "Anthropic", "on-demand-fetcher"),
    ("ChatGPT-User", "OpenAI", "on-demand-fetcher"),
    ("Perplexity-User", "Perplexity", "on-demand-fetcher"),
    ("meta-externalfetcher", "Meta", "on-demand-fetcher"),
    ("Googlebot", "Google", "indexing"),
    ("Bingbot", "Microsoft", "indexing"),
]
MAX_LOCS, MAX_CHILDREN = 50_000, 50


def pattern_regex(pattern: str | Column) -> Column:
    """A robots path pattern as a regular expression: ``*`` is anything, a final ``$`` the end."""
    c = F.col(pattern) if isinstance(pattern, str) else pattern
    escaped = F.regexp_replace(F.regexp_replace(c, r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\$(?!$)", r"\\\$"), r"^$", r"(?!)"))


def groups(text: str) -> tuple[list[tuple[list[str], list[tuple[str, str]]]], list[str], float | None]:
    """(user agents, (field, value) rules) of each group, sitemap addresses, crawl delay for everyone."""
    out: list[tuple[list[str], list[tuple[str, str]]]] = []
    sitemaps, delay, open_agents = [], None, False
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:  # a blank line, or one with a comment only, ends the group
            out.append(([], []))
            open_agents = False
            continue
        field, _, value = (x.strip() for x in line.partition(":"))
        field = field.lower()
        if field == "user-agent":
            if not open_agents or not out:
                out.append(([], []))
            out[-1][0].append(value.lower())
            open_agents = True
        elif field == "sitemap":
            if value:
                sitemaps.append(value)
        else:
            open_agents = False
            if field in ("allow", "disallow") and out and out[-1][0]:
                out[-1][1].append((field, value))
            elif field == "crawl-delay" and delay is None and out and "*" in out[-1][0] and (m := regex.match(r"\d*\.?\d+", value)) and float(m.group()) > 0:
                delay = float(m.group())
    return [g for g in out if g[0]], sitemaps, delay


def rules_for(parsed: list, agent: str) -> list[tuple[str, str]] | None:
    """The rules of the groups whose name is the longest prefix of the agent's, else of ``*``."""
    agent = agent.lower()
    names = [a for agents, _ in parsed for a in agents if a != "*" and agent.startswith(a)]
    name = max(names, key=len, default="*")
    own = [rules for agents, rules in parsed if name in agents]
    return [r for rules in own for r in rules] if own else None


def parse(text: str | None, agent: str = "*") -> dict:
    """The rules that hold for ``agent``, and what the file closes to AI crawlers that it names."""
    parsed, sitemaps, delay = groups(text or "")
    mine = rules_for(parsed, agent) or []
    bots = []
    for name, operator, use in AI_BOTS:
        closed = [v for agents, rules in parsed if name.lower() in agents for f, v in rules if f == "disallow" and v]
        if any(name.lower() in agents for agents, _ in parsed):
            bots.append({"agent": name, "operator": operator, "use": use, "disallow_all": "/" in closed, "paths": closed})
    return {"disallow": [v for f, v in mine if f == "disallow" and v], "allow": [v for f, v in mine if f == "allow" and v], "sitemaps": sitemaps, "crawl_delay": delay, "bots": bots}


PARSED = "disallow array<string>, allow array<string>, sitemaps array<string>, crawl_delay double, bots array<struct<agent string, operator string, use string, disallow_all boolean, paths array<string>>>"


def parse_files(df: DataFrame, site: str, text: str) -> DataFrame:
    """(``site``, parsed robots fields) for each site's robots.txt."""
    kind = df.select(site).schema[0].dataType.simpleString()

    texts = pa.list_(pa.string())
    bot = pa.struct([("agent", pa.string()), ("operator", pa.string()), ("use", pa.string()), ("disallow_all", pa.bool_()), ("paths", texts)])
    kinds = {"disallow": texts, "allow": texts, "sitemaps": texts, "crawl_delay": pa.float64(), "bots": pa.list_(bot)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[c] for x in parsed], t) for c, t in kinds.items())], names=[site, *kinds])

    return df.select(site, text).mapInArrow(run, f"{site} {kind}, {PARSED}")


def patterns_of(parsed: DataFrame, site: str) -> DataFrame:
    """(site, kind, pattern, re): the patterns that hold for every crawler."""
    both = [parsed.select(F.col(site).alias("site"), F.lit(k).alias("kind"), F.explode(k).alias("pattern")) for k in ("disallow", "allow")]
    return both[0].unionByName(both[1]).withColumn("re", pattern_regex("pattern"))


def allowed(targets: DataFrame, patterns: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Adds ``allowed``: the longest allow pattern that matches is at least as long as the longest
    disallow pattern. A site's patterns, few by nature, are one array and joined once by site; each target is
    judged in its own row. Targets of sites without any are allowed."""
    of_site = patterns.groupBy("site").agg(F.collect_list(F.struct("kind", F.length("pattern").alias("n"), "re")).alias("patterns"))
    hit = lambda kind: F.coalesce(F.array_max(F.transform(F.filter("patterns", lambda x: (x["kind"] == kind) & F.rlike(path, x["re"])), lambda x: x["n"])), F.lit(-1))
    return targets.join(of_site, "site", "left").select("site", *keys, path, (hit("disallow") <= hit("allow")).alias("allowed"))


def llms_problems(text: str | Column) -> Column:
    """What is wrong with an llms.txt: no title line first, no summary line."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(
        F.array(
            F.when(~F.coalesce(F.try_element_at(lines, F.lit(1)).startswith("# "), F.lit(False)), F.lit("first line is no title")),
            F.when(~F.exists(lines, lambda x: x.startswith("> ")), F.lit("no summary line")),
        ),
        lambda x: x.isNotNull(),
    )


def sitemap_locs(text: str | Column) -> Column:
    """The addresses of a sitemap file, at most ``MAX_LOCS`` (the format's own limit)."""
    return F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)<loc>\s*([^<]*?)\s*</loc>"), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))), 1, MAX_LOCS)


def expand_index(files: DataFrame) -> DataFrame:
    """(site, ord, loc): a site's sitemap with its index expanded by one level.

    ``files``: site, url, body, is_root. Children must lie on the same host, be no index
    themselves and not the root; at most ``MAX_CHILDREN`` are taken, in order.
    """
    index = r"(?i)<sitemapindex[\s>]"
    root = files.where("is_root")
    plain = root.where(~F.col("body").rlike(index)).select("site", F.lit(0).cast("bigint").alias("child"), F.posexplode(sitemap_locs("body")).alias("pos", "loc"))
    host = lambda c: F.lower(F.regexp_extract(c, r"^https?://([^/?#]+)", 1))
    kids = (
        root.where(F.col("body").rlike(index))
        .select("site", F.col("url").alias("root_url"), F.posexplode(F.array_distinct(sitemap_locs("body"))).alias("child", "url"))
        .where((host("url") == host("root_url")) & (F.col("url") != F.col("root_url")))
    )
    kids = kids.withColumn("rank", F.expr("row_number() over (partition by site order by child)")).where(F.col("rank") <= MAX_CHILDREN)
    bodies = files.where(~F.col("body").rlike(index)).select("site", "url", "body")
    listed = kids.join(bodies, ["site", "url"]).select("site", F.col("rank").cast("bigint").alias("child"), F.posexplode(sitemap_locs("body")).alias("pos", "loc"))
    first = plain.unionByName(listed).groupBy("site", "loc").agg(F.min(F.struct("child", "pos")).alias("at"))
    ranked = first.withColumn("ord", F.expr("row_number() over (partition by site order by at)"))
    return ranked.where(F.col("ord") <= MAX_LOCS).select("site", "ord", "loc")
