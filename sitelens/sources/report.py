"""HTML reports: of a site's findings, a small bounded table rendered on the driver; and of every audit run,
each from its own row, where it lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FINDINGS = 1000


def escape(text: object) -> str:
    """Markup characters as entities, the ampersand first."""
    out = str(text)
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = out.replace(c, e)
    return out


def escaped(column: str | Column) -> Column:
    """The same as a column expression; null is empty."""
    c = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    for a, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(e))
    return c


def render(findings: DataFrame, host: str) -> str:
    """The report of one site; refuses more findings than a catalogue of rules can give."""
    rows = findings.where(F.col("host") == host).orderBy(F.when(F.col("severity") == "hoch", 0).when(F.col("severity") == "mittel", 1).otherwise(2), F.desc("hits"), "rule_id").limit(MOST_FINDINGS + 1).collect()
    if len(rows) > MOST_FINDINGS:
        raise ValueError("more findings than rules: not a findings table")
    body = "".join(
        f"<tr><td>{escape(r.severity)}</td><td>{escape(r.rule_id)}</td><td>{r.hits}</td><td>{'' if r.pct_of_pages is None else escape(r.pct_of_pages) + ' %'}</td></tr>" for r in rows
    )
    return f"<!doctype html><html lang=en><meta charset=utf-8><title>{escape(host)}</title><h1>{escape(host)}</h1><table><tr><th>Severity<th>Rule<th>Pages<th>Share</tr>{body}</table></html>"


CHART_WIDTH, LEVELS = 600, ("hoch", "mittel", "niedrig")


def _chart(findings: Column) -> Column:
    """A bar of the severities: each segment ends at the rounded share of all up to it; none without findings."""
    has = lambda s: lambda f: f["severity"] == s
    count = {s: F.size(F.filter(findings, has(s))) for s in LEVELS}
    total = count["hoch"] + count["mittel"] + count["niedrig"]
    ends = [F.floor(F.lit(CHART_WIDTH) * sum((count[x] for x in LEVELS[: i + 1]), F.lit(0)) / total + 0.5).cast("string") for i in range(3)]
    starts = [F.lit("0"), *ends[:2]]
    bar = lambda i: F.when(count[LEVELS[i]] > 0, F.concat(F.lit(f'<rect class="{LEVELS[i]}" x="'), starts[i], F.lit('" width="'), (ends[i].cast("int") - starts[i].cast("int")).cast("string"), F.lit('" height="24"/>'))).otherwise(F.lit(""))
    caption = F.concat(*[x for s in LEVELS for x in (F.lit(f" {s}: "), count[s].cast("string"))])
    return F.when(total > 0, F.concat(F.lit(f'<figure><svg viewBox="0 0 {CHART_WIDTH} 24">'), *map(bar, range(3)), F.lit("</svg><figcaption>"), F.trim(caption), F.lit("</figcaption></figure>"))).otherwise(F.lit(""))


def _finding(f: Column) -> Column:
    texts = [x for c in ("befund", "beleg", "auswirkung", "empfehlung") for x in (F.lit("<p>"), escaped(f[c]), F.lit("</p>"))]
    return F.concat(F.lit('<article class="'), escaped(f["severity"]), F.lit('"><h3>'), escaped(f["title"]), F.lit("</h3>"), *texts, F.lit("<small>"), escaped(f["prov"]), F.lit(", ICE "), escaped(f["ice"]["score"]), F.lit("</small></article>"))


def run_reports(findings: DataFrame) -> DataFrame:
    """(run_key, html) of each audit run: chart, sections by number with their findings in order, positives."""
    sections = F.coalesce("sections", F.array().cast(findings.schema["sections"].dataType))
    ordered = F.array_sort(F.transform(F.filter(sections, lambda s: s.isNotNull()), lambda s: F.struct(F.coalesce(s["num"], F.lit(0)).alias("num"), F.coalesce(s["id"], F.lit("")).alias("id"), s.alias("s"))), _by_number)
    found = lambda s: F.filter(F.coalesce(s["findings"], F.array().cast(findings.schema["sections"].dataType.elementType["findings"].dataType)), lambda f: f.isNotNull())
    every = F.flatten(F.transform(F.filter(sections, lambda s: s.isNotNull()), found))
    section = lambda x: F.concat(F.lit('<section id="'), escaped(x["id"]), F.lit('"><h2>'), x["num"].cast("string"), F.lit(" "), escaped(x["s"]["title"]), F.lit("</h2>"), F.array_join(F.transform(found(x["s"]), _finding), ""), F.lit("</section>"))
    positives = F.transform(F.filter(F.coalesce("positives", F.array().cast("array<string>")), lambda p: p.isNotNull()), lambda p: F.concat(F.lit("<li>"), escaped(p), F.lit("</li>")))
    listed = F.when(F.size(positives) > 0, F.concat(F.lit("<ul>"), F.array_join(positives, ""), F.lit("</ul>"))).otherwise(F.lit(""))
    head = F.concat(F.lit('<!doctype html><html lang="de"><meta charset="utf-8"><title>'), escaped("meta.url"), F.lit("</title><h1>"), escaped("meta.url"), F.lit("</h1>"))
    return findings.select("run_key", F.concat(head, _chart(every), F.array_join(F.transform(ordered, section), ""), listed, F.lit("</html>")).alias("html"))


def _by_number(a: Column, b: Column) -> Column:
    less = (a["num"] < b["num"]) | ((a["num"] == b["num"]) & (a["id"] < b["id"]))
    same = (a["num"] == b["num"]) & (a["id"] == b["id"])
    return F.when(same, 0).when(less, -1).otherwise(1)
