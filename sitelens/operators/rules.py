"""The rule catalogue: what each rule is, and the predicate of every rule about single pages.

``PAGE_RULES`` are predicates over one row of the crawl table; they are evaluated together in
one pass (``plans.audit``). Rules that relate rows or look at a whole site are in
``relations`` and ``sites``. Missing cells count as ''.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from sitelens.functions.exprs import Spark, path, query


class Rule(NamedTuple):
    rule_id: str
    category: str
    severity: str
    scope: str = "agnostic"
    params: dict[str, float] = {}


Predicate = Callable[[Spark, dict], str]
CATALOGUE: dict[str, Rule] = {}
PAGE_RULES: dict[str, Predicate] = {}


def content(d: Spark) -> str:
    """A parsed page that is no redirect source and has a body."""
    return f"({d.s('error_code')} <> 'js-guard:empty-body' AND {d.s('word_count')} <> '' AND {d.s('redirected')} <> '1')"


def noindex(d: Spark, c: str) -> str:
    return d.re(f"lower({d.s(c)})", r"(^|[\s,])(noindex|none)([\s,]|$)")


def article(d: Spark) -> str:
    return d.re(d.s("ld_types"), r"(^|,)\s*(Article|NewsArticle|BlogPosting)\s*(,|$)")


def redirect_source(d: Spark, p: str = "") -> str:
    return f"({d.s(p + 'redirected')} = '1' OR {d.re(d.s(p + 'redirect_chain'), '[^|]')})"


def error_status(d: Spark, p: str = "") -> str:
    return f"(coalesce({d.int(p + 'status')}, 0) >= 400)"


def rule(rule_id: str, severity: str, scope: str = "agnostic", all_rows: bool = False, category: str = "", **params: float):
    """Registers a predicate over one page; most look at content pages only."""
    info = Rule(rule_id, category or {"crawl": "tech-index", "tech": "tech-index", "schema": "structured-data", "onpage": "on-page", "perf": "performance"}.get(rule_id.split(":")[0], rule_id.split(":")[0]), severity, scope, params)
    CATALOGUE[rule_id] = info

    def keep(f: Callable) -> Callable:
        PAGE_RULES[rule_id] = (lambda d, p: f"({f(d, p)})") if all_rows else (lambda d, p: f"({content(d)} AND ({f(d, p)}))")
        return f

    return keep


def declared(rule_id: str, category: str, severity: str, scope: str = "agnostic", **params: float) -> None:
    """Registers a rule whose evaluation is not a predicate over one page."""
    CATALOGUE[rule_id] = Rule(rule_id, category, severity, scope, params)


def is_one(c: str):
    return lambda d, p: f"{d.s(c)} = '1'"


def not_one(c: str):
    return lambda d, p: f"{d.s(c)} <> '1'"


def empty(c: str):
    return lambda d, p: f"{d.s(c)} = ''"


def blank(c: str):
    return lambda d, p: f"NOT {d.re(d.s(c), r'\S')}"


def above(c: str, limit: str):
    return lambda d, p: f"{d.int(c)} > {p[limit]}"


def at_least(c: str, limit: str):
    return lambda d, p: f"{d.num(c)} >= {p[limit]}"


# accessibility, AI visibility
rule("a11y:control-no-name", "mittel", minCount=1)(at_least("unlabeled_control_count", "minCount"))
rule("geo:missing-citations", "mittel", minCitationWords=80)(lambda d, p: f"{d.int('word_count')} >= {p['minCitationWords']} AND {d.int('outlinks_external')} = 0")
rule("geo:ai-snippet-suppressed", "hoch")(lambda d, p: d.re(f"lower({d.s('robots_meta')})", r"(^|[^a-z0-9_])(nosnippet($|[^a-z0-9_])|max-snippet\s*:\s*0($|[^0-9]))"))
rule("geo:noimageindex", "niedrig")(lambda d, p: d.re(f"lower({d.s('robots_meta')})", r"(^|[^a-z0-9_])noimageindex($|[^a-z0-9_])"))
rule("geo:content-stale", "niedrig")(lambda d, p: f"{article(d)} AND {blank('date_modified')(d, p)}")
rule("geo:poor-chunkability", "niedrig", minWords=900, maxHeadings=1)(lambda d, p: f"{d.int('word_count')} > {p['minWords']} AND {d.size(d.parts(d.s('heading_outline'), ','))} <= {p['maxHeadings']}")
# hygiene
rule("hygiene:oos-noindexed", "mittel", "ecommerce")(lambda d, p: f"{d.re(d.s('availability'), 'OutOfStock|SoldOut')} AND {noindex(d, 'robots_meta')}")
# languages
rule("i18n:hreflang-no-x-default", "info")(lambda d, p: f"{d.size(d.parts(d.s('hreflang'), ','))} > 0 AND NOT {d.any(d.parts(d.s('hreflang'), ','), "lower(p) = 'x-default'")}")
rule("i18n:hreflang-on-noindex", "niedrig")(lambda d, p: f"{d.int('hreflang_count')} >= 1 AND {noindex(d, 'robots_meta')}")
rule("i18n:hreflang-canonical-conflict", "mittel")(lambda d, p: f"{d.int('hreflang_count')} >= 1 AND {d.s('canonical')} <> '' AND {d.s('canon_self')} = '0'")
# links
rule("links:dead-end", "niedrig")(lambda d, p: f"{d.int('outlinks_internal')} = 0")
rule("links:generic-anchor", "mittel", minCount=1)(lambda d, p: f"coalesce({d.int('generic_anchor_count')}, 0) + coalesce({d.int('empty_link_count')}, 0) >= {p['minCount']}")
# on page
rule("onpage:title-missing", "hoch")(empty("title"))
rule("onpage:title-long", "mittel", maxTitle=60)(above("title_len", "maxTitle"))
rule("onpage:meta-missing", "niedrig")(is_one("meta_missing"))
rule("onpage:h1-missing", "hoch")(lambda d, p: f"{d.s('h1_count')} <> '' AND ({d.int('h1_count')} = 0 OR ({d.int('h1_count')} >= 1 AND {blank('h1')(d, p)}))")
rule("onpage:h1-multi", "niedrig")(lambda d, p: f"{d.int('h1_count')} > 1")
rule("onpage:alt-missing", "mittel")(lambda d, p: f"{d.int('img_no_alt')} > 0")
rule("onpage:thin", "niedrig", minWords=100)(lambda d, p: f"{d.int('word_count')} < {p['minWords']}")
rule("onpage:html-lang-missing", "mittel")(blank("html_lang"))
rule("onpage:meta-desc-length", "niedrig", min=70, max=160)(lambda d, p: f"{d.s('meta_missing')} <> '1' AND ({d.int('meta_desc_len')} < {p['min']} OR {d.int('meta_desc_len')} > {p['max']})")
rule("onpage:title-short", "niedrig", minTitle=30)(lambda d, p: f"{d.int('title_len')} >= 1 AND {d.int('title_len')} < {p['minTitle']}")
rule("onpage:viewport-zoom-disabled", "mittel", minScale=2)(
    lambda d, p: f"{d.re(f'lower({d.s("viewport_content")})', r'user-scalable\s*=\s*no($|[^a-z0-9_])')} OR coalesce(try_cast({d.grab(f'lower({d.s("viewport_content")})', r'maximum-scale\s*=\s*([0-9.]+)')} AS DOUBLE) < {p['minScale']}, false)"
)
rule("onpage:og-missing", "niedrig")(lambda d, p: " + ".join(f"CAST({d.s(c)} <> '' AS INT)" for c in ("og_title", "og_image", "og_url")) + " BETWEEN 1 AND 2")
rule("onpage:favicon-missing", "niedrig")(lambda d, p: f"{path(d, 'url')} = '/' AND {d.s('has_favicon')} <> '1'")
rule("onpage:img-missing-dimensions", "mittel", minCount=1)(at_least("img_no_dimensions", "minCount"))
rule("onpage:lcp-image-lazy", "mittel")(is_one("first_img_lazy"))
rule("onpage:excessive-dom", "niedrig", maxNodes=1400)(above("dom_node_count", "maxNodes"))
rule("onpage:render-blocking-head", "niedrig", maxStyles=4)(lambda d, p: f"{d.num('head_blocking_scripts')} >= 1 OR {d.num('head_blocking_styles')} >= {p['maxStyles']}")
rule("onpage:non-modern-image-format", "niedrig", category="performance")(lambda d, p: f"{d.int('img_jpg')} > 0 AND coalesce({d.int('img_webp')}, 0) = 0 AND coalesce({d.int('img_avif')}, 0) = 0")
rule("perf:text-compression-missing", "niedrig")(lambda d, p: f"NOT {d.re(f'lower({d.s("content_encoding")})', r'(^|[^a-z0-9_])(gzip|br|deflate|zstd)($|[^a-z0-9_])')}")
# structured data
rule("schema:invalid", "hoch")(lambda d, p: f"{d.s('ld_valid')} = '0'")
rule("schema:product-no-aggregate", "mittel", "ecommerce")(lambda d, p: f"{d.s('has_product')} = '1' AND {d.s('has_agg')} = '0'")
rule("schema:missing-dates", "niedrig")(lambda d, p: f"{article(d)} AND {d.s('date_published')} = ''")
rule("schema:org-missing-same-as", "mittel")(lambda d, p: f"{d.s('has_org')} = '1' AND {d.s('has_org_same_as')} <> '1'")
rule("schema:article-no-author", "niedrig")(lambda d, p: f"{article(d)} AND {d.s('has_author')} <> '1'")
rule("schema:offer-no-price", "mittel", "ecommerce")(lambda d, p: f"{d.s('has_product')} = '1' AND {blank('offer_price')(d, p)}")
rule("schema:date-inconsistent", "niedrig")(lambda d, p: f"coalesce({d.ts(d.s('date_modified'))} < {d.ts(d.s('date_published'))}, false)")
rule("schema:aggregaterating-incomplete", "niedrig")(lambda d, p: f"{d.s('has_agg')} = '1' AND ({d.s('agg_rating_value')} = '' OR {d.s('agg_rating_count')} = '')")
rule("schema:merchant-shipping-returns", "niedrig")(lambda d, p: f"{d.s('has_product')} = '1' AND ({d.s('has_shipping_details')} <> '1' OR {d.s('has_return_policy')} <> '1')")
rule("schema:organization-logo", "niedrig")(lambda d, p: f"{d.s('has_org')} = '1' AND {d.s('has_org_logo')} <> '1'")
rule("schema:organization-contact", "niedrig")(lambda d, p: f"{d.s('has_org')} = '1' AND {d.s('has_org_contact_point')} <> '1'")
rule("schema:microdata-only", "niedrig")(lambda d, p: f"({d.s('has_microdata')} = '1' OR {d.s('has_rdfa')} = '1') AND {d.s('ld_types')} = ''")
rule("schema:context-invalid", "mittel")(lambda d, p: f"{d.s('ld_context_ok')} = '0'")
# crawling and indexing
rule("crawl:client-rendered", "mittel", all_rows=True)(lambda d, p: f"{d.s('error_code')} = 'js-guard:empty-body'")
rule("tech:non-2xx", "hoch", all_rows=True)(lambda d, p: f"coalesce({d.int('status')} NOT BETWEEN 200 AND 299, false)")
rule("tech:redirect-chain", "mittel", all_rows=True, minChainLength=2)(lambda d, p: f"{d.size(d.parts(d.s('redirect_chain'), '|'))} >= {p['minChainLength']}")
rule("tech:canonical-missing", "mittel")(empty("canonical"))
rule("tech:canonical-nonself", "mittel", all_rows=True)(lambda d, p: f"{d.s('redirected')} <> '1' AND {d.s('canonical')} <> '' AND {d.s('canon_self')} = '0'")
rule("tech:https", "hoch", all_rows=True)(lambda d, p: f"{d.s('https_ok')} = '0' OR {d.s('mixed_content')} = '1'")
rule("tech:noindex-canonical-conflict", "mittel")(lambda d, p: f"{noindex(d, 'robots_meta')} AND {d.s('canonical')} <> ''")
rule("tech:viewport-missing", "mittel")(empty("viewport_content"))
rule("tech:charset-missing", "mittel")(not_one("charset_ok"))
rule("tech:canonical-multiple", "mittel")(lambda d, p: f"{d.int('canonical_count')} > 1")
rule("tech:x-robots-noindex", "mittel")(lambda d, p: noindex(d, "x_robots_tag"))
rule("tech:hsts-missing", "niedrig")(lambda d, p: f"{d.s('https_ok')} = '1' AND {d.s('hsts_present')} <> '1'")
rule("tech:frame-protection-missing", "niedrig")(not_one("frame_protection"))
rule("tech:nosniff-missing", "mittel")(not_one("nosniff_present"))
rule("tech:referrer-policy-missing", "niedrig")(not_one("referrer_policy_present"))
rule("tech:permissions-policy-missing", "niedrig")(not_one("permissions_policy_present"))
rule("tech:csp-missing", "mittel")(not_one("csp_present"))
rule("tech:cookie-insecure", "mittel")(is_one("cookie_insecure"))
rule("tech:version-disclosure", "niedrig")(is_one("version_disclosure"))


# Levels that jump: the outline is h1,h2,...; a pair of neighbours whose second is more than one deeper.
@rule("onpage:heading-skip", "niedrig")
def heading_skip(d: Spark, p: dict) -> str:
    outline = f"lower({d.sub(d.s('heading_outline'), r'\s')})"
    jumps = [f"h{a},h{b}" for a in range(1, 5) for b in range(a + 2, 7)]
    return d.re(outline, "(" + "|".join(jumps) + ")")


def hreflang_invalid(languages: list[str], regions: list[str]) -> Predicate:
    """Any hreflang value that is not language[-Script][-Region] of ISO codes or x-default."""

    def make(d: Spark, p: dict) -> str:
        ok = rf"^(x-default|({'|'.join(sorted(languages))})(-[a-z]{{4}})?(-({'|'.join(sorted(regions))}))?)$"
        return f"{content(d)} AND {d.any(d.parts(d.s('hreflang'), ','), 'NOT ' + d.re('lower(p)', ok.lower()))}"

    return make


def slash_or_hygiene(d: Spark, p: dict) -> str:
    """The part of URL hygiene that one URL shows: capitals, underscores, session ids, length."""
    own = path(d, "url")
    return (
        f"({d.re(d.sub(own, '%[0-9A-Fa-f][0-9A-Fa-f]'), '[A-Z]')} OR {d.re(own, '_')} OR {d.re('lower(url)', '[;?&](jsessionid|phpsessid|sessionid|sid)=')} "
        f"OR {d.utf16('url')} > {p['maxUrlLength']})"
    )


for _args in [
    ("crawl:orphan-page", "links", "niedrig"), ("hygiene:duplicate-content", "hygiene", "niedrig"), ("i18n:hreflang-invalid-code", "i18n", "mittel"),
    ("i18n:hreflang-not-reciprocal", "i18n", "mittel"), ("i18n:hreflang-target-broken", "i18n", "mittel"), ("i18n:html-lang-hreflang-mismatch", "i18n", "niedrig"),
    ("links:internal-broken", "links", "hoch"), ("links:internal-redirect", "links", "mittel"), ("onpage:title-dup", "on-page", "mittel"), ("onpage:meta-dup", "on-page", "niedrig"),
    ("tech:noindex-conflict", "tech-index", "hoch"), ("tech:sitemap-quality", "tech-index", "mittel"), ("tech:canonical-target-broken", "tech-index", "hoch"),
    ("tech:robots-sitemap-conflict", "tech-index", "mittel"), ("tech:robots-blocked-resources", "tech-index", "mittel"),
    ("geo:ai-bot-blocked", "geo", "hoch"), ("geo:llms-txt-malformed", "geo", "mittel"), ("geo:no-faq-howto", "geo", "info"), ("geo:ai-user-fetcher-blocked", "geo", "mittel"),
    ("perf:cwv-field-fail", "performance", "hoch"), ("schema:no-organization", "structured-data", "mittel"), ("tech:robots-site-blocked", "tech-index", "hoch"),
    ("tech:robots-noindex-directive", "tech-index", "mittel"), ("tech:robots-no-sitemap", "tech-index", "niedrig"), ("tech:http-not-redirected", "tech-index", "mittel"),
    ("tech:tls-cert-expiring", "tech-index", "hoch"), ("tech:safe-browsing-flagged", "tech-index", "hoch"), ("trust:contact-pages-missing", "trust", "mittel"),
]:
    declared(*_args)
declared("hygiene:url-inconsistency", "hygiene", "niedrig", maxUrlLength=115)
declared("links:deep", "links", "niedrig", maxDepth=4)
declared("schema:breadcrumb-missing", "structured-data", "niedrig", minDepth=2)
declared("tech:sitemap-scale-limit", "tech-index", "niedrig", maxLoc=50000)


def query_name(rule_id: str) -> str:
    return "rule_" + rule_id.replace(":", "_").replace("-", "_")


__all__ = ["CATALOGUE", "PAGE_RULES", "Rule", "content", "noindex", "query", "query_name"]
