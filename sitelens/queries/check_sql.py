"""SQL of the rules for the independent check, written out by hand: nothing here is shared with
the library, so that a wrong bound or condition there shows as a difference.

``PAGES`` prepares the crawl table: every cell a string without null, ``c`` whether the row is a
content page, ``p`` the path of its address.
"""

from __future__ import annotations

PAGES = r"""t AS (SELECT row_no, host, url, coalesce(COLUMNS(* EXCLUDE (row_no, host, url, crawled_at, ingested_at)), '') FROM crawl),
p AS (SELECT *, error_code <> 'js-guard:empty-body' AND word_count <> '' AND redirected <> '1' AS c,
  CASE WHEN regexp_matches(url, '^\s*[Hh][Tt][Tt][Pp][Ss]?://[^/?#]') THEN coalesce(nullif(regexp_extract(url, '^\s*[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/') ELSE '' END AS path,
  len(list_filter(regexp_split_to_array(lower(robots_meta), '[\s,]+'), lambda x: x IN ('noindex', 'none'))) > 0 AS noindex,
  len(list_filter(list_transform(string_split(ld_types, ','), lambda x: trim(x)), lambda x: x IN ('Article', 'NewsArticle', 'BlogPosting'))) > 0 AS article,
  list_filter(list_transform(string_split(hreflang, ','), lambda x: trim(x)), lambda x: x <> '') AS langs FROM t)"""


def _int(c: str) -> str:
    return rf"try_cast(regexp_extract({c}, '^\s*([+-]?[0-9]+)', 1) AS BIGINT)"


def _number(c: str) -> str:
    return f"CASE WHEN trim({c}) = '' THEN 0 ELSE coalesce(try_cast({c} AS DOUBLE), -1) END"


_BLANK = r"NOT regexp_matches({}, '\S')"

#: rule -> condition over content pages
CONTENT = {
    "a11y:control-no-name": f"{_number('unlabeled_control_count')} >= 1",
    "geo:missing-citations": f"{_int('word_count')} >= 80 AND {_int('outlinks_external')} = 0",
    "geo:ai-snippet-suppressed": r"regexp_matches(robots_meta, '(?i)\bnosnippet\b') OR regexp_matches(robots_meta, '(?i)\bmax-snippet\s*:\s*0([^0-9]|$)')",
    "geo:noimageindex": r"regexp_matches(robots_meta, '(?i)\bnoimageindex\b')",
    "geo:content-stale": f"article AND {_BLANK.format('date_modified')}",
    "geo:poor-chunkability": f"{_int('word_count')} > 900 AND len(list_filter(string_split(heading_outline, ','), lambda x: trim(x) <> '')) <= 1",
    "hygiene:oos-noindexed": "(contains(availability, 'OutOfStock') OR contains(availability, 'SoldOut')) AND noindex",
    "i18n:hreflang-no-x-default": "len(langs) > 0 AND NOT list_contains(list_transform(langs, lambda x: lower(x)), 'x-default')",
    "i18n:hreflang-on-noindex": f"{_int('hreflang_count')} >= 1 AND noindex",
    "i18n:hreflang-canonical-conflict": f"{_int('hreflang_count')} >= 1 AND canonical <> '' AND canon_self = '0'",
    "links:dead-end": f"{_int('outlinks_internal')} = 0",
    "links:generic-anchor": f"coalesce({_int('generic_anchor_count')}, 0) + coalesce({_int('empty_link_count')}, 0) >= 1",
    "onpage:title-missing": "title = ''",
    "onpage:title-long": f"{_int('title_len')} > 60",
    "onpage:meta-missing": "meta_missing = '1'",
    "onpage:h1-missing": f"h1_count <> '' AND ({_int('h1_count')} = 0 OR {_int('h1_count')} >= 1 AND {_BLANK.format('h1')})",
    "onpage:h1-multi": f"{_int('h1_count')} > 1",
    "onpage:alt-missing": f"{_int('img_no_alt')} > 0",
    "onpage:thin": f"{_int('word_count')} < 100",
    "onpage:html-lang-missing": _BLANK.format("html_lang"),
    "onpage:meta-desc-length": f"meta_missing <> '1' AND {_int('meta_desc_len')} NOT BETWEEN 70 AND 160",
    "onpage:title-short": f"{_int('title_len')} BETWEEN 1 AND 29",
    "onpage:viewport-zoom-disabled": r"regexp_matches(viewport_content, '(?i)user-scalable\s*=\s*no\b') OR coalesce(try_cast(regexp_extract(viewport_content, '(?i)maximum-scale\s*=\s*([0-9.]+)', 1) AS DOUBLE) < 2, false)",
    "onpage:og-missing": "len(list_filter([og_title, og_image, og_url], lambda x: x <> '')) IN (1, 2)",
    "onpage:favicon-missing": "path = '/' AND has_favicon <> '1'",
    "onpage:img-missing-dimensions": f"{_number('img_no_dimensions')} >= 1",
    "onpage:lcp-image-lazy": "first_img_lazy = '1'",
    "onpage:excessive-dom": f"{_int('dom_node_count')} > 1400",
    "onpage:render-blocking-head": f"{_number('head_blocking_scripts')} >= 1 OR {_number('head_blocking_styles')} >= 4",
    "onpage:non-modern-image-format": f"{_int('img_jpg')} > 0 AND coalesce({_int('img_webp')}, 0) = 0 AND coalesce({_int('img_avif')}, 0) = 0",
    "perf:text-compression-missing": r"NOT regexp_matches(content_encoding, '(?i)\b(gzip|br|deflate|zstd)\b')",
    "schema:invalid": "ld_valid = '0'",
    "schema:product-no-aggregate": "has_product = '1' AND has_agg = '0'",
    "schema:missing-dates": "article AND date_published = ''",
    "schema:org-missing-same-as": "has_org = '1' AND has_org_same_as <> '1'",
    "schema:article-no-author": "article AND has_author <> '1'",
    "schema:offer-no-price": f"has_product = '1' AND {_BLANK.format('offer_price')}",
    "schema:aggregaterating-incomplete": "has_agg = '1' AND (agg_rating_value = '' OR agg_rating_count = '')",
    "schema:merchant-shipping-returns": "has_product = '1' AND (has_shipping_details <> '1' OR has_return_policy <> '1')",
    "schema:organization-logo": "has_org = '1' AND has_org_logo <> '1'",
    "schema:organization-contact": "has_org = '1' AND has_org_contact_point <> '1'",
    "schema:microdata-only": "(has_microdata = '1' OR has_rdfa = '1') AND ld_types = ''",
    "schema:context-invalid": "ld_context_ok = '0'",
    "tech:canonical-missing": "canonical = ''",
    "tech:noindex-canonical-conflict": "noindex AND canonical <> ''",
    "tech:viewport-missing": "viewport_content = ''",
    "tech:charset-missing": "charset_ok <> '1'",
    "tech:canonical-multiple": f"{_int('canonical_count')} > 1",
    "tech:x-robots-noindex": r"len(list_filter(regexp_split_to_array(lower(x_robots_tag), '[\s,]+'), lambda x: x IN ('noindex', 'none'))) > 0",
    "tech:hsts-missing": "https_ok = '1' AND hsts_present <> '1'",
    "tech:frame-protection-missing": "frame_protection <> '1'",
    "tech:nosniff-missing": "nosniff_present <> '1'",
    "tech:referrer-policy-missing": "referrer_policy_present <> '1'",
    "tech:permissions-policy-missing": "permissions_policy_present <> '1'",
    "tech:csp-missing": "csp_present <> '1'",
    "tech:cookie-insecure": "cookie_insecure = '1'",
    "tech:version-disclosure": "version_disclosure = '1'",
    # each level of the outline against the one before it
    "onpage:heading-skip": """len(list_filter(list_zip(list_transform(regexp_extract_all(lower(heading_outline), 'h[1-6]'), lambda h: CAST(substr(h, 2) AS INT)),
        list_transform(regexp_extract_all(lower(heading_outline), 'h[1-6]'), lambda h: CAST(substr(h, 2) AS INT))[2:]), lambda z: z[2] > z[1] + 1)) > 0""",
}
# the date styles of the table: ISO dates and times; anything else is no date
_DATE = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9:.]+Z?)?$') THEN try_cast(rtrim({0}, 'Z') AS TIMESTAMP) END"
CONTENT["schema:date-inconsistent"] = f"coalesce({_DATE.format('date_modified')} < {_DATE.format('date_published')}, false)"

#: rule -> condition over all rows
ALL_ROWS = {
    "crawl:client-rendered": "error_code = 'js-guard:empty-body'",
    "tech:non-2xx": f"{_int('status')} NOT BETWEEN 200 AND 299",
    "tech:redirect-chain": "len(list_filter(string_split(redirect_chain, '|'), lambda x: x <> '')) >= 2",
    "tech:canonical-nonself": "redirected <> '1' AND canonical <> '' AND canon_self = '0'",
    "tech:https": "https_ok = '0' OR mixed_content = '1'",
}


def page_rule(rule_id: str) -> str:
    where = f"c AND ({CONTENT[rule_id]})" if rule_id in CONTENT else ALL_ROWS[rule_id]
    return f"WITH {PAGES} SELECT host, row_no, url FROM p WHERE {where}"


# Rules about several pages ----------------------------------------------------------------

#: pages with the host and path of their address and its form in the link graph; ``n`` the place inside the site
KEYED = PAGES + r""",
h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)$', '') AS uhost, lower(regexp_extract(url, '^\s*([A-Za-z]+)://', 1)) AS scheme,
  regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query, regexp_replace(path, '/index\.html$', '/') AS short FROM p),
k AS (SELECT *, CASE WHEN path = '' THEN url ELSE concat(scheme, '://', uhost, CASE WHEN short = '/' THEN short ELSE regexp_replace(short, '/$', '') END, query) END AS norm,
  row_number() OVER (PARTITION BY host ORDER BY row_no) - 1 AS n FROM h)"""
_TARGET = "CASE WHEN regexp_matches({0}, '^(?i)https?://') THEN trim({0}) WHEN starts_with({0}, '//') THEN concat(scheme, ':', {0}) WHEN starts_with({0}, '/') THEN concat(scheme, '://', uhost, {0}) END"
_PATH_OF = r"CASE WHEN regexp_matches({0}, '^(?i)https?://[^/?#]') THEN coalesce(nullif(regexp_extract({0}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/') ELSE '' END"
_HOST_OF = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#]*)', 1)), ':(80|443)$', '')"
#: each page but every eleventh of a site is linked from the page at a third of its place
GRAPH = """edges AS (SELECT DISTINCT a.norm AS src, b.norm AS dst FROM k b JOIN k a ON a.host = b.host AND a.n = b.n // 3 WHERE b.n % 11 <> 0),
roots AS (SELECT DISTINCT arg_min(norm, (CASE WHEN regexp_matches(norm, '^[a-z]+://[^/?#]+/?$') THEN 0 ELSE 1 END) * 1000000000000 + row_no) AS norm FROM k GROUP BY host)"""
DEPTH = """depth(url, d) USING KEY (url) AS (SELECT norm, 0 FROM roots UNION SELECT e.dst, min(depth.d) + 1 FROM depth JOIN edges e ON e.src = depth.url WHERE e.dst NOT IN (SELECT url FROM recurring.depth) GROUP BY e.dst)"""
_SITEMAP = f"loc AS (SELECT host, loc, min(row_no) AS ord, {_PATH_OF.format('loc')} AS lpath FROM (SELECT host, row_no, {_TARGET.format('canonical')} AS loc FROM k WHERE canonical <> '') WHERE loc IS NOT NULL GROUP BY host, loc)"
_SITE_HOSTS = f"""own AS (SELECT DISTINCT host, uhost AS known FROM k WHERE uhost <> '' UNION
  SELECT DISTINCT host, {_HOST_OF.format('x')} FROM (SELECT host, path, {_TARGET.format('canonical')} AS x FROM k WHERE canonical <> '') WHERE path <> '' AND {_PATH_OF.format('x')} = path)"""
_ERROR, _LIVE = f"coalesce({_int('status')} >= 400, false)", f"{_int('status')} BETWEEN 200 AND 299"
_MOVED = "(redirected = '1' OR len(list_filter(string_split(redirect_chain, '|'), lambda x: x <> '')) > 0)"
_FIRST_AT = f"f AS (SELECT host AS fh, path AS fp, url AS furl, noindex AS fnoindex, {_ERROR} AS failed, {_MOVED} AS moved FROM k WHERE path <> '' QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY row_no) = 1)"
_FIRST_NORM = f"f AS (SELECT norm AS fn, {_ERROR} AS failed, {_MOVED} AS moved FROM k QUALIFY row_number() OVER (PARTITION BY norm ORDER BY row_no) = 1)"
_PAIRS = f"""a AS (SELECT row_no, host, url, norm, path, scheme, uhost, html_lang, lower(trim(split_part(pair, '=', 1))) AS lang, substr(pair, strpos(pair, '=') + 1) AS href
  FROM (SELECT *, unnest(list_filter(list_transform(string_split(hreflang_links, '|'), lambda x: trim(x)), lambda x: x <> '')) AS pair FROM k WHERE c AND hreflang_links <> '')),
hrefs AS (SELECT *, {_TARGET.format('href')} AS target FROM a)"""
_NORM_OF = r"CASE WHEN {p} = '' THEN {u} ELSE concat(lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)), '://', {h}, CASE WHEN regexp_replace({p}, '/index\.html$', '/') = '/' THEN '/' ELSE regexp_replace(regexp_replace({p}, '/index\.html$', '/'), '/$', '') END, regexp_extract({u}, '^[^?#]*(\?[^#]*)', 1)) END".replace(
    "{p}", f"({_PATH_OF})").replace("{h}", _HOST_OF).replace("{u}", "{0}")
#: the patterns of the four robots.txt texts, by the length of the host's name, with expressions written by hand
ROBOTS = r"""robots(k, kind, pattern, re) AS (VALUES
    (0, 'disallow', '/build/', '^/build/'), (0, 'disallow', '/*/vendor', '^/.*/vendor'), (0, 'allow', '/build/app', '^/build/app'), (0, 'disallow', '/help/', '^/help/'),
    (1, 'disallow', '/static/*.mjs$', '^/static/.*[.]mjs$'), (2, 'disallow', '/', '^/'), (3, 'allow', '/', '^/'))"""
_LONGEST = "coalesce(max(CASE WHEN kind = '{}' AND regexp_matches(x, re) THEN length(pattern) END), -1)"

RELATIONS = {
    "onpage:title-dup": "SELECT host, row_no, url FROM k WHERE c AND title <> '' QUALIFY count(*) OVER (PARTITION BY host, title) > 1",
    "onpage:meta-dup": "SELECT host, row_no, url FROM k WHERE c AND meta_missing <> '1' AND meta_desc <> '' QUALIFY count(*) OVER (PARTITION BY host, meta_desc) > 1",
    "hygiene:duplicate-content": "SELECT host, row_no, url FROM k WHERE c AND title <> '' AND meta_missing <> '1' AND meta_desc <> '' QUALIFY count(*) OVER (PARTITION BY host, title, meta_desc) > 1",
    "hygiene:url-inconsistency": rf""", live AS (SELECT *, regexp_replace(uhost, '^www\.', '') AS base, rtrim(path, '/') AS stem FROM k WHERE redirected <> '1' AND {_LIVE} AND path <> ''),
      form AS (SELECT * FROM live WHERE path <> '/' QUALIFY row_number() OVER (PARTITION BY uhost, path ORDER BY row_no DESC) = 1)
      SELECT url FROM live QUALIFY min(uhost) OVER (PARTITION BY base) <> max(uhost) OVER (PARTITION BY base)
      UNION SELECT url FROM form QUALIFY count(*) OVER (PARTITION BY uhost, stem) > 1
      UNION SELECT url FROM live WHERE regexp_matches(regexp_replace(path, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g'), '[A-Z]') OR contains(path, '_') OR regexp_matches(url, '(?i)[;?&](jsessionid|phpsessid|sessionid|sid)=')
        OR length(url) + length(regexp_replace(url, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) > 115""",
    "crawl:orphan-page": f", {GRAPH} SELECT host, row_no, url FROM k WHERE c AND {_int('status')} < 400 AND norm NOT IN (SELECT dst FROM edges) AND norm NOT IN (SELECT norm FROM roots)",
    "links:deep": f", {GRAPH}, {DEPTH} SELECT k.host, row_no, k.url FROM k JOIN depth ON depth.url = norm WHERE d > 4",
    "schema:breadcrumb-missing": f", {GRAPH}, {DEPTH} SELECT k.host, row_no, k.url FROM k JOIN depth ON depth.url = norm WHERE c AND d >= 2 AND has_breadcrumb <> '1' AND has_microdata <> '1' AND has_rdfa <> '1'",
    "links:internal-broken": f", {GRAPH}, {_FIRST_NORM} SELECT host, row_no, url FROM k WHERE c AND EXISTS (SELECT 1 FROM edges JOIN f ON fn = dst WHERE src = norm AND failed)",
    "links:internal-redirect": f", {GRAPH}, {_FIRST_NORM} SELECT host, row_no, url FROM k WHERE c AND EXISTS (SELECT 1 FROM edges JOIN f ON fn = dst WHERE src = norm AND moved)",
    "tech:noindex-conflict": f", {_SITEMAP} SELECT host, row_no, url FROM k WHERE noindex AND path <> '' AND EXISTS (SELECT 1 FROM loc WHERE loc.host = k.host AND lpath = path)",
    "tech:sitemap-quality": f""", {_SITEMAP}, last AS (SELECT * FROM k WHERE path <> '' QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY row_no DESC) = 1)
      SELECT last.host, row_no, url, ord FROM last JOIN loc ON loc.host = last.host AND lpath = path WHERE noindex OR redirected = '1' OR NOT {_LIVE}""",
    "tech:canonical-target-broken": f""", {_SITE_HOSTS}, {_FIRST_AT}, x AS (SELECT host, row_no, url, {_TARGET.format('canonical')} AS target FROM k WHERE c AND canonical <> '')
      SELECT host, row_no, url FROM x JOIN f ON fh = host AND fp = {_PATH_OF.format('target')} WHERE (host, {_HOST_OF.format('target')}) IN (SELECT (host, known) FROM own) AND (failed OR moved OR fnoindex AND furl <> url)""",
    "i18n:hreflang-target-broken": f""", {_PAIRS}, {_SITE_HOSTS}, {_FIRST_AT}
      SELECT DISTINCT host, row_no, url FROM hrefs JOIN f ON fh = host AND fp = {_PATH_OF.format('target')} WHERE href <> '' AND (host, {_HOST_OF.format('target')}) IN (SELECT (host, known) FROM own) AND (failed OR moved)""",
    "i18n:hreflang-not-reciprocal": f""", {_PAIRS}, says AS (SELECT DISTINCT host, norm, {_NORM_OF.format('href')} AS other FROM hrefs WHERE href <> ''), pages AS (SELECT DISTINCT host, norm FROM k WHERE c)
      SELECT DISTINCT host, row_no, url FROM hrefs WHERE NOT regexp_matches(href, '^(?i)https?://') OR (host, norm, norm) NOT IN (SELECT (host, norm, other) FROM says)
        OR EXISTS (SELECT 1 FROM says WHERE says.host = hrefs.host AND says.norm = hrefs.norm AND other <> says.norm AND (says.host, other) IN (SELECT (host, norm) FROM pages) AND (says.host, other, says.norm) NOT IN (SELECT (host, norm, other) FROM says))""",
    "i18n:html-lang-hreflang-mismatch": f""", {_PAIRS} SELECT DISTINCT host, row_no, url FROM hrefs
      WHERE target = url AND trim(html_lang) <> '' AND lang NOT IN ('', 'x-default') AND split_part(lang, '-', 1) <> split_part(lower(trim(html_lang)), '-', 1)""",
    "tech:robots-sitemap-conflict": rf""", {_SITEMAP}, {ROBOTS}, v AS (SELECT loc.host, loc, ord, {_LONGEST.format('disallow')} AS dis, {_LONGEST.format('allow')} AS alw
      FROM (SELECT *, concat(lpath, regexp_extract(loc, '^[^?#]*(\?[^#]*)', 1)) AS x FROM loc WHERE lpath <> '') loc JOIN robots ON length(host) % 4 = k GROUP BY ALL) SELECT host, loc AS url, ord FROM v WHERE dis > alw""",
    "tech:robots-blocked-resources": f""", {ROBOTS}, q AS (SELECT host, row_no, url, trim(unnest(string_split(resource_paths, '|'))) AS x FROM k WHERE c AND resource_paths <> ''),
      v AS (SELECT host, row_no, url, x, {_LONGEST.format('disallow')} AS dis, {_LONGEST.format('allow')} AS alw FROM q JOIN robots ON length(host) % 4 = k WHERE x <> '' GROUP BY ALL) SELECT DISTINCT host, row_no, url FROM v WHERE dis > alw""",
}
RECURSIVE = ("links:deep", "schema:breadcrumb-missing")


def relation(rule_id: str) -> str:
    return f"WITH {'RECURSIVE ' if rule_id in RECURSIVE else ''}{KEYED} {RELATIONS[rule_id]}"


#: the language and region codes of the table, as the check knows them; the library takes the full ISO lists
HREFLANG = f"""WITH {PAGES} SELECT host, row_no, url FROM p WHERE c AND len(list_filter(langs, lambda x: NOT regexp_matches(lower(x),
  '^(x-default|(de|en|es|fr|it|pt|zh|ja|ru|el|fa)(-[a-z][a-z][a-z][a-z])?(-(at|br|ca|ch|de|gb|mx|tw|us))?)$'))) > 0"""

# Rules about whole sites: the signals of a host follow from the length n of its name ---------

_CONTACT = "/(kontakt|contact|reach-us|get-in-touch|hilfe|ueber-uns|ueber|uber-uns|uber|about|wer-wir-sind|unternehmen|firma|impressum|imprint|legal-notice|legal|anbieterkennzeichnung|datenschutz|privacy|data-protection|dsgvo)"
_FACTS = rf"""WITH {PAGES}, s AS (SELECT host, length(host) AS n, bool_or(len(list_filter(list_transform(string_split(ld_types, ','), lambda x: trim(x)), lambda x: x IN ('FAQPage', 'HowTo'))) > 0) AS faq,
  bool_or(has_org = '1') AS org, bool_or(has_microdata = '1' OR has_rdfa = '1') AS markup, bool_or(https_ok = '1') AS https, bool_or(regexp_matches(lower(path), '{_CONTACT}')) AS contact FROM p GROUP BY host)
SELECT host, CASE WHEN (@) IS NULL THEN 'skipped' WHEN @ THEN 'finding' ELSE 'positive' END AS status, CASE WHEN coalesce(@, false) THEN # ELSE 0 END AS hits FROM s"""
SITES = {
    "geo:ai-bot-blocked": ("n % 4 = 1", 2), "geo:ai-user-fetcher-blocked": ("n % 4 = 3", 1), "geo:llms-txt-malformed": ("n % 10 <> 0 AND n % 3 <> 0", 1), "geo:no-faq-howto": ("NOT faq", 1),
    "schema:no-organization": ("NOT org AND NOT markup", 1), "trust:contact-pages-missing": ("NOT contact", 1), "tech:robots-site-blocked": ("n % 4 = 2", 1),
    "tech:robots-noindex-directive": ("n % 4 = 2", 1), "tech:robots-no-sitemap": ("n % 4 IN (1, 2)", 1), "tech:sitemap-scale-limit": ("CASE WHEN n % 5 <> 0 THEN n * 3000 ELSE n * 2400 END > 50000", 1),
    "tech:http-not-redirected": ("n % 2 = 0 AND n % 3 <> 0 AND https", 1), "perf:cwv-field-fail": ("CASE WHEN n % 4 <> 0 THEN n * 200 > 2500 END", 1),
    "tech:tls-cert-expiring": ("CASE WHEN n % 5 <> 0 THEN n - 20 <= 14 END", 1), "tech:safe-browsing-flagged": ("CASE WHEN n % 7 <> 0 THEN n % 7 = 1 END", 1),
}


def site_rule(rule_id: str) -> str:
    condition, hits = SITES[rule_id]
    return _FACTS.replace("@", condition).replace("#", str(hits))


# The audit of all rules ---------------------------------------------------------------------


def _of_relation(rule_id: str) -> str:
    """Hits of a rule about several pages; ``ord`` is the place in the crawl, or in the sitemap."""
    sql = f"({relation(rule_id)})"
    if rule_id == "hygiene:url-inconsistency":  # an address counts with its first live page in a site
        return f"SELECT host, min(row_no) AS row_no, url, '{rule_id}' AS rule_id, min(row_no) AS ord FROM p WHERE redirected <> '1' AND {_LIVE} AND url IN (SELECT url FROM {sql}) GROUP BY host, url"
    columns = {"tech:sitemap-quality": "row_no, url, '{}', ord", "tech:robots-sitemap-conflict": "ord, url, '{}', ord"}.get(rule_id, "row_no, url, '{}', row_no").format(rule_id)
    return f"SELECT host, {columns} FROM {sql}"


def audit(severities: dict[str, str]) -> dict[str, str]:
    """SQL of the audit queries; ``severities``: of each rule."""
    one = [f"SELECT host, row_no, url, '{r}' AS rule_id, row_no AS ord FROM p WHERE {'c AND (' + CONTENT[r] + ')' if r in CONTENT else ALL_ROWS[r]}" for r in [*CONTENT, *ALL_ROWS]]
    one.append(f"SELECT host, row_no, url, 'i18n:hreflang-invalid-code', row_no FROM ({HREFLANG})")
    sites = " UNION ALL ".join(f"SELECT host, '{r}' AS rule_id, status, hits FROM ({site_rule(r)})" for r in SITES)
    head = f"WITH {PAGES}, hits AS ({' UNION ALL '.join([*one, *map(_of_relation, RELATIONS)])}), whole AS ({sites})"
    levels = "sev(rule_id, severity) AS (VALUES " + ", ".join(f"('{r}', '{v}')" for r, v in severities.items()) + ")"
    named = ", ".join(f"'{r}'" for r in severities if r not in SITES)
    pattern = "CASE WHEN seg_path = '' THEN '(other)' WHEN regexp_extract(seg_path, '^/+([^/]+)', 1) = '' THEN '/' ELSE concat('/', regexp_extract(seg_path, '^/+([^/]+)', 1), '/*') END"
    return {
        "audit_hits": head + " SELECT rule_id, host, row_no FROM hits UNION ALL SELECT rule_id, host, NULL FROM whole WHERE status = 'finding'",
        "audit_findings": head
        + f""", {levels}, n AS (SELECT host, count(*) AS pages FROM crawl GROUP BY host), g AS (SELECT host, rule_id, count(*) AS hits, true AS of_pages FROM hits GROUP BY host, rule_id UNION ALL SELECT host, rule_id, hits, false FROM whole WHERE status = 'finding')
        SELECT g.host, rule_id, severity, hits, CASE WHEN of_pages AND pages >= 5 THEN round(hits / pages * 100, 1) END AS pct_of_pages FROM g JOIN n ON n.host = g.host JOIN sev USING (rule_id)""",
        "audit_status": head
        + f""", r AS (SELECT unnest([{named}]) AS rule_id), fired AS (SELECT DISTINCT host, rule_id FROM hits)
        SELECT h.host, r.rule_id, CASE WHEN fired.host IS NULL THEN 'positive' ELSE 'finding' END AS status FROM (SELECT DISTINCT host FROM crawl) h CROSS JOIN r LEFT JOIN fired ON fired.host = h.host AND fired.rule_id = r.rule_id
        UNION ALL SELECT host, rule_id, status FROM whole""",
        "audit_samples": head
        + """, o AS (SELECT host, rule_id, url, row_number() OVER (PARTITION BY host, rule_id ORDER BY ord) - 1 AS rank, count(*) OVER (PARTITION BY host, rule_id) AS total FROM hits),
        s AS (SELECT * FROM o WHERE total <= 10 OR rank IN (SELECT floor(i * (total - 1) / 9 + 0.5) FROM range(10) t(i))) SELECT host, rule_id, row_number() OVER (PARTITION BY host, rule_id ORDER BY rank) AS ord, url FROM s""",
        "audit_clusters": head
        + f""", g AS (SELECT host, rule_id, {pattern} AS pattern, count(*) AS n FROM (SELECT *, {_PATH_OF.format('url')} AS seg_path FROM hits) GROUP BY ALL)
        SELECT host, rule_id, pattern, n, row_number() OVER (PARTITION BY host, rule_id ORDER BY n DESC, pattern) AS ord FROM g QUALIFY ord <= 5""",
    }


GRAPH_QUERIES = {
    "link_edges": f"WITH {KEYED}, {GRAPH} SELECT src, dst FROM edges",
    "link_inlinks": f"WITH {KEYED}, {GRAPH} SELECT dst AS url, count(*) AS inlinks FROM edges GROUP BY dst",
    "link_depth": f"WITH RECURSIVE {KEYED}, {GRAPH}, {DEPTH} SELECT url, CAST(d AS INT) AS depth FROM depth",
    "link_orphans": f"WITH {KEYED}, {GRAPH} SELECT row_no, norm AS url FROM k WHERE norm NOT IN (SELECT dst FROM edges) AND norm NOT IN (SELECT norm FROM roots)",
}
