"""Features of web pages from their HTML: the columns of the crawl table.

A page is read once as a stream of tags and texts (``_events``); collectors take from it what
they need. Works on Arrow batches; broken markup never fails a page.
"""

from __future__ import annotations

import html as entities
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import urls
from sitelens.functions.exprs import Spark, normalized
from sitelens.session import spread

# Link texts that say nothing, in lower case.
GENERIC = frozenset([
    "hier", "hier klicken", "klicken sie hier", "klick hier", "mehr", "mehr erfahren", "mehr lesen", "mehr dazu", "weiterlesen", "weiter", "link",
    "click here", "click", "here", "read more", "more", "learn more", "this link",
])
# Domains whose pages count as authoritative besides .gov, .edu and wikipedia.org.
AUTHORITATIVE = (
    "pubmed.ncbi.nlm.nih.gov", "who.int", "statista.com", "nature.com", "sciencedirect.com", "springer.com", "nih.gov",
    "cdc.gov", "ec.europa.eu", "destatis.de", "bundestag.de", "europarl.europa.eu", "bbc.com", "reuters.com",
)
MAX_RESOURCES, SHELL_WORDS = 20, 10

_COMMENT = regex.compile(r"<!--.*?-->", regex.S)
_TAG = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9-]*)([^>]*)>")
_ATTR = regex.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_CJK = regex.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣豈-﫿]")
_RAW = ("script", "style")
_END = {n: regex.compile(rf"</{n}\s*>", regex.I) for n in _RAW}
_EXT = {e: regex.compile(rf"\.{e}(?:[?#]|$)", regex.I) for e in ("jpe?g", "webp", "avif")}
_NO_PAGE = regex.compile(r"(?:javascript|mailto|tel):", regex.I)
_LEVEL = frozenset(f"h{i}" for i in range(1, 7))


def decode(text: str) -> str:
    """Entities decoded once; references beyond Unicode become the replacement character."""
    return entities.unescape(text).replace("\xa0", " ") if "&" in text else text


def words(text: str) -> int:
    """Words between blanks, and each Chinese, Japanese or Korean character."""
    return len(_CJK.findall(text)) + len(_CJK.sub(" ", text).split())


class Tag:
    __slots__ = ("name", "closing", "attrs", "quoted", "start", "end")

    def __init__(self, name: str, closing: bool, raw: str, start: int, end: int):
        self.name, self.closing, self.start, self.end = name, closing, start, end
        self.attrs: dict[str, str] = {}
        self.quoted: set[str] = set()
        if raw and not closing:
            for k, a, b, c in _ATTR.findall(raw):
                k = k.lower()
                if k not in self.attrs:
                    self.attrs[k] = a or b or c
                    if not c:
                        self.quoted.add(k)

    def get(self, k: str) -> str:
        return decode(self.attrs.get(k, ""))


def _events(text: str) -> tuple[list[Tag], list[tuple[str, str, int, int]]]:
    """(tags outside scripts and styles, (name, body, start, end) of scripts and styles)."""
    tags, blocks, at = [], [], 0
    while m := _TAG.search(text, at):
        closing, name, raw = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        tag = Tag(name.lower(), bool(closing), raw, m.start(), m.end())
        tags.append(tag)
        at = m.end()
        if tag.name in _RAW and not closing:
            end = _END[tag.name].search(text, at)
            stop = end.start() if end else len(text)
            blocks.append((tag.name, text[at:stop], tag.start, end.end() if end else len(text)))
            at = end.end() if end else len(text)
    return tags, blocks


def _span(tags: list[Tag], name: str, size: int) -> tuple[int, int]:
    start = next((t.end for t in tags if t.name == name and not t.closing), None)
    if start is None:
        return (0, 0) if name == "head" else (0, size)
    return start, next((t.start for t in reversed(tags) if t.name == name and t.closing and t.start >= start), size)


def _closers(tags: list[Tag]) -> list[int]:
    """For each tag the next closing tag of its name, by one walk from the end."""
    nearest: dict[str, int] = {}
    out = [0] * len(tags)
    for i in range(len(tags) - 1, -1, -1):
        out[i] = nearest.get(tags[i].name, 0)
        if tags[i].closing:
            nearest[tags[i].name] = i
    return out


def _inner(text: str, tags: list[Tag], closers: list[int], i: int) -> tuple[str, list[Tag]] | None:
    """Text between a tag and its closing tag, without tags, and the tags inside."""
    if not (j := closers[i]):
        return None
    body = text[tags[i].end : tags[j].start]
    return decode(" ".join((_TAG.sub(" ", body) if "<" in body else body).split())).strip(), tags[i + 1 : j]


def _walk(node) -> Iterator[dict]:
    """All objects of a JSON-LD value, outermost first: an object's graph, then its other members."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            members = [v for k, v in x.items() if not k.startswith("@")]
            todo.extend(reversed([x["@graph"], *members] if isinstance(x.get("@graph"), list) else members))
        elif isinstance(x, list):
            todo.extend(reversed(x))


def _tops(node) -> Iterator[dict]:
    """The objects that a block states: itself, the entries of arrays and graphs."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo.extend(reversed(x["@graph"] if isinstance(x.get("@graph"), list) else []))
        elif isinstance(x, list):
            todo.extend(reversed(x))


def _types(node: dict) -> list[str]:
    t = node.get("@type")
    return [str(x) for x in (t if isinstance(t, list) else [t]) if x]


def _offer(block) -> dict:
    """The first offer that a block states, by itself or as the offer of what it states."""
    for top in _tops(block):
        own = top.get("offers")
        for x in (top, *(own if isinstance(own, list) else [own])):
            if isinstance(x, dict) and x.get("@type") == "Offer":
                return x
    return {}


def _rating(block) -> dict:
    """The first rating of a block, at any depth, by its type or as the rating of something."""
    for x in _walk(block):
        if "AggregateRating" in _types(x):
            return x
        own = x.get("aggregateRating")
        own = own[0] if isinstance(own, list) and own else own
        if isinstance(own, dict) and (own.get("@type") == "AggregateRating" or own.get("ratingValue") is not None):
            return own
    return {}


def _reject(x: str):
    raise ValueError(x)


_OPENING, _CLOSING = regex.compile(r"(?:(?://|/\*)\s*+)?<!\[CDATA\[(?:\*/)?", regex.I), regex.compile(r"(?:(?://|/\*)\s*+)?\]\]>\s*+(?:\*/|//)?\Z", regex.I)


def _unwrapped(raw: str) -> str:
    """A JSON-LD block without the marks of a character-data section."""
    body = raw.strip()
    if "<![CDATA[" in body and (m := _OPENING.match(body)):
        body = body[m.end() :]
    if "]]>" in body and (m := _CLOSING.search(body)):
        body = body[: m.start()]
    return body.strip()


def _text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def linked_data(blocks: list[str]) -> dict:
    """Features of the JSON-LD blocks of a page."""
    valid, context, types, parsed = "1", "", [], []
    for raw in blocks:
        body = _unwrapped(raw)
        try:
            value = json.loads(body, parse_constant=_reject)
        except (ValueError, RecursionError):
            valid = "0"
            types += regex.findall(r"\"@type\"\s*:\s*\"([^\"]+)\"", body)
            continue
        parsed.append(value)
        types += [t for n in _walk(value) for t in _types(n)]
        for top in value if isinstance(value, list) else [value]:
            ctx = top.get("@context") if isinstance(top, dict) else None
            context = "0" if context == "0" or ctx is None or "schema.org" not in json.dumps(ctx).lower() else "1"
    kinds = set(types)
    orgs = [n for v in parsed for n in _walk(v) if "Organization" in _types(n)]
    flag = lambda b: "1" if b else "0"
    org_has = lambda k: flag(any(o.get(k) is not None for o in orgs))
    first = lambda k: next((str(n[k]) for v in parsed for n in _tops(v) if n.get(k)), "")
    offer = next((o for v in parsed if (o := _offer(v))), {})
    rating = next((r for v in parsed if (r := _rating(v))), {})
    count = rating.get("ratingCount") if rating.get("ratingCount") is not None else rating.get("reviewCount")
    return {
        "ld_valid": valid, "ld_context_ok": context, "ld_types": ",".join(dict.fromkeys(types)), "has_product": flag("Product" in kinds), "has_agg": flag("AggregateRating" in kinds), "has_breadcrumb": flag("BreadcrumbList" in kinds),
        "has_org": flag("Organization" in kinds), "has_org_same_as": org_has("sameAs"), "has_faq": flag("FAQPage" in kinds), "has_author": flag(kinds & {"Author", "Person"}), "date_published": first("datePublished"), "date_modified": first("dateModified"),
        "offer_price": _text(offer.get("price")), "availability": _text(offer.get("availability") or None), "agg_rating_value": _text(rating.get("ratingValue")), "agg_rating_count": _text(count),
        "has_shipping_details": flag(offer.get("shippingDetails") is not None), "has_return_policy": flag(offer.get("hasMerchantReturnPolicy") is not None), "has_org_logo": org_has("logo"), "has_org_contact_point": org_has("contactPoint"),
    }


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def extract(page: str | None, url: str) -> dict[str, object]:
    """All features of a page, as strings; ``internal_links`` is a list. No page, no features."""
    if page is None:
        return {}
    text = _COMMENT.sub(" ", page)
    tags, blocks = _events(text)
    own = urls.parse(url)
    body0, body1 = _span(tags, "body", len(text))
    head0, head1 = _span(tags, "head", len(text))
    opening, closers = [t for t in tags if not t.closing], _closers(tags)
    in_body = [t for t in opening if body0 <= t.start < body1]
    flag = lambda b: "1" if b else "0"
    n = lambda it: str(sum(1 for _ in it))

    meta: dict[str, str] = {}
    for t in opening:
        if t.name == "meta":
            name = (t.attrs.get("name") or t.attrs.get("property") or "").strip().lower()
            if name and "content" in t.attrs:
                meta.setdefault(name, t.get("content"))
    links = [t for t in opening if t.name == "link"]
    rel = lambda t: t.attrs.get("rel", "").lower().split()
    title = next((x[0] for i, t in enumerate(tags) if t.name == "title" and not t.closing and (x := _inner(text, tags, closers, i))), "")
    canonicals = list(dict.fromkeys(t.get("href") for t in links if "canonical" in rel(t) and t.attrs.get("href")))
    target = urls.parse(canonicals[0], url) if canonicals else None
    bare = lambda u: (u[0], u[1], u[2][:-1] if u[2].endswith("/") else u[2])
    alternates = [(t.get("hreflang"), t.get("href")) for t in links if "alternate" in rel(t) and "hreflang" in t.attrs]
    h1 = [x[0] for i, t in enumerate(tags) if t.name == "h1" and not t.closing and body0 <= t.start < body1 and (x := _inner(text, tags, closers, i))]
    images = [t for t in in_body if t.name == "img"]
    sources = [t for t in in_body if t.name == "source"]
    ends = lambda ext: (lambda t: _EXT[ext].search(t.attrs.get("src", "")) is not None)
    from_image = lambda ext: sum(1 for t in images if ends(ext)(t) or f".{ext}" in t.attrs.get("srcset", "").lower())
    from_source = lambda ext: sum(1 for t in sources if f"image/{ext}" in t.attrs.get("type", "").lower() or f".{ext}" in t.attrs.get("srcset", "").lower())
    visible, raw = text[body0:body1], text[body0:body1]
    for _, _, a, b in reversed(blocks):
        if body0 <= a < body1:
            visible = visible[: a - body0] + " " + visible[b - body0 :]
    shown, all_text = (" ".join(_TAG.sub(" ", x).split()) for x in (visible, raw))
    named = lambda t, *ks: any(t.attrs.get(k, "").strip() for k in ks)
    alt_inside = lambda ts: any(x.name == "img" and x.attrs.get("alt", "").strip() for x in ts)
    generic = hollow = unlabeled = 0
    for i, t in enumerate(tags):
        if t.closing or not body0 <= t.start < body1:
            continue
        if t.name == "a" and "href" in t.attrs and (x := _inner(text, tags, closers, i)):
            label, inside = x[0].lower(), x[1]
            if not label and not named(t, "aria-label", "title") and not alt_inside(inside):
                hollow += 1
            elif label in GENERIC and not named(t, "aria-label", "title"):
                generic += 1
        elif t.name == "iframe" and not named(t, "title", "aria-label"):
            unlabeled += 1
        elif t.name == "button" and (x := _inner(text, tags, closers, i)) and not x[0] and not named(t, "aria-label", "aria-labelledby", "title") and not alt_inside(x[1]):
            unlabeled += 1
    inner_links, outward, trusted = [], 0, 0
    for t in in_body:
        href = t.get("href").strip()
        if t.name != "a" or "href" not in t.quoted or not href or href.startswith("#") or _NO_PAGE.match(href):
            continue
        u = urls.parse(href, url)
        if u is None:
            continue
        if own and urls.origin(u) == urls.origin(own):
            inner_links.append(urls.key(f"{urls.origin(u)}{u[2]}{u[3]}"))
        else:
            outward += 1
            h = u[1].partition(":")[0]
            trusted += h.endswith((".gov", ".edu")) or any(h == d or h.endswith("." + d) for d in ("wikipedia.org", *AUTHORITATIVE))
    resources: dict[str, None] = {}
    for t in opening:
        ref = t.get("src") if t.name == "script" else t.get("href") if t.name == "link" and "stylesheet" in rel(t) else ""
        if ref and own and (u := urls.parse(ref, url)) and urls.origin(u) == urls.origin(own):
            resources[u[2] + u[3]] = None
    head = [t for t in opening if head0 <= t.start < head1]
    secure = bool(own and own[0] == "https")
    insecure = any(t.attrs.get(k, "").strip().lower().startswith("http://") for t in opening for k in ("src", "data", "poster", *(("href",) if t.name == "link" and "stylesheet" in rel(t) else ())))
    raw_words = words(all_text)
    out: dict[str, object] = {
        "title": title, "title_len": str(utf16(title)), "meta_desc": meta.get("description", ""), "meta_desc_len": str(utf16(meta.get("description", ""))), "meta_missing": flag("description" not in meta),
        "canonical": canonicals[0] if canonicals else "", "canon_self": "" if not canonicals else flag(target and own and bare(target) == bare(own)), "canonical_count": str(len(canonicals)), "robots_meta": meta.get("robots", ""),
        "html_lang": next((t.get("lang") for t in opening if t.name == "html"), ""), "hreflang_count": str(len(alternates)), "hreflang": ",".join(a for a, _ in alternates), "hreflang_links": "|".join(f"{a}={h}" for a, h in alternates),
        "h1": h1[0] if h1 else "", "h1_count": str(len(h1)), "heading_outline": ",".join(t.name for t in in_body if t.name in _LEVEL),
        "img_total": str(len(images)), "img_no_alt": n(t for t in images if not t.attrs.get("alt", "").strip()), "img_jpg": n(t for t in images if ends("jpe?g")(t)), "img_webp": str(from_image("webp") + from_source("webp")),
        "img_avif": str(from_image("avif") + from_source("avif")), "img_no_dimensions": n(t for t in images if "width" not in t.attrs or "height" not in t.attrs), "first_img_lazy": flag(images and images[0].attrs.get("loading", "").lower() == "lazy"),
        "outlinks_internal": str(len(inner_links)), "outlinks_external": str(outward), "outlinks_authoritative": str(trusted), "word_count": str(words(shown)), "raw_word_count": str(raw_words),
        "https_ok": flag(secure), "mixed_content": flag(secure and insecure), "error_code": "js-guard:empty-body" if raw_words < SHELL_WORDS else "", "viewport_content": meta.get("viewport", ""),
        "charset_ok": flag(regex.search(r"<meta[^>]+charset\s*=\s*[\"']?\s*utf-8", page[:1024], regex.I)), "og_title": meta.get("og:title", ""), "og_image": meta.get("og:image", ""), "og_url": meta.get("og:url", ""),
        "has_favicon": flag(any("icon" in t.attrs.get("rel", "").lower() for t in links)), "dom_node_count": n(t for t in in_body if t.name not in _RAW),
        "head_blocking_scripts": n(t for t in head if t.name == "script" and "src" in t.attrs and not {"async", "defer"} & t.attrs.keys() and t.attrs.get("type", "").strip().lower() != "module"),
        "head_blocking_styles": n(t for t in head if t.name == "link" and t.attrs.get("rel", "").lower() == "stylesheet" and t.attrs.get("media", "").strip().lower() != "print"),
        "generic_anchor_count": str(generic), "empty_link_count": str(hollow), "unlabeled_control_count": str(unlabeled), "has_microdata": flag(any("itemscope" in t.attrs and "schema.org" in t.attrs.get("itemtype", "").lower() for t in opening)),
        "has_rdfa": flag(any("typeof" in t.attrs or "vocab" in t.attrs for t in opening)), "resource_paths": "|".join(list(resources)[:MAX_RESOURCES]), "internal_links": list(dict.fromkeys(inner_links)),
    }
    ld = [body for name, body, a, _ in blocks if name == "script" and regex.search(r"type\s*=\s*[\"']?application/ld\+json", text[a : text.find(">", a) + 1], regex.I)]
    out |= linked_data(ld)
    out["date_published"] = out["date_published"] or meta.get("article:published_time", "") or meta.get("datepublished", "")
    out["date_modified"] = out["date_modified"] or meta.get("article:modified_time", "") or meta.get("datemodified", "")
    return out


COLUMNS = [k for k in extract("<p>x</p>", "https://x.example/") if k != "internal_links"]


def features(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(``key``, ``url``, feature columns, internal_links) for each page; a page that cannot be read
    gives empty features."""
    kind = pages.select(key).schema[0].dataType.simpleString()
    schema = f"{key} {kind}, {url} string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", internal_links array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells: dict[str, list] = {c: [] for c in [*COLUMNS, "internal_links"]}
            for u, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    got = extract(page, u or "")
                except Exception:  # noqa: BLE001 - one broken page must not fail the crawl
                    got = {}
                for c in COLUMNS:
                    cells[c].append(got.get(c, ""))
                cells["internal_links"].append(got.get("internal_links", []))
            kinds = [pa.list_(pa.string()) if c == "internal_links" else pa.string() for c in cells]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(cells.values(), kinds))], names=[key, url, *cells])

    return spread(pages.select(key, url, html)).mapInArrow(run, schema)


def crawl_rows(fetched: DataFrame, key: str = "row_no") -> DataFrame:
    """The rows of a crawl from what was fetched: (``key``, url, page_type, status int, final_url, hops array<string>,
    headers map<string,string> with lower-case names, set_cookies array<string>, error, html). Only pages with
    markup have page features; a page that is refused or empty keeps its address, status and headers."""
    from sitelens.operators.runtime import header_features
    from sitelens.sources.artifacts import CRAWL_COLUMNS

    about = fetched.select(
        key, "url", F.coalesce("page_type", F.lit("page")).alias("page_type"), F.coalesce(F.col("status").cast("string"), F.lit("")).alias("status"), F.coalesce("final_url", "url").alias("final_url"),
        F.when(F.size("hops") > 0, "1").otherwise("0").alias("redirected"), F.coalesce(F.array_join("hops", "|"), F.lit("")).alias("redirect_chain"), F.when(F.coalesce("final_url", "url").startswith("https://"), "1").otherwise("0").alias("secure"),
        F.coalesce("error", F.lit("")).alias("error"), *[c.alias(n) for n, c in header_features(F.col("headers"), F.col("set_cookies")).items()],
    )
    parsed = features(fetched.where("html IS NOT NULL").select(key, F.coalesce("final_url", "url").alias("at"), "html"), key, "at", "html").drop("at", "https_ok", "internal_links")
    own = {"https_ok": F.col("secure"), "error_code": F.when(F.col("error") != "", F.col("error")).otherwise(F.coalesce("error_code", F.lit("")))}
    out = about.join(parsed, key, "left")
    return out.select(key, *[own[c].alias(c) if c in own else F.coalesce(c, F.lit("")).alias(c) for c in CRAWL_COLUMNS])


_HREF = regex.compile(r"<a\s[^>]*\bhref=(?:\"([^\"]+)\"|'([^']+)')", regex.I)


def frontier_links_of(page: str | None, base: str) -> list[str]:
    """Where a crawl may go on from a page: links of its own origin, each once, in order, as they are written
    (a slash at the end or an index file stays) but without fragment."""
    out: dict[str, None] = {}
    if page and (own := urls.parse(base)):
        for a, b in _HREF.findall(page):
            u = urls.parse(decode(a or b), base)
            if u and urls.origin(u) == urls.origin(own):
                out[f"{urls.origin(u)}{u[2]}{u[3]}"] = None
    return list(out)


def frontier_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(``url``, ord, link) of the links that a crawl may follow from each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [frontier_links_of(page, u or "") for u, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["url", "links"])

    got = pages.select(F.col(url).alias("url"), html).mapInArrow(run, "url string, links array<string>")
    return got.select(F.col("url").alias(url), F.posexplode("links").alias("ord", "link"))


def link_edges(extracted: DataFrame, url: str) -> DataFrame:
    """(src, dst) of the internal links of extracted pages, as link-graph keys."""
    return extracted.select(F.expr(normalized(Spark(), url)).alias("src"), F.explode("internal_links").alias("dst"))
