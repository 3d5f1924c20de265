"""SQL building blocks with the semantics that page audits need, for two SQL dialects.

Cells are strings and '' means absent; numbers are read from a prefix of decimal digits.
Spark is what the library runs on; the other dialect serves only as the independent check.
"""

from __future__ import annotations


class Spark:
    """Expressions in Spark SQL."""

    name = "spark"

    def s(self, c: str) -> str:
        return f"coalesce({c}, '')"

    def lit(self, text: str) -> str:
        return "r'" + text.replace("'", "\\'") + "'" if "\\" in text else "'" + text.replace("'", "\\'") + "'"

    def re(self, e: str, pattern: str) -> str:
        return f"({e} RLIKE {self.lit(pattern)})"

    def sub(self, e: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({e}, {self.lit(pattern)}, '{to}')"

    def grab(self, e: str, pattern: str) -> str:
        return f"regexp_extract({e}, {self.lit(pattern)}, 1)"

    def int(self, c: str) -> str:
        """parseInt: null where JavaScript has NaN"""
        return f"try_cast({self.grab(self.s(c), r'^\s*([+-]?\d+)')} AS BIGINT)"

    def num(self, c: str) -> str:
        """Number(x ?? 0): '' is 0"""
        return f"(CASE WHEN trim({self.s(c)}) = '' THEN 0D ELSE try_cast({c} AS DOUBLE) END)"

    def parts(self, e: str, sep: str) -> str:
        """Non-empty trimmed entries of a list cell."""
        return f"filter(transform(split({e}, '[{sep}]'), p -> trim(p)), p -> p <> '')"

    def any(self, array: str, test: str) -> str:
        return f"exists({array}, p -> {test})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def explode(self, array: str) -> str:
        return f"explode({array})"

    def utf16(self, e: str) -> str:
        """Length in UTF-16 units."""
        return f"(octet_length(encode({e}, 'UTF-16BE')) / 2)"

    def ts(self, e: str) -> str:
        """A date as a script engine reads it: ISO forms, else month names and American order; null otherwise."""
        plain = f"trim(regexp_replace(regexp_replace({e}, '^[A-Za-z]+, *', ''), '( GMT| UTC|Z)$', ''))"
        forms = ["d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy HH:mm:ss", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy"]
        return f"coalesce(try_cast({e} AS TIMESTAMP), {', '.join(f"try_to_timestamp({plain}, '{f}')" for f in forms)})"


class DuckDb(Spark):
    name = "duckdb"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def re(self, e: str, pattern: str) -> str:
        return f"regexp_matches({e}, {self.lit(pattern)})"

    def sub(self, e: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({e}, {self.lit(pattern)}, '{to.replace('$', chr(92))}', 'g')"

    def num(self, c: str) -> str:
        return f"(CASE WHEN trim({self.s(c)}) = '' THEN 0 ELSE try_cast({c} AS DOUBLE) END)"

    def parts(self, e: str, sep: str) -> str:
        return f"list_filter(list_transform(string_split({e}, '{sep}'), lambda p: trim(p)), lambda p: p <> '')"

    def any(self, array: str, test: str) -> str:
        return f"len(list_filter({array}, lambda p: {test})) > 0"

    def size(self, array: str) -> str:
        return f"len({array})"

    def explode(self, array: str) -> str:
        return f"unnest({array})"

    def utf16(self, e: str) -> str:
        return f"(length({e}) + length(regexp_replace({e}, '[^\U00010000-\U0010ffff]', '', 'g')))"


# URLs, in either dialect ------------------------------------------------------------------


def scheme(d: Spark, u: str) -> str:
    return f"lower({d.grab(u, r'^\s*([A-Za-z][A-Za-z0-9+.-]*):')})"


def host(d: Spark, u: str) -> str:
    """Lower-case host with port; the default port is left out."""
    return d.sub(f"lower({d.grab(u, r'^\s*[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)')})", r":(80|443)$")


def path(d: Spark, u: str) -> str:
    """Path of an absolute http(s) URL ('/' if none); '' for anything else."""
    p = d.grab(u, r"^\s*[Hh][Tt][Tt][Pp][Ss]?://[^/?#]+([^?#]*)")
    return f"(CASE WHEN {d.re(u, r'^\s*[Hh][Tt][Tt][Pp][Ss]?://[^/?#]+')} THEN CASE WHEN {p} = '' THEN '/' ELSE {p} END ELSE '' END)"


def query(d: Spark, u: str) -> str:
    return d.grab(u, r"^[^?#]*(\?[^#]*)")


def resolve(d: Spark, ref: str, base: str, parts: tuple[str, str, str, str] | None = None) -> str:
    """An href seen from a page, as an absolute address: with a scheme of its own, from the protocol, the
    root, the folder, the query or the fragment on; ``.`` and ``..`` are followed. ``parts``: columns that hold
    scheme, host, path and query of ``base`` already. Spark only."""
    of, at, way, asked = parts or (scheme(d, base), host(d, base), path(d, base), query(d, base))
    joined = (
        f"(CASE WHEN {d.re('r', '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN r WHEN {way} = '' THEN NULL WHEN {d.re('r', '^//')} THEN concat({of}, ':', r) WHEN {d.re('r', '^/')} THEN concat({of}, '://', {at}, r) "
        f"WHEN {d.re('r', '^([?]|$)')} THEN concat({of}, '://', {at}, {way}, CASE WHEN r = '' THEN {asked} ELSE r END) WHEN {d.re('r', '^#')} THEN concat({of}, '://', {at}, {way}, {asked}, r) "
        f"ELSE concat({of}, '://', {at}, {d.sub(way, '[^/]*$')}, r) END)"
    )
    return f"transform(transform(array(trim({ref})), r -> {joined}), u -> CASE WHEN contains(u, '/.') THEN {_dotless(d, 'u')} ELSE u END)[0]"


def _dotless(d: Spark, u: str) -> str:
    """The address without ``.`` and ``..`` steps."""
    steps = f"split(substring({path(d, u)}, 2), '/')"
    walked = f"aggregate({steps}, cast(array() AS array<string>), (a, x) -> CASE WHEN x = '..' THEN slice(a, 1, greatest(size(a) - 1, 0)) WHEN x = '.' THEN a ELSE concat(a, array(x)) END)"
    slash = f"CASE WHEN element_at({steps}, -1) IN ('.', '..') AND size({walked}) > 0 THEN '/' ELSE '' END"
    return f"concat({scheme(d, u)}, '://', {host(d, u)}, '/', array_join({walked}, '/'), {slash}, {query(d, u)})"


def address(d: Spark, u: str) -> str:
    """An absolute http(s) address with lower-case host, without default port; null for anything else."""
    return f"(CASE WHEN {path(d, u)} <> '' THEN concat({scheme(d, u)}, '://', {host(d, u)}, {path(d, u)}, {query(d, u)}, {d.grab(u, '(#.*)$')}) END)"


def normalized(d: Spark, u: str) -> str:
    """Key of a URL in the link graph: lower host, no index.html, no trailing slash, no fragment."""
    p = d.sub(path(d, u), r"/index\.html$", "/")
    p = f"(CASE WHEN {p} <> '/' THEN {d.sub(p, r'/$')} ELSE {p} END)"
    return f"(CASE WHEN {path(d, u)} = '' THEN {u} ELSE concat({scheme(d, u)}, '://', {host(d, u)}, {p}, {query(d, u)}) END)"
