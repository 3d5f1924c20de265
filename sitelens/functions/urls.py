"""URL handling for page extraction: resolving references as browsers do, as plain functions."""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import quote, urlsplit

_DEFAULT = {"http": "80", "https": "443"}
_BAD = frozenset(" <>^|%")


@lru_cache(maxsize=50_000)
def parse(url: str, base: str | None = None) -> tuple[str, str, str, str] | None:
    """(scheme, host with port, path, query) of an absolute address; null if it has none.

    Lower-cases scheme and host, drops the default port, removes dot segments, escapes blanks.
    """
    text = "".join(url.split("\t")).replace("\n", "").replace("\r", "").strip()
    own = parse(base) if base else None
    head = text.partition(":")[0]
    if not (head and head[0].isalpha() and all(c.isalnum() or c in "+-." for c in head) and ":" in text):
        if own is None:
            return None
        scheme, host, path, query = own
        if text.startswith(("//", "\\\\")):
            text = f"{scheme}:{text}"
        elif text.startswith(("/", "\\")):
            text = f"{scheme}://{host}{text}"
        elif text.startswith("?"):
            text = f"{scheme}://{host}{path}{text}"
        elif text.startswith("#") or not text:
            text = f"{scheme}://{host}{path}{query}{text}"
        else:
            text = f"{scheme}://{host}{path.rpartition('/')[0]}/{text}"
    try:
        parts = urlsplit(text)
        port, name = parts.port, parts.hostname
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in _DEFAULT or not name or _BAD.intersection(name):
        return None
    host = name + (f":{port}" if port is not None and str(port) != _DEFAULT[scheme] else "")
    steps: list[str] = []
    pieces = (parts.path or "/").replace("\\", "/").split("/")[1:]
    for i, p in enumerate(pieces):
        last = i == len(pieces) - 1
        if p.lower() in ("..", "%2e%2e"):
            steps = steps[:-1]
            if last:
                steps.append("")
        elif p.lower() in (".", "%2e"):
            if last:
                steps.append("")
        else:
            steps.append(p)
    safe = "!$&'()*+,-./:;=@_~%[]|\\^"
    return scheme, host, "/" + quote("/".join(steps), safe=safe), "?" + quote(parts.query, safe=safe + "?/{}`") if parts.query else ""


def origin(u: tuple[str, str, str, str]) -> str:
    return f"{u[0]}://{u[1]}"


def key(url: str) -> str:
    """The address as the link graph knows it."""
    if (u := parse(url)) is None:
        return url
    path = u[2][: -len("index.html")] if u[2].endswith("/index.html") else u[2]
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    return f"{origin(u)}{path or '/'}{u[3]}"
