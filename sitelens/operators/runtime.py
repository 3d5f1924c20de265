"""Classifiers for runtime measurements, certificates, headers and addresses, as column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators.sites import CWV_BOUNDS

EXPIRING_DAYS = 14


def cwv_category(metric: str, value: Column) -> Column:
    """good, needs-improvement or poor; null without a number."""
    good, fair = CWV_BOUNDS[metric]
    return F.when(value.isNull() | F.isnan(value), None).when(value <= good, "good").when(value <= fair, "needs-improvement").otherwise("poor")


CRUX_SCHEMA = "record struct<metrics: map<string, struct<percentiles: struct<p75: string>>>>"
CRUX_NAMES = {"lcp": "largest_contentful_paint", "inp": "interaction_to_next_paint", "cls": "cumulative_layout_shift"}


def crux_record(text: Column) -> Column:
    """metric -> (p75, category) of a field-data answer; null if it has none of the metrics."""
    metrics = F.from_json(text, CRUX_SCHEMA)["record"]["metrics"]
    entry = lambda m: F.struct(F.lit(m).alias("metric"), metrics[CRUX_NAMES[m]]["percentiles"]["p75"].try_cast("double").alias("p75"))
    have = F.filter(F.array(*map(entry, CRUX_NAMES)), lambda x: x["p75"].isNotNull())
    return F.when(F.size(have) > 0, have)


def threat_types(matches: Column) -> Column:
    """Distinct threat types, first seen first."""
    return F.array_distinct(matches)


def certificate_issues(days_left: Column, host_matches: Column, trusted: Column) -> Column:
    """What is wrong with a certificate; ``days_left`` is rounded down."""
    days = F.floor(days_left)
    return F.filter(
        F.array(F.when(days < 0, "expired"), F.when((days >= 0) & (days <= EXPIRING_DAYS), "expiring"), F.when(~host_matches, "mismatch"), F.when(~trusted, "untrusted")),
        lambda x: x.isNotNull(),
    )


def san_matches(host: Column, names: Column) -> Column:
    """The host is one of the names, or one label below a wildcard."""
    h = F.lower(host)
    return F.exists(names, lambda n: (F.lower(n) == h) | (n.startswith("*.") & (F.regexp_replace(h, r"^[^.]+", "*") == F.lower(n)) & h.contains(".")))


@F.pandas_udf(T.BooleanType())
def is_private_address(addresses: pd.Series) -> pd.Series:
    """Addresses that a crawler must not fetch: private, loopback, link-local, multicast, reserved, mapped ones."""

    def private(a: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address((a or "").strip().strip("[]"))
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return not ip.is_global or ip.is_multicast

    return addresses.map(private).astype("object")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date seen from ``now``; null if neither."""
    at = F.try_to_timestamp(F.regexp_extract(value, r"^\s*\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\s*$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(value.rlike(r"^\s*\d+\s*$"), F.trim(value).try_cast("double")), F.when(at.isNotNull(), F.greatest(F.lit(0.0), at.cast("double") - now.cast("double"))))


def cookie_insecure(set_cookies: Column) -> Column:
    """Any cookie without Secure, HttpOnly and SameSite among its attributes; null if none is set."""
    attributes = lambda c: F.transform(F.slice(F.split(F.lower(c), ";"), F.lit(2), F.length(c) + 1), lambda p: F.trim(F.split(p, "=")[0]))
    lacks = lambda c: F.size(F.array_except(F.array(F.lit("secure"), F.lit("httponly"), F.lit("samesite")), attributes(c))) > 0
    return F.when(F.size(set_cookies) > 0, F.exists(set_cookies, lacks))


def discloses_version(server: Column, powered_by: Column) -> Column:
    """A version number behind a slash in the Server header, or any X-Powered-By."""
    return F.coalesce(server, F.lit("")).rlike(r"/\d+\.\d") | (F.trim(F.coalesce(powered_by, F.lit(""))) != "")


def nosniff(value: Column) -> Column:
    """One of the tokens of X-Content-Type-Options says nosniff."""
    return F.exists(F.split(F.lower(F.coalesce(value, F.lit(""))), ","), lambda t: F.trim(t) == "nosniff")


def header_features(headers: Column, set_cookies: Column) -> dict[str, Column]:
    """The header columns of a crawl row from a map of headers (lower-case names) and its cookies."""
    get = lambda n: F.coalesce(headers[n], F.lit(""))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), "1").otherwise("0")
    csp = get("content-security-policy")
    return {
        "x_robots_tag": get("x-robots-tag"), "hsts_present": flag(get("strict-transport-security") != ""), "frame_protection": flag((get("x-frame-options") != "") | csp.rlike("(?i)frame-ancestors")), "content_encoding": get("content-encoding"),
        "nosniff_present": flag(nosniff(headers["x-content-type-options"])), "referrer_policy_present": flag(get("referrer-policy") != ""), "permissions_policy_present": flag(get("permissions-policy") != ""), "csp_present": flag(csp != ""),
        "cookie_insecure": flag(cookie_insecure(set_cookies)), "version_disclosure": flag(discloses_version(headers["server"], headers["x-powered-by"])),
    }


def fetch_interval_ms(rps: Column, crawl_delay: Column) -> Column:
    """Milliseconds between two requests: the slower of the rate and the site's delay (10 s at most)."""
    return F.greatest(F.lit(1000.0) / rps, F.least(F.coalesce(crawl_delay, F.lit(0.0)), F.lit(10.0)) * 1000)
