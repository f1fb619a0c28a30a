"""Column expressions over URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import as_col


def origin(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), r"(?i)^(https?://[^/?#]+)", 1)


def host(url: Column | str) -> Column:
    """Lower-case host without user part and port; "" when there is none."""
    return F.lower(F.regexp_extract(as_col(url), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def canonical(url: Column | str) -> Column:
    return F.regexp_replace(as_col(url), r"(?s)\?.*$", "")


def is_http(url: Column | str) -> Column:
    return F.coalesce(as_col(url).startswith("http"), F.lit(False))


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link; NULL for fragments and other schemes."""
    base, href = as_col(base), as_col(href)
    folder = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+(?:/(?:[^?#]*/)?)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.rlike(r"^(?:#.*|[a-zA-Z][a-zA-Z0-9+.-]*:.*)?$"), F.lit(None).cast("string"))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )


def on_host(url: Column | str, hosts, mode: str = "host") -> Column:
    """Is the URL on one of the hosts? ``mode="substring"`` searches the text."""
    if mode == "substring":
        pattern = "|".join(re.escape(h) for h in hosts)
        return F.coalesce(as_col(url).rlike(pattern), F.lit(False))
    names = "|".join(re.escape(h) for h in hosts)
    pattern = rf"(?i)^https?://(?:[^/?#@]*@)?(?:[^/?#:]*\.)?(?:{names})(?:[/?#:]|\z)"
    return F.coalesce(as_col(url).rlike(pattern), F.lit(False))


def listing_score(url: Column | str, domain: Column, department: Column) -> Column:
    """Rank of a hit as a listing page; 0 means "not one".

    4 for the official domain, 2 for a department subdomain, 1 for a listing
    path. Home pages, blocked hosts and foreign domains score 0. Each test is
    one pattern, so that a computed ``url`` is not evaluated over and over.
    """
    url = as_col(url)
    h = host(url)
    official = (h == domain) | h.endswith(F.concat(F.lit("."), domain))
    home = url.rlike(r"(?i)^https?://[^/?#]+/?(?:[?#]|\z)")
    paths = "|".join(re.escape(p) for p in fv.LISTING_PATHS)
    listing = url.rlike(rf"(?i)^https?://[^/?#]+[^?#]*?(?:{paths})")
    dept_host = h.startswith(F.concat(F.lower(department), F.lit(".")))
    score = (
        F.lit(4)
        + F.when(F.coalesce(dept_host, F.lit(False)), 2).otherwise(0)
        + F.when(listing, 1).otherwise(0)
    )
    usable = official & ~home & ~on_host(url, fv.BLOCKED_HOSTS)
    return F.when(F.coalesce(usable, F.lit(False)), score).otherwise(0)
