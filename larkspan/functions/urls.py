"""URL expressions; none fails on a malformed URL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def normalise(url: Column) -> Column:
    """Without fragment."""
    return F.regexp_replace(url, "#.*$", "")


def on_sites(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d.lower()) | h.endswith("." + d.lower())
    return F.coalesce(out, F.lit(False))


def sites_asked(query: Column) -> Column:
    """Domains of site: operators, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("\\bsite:([a-z0-9.-]+)"), 1))
