"""Address expressions, Column to Column; regular expressions, as ``parse_url`` fails on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
TURKISH = "çğıöşüÇĞİÖŞÜ"


def netloc(url: Column) -> Column:
    """Authority part in lower case, with port and user; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def canonical(url: Column) -> Column:
    """Scheme and authority in lower case, default port, fragment and empty path normalised; path and query kept."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, authority, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    authority = F.when((scheme == "http"), F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    whole = F.concat(scheme, F.lit("://"), authority, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "?", F.lit("")).otherwise(query))
    return F.when(url.rlike(_PARTS), whole).otherwise(url)


def is_turkish(url: Column) -> Column:
    h, path = host(url), F.lower(F.regexp_extract(url, _PARTS, 3))
    return h.rlike(r"\.tr$") | h.rlike(r"^tr\.") | path.contains("/tr/") | path.startswith("/tr") | F.lower(F.regexp_extract(url, _PARTS, 4)).contains("lang=tr")


def guess_language(url: Column, hint: Column, text: Column) -> Column:
    """Hint, then Turkish address, then ``lang=`` of the query, then Turkish letters of the beginning, then empty."""
    from .text import normal_language

    said = normal_language(hint)
    asked = normal_language(F.regexp_extract(F.lower(F.regexp_extract(url, _PARTS, 4)), r"[?&]lang=([^&;]+)", 1))
    letters = F.length(F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, 400), f"[^{TURKISH}]", ""))
    return F.when(said != "", said).when(is_turkish(url), F.lit("tr")).when(asked != "", asked).when(letters >= 3, F.lit("tr")).otherwise(F.lit(""))


def with_scheme(seed: Column) -> Column:
    return F.when(seed.contains("://"), seed).otherwise(F.concat(F.lit("https://"), seed))


def in_domains(url: Column, domains: list[str]) -> Column:
    """Host equal to a domain or below it; an empty list allows all."""
    h = host(url)
    out = F.lit(not domains)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out
