"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sites of state bodies.
OFFICIAL = ["cdep.ro", "senat.ro", "gov.ro", "presidency.ro", "europarl.europa.eu", "mae.ro", "ccr.ro", "romania.europa.eu"]
#: Paths with these ends aren't pages.
SKIP_EXT = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".zip", ".rar", ".7z", ".gz",
    ".exe", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pdf", ".css", ".js", ".xml", ".rss",
]
#: Fixed value.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|mc_[^=]*|ref)(=.*)?$"


def normalize_url(url: Column) -> Column:
    """http and https URLs with a host, without tracking parameters and fragment; else null. Parameters keep their order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    base, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)), "&")
    return F.when(bare.rlike(r"(?i)^https?://[^/?#]+"), F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base))


def hostname(url: Column) -> Column:
    """Lower-cased host without port, user and leading "www."."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def is_official(host: Column, domains: list[str] = OFFICIAL) -> Column:
    """The host is a domain of the list or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit("." + d))
    return out


def is_page(url: Column) -> Column:
    """The path doesn't end like a file that isn't a page."""
    path = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    return ~path.rlike("(" + "|".join(x.replace(".", "\\.") for x in SKIP_EXT) + ")$")
