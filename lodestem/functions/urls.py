"""URLs on columns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_domain(url: Column) -> Column:
    """Lower-cased authority (user info and port stay); empty without one."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def normalize_url(url: Column) -> Column:
    """Lower-cased scheme and authority, path without ``;params`` and closing slashes (``/`` if nothing is left), query
    kept, fragment dropped. What is no absolute URL stays as it is."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    path = F.regexp_replace(F.regexp_replace(part(3), r";[^/]*$", ""), r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = part(4)
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.regexp_like(url, F.lit(_URL)), whole).otherwise(url)


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` as seen from ``base``; null if either is null or it can't be read as a URL."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b, h) if b is not None and h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def crawlable(href: Column) -> Column:
    """Whether a link target is one to follow: not empty, no script, mail address or place in the same page."""
    return (href != "") & ~href.startswith("javascript:") & ~href.startswith("mailto:") & ~href.startswith("#")
