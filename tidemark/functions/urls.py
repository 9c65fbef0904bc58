"""URL checks by the generic URL grammar: scheme, host and path are what is needed here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension

_WITH_HOST = r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"
_PATH = r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def is_valid_url(url: Column) -> Column:
    """Scheme and host are both present; false for null."""
    return F.coalesce(url.rlike(_WITH_HOST), F.lit(False))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_extension(url: Column) -> Column:
    return extension(url_path(url))
