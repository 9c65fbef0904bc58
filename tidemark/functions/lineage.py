"""Which sources a query text names: ``cluster('..')`` and ``.database('..')`` references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the reference forms in a query text
_FIRST_CLUSTER = r"cluster\(['\"]([^'\"()]+)['\"]\)"
_ANY_CLUSTER = r"cluster\(['\"]([^'\"]+)['\"]\)"
_DATABASE = r"\.database\(['\"]([^'\"]+)['\"]\)"


def first_cluster(query: Column) -> Column:
    """The cluster that would run the query; null when the text names none."""
    name = F.trim(F.regexp_extract(query, _FIRST_CLUSTER, 1))
    return F.when(name != "", name)


def all_clusters(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(_ANY_CLUSTER), 1)


def cluster_url(name: Column, suffix: str) -> Column:
    """The https address of a cluster that is named by host, with or without the suffix; whole addresses stay."""
    end = F.lit(suffix)
    host = F.regexp_replace(name, "^https?://", "")
    address = F.concat(F.lit("https://"), host, F.when(F.endswith(host, end), F.lit("")).otherwise(end))
    return F.when(F.startswith(name, F.lit("http")) & F.endswith(name, end), name).otherwise(address)


def database_of(query: Column, default: str) -> Column:
    name = F.regexp_extract(query, _DATABASE, 1)
    return F.when(name != "", name).otherwise(F.lit(default))
