"""Captured URLs: what a fetcher landed as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import is_valid_url
from .trees import MAX_FILE_SIZE

# fixed values: the message texts of this module
NO_URLS = "No documents fetched from static data source"


def explode_urls(specs: DataFrame, urls: str = "urls") -> DataFrame:
    """One row per URL; a bare string counts as a list of one."""
    if isinstance(specs.schema[urls].dataType, T.StringType):
        return specs.withColumn("url", F.col(urls)).drop(urls).where(F.col("url").isNotNull())
    return specs.withColumn("url", F.explode(urls)).drop(urls)


def specs_without_urls(specs: DataFrame, urls: str = "urls") -> DataFrame:
    """Error rows for specs that list no URL."""
    empty = F.col(urls).isNull()
    if isinstance(specs.schema[urls].dataType, T.ArrayType):
        empty = empty | (F.size(urls) == 0)
    return specs.where(empty).select(
        "owner", F.lit(None).cast("string").alias("unit"), F.lit(NO_URLS).alias("message")
    )


def size_error(
    content: Column, max_size: int = MAX_FILE_SIZE, declared: Column | None = None
) -> Column:
    """A message where the declared or the actual length is over the limit, else null."""
    over = F.octet_length(content) > max_size
    error = F.when(over, F.lit(f"File too large: exceeds limit of {max_size} bytes"))
    if declared is None:
        return error
    message = F.concat(
        F.lit("File too large: "),
        declared.cast("string"),
        F.lit(f" bytes exceeds limit of {max_size} bytes"),
    )
    return F.when(declared > max_size, message).otherwise(error)


def capture_error(
    url: Column, content: Column, max_size: int = MAX_FILE_SIZE, declared: Column | None = None
) -> Column:
    """Why a captured URL cannot be used, else null."""
    return F.when(~is_valid_url(url), F.concat(F.lit("Invalid URL format: "), url)).otherwise(
        size_error(content, max_size, declared)
    )
