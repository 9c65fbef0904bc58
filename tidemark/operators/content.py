"""Which handler reads which bytes, and what text comes out.

A handler is a name, a priority, a predicate and an extractor, both given as functions from
``(content, content_type, ext)`` columns to a column. The handlers fold into one CASE, highest
priority first, so routing stays inside the JVM unless an extractor is an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode, is_pdf, looks_like_text

ColumnRule = Callable[[Column, Column, Column], Column]

# fixed value: the message of a row that no handler takes
NO_HANDLER = "No suitable content handler found"

# fixed values: content types taken as text without looking at the bytes
TEXT_TYPES = (
    "text/",
    "application/json",
    "application/xml",
    "application/yaml",
    "application/javascript",
    "application/x-yaml",
    "application/toml",
    "text/csv",
)


@dataclass(frozen=True)
class Handler:
    name: str
    priority: int
    can_handle: ColumnRule
    extract: ColumnRule | None = None


def _pdf_rule(content: Column, content_type: Column, ext: Column) -> Column:
    fits = (F.coalesce(ext, F.lit("")) == "") | (F.lower(ext) == ".pdf")
    declared = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))
    return fits & (declared | is_pdf(content))


def _text_rule(content: Column, content_type: Column, ext: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    declared = F.lit(False)
    for text_type in TEXT_TYPES:
        declared = declared | F.contains(kind, F.lit(text_type))
    return declared | looks_like_text(content)


# Page and table rows of a PDF are put together by operators.pages, so it has no extractor here.
PDF = Handler("pdf", 10, _pdf_rule)
TEXT = Handler("text", 1, _text_rule, lambda content, content_type, ext: decode(content, content_type))

# The same, for sources that declare rare charsets.
TEXT_ANY_CHARSET = Handler(
    "text",
    1,
    _text_rule,
    lambda content, content_type, ext: decode(content, content_type, any_charset=True),
)

_REGISTERED: list[Handler] = [PDF, TEXT]


def register_handler(
    name: str, priority: int, can_handle: ColumnRule, extract: ColumnRule | None = None
) -> Handler:
    """Add a handler, or replace the one of the same name."""
    handler = Handler(name, priority, can_handle, extract)
    _REGISTERED[:] = [h for h in _REGISTERED if h.name != name] + [handler]
    return handler


def unregister_handler(name: str) -> None:
    """Take a handler out again; one that is not there changes nothing."""
    _REGISTERED[:] = [h for h in _REGISTERED if h.name != name]


def default_handlers() -> list[Handler]:
    return sorted(_REGISTERED, key=lambda h: -h.priority)


def with_any_charset(handlers: Sequence[Handler] | None = None) -> list[Handler]:
    """The handlers with the text handler that knows all charsets; for captures that come with a declared one.

    Files of a tree declare none, so their runs do without it.
    """
    return [TEXT_ANY_CHARSET if h is TEXT else h for h in (handlers or default_handlers())]


def _case(branches: Sequence[tuple[Column, Column]]) -> Column:
    chain = F.when(*branches[0])
    for condition, value in branches[1:]:
        chain = chain.when(condition, value)
    return chain


def route(
    df: DataFrame,
    handlers: Sequence[Handler] | None = None,
    content: str = "content",
    content_type: str = "content_type",
    ext: str = "ext",
) -> DataFrame:
    """Add ``handler``: the first one that takes the row, null where none does."""
    ordered = sorted(handlers or _REGISTERED, key=lambda h: -h.priority)
    args = (F.col(content), F.col(content_type), F.col(ext))
    return df.withColumn("handler", _case([(h.can_handle(*args), F.lit(h.name)) for h in ordered]))


def extract_text(
    df: DataFrame,
    handlers: Sequence[Handler] | None = None,
    content: str = "content",
    content_type: str = "content_type",
    ext: str = "ext",
) -> DataFrame:
    """Route, then add ``text`` and ``error``. A bad row carries a message and does not stop the job."""
    ordered = sorted(handlers or _REGISTERED, key=lambda h: -h.priority)
    args = (F.col(content), F.col(content_type), F.col(ext))
    readable = [h for h in ordered if h.extract is not None]
    text = _case([(F.col("handler") == h.name, h.extract(*args)) for h in readable])
    names = [h.name for h in readable]
    error = F.when(F.col("handler").isNull(), F.lit(NO_HANDLER)).when(
        ~F.col("handler").isin(*names),
        F.concat(F.lit("No text extractor for handler "), F.col("handler")),
    )
    return route(df, ordered, content, content_type, ext).withColumn("text", text).withColumn("error", error)
