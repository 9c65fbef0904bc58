"""Bytes to text, and small text helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separators U+001C..U+001F: what a full strip removes.
WHITE = (
    r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

SNIFF_BYTES = 1024

# Charset names by the decoder that serves them (fixed values: public alias names).
LATIN1_NAMES = ("latin1", "latin-1", "l1", "iso-8859-1", "iso8859-1", "iso_8859-1", "8859", "cp819")
UTF8_NAMES = ("utf-8", "utf8", "ascii", "us-ascii")
CP1252_NAMES = ("cp1252", "windows-1252", "1252")

# windows-1252 differs from ISO-8859-1 only here (fixed values; five bytes are undefined).
_CP1252_HIGH = {
    byte: bytes([byte]).decode("cp1252")
    for byte in range(0x80, 0xA0)
    if byte not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(text, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return text.isNull() | ~text.rlike(rf"[^{WHITE}]")


def truncate(text: Column, width: int = 100) -> Column:
    """The text, cut to ``width`` characters plus dots where it is longer."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)


def charset_of(content_type: Column) -> Column:
    """The declared charset in lower case; empty when none is declared."""
    return F.lower(F.trim(F.regexp_extract(content_type, r"charset=([^;]*)", 1)))


def as_utf8(content: Column) -> Column:
    """The bytes taken as UTF-8, unchecked: pair it with ``is_valid_utf8``."""
    return content.cast("string")


def has_nul(content: Column) -> Column:
    """A NUL byte among the first bytes marks binary content."""
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00"))


def looks_like_text(content: Column) -> Column:
    """No NUL in the sample, and the sample is valid UTF-8.

    The sample may end inside a character, so up to three trailing bytes are left out
    of the test when there is more content behind it.
    """

    def valid(n: int) -> Column:
        return F.is_valid_utf8(as_utf8(F.substring(content, 1, n)))

    cut = F.octet_length(content) > SNIFF_BYTES
    sample_ok = valid(SNIFF_BYTES) | (
        cut & (valid(SNIFF_BYTES - 1) | valid(SNIFF_BYTES - 2) | valid(SNIFF_BYTES - 3))
    )
    return ~has_nul(content) & sample_ok


def is_pdf(content: Column) -> Column:
    """The bytes start with the magic ``%PDF``."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def drop_bom(text: Column) -> Column:
    bom = F.lit("\ufeff")
    return F.when(F.startswith(text, bom), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def _codec_udf():
    @F.pandas_udf("string")
    def by_codec(content: pd.Series, charset: pd.Series) -> pd.Series:
        def one(data: bytes | None, name: str) -> str | None:
            try:
                return None if data is None else bytes(data).decode(name)
            except (LookupError, UnicodeDecodeError):
                return None

        return pd.Series([one(c, n) for c, n in zip(content, charset, strict=True)], dtype="object")

    return by_codec


def decode(
    content: Column, content_type: Column, keep_bom: bool = False, any_charset: bool = False
) -> Column:
    """Decode by declared charset, then UTF-8, then ISO-8859-1, which never fails.

    A declared charset that is unknown here or does not fit the bytes falls through to the
    rest of the chain. UTF-8, ASCII, ISO-8859-1 and windows-1252 are decoded in the JVM. With
    ``any_charset`` the other charsets Python knows (UTF-16, Shift-JIS, ...) are tried too, in an
    Arrow UDF that gets the bytes of just those rows.
    """
    charset = charset_of(F.coalesce(content_type, F.lit("")))
    latin1 = F.decode(content, "ISO-8859-1")
    utf8 = as_utf8(content)
    undefined_1252 = latin1.rlike(r"[\x{81}\x{8D}\x{8F}\x{90}\x{9D}]")
    cp1252 = F.translate(
        latin1, "".join(map(chr, _CP1252_HIGH)), "".join(_CP1252_HIGH.values())
    )
    fallback = F.when(F.is_valid_utf8(utf8), utf8).otherwise(latin1)
    if any_charset:
        native = charset.isin("", *UTF8_NAMES, *LATIN1_NAMES, *CP1252_NAMES)
        fallback = F.coalesce(_codec_udf()(F.when(~native, content), charset), fallback)
    text = (
        F.when(F.octet_length(content) == 0, F.lit(""))
        .when(charset.isin(*LATIN1_NAMES), latin1)
        .when(charset.isin(*CP1252_NAMES) & ~undefined_1252, cp1252)
        .otherwise(fallback)
    )
    return text if keep_bom else drop_bom(text)


def decode_lossy(content: Column) -> Column:
    """Decode as UTF-8 with U+FFFD for each byte sequence that is not valid."""
    return F.make_valid_utf8(as_utf8(content))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC with a trailing Z (the session zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_rfc3339(text: Column) -> Column:
    """A timestamp, or null where the text is not one."""
    return F.try_to_timestamp(text)
