from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.lineage import all_clusters, cluster_url, database_of, first_cluster
from tidemark.functions.records import grid_text, json_map, json_of, merge_maps, preview, rows_to_text
from tidemark.functions.text import (
    charset_of,
    decode,
    decode_lossy,
    is_blank,
    iso_utc,
    looks_like_text,
    parse_rfc3339,
    strip,
)
from tidemark.functions.urls import is_valid_url, url_extension

SPACES = [c for c in map(chr, range(0x110000)) if c.isspace()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_strip_removes_all_white_space(spark):
    df = spark.createDataFrame([(f"{c}x y{c}", f"{c}{c}") for c in SPACES], "a string, b string")
    for row in df.select("a", "b", strip(F.col("a")).alias("s"), is_blank(F.col("b")).alias("blank")).collect():
        assert row.s == row.a.strip() == "x y"
        assert row.blank, hex(ord(row.b[0]))
    assert one(spark, strip(F.lit(" \n a​b \t"))) == "a​b"
    assert one(spark, is_blank(F.lit(None).cast("string")))
    assert not one(spark, is_blank(F.lit(" \n.")))


@pytest.mark.parametrize(
    "content_type, charset",
    [
        ("text/html; charset=UTF-8", "utf-8"),
        ("text/html;charset= latin1 ; x=y", "latin1"),
        ("text/html", ""),
    ],
)
def test_charset(spark, content_type, charset):
    assert one(spark, charset_of(F.lit(content_type))) == charset


@pytest.mark.parametrize(
    "content, content_type, text",
    [
        ("héllo".encode(), "text/plain", "héllo"),
        ("héllo".encode("latin1"), "text/plain; charset=latin1", "héllo"),
        ("héllo".encode("latin1"), "text/plain", "héllo"),
        ("“q” €".encode("cp1252"), "text/plain; charset=windows-1252", "“q” €"),
        (b"\x81x", "text/plain; charset=windows-1252", "\x81x"),
        ("é".encode(), "text/plain; charset=ISO-8859-1", "Ã©"),
        (b"", "text/plain", ""),
        (b"\xff\xfe\x00\x01", "application/octet-stream", "ÿþ\x00\x01"),
        ("﻿bom".encode(), "text/plain; charset=utf-8", "bom"),
        ("é".encode(), "text/plain; charset=no-such-charset", "é"),
        ("x﻿".encode(), None, "x﻿"),
    ],
)
def test_decode(spark, content, content_type, text):
    df = spark.createDataFrame([(bytearray(content), content_type)], "c binary, t string")
    assert df.select(decode(F.col("c"), F.col("t")).alias("v")).first().v == text


def test_keep_bom(spark):
    df = spark.createDataFrame([(bytearray("﻿a".encode()),)], "c binary")
    assert df.select(decode(F.col("c"), F.lit(""), keep_bom=True).alias("v")).first().v == "﻿a"


def test_lossy_decode_replaces(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary")
    assert df.select(decode_lossy(F.col("c")).alias("v")).first().v == "a�b"


@pytest.mark.parametrize(
    "content, is_text",
    [
        (b"plain", True),
        (b"nul\x00", False),
        (b"x" * 1024 + b"\x00", True),
        (b"\xff\xfe", False),
        (b"", True),
        *[(b"x" * k + "€".encode() + b"y" * 10, True) for k in (1021, 1022, 1023)],
        (b"x" * 1023 + "😀".encode(), True),
        (b"x" * 1021 + "😀".encode(), True),
        (b"x" * 1022 + b"\xe2", False),
        (b"x" * 900 + b"\xff" + b"x" * 500, False),
    ],
)
def test_sniff(spark, content, is_text):
    df = spark.createDataFrame([(bytearray(content),)], "c binary")
    assert df.select(looks_like_text(F.col("c")).alias("v")).first().v is is_text


def test_grid_text(spark):
    df = spark.createDataFrame(
        [([["A", None, "C"], [None, "B", None], [None, ""], [], None, [" x ", "y"]],)], "g array<array<string>>"
    )
    assert df.select(grid_text(F.col("g")).alias("v")).first().v == "A |  | C\n | B | \nx | y"


def test_rows_to_text_skips_blank_values_and_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, " \t", "b"), (None, None, "")], "id int, `odd name` string, note string"
    )
    got = [r.text for r in rows_to_text(df).orderBy("id").collect()]
    assert sorted(got) == ["id: 1\nodd name: a", "id: 2\nnote: b"]


def test_preview_cuts_long_values(spark):
    df = spark.createDataFrame([(i, "x" * (99 + i)) for i in range(5)], "id int, t string")
    got = preview(df, n=3, order_by="id").collect()
    assert [(r.id, len(r.t), r.t.endswith("...")) for r in got] == [
        ("0", 99, False), ("1", 100, False), ("2", 103, True)
    ]


@pytest.mark.parametrize(
    "url, valid, ext",
    [
        ("not-a-valid-url", False, ""),
        ("https://example.org/a/b.md?x=1.py#f.go", True, ".md"),
        ("https://example.org", True, ""),
        ("https:///path.md", False, ""),
        ("//host/path.md", False, ""),
        ("http://h/a b/c.PY", True, ".PY"),
        ("http://h/.profile", True, ""),
        ("mailto:x@y.z", False, ""),
    ],
)
def test_urls(spark, url, valid, ext):
    row = spark.range(1).select(is_valid_url(F.lit(url)).alias("v"), url_extension(F.lit(url)).alias("e")).first()
    assert row.v is valid
    if valid:
        assert row.e == ext


def test_lineage(spark):
    q = F.lit("cluster('https://a').database(\"d\").T | join cluster(\"b.db.example.net\").database('e').U")
    row = spark.range(1).select(
        cluster_url(first_cluster(q), ".db.example.net").alias("url"),
        database_of(q, "x").alias("db"),
        all_clusters(q).alias("all"),
        cluster_url(F.lit("b.db.example.net"), ".db.example.net").alias("full"),
        first_cluster(F.lit("T | take 1")).alias("none"),
    ).first()
    assert tuple(row) == (
        "https://a.db.example.net", "d", ["https://a", "b.db.example.net"], "https://b.db.example.net", None
    )


def test_json_map(spark):
    assert one(spark, json_map(F.lit('{"a": "b", "n": 1}'))) == {"a": "b", "n": "1"}
    assert one(spark, json_map(F.lit("{broken"))) is None


def test_merge_maps(spark):
    df = spark.createDataFrame(
        [({"a": "1", "b": "2"}, {"b": "9", "c": None}), (None, {"x": "1"}), ({"y": "1"}, None), (None, None)],
        "old map<string,string>, new map<string,string>",
    )
    got = [r.m for r in df.select(merge_maps(F.col("old"), F.col("new")).alias("m")).collect()]
    assert got == [{"a": "1", "b": "9", "c": None}, {"x": "1"}, {"y": "1"}, {}]
    assert one(spark, json_of(F.create_map(F.lit("owner"), F.lit('a"b')))) == '{"owner":"a\\"b"}'


def test_times(spark):
    assert one(spark, iso_utc(F.lit("2024-01-02 03:04:05.5").cast("timestamp"))) == "2024-01-02T03:04:05.500000Z"
    assert one(spark, iso_utc(parse_rfc3339(F.lit("2024-01-02T05:04:05+02:00")))) == "2024-01-02T03:04:05.000000Z"
    assert one(spark, parse_rfc3339(F.lit("soon"))) is None


@pytest.mark.parametrize(
    "content, charset, text",
    [
        ("日本".encode("shift_jis"), "Shift_JIS", "日本"),
        ("ab€".encode("utf-16"), "utf-16", "ab€"),
        ("é".encode(), "no-such-charset", "é"),
        (b"\xd8\x00", "utf-16-be", "Ø\x00"),
        ("é".encode("latin1"), "latin1", "é"),
        ("п".encode("koi8-r"), "koi8-r", "п"),
    ],
)
def test_any_charset(spark, content, charset, text):
    df = spark.createDataFrame([(bytearray(content), f"text/plain; charset={charset}")], "c binary, t string")
    assert df.select(decode(F.col("c"), F.col("t"), any_charset=True).alias("v")).first().v == text
