"""Decoding inside the JVM against Python's codecs, and which charset holds."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import charsets, feeds, pages


def texts(spark, rows, how):
    df = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(rows)], "i int, b binary, c string")
    return [r.t for r in how(df, "b", F.col("c"), "t").orderBy("i").collect()]


def test_pages(spark):
    raw = [
        ("é".encode("latin-1"), "iso-8859-1"), ("é".encode(), ""), (b"\xef\xbb\xbf\xc3\xa9", "latin1"), ('<meta charset="shift_jis">日'.encode("cp932"), ""), (b"\xff", "nonsense"), (None, None),
        (b"\x80\x81\x9f", " Latin1 "), ("<meta content='text/html; charset=euc-jp' http-equiv=Content-Type>日".encode("euc_jp"), None), ("<p data-charset='euc-jp'>é".encode(), None),
        ('<?xml version="1.0" encoding="windows-1251"?>Я'.encode("cp1251"), None), ("﻿aé😀".encode("utf-16-le"), "utf-8"), ("﻿aé😀".encode("utf-16-be"), "utf-8"), (b"", None),
        (b" " * 4096 + b"<meta charset=latin1>\xe9", None), ('<meta charset="nonsense">é'.encode(), None),
    ]
    want = [
        "é", "é", "é", '<meta charset="shift_jis">日', "�", None, "€\x81Ÿ", "<meta content='text/html; charset=euc-jp' http-equiv=Content-Type>日", "<p data-charset='euc-jp'>é",
        '<?xml version="1.0" encoding="windows-1251"?>Я', "aé😀", "aé😀", "", " " * 4096 + "<meta charset=latin1>�", '<meta charset="nonsense">é',
    ]
    assert texts(spark, raw, charsets.html_text) == want


def test_feeds(spark):
    xml = '<?xml version="1.0" encoding="{}"?><rss><channel><item><title>é</title><link>https://e.org/</link></item></channel></rss>'
    raw = [(xml.format("ISO-8859-1").encode("latin-1"), None), (("﻿" + xml.format("utf-16")).encode("utf-16-le"), "utf-8"), (xml.format("Shift_JIS").encode(), "utf-8"), (xml.format("utf-8").encode("latin-1"), "windows-1252"), ((" " * 190 + xml.format("latin1")).encode("latin-1"), None)]
    got = texts(spark, raw, charsets.xml_text)
    assert got[0] == xml.format("ISO-8859-1") and got[1] == xml.format("utf-16") and got[2] == xml.format("Shift_JIS") and got[3] == xml.format("utf-8") and "�" in got[4]
    items = feeds.rss_items(spark.createDataFrame(list(enumerate(got[:4])), "doc int, xml string"))
    assert [r.title for r in items.orderBy("doc").collect()] == ["é"] * 4


@pytest.mark.parametrize("codec", ["utf-8", "utf-16-le", "utf-16-be", "cp1252"])
def test_random_bytes(spark, codec):
    rng = random.Random(codec)
    raw = [bytes(rng.choice([0, 0x41, 0xC3, 0xA9, 0xD8, 0xDC, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, rng.randrange(256)]) for _ in range(rng.randrange(40))) for _ in range(2000)]
    raw = [b for b in raw if b[:2] not in (b"\xff\xfe", b"\xfe\xff") and b[:3] != b"\xef\xbb\xbf"]
    want = [b.decode("latin-1").translate({ord(x): y for x, y in zip(charsets.CONTROLS, charsets.PRINTED)}) if codec == "cp1252" else b.decode(codec, "replace") for b in raw]
    assert texts(spark, [(b, codec) for b in raw], charsets.decoded) == want


def test_every_label_has_a_codec(spark):
    import codecs

    assert all(codecs.lookup(c) for c in charsets.CODECS.values())
    got = spark.createDataFrame([(x,) for x in ("UTF8", " Windows-1250 ", "iso-8859-15", "none", "", None)], "x string").select(charsets.known(F.col("x")).alias("k")).collect()
    assert [r.k for r in got] == ["utf-8", "cp1250", "iso8859_15", None, None, None]
    assert spark.range(1).select(pages.charset_of(F.lit('text/html; Charset="X"')).alias("c")).first().c == "x"
