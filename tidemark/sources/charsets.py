"""Bytes of pages and feeds to text: which charset holds is told from the first bytes, the header and the declaration, JVM-side.

UTF-8, Latin-1 and well-formed UTF-16 are decoded by expressions inside the scan's stage; only bodies in other charsets, and
UTF-16 with lone surrogates, are sent to Python. Decoding never fails: bytes that mean nothing become U+FFFD.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import let

# Labels of the Encoding Standard and the codecs that read them. ASCII and Latin-1 labels mean windows-1252.
LABELS = {
    "utf-8": "utf-8 utf8 unicode-1-1-utf-8 x-unicode20utf8",
    "utf-16-le": "utf-16 utf-16le ucs-2 unicode iso-10646-ucs-2 csunicode",
    "utf-16-be": "utf-16be unicodefffe",
    "cp1252": "ansi_x3.4-1968 ascii us-ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 windows-1252 cp1252 x-cp1252",
    "cp932": "shift_jis shift-jis sjis x-sjis ms932 ms_kanji csshiftjis windows-31j",
    "euc_jp": "euc-jp x-euc-jp cseucpkdfmtjapanese",
    "iso2022_jp": "iso-2022-jp csiso2022jp",
    "cp949": "euc-kr cseuckr korean ks_c_5601-1987 ksc5601 windows-949",
    "gb18030": "gb18030 gbk gb2312 gb_2312-80 chinese csgb2312 x-gbk",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "cp1254": "iso-8859-9 iso8859-9 latin5 l5 windows-1254 cp1254 x-cp1254",
    "cp874": "iso-8859-11 tis-620 windows-874 dos-874",
    "koi8_r": "koi8-r koi8 koi cskoi8r",
    "koi8_u": "koi8-u koi8-ru",
    "cp866": "ibm866 cp866 866 csibm866",
    "mac_roman": "macintosh mac x-mac-roman csmacintosh",
}
CODECS = {label: codec for codec, labels in LABELS.items() for label in labels.split()}
CODECS |= {f"{prefix}{n}": f"cp{n}" for n in (1250, 1251, 1253, 1255, 1256, 1257, 1258) for prefix in ("windows-", "cp", "x-cp")}
CODECS |= {f"{prefix}{n}": f"iso8859_{n}" for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16) for prefix in ("iso-8859-", "iso8859-", "iso_8859-")}
#: Characters that windows-1252 has in place of control characters of Latin-1; five of these stay as they are.
CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
PRINTED = CONTROLS.encode("latin-1").decode("cp1252")

HTML_BYTES, XML_BYTES = 4096, 200
META = r"""(?i)<meta\b[^>]*[^>\w-]charset\s*=\s*["']?([\w-]+)"""
ANY_XML = r"""(?i)<\?xml[^>]+encoding\s*=\s*["']([\w-]+)["']"""
XML = r"""(?i)<\?xml[^>]*\sencoding=["']([^"']+)["']"""


def known(label: Column) -> Column:
    """The codec of a label; null for labels nobody knows, empty ones and null."""
    table = F.create_map(*[F.lit(x) for pair in CODECS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(label)))


def starts(body: Column, mark: bytes) -> Column:
    return F.substring(body, 1, len(mark)) == F.lit(mark)


def utf16_mark(body: Column) -> Column:
    return F.when(starts(body, codecs.BOM_UTF16_LE), "utf-16-le").when(starts(body, codecs.BOM_UTF16_BE), "utf-16-be")


def codec_of_html(body: Column, header: Column) -> Column:
    """A byte order mark, the header's charset, the meta element or XML declaration in the first 4096 bytes, UTF-8."""
    head = F.decode(F.substring(body, 1, HTML_BYTES), "ISO-8859-1")
    declared = [F.nullif(F.regexp_extract(head, pattern, 1), F.lit("")) for pattern in (META, ANY_XML)]
    return F.coalesce(F.when(starts(body, codecs.BOM_UTF8), "utf-8"), utf16_mark(body), known(header), known(F.coalesce(*declared)), F.lit("utf-8"))


def codec_of_xml(body: Column, header: Column) -> Column:
    """A byte order mark of UTF-16, the header's charset, the declaration in the first 200 bytes, UTF-8."""
    head = F.decode(F.substring(body, 1, XML_BYTES), "ISO-8859-1")
    return F.coalesce(utf16_mark(body), known(header), known(F.regexp_extract(head, XML, 1)), F.lit("utf-8"))


@F.pandas_udf(T.StringType())
def by_python(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(body, codec) -> text; null bodies stay null."""
    for body, codec in batches:
        yield pd.Series([None if b is None else bytes(b).decode(c, "replace") for b, c in zip(body, codec, strict=True)], dtype=object)


def lone_surrogates(body: Column, little: bool) -> Column:
    """Whether UTF-16 has half a pair somewhere, or half a unit at its end."""
    units = F.regexp_replace(F.hex(body), "(.{4})", " $1")
    high, low = (" ..D[89AB]", " ..D[C-F]") if little else (" D[89AB]..", " D[C-F]..")
    return (F.octet_length(body) % 2 == 1) | units.rlike(f"{high}(?!{low})|(?<!{high}){low}")


def parts_of(body: Column, codec: Column) -> Column:
    """text, left, codec: what the JVM decodes of ``body`` without the byte order mark of its own charset, and else the bytes left to Python."""

    def without_mark(c: Column) -> Column:
        rest = body
        for name, mark in (("utf-8", codecs.BOM_UTF8), ("utf-16-le", codecs.BOM_UTF16_LE), ("utf-16-be", codecs.BOM_UTF16_BE)):
            rest = F.when((c == name) & starts(body, mark), F.substring(body, F.lit(len(mark) + 1), F.octet_length(body))).otherwise(rest)
        return rest

    def judged(c: Column, rest: Column) -> Column:
        left = F.when(c.isin("utf-8", "cp1252"), False).when(c == "utf-16-le", lone_surrogates(rest, True)).when(c == "utf-16-be", lone_surrogates(rest, False)).otherwise(True)
        return F.struct(c.alias("codec"), rest.alias("rest"), left.alias("left"))

    def decoded_by_jvm(x: Column) -> Column:
        c, rest = x["codec"], x["rest"]
        text = F.when(x["left"], None).when(c == "utf-8", F.make_valid_utf8(rest.cast("string"))).when(c == "cp1252", F.translate(F.decode(rest, "ISO-8859-1"), CONTROLS, PRINTED))
        text = text.when(c == "utf-16-le", F.decode(rest, "UTF-16LE")).when(c == "utf-16-be", F.decode(rest, "UTF-16BE"))
        return F.struct(text.alias("text"), F.when(x["left"], rest).alias("left"), c.alias("codec"))

    return let(codec, lambda c: let(without_mark(c), lambda rest: let(judged(c, rest), decoded_by_jvm)))


def decoded(df: DataFrame, body: str, codec: Column, name: str = "text") -> DataFrame:
    """``df`` with ``name``, the text of ``body`` in ``codec``: null for null. The parts are a column of their own, so no body is decoded twice."""
    parts = df.withColumn("_parts", parts_of(F.col(body), codec))
    return parts.withColumn(name, F.coalesce("_parts.text", by_python(F.col("_parts.left"), F.col("_parts.codec")))).drop("_parts")


def html_text(df: DataFrame, body: str, header: Column, name: str = "text") -> DataFrame:
    """``df`` with a page's bytes as text; ``header`` is the charset of its content type, empty or null if there is none."""
    return decoded(df, body, codec_of_html(F.col(body), header), name)


def xml_text(df: DataFrame, body: str, header: Column, name: str = "xml") -> DataFrame:
    """``df`` with a feed's bytes as text."""
    return decoded(df, body, codec_of_xml(F.col(body), header), name)
