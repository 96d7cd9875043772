"""Network safety: addresses in every notation a host may be written in, and the static check of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.text import let

# Fixed values.
PORTS = (80, 443, 8080, 8443)
BLOCKED_HOSTS = ("metadata.google.internal", "metadata.internal", "instance-data.ec2.internal")


def _part(x: Column) -> Column:
    number = lambda digits, base: F.when(F.length(digits) <= 15, F.conv(digits, base, 10).cast("long")).otherwise(F.lit(1 << 40))
    return (
        F.when(x.rlike("(?i)^0x[0-9a-f]+$"), number(F.substring(x, 3, 1 << 20), 16))
        .when(x.rlike("^0[0-7]+$"), number(F.substring(x, 2, 1 << 20), 8))
        .when(x.rlike("^[0-9]+$"), number(x, 10))
    )


def ipv4(host: Column) -> Column:
    """The address as a long, from 1 to 4 decimal, octal or hexadecimal parts; null if it is none."""

    def packed(v: Column) -> Column:
        n, last, head = F.size(v), F.element_at(v, -1), F.slice(v, F.lit(1), F.size(v) - 1)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
        ok = (n <= 4) & ~F.exists(v, lambda x: x.isNull()) & ~F.exists(head, lambda x: x > 255) & (last < room)
        return F.when(ok, F.aggregate(head, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x) * room + last)

    return F.when(host.rlike("^[0-9a-zA-Z.]+$"), let(F.transform(F.split(host, r"\."), _part), packed))


def ipv4_class(ip: Column) -> Column:
    """Why an address must not be reached; null for public ones."""
    a, b = F.shiftright(ip, 24), F.shiftright(ip, 16).bitwiseAND(255)
    return (
        F.when(a == 127, "loopback")
        .when(a == 0, "invalid")
        .when(ip == 0xA9FEA9FE, "metadata")
        .when((a == 169) & (b == 254), "link-local")
        .when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private")
        .when((a == 100) & b.between(64, 127), "cgn")
        .when(a >= 224, "invalid")
    )


def ipv6(host: Column) -> Column:
    """Eight groups as array<long>; null if it is no IPv6 address."""

    def groups(x: Column) -> Column:
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))

    def without_v4(x: Column) -> Column:
        tail = F.regexp_extract(x, r":([^:]*\.[^:]*)$", 1)
        hexed = lambda v: F.concat(F.regexp_extract(x, "^(.*:)", 1), F.lower(F.hex(F.shiftright(v, 16))), F.lit(":"), F.lower(F.hex(v.bitwiseAND(65535))))
        return F.when(tail == "", x).otherwise(let(ipv4(tail), hexed))

    def filled(sides: Column) -> Column:
        head, rest = groups(F.element_at(sides, 1)), groups(F.try_element_at(sides, F.lit(2)))
        return F.when(F.size(sides) == 1, head).when((F.size(sides) == 2) & (F.size(head) + F.size(rest) <= 8), F.concat(head, F.array_repeat(F.lit("0"), 8 - F.size(head) - F.size(rest)), rest))

    bare = F.regexp_replace(host, r"^\[|\]$", "")
    full = let(F.split(let(bare, without_v4), "::", -1), filled)
    valid = lambda g: F.when((F.size(g) == 8) & ~F.exists(g, lambda x: ~x.rlike("^[0-9a-fA-F]{1,4}$")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("long")))
    return F.when(bare.contains(":"), let(full, valid))


def ipv6_class(g: Column) -> Column:
    at = lambda k: F.element_at(g, k)
    zero = lambda n: F.aggregate(F.slice(g, 1, n), F.lit(0).cast("long"), lambda a, x: a + x) == 0
    inner = F.shiftleft(at(7), 16) + at(8)
    return (
        F.when(zero(7) & (at(8) == 1), "loopback")
        .when(zero(8), "invalid")
        .when(F.array_join(g, ":") == "64768:3778:0:0:0:0:0:596", "metadata")
        .when((zero(5) & (at(6) == 65535)) | zero(6), ipv4_class(inner))
        .when(at(1).bitwiseAND(0xFFC0) == 0xFE80, "link-local")
        .when(at(1).bitwiseAND(0xFE00) == 0xFC00, "private")
    )


def host_class(host: Column) -> Column:
    """Why a host must not be reached; null for public or unknown names."""

    def classed(h: Column) -> Column:
        named = F.when((h == "localhost") | h.endswith(".localhost"), "loopback").when(h.isin(*BLOCKED_HOSTS), "metadata")
        address = F.struct(ipv4(h).alias("v4"), ipv6(h).alias("v6"))
        return let(address, lambda x: F.when(x["v4"].isNotNull(), ipv4_class(x["v4"])).when(x["v6"].isNotNull(), ipv6_class(x["v6"])).otherwise(named))

    return let(F.lower(host), classed)


def url_check(url: Column) -> Column:
    """The first reason a URL is refused without asking the network; null if it is fine."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(url.isNull() | (scheme == ""), "invalid_url")
        .when(~scheme.isin("http", "https"), "scheme")
        .when((urls.host(url) == "") | urls.port(url).isNull(), "invalid_url")
        .when(url.rlike(r"^[A-Za-z]+://[^/?#]*@") & ~url.rlike(r"^[A-Za-z]+://:?@"), "userinfo")
        .when(~urls.port(url).isin(*PORTS), "port")
        .otherwise(host_class(urls.host(url)))
    )
