"""Audit of target URLs, host names and literal addresses before anything fetches them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import urls as U
from .stages import stage
from .text import strip


def validate_targets(df: DataFrame, col: str) -> DataFrame:
    """Add ``code`` (``ok`` or a reason code), ``host`` and the ``normalised`` URL of each target."""
    raw = strip(F.coalesce(F.col(col), F.lit("")))
    has_scheme = raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    df = stage(df, _raw=raw, _target=F.when(has_scheme, raw).otherwise(F.concat(F.lit("https://"), raw)))
    df = U.with_url_parts(df, F.col("_target"), "_p")
    scheme = F.lower(F.regexp_extract("_target", r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    code = (
        F.when((F.col("_raw") == "") | (F.length("_raw") > K.MAX_URL_LENGTH), "invalid-url")
        .when(~scheme.isin("http", "https"), "blocked-protocol")
        .when(F.col("_p_host").isNull(), "invalid-url")
        .when(F.col("_p_user") != "", "blocked-credentials")
        .when(F.col("_p_port").try_cast("int").isin(*K.BLOCKED_PORTS), "blocked-port")
        .otherwise("ok")
    )
    df = stage(df, code=code, host=F.col("_p_host"))
    df = df.withColumn("normalised", F.when(F.col("code") == "ok", U.href("_p")))
    return U.drop_parts(df, "_p").drop("_raw", "_target")


def hostname_reason(host: Column) -> Column:
    """Why a host name must never be resolved, or null. First matching rule wins."""
    rules = [F.when(host.rlike(f"(?i){p}"), F.lit(r)) for p, r in K.BLOCKED_HOSTNAMES]
    return F.coalesce(F.when(host == "", "empty hostname"), *rules)


def host_verdicts(df: DataFrame) -> DataFrame:
    host = F.regexp_replace(F.coalesce("host", F.lit("")), r"\.$", "")
    return df.withColumn("host", host).withColumn("reason", hostname_reason(F.col("host")))


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number, or null when it is not a valid one."""
    octets = F.transform(F.split(ip, r"\."), lambda o: o.try_cast("bigint"))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(
        ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda o: o <= 255), value
    )


def _cidr_bounds(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    low = reduce(lambda acc, o: acc * 256 + int(o), base.split("."), 0)
    return low, low + 2 ** (32 - int(bits)) - 1


def ipv4_reason(ip: Column) -> Column:
    """Why an IPv4 literal is refused, or null. The block list is 15 literals, so it is folded in."""
    n = ipv4_number(ip)
    rules = [
        F.when(n.between(*_cidr_bounds(cidr)), F.lit(reason)) for cidr, reason in K.IPV4_BLOCKS
    ]
    return F.coalesce(
        F.when(n.isNull(), "not a valid IPv4 address"),
        F.when(n == 2**32 - 1, "broadcast address"),
        *rules,
    )


def cidr_lookup(df: DataFrame, ip: str) -> DataFrame:
    """First block of the list that holds each address, as a join on the leading octet.

    Every block is expanded to the leading octets it covers (at most 16 per block), so the
    range condition is only evaluated within one octet instead of against all blocks.
    """
    spark = df.sparkSession
    blocks = [
        (octet, i, *_cidr_bounds(cidr), reason)
        for i, (cidr, reason) in enumerate(K.IPV4_BLOCKS)
        for octet in range(_cidr_bounds(cidr)[0] >> 24, (_cidr_bounds(cidr)[1] >> 24) + 1)
    ]
    table = spark.createDataFrame(blocks, "octet bigint, ord int, low bigint, high bigint, why string")
    df = stage(df, _n=ipv4_number(F.col(ip)))
    hit = df.join(
        F.broadcast(table),  # fixed size: one row per block and leading octet
        (F.shiftright("_n", 24) == F.col("octet")) & F.col("_n").between(F.col("low"), F.col("high")),
    )
    return hit.groupBy(ip).agg(F.min_by("why", "ord").alias("reason"), F.min("ord").alias("rule"))


def with_ipv6_reason(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Why an IPv6 literal is refused, or null; mapped and NAT64 addresses defer to IPv4."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(ip)), r"^\[|\]$", ""), "%.*$", "")
    dotted = F.regexp_extract(bare, r"([0-9]+\.[0-9.]+)$", 1)
    df = stage(df, _v4=F.when(dotted != "", ipv4_number(dotted)))
    hexed = F.concat(
        F.regexp_replace(bare, r"[0-9]+\.[0-9.]+$", ""),
        F.hex(F.shiftright("_v4", 16)), F.lit(":"), F.hex(F.col("_v4").bitwiseAND(65535)),
    )
    df = stage(df, _t=F.when(dotted != "", hexed).otherwise(bare))
    sides = F.split("_t", "::")
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    head, tail = groups(F.get(sides, 0)), groups(F.coalesce(F.get(sides, 1), F.lit("")))
    fill = F.lit(8) - F.size(head) - F.size(tail)
    df = stage(
        df,
        _g=F.when(F.size(sides) == 1, head).when(
            (F.size(sides) == 2) & (fill >= 0),
            F.concat(head, F.array_repeat(F.lit("0"), F.greatest(fill, F.lit(0))), tail),
        ),
    )
    valid = (F.size("_g") == 8) & F.forall("_g", lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
    number = lambda g: F.conv(g, 16, 10).cast("int")
    df = stage(df, _n=F.when(valid, F.transform("_g", number)))
    n = lambda i: F.get("_n", i)
    embedded = F.concat_ws(
        ".", F.shiftright(n(6), 8), n(6).bitwiseAND(255), F.shiftright(n(7), 8), n(7).bitwiseAND(255)
    )
    v4 = ipv4_reason(embedded)
    zeros = lambda k: F.forall(F.slice("_n", 1, k), lambda g: g == 0)
    mapped, nat64 = zeros(5) & (n(5) == 0xFFFF), (n(0) == 0x64) & (n(1) == 0xFF9B)
    masked = lambda mask, value: n(0).bitwiseAND(mask) == value
    reason = (
        F.when(F.col("_n").isNull(), "not a valid IPv6 address")
        .when(zeros(8), "unspecified address")
        .when(zeros(7) & (n(7) == 1), "loopback address")
        .when(mapped, F.when(v4.isNotNull(), F.concat(F.lit("IPv4-mapped "), v4)))
        .when(nat64, F.when(v4.isNotNull(), F.concat(F.lit("NAT64-embedded "), v4)))
        .when(masked(0xFE00, 0xFC00), "unique local address (fc00::/7)")
        .when(masked(0xFFC0, 0xFE80), "link-local address (fe80::/10)")
        .when(masked(0xFF00, 0xFF00), "multicast address")
        .when((n(0) == 0x2001) & (n(1).bitwiseAND(0xFF00) == 0), "IETF special-purpose range (2001::/23)")
        .when(n(0) == 0x2002, "deprecated 6to4 range")
        .when((n(0) == 0x100) & (n(1) == 0), "discard-only range")
    )
    return stage(df, **{out: reason}).drop("_v4", "_t", "_g", "_n")
