"""Network addresses as bit strings, so that a range test is a prefix test.

``ip_bits`` turns an IPv4 address into ``4:`` + 32 binary digits and an IPv6 address into
``6:`` + 128; anything else is null. A range is the same string cut after its prefix length.
Versions never mix, and ``/0`` is just the two-character family mark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequill.functions.basics import let, nonempty
from sitequill.functions.text import header_text, trim_all

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"{_OCTET}(?:[.]{_OCTET}){{3}}"
NO_ADDRESS = "0.0.0.0"


def _number(ip: str) -> str:
    return f"aggregate(split({ip}, '[.]'), 0L, (total, o) -> total * 256 + CAST(o AS BIGINT))"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _side(n: int) -> str:
    side = f"get(sides, {n})"
    return f"CASE WHEN {side} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({side}, ':', -1) END"


# SQL lambdas, so that the driver sends one expression. A dotted tail is first written as two
# hexadecimal groups, then "::" is filled up to eight groups.
_PLAIN = _let(
    f"regexp_extract(ip, ':({IPV4})$', 1)",
    "tail",
    f"""CASE WHEN tail = '' THEN ip ELSE concat(substr(ip, 1, length(ip) - length(tail)),
      hex(shiftright({_number("tail")}, 16)), ':', hex({_number("tail")} & 65535L)) END""",
)
_GROUPS = f"""CASE
  WHEN size(sides) = 1 THEN split(get(sides, 0), ':', -1)
  WHEN size(sides) = 2 THEN {_let(
      f"named_struct('l', {_side(0)}, 'r', {_side(1)})",
      "h",
      "CASE WHEN size(h.l) + size(h.r) <= 7 THEN"
      " concat(h.l, array_repeat('0', 8 - size(h.l) - size(h.r)), h.r) END",
  )} END"""
_V6_BITS = """CASE
  WHEN size(g) = 8 AND forall(g, x -> x RLIKE '^[0-9a-fA-F]{1,4}$')
  THEN concat('6:', array_join(transform(g, x -> lpad(conv(x, 16, 2), 16, '0')), '')) END"""
_IP_BITS = f"""ip -> CASE
  WHEN ip RLIKE '^{IPV4}$' THEN concat('4:', lpad(bin({_number("ip")}), 32, '0'))
  WHEN ip RLIKE '^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$'
  THEN {_let(f"split({_PLAIN}, '::', -1)", "sides", _let(_GROUPS, "g", _V6_BITS))} END"""
_RANGE_PREFIX = f"""entry -> CASE WHEN entry RLIKE '^[^/]+/[0-9]{{1,3}}$' THEN
  get(transform(
    transform(array(named_struct('net', split_part(entry, '/', 1),
      'size', CAST(split_part(entry, '/', 2) AS INT))),
      r -> named_struct('size', r.size, 'bits', get(transform(array(r.net), {_IP_BITS}), 0))),
    r -> CASE WHEN r.size <= length(r.bits) - 2 THEN substr(r.bits, 1, r.size + 2) END), 0) END"""


def _apply(sql_lambda: str, c: Column) -> Column:
    return F.element_at(F.call_function("transform", F.array(c), F.expr(sql_lambda)), 1)


def ip_bits(ip: Column) -> Column:
    return _apply(_IP_BITS, ip)


def is_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(f"^{IPV4}$"), F.lit(False)) | F.coalesce(ip_bits(ip).isNotNull(), F.lit(False))


def range_prefix(entry: Column) -> Column:
    """Bit prefix of a range ``address/length``; null when it is not a valid range.

    The length has to be a number: a word after the slash is rejected, not read as zero.
    """
    return _apply(_RANGE_PREFIX, entry)


def is_ip_or_range(entry: Column) -> Column:
    return F.when(entry.contains("/"), range_prefix(entry).isNotNull()).otherwise(is_ip(entry))


def valid_entries(entries: Column) -> Column:
    """Keep the valid addresses and ranges as (entry, prefix); prefix is null for an address."""
    tidy = F.filter(F.transform(entries, header_text), nonempty)
    return F.transform(
        F.filter(tidy, is_ip_or_range),
        lambda e: F.struct(e.alias("entry"), range_prefix(e).alias("prefix")),
    )


def in_range(bits: Column, prefix: Column) -> Column:
    return F.coalesce(bits.startswith(prefix), F.lit(False))


def is_trusted(peer: Column, proxies: Column) -> Column:
    """Exact text match with an entry, or inside one of the ranges."""
    return F.coalesce(
        let(
            ip_bits(peer),
            lambda bits: F.exists(
                proxies, lambda p: (p["entry"] == peer) | in_range(bits, p["prefix"])
            ),
        ),
        F.lit(False),
    )


def _first_of_list(header: Column) -> Column:
    return let(
        header_text(header),
        lambda h: F.when(h.contains(","), trim_all(F.split_part(h, F.lit(","), F.lit(1))))
        .otherwise(h),
    )


def client_ip(peer: Column, proxies: Column, headers: list[Column]) -> Column:
    """The peer, unless it is trusted: then the first forwarding header with a valid address."""

    def judge(address: Column) -> Column:
        checked_peer = F.when(is_ip(address), address).otherwise(F.lit(NO_ADDRESS))
        # One header after the other, so that those behind the first valid address stay unread.
        forwarded = [let(_first_of_list(h), lambda a: F.when(is_ip(a), a)) for h in headers]
        return F.when(
            is_trusted(address, proxies), F.coalesce(*forwarded, checked_peer)
        ).otherwise(checked_peer)

    return let(F.when(peer.isNull(), F.lit(NO_ADDRESS)).otherwise(header_text(peer)), judge)
