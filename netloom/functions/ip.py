"""IP addresses and subnets as column expressions.

An address becomes ``ip_hex``: the 32 lower-case hex digits of its 16-byte form,
IPv4 as ``00000000000000000000ffff`` plus eight digits. An IPv6-mapped IPv4
address is the IPv4 address. Text that is not an address gives NULL: leading-zero
octets, zone suffixes, host names, unset markers. A subnet never contains an
address of the other family.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V4_PREFIX = "00000000000000000000ffff"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_GROUP = "[0-9a-f]{1,4}"
_V6_FULL = f"^(?:{_GROUP}:){{7}}{_GROUP}$"
_V6_SHORT = f"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _v4_digits(ip: Column) -> Column:
    """Eight hex digits of a dotted quad, NULL if it is none."""
    upper = F.substring_index(ip, ".", 2)
    lower = F.substring_index(ip, ".", -2)

    def octet(text: Column) -> Column:
        return text.try_cast("bigint")

    number = (
        octet(F.substring_index(upper, ".", 1)) * 16777216
        + octet(F.substring_index(upper, ".", -1)) * 65536
        + octet(F.substring_index(lower, ".", 1)) * 256
        + octet(F.substring_index(lower, ".", -1))
    )
    return F.when(ip.rlike(_V4), F.lpad(F.lower(F.hex(number)), 8, "0"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v6_digits(ip: Column) -> Column:
    def without_quad(quad: Column) -> Column:
        head = F.substr(ip, F.lit(1), F.length(ip) - F.length(F.substring_index(ip, ":", -1)))
        return F.concat(head, F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4))

    plain = F.lower(
        F.when(ip.contains("."), _let(_v4_digits(F.substring_index(ip, ":", -1)), without_quad)).otherwise(ip)
    )

    def groups(side: Column) -> Column:
        return F.filter(F.split(side, ":"), lambda g: g != "")

    def filled(sides: Column) -> Column:
        used = F.size(F.get(sides, F.lit(0))) + F.size(F.get(sides, F.lit(1)))
        zeros = F.array_repeat(F.lit("0000"), F.lit(8) - used)
        return F.when(used <= 7, F.concat(F.get(sides, F.lit(0)), zeros, F.get(sides, F.lit(1))))

    def expanded(text: Column) -> Column:
        """The text's groups, with the zero groups ``::`` stands for."""
        sides = F.array(groups(F.substring_index(text, "::", 1)), groups(F.substring_index(text, "::", -1)))
        return F.when(text.rlike(_V6_FULL), F.split(text, ":")).when(text.rlike(_V6_SHORT), _let(sides, filled))

    padded = F.transform(_let(plain, expanded), lambda g: F.lpad(g, 4, "0"))
    return F.array_join(padded, "")


def ip_hex(col: Column | str) -> Column:
    """Sort-preserving 32-digit key of an address, NULL for anything else."""
    ip = _c(col)
    return F.when(ip.contains(":"), _v6_digits(ip)).otherwise(
        F.concat(F.lit(V4_PREFIX), _v4_digits(ip))
    )


def ip_family(hex_col: Column | str) -> Column:
    """``4`` or ``6`` for an ``ip_hex`` value."""
    key = _c(hex_col)
    return F.when(key.startswith(V4_PREFIX), F.lit("4")).when(key.isNotNull(), F.lit("6"))


# --- subnets given as a short list (configuration) ---------------------------


@dataclass(frozen=True)
class Cidr:
    """A subnet: family, number of fixed bits of the 128, lowest and highest key."""

    family: str
    bits: int
    lo: str
    hi: str

    def nibble_prefixes(self) -> list[str]:
        """Hex-digit prefixes (at most eight) that together are this subnet."""
        digits = -(-self.bits // 4)
        if digits == 0:
            return [""]
        stem, last = self.lo[: digits - 1], int(self.lo[digits - 1], 16)
        return [f"{stem}{last + i:x}" for i in range(1 << (4 * digits - self.bits))]


def parse_cidr(text: str) -> Cidr | None:
    """One subnet, or None if the text is not one. Host bits are masked off."""
    match = re.fullmatch(r"([^/%]+)/([0-9]+)", text)
    if not match:
        return None
    try:
        address = ipaddress.ip_address(match.group(1))
    except ValueError:
        return None
    length = int(match.group(2))
    if length > address.max_prefixlen:
        return None
    raw, bits = int(address), length
    if address.version == 4:
        raw, bits = raw | (0xFFFF << 32), length + 96
    size = 1 << (128 - bits)
    low = raw - raw % size
    lo, hi = f"{low:032x}", f"{low + size - 1:032x}"
    family = "4" if bits >= 96 and lo.startswith(V4_PREFIX) else "6"
    return Cidr(family, bits, lo, hi)


def split_list(text: str) -> list[str]:
    """Entries of a comma list, trimmed, blanks dropped."""
    return [part.strip() for part in text.split(",") if part.strip()]


def cidr_list(cidrs: str | list[str], strict: bool = True) -> list[Cidr]:
    """Subnets of a list or a comma string.

    ``strict`` raises on a bad entry; otherwise bad entries are left out. Everything
    that publishes data uses the strict form, since leaving one out filters less.
    """
    entries = split_list(cidrs) if isinstance(cidrs, str) else [c.strip() for c in cidrs if c.strip()]
    parsed = [(entry, parse_cidr(entry)) for entry in entries]
    bad = [entry for entry, cidr in parsed if cidr is None]
    if strict and bad:
        raise ValueError(f"invalid CIDR entries: {bad}")
    return [cidr for _, cidr in parsed if cidr is not None]


def cidr_pattern(cidrs: list[Cidr]) -> str:
    """Regular expression for the start of an ``ip_hex`` value inside any of ``cidrs``."""
    parts = []
    for cidr in cidrs:
        full, loose = divmod(cidr.bits, 4)
        text = cidr.lo[:full]
        if loose:
            first = int(cidr.lo[full], 16)
            text += "[" + "".join(f"{first + i:x}" for i in range(1 << (4 - loose))) + "]"
        if cidr.family == "6" and V4_PREFIX.startswith(cidr.lo[: min(full, 24)]):
            text = f"(?!{V4_PREFIX}){text}"
        parts.append(text)
    return "^(?:" + "|".join(dict.fromkeys(parts)) + ")"


def quad_pattern(cidrs: list[Cidr]) -> str | None:
    """Regular expression for a valid dotted quad inside any of the IPv4 ``cidrs``."""
    parts = []
    for cidr in cidrs:
        if cidr.family != "4":
            continue
        low = int(cidr.lo[24:], 16).to_bytes(4, "big")
        full, loose = divmod(cidr.bits - 96, 8)
        octets = [str(value) for value in low[:full]]
        if loose:
            octets.append("(?:" + "|".join(str(low[full] + i) for i in range(1 << (8 - loose))) + ")")
        octets += [_OCTET] * (4 - len(octets))
        parts.append(r"\.".join(octets))
    return "^(?:" + "|".join(dict.fromkeys(parts)) + ")$" if parts else None


def _colon_hint(cidrs: list[Cidr]) -> str:
    """Regular expression that any text with a colon inside one of ``cidrs`` matches.

    It spares most IPv6 addresses the conversion: a subnet whose first digit is not 0
    shows in the text as written, and a mapped IPv4 address has a group ``ffff``.
    """
    hints = []
    for cidr in cidrs:
        if cidr.family == "4":
            hints.append("ffff:")
        elif cidr.bits < 4 or cidr.lo[0] == "0":
            return ""
        else:
            hints.append("^" + cidr.lo[: min(cidr.bits // 4, 4)])
    return "(?i)" + "|".join(dict.fromkeys(hints))


def quad_in_cidrs(address: Column, cidrs: list[Cidr]) -> Column:
    """``in_cidrs`` for dotted quads: matched as they are written."""
    quads = quad_pattern(cidrs)
    return F.coalesce(address.rlike(quads), F.lit(False)) if quads else F.lit(False)


def colon_in_cidrs(address: Column, cidrs: list[Cidr]) -> Column:
    """``in_cidrs`` for text with a colon: turned into its key if it can be inside."""
    inside = address.rlike(_colon_hint(cidrs)) & ip_hex(address).rlike(cidr_pattern(cidrs))
    return F.coalesce(address.contains(":") & inside, F.lit(False))


def in_cidrs(address: Column | str, cidrs: list[Cidr]) -> Column:
    """True if the text is an address inside one of ``cidrs``, never NULL.

    One pattern tests all subnets.
    """
    return quad_in_cidrs(_c(address), cidrs) | colon_in_cidrs(_c(address), cidrs)


# --- subnets given as a table ------------------------------------------------


def _cidr_struct(col: Column) -> Column:
    """``family, bits, lo, hi`` of subnet text, NULL if it is none."""
    text = F.trim(col)
    shape = text.rlike("^[^/]+/[0-9]+$")
    v6 = text.contains(":")
    length = F.when(shape, F.substring_index(text, "/", -1)).try_cast("int")
    bits = F.when(v6 & (length <= 128), length).when(~v6 & (length <= 32), length + 96)
    parsed = F.struct(F.when(shape, ip_hex(F.substring_index(text, "/", 1))).alias("key"), bits.alias("bits"))

    def bounds(p: Column) -> Column:
        full, loose = F.floor(p["bits"] / 4).cast("int"), p["bits"] % 4
        step = F.get(F.array(*[F.lit(n) for n in (16, 8, 4, 2)]), loose)
        digit = F.conv(F.substr(p["key"], full + 1, F.lit(1)), 16, 10).try_cast("int")
        stem = F.substr(p["key"], F.lit(1), full)

        def bound(nibble: Column, filler: str) -> Column:
            middle = F.when(loose > 0, F.lower(F.hex(nibble))).otherwise(F.lit(""))
            return F.rpad(F.concat(stem, middle), 32, filler)

        low = digit - digit % step
        return F.struct(
            p["bits"].alias("bits"), bound(low, "0").alias("lo"), bound(low + step - 1, "f").alias("hi")
        )

    def with_family(b: Column) -> Column:
        v4 = (b["bits"] >= 96) & b["lo"].startswith(V4_PREFIX)
        family = F.when(v4, F.lit("4")).otherwise(F.lit("6"))
        return F.struct(family.alias("family"), b["bits"].alias("bits"), b["lo"].alias("lo"), b["hi"].alias("hi"))

    return _let(
        parsed, lambda p: F.when(p["key"].isNotNull() & p["bits"].isNotNull(), _let(bounds(p), with_family))
    )


def cidr_columns(table: DataFrame, col: str) -> DataFrame:
    """Adds ``valid, family, bits, lo, hi`` for the subnet text in ``col``."""
    return (
        table.withColumn("_cidr", _cidr_struct(F.col(col)))
        .withColumn("valid", F.col("_cidr").isNotNull())
        .select(*table.columns, "valid", "_cidr.*")
    )


def cidr_prefixes(col: Column | str) -> Column:
    """Array of the text prefixes of ``lookup_key`` that together are a subnet.

    Prefixes end on a hex digit, so there are at most eight, and containment turns
    into equality with one of an address's own prefixes. NULL for no subnet.
    """

    def expand(c: Column) -> Column:
        digits = F.ceil(c["bits"] / 4).cast("int")
        count = F.get(F.array(*[F.lit(n) for n in (1, 8, 4, 2)]), c["bits"] % 4)
        first = F.conv(F.substr(c["lo"], digits, F.lit(1)), 16, 10).try_cast("int")
        stem = F.concat(c["family"], F.substr(c["lo"], F.lit(1), digits - 1))
        steps = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.concat(stem, F.lower(F.hex(first + i)))
        )
        return F.when(digits == 0, F.array(c["family"])).otherwise(steps)

    return _let(_cidr_struct(_c(col)), expand)


def lookup_prefixes(col: Column | str, lengths: list[int]) -> Column:
    """An address's own prefixes (family digit and hex digits) of the given lengths."""

    def prefixes(key: Column) -> Column:
        text = F.concat(ip_family(key), key)
        return F.array(*[F.substring(text, 1, n) for n in lengths])

    return _let(ip_hex(col), prefixes)
