"""Small text expressions: separators, lists, stamps, names, MAC addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_OUTER_SPACE = r"(?U)^\s+|\s+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_separator(line: Column | str) -> Column:
    r"""The separator a ``#separator \x09`` line declares; tab if it declares none."""
    rest = F.trim(F.regexp_extract(_c(line), r"^#separator (.*)$", 1))
    code = F.regexp_extract(rest, r"^\\x([0-9A-Fa-f]{1,2})$", 1)
    return (
        F.when(code != "", F.chr(F.conv(code, 16, 10).try_cast("int")))
        .when(rest != "", rest)
        .otherwise(F.lit("\t"))
    )


def list_entries(col: Column | str) -> Column:
    """Array of the trimmed, non-blank entries of a comma list."""
    bare = F.transform(F.split(_c(col), ","), lambda x: F.regexp_replace(x, _OUTER_SPACE, ""))
    return F.filter(bare, lambda x: x != "")


def byte_list(col: Column | str) -> Column:
    """``1,3,6,15`` for the bytes 01 03 06 0f; empty for no bytes."""
    digits = F.hex(_c(col))
    size = F.octet_length(_c(col))
    values = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10),
    )
    return F.when(size > 0, F.array_join(values, ",")).when(size == 0, F.lit(""))


def mac_text(col: Column | str) -> Column:
    """Lower-case colon-separated text of a binary hardware address."""
    return F.lower(F.regexp_replace(F.hex(_c(col)), "(..)(?!$)", "$1:"))


def utc_stamp(ts: Column | str) -> Column:
    """``20240131T235959Z`` (the session time zone is UTC)."""
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss'Z'")


def utc_stamp_fine(ts: Column | str) -> Column:
    """As ``utc_stamp`` with nine fraction digits, of which Spark knows six."""
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss.SSSSSSSSS'Z'")


def backlog_name(ts: Column | str) -> Column:
    """Name of an unsent payload; names sort by time."""
    nanos = (F.unix_micros(_c(ts)) * 1000).cast("string")
    return F.concat(F.lit("buf_"), utc_stamp(ts), F.lit("_"), nanos, F.lit(".bin"))


def run_folder(ts: Column | str) -> Column:
    """Name of a capture window's folder."""
    return F.concat(F.lit("zeek_out_"), utc_stamp_fine(ts))


def is_capture_name(col: Column | str) -> Column:
    """True for names ending in .pcap or .pcapng, in any case."""
    return F.lower(_c(col)).rlike(r"[.]pcap(ng)?$")


def chunk_name(path: Column | str, number: Column | str) -> Column:
    """``dir/conn_chunk_2.log`` for ``dir/conn.log`` and 2."""
    name = _c(path)
    stem = F.regexp_extract(name, r"^(.*?)([.][^./]*)?$", 1)
    extension = F.regexp_extract(name, r"^(.*?)([.][^./]*)?$", 2)
    return F.concat(stem, F.lit("_chunk_"), _c(number).cast("string"), extension)


def machine_id(mac: Column | str) -> Column:
    """SHA-256 of the MAC text; unsalted. A sensor without one shares a fixed text."""
    return F.sha2(F.coalesce(_c(mac), F.lit("unknown-device")), 256)


def network_id_valid(col: Column | str) -> Column:
    """1-64 bytes after trimming; letters, digits, inner space, hyphen, underscore.

    Underscores are allowed, the placeholder of a sample configuration is not.
    """
    value = F.regexp_replace(_c(col), _OUTER_SPACE, "")
    return F.coalesce(
        value.rlike(r"^[a-zA-Z0-9](?:[a-zA-Z0-9_ -]*[a-zA-Z0-9])?\z")
        & (F.octet_length(value) <= 64)
        & (value != "REPLACE_WITH_YOUR_NETWORK_ID"),
        F.lit(False),
    )


def is_private_v4(hex_col: Column | str) -> Column:
    """True for an ``ip_hex`` inside 10/8, 172.16/12 or 192.168/16."""
    return F.coalesce(_c(hex_col).rlike("^0{20}ffff(?:0a|ac1|c0a8)"), F.lit(False))
