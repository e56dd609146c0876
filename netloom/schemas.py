"""Schemas of the logs, the protocol events, packets and the sensor inventory."""

from __future__ import annotations

from pyspark.sql import types as T

# Column name in the log file, and its declared log type. Address, port and
# protocol columns carry the name used inside DataFrames; ``FILE_NAMES`` gives
# the dotted name used in files.
LOGS: dict[str, list[tuple[str, str]]] = {
    "conn": [
        ("ts", "time"), ("uid", "string"),
        ("orig_h", "addr"), ("orig_p", "port"), ("resp_h", "addr"), ("resp_p", "port"),
        ("proto", "enum"),
    ],
    "dns": [
        ("ts", "time"), ("uid", "string"),
        ("orig_h", "addr"), ("orig_p", "port"), ("resp_h", "addr"), ("resp_p", "port"),
        ("proto", "enum"), ("query", "string"), ("qtype_name", "string"),
        ("answers", "vector[string]"),
    ],
    "dhcp": [
        ("ts", "time"), ("uids", "set[string]"), ("mac", "string"),
        ("client_addr", "addr"), ("server_addr", "addr"),
        ("requested_addr", "addr"), ("assigned_addr", "addr"),
        ("host_name", "string"), ("lease_time", "interval"), ("param_req_list", "string"),
    ],
    "ja3_ja4": [
        ("ts", "time"), ("uid", "string"),
        ("orig_h", "addr"), ("orig_p", "port"), ("resp_h", "addr"), ("resp_p", "port"),
        ("ja3", "string"), ("ja3_hash", "string"), ("ja4", "string"), ("ja4_hash", "string"),
        ("client_version", "string"), ("cipher_suites", "vector[string]"),
        ("extensions", "vector[string]"), ("server_name", "string"), ("user_agent", "string"),
    ],
    "ja4s": [
        ("ts", "time"), ("uid", "string"),
        ("orig_h", "addr"), ("orig_p", "port"), ("resp_h", "addr"), ("resp_p", "port"),
        ("ja4s", "string"), ("ja4s_hash", "string"), ("server_version", "string"),
        ("server_cipher", "string"), ("server_extensions", "vector[string]"),
        ("server_name", "string"),
    ],
}

# The one list every multi-log step works from, in upload order of the logs.
LOG_NAMES = tuple(LOGS)

FILE_NAMES = {
    "orig_h": "id.orig_h", "orig_p": "id.orig_p",
    "resp_h": "id.resp_h", "resp_p": "id.resp_p",
}
COLUMN_NAMES = {v: k for k, v in FILE_NAMES.items()}

# Columns that hold one address, and columns that hold a set with addresses in it.
ADDRESS_COLUMNS = (
    "orig_h", "resp_h", "client_addr", "server_addr", "requested_addr", "assigned_addr",
)
ADDRESS_SET_COLUMNS = ("answers",)

_SCALAR_TYPES: dict[str, T.DataType] = {
    "time": T.TimestampType(),
    "interval": T.DecimalType(18, 6),
    "port": T.IntegerType(),
    "count": T.LongType(),
    "int": T.LongType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
}


def spark_type(log_type: str) -> T.DataType:
    """Spark type of a log type; anything not numeric, time or set is text."""
    if log_type.startswith(("set[", "vector[")):
        return T.ArrayType(T.StringType())
    return _SCALAR_TYPES.get(log_type, T.StringType())


def log_schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, spark_type(t)) for c, t in LOGS[name]])


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "binary": T.BinaryType(), "bigints": T.ArrayType(T.LongType()),
    "options": T.MapType(T.IntegerType(), T.BinaryType()),
}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


CLIENT_HELLO = _struct(
    seq="bigint", ts="timestamp", conn_start="timestamp", uid="string", orig_h="string", orig_p="int",
    resp_h="string", resp_p="int", version="bigint", ciphers="bigints", server_name="string",
    resumed="boolean", curve="string", next_protocol="string",
)
SERVER_HELLO = _struct(
    seq="bigint", ts="timestamp", conn_start="timestamp", uid="string", orig_h="string", orig_p="int",
    resp_h="string", resp_p="int", version="bigint", cipher="bigint", server_name="string",
)
TLS_EXTENSION = _struct(seq="bigint", ts="timestamp", uid="string", is_orig="boolean", code="bigint")
HTTP_HEADER = _struct(
    seq="bigint", ts="timestamp", uid="string", orig_h="string", orig_p="int", is_orig="boolean",
    name="string", value="string",
)
TLS_EVENTS = {
    "client_hello": CLIENT_HELLO,
    "server_hello": SERVER_HELLO,
    "tls_extension": TLS_EXTENSION,
    "http_header": HTTP_HEADER,
}

PACKETS = _struct(
    run_id="string", file="string", packet_no="bigint", ts="timestamp", eth_src="string", eth_dst="string",
    ip_src="string", ip_dst="string", proto="int", sport="int", dport="int", length="bigint", payload="binary",
)
DHCP_MESSAGES = _struct(run_id="string", packet_no="bigint", op="int", mac="string", options="options")
INVENTORY = _struct(
    sensor_id="string", pos="int", name="string", mac="string", ip="string", up="boolean", loopback="boolean"
)
