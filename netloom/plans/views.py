"""The sample tables seen as sensor data.

The sample tables have no network columns. Each view below is one SQL text that both
Spark and DuckDB run on the tables, made of integer arithmetic and text only, so the
two can be compared. ``{events}`` and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONN = """
SELECT substr(CAST(l_shipdate AS STRING), 1, 7) AS run_id, l_shipdate AS ts,
  concat('C', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS uid,
  concat(CASE l_suppkey % 4 WHEN 0 THEN '10' WHEN 1 THEN '192' WHEN 2 THEN '172' ELSE '203' END,
         '.', l_suppkey % 256, '.', l_partkey % 256, '.', l_linenumber) AS orig_h,
  CAST(1024 + l_orderkey % 50000 AS INT) AS orig_p,
  CASE l_partkey % 6
    WHEN 0 THEN concat('fd00::', l_linenumber, ':', l_suppkey % 1000)
    WHEN 1 THEN concat('2606:4700::', l_suppkey % 1000)
    WHEN 2 THEN concat('10.', l_partkey % 256, '.0.', l_linenumber)
    WHEN 3 THEN '-host-'
    ELSE concat('8.', l_partkey % 256, '.', l_suppkey % 256, '.8') END AS resp_h,
  CAST(CASE l_linenumber % 3 WHEN 0 THEN 443 WHEN 1 THEN 53 ELSE 80 END AS INT) AS resp_p,
  CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'R' THEN 'udp' ELSE 'icmp' END AS proto
FROM {lineitem}
"""

DNS = """
SELECT substr(CAST(ts AS STRING), 1, 7) AS run_id, ts, concat('D', event_id) AS uid,
  concat('192.168.', user_id % 256, '.', event_id % 200 + 1) AS orig_h,
  CAST(1024 + event_id % 60000 AS INT) AS orig_p,
  concat(CASE event_id % 10 WHEN 0 THEN '10' ELSE '9' END, '.9.9.9') AS resp_h,
  CAST(53 AS INT) AS resp_p, 'udp' AS proto,
  concat(event_type, user_id, '.example.com') AS query,
  CASE event_id % 2 WHEN 0 THEN 'A' ELSE 'AAAA' END AS qtype_name,
  CASE WHEN event_id % 7 = 0 THEN NULL
    WHEN event_id % 7 = 1 THEN concat('fd00::', user_id % 10000)
    WHEN event_id % 7 = 2 THEN concat('alias', user_id, '.invalid,10.77.', user_id % 256, '.6')
    WHEN event_id % 7 = 3 THEN concat('alias', user_id, '.invalid')
    ELSE concat('alias', user_id, '.invalid,198.51.', user_id % 256, '.81') END AS answers
FROM {events}
"""

_MAC = (
    "concat(substr(h, 1, 2), ':', substr(h, 3, 2), ':', substr(h, 5, 2), ':',"
    " substr(h, 7, 2), ':', substr(h, 9, 2), ':', substr(h, 11, 2))"
)

DHCP = f"""
SELECT concat('R', c_custkey % 4) AS run_id, c_custkey AS row_no, {_MAC} AS mac,
  CASE c_custkey % 3 WHEN 0 THEN NULL ELSE concat('192.168.7.', c_custkey % 256) END AS client_addr,
  '192.168.7.1' AS server_addr,
  CASE c_custkey % 11 WHEN 0 THEN '10.9.9.9' ELSE NULL END AS requested_addr,
  concat(CASE c_custkey % 5 WHEN 0 THEN '10' ELSE '11' END, '.0.', c_custkey % 256, '.50') AS assigned_addr,
  c_name AS host_name,
  CASE c_custkey % 5 WHEN 2 THEN '61,55' ELSE NULL END AS param_req_list
FROM (SELECT c_custkey, c_name, md5(c_name) AS h FROM {{customer}}) c
"""

# Every priority stands for one client type; the last one sends an empty list.
DHCP_MESSAGES = f"""
SELECT concat('R', o_custkey % 4) AS run_id, o_orderkey AS packet_no,
  CAST(CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS INT) AS op, h AS client_hash, {_MAC} AS mac,
  CASE o_orderpriority WHEN '1-URGENT' THEN '2A0C330679' WHEN '2-HIGH' THEN '2A0C1A03'
    WHEN '3-MEDIUM' THEN '7842060C' WHEN '4-NOT SPECIFIED' THEN '0C' ELSE '' END AS params,
  CASE o_orderpriority WHEN '1-URGENT' THEN '42,12,51,6,121' WHEN '2-HIGH' THEN '42,12,26,3'
    WHEN '3-MEDIUM' THEN '120,66,6,12' WHEN '4-NOT SPECIFIED' THEN '12' ELSE '' END AS params_text
FROM (SELECT *, md5(concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0'))) AS h FROM {{orders}}) o
"""

# A TLS connection is a user slot within 256 consecutive events, so it stays as short
# as a real one however the events are distributed.
TLS = """
SELECT event_id AS seq, event_type, user_id, props, concat('T', slot, '-', part) AS uid,
  1700000000 + part * 60 AS conn_start,
  concat('10.', part % 256, '.', slot, '.7') AS orig_h,
  CAST(20000 + (part * 16 + slot) % 40000 AS INT) AS orig_p,
  concat('93.184.', user_id % 256, '.34') AS resp_h, CAST(443 AS INT) AS resp_p
FROM (SELECT *, CAST(floor(event_id / 256) AS BIGINT) AS part, user_id % 16 AS slot FROM {events}) e
"""

CLIENT_HELLO = f"""
SELECT seq, uid, conn_start, orig_h, orig_p, resp_h, resp_p, CAST(771 + seq % 2 AS BIGINT) AS version,
  CASE seq % 6 WHEN 0 THEN '' ELSE concat(4865 + seq % 3, ',', 49195 + user_id % 5) END AS ciphers,
  CASE seq % 3 WHEN 0 THEN NULL ELSE concat('h', user_id, '.example.com') END AS server_name,
  CASE seq % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS resumed,
  CASE seq % 4 WHEN 0 THEN 'x25519' WHEN 1 THEN '' ELSE NULL END AS curve,
  CASE seq % 7 WHEN 0 THEN 'h2' WHEN 1 THEN '' ELSE NULL END AS next_protocol
FROM ({TLS}) t WHERE event_type IN ('view', 'signup')
"""

SERVER_HELLO = f"""
SELECT seq, uid, conn_start, orig_h, orig_p, resp_h, resp_p, CAST(771 + seq % 2 AS BIGINT) AS version,
  4865 + seq % 3 AS cipher,
  CASE seq % 3 WHEN 0 THEN NULL ELSE concat('h', user_id, '.example.com') END AS server_name
FROM ({TLS}) t WHERE event_type = 'purchase'
"""

TLS_EXTENSION = f"""
SELECT seq, uid, seq % 4 = 0 AS is_orig, seq % 52 AS code
FROM ({TLS}) t WHERE event_type = 'click'
"""

HTTP_HEADER = f"""
SELECT seq, CASE seq % 3 WHEN 0 THEN uid ELSE concat('H', seq) END AS uid, orig_h,
  CASE seq % 3 WHEN 2 THEN 1 ELSE orig_p END AS orig_p, seq % 4 <> 0 AS is_orig,
  CASE seq % 5 WHEN 0 THEN 'HOST' ELSE 'USER-AGENT' END AS name,
  CASE seq % 10 WHEN 1 THEN '' ELSE concat('agent ', props) END AS value
FROM ({TLS}) t WHERE event_type = 'error'
"""

PACKETS = """
SELECT concat('W', substr(CAST(ts AS STRING), 1, 7)) AS run_id, event_id AS packet_no, ts,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN concat('10.0.', user_id % 256, '.1')
    ELSE concat('93.184.', user_id % 256, '.34') END AS ip_src,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN concat('93.184.', user_id % 256, '.34')
    ELSE concat('10.0.', user_id % 256, '.1') END AS ip_dst,
  CAST(CASE user_id % 2 WHEN 0 THEN 6 ELSE 17 END AS INT) AS proto,
  CAST(CASE WHEN event_type IN ('view', 'click', 'error') THEN 40000 + user_id % 1000 ELSE 443 END AS INT) AS sport,
  CAST(CASE WHEN event_type IN ('view', 'click', 'error') THEN 443 ELSE 40000 + user_id % 1000 END AS INT) AS dport,
  60 + event_id % 1400 AS length
FROM {events}
"""

LOG_LINES = """
SELECT concat('R', o_orderkey % 4) AS run_id, 'conn' AS log, o_orderkey AS line_no,
  concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) AS line FROM {orders}
UNION ALL
SELECT concat('R', event_id % 4), 'dns', event_id, concat_ws('|', event_id, user_id, event_type, props) FROM {events}
UNION ALL
SELECT concat('R', c_custkey % 3), 'dhcp', c_custkey, concat_ws('|', c_custkey, c_name, c_mktsegment) FROM {customer}
UNION ALL
SELECT concat('R', doc_id % 4), 'ja3_ja4', doc_id, replace(text, chr(10), ' ') FROM {documents}
UNION ALL
SELECT 'R0', 'ja4s', s_suppkey, concat_ws('|', s_suppkey, s_name) FROM {supplier}
"""

INVENTORY = f"""
SELECT concat('sensor', c_nationkey) AS sensor_id, CAST(c_custkey AS INT) AS pos,
  concat(CASE c_custkey % 7 WHEN 0 THEN 'lo' WHEN 1 THEN 'eth' WHEN 2 THEN 'en' WHEN 3 THEN 'wlan'
    WHEN 4 THEN 'wl' ELSE 'tun' END, c_custkey) AS name,
  CASE c_custkey % 3 WHEN 0 THEN NULL ELSE {_MAC} END AS mac,
  CASE c_custkey % 6 WHEN 0 THEN concat('10.0.', c_custkey % 13, '.1')
    WHEN 1 THEN concat('172.', c_custkey % 64, '.0.1') WHEN 2 THEN concat('192.168.', c_custkey % 30, '.1')
    WHEN 3 THEN concat('8.8.', c_custkey % 256, '.8') WHEN 4 THEN concat('fd00::', c_custkey % 100)
    ELSE concat('10.1.', c_custkey % 40, '.2') END AS ip,
  c_custkey % 9 <> 0 AS up, c_custkey % 7 = 0 AS loopback
FROM (SELECT *, md5(c_name) AS h FROM {{customer}}) c
"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A view's SQL over the sample tables of a folder."""
    used = {name: table(spark, folder, name) for name in TABLES if "{" + name + "}" in sql}
    return spark.sql(sql, **used)


def for_duckdb(sql: str) -> str:
    """The same text over the tables as DuckDB names them."""
    return sql.format(**{name: name for name in TABLES})


def conn(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, CONN)


def dns(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, DNS).withColumn("answers", F.split("answers", ","))


def dhcp(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, DHCP)


def dhcp_messages(spark: SparkSession, folder: str) -> DataFrame:
    options = F.create_map(F.lit(55), F.unhex("params"))
    return view(spark, folder, DHCP_MESSAGES).select("run_id", "packet_no", "op", "mac", options.alias("options"))


def client_hello(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.filter(F.split("ciphers", ","), lambda c: c != "").cast("array<bigint>")
    return (
        view(spark, folder, CLIENT_HELLO)
        .withColumn("ciphers", codes)
        .withColumn("conn_start", F.timestamp_seconds("conn_start"))
    )


def server_hello(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, SERVER_HELLO).withColumn("conn_start", F.timestamp_seconds("conn_start"))


def tls_extension(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, TLS_EXTENSION)


def http_header(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, HTTP_HEADER)


def packets(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, PACKETS).withColumn("ts", F.col("ts").cast("timestamp"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, LOG_LINES)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, INVENTORY)
