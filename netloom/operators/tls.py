"""TLS fingerprint rows from handshake and header events.

``seq`` numbers all events of a feed in order of arrival and decides what was known
when. The state kept per connection uid is: ts, uid and addresses of the first client
hello; version, ciphers and extensions of the latest; ja3 of the latest that had both
ciphers and extensions; the latest server name given.

Rows written:
 * on the first client hello of a uid, if ciphers and extensions are non-empty;
 * on every originator ``USER-AGENT`` header with a state: by uid, else by originator
   address and port (of several, the one with the latest hello);
 * on every server hello.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.tls import client_extensions, ja3, ja4, ja4s
from netloom.session import cut_lineage
from netloom.operators.ordered import BLOCK_BITS, asof_number, running_values

JA3_JA4_COLUMNS = (
    "ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "ja3", "ja3_hash", "ja4", "ja4_hash",
    "client_version", "cipher_suites", "extensions", "server_name", "user_agent",
)
JA4S_COLUMNS = (
    "ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "ja4s", "ja4s_hash", "server_version",
    "server_cipher", "server_extensions", "server_name",
)
_ID = ("ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p")


def described_hellos(client_hello: DataFrame) -> DataFrame:
    """Client hellos with version, ciphers and extensions as text, and ja3 if it applies."""
    version = F.col("version")
    hellos = client_hello.select(
        "seq", "uid",
        F.col("conn_start").alias("ts"), "orig_h", "orig_p", "resp_h", "resp_p",
        version.cast("string").alias("client_version"),
        F.coalesce(F.col("ciphers").cast("array<string>"), F.array().cast("array<string>")).alias("cipher_suites"),
        client_extensions(
            version, F.col("server_name"), F.col("resumed"), F.col("curve"), F.col("next_protocol")
        ).alias("extensions"),
        "server_name",
    )
    complete = (F.size("cipher_suites") > 0) & (F.size("extensions") > 0)
    return hellos.withColumn(
        "ja3", F.when(complete, ja3(F.col("client_version"), F.col("cipher_suites"), F.col("extensions")))
    )


def first_per_uid(events: DataFrame, order: str = "seq") -> DataFrame:
    """The first event of every uid.

    With the rank limit Spark keeps one row per uid and task before it shuffles.
    """
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(order))
    return events.withColumn("_n", rank).where("_n = 1").drop("_n")


def hello_rows(client_hello: DataFrame) -> DataFrame:
    """Rows written on client hellos. Later hellos of a uid write nothing,
    even if the first one could not be written."""
    none = F.lit(None).cast("string")
    return (
        first_per_uid(described_hellos(client_hello))
        .where("ja3 is not null")
        .withColumns({"ja3_hash": F.md5("ja3"), "ja4": none, "ja4_hash": none, "user_agent": none})
        .select(*JA3_JA4_COLUMNS)
    )


def states_after_hello(client_hello: DataFrame, block_bits: int = BLOCK_BITS, dense: bool = False) -> DataFrame:
    """For every client hello the state of its uid right after it.

    ``dense`` is for feeds whose ``seq`` has gaps (clock readings, say), here and below.
    """
    hellos = described_hellos(client_hello)
    known = running_values(
        hellos.withColumn("_id", F.struct(*_ID)).drop("ts", "orig_h", "orig_p", "resp_h", "resp_p"),
        ["uid"],
        "seq",
        firsts={"first_id": F.col("_id")},
        lasts={"last_ja3": F.col("ja3"), "last_server_name": F.col("server_name")},
        include_current=True,
        block_bits=block_bits,
        dense=dense,
    )
    return known.select(
        "seq",
        *[F.col(f"first_id.{c}").alias(c) for c in _ID],
        F.col("last_ja3").alias("ja3"),
        "client_version", "cipher_suites", "extensions",
        F.col("last_server_name").alias("server_name"),
    )


def latest_states(client_hello: DataFrame) -> DataFrame:
    """The state of every uid after all its hellos, by partial aggregation only."""
    hellos = described_hellos(client_hello)

    def last_given(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    newest = F.struct("client_version", "cipher_suites", "extensions")
    return (
        hellos.groupBy("uid")
        .agg(
            F.min_by(F.struct("ts", "orig_h", "orig_p", "resp_h", "resp_p"), "seq").alias("_first"),
            F.max_by(newest, "seq").alias("_newest"),
            last_given("ja3"),
            last_given("server_name"),
        )
        .select("_first.*", "uid", "ja3", F.md5("ja3").alias("ja3_hash"), "_newest.*", "server_name")
    )


def header_matches(
    http_header: DataFrame, client_hello: DataFrame, block_bits: int = BLOCK_BITS, dense: bool = False
) -> DataFrame:
    """Originator USER-AGENT headers with struct ``state``, NULL if none is known.

    The states are looked up twice and the headers split by outcome, so both are kept
    in the shared checkpoint folder instead of being computed again. The lookups find
    the number of a state; its row is joined at the end.
    """
    headers = http_header.where("name = 'USER-AGENT' and is_orig").select(
        "seq", "uid", "orig_h", "orig_p", F.coalesce("value", F.lit("")).alias("value")
    )
    states = cut_lineage(states_after_hello(client_hello, block_bits, dense))
    by_uid = cut_lineage(asof_number(headers, states, ["uid"], "seq", "_match", block_bits, dense))
    unmatched = by_uid.where("_match is null").drop("_match")
    by_origin = asof_number(unmatched, states, ["orig_h", "orig_p"], "seq", "_match", block_bits, dense)
    rows = states.select(F.col("seq").alias("_match"), F.struct("*").alias("state"))
    return by_uid.where("_match is not null").unionByName(by_origin).join(rows, "_match", "left").drop("_match")


def header_rows(
    http_header: DataFrame, client_hello: DataFrame, block_bits: int = BLOCK_BITS, dense: bool = False
) -> DataFrame:
    """Rows written on matched headers; the vectors may be empty here."""
    matched = header_matches(http_header, client_hello, block_bits, dense).where("state is not null")
    return (
        matched.select("state.*", F.col("value").alias("user_agent"))
        .withColumn("ja3_hash", F.md5("ja3"))
        .withColumn(
            "ja4", ja4(F.col("client_version"), F.col("cipher_suites"), F.col("extensions"), F.col("user_agent"))
        )
        .withColumn("ja4_hash", F.md5("ja4"))
        .select(*JA3_JA4_COLUMNS)
    )


def client_fingerprints(
    client_hello: DataFrame, http_header: DataFrame, block_bits: int = BLOCK_BITS, dense: bool = False
) -> DataFrame:
    """The ja3_ja4 log."""
    return hello_rows(client_hello).unionByName(header_rows(http_header, client_hello, block_bits, dense))


def server_extension_lists(tls_extension: DataFrame) -> DataFrame:
    """``uid, server_extensions``: codes the server sent, in order, duplicates kept.

    The list is one cell of a log row; a handshake bounds it.
    """
    items = F.array_sort(F.collect_list(F.struct("seq", F.col("code").cast("string").alias("code"))))
    return (
        tls_extension.where("not is_orig")
        .groupBy("uid")
        .agg(items.alias("_items"))
        .select("uid", F.transform("_items", lambda i: i["code"]).alias("server_extensions"))
    )


def server_fingerprints(server_hello: DataFrame, tls_extension: DataFrame) -> DataFrame:
    """The ja4s log: extensions are those seen before the hello.

    Codes that no hello of their uid can see are dropped before the list is built.
    """
    last_hello = server_hello.groupBy("uid").agg(F.max("seq").alias("_last"))
    seen = (
        tls_extension.where("not is_orig")
        .join(last_hello, "uid")
        .where("seq < _last")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("seq", F.col("code").cast("string").alias("code")))).alias("_items"))
    )
    before = F.transform(
        F.filter(F.col("_items"), lambda i: i["seq"] < F.col("seq")), lambda i: i["code"]
    )
    return (
        server_hello.join(seen, "uid", "left")
        .select(
            F.col("conn_start").alias("ts"), "uid", "orig_h", "orig_p", "resp_h", "resp_p",
            F.col("version").cast("string").alias("server_version"),
            F.col("cipher").cast("string").alias("server_cipher"),
            F.coalesce(before, F.array().cast("array<string>")).alias("server_extensions"),
            F.coalesce("server_name", F.lit("Unknown")).alias("server_name"),
        )
        .withColumn("ja4s", ja4s(F.col("server_version"), F.col("server_cipher"), F.col("server_extensions")))
        .withColumn("ja4s_hash", F.md5("ja4s"))
        .select(*JA4S_COLUMNS)
    )
