"""TLS fingerprint logs from event streams.

Client events are keyed by originator address and port: a connection has one
originator, so its uid and every connection a header may fall back to are in the same
group. Server events are keyed by uid. Events of a micro-batch are taken in ``seq``
order; an event that arrives after a later one was handled counts as later.

State values live in the state store. ``idle`` lets a connection's state expire that
long after it was last written or matched; by default it is kept. Expiry goes by
processing time, so such a stream needs a processing-time trigger: run with
``availableNow`` it would not end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.functions.tls import ja4, ja4s
from netloom.operators.tls import JA3_JA4_COLUMNS, JA4S_COLUMNS, described_hellos

# The process that starts a stateful operator does not see files added to the session,
# so the processors below are sent along whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_TEXTS = T.ArrayType(_S)
_STATE_FIELDS = [
    ("ts", _L), ("uid", _S), ("orig_h", _S), ("orig_p", _I), ("resp_h", _S), ("resp_p", _I), ("ja3", _S),
    ("client_version", _S), ("cipher_suites", _TEXTS), ("extensions", _TEXTS), ("server_name", _S),
]
_STATE = T.StructType([T.StructField(n, t) for n, t in _STATE_FIELDS])
_CLIENT_OUT = T.StructType([*_STATE.fields, T.StructField("user_agent", _S)])
_NAMES = [n for n, _ in _STATE_FIELDS]
_KEY = T.StructType([T.StructField("uid", _S)])
_SERVER_OUT = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("ts", _L), ("uid", _S), ("orig_h", _S), ("orig_p", _I), ("resp_h", _S), ("resp_p", _I),
            ("server_version", _S), ("server_cipher", _S), ("server_extensions", _TEXTS), ("server_name", _S),
        ]
    ]
)


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _in_order(rows: Iterator[Row]) -> list[dict[str, Any]]:
    return sorted((row.asDict() for row in rows), key=lambda event: event["seq"])


def _text(value: Any) -> str | None:
    return value if isinstance(value, str) else None


class _ClientState(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", _KEY, _STATE, self.ttl_ms)
        self.latest = handle.getValueState("latest", _KEY, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """Every call of the store goes over a socket, so a state is read once and written once a batch, not per event."""
        out = []
        states: dict[tuple, dict[str, Any] | None] = {}
        touched: dict[tuple, None] = {}
        latest, latest_read, latest_set = None, False, False

        def state_of(uid: tuple) -> dict[str, Any] | None:
            if uid not in states:
                states[uid] = dict(zip(_NAMES, self.known.getValue(uid))) if self.known.containsKey(uid) else None
            return states[uid]

        for event in _in_order(rows):
            uid = (event["uid"],)
            state = state_of(uid)
            if event["kind"] == "hello":
                fresh = state is None
                state = states[uid] = self._after_hello(event, state)
                touched[uid] = None
                latest, latest_read, latest_set = uid, True, True
                if fresh and state["ja3"] is not None:
                    out.append({**state, "user_agent": None})
                continue
            if state is None:
                if not latest_read:
                    latest, latest_read = tuple(self.latest.get()) if self.latest.exists() else None, True
                if latest is not None:
                    uid = latest
                    state = state_of(uid)
            if state is not None:
                touched[uid] = None
                out.append({**state, "user_agent": event["value"]})
        for uid in touched:
            self.known.updateValue(uid, tuple(states[uid][n] for n in _NAMES))
        if latest_set:
            self.latest.update(latest)
        for row in out:
            yield Row(**{n: row[n] for n in _CLIENT_OUT.names})

    @staticmethod
    def _after_hello(event: dict[str, Any], state: dict[str, Any] | None) -> dict[str, Any]:
        """First ts, uid and addresses; latest version and lists; latest given ja3 and name."""
        known = state or {n: event[n] for n in ("ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p")}
        return {
            **known,
            "ts": int(known["ts"]), "orig_p": int(known["orig_p"]), "resp_p": int(known["resp_p"]),
            "client_version": event["client_version"],
            "cipher_suites": list(event["cipher_suites"]),
            "extensions": list(event["extensions"]),
            "ja3": _text(event["ja3"]) or (state or {}).get("ja3"),
            "server_name": event["server_name"] if isinstance(event["server_name"], str) else (state or {}).get("server_name"),
        }

    def close(self) -> None:
        pass


class _ServerState(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.codes = handle.getListState("codes", T.StructType([T.StructField("code", _S)]), self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """Codes are read once, and only if a hello needs them, and the new ones written once."""
        events = _in_order(rows)
        asked = any(event["kind"] == "hello" for event in events)
        seen = [c[0] for c in self.codes.get()] if asked and self.codes.exists() else []
        out, new = [], []
        for event in events:
            if event["kind"] == "extension":
                seen.append(event["code"])
                new.append((event["code"],))
            else:
                out.append({**{n: event[n] for n in _SERVER_OUT.names if n != "server_extensions"}, "server_extensions": list(seen)})
        if new:
            self.codes.appendList(new)
        for row in out:
            yield Row(**{n: row[n] for n in _SERVER_OUT.names})

    def close(self) -> None:
        pass


def _millis(idle: str | None) -> int | None:
    return None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)


def _time_mode(idle: str | None) -> str:
    return "None" if idle is None else "ProcessingTime"


def client_fingerprint_stream(client_hello: DataFrame, http_header: DataFrame, idle: str | None = None) -> DataFrame:
    """The ja3_ja4 log as a stream."""
    hellos = described_hellos(client_hello).select(
        F.lit("hello").alias("kind"), "seq", *[F.unix_micros("ts").alias("ts") if n == "ts" else n for n in _NAMES],
        F.lit(None).cast("string").alias("value"),
    )
    unknown = {"ts": _L, "resp_h": _S, "resp_p": _I, "ja3": _S, "client_version": _S, "cipher_suites": _TEXTS,
               "extensions": _TEXTS, "server_name": _S}
    headers = http_header.where("name = 'USER-AGENT' and is_orig").select(
        F.lit("header").alias("kind"), "seq",
        *[F.lit(None).cast(unknown[n]).alias(n) if n in unknown else F.col(n) for n in _NAMES],
        F.coalesce("value", F.lit("")).alias("value"),
    )
    rows = (
        hellos.unionByName(headers)
        .withColumns({"key_h": F.col("orig_h"), "key_p": F.col("orig_p")})
        .groupBy("key_h", "key_p")
        .transformWithState(_ClientState(_millis(idle)), _CLIENT_OUT, "Append", _time_mode(idle))
    )
    agent = F.col("user_agent")
    text = ja4(F.col("client_version"), F.col("cipher_suites"), F.col("extensions"), agent)
    return (
        rows.withColumn("ts", F.timestamp_micros("ts"))
        .withColumn("ja3_hash", F.md5("ja3"))
        .withColumn("ja4", F.when(agent.isNotNull(), text))
        .withColumn("ja4_hash", F.md5("ja4"))
        .select(*JA3_JA4_COLUMNS)
    )


def server_fingerprint_stream(server_hello: DataFrame, tls_extension: DataFrame, idle: str | None = None) -> DataFrame:
    """The ja4s log as a stream."""
    none = F.lit(None)
    hellos = server_hello.select(
        F.lit("hello").alias("kind"), "seq", F.unix_micros("conn_start").alias("ts"), "uid", "orig_h", "orig_p", "resp_h",
        "resp_p", F.col("version").cast("string").alias("server_version"), F.col("cipher").cast("string").alias("server_cipher"),
        F.coalesce("server_name", F.lit("Unknown")).alias("server_name"), none.cast("string").alias("code"),
    )
    codes = tls_extension.where("not is_orig").select(
        F.lit("extension").alias("kind"), "seq", none.cast("bigint").alias("ts"), "uid", none.cast("string").alias("orig_h"),
        none.cast("int").alias("orig_p"), none.cast("string").alias("resp_h"), none.cast("int").alias("resp_p"),
        none.cast("string").alias("server_version"), none.cast("string").alias("server_cipher"),
        none.cast("string").alias("server_name"), F.col("code").cast("string").alias("code"),
    )
    rows = (
        hellos.unionByName(codes)
        .withColumn("key_uid", F.col("uid"))
        .groupBy("key_uid")
        .transformWithState(_ServerState(_millis(idle)), _SERVER_OUT, "Append", _time_mode(idle))
    )
    text = ja4s(F.col("server_version"), F.col("server_cipher"), F.col("server_extensions"))
    return (
        rows.withColumn("ts", F.timestamp_micros("ts")).withColumn("ja4s", text).withColumn("ja4s_hash", F.md5("ja4s"))
        .select(*JA4S_COLUMNS)
    )


def server_fingerprint_join(
    server_hello: DataFrame, tls_extension: DataFrame, within: str = "10 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """The ja4s log by a join of the two streams, with Spark's own state only.

    A hello takes the extensions of its uid that came before it (``seq``), at most ``within``
    earlier (``ts``). Rows may come up to ``lateness`` behind the latest one of either stream. A hello is
    given out, with extensions or without, once the watermark is past it; what is
    older than ``within`` leaves the state, so no idle time has to be guessed.
    """
    hello = server_hello.select(
        F.col("ts").alias("at"), "seq", "uid", "conn_start", "orig_h", "orig_p", "resp_h", "resp_p", "version", "cipher", "server_name"
    ).withWatermark("at", lateness)
    known = [c for c in hello.columns]
    sent = tls_extension.where("not is_orig").select(
        F.col("ts").alias("_ts"), F.col("uid").alias("_uid"), F.col("seq").alias("_seq"), F.col("code").cast("string").alias("_code")
    ).withWatermark("_ts", lateness)
    met = hello.join(
        sent, F.expr(f"uid = _uid AND _seq < seq AND _ts <= at AND _ts >= at - INTERVAL {within}"), "leftOuter"
    ).select(*known, F.when(F.col("_seq").isNotNull(), F.struct("_seq", "_code")).alias("_sent"))
    lists = met.groupBy(*known).agg(F.array_sort(F.collect_list("_sent")).alias("_sent"))
    version, cipher = F.col("version").cast("string"), F.col("cipher").cast("string")
    codes = F.transform("_sent", lambda s: s["_code"])
    text = ja4s(version, cipher, codes)
    return lists.select(
        F.col("conn_start").alias("ts"), "uid", "orig_h", "orig_p", "resp_h", "resp_p", text.alias("ja4s"), F.md5(text).alias("ja4s_hash"),
        version.alias("server_version"), cipher.alias("server_cipher"), codes.alias("server_extensions"),
        F.coalesce("server_name", F.lit("Unknown")).alias("server_name"),
    )
