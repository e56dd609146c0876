"""Windows, flows and fingerprints of streams by event time, delivered in steps with late rows."""

from datetime import datetime, timedelta, timezone

import pytest

from netloom import schemas
from netloom.operators import flows, tls
from netloom.sources.events import read_events
from netloom.streaming import flows as flow_streams
from netloom.streaming import tls as tls_streams

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
PACKETS = "run_id string, packet_no long, ts timestamp, ip_src string, ip_dst string, proto int, sport int, dport int, length long"


def packet(no, seconds, source="10.0.0.1", target="10.0.0.2", sport=1, dport=2, length=100):
    return ("r", no, T0 + timedelta(seconds=seconds), source, target, 6, sport, dport, length)


def deliver(spark, base, schema, parts, stream_of):
    """Runs the stream once per part, from its checkpoint."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        frame = stream_of(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{base}/in"))
        query = (
            frame.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
            .trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
    return spark.read.schema(frame.schema).parquet(f"{base}/out").collect()


def test_windows_close_once_and_drop_what_is_too_late(spark, tmp_path):
    parts = [
        [packet(1, 5), packet(2, 61, length=7), packet(3, 130)],
        [packet(4, 10, length=5), packet(5, 300), packet(6, 125)],  # 4 comes 120 s late, 6 just 5 s
        [packet(7, 20), packet(8, 900)],  # 7 belongs to a window that is out
    ]
    got = deliver(spark, tmp_path, PACKETS, parts, lambda p: flow_streams.window_counts(p, 60, "2 minutes"))
    assert sorted(map(tuple, got)) == [
        ("20240501T000000Z", 2, 105), ("20240501T000100Z", 1, 7), ("20240501T000200Z", 2, 200), ("20240501T000500Z", 1, 100),
    ]


def test_flows_of_a_stream_are_those_of_the_capture(spark, tmp_path):
    back = {"source": "10.0.0.2", "target": "10.0.0.1", "sport": 2, "dport": 1}
    first = [packet(2, 10, **back), packet(3, 70), packet(9, 71, sport=9)]
    second = [packet(1, 9), packet(4, 130.000001), packet(5, 190), packet(6, 200, "::1", "::2")]
    end = [packet(7, 5000, "z", "y")]
    got = deliver(spark, tmp_path, PACKETS, [first, second, end], lambda p: flow_streams.flow_stream(p, 60, "3 minutes"))
    whole = flows.flows(spark.createDataFrame(first + second, PACKETS), 60).collect()
    order = lambda rows: sorted(str(r.asDict()) for r in rows)
    assert order(got) == order(whole) and len(whole) == 4  # a silence of exactly 60 s keeps a flow, a microsecond more ends it
    assert {r.orig_h for r in got if r.packets == 3} == {"10.0.0.1"}  # packet 1 came late and still is the opener


@pytest.mark.parametrize("early", ["true", "false"])
def test_sessions_merged_early_change_nothing(spark, tmp_path, early):
    key = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    old = spark.conf.get(key)
    try:
        if early == "true":
            flow_streams.merge_sessions_early(spark)
        rows = [packet(i, 30 * i + (400 if i > 20 else 0)) for i in range(40)]
        got = deliver(spark, tmp_path, PACKETS, [rows[::2], rows[1::2], [packet(99, 9000, "z")]], lambda p: flow_streams.flow_stream(p, 60, "1 hour"))
        assert sorted(r.packets for r in got) == [19, 21]
    finally:
        spark.conf.set(key, old)


def hello(seq, uid, name=None):
    return (seq, T0 + timedelta(seconds=seq), T0, uid, "1.1.1.1", 1, "2.2.2.2", 443, 771, 9, name)


def extension(seq, uid, code, is_orig=False):
    return (seq, T0 + timedelta(seconds=seq), uid, is_orig, code)


def test_server_hellos_take_their_extensions_by_a_join(spark, tmp_path):
    hellos = [hello(4, "a"), hello(9, "a", "n"), hello(5, "b"), hello(700, "c"), hello(6, None)]
    sent = [extension(1, "a", 43), extension(2, "a", 5, True), extension(3, "a", 51), extension(7, "a", 51), extension(8, "b", 1), extension(20, "c", 2)]
    far = ([hello(10**6, "end")], [extension(10**6, "end", 0)])
    for mine, theirs in ((hellos[:1], sent[3:]), (hellos[1:], sent[:3]), far):
        spark.createDataFrame(mine, schemas.SERVER_HELLO).write.mode("append").parquet(f"{tmp_path}/server_hello")
        spark.createDataFrame(theirs, schemas.TLS_EXTENSION).write.mode("append").parquet(f"{tmp_path}/tls_extension")
        frame = tls_streams.server_fingerprint_join(*(read_events(spark, f"{tmp_path}/{k}", k, stream=True) for k in ("server_hello", "tls_extension")), within="5 minutes", lateness="1 hour")
        query = frame.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        assert query.trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.schema(frame.schema).parquet(f"{tmp_path}/out").collect()
    batch = tls.server_fingerprints(spark.createDataFrame(hellos, schemas.SERVER_HELLO), spark.createDataFrame(sent, schemas.TLS_EXTENSION)).collect()
    # c's extension is older than five minutes, all else as in batch
    assert sorted(r.ja4s for r in got) == sorted("t771_9_" if r.uid == "c" else r.ja4s for r in batch)
    assert sorted(r.ja4s for r in got) == ["t771_9_", "t771_9_", "t771_9_", "t771_9_43-51", "t771_9_43-51-51"]
