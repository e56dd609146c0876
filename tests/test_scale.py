"""Properties of plans and of results under skew that matter on large data."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from netloom.operators import dhcp, flows, tls
from netloom.operators.chunking import assign_chunks
from netloom.operators.ordered import dense_numbers, running_values
from netloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PLANNED = [n for n in QUERIES if n[:2] not in ("s1", "s6", "s7", "t2", "t3", "f7", "k2", "k3", "j5", "w3") and not n.endswith(("_stream", "_pass"))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no sample tables")
def test_no_forced_broadcasts_and_no_pair_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in PLANNED:
            text = plan(entry.queries()[name](spark, FOLDER))
            assert not any(w in text for w in ("BroadcastExchange", "NestedLoop", "Cartesian")), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no sample tables")
def test_only_needed_columns_are_read_and_filters_reach_the_scan(spark):
    text = plan(entry.queries()["f9_conn_sample"](spark, FOLDER))
    assert "l_extendedprice" not in text and "l_discount" not in text
    hot = plan(entry.queries()["p1_client_hello_rows"](spark, FOLDER))
    assert "PushedFilters: [In(event_type" in hot.replace("Or(EqualTo(event_type", "In(event_type")


def test_rank_limit_before_the_shuffle(spark):
    events = spark.range(100).select((F.col("id") % 3).alias("uid"), F.col("id").alias("seq"))
    text = plan(tls.first_per_uid(events))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_flows_combine_before_the_window(spark):
    packets = spark.range(10).select(
        F.lit("r").alias("run_id"), F.col("id").alias("packet_no"), F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("ip_src"),
        F.lit("b").alias("ip_dst"), F.lit(6).alias("proto"), F.lit(1).alias("sport"), F.lit(2).alias("dport"), F.col("id").alias("length"),
    )
    text = plan(flows.flows(packets))
    assert "SortAggregate" not in text and "partial_count" in text and text.index("Window") < text.index("partial_count")


def test_hot_key_gives_the_same_rows_in_small_and_large_blocks(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id") % 50))
    base = spark.range(6000).select(
        F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.timestamp_seconds("id").alias("conn_start"),
        hot.alias("uid"), F.concat(F.lit("10.0.0."), F.length(hot)).alias("orig_h"), F.lit(1).alias("orig_p"), F.lit("9.9.9.9").alias("resp_h"),
        F.lit(443).alias("resp_p"), (771 + F.col("id") % 2).alias("version"), F.array(F.col("id") % 7).alias("ciphers"),
        F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("server_name"), F.lit(True).alias("resumed"), F.lit("").alias("curve"),
        F.lit(None).cast("string").alias("next_protocol"),
    )
    hellos = base.where("seq % 2 = 0")
    headers = base.where("seq % 2 = 1").select(
        "seq", "ts", "uid", "orig_h", "orig_p", F.lit(True).alias("is_orig"), F.lit("USER-AGENT").alias("name"), F.lit("ua").alias("value")
    )
    small, large = (
        sorted(map(str, tls.header_rows(headers, hellos, block_bits=bits).collect())) for bits in (5, 20)
    )
    assert small == large and len(small) > 2900


def test_one_log_with_most_lines_is_cut_like_a_small_one(spark):
    lines = spark.range(20000).select(
        F.lit("r").alias("run_id"), F.when(F.col("id") % 3 == 0, "conn").otherwise("dns").alias("log"), F.col("id").alias("line_no"),
        F.repeat(F.lit("x"), (F.col("id") % 37).cast("int")).alias("line"),
    )
    small = assign_chunks(lines, 2000, bits=6).select("log", "line_no", "chunk_no")
    large = assign_chunks(lines, 2000, bits=16).select("log", "line_no", "chunk_no")
    assert small.exceptAll(large).isEmpty() and small.count() == 20000


def test_filling_never_changes_the_row_count(spark):
    log = spark.range(3000).select(F.lit("r").alias("run_id"), F.when(F.col("id") % 3 == 0, "m").otherwise(F.col("id").cast("string")).alias("mac"), F.lit(None).cast("string").alias("param_req_list"))
    prints = spark.createDataFrame([("r", "m", "1,3")], "run_id string, mac string, fingerprint string")
    filled = dhcp.fill_fingerprints(log, prints)
    assert filled.count() == 3000 and filled.where("param_req_list = '1,3'").count() == 1000


def test_dense_numbers_of_a_hot_key(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("key"),
        F.when(F.col("id") % 11 != 0, F.col("id") * F.lit(7919) % 4999 * F.lit(1 << 49)).alias("at"), F.col("id"),
    )
    found = dense_numbers(rows, ["key"], ["at", "id"], "n", "total").toPandas()
    for _, group in found.groupby("key", dropna=False):
        group = group.sort_values(["at", "id"], na_position="first")
        assert group["n"].tolist() == list(range(len(group))) and set(group["total"]) == {len(group)}


def test_sparse_numbers_fill_their_blocks(spark):
    """One key, numbers spread over 2^62: blocks of ranks stay full, so few rows are carried."""
    events = spark.range(4000).select(F.lit("k").alias("key"), (F.col("id") * F.lit(1 << 50)).alias("seq"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    known = running_values(events, ["key"], "seq", lasts={"last": F.col("v")}, block_bits=6, dense=True)
    got = {r.seq >> 50: r.last for r in known.collect()}
    assert got == {i: ((i - 1) // 5 * 5 if i else None) for i in range(4000)}
    blocks = dense_numbers(events, ["key"], ["seq"], "n").groupBy(F.shiftright("n", 6)).count()
    assert blocks.agg(F.max("count"), F.count("*")).first() == (64, 63)


def test_sparse_and_numbered_feeds_give_the_same_rows(spark):
    hellos = spark.range(900).select(
        F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.timestamp_seconds("id").alias("conn_start"),
        F.concat(F.lit("u"), F.col("id") % 40).alias("uid"), F.lit("10.0.0.1").alias("orig_h"), F.lit(1).alias("orig_p"), F.lit("9.9.9.9").alias("resp_h"),
        F.lit(443).alias("resp_p"), F.lit(771).cast("bigint").alias("version"), F.array(F.col("id") % 7).alias("ciphers"),
        F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("server_name"), F.lit(True).alias("resumed"), F.lit("").alias("curve"),
        F.lit(None).cast("string").alias("next_protocol"),
    )
    headers = spark.range(900, 1500).select(
        (F.col("id") * 7 % 1500).alias("seq"), F.concat(F.lit("u"), F.col("id") % 60).alias("uid"), F.lit("10.0.0.1").alias("orig_h"),
        F.lit(1).alias("orig_p"), F.lit(True).alias("is_orig"), F.lit("USER-AGENT").alias("name"), F.lit("ua").alias("value"),
    )
    wide = lambda df: df.withColumn("seq", F.col("seq") * F.lit(1 << 51))
    plain = tls.client_fingerprints(hellos, headers)
    sparse = tls.client_fingerprints(wide(hellos), wide(headers), block_bits=4, dense=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sparse.collect())) and plain.count() > 100


def test_log_folders_leave_the_text_only(spark, tmp_path, monkeypatch):
    """The table of numbered lines is narrow, met by its counts where it is, and dropped."""
    from netloom.operators import ordered
    from netloom.plans import queries

    numbered = []

    def seen(*args, **more):
        numbered.append(dense_numbers(*args, **more))
        return numbered[-1]

    monkeypatch.setattr(queries, "dense_numbers", seen)
    for module in (ordered, queries):
        monkeypatch.setattr(module, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    conn = spark.range(500).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"), F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("u"), F.col("id") * 7 % 500).alias("uid"),
        F.lit("192.0.2.1").alias("orig_h"), F.lit(1).alias("orig_p"), F.lit("192.0.2.2").alias("resp_h"), F.lit(2).alias("resp_p"), F.lit("tcp").alias("proto"),
    )
    path = queries._log_folders(spark, "", {"conn": conn})
    assert [p.name for p in tmp_path.iterdir()] == ["run-folders"]
    assert numbered[0].columns == ["run_id", "_line", "_row"] and "BroadcastHashJoin" in plan(numbered[0])
    for run in range(3):
        parts = sorted(Path(f"{path}/run_id=r{run}/log=conn").glob("part-*"))
        lines = [x for p in parts for x in p.read_text().splitlines() if not x.startswith("#")]
        assert lines == sorted(lines) and len(lines) == len(range(run, 500, 3))
