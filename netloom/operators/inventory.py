"""Facts about a fleet of sensors from its interface inventory.

Inventory rows are ``sensor_id, pos, name, mac, ip, up, loopback``: one per interface
address, ``pos`` giving the order the sensor lists them in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.ip import ip_hex
from netloom.functions.text import is_private_v4, machine_id

MAX_HOST_IPS = 10
INTERFACE_PREFERENCE = ("eth", "en", "wlan", "wl")


def private_addresses(inventory: DataFrame) -> DataFrame:
    """Interface rows with a private IPv4 address, on interfaces that are up."""
    return inventory.where("up").where(is_private_v4(ip_hex("ip")))


def host_ips(inventory: DataFrame, capture: DataFrame | None = None, limit: int = MAX_HOST_IPS) -> DataFrame:
    """``sensor_id, host_ips``: distinct private addresses, in order, comma-joined.

    ``capture`` (``sensor_id, interface``) names configured capture interfaces; the
    first private address of one (the first of a comma list; not ``any`` or ``all``)
    then stands alone.
    """
    private = private_addresses(inventory)
    ordered = (
        private.where("not loopback")
        .groupBy("sensor_id", "ip")
        .agg(F.min("pos").alias("pos"))
        .withColumn("_n", F.row_number().over(Window.partitionBy("sensor_id").orderBy("pos")))
        .where(F.col("_n") <= limit)
        .groupBy("sensor_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "ip"))).alias("_list"))
        .select("sensor_id", F.array_join(F.transform("_list", lambda x: x["ip"]), ",").alias("host_ips"))
    )
    if capture is None:
        return ordered
    wanted = (
        capture.where("interface is not null and interface not in ('', 'any', 'all')")
        .select("sensor_id", F.trim(F.substring_index("interface", ",", 1)).alias("name"))
    )
    chosen = (
        private.join(wanted, ["sensor_id", "name"])
        .groupBy("sensor_id")
        .agg(F.min_by("ip", "pos").alias("_own"))
    )
    return ordered.join(chosen, "sensor_id", "full").select(
        "sensor_id", F.coalesce("_own", "host_ips").alias("host_ips")
    )


def primary_mac(inventory: DataFrame) -> DataFrame:
    """``sensor_id, mac``: wired before wireless before others, then by name."""
    rank = F.lit(len(INTERFACE_PREFERENCE))
    for i in reversed(range(len(INTERFACE_PREFERENCE))):
        rank = F.when(F.col("name").startswith(INTERFACE_PREFERENCE[i]), F.lit(i)).otherwise(rank)
    return (
        inventory.where("not loopback and mac is not null and mac <> ''")
        .groupBy("sensor_id")
        .agg(F.min_by("mac", F.struct(rank.alias("rank"), F.col("name"), F.col("pos"))).alias("mac"))
    )


def sensor_metadata(sensors: DataFrame, inventory: DataFrame) -> DataFrame:
    """``sensor_id, metadata``: the map sent along with a sensor's payloads.

    ``sensors`` has ``sensor_id, network_id, sensor_version, os_name, os_version,
    architecture, zeek_version, interface``. Absent optional values have no key.
    """
    facts = (
        sensors.join(primary_mac(inventory), "sensor_id", "left")
        .join(host_ips(inventory, sensors.select("sensor_id", "interface")), "sensor_id", "left")
        .withColumn("machine_id", machine_id("mac"))
    )
    keys = [
        "network_id", "machine_id", "sensor_version", "os_name", "os_version", "architecture",
        "host_ips", "zeek_version",
    ]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    given = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    return facts.select("sensor_id", F.map_from_entries(given).alias("metadata"))


def with_session(metadata: DataFrame) -> DataFrame:
    """Adds a random ``session_id`` to every metadata map."""
    session = F.create_map(F.lit("session_id"), F.expr("uuid()"))
    return metadata.withColumn("metadata", F.map_concat("metadata", session))
