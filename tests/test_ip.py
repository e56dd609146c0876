import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netloom.functions import ip

EDGE = (
    "10.1.2.3|010.1.2.3|256.1.1.1|::|::1|1::|fd00::1|::ffff:10.1.2.3|1:2:3:4:5:6:1.2.3.4|fe80::1%eth0|1::2::3|"
    "1:2:3:4:5:6:7:|g::1|host.name|-|(empty)||1:2:3:4:5:6:7:8|1:2:3:4:5:6:7::|::2:3:4:5:6:7:8|1:2:3:4:5:6:7:8:9|"
    "1:2:3:4::5:6:7:8|:1:2:3:4:5:6:7|:::|1:::2|12345::|::1.2.3.4|::1.2.3|1.2.3.4.5|1.2.3.|::ffff:010.1.2.3|ABCD::EF|"
    "1:2:3:4:5:6::1.2.3.4|1.2.3.4:|0.0.0.0|255.255.255.255|1..2.3"
).split("|")


def expected_key(text):
    if "%" in text:
        return None
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{ip.V4_PREFIX}{int(address):08x}" if address.version == 4 else f"{int(address):032x}"


def test_address_keys(spark):
    rng = random.Random(3)
    made = [
        ":".join(rng.choice(["", "0", "1", "ff", "abcd", "12345", "1.2.3.4", ""]) for _ in range(rng.randint(1, 9)))
        for _ in range(3000)
    ]
    texts = list(dict.fromkeys(EDGE + made))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ip.ip_hex("t").alias("k")).collect()
    assert {r.t: r.k for r in rows} == {t: expected_key(t) for t in texts}


CIDRS = [
    "10.0.0.0/8", "10.1.2.3/8", "172.20.10.0/24", "172.16.0.0/12", "192.168.4.0/23", "1.2.3.4/32", "0.0.0.0/0",
    "fd00::/8", "::/0", "::/90", "2001:db8::/33", "::ffff:10.0.0.0/104", "fe80::1/128", "100.64.0.0/10",
]
BAD_CIDRS = ["10.0.0.0", "not-a-cidr", "10.0.0.0/99", "fd00::/129", "010.0.0.0/8", "fe80::1%eth0/64", "/8", "10.0.0.0/-1", ""]
PROBES = [
    "10.1.2.3", "9.255.255.255", "11.0.0.0", "172.20.10.5", "172.20.11.0", "172.31.255.255", "172.32.0.0", "192.168.5.255",
    "192.168.6.0", "1.2.3.4", "1.2.3.5", "100.127.0.1", "100.128.0.1", "fd12::1", "fe00::1", "::1", "::ffff:10.9.9.9",
    "2001:db8:7fff::1", "2001:db8:8000::1", "fe80::1", "fe80::2", "host", "-", "::ffff:1.2.3.4",
]


def contains(cidr, text):
    key = expected_key(text)
    if key is None:
        return False
    net = ipaddress.ip_network(cidr, strict=False)
    address = ipaddress.ip_address(text)
    if getattr(address, "ipv4_mapped", None):
        address = address.ipv4_mapped
    if net.version == 6 and net.network_address.ipv4_mapped and net.prefixlen >= 96:
        net = ipaddress.ip_network(f"{net.network_address.ipv4_mapped}/{net.prefixlen - 96}")
    return net.version == address.version and address in net


@pytest.mark.parametrize("cidr", CIDRS)
def test_containment_in_one_subnet(spark, cidr):
    frame = spark.createDataFrame([(p,) for p in PROBES], "p string")
    rows = frame.select("p", ip.in_cidrs("p", [ip.parse_cidr(cidr)]).alias("hit")).collect()
    assert {r.p: r.hit for r in rows} == {p: contains(cidr, p) for p in PROBES}


def test_subnet_columns_agree_with_the_list_form(spark):
    table = spark.createDataFrame([(c,) for c in CIDRS + BAD_CIDRS], "cidr string")
    for row in ip.cidr_columns(table, "cidr").withColumn("prefixes", ip.cidr_prefixes("cidr")).collect():
        parsed = ip.parse_cidr(row.cidr)
        assert row.valid == (parsed is not None) == (row.cidr in CIDRS), row
        if parsed:
            assert (row.family, row.bits, row.lo, row.hi) == (parsed.family, parsed.bits, parsed.lo, parsed.hi)
            assert sorted(row.prefixes) == sorted(parsed.family + p for p in parsed.nibble_prefixes())


def test_lists():
    assert ip.cidr_list(" ") == ip.cidr_list([]) == []
    assert [c.bits for c in ip.cidr_list("198.18.0.0/15 ,, fc00::/7,")] == [111, 7]
    for bad in ("198.18.0.1", "198.18.0.0/15,gateway", "198.18.0.0/-1", "fc00::/129"):
        with pytest.raises(ValueError):
            ip.cidr_list(bad)
    assert [c.bits for c in ip.cidr_list(["gateway", "198.18.0.0/15"], strict=False)] == [111]


def test_family(spark):
    row = spark.range(1).select(ip.ip_family(ip.ip_hex(F.lit("::ffff:1.2.3.4"))).alias("a"), ip.ip_family(ip.ip_hex(F.lit("::1"))).alias("b")).first()
    assert (row.a, row.b) == ("4", "6")
