"""Addresses and their longest networks against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import addresses
from evidentia.operators import networks


def plain_key(ip):
    try:
        a = ipaddress.ip_address(ip.strip().lower().split("%")[0])
    except ValueError:
        return None
    return f"{a.version}{int(a):0{8 if a.version == 4 else 32}x}"


def test_keys(spark):
    given = ["10.0.0.1", "255.255.255.255", "256.1.1.1", "1.2.3", "::", "::1", "2001:DB8::1", "2001:db8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3::4", "1:2:3", "12345::", "g::1", ":1:2:3:4:5:6:7",
             "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "::1.2.3.400", "fe80::1%eth0", "", "geen ip", " 8.8.8.8 ", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8"]
    rows = spark.createDataFrame([(g,) for g in [*given, None]], "ip string").select("ip", addresses.address_key(F.col("ip")).alias("k")).collect()
    for r in rows:
        assert r.k == (plain_key(r.ip) if r.ip is not None else None), r.ip


def nets_and_hosts(seed):
    rng = random.Random(seed)
    nets, hosts = [], []
    for _ in range(120):
        if rng.random() < 0.5:
            base, bits = (10 << 24) + rng.randrange(1 << 12) * (1 << rng.choice((0, 4, 12))), rng.choice((0, 7, 8, 9, 15, 20, 22, 23, 24, 25, 29, 30, 31, 32))
            nets.append(f"{ipaddress.IPv4Address(base % 2**32)}/{bits}")
        else:
            base, bits = (0x20010DB8 << 96) + rng.randrange(1 << 10) * (1 << rng.choice((0, 3, 60, 90))), rng.choice((3, 32, 33, 47, 64, 65, 100, 126, 127, 128))
            nets.append(f"{ipaddress.IPv6Address(base)}/{bits}")
    nets += [n.split("/")[0] for n in nets[:9]] + nets[:5] + ["kein/8", "10.0.0.0/99", "", None, "255.255.255.254/31", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:0/112"]
    for n in nets:
        if plain_key((n or "").split("/")[0]) and n.split("/")[-1] != "99":
            net = ipaddress.ip_network(n, strict=False)
            for number in (int(net[0]), int(net[-1]), int(net[0]) - 1, int(net[-1]) + 1, int(net[0]) + rng.randrange(net.num_addresses)):
                if 0 <= number < 2**net.max_prefixlen:
                    hosts.append(str((ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address)(number)))
    return nets, [*hosts, *["10.0.0.1"] * 200, "0.0.0.0", "255.255.255.255", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "geen", None]


def plain_longest(ip, table):
    if ip is None or plain_key(ip) is None:
        return None, None
    own = ipaddress.ip_address(ip)
    around = [(net.prefixlen, net) for net in table if net.version == own.version and own in net]
    return table[max(around, key=lambda x: x[0])[1]] if around else (None, None)


@pytest.mark.parametrize("seed", range(2))
def test_longest_networks(spark, seed):
    nets, hosts = nets_and_hosts(seed)
    table = {}
    for k, n in enumerate(nets):
        if n and plain_key(n.split("/")[0]) and n.split("/")[-1] != "99":
            net = ipaddress.ip_network(n, strict=False)
            name, value = table.get(net, (n, f"o{k:03}"))
            table[net] = (min(name, n), min(value, f"o{k:03}"))
    listed = spark.createDataFrame([(n, f"o{k:03}") for k, n in enumerate(nets)], "network string, org string")
    found = networks.longest_networks(spark.createDataFrame(list(enumerate(hosts)), "k long, ip string"), "ip", listed, "network", "org")
    assert found.columns == ["k", "ip", "network", "org"]
    got = {r.k: (r.network, r.org) for r in found.collect()}
    assert got == {k: plain_longest(ip, table) for k, ip in enumerate(hosts)}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_networks(spark):
    rows = spark.createDataFrame([("10.0.0.1",)], "ip string")
    assert [tuple(r) for r in networks.longest_networks(rows, "ip", spark.createDataFrame([], "network string, org string"), "network", "org").collect()] == [("10.0.0.1", None, None)]
