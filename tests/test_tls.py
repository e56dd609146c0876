import hashlib
import random
from datetime import datetime, timezone

import pytest

from netloom import schemas
from netloom.operators import tls
from netloom.operators.ordered import asof_join, running_values

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def hello(seq, uid, version=0x0303, ciphers=(4865, 49195), name="h.example", resumed=None, curve=None, alpn=None, orig=("10.0.0.1", 5000)):
    return (seq, T0, T0.replace(minute=1), uid, *orig, "9.9.9.9", 443, version, list(ciphers), name, resumed, curve, alpn)


def header(seq, uid, value="curl", orig=("10.0.0.1", 5000), name="USER-AGENT", is_orig=True):
    return (seq, T0, uid, *orig, is_orig, name, value)


def frames(spark, hellos, headers=()):
    return (
        spark.createDataFrame(hellos, schemas.CLIENT_HELLO),
        spark.createDataFrame(list(headers), schemas.HTTP_HEADER),
    )


def test_hello_row_by_hand(spark):
    hellos, _ = frames(spark, [hello(1, "u", 0x0304, resumed=True, curve="x25519", alpn="h2")])
    row = tls.hello_rows(hellos).first()
    assert row.ja3 == "772,4865-49195,0-35-10-13-51-43-16"
    assert row.ja3_hash == md5(row.ja3) and row.ja4 is None and row.user_agent is None
    assert row.extensions == ["0", "35", "10", "13", "51", "43", "16"] and row.ts.minute == 1


def test_first_hello_decides(spark):
    """A first hello without extensions writes nothing, and neither does a later one."""
    hellos, _ = frames(spark, [
        hello(1, "a", name=None), hello(2, "a"), hello(3, "b"), hello(4, "b", ciphers=(1,)), hello(5, "c", ciphers=()),
        hello(6, "d", name=None, resumed=False, curve="", alpn=""),
    ])
    assert [(r.uid, r.ja3) for r in tls.hello_rows(hellos).collect()] == [("b", "771,4865-49195,0")]


def test_user_agent_cases(spark):
    other = ("10.0.0.2", 6000)
    hellos, headers = frames(
        spark,
        [hello(10, "a"), hello(20, "b", orig=other), hello(30, "c", ciphers=(7,), orig=other), hello(40, "e", ciphers=(), name=None)],
        [
            header(11, "a"), header(12, "a", ""), header(13, "x"), header(14, "y", orig=("1.1.1.1", 1)), header(5, "a"),
            header(35, "z", "w", orig=other), header(25, "z", "v", orig=other), header(15, "a", name="User-Agent"),
            header(16, "a", is_orig=False), header(41, "e", "q"),
        ],
    )
    rows = {(r.uid, r.user_agent, r.ja4) for r in tls.header_rows(headers, hellos).collect()}
    assert rows == {
        ("a", "curl", f"t771_4865-49195_0_{md5('curl')}"), ("a", "", "t771_4865-49195_0_0"),
        ("b", "v", f"t771_4865-49195_0_{md5('v')}"), ("c", "w", f"t771_7_0_{md5('w')}"), ("e", "q", f"t771___{md5('q')}"),
    }
    assert tls.header_rows(headers, hellos).count() == 6  # uid a: by uid twice, and x by address


def expected_state(hellos, uid, before):
    """State of a uid before a number, straight from its definition."""
    seen = sorted(h for h in hellos if h[3] == uid and h[0] < before)
    if not seen:
        return None
    first, last = seen[0], seen[-1]

    def extensions(h):
        modern = h[8] >= 0x0304
        given = [(h[10] is not None, "0"), (bool(h[11]), "35"), (bool(h[12]), "10"), (modern, "13"), (modern, "51"), (modern, "43"), (bool(h[13]), "16")]
        return [code for there, code in given if there]

    ja3s = [f"{h[8]},{'-'.join(map(str, h[9]))},{'-'.join(extensions(h))}" for h in seen if h[9] and extensions(h)]
    names = [h[10] for h in seen if h[10] is not None]
    return (
        uid, first[4], first[5], str(last[8]), [str(c) for c in last[9]], extensions(last),
        ja3s[-1] if ja3s else None, names[-1] if names else None,
    )


@pytest.mark.parametrize("bits", [1, 3, 18])
def test_header_rows_against_definition(spark, bits):
    rng = random.Random(bits)
    numbers = rng.sample(range(400), 260)
    origins = {f"u{i}": (f"10.0.0.{i % 3}", 5000 + i % 2) for i in range(8)}
    hellos, headers = [], []
    for n in numbers:
        uid = rng.choice(["u0"] * 6 + list(origins))
        if n % 2:
            hellos.append(hello(n, uid, rng.choice([771, 772]), rng.choice([(), (1, 2), (3,)]), rng.choice([None, "s1", "s2"]),
                                rng.choice([None, True]), rng.choice([None, "", "c"]), None, origins[uid]))
        else:
            headers.append(header(n, rng.choice([uid, "none"]), rng.choice(["", "ua"]), rng.choice([origins[uid], ("7.7.7.7", 7)])))
    expected = []
    for h in headers:
        state = expected_state(hellos, h[2], h[0])
        if state is None:
            near = [x for x in hellos if (x[4], x[5]) == (h[3], h[4]) and x[0] < h[0]]
            state = expected_state(hellos, max(near)[3], h[0]) if near else None
        if state:
            expected.append((*state, h[7]))
    found = tls.header_rows(*reversed(frames(spark, hellos, headers)), block_bits=bits).collect()
    got = [
        (r.uid, r.orig_h, r.orig_p, r.client_version, r.cipher_suites, r.extensions, r.ja3, r.server_name, r.user_agent)
        for r in found
    ]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and got


def test_server_rows(spark):
    hello_rows = [
        (10, T0, T0, "a", "1.1.1.1", 1, "2.2.2.2", 443, 771, 4865, None), (20, T0, T0, "a", "1.1.1.1", 1, "2.2.2.2", 443, 772, 4866, "n"),
        (5, T0, T0, "b", "1.1.1.1", 1, "2.2.2.2", 443, 771, 1, "m"),
    ]
    codes = [(9, T0, "a", False, 43), (8, T0, "a", False, 51), (15, T0, "a", False, 43), (16, T0, "a", True, 9), (25, T0, "a", False, 1), (6, T0, "b", False, 2)]
    rows = tls.server_fingerprints(
        spark.createDataFrame(hello_rows, schemas.SERVER_HELLO), spark.createDataFrame(codes, schemas.TLS_EXTENSION)
    ).collect()
    assert sorted((r.uid, r.ja4s, r.server_name) for r in rows) == [
        ("a", "t771_4865_51-43", "Unknown"), ("a", "t772_4866_51-43-43", "n"), ("b", "t771_1_", "m"),
    ]
    assert all(r.ja4s_hash == md5(r.ja4s) for r in rows)


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_asof_against_scan(spark, bits):
    rng = random.Random(bits + 5)
    left = [(n, rng.choice(["hot", "hot", "k1", "k2", None])) for n in range(0, 300, 2)]
    right = [(n, rng.choice(["hot", "hot", "k1", None])) for n in range(1, 300, 3)]
    joined = asof_join(
        spark.createDataFrame(left, "seq bigint, k string"), spark.createDataFrame(right, "seq bigint, k string"), ["k"], "seq", "m", bits
    ).collect()
    found = {r.seq: r.m.seq if r.m else None for r in joined}
    wanted = {n: max((m for m, key in right if key == k and k is not None and m < n), default=None) for n, k in left}
    assert found == wanted and len(joined) == len(left)
