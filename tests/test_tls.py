"""TLS sessions sealed with Spark's AES, opened through a key log."""

import hashlib
import hmac
import struct

import pytest
from pyspark.sql import functions as F

from wiretide.operators import tls as T

CLIENT, SERVER, SECRET = bytes(range(32)), bytes(range(100, 132)), bytes(range(48))


def record(kind, body):
    return bytes([kind]) + b"\x03\x03" + struct.pack("!H", len(body)) + body


def hello(kind, random, suite=b"\x13\x01", new=True):
    more = (b"\x00\x2b\x00\x02\x03\x04" if kind == 2 else b"\x00\x2b\x00\x03\x02\x03\x04") if new else b""
    rest = (suite + b"\x00" if kind == 2 else b"\x00\x02" + suite + b"\x01\x00") + struct.pack("!H", len(more)) + more
    body = b"\x03\x03" + random + b"\x00" + rest
    return record(22, bytes([kind]) + len(body).to_bytes(3, "big") + body)


def seal(spark, key, nonce, text, aad):
    row = spark.range(1).select(F.aes_encrypt(*[F.unhex(F.lit(x.hex())) if isinstance(x, bytes) else F.lit(x) for x in (text, key, "GCM", "DEFAULT", nonce, aad)]))
    return bytes(row.first()[0])[12:]


def streams(spark, sides):
    """Reassembled rows: each side's bytes in pieces of 50."""
    rows = [("s", 1, resp, i, bytearray(data[i : i + 50])) for resp, data in sides.items() for i in range(0, len(data), 50)]
    return spark.createDataFrame(rows, "session_id string, flow_id long, resp boolean, packet_id long, data binary")


def keylog(spark, tmp_path, lines):
    (tmp_path / "keys.log").write_text("# comment\nBOGUS aa bb\n" + "\n".join(lines + lines[:1]) + "\n")
    return T.read_keylog(spark, str(tmp_path / "keys.log"))


@pytest.mark.parametrize(("suite", "size", "algo"), [(b"\xc0\x2f", 16, "sha256"), (b"\xc0\x30", 32, "sha384")])
def test_tls12(spark, tmp_path, suite, size, algo):
    seed, out, a = b"key expansion" + SERVER + CLIENT, b"", b"key expansion" + SERVER + CLIENT
    while len(out) < 2 * size + 8:
        a = hmac.new(SECRET, a, algo).digest()
        out += hmac.new(SECRET, a + seed, algo).digest()
    key, iv = out[:size], out[2 * size : 2 * size + 4]
    parts = [hello(1, CLIENT, suite, new=False), record(20, b"\x01")]
    for n, (kind, text) in enumerate([(22, b"\x14\x00\x00\x0cfinishedfini"), (23, b"GET /  secret\r\n"), (23, b"x" * 300)]):
        explicit = struct.pack("!Q", 77 + n)
        aad = struct.pack("!QB", n, kind) + b"\x03\x03" + struct.pack("!H", len(text))
        parts.append(record(kind, explicit + seal(spark, key, iv + explicit, text, aad)))
    sides = {False: b"".join(parts), True: hello(2, SERVER, suite, new=False)}
    keys = keylog(spark, tmp_path, [f"CLIENT_RANDOM {CLIENT.hex()} {SECRET.hex()}"])
    assert keys.count() == 1
    got = T.plaintexts(T.records(streams(spark, sides)), keys).withColumn("text", T.plaintext_summary(F.col("plaintext"))).orderBy("n").collect()
    assert [(r.kind, bytes(r.plaintext)) for r in got] == [(22, b"\x14\x00\x00\x0cfinishedfini"), (23, b"GET /  secret\r\n"), (23, b"x" * 300)]
    assert got[1].text == "GET / secret" and got[2].text == "x" * 140 + "..."
    other = keylog(spark, tmp_path, [f"CLIENT_RANDOM {CLIENT.hex()} {SECRET[::-1].hex()}"])
    assert T.plaintexts(T.records(streams(spark, sides)), other).count() == 0


def test_tls13(spark, tmp_path):
    def derive(secret, label, size):
        info = struct.pack("!HB", size, len(label) + 6) + b"tls13 " + label + b"\x00"
        return hmac.new(secret, info + b"\x01", "sha256").digest()[:size]

    secrets = {x: hashlib.sha256(x.encode()).digest() for x in T.TLS13_LABELS}
    sides = {False: hello(1, CLIENT), True: hello(2, SERVER) + record(20, b"\x01")}
    plain = {True: ([b"\x08\x00\x00\x02\x00\x00", b"\x14\x00\x00\x20" + bytes(32)], [b"HTTP/1.1 200 OK", b"body"]), False: ([b"\x14\x00\x00\x20" + bytes(32)], [b"GET / HTTP/1.1"])}
    want = []
    for resp, epochs in plain.items():
        for epoch, texts in enumerate(epochs):
            secret = secrets[T.TLS13_LABELS[2 * epoch + resp]]
            key, iv = derive(secret, b"key", 16), derive(secret, b"iv", 12)
            for n, text in enumerate(texts):
                inner = text + bytes([22 if epoch == 0 else 23])
                nonce = iv[:4] + (int.from_bytes(iv[4:], "big") ^ n).to_bytes(8, "big")
                sides[resp] += record(23, seal(spark, key, nonce, inner, b"\x17\x03\x03" + struct.pack("!H", len(inner) + 16)))
                want.append((resp, inner[-1], text))
    keys = keylog(spark, tmp_path, [f"{x} {CLIENT.hex()} {s.hex()}" for x, s in secrets.items()])
    got = T.plaintexts(T.records(streams(spark, sides)), keys).orderBy("resp", "n").collect()
    assert sorted((r.resp, r.kind, bytes(r.plaintext)) for r in got) == sorted(want)
    assert T.plaintext_summary(F.lit(" \n ").cast("binary")) is not None
    assert spark.range(1).select(T.plaintext_summary(F.lit(" \n ").cast("binary"))).first()[0] == "<3 plaintext bytes>"
