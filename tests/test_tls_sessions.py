"""Whole TLS sessions, sealed here: CBC and ChaCha20-Poly1305 suites, Finished checks, hellos over records, events with times."""

import hashlib
import hmac
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ingest import ACK, SYN, tcp
from test_tls import CLIENT, SECRET, SERVER, record, seal, streams

from wiretide.operators import ingest as I  # noqa: E741
from wiretide.operators import tls as T
from wiretide.operators.ciphers import chacha20_blocks, chacha20_poly1305_open, poly1305


def message(kind, body):
    return bytes([kind]) + len(body).to_bytes(3, "big") + body


def hello(kind, random, suite, new, sni=b""):
    more = (b"\x00\x2b\x00\x02\x03\x04" if kind == 2 else b"\x00\x2b\x00\x03\x02\x03\x04") if new else b""
    if sni:
        more += struct.pack("!HHHBH", 0, len(sni) + 5, len(sni) + 3, 0, len(sni)) + sni
    rest = (struct.pack("!H", suite) + b"\x00" if kind == 2 else b"\x00\x02" + struct.pack("!H", suite) + b"\x01\x00") + struct.pack("!H", len(more)) + more
    return message(kind, b"\x03\x03" + random + b"\x00" + rest)


def prf(secret, seed, size, algo):
    out, a = b"", seed
    while len(out) < size:
        a = hmac.new(secret, a, algo).digest()
        out += hmac.new(secret, a + seed, algo).digest()
    return out[:size]


def label13(secret, label, size, algo):
    info = struct.pack("!HB", size, len(label) + 6) + b"tls13 " + label + b"\x00"
    return hmac.new(secret, info + b"\x01", algo).digest()[:size]


def seal_chacha(key, nonce, text, aad):
    words = lambda b: np.frombuffer(b, "<u4")[None]
    n = 1 + -(-len(text) // 64)
    stream = chacha20_blocks(np.repeat(words(key), n, 0), np.repeat(words(nonce), n, 0), np.arange(n, dtype=np.uint32))
    sealed = bytes(a ^ b for a, b in zip(text, stream[1:].tobytes(), strict=False))
    pad = lambda b: b + bytes(-len(b) % 16)
    return sealed + poly1305(stream[:1, :32], [pad(aad) + pad(sealed) + struct.pack("<QQ", len(aad), len(sealed))])[0]


def session13(spark, suite, texts, forge=False):
    """Sides of a TLS 1.3 session and its key log; texts are application data by side."""
    size, algo = T.AEAD_SUITES[suite]
    secrets = {x: hashlib.new(algo, x.encode()).digest() for x in T.TLS13_LABELS}
    transcript = hello(1, CLIENT, suite, True, b"new.example") + hello(2, SERVER, suite, True)
    sides = {False: record(22, hello(1, CLIENT, suite, True, b"new.example")), True: record(22, hello(2, SERVER, suite, True)) + record(20, b"\x01")}

    def add(resp, epoch, n, inner):
        secret = secrets[T.TLS13_LABELS[2 * epoch + resp]]
        key, iv = label13(secret, b"key", size, algo), label13(secret, b"iv", 12, algo)
        nonce = iv[:4] + (int.from_bytes(iv[4:], "big") ^ n).to_bytes(8, "big")
        aad = b"\x17\x03\x03" + struct.pack("!H", len(inner) + 16)
        sides[resp] += record(23, seal_chacha(key, nonce, inner, aad) if suite == T.CHACHA else seal(spark, key, nonce, inner, aad))

    flight = message(8, b"\x00\x00") + message(11, b"c" * 500)
    for resp in (True, False):
        own = flight if resp else b""
        transcript += own
        secret = secrets[T.TLS13_LABELS[resp]]
        size_hash = hashlib.new(algo).digest_size
        verify = hmac.new(label13(secret, b"finished", size_hash, algo), hashlib.new(algo, transcript).digest(), algo).digest()
        if forge and not resp:
            verify = bytes([verify[0] ^ 1]) + verify[1:]
        said = own + message(20, verify)
        transcript += message(20, verify)
        for n, at in enumerate(range(0, len(said), 200)):  # messages go over records
            add(resp, 0, n, said[at : at + 200] + b"\x16")
    add(True, 1, 0, message(4, b"ticket") + b"\x16")
    for resp, some in texts.items():
        for n, text in enumerate(some):
            add(resp, 1, n + resp, text + b"\x17")
    return sides, [f"{x} {CLIENT.hex()} {s.hex()}" for x, s in secrets.items()]


def session12(spark, suite, texts, forge=False, break_at=None):
    """Sides of a TLS 1.2 session under CBC or GCM; break_at spoils the last byte of the record with that text."""
    cbc = suite in T.CBC_SUITES
    size, mac = T.CBC_SUITES.get(suite, (T.AEAD_SUITES.get(suite, (0,))[0], 0))
    algo = "sha256" if cbc else T.AEAD_SUITES[suite][1]
    block = prf(SECRET, b"key expansion" + SERVER + CLIENT, 2 * size + 2 * mac + 8, algo)
    shake = {False: [hello(1, CLIENT, suite, False)], True: [hello(2, SERVER, suite, False), message(11, b"c" * 300), message(14, b"")]}
    transcript = b"".join(shake[False] + shake[True]) + message(16, b"k" * 60)
    sides = {False: record(22, shake[False][0]), True: b"".join(record(22, m) for m in shake[True])}
    sides[False] += record(22, message(16, b"k" * 60))
    number = {False: 0, True: 0}
    rng = random.Random(suite)

    def add(resp, kind, text):
        key = block[size * resp : size * (1 + resp)]
        head = struct.pack("!QB", number[resp], kind) + b"\x03\x03" + struct.pack("!H", len(text))
        number[resp] += 1
        if cbc:
            mac_key = block[2 * size + mac * resp : 2 * size + mac * (1 + resp)]
            whole = text + hmac.new(mac_key, head + text, "sha1" if mac == 20 else "sha256").digest()
            pad = 15 - len(whole) % 16 + 16 * rng.randint(0, 3)
            whole += bytes([pad]) * (pad + 1)
            if break_at == ("padding", text):
                whole = whole[:-2] + bytes([whole[-2] ^ 1]) + whole[-1:]
            iv = rng.randbytes(16)
            row = spark.range(1).select(F.aes_encrypt(*[F.unhex(F.lit(x.hex())) if isinstance(x, bytes) else F.lit(x) for x in (whole, key, "CBC", "PKCS", iv)])).first()[0]
            body = bytes(row)[:-16]
        else:
            salt = block[2 * size + 4 * resp : 2 * size + 4 * (1 + resp)]
            explicit = rng.randbytes(8)
            body = explicit + seal(spark, key, salt + explicit, text, head)
        if break_at == ("mac", text):
            body = body[:20] + bytes([body[20] ^ 1]) + body[21:]
        sides[resp] += record(kind, body)

    for resp in (False, True):
        if resp:
            transcript += message(4, b"ticket")
            sides[True] += record(22, message(4, b"ticket"))
        verify = prf(SECRET, (b"server" if resp else b"client") + b" finished" + hashlib.new(algo, transcript).digest(), 12, algo)
        if forge and resp:
            verify = verify[:-1] + bytes([verify[-1] ^ 1])
        transcript += message(20, verify)
        sides[resp] += record(20, b"\x01")
        add(resp, 22, message(20, verify))
    for resp, some in texts.items():
        for text in some:
            add(resp, 23, text)
    return sides, [f"CLIENT_RANDOM {CLIENT.hex()} {SECRET.hex()}"]


def keylog(spark, tmp_path, lines):
    (tmp_path / "keys.log").write_text("\n".join(lines) + "\n")
    return T.read_keylog(spark, str(tmp_path / "keys.log"))


TEXTS = {False: [b"GET / HTTP/1.1\r\n", b"q" * 700], True: [b"HTTP/1.1 200 OK", b"x" * 5]}


def opened(spark, tmp_path, sides, lines):
    r = T.records(streams(spark, sides))
    keys = keylog(spark, tmp_path, lines)
    texts = sorted((r.resp, bytes(r.plaintext)) for r in T.plaintexts(r, keys).where("kind = 23").collect())
    checks = [(r.resp, r.version, r.verified) for r in T.finished(r, keys).orderBy("place").collect()]
    return texts, checks


@pytest.mark.parametrize("forge", [False, True])
@pytest.mark.parametrize("suite", [0x1303, 0x1302])
def test_tls13_sessions(spark, tmp_path, suite, forge):
    texts, checks = opened(spark, tmp_path, *session13(spark, suite, TEXTS, forge))
    assert texts == sorted((s, t) for s, some in TEXTS.items() for t in some)
    assert checks == [(True, 3, True), (False, 3, not forge)]


@pytest.mark.parametrize("suite", [0x002F, 0x003C, 0xC013, 0x003D, 0xC02F])
def test_tls12_sessions(spark, tmp_path, suite):
    texts, checks = opened(spark, tmp_path, *session12(spark, suite, TEXTS))
    assert texts == sorted((s, t) for s, some in TEXTS.items() for t in some)
    assert checks == [(False, 2, True), (True, 2, True)]


@pytest.mark.parametrize("fault", ["mac", "padding"])
def test_cbc_faults_open_nothing(spark, tmp_path, fault):
    sides, lines = session12(spark, 0x003C, TEXTS, forge=True, break_at=(fault, TEXTS[False][1]))
    texts, checks = opened(spark, tmp_path, sides, lines)
    assert texts == sorted([(False, TEXTS[False][0]), *[(True, t) for t in TEXTS[True]]])
    assert checks == [(False, 2, True), (True, 2, False)]


def test_rfc_8439():
    key, nonce, aad = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    sealed = bytes.fromhex(
        "d31a8d34648e60db7b86afbc53ef7ec2a4aded51296e08fea9e2b5a736ee62d63dbea45e8ca9671282fafb69da92728b1a71de0a9e060b2905d6a5b67ecd3b36"
        "92ddbd7f2d778b8c9803aee328091b58fab324e4fad675945585808b4831d7bc3ff4def08e4b7a9de576d26586cec64b61161ae10b594f09e26a7e902ecbd0600691"
    )
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    wrong = sealed[:-1] + bytes([sealed[-1] ^ 1])
    assert chacha20_poly1305_open([key] * 4, [nonce] * 4, [sealed, wrong, b"short", sealed], [aad, aad, aad, b""]) == [text, None, None, None]
    one_time = np.frombuffer(bytes.fromhex("85d6be7857556d337f4452fe42d506a80103808afb0db2fd4abff6af4149f51b"), np.uint8)[None]
    assert poly1305(one_time[:0], []) == []
    rng = random.Random(2)
    for n in (0, 1, 5, 40):  # against whole numbers
        keys, said = [rng.randbytes(32) for _ in range(7)], [rng.randbytes(16 * rng.randint(0, n)) for _ in range(7)]
        want = []
        for k, m in zip(keys, said, strict=True):
            r, a = int.from_bytes(k[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, 0
            for i in range(0, len(m), 16):
                a = (a + int.from_bytes(m[i : i + 16] + b"\x01", "little")) * r % ((1 << 130) - 5)
            want.append(((a + int.from_bytes(k[16:], "little")) % (1 << 128)).to_bytes(16, "little"))
        assert poly1305(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 32), said) == want


def test_hello_over_records_and_after_junk(spark):
    h = hello(1, CLIENT, 0x1301, True, b"long.example")
    parts = record(22, h[:3]) + record(22, h[3:50]) + record(22, h[50:])
    junk = bytes(random.Random(4).choices([0x16, 3, 1, 0, 0x17, 0xFF], k=3000))
    for before, resume in ((b"", False), (b"", True), (junk, True), (b"\x16\x03\x01", True)):
        got = T.handshakes(streams(spark, {False: before + parts + record(23, b"sealed") + record(22, b"\x0b\x00\x00\x01x")}), resume).collect()
        assert [(r.type, r.sni, bytes(r.random), r.packet_id) for r in got] == [(1, "long.example", CLIENT, got[0].packet_id)], before[:5]
        told = T.records(streams(spark, {False: before + parts}), resume).where("hello = 1").collect()
        assert [(bytes(r.random), r.offset) for r in told] == [(CLIENT, len(before) + len(parts) - len(h) + 50 - 5)]
    assert T.handshakes(streams(spark, {False: b"xx" + parts}), False).count() == 0


def test_records_know_their_packets():
    stream = b"".join(record(23, bytes([i]) * i) for i in range(1, 60))
    for size in (1, 3, 7, 64, 5000):
        cutter, got = T.Records(), []
        for i in range(0, len(stream), size):
            got += [(offset, packet) for offset, packet, *_ in cutter.feed(stream[i : i + size], i // size)]
            assert len(cutter.pieces) <= 5 + 64
        assert len(got) == 59 and all(packet == offset // size for offset, packet in got)


def test_events_of_what_is_opened(spark, tmp_path):
    sides, lines = session13(spark, 0x1303, TEXTS)
    frames, seq = [tcp(True, SYN, 99, port=443), tcp(False, SYN | ACK, 199, port=443)], {False: 100, True: 200}
    carried = {}
    pieces = {resp: [data[i : i + 60] for i in range(0, len(data), 60)] for resp, data in sides.items()}
    for resp in (False, True):
        place = 0
        for piece in pieces[resp]:
            frames.append(tcp(not resp, ACK, seq[resp], piece, port=443))
            carried[resp, place] = len(frames)
            seq[resp] += len(piece)
            place += len(piece)
    rows = spark.createDataFrame([("s", i + 1, 1000 * i, f) for i, f in enumerate(frames)], "session_id string, packet_id long, ts_us long, raw binary")
    keys = keylog(spark, tmp_path, lines)
    t, _, events = I.ingest(rows, keys)
    got = events.orderBy("event_id").collect()
    late = got[-6:]
    assert [(e.event_type, e.summary) for e in late] == [
        ("DECRYPT", "GET / HTTP/1.1"), ("DECRYPT", "q" * 140 + "..."), ("DECRYPT", "HTTP/1.1 200 OK"), ("DECRYPT", "xxxxx"),
        ("TLS", "TLS 1.3 server Finished verified (32B verify_data)"), ("TLS", "TLS 1.3 client Finished verified (32B verify_data)"),
    ]
    assert all(e.packet_id is None and e.flow_id == 1 for e in late) and all(e.event_type != "DECRYPT" for e in got[:-6])
    offsets = {(r.resp, r.n): r.offset for r in T.records(I.reassemble(I.segments_of(t))).collect()}
    opened_at = [(r.resp, offsets[r.resp, r.n]) for r in T.plaintexts(T.records(I.reassemble(I.segments_of(t))), keys).where("kind = 23").orderBy("resp", "n").collect()]
    assert [e.ts_us for e in late[:4]] == [1000 * (carried[resp, at // 60 * 60] - 1) for resp, at in opened_at]
