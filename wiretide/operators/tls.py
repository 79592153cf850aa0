"""Plaintext of TLS sessions whose secrets are known, by joins with a key log.

Records are cut off reassembled directions, handshake messages off records.  Hellos give randoms and suite; the
key log is joined on the client random; small Arrow functions derive keys for each direction; records are
then opened by Spark's AES (GCM, or CBC with a MAC) or by ChaCha20-Poly1305, which all authenticate, so that a wrong
key or number gives null and no error.  Finished messages are checked against the transcript of their flow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hmac import compare_digest as hmac_same
from hmac import digest as hmac_digest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretide.functions.frames import big_endian, octets
from wiretide.functions.protocols import Parts, server_name
from wiretide.operators.ciphers import cbc_open, chacha_open, hmac
from wiretide.operators.ordered import dealt, numbered
from wiretide.operators.reassembly import DIRECTION
from wiretide.operators.scratch import materialize

#: Fixed names of secrets in key logs.
TLS12_LABEL = "CLIENT_RANDOM"
TLS13_LABELS = ("CLIENT_HANDSHAKE_TRAFFIC_SECRET", "SERVER_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0")
#: CBC suites of TLS 1.2: length of the key and of the MAC; their hash is SHA-256.
CBC_SUITES = {0x002F: (16, 20), 0x0035: (32, 20), 0xC013: (16, 20), 0xC014: (32, 20), 0x003C: (16, 32), 0x003D: (32, 32), 0xC027: (16, 32), 0xC028: (32, 32)}
CHACHA = 0x1303
#: AEAD suites: length of the key and hash.
AEAD_SUITES = {CHACHA: (32, "sha256"), 0x1301: (16, "sha256"), 0x1302: (32, "sha384"), 0xC02B: (16, "sha256"), 0xC02F: (16, "sha256"), 0x009C: (16, "sha256"), 0xC02C: (32, "sha384"), 0xC030: (32, "sha384"), 0x009D: (32, "sha384")}
CHANGE_CIPHER, HANDSHAKE, APPLICATION = 20, 22, 23
CLIENT_HELLO, SERVER_HELLO, NEW_TICKET, FINISHED = 1, 2, 4, 20
#: Longest body of a record, and longest handshake message that is put together.
MAX_RECORD, MAX_MESSAGE = (1 << 14) + 2048, 1 << 20
_RECORDS = "session_id string, flow_id long, resp boolean, n long, offset long, packet_id long, kind int, version int, body binary, hello int, random binary, suite int, tls13 boolean"
_MESSAGES = "session_id string, flow_id long, resp boolean, n long, packet_id long, type int, size long, sni string, random binary, suite int"


def read_keylog(spark: SparkSession, path: str) -> DataFrame:
    """``(label, client_random, secret)`` of the lines of a key log that have a known label; others are left out.

    Of several secrets for one label and random the last line counts, of the last file by name.
    """
    words = F.split(F.trim("value"), r"\s+")
    # blocks of a file hold its lines in order, and rows of a block are numbered upwards
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(words.alias("w"), place.alias("at")).where(F.size("w") == 3)
    known = F.col("w")[0].isin(TLS12_LABEL, *TLS13_LABELS)
    parsed = lines.where(known).select(F.col("w")[0].alias("label"), F.expr("try_to_binary(w[1], 'hex')").alias("client_random"), F.expr("try_to_binary(w[2], 'hex')").alias("secret"), "at")
    known = parsed.where("client_random is not null and secret is not null")
    return known.groupBy("label", "client_random").agg(F.max_by("secret", "at").alias("secret"))


def _hello(body: bytes) -> tuple[int | None, bytes | None, int | None, bool]:
    """(1 or 2, random, suite, whether TLS 1.3 is chosen) of a hello, as far as there is one."""
    if len(body) < 38 or body[0] not in (1, 2):
        return None, None, None, False
    random, suite, new = body[6:38], None, False
    try:
        p = Parts(body, 38)
        p.block(1)
        if body[0] == 2:
            suite = p.number(2)
            p.take(1)
            more = p.block(2)
            while more.more():
                kind, value = more.number(2), more.block(2)
                new |= kind == 43 and value.data == b"\x03\x04"
    except ValueError:
        pass
    return body[0], random, suite, new


class Records:
    """Cuts a direction's bytes, piece by piece, into records: ``(offset, packet, kind, version, body)``.

    packet is the one that carried the record's first byte: pieces are an interval each of the stream's
    offsets, and only those under the unfinished record are remembered.  What is no record ends the
    direction; with ``resume`` it is skipped up to a place where two record heads follow one another, or one fits
    what is left, so a stream that is joined midway is read too.
    """

    def __init__(self, resume: bool = False) -> None:
        self.held, self.offset, self.live, self.resume = bytearray(), 0, True, resume
        self.pieces: list[tuple[int, int | None]] = []  # (first offset, packet)
        self.end = 0

    def feed(self, data: bytes, packet: int | None) -> Iterator[tuple[int, int | None, int, int, bytes]]:
        if self.live:
            self.pieces.append((self.end, packet))
            self.end += len(data)
            self.held += data
            yield from self._whole(last=False)

    def finish(self) -> Iterator[tuple[int, int | None, int, int, bytes]]:
        """Records behind a head that waits for bytes which do not come; only where the scan resumes."""
        if self.live and self.resume:
            yield from self._whole(last=True)

    def _whole(self, last: bool) -> Iterator[tuple[int, int | None, int, int, bytes]]:
        at, held = 0, self.held
        while len(held) - at >= 5:
            size = int.from_bytes(held[at + 3 : at + 5], "big")
            if not (20 <= held[at] <= 24 and (not self.resume or self._head(at))):
                if not self.resume:
                    self.live, self.held, self.pieces = False, bytearray(), []
                    return
                at = self._next(at + 1)
                continue
            if len(held) - at < 5 + size:
                if not last:
                    break
                at = self._next(at + 1)
                continue
            if self.resume and len(held) - at >= 10 + size and not self._head(at + 5 + size):
                at = self._next(at + 1)  # one head alone in what is no stream of records
                continue
            yield self.offset + at, self._packet(self.offset + at), held[at], int.from_bytes(held[at + 1 : at + 3], "big"), bytes(held[at + 5 : at + 5 + size])
            at += 5 + size
        del held[:at]
        self.offset += at
        self._packet(self.offset)

    def _head(self, at: int) -> bool:
        h = self.held[at : at + 5]
        return 20 <= h[0] <= 24 and h[1] == 3 and h[2] <= 4 and int.from_bytes(h[3:5], "big") <= MAX_RECORD

    def _next(self, at: int) -> int:
        """The next place that may begin a record."""
        n = len(self.held)
        while at < n and not (20 <= self.held[at] <= 24 and (at + 1 >= n or self.held[at + 1] == 3)):
            at += 1
        return at

    def _packet(self, offset: int) -> int | None:
        k = 0
        while k + 1 < len(self.pieces) and self.pieces[k + 1][0] <= offset:
            k += 1
        del self.pieces[:k]
        return self.pieces[0][1] if self.pieces else None


class Messages:
    """Puts handshake messages together from record bodies; zeros, as padding leaves them, and messages over MAX_MESSAGE end it."""

    def __init__(self) -> None:
        self.held, self.live = bytearray(), True

    def feed(self, body: bytes) -> Iterator[bytes]:
        if self.live:
            self.held += body
        while self.live and len(self.held) >= 4:
            size = int.from_bytes(self.held[1:4], "big")
            if size > MAX_MESSAGE or (size == 0 and self.held[0] == 0):
                self.live, self.held = False, bytearray()
            elif len(self.held) < 4 + size:
                return
            else:
                message = bytes(self.held[: 4 + size])
                del self.held[: 4 + size]
                yield message


def _cut(resume: bool, as_messages: bool):
    """Pieces of sorted directions -> rows of records, or of the handshake messages in plain records."""
    names = [c.split()[0] for c in (_MESSAGES if as_messages else _RECORDS).split(", ")]

    def rows(key: tuple, found: Iterator, said: Messages, n: int) -> Iterator[tuple]:
        for offset, packet, kind, version, body in found:
            if kind in (CHANGE_CIPHER, APPLICATION):
                said.live = False  # what follows is sealed
            if resume and kind == HANDSHAKE and not said.live and body[:1] == bytes([CLIENT_HELLO]) and body[1:2] in (b"", b"\x00"):
                said.held, said.live = bytearray(), True  # a hello begins anew
            messages = list(said.feed(body)) if kind == HANDSHAKE else []
            if as_messages:
                for m in messages:
                    n += 1
                    hello = _hello(m)
                    yield (*key, n, packet, m[0], len(m) - 4, server_name(m[4:]) if m[0] == CLIENT_HELLO else None, hello[1], hello[2])
            else:
                n += 1
                hello = next((h for h in map(_hello, messages) if h[0]), (None, None, None, False))
                yield (*key, n, offset, packet, kind, version, body, *hello)

    def table(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("hello", "suite", "packet_id") if c in names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, records, said, n = None, Records(resume), Messages(), 0
        for batch in batches:
            out = []
            for session, flow, resp, at, data in batch.itertuples(index=False, name=None):
                if (session, flow, resp) != key:
                    out += rows(key, records.finish(), said, n)
                    key, records, said, n = (session, flow, resp), Records(resume), Messages(), 0
                new = list(rows(key, records.feed(bytes(data), at), said, n))
                n += len(new)
                out += new
            if out:
                yield table(out)
        if out := list(rows(key, records.finish(), said, n)) if key else []:
            yield table(out)

    return run


def _directions(reassembled: DataFrame) -> DataFrame:
    """Pieces of each direction in order, with the packet that carried each, or that waited behind the last hole."""
    packet = "coalesce(packet_id, cause_packet)" if "cause_packet" in reassembled.columns else "packet_id"
    r = reassembled.where("octet_length(data) > 0").selectExpr(*DIRECTION, "coalesce(packet_id, 9223372036854775807) at", f"{packet} packet", "data")
    return r.repartition(*DIRECTION).sortWithinPartitions(*DIRECTION, "at").select(*DIRECTION, F.coalesce("packet", F.lit(-1)).alias("packet"), "data")


def records(reassembled: DataFrame, resume: bool = False) -> DataFrame:
    """TLS records of each direction in order, with the packet that carried the first byte of each; an unfinished one at the end is left out.

    A hello is told with the record that completes it, over however many records it goes.  resume: read on
    after what is no record.
    """
    return _directions(reassembled).mapInPandas(_cut(resume, False), _RECORDS)


def handshakes(reassembled: DataFrame, resume: bool = True) -> DataFrame:
    """Handshake messages of each direction that are not sealed, numbered, with host name, random and suite of hellos."""
    return _directions(reassembled).mapInPandas(_cut(resume, True), _MESSAGES)


def expand12(secret: bytes, seed: bytes, size: int, algo: str) -> bytes:
    """The TLS 1.2 pseudo-random function; seed begins with its label."""
    out, a = b"", seed
    while len(out) < size:
        a = hmac_digest(secret, a, algo)
        out += hmac_digest(secret, a + seed, algo)
    return out[:size]


def expand13(secret: bytes, label: str, size: int, algo: str) -> bytes:
    """HKDF-Expand-Label with an empty context."""
    name = b"tls13 " + label.encode()
    info = size.to_bytes(2, "big") + bytes([len(name)]) + name + b"\x00"
    out, block, i = b"", b"", 1
    while len(out) < size:
        block = hmac_digest(secret, block + info + bytes([i]), algo)
        out, i = out + block, i + 1
    return out[:size]


_KEYS = "key binary, iv binary, inner binary, outer binary"


def _padded(key: bytes, byte: int) -> bytes:
    """A key of HMAC, filled up to a block of 64 bytes, each with ``byte``."""
    return bytes(x ^ byte for x in key.ljust(64, b"\x00"))


def _keys(secret: pd.Series, suite: pd.Series, new: pd.Series, seed: pd.Series, resp: pd.Series) -> pd.DataFrame:
    out = []
    for s, code, tls13, randoms, server in zip(secret, suite, new, seed, resp, strict=True):
        size, algo = AEAD_SUITES.get(code, (0, ""))
        if s is not None and code in CBC_SUITES and not tls13:
            size, mac = CBC_SUITES[code]
            block = expand12(s, b"key expansion" + randoms, 2 * size + 2 * mac + 32, "sha256")
            mac_key = block[2 * size + mac * server : 2 * size + mac * (1 + server)]
            out.append((block[size * server : size * (1 + server)], None, _padded(mac_key, 0x36), _padded(mac_key, 0x5C)))
        elif s is None or not size:
            out.append((None, None, None, None))
        elif tls13:
            out.append((expand13(s, "key", size, algo), expand13(s, "iv", 12, algo), None, None))
        elif code == CHACHA:
            out.append((None, None, None, None))
        else:
            block = expand12(s, b"key expansion" + randoms, 2 * size + 8, algo)
            out.append((*((block[size : 2 * size], block[2 * size + 4 :]) if server else (block[:size], block[2 * size : 2 * size + 4])), None, None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _KEYS.split(", ")])


def derived(secret: Column, suite: Column, tls13: Column, randoms: Column, resp: Column) -> Column:
    """struct(key, iv, inner, outer) of a direction; null fields for other suites.  randoms is the server's, then the client's."""
    return F.pandas_udf(_keys, _KEYS)(secret, suite, tls13, randoms, resp)


def _open(nonce: Column, sealed: Column, key: Column, aad: Column) -> Column:
    return F.try_aes_decrypt(F.concat(nonce, sealed), key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def counted(iv: Column, number: Column) -> Column:
    """A nonce of 12 bytes: iv with the record's number added without carry."""
    low = F.conv(F.hex(F.substring(iv, 5, 8)), 16, -10).cast("long").bitwiseXOR(number)
    return F.concat(F.substring(iv, 1, 4), big_endian(low, 8))


def _cbc_content(plain: Column, number: Column, kind: Column, mac: Column, inner: Column, outer: Column) -> Column:
    """Content of a CBC record: padding and MAC are taken off after both are found right, else null."""
    size = F.octet_length(plain)
    last = F.substring(plain, size, F.lit(1))
    pad = F.conv(F.hex(last), 16, 10).cast("int")
    length = size - 1 - pad - mac
    padding = F.substring(plain, size - pad, pad + 1) == F.unhex(F.repeat(F.hex(last), pad + 1))
    content = F.substring(plain, F.lit(1), length)
    said = F.concat(big_endian(number, 8), big_endian(kind, 1), octets("0303"), big_endian(length, 2), content)
    right = F.substring(plain, length + 1, mac) == hmac(inner, outer, said, mac)
    return F.when((length >= 0) & padding, F.when(right, content))


def _secrets(r: DataFrame, keylog: DataFrame) -> DataFrame:
    """One row a flow that has both hellos and secrets: randoms, suite, whether TLS 1.3, and the secrets by label; stored."""
    flow = ["session_id", "flow_id"]
    first = lambda c, hello: F.min_by(c, F.when(F.col("hello") == hello, F.col("n")))
    known = r.where("hello is not null").groupBy(*flow).agg(first("random", 1).alias("client"), first("random", 2).alias("server"), first("suite", 2).alias("suite"), first("tls13", 2).alias("new"))
    per = keylog.groupBy("client_random").agg(*[F.max(F.when(F.col("label") == x, F.col("secret"))).alias(f"of_{x}") for x in (TLS12_LABEL, *TLS13_LABELS)])
    return materialize(known.join(per, F.col("client") == F.col("client_random")).where("suite is not null"), "tls-secrets")


def plaintexts(records: DataFrame, keylog: DataFrame) -> DataFrame:
    """``(session_id, flow_id, resp, n, offset, packet_id, kind, epoch, plaintext)`` of the records that the key log opens.

    kind is the type of what is inside: 22 handshake, 23 application data.  epoch is 1 under the keys of the handshake
    (TLS 1.3) or of the session (1.2), 2 under those of the application (1.3).  Flows without hellos, secrets or a known
    suite, and records that do not authenticate, give nothing.  A later handshake on the same flow is not followed.
    """
    r = materialize(records, "records")
    return _opened(r, _secrets(r, keylog))


def _opened(r: DataFrame, known: DataFrame) -> DataFrame:
    flow = ["session_id", "flow_id"]
    k = known.withColumn("resp", F.explode(F.array(F.lit(False), F.lit(True))))
    side = lambda i: F.when(F.col("resp"), F.col(f"of_{TLS13_LABELS[i + 1]}")).otherwise(F.col(f"of_{TLS13_LABELS[i]}"))
    randoms = F.concat("server", "client")
    one = derived(F.when(F.col("new"), side(0)).otherwise(F.col(f"of_{TLS12_LABEL}")), F.col("suite"), F.col("new"), randoms, F.col("resp"))
    two = derived(F.when(F.col("new"), side(2)), F.col("suite"), F.col("new"), randoms, F.col("resp"))
    mac = mapped_int(F.col("suite"), {c: m for c, (_, m) in CBC_SUITES.items()})
    keys = materialize(k.select(*flow, "resp", "new", (F.col("suite") == CHACHA).alias("chacha"), mac.alias("mac"), one.alias("k1"), two.alias("k2")), "tls-keys")
    j = r.join(keys, [*flow, "resp"])
    w = Window.partitionBy(*flow, "resp").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # TLS 1.2 counts from the change of ciphers, TLS 1.3 its records of outer type 23
    changed = F.max((F.col("kind") == CHANGE_CIPHER).cast("int")).over(upto) == 1
    sealed = F.when(F.col("new"), F.col("kind") == APPLICATION).otherwise(changed & (F.col("kind") != CHANGE_CIPHER))
    j = j.withColumn("sealed", sealed).withColumn("number", F.sum(F.col("sealed").cast("long")).over(upto) - 1).where("sealed")
    size = F.octet_length("body")
    gcm = ~F.col("new") & F.col("mac").isNull()
    old_aad = F.concat(big_endian(F.col("number"), 8), big_endian(F.col("kind"), 1), octets("0303"), big_endian(size - 24, 2))
    old = _open(F.concat(F.col("k1.iv"), F.substring("body", 1, 8)), F.substring(F.col("body"), F.lit(9), size), F.col("k1.key"), old_aad)
    aad = F.concat(octets("170303"), big_endian(size, 2))

    def sealed13(keys: str, number: Column) -> Column:
        nonce, chacha = counted(F.col(f"{keys}.iv"), number), F.col("new") & F.col("chacha") & (number >= 0)
        other = chacha_open(F.when(chacha, F.col(f"{keys}.key")), nonce, F.col("body"), aad)
        return F.when(F.col("chacha"), other).when(number >= 0, _open(nonce, F.col("body"), F.col(f"{keys}.key"), aad))

    cbc = cbc_open(F.substring("body", 1, 16), F.substring(F.col("body"), F.lit(17), size), F.when(~F.col("new") & F.col("mac").isNotNull(), F.col("k1.key")))
    j = materialize(j.withColumns({"shake": F.when(F.col("new"), sealed13("k1", F.col("number"))), "cbc": cbc, "gcm": F.when(gcm & (size > 24), old)}), "tried")
    content = _cbc_content(F.col("cbc"), F.col("number"), F.col("kind"), F.col("mac"), F.col("k1.inner"), F.col("k1.outer"))
    j = j.withColumn("opened", F.coalesce("shake", "gcm", F.when(F.col("cbc").isNotNull(), content)))
    # TLS 1.3: what the handshake's keys do not open is counted again, from the end of the handshake
    before = F.count_if(F.col("shake").isNotNull()).over(Window.partitionBy(*flow, "resp"))
    j = materialize(j.withColumn("after", F.when(F.col("new") & F.col("shake").isNull(), F.col("number") - before)), "opened")
    text = F.coalesce("opened", F.when(F.col("after") >= 0, sealed13("k2", F.col("after"))))
    found = materialize(j.select(*flow, "resp", "n", "offset", "packet_id", "kind", "new", F.when(F.col("new") & F.col("opened").isNull(), 2).otherwise(1).alias("epoch"), text.alias("inner")).where("inner is not null"), "inner")
    length = F.octet_length("inner")
    kind = F.when(F.col("new"), F.conv(F.hex(F.substring(F.col("inner"), length, F.lit(1))), 16, 10).cast("int")).otherwise(F.col("kind"))
    inside = F.when(F.col("new"), F.substring(F.col("inner"), F.lit(1), length - 1)).otherwise(F.col("inner"))
    # zeros at the end of an application record pad it
    bare = F.encode(F.regexp_replace(F.decode(inside, "ISO-8859-1"), "\\x00+$", ""), "ISO-8859-1")
    out = found.select(*flow, "resp", "n", "offset", "packet_id", kind.alias("kind"), "epoch", inside.alias("inside"), F.when(F.col("new") & (kind == APPLICATION), bare).alias("bare"))
    return out.select(*flow, "resp", "n", "offset", "packet_id", "kind", "epoch", F.coalesce("bare", "inside").alias("plaintext"))


def mapped_int(c: Column, names: dict[int, int]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in names.items()])


_CHECKS = "session_id string, flow_id long, resp boolean, packet_id long, place int, version int, verified boolean, expected binary, actual binary"


def _rank(kind: int, server: bool, new: bool) -> int:
    """Place of a handshake message in its flow's transcript, whatever the order in which directions were captured."""
    if kind == CLIENT_HELLO:
        return 0
    if kind == NEW_TICKET and not new:
        return 4  # between the two Finished messages
    if kind != FINISHED:
        return 1 if server else 2
    return (3 if server else 4) if new else (5 if server else 3)


def _checked(said: pd.DataFrame) -> pd.DataFrame:
    """Handshake bytes of one flow -> its Finished messages, compared with what the transcript before each demands."""
    one = said.iloc[0]
    new, algo = bool(one.new), AEAD_SUITES.get(int(one.suite), (0, "sha256"))[1]
    told = []
    for server in (False, True):
        plain, sealed, first = Messages(), Messages(), None
        for r in said[said["resp"] == server].sort_values("n").itertuples(index=False):
            if r.sealed and first is None:
                first = r.packet_id
            at = first if new and r.sealed else r.packet_id
            told += [(_rank(m[0], server, new), server, at, m) for m in (sealed if r.sealed else plain).feed(bytes(r.data))]
    transcript, out = hashlib.new(algo), []
    for place, (_, server, packet, m) in enumerate(sorted(told, key=lambda x: x[0])):
        if m[0] == FINISHED:
            secret, digest = (one.server_secret if server else one.client_secret) if new else one.master, transcript.digest()
            if secret is not None:
                if new:
                    expected = hmac_digest(expand13(secret, "finished", len(digest), algo), digest, algo)
                else:
                    expected = expand12(secret, (b"server" if server else b"client") + b" finished" + digest, 12, algo)
                actual = m[4 : 4 + len(expected)]
                out.append((one.session_id, one.flow_id, server, packet, place, 3 if new else 2, hmac_same(expected, actual), expected, actual))
        transcript.update(m)
    return pd.DataFrame(out, columns=[c.split()[0] for c in _CHECKS.split(", ")], dtype=object).astype({"flow_id": "Int64", "packet_id": "Int64", "place": "Int32", "version": "Int32"})


def finished(records: DataFrame, keylog: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """Finished messages of each flow in order of its transcript, with what their verify data should be.

    A flow's handshake, some kilobytes, is put together in one task; application data stay where they are.  Flows
    without hellos or secrets, or whose Finished can't be opened, give nothing.  In TLS 1.3 a sealed message
    has the packet of its direction's first sealed record.
    """
    r = materialize(records, "records")
    known = _secrets(r, keylog)
    opened = _opened(r, known) if opened is None else opened
    flow = ["session_id", "flow_id"]
    change = F.min(F.when(F.col("kind").isin(CHANGE_CIPHER, APPLICATION), F.col("n")))
    sealed_from = r.where(F.col("kind").isin(CHANGE_CIPHER, APPLICATION)).groupBy(*flow, "resp").agg(change.alias("sealed_from"))
    plain = r.where(F.col("kind") == HANDSHAKE).join(sealed_from, [*flow, "resp"], "left").where("sealed_from is null or n < sealed_from")
    columns = [*flow, "resp", "n", "packet_id"]
    said = plain.select(*columns, F.lit(False).alias("sealed"), F.col("body").alias("data"))
    said = said.unionByName(opened.where(f"kind = {HANDSHAKE} and epoch = 1").select(*columns, F.lit(True).alias("sealed"), F.col("plaintext").alias("data")))
    own = known.select(*flow, "suite", "new", F.col(f"of_{TLS12_LABEL}").alias("master"), F.col(f"of_{TLS13_LABELS[0]}").alias("client_secret"), F.col(f"of_{TLS13_LABELS[1]}").alias("server_secret"))
    return said.join(own, flow).groupBy(*flow).applyInPandas(_checked, _CHECKS)


def finished_summary() -> Column:
    """Text of a row of ``finished``."""
    head = F.concat(F.lit("TLS 1."), F.col("version").cast("string"), F.lit(" "), F.when(F.col("resp"), "server").otherwise("client"), F.lit(" Finished "))
    short = lambda c: F.concat(F.substring(F.lower(F.hex(c)), 1, 12), F.lit("..."))
    right = F.concat(F.lit("verified ("), F.octet_length("expected").cast("string"), F.lit("B verify_data)"))
    return F.concat(head, F.when(F.col("verified"), right).otherwise(F.concat(F.lit("MISMATCH (expected "), short("expected"), F.lit(" actual "), short("actual"), F.lit(")"))))


def decrypt_events(records: DataFrame, keylog: DataFrame, packets: DataFrame) -> DataFrame:
    """``(session_id, packet_id, ts_us, flow_id, pos, event_type, summary)``: DECRYPT events of application data, then TLS events of Finished messages.

    By flow: the initiator's records, the responder's, then the checks.  packet_id is null, as these events come
    after all others; ts_us is that of the packet that carried the record's first byte.
    """
    r = materialize(records, "records")
    opened = materialize(_opened(r, _secrets(r, keylog)), "plaintexts")
    data = opened.where(f"kind = {APPLICATION} and octet_length(plaintext) > 0")
    data = data.select("session_id", "flow_id", F.col("resp").cast("int").alias("section"), "n", "packet_id", F.lit("DECRYPT").alias("event_type"), plaintext_summary(F.col("plaintext")).alias("summary"))
    checks = finished(r, keylog, opened).select("session_id", "flow_id", F.lit(2).alias("section"), F.col("place").cast("long").alias("n"), "packet_id", F.lit("TLS").alias("event_type"), finished_summary().alias("summary"))
    at = packets.select("session_id", "packet_id", "ts_us")
    both = data.unionByName(checks).join(at, ["session_id", "packet_id"], "left")
    order = ["flow_id", "section", "n"]
    ranked = numbered(dealt(both, order), order, "rank")
    # after the holes that are open at the end
    return ranked.select("session_id", F.lit(None).cast("long").alias("packet_id"), "ts_us", "flow_id", (F.lit(1 << 60) + F.col("rank")).alias("pos"), "event_type", "summary")


def plaintext_summary(plaintext: Column) -> Column:
    """Text with runs of blanks folded, at most 140 characters and dots; the size where nothing shows."""
    text = F.trim(F.regexp_replace(F.decode(plaintext, "UTF-8"), r"\s+", " "))
    short = F.when(F.length(text) > 140, F.concat(F.substring(text, 1, 140), F.lit("..."))).otherwise(text)
    return F.when(text == "", F.concat(F.lit("<"), F.octet_length(plaintext).cast("string"), F.lit(" plaintext bytes>"))).otherwise(short)
