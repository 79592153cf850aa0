"""Ciphers that Spark has not: ChaCha20-Poly1305, and AES-CBC without its padding rule.

ChaCha20 works on all 64-byte blocks of a batch side by side, Poly1305 on all records of it, in numpy.  AES-CBC is
Spark's own: a forged last block, made with Spark's ECB, satisfies its padding, so what it gives back is the whole
plaintext, TLS padding and all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first words of a ChaCha20 state, and the bits of r that Poly1305 keeps.
SIGMA = np.frombuffer(b"expand 32-byte k", "<u4")
CLAMP = 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
#: Blocks worked on at once.
LANES = 1 << 16
_U26, _P = np.uint64(26), (1 << 130) - 5
_LOW26 = np.uint64((1 << 26) - 1)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def chacha20_blocks(keys: np.ndarray, nonces: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """(n, 64) bytes of key stream for (n, 8) key words, (n, 3) nonce words and n counters."""
    start = np.empty((16, len(counters)), np.uint32)
    start[:4], start[4:12], start[12], start[13:] = SIGMA[:, None], keys.T, counters, nonces.T
    x = list(start.copy())

    def quarter(a: int, b: int, c: int, d: int) -> None:
        for i, j, k, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            x[i] = x[i] + x[j]
            x[k] = _rotated(x[k] ^ x[i], n)

    for _ in range(10):
        for i in range(4):
            quarter(i, i + 4, i + 8, i + 12)
        for i in range(4):
            quarter(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
    return np.ascontiguousarray((np.stack(x) + start).T.astype("<u4")).view(np.uint8)


def _limbs(words: np.ndarray, top: int) -> np.ndarray:
    """(5, n) limbs of 26 bits of (n, 4) little-endian words, with bits above 2**128 as given."""
    w = words.astype(np.uint64).T
    u = np.uint64
    return np.stack([w[0] & _LOW26, (w[0] >> u(26) | w[1] << u(6)) & _LOW26, (w[1] >> u(20) | w[2] << u(12)) & _LOW26, (w[2] >> u(14) | w[3] << u(18)) & _LOW26, (w[3] >> u(8)) | u(top << 24)])


def poly1305(one_time: np.ndarray, messages: list[bytes]) -> list[bytes]:
    """Tags of messages of whole 16-byte blocks, under (n, 32) one-time keys."""
    order = sorted(range(len(messages)), key=lambda i: -len(messages[i]))  # so that those still at work come first
    sizes = np.array([len(messages[i]) // 16 for i in order])
    r = [int.from_bytes(one_time[i, :16].tobytes(), "little") & CLAMP for i in order]
    r_words = np.frombuffer(b"".join(x.to_bytes(16, "little") for x in r), "<u4").reshape(-1, 4)
    r5 = _limbs(r_words, 0)
    s5 = r5 * np.uint64(5)
    blocks = [np.frombuffer(messages[i], "<u4").reshape(-1, 4) for i in order]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.concatenate(blocks) if blocks else np.zeros((0, 4), np.uint32)
    h = np.zeros((5, len(order)), np.uint64)
    for j in range(int(sizes.max(initial=0))):
        k = int(np.searchsorted(-sizes, -j, "left"))  # records with more than j blocks
        a = h[:, :k] + _limbs(flat[starts[:k] + j], 1)
        d = [sum(a[q] * (r5[p - q, :k] if q <= p else s5[5 + p - q, :k]) for q in range(5)) for p in range(5)]
        for p in range(4):
            d[p + 1] += d[p] >> _U26
            d[p] &= _LOW26
        d[0] += (d[4] >> _U26) * np.uint64(5)
        d[4] &= _LOW26
        d[1] += d[0] >> _U26
        d[0] &= _LOW26
        h[:, :k] = d
    out = [b""] * len(messages)
    for column, i in enumerate(order):
        total = sum(int(h[p, column]) << 26 * p for p in range(5)) % _P
        out[i] = ((total + int.from_bytes(one_time[i, 16:].tobytes(), "little")) % (1 << 128)).to_bytes(16, "little")
    return out


def chacha20_poly1305_open(keys: list[bytes], nonces: list[bytes], sealed: list[bytes], aads: list[bytes]) -> list[bytes | None]:
    """Plaintexts of ciphertexts that end in their tags; None where a tag is wrong."""
    out: list[bytes | None] = []
    sizes = [max(0, len(s) - 16) for s in sealed]
    at = 0
    while at < len(sealed):
        end, lanes = at, 0
        while end < len(sealed) and (end == at or lanes < LANES):
            lanes += 1 + -(-sizes[end] // 64)
            end += 1
        out += _open_some(keys[at:end], nonces[at:end], sealed[at:end], aads[at:end])
        at = end
    return out


def _open_some(keys: list[bytes], nonces: list[bytes], sealed: list[bytes], aads: list[bytes]) -> list[bytes | None]:
    lanes = np.array([1 + -(-max(0, len(s) - 16) // 64) for s in sealed])  # block 0 is the one-time key
    first = np.cumsum(lanes) - lanes
    of = np.repeat(np.arange(len(sealed)), lanes)
    key_words, nonce_words = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 8), np.frombuffer(b"".join(nonces), "<u4").reshape(-1, 3)
    stream = chacha20_blocks(key_words[of], nonce_words[of], (np.arange(len(of)) - first[of]).astype(np.uint32))
    texts = [s[:-16] for s in sealed]
    tags = poly1305(stream[first, :32], [_authenticated(a, t) for a, t in zip(aads, texts, strict=True)])
    out: list[bytes | None] = []
    for i, (text, tag) in enumerate(zip(texts, tags, strict=True)):
        if len(sealed[i]) < 16 or tag != sealed[i][-16:]:
            out.append(None)
            continue
        mask = stream[first[i] + 1 : first[i] + lanes[i]].reshape(-1)[: len(text)]
        out.append((np.frombuffer(text, np.uint8) ^ mask).tobytes())
    return out


def chacha20_poly1305_seal(keys: list[bytes], nonces: list[bytes], texts: list[bytes], aads: list[bytes]) -> list[bytes]:
    """Ciphertexts with their tags."""
    lanes = np.array([1 + -(-len(t) // 64) for t in texts], np.int64)
    first = np.cumsum(lanes) - lanes
    of = np.repeat(np.arange(len(texts)), lanes)
    key_words, nonce_words = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 8), np.frombuffer(b"".join(nonces), "<u4").reshape(-1, 3)
    stream = chacha20_blocks(key_words[of], nonce_words[of], (np.arange(len(of)) - first[of]).astype(np.uint32))
    sealed = [(np.frombuffer(t, np.uint8) ^ stream[f + 1 : f + n].reshape(-1)[: len(t)]).tobytes() for t, f, n in zip(texts, first, lanes, strict=True)]
    tags = poly1305(stream[first, :32], [_authenticated(a, s) for a, s in zip(aads, sealed, strict=True)])
    return [s + t for s, t in zip(sealed, tags, strict=True)]


def _authenticated(aad: bytes, text: bytes) -> bytes:
    return aad + bytes(-len(aad) % 16) + text + bytes(-len(text) % 16) + len(aad).to_bytes(8, "little") + len(text).to_bytes(8, "little")


def _each(work, key: pd.Series, nonce: pd.Series, data: pd.Series, aad: pd.Series) -> pd.Series:
    some = [i for i, x in enumerate(zip(key, nonce, data, aad, strict=True)) if all(v is not None for v in x) and len(x[0]) == 32 and len(x[1]) == 12]
    out = pd.Series([None] * len(key), dtype=object)
    done = work(*[[bytes(c.iloc[i]) for i in some] for c in (key, nonce, data, aad)]) if some else []
    for i, text in zip(some, done, strict=True):
        out.iloc[i] = text
    return out


def _chacha(key: pd.Series, nonce: pd.Series, sealed: pd.Series, aad: pd.Series) -> pd.Series:
    return _each(chacha20_poly1305_open, key, nonce, sealed, aad)


def _chacha_sealed(key: pd.Series, nonce: pd.Series, text: pd.Series, aad: pd.Series) -> pd.Series:
    return _each(chacha20_poly1305_seal, key, nonce, text, aad)


def chacha_seal(key: Column, nonce: Column, text: Column, aad: Column) -> Column:
    """Ciphertext and tag; null as for ``chacha_open``."""
    return F.pandas_udf(_chacha_sealed, "binary")(key, nonce, text, aad)


def chacha_open(key: Column, nonce: Column, sealed: Column, aad: Column) -> Column:
    """Plaintext, or null for a wrong tag, and for keys and nonces of another size or null."""
    return F.pandas_udf(_chacha, "binary")(key, nonce, sealed, aad)


def _xored(block: Column, byte: int) -> Column:
    """16 bytes, each with ``byte``."""
    half = int.from_bytes(bytes([byte]) * 8, "big")
    part = lambda at: F.conv(F.hex(F.substring(block, at, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(half))
    return F.unhex(F.concat(*[F.lpad(F.hex(part(at)), 16, "0") for at in (1, 9)]))


def cbc_open(iv: Column, sealed: Column, key: Column) -> Column:
    """All bytes under AES-CBC, padding included; null unless there are whole blocks."""
    size = F.octet_length(sealed)
    last = F.substring(sealed, size - 15, F.lit(16))
    # deciphers to sixteen bytes of 16, the padding that Spark takes off
    forged = F.substring(F.aes_encrypt(_xored(last, 16), key, F.lit("ECB"), F.lit("PKCS")), 1, 16)
    good = (size > 0) & (size % 16 == 0) & key.isNotNull()
    return F.when(good, F.try_aes_decrypt(F.concat(iv, sealed, forged), key, F.lit("CBC"), F.lit("PKCS")))


def hmac(inner: Column, outer: Column, message: Column, size: Column) -> Column:
    """HMAC of 20 (SHA-1) or 32 bytes (SHA-256), from its key's padded halves."""
    def digest(c: Column) -> Column:
        return F.when(size == 20, F.unhex(F.sha1(c))).otherwise(F.unhex(F.sha2(c, 256)))

    return digest(F.concat(outer, digest(F.concat(inner, message))))
