"""Keys and sealing.

HKDF and HMAC follow RFC 5869 and RFC 2104.  Sealing uses Spark's AES-GCM where other systems use ChaCha20-Poly1305, and the
passphrase KDF is scrypt instead of Argon2id: neither is in the image.  Signatures have no library here either and are
taken as a precomputed column.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def hkdf(secret: bytes, info: bytes, length: int = 32, salt: bytes = b"") -> bytes:
    key = hmac.new(salt or b"\0" * 32, secret, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(key, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:length]


def blind_id(folder_key: bytes, chunk_id: bytes, label: bytes = b"foldlake blind id") -> bytes:
    """An id that holders see instead of the content's own."""
    return hkdf(folder_key, label + chunk_id)


def verifier(folder_key: bytes, label: bytes = b"foldlake verifier") -> bytes:
    """What two sides compare to know that they hold the same key."""
    return hkdf(folder_key, label)


def passphrase_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def hmac_column(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 under a constant key, as an expression: the key's two pads are constants."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.unhex(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256))


def hkdf_column(secret: bytes, info: Column) -> Column:
    """``hkdf(secret, info)`` of 32 bytes for a constant secret."""
    return hmac_column(hmac.new(b"\0" * 32, secret, hashlib.sha256).digest(), F.concat(info, F.lit(b"\1")))


def blind_id_column(folder_key: bytes, chunk_id: Column, label: bytes = b"foldlake blind id") -> Column:
    return hkdf_column(folder_key, F.concat(F.lit(label), chunk_id))


def seal(data: Column, key: bytes, chunk_id: Column) -> Column:
    """Convergent sealing: key and nonce come from the content id, so equal contents give equal ciphertexts; the id is authenticated."""
    nonce = F.substring(hkdf_column(key, F.concat(F.lit(b"nonce"), chunk_id)), 1, 12)
    return F.aes_encrypt(data, hkdf_column(key, F.concat(F.lit(b"key"), chunk_id)), F.lit("GCM"), F.lit("DEFAULT"), nonce, chunk_id)


def open_(sealed: Column, key: bytes, chunk_id: Column) -> Column:
    """The content, or null where it was tampered with."""
    return F.try_aes_decrypt(sealed, hkdf_column(key, F.concat(F.lit(b"key"), chunk_id)), F.lit("GCM"), F.lit("DEFAULT"), chunk_id)


def seal_mutable(data: Column, key: bytes, label: Column) -> Column:
    """Sealing of what changes under one name: a random nonce, so equal contents differ; the name is authenticated."""
    return F.aes_encrypt(data, F.lit(hkdf(key, b"mutable")), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), label)


def open_mutable(sealed: Column, key: bytes, label: Column) -> Column:
    return F.try_aes_decrypt(sealed, F.lit(hkdf(key, b"mutable")), F.lit("GCM"), F.lit("DEFAULT"), label)
