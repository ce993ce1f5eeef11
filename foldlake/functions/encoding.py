"""Canonical encodings: identities, version vectors, catalogs, ids.

Formats carry a domain tag, which is a parameter: pass the tag of the format to be matched.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterable

IDENTITY_DOMAIN, CATALOG_DOMAIN = b"foldlake/manifest/v1\0", b"foldlake/catalog/v1\0"
REGULAR, DIRECTORY, SYMLINK = 0, 1, 2
FORMAT = 1


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


class Reader:
    """Strict reader of a canonical encoding: anything cut off or left over is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise ValueError("cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def uvarint(self) -> int:
        value, shift = 0, 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                if value >> 64:
                    raise ValueError("number too large")
                return value
            shift += 7
            if shift > 63:
                raise ValueError("number too large")

    def sized(self) -> bytes:
        return self.take(self.uvarint())

    def end(self) -> None:
        if self.at != len(self.data):
            raise ValueError("trailing bytes")


def sized(data: bytes) -> bytes:
    return uvarint(len(data)) + data


def nfc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", text)


def identity_bytes(kind: int, path: str, mode: int, target: str, chunks: Iterable[tuple[bytes, int]], domain: bytes = IDENTITY_DOMAIN) -> bytes:
    """What a manifest's id is the hash of; times, owners and sequence numbers are no part of it."""
    chunks = list(chunks)
    runs = 1 if kind == REGULAR and mode & 0o111 else 0
    head = domain + bytes([FORMAT, kind]) + sized(nfc(path).encode()) + bytes([runs]) + sized(nfc(target).encode())
    return head + uvarint(len(chunks)) + b"".join(i + uvarint(n) for i, n in chunks)


def encode_vector(vector: dict[str, int]) -> bytes:
    """Nonzero entries by ascending node."""
    entries = sorted((k.encode(), v) for k, v in vector.items() if v)
    return uvarint(len(entries)) + b"".join(sized(k) + uvarint(v) for k, v in entries)


def decode_vector(data: bytes) -> dict[str, int]:
    r = Reader(data)
    out = {}
    for _ in range(r.uvarint()):
        node = r.sized().decode()
        out[node] = r.uvarint()
    r.end()
    return out


def encode_catalog(entries: Iterable[tuple[int, str, int, str, list[tuple[bytes, int]]]], domain: bytes = CATALOG_DOMAIN) -> bytes:
    """Manifests (kind, path, mode, target, chunks) by path."""
    rows = sorted(entries, key=lambda e: e[1].encode())
    out = [domain, uvarint(len(rows))]
    for kind, path, mode, target, chunks in rows:
        out += [bytes([kind]), sized(path.encode()), uvarint(mode), sized(target.encode()), uvarint(len(chunks)), *(i + uvarint(n) for i, n in chunks)]
    return b"".join(out)


def decode_catalog(data: bytes, domain: bytes = CATALOG_DOMAIN) -> list[tuple[int, str, int, str, list[tuple[bytes, int]]]]:
    if not data.startswith(domain):
        raise ValueError("another format")
    r = Reader(data[len(domain) :])
    out = []
    for _ in range(r.uvarint()):
        kind, path, mode, target = r.take(1)[0], r.sized().decode(), r.uvarint(), r.sized().decode()
        out.append((kind, path, mode, target, [(r.take(32), r.uvarint()) for _ in range(r.uvarint())]))
    r.end()
    return out


def base32_id(digest: bytes) -> str:
    """A node id: unpadded lower-case base32."""
    return base64.b32encode(digest).decode().rstrip("=").lower()


def node_id(public_key_info: bytes) -> str:
    return base32_id(hashlib.sha256(public_key_info).digest())


def recovery_code(secret: bytes) -> str:
    """A key as unpadded upper-case base32."""
    return base64.b32encode(secret).decode().rstrip("=")


def read_recovery_code(code: str, length: int | None = None) -> bytes:
    """The key of a code, which may be in lower case and stand between spaces; a ``length`` is demanded of the key if given."""
    text = code.strip().upper()
    key = base64.b32decode(text + "=" * (-len(text) % 8))
    if length is not None and len(key) != length:
        raise ValueError(f"code of {len(key)} bytes instead of {length}")
    return key
