"""BLAKE3 in numpy-free Python (public specification), for content ids that must match other systems.

``sha2`` is the default digest of the engine; this one is for compatibility and is slower.
"""

from __future__ import annotations

import struct

# Fixed values of the BLAKE3 specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK = 1024
MASK = 0xFFFFFFFF


def _schedules() -> list[tuple[int, ...]]:
    out, now = [], tuple(range(16))
    for _ in range(7):
        out.append(now)
        now = tuple(now[i] for i in PERMUTATION)
    return out


SCHEDULES = _schedules()
LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def compress(chain, words, counter: int, length: int, flags: int) -> list[int]:
    v = [*chain, *IV[:4], counter & MASK, counter >> 32, length, flags]
    for order in SCHEDULES:
        for k, (a, b, c, d) in enumerate(LANES):
            for word, r1, r2 in ((words[order[2 * k]], 16, 12), (words[order[2 * k + 1]], 8, 7)):
                v[a] = (v[a] + v[b] + word) & MASK
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << (32 - r1)) & MASK
                v[c] = (v[c] + v[d]) & MASK
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << (32 - r2)) & MASK
    return [v[i] ^ v[i + 8] for i in range(8)]


def _words(block: bytes) -> tuple[int, ...]:
    return struct.unpack("<16I", block.ljust(64, b"\0"))


def _chunk(data: bytes, counter: int, root: bool) -> list[int]:
    chain, blocks = list(IV), [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, block in enumerate(blocks):
        flags = (CHUNK_START if i == 0 else 0) | ((CHUNK_END | (ROOT if root else 0)) if i == len(blocks) - 1 else 0)
        chain = compress(chain, _words(block), counter, len(block), flags)
    return chain


def blake3(data: bytes) -> bytes:
    """32-byte digest."""
    if len(data) <= CHUNK:
        return struct.pack("<8I", *_chunk(data, 0, True))
    level = [_chunk(data[i : i + CHUNK], i // CHUNK, False) for i in range(0, len(data), CHUNK)]
    while len(level) > 1:
        root = ROOT if len(level) == 2 else 0
        level = [compress(IV, level[i] + level[i + 1], 0, 64, PARENT | root) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return struct.pack("<8I", *level[0])
