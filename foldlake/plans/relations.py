"""SQL of the derived folder relations, in front of every oracle, and the registry that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldlake.operators import merkle

Query = Callable[[SparkSession, str], DataFrame]

RELATIONS = """
WITH RECURSIVE feed AS (
  SELECT event_id AS seq, 'u' || user_id || '/f' || event_id % 7 || '.txt' AS path, 'n' || event_id % 3 AS author, epoch_us(ts) // 1000 AS authored_ms, ts,
    event_type = 'error' AS deleted, event_id % 11 AS c, sha256('u' || user_id || '/f' || event_id % 7 || '.txt:' || event_id % 11) AS manifest_id
  FROM events),
manifests AS (
  SELECT path, manifest_id, c, seq, author, authored_ms, deleted FROM feed QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1),
manifest_chunks AS (
  SELECT manifest_id, ord, sha256('k' || (c + ord) || '/' || substr(manifest_id, 1, 4)) AS chunk_id, 100 * (c + ord + 1) AS length
  FROM (SELECT DISTINCT manifest_id, c FROM feed) m CROSS JOIN (VALUES (0::BIGINT), (1), (2)) o(ord) WHERE ord <= c % 3),
snapshot_manifests AS (
  SELECT n AS snap_seq, path, manifest_id, deleted FROM feed CROSS JOIN (VALUES (1::BIGINT), (2), (3), (4)) s(n)
  WHERE ts < TIMESTAMP '2024-01-01' + INTERVAL (6 * n) DAY QUALIFY row_number() OVER (PARTITION BY n, path ORDER BY seq DESC) = 1),
chunks AS (
  SELECT chunk_id, any_value(length) AS plaintext_length, max(length + 1000 * ord) AS last_seen_ms, min(length + 1000 * ord) // 100 % 20 AS blob_id
  FROM manifest_chunks GROUP BY chunk_id),
receipts AS (
  SELECT 'p' || user_id % 20 AS peer_id, CAST(CASE WHEN user_id % 20 = 3 THEN 2 ELSE 1 END AS BIGINT) AS epoch, max(event_id) AS high_water
  FROM events WHERE event_type = 'purchase' AND user_id % 20 <> 19 GROUP BY 1, 2),
members AS (
  SELECT s_suppkey AS node_id, greatest(s_suppkey // 2, 1) AS added_by, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS role, s_suppkey % 17 <> 0 AS sig_ok
  FROM supplier WHERE s_suppkey > 0),
roster AS (
  SELECT node_id, added_by, role, 0 AS depth FROM members WHERE sig_ok AND node_id = 1 AND added_by = 1 AND role = 1
  UNION ALL
  SELECT m.node_id, m.added_by, m.role, depth + 1 FROM members m JOIN roster r ON m.added_by = r.node_id WHERE m.sig_ok AND r.role = 1 AND m.node_id <> m.added_by),
files AS (
  SELECT source || '/d' || doc_id AS path, 'regular' AS kind, CASE WHEN doc_id % 5 = 0 THEN 493 ELSE 420 END AS mode, doc_id * 1000003 AS mtime_ns,
    strlen(text) + CASE WHEN doc_id % 6 = 1 THEN 1 ELSE 0 END AS size, doc_id AS inode FROM documents WHERE doc_id % 9 <> 4),
known_files AS (
  SELECT source || '/d' || doc_id AS path, 'regular' AS kind, CASE WHEN doc_id % 5 = 0 THEN 493 ELSE 420 END AS mode, doc_id * 1000003 AS mtime_ns,
    strlen(text) AS size, doc_id AS inode, doc_id % 10 = 7 AS deleted FROM documents WHERE doc_id % 8 <> 3),
live AS (
  SELECT DISTINCT manifest_id FROM manifests WHERE NOT deleted),
leaves AS (
  SELECT DISTINCT manifest_id FROM snapshot_manifests WHERE NOT deleted),
reachable AS (
  SELECT DISTINCT chunk_id FROM manifest_chunks WHERE manifest_id IN (SELECT manifest_id FROM live UNION SELECT manifest_id FROM leaves))
"""



def sql_varint(n: str) -> str:
    """Hex of the variable-length bytes of a number below 16384."""
    return f"(CASE WHEN {n} < 128 THEN printf('%02x', ({n})::BIGINT) ELSE printf('%02x%02x', ({n} % 128 + 128)::BIGINT, ({n} // 128)::BIGINT) END)"


def sql_sized(text: str) -> str:
    """Hex of a text behind its length."""
    return f"({sql_varint(f'strlen({text})')} || lower(hex(encode({text}))))"


def sql_base32(hexed: str) -> str:
    """Unpadded lower-case base32 of 32 bytes in hex."""
    return f"(SELECT string_agg(substr('abcdefghijklmnopqrstuvwxyz234567', (CAST('0x' || substr({hexed} || '00', 5 * i // 4 + 1, 3) AS INT) >> (7 - 5 * i % 4)) % 32 + 1, 1), '' ORDER BY i) FROM range(52) b(i))"


def sql_hmac(key: bytes, message: str) -> str:
    """Hex of HMAC-SHA256 of a hex text's bytes."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    return f"sha256(unhex('{outer}' || sha256(unhex('{inner}' || {message}))))"


#: Levels of the tree as one recursive relation: pairs of neighbours are hashed, an odd one is carried up.
MERKLE = f"""hashed AS (SELECT g, path, sha256(unhex('{merkle.LEAF_DOMAIN.hex()}' || {sql_sized("path")} || manifest_id || CASE WHEN deleted THEN '01' ELSE '00' END)) AS h FROM leaf),
tree AS (
  SELECT g, 0 AS level, row_number() OVER (PARTITION BY g ORDER BY path) - 1 AS i, h, count(*) OVER (PARTITION BY g) AS n FROM hashed
  UNION ALL
  SELECT g, level + 1, i // 2, CASE WHEN count(*) = 2 THEN sha256(unhex('{merkle.NODE_DOMAIN.hex()}' || min_by(h, i) || max_by(h, i))) ELSE any_value(h) END, (any_value(n) + 1) // 2
  FROM tree WHERE n > 1 GROUP BY g, level, i // 2)"""


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: str = "") -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL of its rows (``more``: further relations) if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = RELATIONS + (f", {more}\n" if more else "") + sql
        return f

    return add
