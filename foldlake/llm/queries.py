"""Registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.llm import bpe, chat, exact, html, langid, mixing, neardup, periodic, quality, repair, ring, simhash, suffix
from foldlake.llm.common import read_table

MIX_WEIGHTS = [5.0, 2.0, 1.0]
MIX_RATIO = 1.5


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op4_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring.assign(read_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.pair_replies(read_table(spark, sf_dir, "conversations")))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op7_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_RATIO, epochs=2))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(read_table(spark, sf_dir, "documents"), length=200)


def op9_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"), outputs=("text", "n_chars", "n_lines", "text_sha256"))


def op10_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return langid.identify(docs, F.coalesce(~held, F.lit(False)), {"doc_id": F.col("doc_id"), "held_out": F.coalesce(held, F.lit(False))})


def op11_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return repair.report(conversations, repair.damage(conversations))


def op12_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.link(read_table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op13_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return periodic.digest(periodic.find(docs, {"doc_id": F.col("doc_id")}, edit=periodic.planted))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_bpe, op2_minhash, op3_exact, op4_ring, op5_preference, op6_lines, op7_fair, op8_suffix, op9_layout, op10_rank, op11_retained, op12_bktree, op13_blocks, pipeline)
    return {f.__name__: f for f in every}


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


PREFERENCE_SQL = """
WITH ends AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS cut, max(turn) AS top FROM conversations GROUP BY conv_id),
reply AS (
  SELECT conv_id, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) = 1),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, conv_id, turn, role, text FROM conversations
  UNION ALL SELECT c.conv_id, 'rejected', c.conv_id, turn, role, text FROM conversations c JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE cut IS NULL OR turn IS NULL OR turn < cut
  UNION ALL SELECT e.conv_id, 'rejected', r.conv_id, coalesce(cut, top + 1, 0), 'assistant', r.text FROM ends e JOIN reply r ON r.conv_id = xor(e.conv_id, 1)),
turns AS (
  SELECT pair_id, side, conv_id, turn, coalesce(role, 'unknown') AS role, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS content FROM sides),
placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, coalesce(sum(length(content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM turns WINDOW w AS (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, sha256(content))),
met AS (
  SELECT pair_id, pos, count(*) FILTER (side = 'chosen') = 1 AND count(*) FILTER (side = 'rejected') = 1 AND count(DISTINCT content) = 1 AS same
  FROM placed GROUP BY pair_id, pos),
prefix AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same), count(*)) AS n FROM met GROUP BY pair_id),
kept AS (SELECT p.*, n, pos < n AS shared FROM placed p JOIN prefix USING (pair_id) WHERE NOT (pos < n AND side = 'rejected')),
lead_ AS (SELECT pair_id, coalesce(sum(length(content)) FILTER (shared), 0) AS chars FROM kept GROUP BY pair_id)
SELECT pair_id, conv_id, CASE WHEN shared THEN 'prompt' ELSE side END AS segment, CAST(CASE WHEN shared THEN pos ELSE pos - n END AS BIGINT) AS position,
  CAST(CASE WHEN shared THEN before ELSE before - chars END AS BIGINT) AS start, role, content, NOT shared AND role = 'assistant' AS trained, CAST(n AS BIGINT) AS n_prompt_turns
FROM kept JOIN lead_ USING (pair_id)
"""


#: Words and lower case as the contracts define them.
WORDS = "'[^\\x20\\x09-\\x0D]+'"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
QUALITY_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, {WORDS}) AS w FROM docs),
placed AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words),
windows AS (SELECT r, p, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS s FROM placed WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM windows WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
repeated AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY r),
split AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (SELECT r, source, text, line, len(w) AS words, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS folded
  FROM (SELECT *, regexp_extract_all(line, {WORDS}) AS w FROM split) WHERE len(w) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM docs GROUP BY source),
often AS (SELECT l.source, folded FROM lines l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source GROUP BY l.source, folded, docs HAVING count(DISTINCT text) > 5 AND count(DISTINCT text) > docs * 0.05::DOUBLE),
lost AS (SELECT r, sum(words)::BIGINT AS n FROM lines l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.folded = l.folded GROUP BY r),
base AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_boilerplate_words
  FROM docs JOIN words USING (r) LEFT JOIN dup d USING (r) LEFT JOIN repeated p USING (r) LEFT JOIN lost l USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_boilerplate_words >= 0.2::DOUBLE * n_words AS kept FROM base
"""
#: All pairs that share a shingle, as small tables allow.
NEAR_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), {WORDS}) AS w FROM documents),
placed AS (SELECT r, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM docs),
shingles AS (
  SELECT DISTINCT r, s FROM (SELECT r, n, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS s FROM placed WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE s IS NOT NULL
  UNION ALL SELECT r, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT r, r AS t FROM docs UNION SELECT reached.r, b FROM reached JOIN links ON a = t),
least AS (SELECT reached.r, min(d.doc_id) AS component_id FROM reached JOIN docs d ON d.r = t GROUP BY reached.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM docs LEFT JOIN sizes USING (r) JOIN least USING (r)
"""
#: Every string of 200 bytes by its hash, from blocks of 256 starts.
SUFFIX_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
blocks AS (SELECT r, j, substr(h, 512 * j + 1, 912) AS piece FROM (SELECT r, h, unnest(range((length(h) // 2 - 199 + 255) // 256)) AS j FROM docs WHERE length(h) >= 400)),
starts AS (SELECT r, 256 * j + o AS i, hash(substr(piece, 2 * o + 1, 400)) AS k FROM (SELECT r, j, piece, unnest(range(least(256, length(piece) // 2 - 199))) AS o FROM blocks)),
again AS (SELECT r, i FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY r, g),
gaps AS (SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM (SELECT r, a, b FROM runs UNION ALL SELECT r, -1, 0 FROM docs)),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h FROM gaps JOIN docs USING (r) GROUP BY r),
cut AS (SELECT r, sum(b - a)::BIGINT AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256 FROM docs d JOIN kept k USING (r) LEFT JOIN cut USING (r)
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    eight = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(list_reduce(list_transform(range(length({text})), lambda j: ascii(substr({text}, j + 1, 1))::BIGINT), lambda c, x: {eight}, 4294967295), 4294967295)"


#: Turn by turn: the cheapest edits (cost, audit, text) for each state, nothing yet, system, user and assistant last.
REPAIR_SQL = f"""
WITH RECURSIVE cells AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql('name')} % 20 AS k FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations)),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM cells, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER w AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS own
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
turns AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN body[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault, lag(own) OVER (PARTITION BY conv_id ORDER BY i) || own AS pair FROM placed),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
done(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'x': '', 'r': ''}}, {{'c': 1000000000000, 'x': '', 'r': ''}}, {{'c': 2, 'x': 'I', 'r': 'user:' || chr(10)}}, {{'c': 4, 'x': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}} FROM counts
  UNION ALL
  SELECT conv_id, i, e, s,
    least(u, {{'c': (least(e, s, a)).c + 2, 'x': (least({{'c': e.c, 'x': e.x || 'I', 'r': e.r}}, {{'c': s.c, 'x': s.x || 'I', 'r': s.r}}, {{'c': a.c, 'x': a.x || 'I', 'r': a.r}})).x,
      'r': (least({{'c': e.c, 'x': e.x || 'I', 'r': e.r}}, {{'c': s.c, 'x': s.x || 'I', 'r': s.r}}, {{'c': a.c, 'x': a.x || 'I', 'r': a.r}})).r || 'user:' || chr(10)}}) AS u,
    least(a, {{'c': u.c + 2, 'x': u.x || 'I', 'r': u.r || 'assistant:' || chr(10)}}) AS a
  FROM (
    SELECT d.conv_id, t.i,
      {{'c': e.c + 3, 'x': e.x || 'D', 'r': e.r}} AS e,
      least({{'c': s.c + 3, 'x': s.x || 'D', 'r': s.r}}, {{'c': CASE WHEN own = 's' THEN e.c + extra ELSE 1000000000000 END, 'x': e.x || 'K', 'r': e.r || role || ':' || text || chr(10)}}) AS s,
      least({{'c': u.c + 3, 'x': u.x || 'D', 'r': u.r}}, ku, ru) AS u, least({{'c': a.c + 3, 'x': a.x || 'D', 'r': a.r}}, ka, ra) AS a
    FROM done d JOIN (SELECT *, CASE fault WHEN 't' THEN 1 WHEN '.' THEN 0 ELSE 1000000000000 END AS extra FROM turns) t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i + 1,
    LATERAL (SELECT least(e, s, a) AS q),
    LATERAL (SELECT {{'c': CASE WHEN own = 'u' THEN q.c + extra ELSE 1000000000000 END, 'x': q.x || 'K', 'r': q.r || role || ':' || text || chr(10)}} AS ku, {{'c': q.c + 2 + extra, 'x': q.x || 'R', 'r': q.r || 'user:' || text || chr(10)}} AS ru,
      {{'c': CASE WHEN own = 'a' THEN u.c + extra ELSE 1000000000000 END, 'x': u.x || 'K', 'r': u.r || role || ':' || text || chr(10)}} AS ka, {{'c': u.c + 2 + extra, 'x': u.x || 'R', 'r': u.r || 'assistant:' || text || chr(10)}} AS ra))),
best AS (SELECT c.*, least(e, a) AS b FROM done d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.x, '') AS audit, sha256(coalesce(b.r[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""
#: Equal words of a document at every distance; stretches of them that are long enough are runs, if no shorter period holds there.
PERIODS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w, {crc32_sql('(doc_id::VARCHAR)')} AS h FROM documents),
planted AS (
  SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
  FROM (SELECT *, 1 + (len(w) - a) // (3 + h // 10 % 8) AS p FROM (SELECT *, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM docs))),
words AS (SELECT r, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM planted),
equal AS (SELECT a.r, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM equal) GROUP BY r, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT s.* FROM stretches s ANTI JOIN stretches t ON s.r = t.r AND t.q < s.q AND s.q % t.q = 0 AND t.start <= s.start AND t.start + t.length >= s.start + s.length),
best AS (SELECT * FROM runs a QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / q DESC, start, q) = 1),
lines AS (SELECT r, count(*) AS n, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM planted LEFT JOIN lines l USING (r) LEFT JOIN best USING (r) LEFT JOIN kept k USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": NEAR_SQL, "op3_exact": EXACT_SQL, "op5_preference": PREFERENCE_SQL, "op6_lines": QUALITY_SQL, "op8_suffix": SUFFIX_SQL, "op11_retained": REPAIR_SQL, "op13_blocks": PERIODS_SQL}
