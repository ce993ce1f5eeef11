"""Conversation structure repair: the cheapest edits that give a conversation its turn structure.

A repaired conversation has roles ``(system? (user assistant)+)?`` by their initials.  A turn is kept (0), rerolled to user or assistant
(2) or deleted (3; blank and duplicate turns must be), empty user or assistant turns are inserted anywhere (2), and a truncated turn that
stays costs 1 more.  Of the cheapest edits those count whose audit, the initials D, I, K, R in order, is the least by ASCII.

The search runs over retained turns only.  A turn is retained with one of at most three roles; what lies between two retained
turns is priced by prefix sums of deletions, and what the pair of roles lacks between them is inserted.  From the last turn to the first a running
minimum for each role, cost to the end plus deletions before, gives every turn its best successor.  Ties: a gap reads D..DI..I and then
the retained turn's K or R, so the farther successor has the smaller audit, and at one place the smaller gap.  No gap is the beginning of
another, so the choice of gaps one by one gives the least audit.

Turns are dealt by ranges of (conversation, turn), which cut a conversation of any size.  There they become chunks of at most ``ROWS``
turns and about ``BYTES`` of text; the search reads one letter for the role and one for the fault of each turn, as much as the audit
that it writes.  The chunks then take their piece of the audit along and are hashed one after the other, a chunk at a time.

Defined cases: a null role or text counts as one space; turns come by turn number (null first), then role and SHA-256 of the text, so
repeated rows stand next to each other; a null conversation is one of its own; roles count by their first letter, case and all, and any
but s, u and a can only be rerolled or deleted; a conversation whose turns all fell away has zeros, an empty audit and the hash of the
empty string; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foldlake.llm.common import map_arrow, scratch, shared_table, small

#: Turns and bytes of text of a chunk.
ROWS, BYTES = 256, 1 << 20
#: What ends a word, as a set of characters to trim.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"
#: Turns to insert between one retained role and the next: from nothing (-), s, u or a to s, u, a or the end ($).
LACKS = {"-s": "", "-u": "", "-a": "u", "-$": "", "su": "", "sa": "u", "s$": "ua", "ua": "", "uu": "a", "u$": "a", "au": "", "aa": "u", "a$": ""}


def repair(initials: str, faults: str) -> tuple[int, str]:
    """Cost and audit for the turns' initials and faults (``b`` blank, ``d`` duplicate, ``t`` truncated, else ``.``)."""
    n = len(initials)
    deleted = [DELETE * i for i in range(n + 1)]  # cost of deleting the turns before i
    #: role -> (cost from a turn retained with it to the end plus deletions before it, its place, its letter)
    best: dict[str, tuple[int, int, str]] = {"$": (deleted[n], n, "")}
    after: list[dict[str, tuple[str, str]] | None] = [None] * n  # a turn's role -> successor's role and the gap's audit without D
    place: list[dict[str, int] | None] = [None] * n

    def successor(role: str, i: int) -> tuple[int, int, str, str]:
        """Cheapest way on from turn i retained with a role: cost, minus the successor's place, gap, successor's role."""
        ways = []
        for to, (cost, j, letter) in best.items():
            lacks = LACKS.get(role + to)
            if lacks is not None:
                ways.append((cost - deleted[i + 1] + INSERT * len(lacks), -j, "I" * len(lacks) + letter, to))
        return min(ways)

    for i in range(n - 1, -1, -1):
        if faults[i] in "bd":
            continue
        more = TRUNCATED if faults[i] == "t" else 0
        own = initials[i]
        here = {own: (KEEP + more, "K")} if own in "sua" else {}
        for role in "ua":
            here.setdefault(role, (REROLE + more, "R"))
        after[i], place[i], costs = {}, {}, {}
        for role, (price, letter) in here.items():
            cost, at, gap, to = successor(role, i)
            after[i][role], place[i][role] = (to, gap), -at
            costs[role] = (price + cost + deleted[i], i, letter)
        for role, found in costs.items():
            if role not in best or found[0] < best[role][0]:  # of equal ones the farther stays
                best[role] = found
    # the start is a turn before the first whose role is nothing yet; a first s stands before all others
    cost, at, gap, role = successor("-", -1)
    audit, i, j = ["D" * -at, gap], -1, -at
    while j < n:
        i = j
        to, gap = after[i][role]
        j = place[i][role]
        audit += ["D" * (j - i - 1), gap]
        role = to
    return cost, "".join(audit)


def damage(conversations: DataFrame) -> DataFrame:
    """What the registered query does to its rows, by ``crc32(conv_id:turn) % 20``: turns dropped, emptied, cut, repeated, rerolled."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn")).cast("binary")) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate(cell("text"), ".!?", "")).otherwise(cell("text"))
    rows = conversations.withColumn("_k", kind).select("conv_id", "turn", F.when(F.col("_k") == 4, USER).otherwise(cell("role")).alias("role"), text.alias("text"), "_k")
    copies = F.when(F.col("_k") == 0, 0).when(F.col("_k") == 3, 2).otherwise(1)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_k", "_copy")


def fault(text: Column) -> Column:
    """``b`` for a blank text, ``t`` if its last character is no end of a sentence, else ``.``."""
    end = F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)
    return F.when(end == "", "b").when(end.isin(".", "!", "?"), ".").otherwise("t")


def kinds(df: DataFrame) -> tuple[str, pa.DataType]:
    """Type of the column ``conv`` for Spark and for Arrow."""
    return df.schema["conv"].dataType.simpleString(), to_arrow_type(df.schema["conv"].dataType)


def arrow(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def chunks(turns: DataFrame) -> DataFrame:
    """Chunks of turns in order (``conv, part, chunk``): initials, faults, roles, texts, and first, last and number of turn numbers."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("fault", fault(F.col("text")))
    # texts that come back at another turn number, by their first one; those of the same number are neighbours
    again = rows.where("fault <> 'b'").groupBy("conv", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_lo"), F.max(F.struct(F.col("turn").isNotNull(), "turn")).alias("_hi"))
    again = shared_table(again.where("_lo <> _hi").select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("sha").alias("_sha"), F.col("_lo.turn").alias("_first")))
    rows = rows.join(small(again), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_sha")), "left")
    later = F.col("_sha").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first"))
    rows = rows.withColumn("fault", F.when((F.col("fault") != "b") & later, "d").otherwise(F.col("fault"))).select("conv", "turn", "role", "sha", "fault", "text")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "sha"]
    kind, id_type = kinds(rows)
    schema = f"conv {kind}, part int, chunk long, initials string, faults string, roles array<string>, texts array<string>, first long, last long, turns long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, before, held, out = TaskContext.get().partitionId(), 0, 0, None, [], []
        types = [id_type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 3]

        def chunk() -> tuple:
            _, turns_, roles, texts, faults = zip(*held)
            known = [t for t in turns_ if t is not None]
            initials = "".join(r[0] if r[:1] in ("s", "u", "a") else "-" for r in roles)
            return held[0][0], part, number, initials, "".join(faults), roles, texts, known[0] if known else None, known[-1] if known else None, len(set(known))

        waiting = 0  # bytes of text in finished chunks
        for batch in batches:
            for conv, turn, role, sha, own, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (conv != held[0][0] or len(held) >= ROWS or size >= BYTES):
                    out.append(chunk())
                    number, waiting, size, held = number + 1, waiting + size, 0, []
                    if waiting >= BYTES or len(out) >= ROWS:
                        yield arrow(out, types, names)
                        out, waiting = [], 0
                if own != "b" and (conv, turn, role, sha) == before:
                    own = "d"
                before = (conv, turn, role, sha)
                held.append((conv, turn, role, text, own))
                size += len(text)
        if held:
            out.append(chunk())
        if out:
            yield arrow(out, types, names)

    return map_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), run, schema)


def audited(parts: DataFrame) -> DataFrame:
    """The piece of the audit for each chunk, and with the last one of a conversation its counts."""
    kind, id_type = kinds(parts)
    names = ["conv", "part", "chunk", "piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv {kind}, part int, chunk long, piece string, " + ", ".join(f"{c} long" for c in names[4:])

    def cut(held: list[tuple]) -> Iterator[tuple]:
        initials, faults = "".join(r[3] for r in held), "".join(r[4] for r in held)
        cost, audit = repair(initials, faults)
        known, turns = [r for r in held if r[5] is not None], 0
        for k, r in enumerate(known):
            turns += r[7] - (k > 0 and known[k - 1][6] == r[5])
        gaps = known[-1][6] - known[0][5] + 1 - turns if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        at = 0
        for k, r in enumerate(held):
            to, left = at, len(r[3])
            while left:
                left -= audit[to] != "I"
                to += 1
            last = k == len(held) - 1
            counts = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost) if last else (None,) * 6
            yield (*r[:3], audit[at:] if last else audit[at:to], *counts)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, types = [], [], [id_type, pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 6]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out += cut(held)
                    held = []
                    if len(out) >= 1000:
                        yield arrow(out, types, names)
                        out = []
                held.append(row)
        if held:
            out += cut(held)
        if out:
            yield arrow(out, types, names)

    narrow = parts.select("conv", "part", "chunk", "initials", "faults", "first", "last", "turns")
    return map_arrow(narrow.repartition("conv").sortWithinPartitions("conv", "part", "chunk"), run, schema)


def rendered(roles: list[str], texts: list[str], piece: str, before: str) -> tuple[list[str], str]:
    """``role:text`` of what a piece of the audit makes of its turns, and the last role's initial."""
    lines, i = [], 0
    for edit in piece:
        if edit in "IR":
            role = ASSISTANT if before == "u" else USER
        elif edit == "K":
            role = roles[i]
        if edit != "D":
            lines.append(f"{role}:{'' if edit == 'I' else texts[i]}")
            before = role[0]
        i += edit != "I"
    return lines, before


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation with turns: ``conv_id``, the counts, ``cost``, ``audit`` and ``repaired_sha256``.

    The digest is that of the repaired ``role:text`` lines; ``lines`` has the lines themselves.
    """
    with scratch() as keep:
        parts, pieces = solved(turns)
        keep(parts), keep(pieces)
    return hashed(parts, pieces)


def solved(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = shared_table(chunks(turns))
    return parts, shared_table(audited(parts))


def in_order(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Every chunk's piece right before its turns, conversation by conversation."""
    none = lambda kind: F.lit(None).cast(kind)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    a = pieces.select("conv", "part", "chunk", F.lit(0).alias("kind"), "piece", *counts, none("array<string>").alias("roles"), none("array<string>").alias("texts"))
    b = parts.select("conv", "part", "chunk", F.lit(1).alias("kind"), none("string").alias("piece"), *[none("long").alias(c) for c in counts], "roles", "texts")
    return a.unionByName(b).repartition("conv").sortWithinPartitions("conv", "part", "chunk", "kind").drop("part", "chunk", "kind")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per chunk: conversation, piece of the audit, its lines, and the counts with the last chunk of a conversation."""
    conv = piece = counts = None
    before = "-"
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1] is not None:
                conv, piece, counts = row[0], row[1], row[2:8]
            else:
                lines, before = rendered(row[8], row[9], piece, before)
                yield conv, piece, lines, counts
                if counts[0] is not None:
                    before = "-"


def hashed(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    kind, id_type = kinds(parts)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, audit, digest, first = [], [], hashlib.sha256(), True

        types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        for conv, piece, lines, counts in edited(batches):
            audit.append(piece)
            for line in lines:
                digest.update((line if first else "\n" + line).encode())
                first = False
            if counts[0] is not None:
                out.append((conv, *counts, "".join(audit), digest.hexdigest()))
                audit, digest, first = [], hashlib.sha256(), True
                if len(out) >= 1000:
                    yield arrow(out, types, names)
                    out = []
        if out:
            yield arrow(out, types, names)

    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", audit string, repaired_sha256 string"
    return map_arrow(in_order(parts, pieces), run, schema)


def lines(turns: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, chunk`` (from 0) and the ``role:text`` lines of the chunk."""
    with scratch() as keep:
        parts, pieces = solved(turns)
        keep(parts), keep(pieces)
    kind, id_type = kinds(parts)
    schema = pa.schema([("conv_id", id_type), ("chunk", pa.int64()), ("lines", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = 0
        for conv, _, made, counts in edited(batches):
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "chunk": chunk, "lines": made}], schema)
            chunk = 0 if counts[0] is not None else chunk + 1

    return map_arrow(in_order(parts, pieces), run, f"conv_id {kind}, chunk long, lines array<string>")


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for every conversation of a table, of ``repaired`` for what is left of its turns."""
    done = repaired(turns)
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    all_ = conversations.select(F.col("conv_id").alias("_id")).distinct()
    return all_.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
