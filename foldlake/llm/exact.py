"""Exact dedup with Patricia-trie owners.

Texts are dealt by length and content hash.  Each task inserts the whole byte strings of its share into a
compressed radix trie; the terminal node of a string keeps the smallest identifier (or the largest, as a
parameter) and the number of rows.  The same trie runs first over every input task, so one task sends a text
once however often it holds it, and a group of copies that holds a third of all rows arrives at its owner as one
string per input task.

When a trie outgrows its budget, which stubs count in too, the heaviest subtrees are spilled: their strings leave the task as rows of a table
in the shared folder, and so does every later string that ends below one.  Spilled rows are dealt
again in another round, by another hash, until none is left.  Nothing is kept on a machine's own disk, so a lost executor
costs its tasks only.  A subtree hangs at a branching node, however long the prefix that its strings share.

Defined cases: null counts as the empty text, and empty texts equal each other; a null id orders before all others for
``keep="largest"`` and after all for ``keep="smallest"``, so it stays only where all ids of the group are null; a row that
repeats an id and text is a copy like any other, and both rows carry the same verdict; an empty table gives no
rows; other columns are not read.  A text larger than the budget is held whole, one at a time; the stubs below the root
(256 at most) may take 100 KB more than a smaller budget.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import ROW, map_arrow, row_key, rows_of, shared_table

#: Bytes of edge labels and nodes that a task's trie may hold before a subtree is spilled.
TRIE_BYTES = 96 << 20
#: Bytes of a trie over an input task, which is emitted and begun anew instead.
LOCAL_BYTES = 24 << 20
NODE_BYTES = 400


class Node:
    """An edge label, the children by first byte, and for a terminal the best identifier and the number of rows.

    Below a ``spilled`` node there is nothing in memory any more.
    """

    __slots__ = ("label", "children", "best", "rows", "spilled")

    def __init__(self, label: bytes, best: int | None = None, rows: int = 0):
        self.label, self.children, self.best, self.rows, self.spilled = label, {}, best, rows, False


def shared_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of ``a`` and ``b[start:]``, by doubling and halving slices."""
    most = min(len(a), len(b) - start)
    if a[:most] == b[start : start + most]:
        return most
    low, step = 0, 16
    while low + step < most and a[low : low + step] == b[start + low : start + low + step]:
        low, step = low + step, step * 2
    high = min(low + step, most)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[start + low : start + middle]:
            low = middle
        else:
            high = middle
    return low + (low < most and a[low] == b[start + low])


class PatriciaTrie:
    """A compressed radix trie of byte strings with owners; beyond its budget whole subtrees go to ``spill_out``.

    The first string stays beside the trie, so every task finishes one string at least and the rounds come to an end.
    """

    def __init__(self, budget: int = TRIE_BYTES, prefer=min):
        self.root, self.used, self.budget, self.limit, self.prefer = Node(b""), 0, budget, budget, prefer
        self.first: tuple[bytes, int | None, int] | None = None
        self.spill_out: list[tuple[bytes, int | None, int]] = []  # for the caller to take
        self.spills = 0

    def better(self, a: int | None, b: int | None) -> int | None:
        return b if a is None else a if b is None else self.prefer(a, b)

    def add(self, text: bytes, best: int | None, rows: int = 1) -> None:
        if self.first is None or self.first[0] == text:
            self.first = (text, self.better(self.first[1], best), self.first[2] + rows) if self.first else (text, best, rows)
            return
        node, at = self.root, 0
        while True:
            if at == len(text):
                node.best, node.rows = (self.better(node.best, best), node.rows + rows) if node.rows else (best, rows)
                return
            if node.spilled:
                self.spill_out.append((text, best, rows))
                return
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], best, rows)
                self.used += len(text) - at + NODE_BYTES
                break
            k = shared_prefix(child.label, text, at)
            if k < len(child.label):  # split the edge
                upper = Node(child.label[:k])
                child.label = child.label[k:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = upper
                self.used += NODE_BYTES
                child = upper
            node, at = child, at + k
        if self.used > self.limit:
            self.spill()

    def entries(self) -> Iterator[tuple[bytes, int | None, int]]:
        """What is in memory: each string with its identifier and rows."""
        if self.first:
            yield self.first
        yield from self.walk(self.root, b"")

    def walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """The strings at and below a node; ``prefix`` ends above its label."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.label
            if node.rows:
                yield text, node.best, node.rows
            stack += [(c, text) for c in node.children.values()]

    def weights(self) -> dict[int, int]:
        """Bytes at and below each node."""
        order, stack = [], [self.root]
        while stack:
            n = stack.pop()
            order.append(n)
            stack += n.children.values()
        out: dict[int, int] = {}
        for n in reversed(order):
            out[id(n)] = len(n.label) + NODE_BYTES + sum(out[id(c)] for c in n.children.values())
        return out

    def spill(self) -> None:
        """Spill the heaviest subtrees that hold at most half of the bytes, or mostly one label, until a quarter of the budget is free."""
        weight = self.weights()
        while self.used > 3 * self.budget // 4:
            path, prefix = [self.root], b""
            while True:
                first, heavy = max(path[-1].children.items(), key=lambda c: weight[id(c[1])])
                if weight[id(heavy)] <= self.used // 2 or not heavy.children or len(heavy.label) > weight[id(heavy)] // 2:
                    break
                path.append(heavy)
                prefix += heavy.label
            # a stub of one byte stays; a string that ends at it is no part of the subtree
            stub = Node(heavy.label[:1])
            freed = weight[id(heavy)] - 1 - NODE_BYTES
            if not freed:  # stubs only
                break
            if len(heavy.label) == 1:
                stub.best, stub.rows, heavy.rows = heavy.best, heavy.rows, 0
            self.spill_out += self.walk(heavy, prefix)
            stub.spilled = True
            path[-1].children[first] = stub
            weight[id(stub)] = 1 + NODE_BYTES
            for n in path:
                weight[id(n)] -= freed
            self.used -= freed
            self.spills += 1
        self.limit = max(self.budget, self.used + self.budget // 4)

    def owners(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Each distinct text with its identifier and rows: what is in the trie, then what is left of ``spill_out``."""
        trie = self
        while True:
            yield from trie.entries()
            if not trie.spill_out:
                return
            rest, trie = trie.spill_out, PatriciaTrie(self.budget, self.prefer)
            for entry in rest:
                trie.add(*entry)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: ``text_sha256``, ``keep_id`` and ``group_size``."""
    prefer = {"smallest": min, "largest": max}[keep]
    names = ("body", "best", "rows", "text_sha256")
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    schema = "body binary, best long, rows long, text_sha256 string"

    def packed(entries, digest: bool) -> Iterator[pa.RecordBatch]:
        """Rows of whole strings, or of their digests."""
        rows, size = [], 0
        for text, best, n in entries:
            rows.append((None, best, n, hashlib.sha256(text).hexdigest()) if digest else (text, best, n, None))
            size += 100 if digest else len(text) + 100
            if size > 1 << 20:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)

    def made(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=list(names))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(1 << 62, prefer)
        for batch in batches:
            for text, best in zip(batch.column(1), batch.column(0).to_pylist()):
                trie.add((text.as_py() or "").encode(), best)
                if trie.used > LOCAL_BYTES:
                    yield from packed(trie.entries(), False)
                    trie = PatriciaTrie(1 << 62, prefer)
        yield from packed(trie.entries(), False)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget, prefer)
        for batch in batches:
            for body, best, rows in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                trie.add(body.as_py(), best, rows)
                if trie.spill_out:
                    yield from packed(trie.spill_out, False)
                    trie.spill_out = []
        yield from packed(trie.entries(), True)

    whole = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), local, schema)
    out, deal = None, 0
    while True:
        # length and content hash together pick the task; a text is never in two tasks
        dealt = whole.withColumn("_deal", F.xxhash64(F.lit(deal), F.octet_length("body"), F.xxhash64("body"))).repartition("_deal").drop("_deal")
        table = shared_table(map_arrow(dealt, final, schema))
        done = table.where("body is null").select("text_sha256", F.col("best").alias("keep_id"), F.col("rows").alias("group_size"))
        out, deal = done if out is None else out.unionByName(done), deal + 1
        whole = table.where("body is not null")
        if whole.isEmpty():
            return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    own = owners(docs, id_col, text_col, keep, budget)
    return mine.join(own, "text_sha256", "left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, whole and with their own columns: one of each text, also where ids are null or repeated."""
    mine = docs.select(row_key(docs).alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    kept = mine.join(owners(docs, keep=keep), "text_sha256").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return rows_of(docs, kept.groupBy("text_sha256").agg(F.min(ROW).alias(ROW)).select(ROW))
