"""SimHash near-dedup: 64-bit fingerprints linked within a Hamming radius by BK-trees.

A bit of a document's fingerprint is set if it is set in more than half of the hashes of its word shingles, repeats included.
Equal fingerprints are one node from the start.  The others are dealt into shards: a fingerprint is cut into m fields, and two
that differ in at most r bits agree in m - r fields, so every choice of m - r fields is a table and its value there a
shard.  m grows with the number of fingerprints, which keeps a shard of unrelated ones small.

A shard of any size becomes trees of some ``TREE`` nodes each.  In a BK-tree every child hangs from its parent by their Hamming distance; a
query at distance d of a node follows only the edges from d - r to d + r.  The trees of an Arrow batch are built and searched
level by level, all at once.  Members of a tree are its queries first, then the queries of the other trees of the shard come to
it; the trees are broadcast for that if their nodes were counted and are few, and meet by shard in a shuffle if not.

Only a forest of links leaves a task.  A subtree whose nodes all are in the query's component is not entered, so a large group of
near copies costs a pass a tree and not all its pairs; the search is exact nevertheless, as it skips nothing but known links.

Defined cases: null and empty texts and texts without words have the fingerprint zero and are linked like others; fewer words
than a shingle give the whole sequence; null ids are linked too, a component is named by its smallest non-null id (null if
there is none); repeated rows and ids are rows of their own; an empty table gives no rows; columns but id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import BROADCAST_ROWS, components, map_arrow, scratch, shared_table, slices, small

#: Nodes of a tree, about.
TREE = 1024
#: Members of a shard of unrelated fingerprints, at most.
SHARD = 64
#: (Query, node) pairs that are looked at together.
PAIRS = 1 << 17
#: Shingles whose bits are counted together.
PART = 1 << 15


def fingerprint(text: bytes, words: int, seed: int) -> int:
    found = text.lower().split()  # ASCII letters; at space and 0x09 to 0x0D
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1], ends[k - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), PART):
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at : at + PART].tolist(), ends[at : at + PART].tolist())), "<u8", len(starts[at : at + PART]))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``print``, the fingerprint's 64 bits as a long."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = [fingerprint(t or b"", words, seed) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return map_arrow(source, run, f"doc_id {source.schema[0].dataType.simpleString()}, print long")


def tables(n: int, radius: int) -> list[int]:
    """Masks of the tables for n fingerprints: the fewest fields that keep shards small."""
    for m in range(radius + 1, max(2 * radius, radius + 1) + 1):
        if n <= SHARD * 2 ** (64 * (m - radius) / m):
            break
    cuts = [64 * k // m for k in range(m + 1)]
    fields = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(fields, m - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


class Forest:
    """BK-trees of several lists of fingerprints, level by level.

    ``prints`` and ``tree`` (its number, ascending) describe the members.  Nodes are kept in order of level, so that a parent comes before its children; ``edge``
    is the distance to the parent, and children stand in order of (parent, edge).
    """

    def __init__(self, prints: np.ndarray, tree: np.ndarray):
        n = len(prints)
        first = np.ones(n, bool)
        first[1:] = tree[1:] != tree[:-1]
        nodes, parents, edges = [np.flatnonzero(first)], [np.full(int(first.sum()), -1)], [np.zeros(int(first.sum()), np.int64)]
        self.levels = [(0, len(nodes[0]))]
        rest = np.flatnonzero(~first)
        at = (np.cumsum(first) - 1)[rest]  # the node below which each member belongs
        made, above = len(nodes[0]), nodes[0]
        while len(rest):
            gap = distance(prints[rest], prints[above[at - self.levels[-1][0]]])
            order = np.lexsort((rest, gap, at))
            rest, at, gap = rest[order], at[order], gap[order]
            head = np.ones(len(rest), bool)
            head[1:] = (at[1:] != at[:-1]) | (gap[1:] != gap[:-1])
            nodes.append(rest[head]), parents.append(at[head]), edges.append(gap[head])
            below = made + np.cumsum(head) - 1
            self.levels.append((made, made + int(head.sum())))
            above = rest[head]
            made += int(head.sum())
            rest, at = rest[~head], below[~head]
        self.member, self.parent, self.edge = np.concatenate(nodes), np.concatenate(parents), np.concatenate(edges)
        self.prints = prints[self.member]
        self.root = np.flatnonzero(self.parent < 0)  # by tree
        inner = np.flatnonzero(self.parent >= 0)
        self.keys = self.parent[inner] * 128 + self.edge[inner]
        order = np.argsort(self.keys, kind="stable")
        self.child, self.keys = inner[order], self.keys[order]

    def pure(self, label: np.ndarray) -> np.ndarray:
        """Nodes whose whole subtree has one label."""
        out = np.ones(len(label), bool)
        for a, b in self.levels[:0:-1]:
            up = self.parent[a:b]
            out[up[~out[a:b] | (label[a:b] != label[up])]] = False
        return out

    def search(self, prints: np.ndarray, tree: np.ndarray, mine: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(Query, node) pairs within the radius, but those below a node whose subtree is all of the query's label."""
        query, node, one, out = np.arange(len(prints)), self.root[tree], self.pure(label), []
        while len(query):
            open_ = ~(one[node] & (label[node] == mine[query]))
            query, node = query[open_], node[open_]
            gap = distance(prints[query], self.prints[node])
            near = gap <= radius
            out.append((query[near], node[near]))
            low = np.searchsorted(self.keys, node * 128 + np.maximum(gap - radius, 0))
            many = np.searchsorted(self.keys, node * 128 + np.minimum(gap + radius, 127), "right") - low
            query, low = np.repeat(query, many), np.repeat(low, many)
            node = self.child[low + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def forest_links(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], radius: int) -> list[tuple[int, int]]:
    """Links that join what the rows' labels leave apart: each row has queries and their labels, a tree's fingerprints and theirs."""
    lengths = lambda k: np.array([len(r[k]) for r in rows])
    asked, members = np.concatenate([r[0] for r in rows]), np.concatenate([r[2] for r in rows])
    forest = Forest(members, np.repeat(np.arange(len(rows)), lengths(2)))
    known, place = np.unique(np.concatenate([asked, members]), return_inverse=True)
    label = np.zeros(len(known), np.int64)
    label[place] = np.concatenate([r[1] for r in rows] + [r[3] for r in rows])
    label = np.unique(label, return_inverse=True)[1]
    above = np.arange(int(label.max(initial=-1)) + 1)
    ask, own = place[: len(asked)], place[len(asked) :][forest.member]
    tree, found = np.repeat(np.arange(len(rows)), lengths(0)), []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    cost, at = np.cumsum(lengths(2)[tree]), 0
    while at < len(asked):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
        roots = above[above]
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]
        now = roots[label]
        query, node = forest.search(asked[at:to], tree[at:to], now[ask[at:to]], now[own], radius)
        a, b = ask[at:to][query], own[node]
        apart = now[a] != now[b]
        a, b = a[apart], b[apart]
        _, pick = np.unique(now[a] * len(above) + now[b], return_index=True)
        for x, y in zip(a[pick].tolist(), b[pick].tolist()):
            p, q = top(label[x]), top(label[y])
            if p != q:
                above[max(p, q)] = min(p, q)
                found.append((int(known[x]), int(known[y])))
        at = to
    return found


def links_of(pairs: DataFrame, radius: int) -> DataFrame:
    """Links (``a``, ``b``) of rows ``asked, asked_of, tree, tree_of``: fingerprints and component names of queries and of a tree."""

    def arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
        column = batch.column(name)
        ends, flat_ = column.offsets.to_numpy(), column.values.to_numpy()
        return [flat_[a:b] for a, b in zip(ends, ends[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = forest_links(list(zip(*(arrays(batch, c) for c in ("asked", "asked_of", "tree", "tree_of")))), radius)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return map_arrow(pairs.select("asked", "asked_of", "tree", "tree_of"), run, "a long, b long")


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """``print`` and ``component`` (a fingerprint) of every fingerprint that is linked with another."""
    masks = tables(prints.count(), radius)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(masks)]))
    dealt = prints.select("print", keys.alias("_k")).select("_k.t", "_k.v", "print")
    sizes = shared_table(dealt.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1"))
    # a large shard is cut by a hash that has nothing to do with the fields
    part = F.pmod(F.xxhash64("print", F.lit(7)), F.ceil(F.col("n") / TREE))
    shards = dealt.join(small(sizes), ["t", "v"]).select("t", "v", part.alias("part"), "print")
    trees = shared_table(shards.groupBy("t", "v", "part").agg(F.collect_list("print").alias("tree")))
    own = trees.select(F.col("tree").alias("asked"), F.col("tree").alias("asked_of"), "tree", F.col("tree").alias("tree_of"))
    links = shared_table(links_of(own, radius))

    # shards of several trees: the first tree takes the queries of the others, then every tree those after it, by what is still apart
    many = shared_table(trees.join(trees.where("part > 0").select("t", "v").distinct(), ["t", "v"], "left_semi"))
    for first in (True, False):
        groups = shared_table(components(links))
        placed = many.select("t", "v", "part", F.explode("tree").alias("print")).join(small(groups), F.col("print") == F.col("id"), "left").withColumn("component", F.coalesce("component", "print"))
        mixed = placed.groupBy("t", "v").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("t", "v")
        both = F.collect_list(F.struct("print", "component"))
        rest = shared_table(placed.join(mixed, ["t", "v"], "left_semi").groupBy("t", "v", "part").agg(both.alias("_m")).select("t", "v", "part", F.col("_m.print").alias("tree"), F.col("_m.component").alias("tree_of")))
        asked = rest.select("t", "v", F.col("part").alias("_from"), F.col("tree").alias("asked"), F.col("tree_of").alias("asked_of"))
        held = rest.where("part = 0") if first else rest.where("part > 0")
        nodes = held.agg(F.sum(F.size("tree"))).first()[0] or 0
        met = asked.join(F.broadcast(held) if nodes <= BROADCAST_ROWS else held, ["t", "v"]).where("_from > part")
        links = shared_table(links.union(links_of(met, radius)))
    return components(links).select(F.col("id").alias("print"), "component")


def link(docs: DataFrame, words: int = 5, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, print, component_id``; documents whose fingerprints differ in at most ``radius`` bits are linked."""
    with scratch() as keep:
        made = keep(shared_table(fingerprints(docs, words, seed, id_col, text_col)))
        prints = shared_table(made.groupBy("print").agg(F.min("doc_id").alias("least")))
        grouped = prints.join(classes(prints.select("print"), radius), "print", "left").withColumn("component", F.coalesce("component", "print"))
        least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        table = keep(shared_table(grouped.join(least, "component").select("print", "component_id")))
    return made.join(table, "print", "left").select("doc_id", "print", "component_id")
