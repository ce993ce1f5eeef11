"""Version vectors and conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME_BYTES = 255


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("bigint"))


def compare(a: Column, b: Column) -> Column:
    """``equal``, ``greater``, ``less`` or ``concurrent`` for two maps; a missing node counts 0."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(zero(x).alias("x"), zero(y).alias("y"))))
    le, ge = F.forall(both, lambda p: p["x"] <= p["y"]), F.forall(both, lambda p: p["x"] >= p["y"])
    return F.when(le & ge, "equal").when(ge, "greater").when(le, "less").otherwise("concurrent")


def dominates(a: Column, b: Column) -> Column:
    return compare(a, b).isin("equal", "greater")


def join(a: Column, b: Column) -> Column:
    """Entrywise maximum without zeros."""
    return F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.greatest(zero(x), zero(y))), lambda _, v: v > 0)


def bump(vector: Column, node: str | Column) -> Column:
    """The vector with one more change by a node."""
    node = F.lit(node) if isinstance(node, str) else node
    rest = F.map_filter(vector, lambda k, _: k != node)
    return F.map_concat(rest, F.map_from_arrays(F.array(node), F.array(zero(F.element_at(vector, node)) + 1)))


def from_rows(rows: DataFrame, *key: str) -> DataFrame:
    """Vector of each key from changes (``node``): the number of changes by every node."""
    each = rows.groupBy(*key, "node").agg(F.count("*").alias("counter"))
    return each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "counter")))).alias("vector"))


def compare_long(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """The same order from long form (``key, node, counter``), for keys on both sides: one full join and one aggregate."""
    x, y = a.select(key, "node", F.col("counter").alias("l")), b.select(key, "node", F.col("counter").alias("r"))
    both = x.join(y, [key, "node"], "full_outer")
    keys = a.select(key).distinct().join(b.select(key).distinct(), key)
    le, ge = F.bool_and(zero(F.col("l")) <= zero(F.col("r"))), F.bool_and(zero(F.col("l")) >= zero(F.col("r")))
    out = both.join(keys, key).groupBy(key).agg(le.alias("le"), ge.alias("ge"))
    return out.select(key, F.when(F.col("le") & F.col("ge"), "equal").when(F.col("ge"), "greater").when(F.col("le"), "less").otherwise("concurrent").alias("ordering"))


def join_long(rows: DataFrame, key: str = "path") -> DataFrame:
    """Joined vector of all versions of a key, long form."""
    return rows.groupBy(key, "node").agg(F.max("counter").alias("counter")).where("counter > 0")


def wins(author_a: Column, ms_a: Column, author_b: Column, ms_b: Column) -> Column:
    """Does version a win over b?  The later edit, on a tie the larger author."""
    return F.when(ms_a != ms_b, ms_a > ms_b).otherwise(author_a > author_b)


def winner(versions: DataFrame, key: str = "path") -> DataFrame:
    """Winning version among concurrent ones of each key."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*[c for c in versions.columns if c != key]), F.struct("authored_ms", "author")).alias("_w")).select(key, "_w.*")


def conflict_path(path: Column, author: Column, authored_ms: Column) -> Column:
    """``<dir><stem>.conflict-<time>-<author><ext>``; the stem is cut so that the name fits 255 bytes.

    The cut counts bytes; a character it would split is left out.
    """
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    folder = F.substr(path, F.lit(1), F.char_length(path) - F.char_length(base))
    dot = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    whole = F.char_length(dot) == F.char_length(base)  # a dotfile is all extension: keep its name visible
    ext = F.when(whole, "").otherwise(dot)
    stem = F.substr(base, F.lit(1), F.char_length(base) - F.char_length(ext))
    suffix = F.concat(F.lit(".conflict-"), F.date_format(F.timestamp_millis(authored_ms), "yyyyMMdd'T'HHmmss.SSS'Z'"), F.lit("-"), author)
    room = F.lit(NAME_BYTES) - F.octet_length(suffix) - F.octet_length(ext)
    cut = F.decode(F.substring(F.encode(stem, "UTF-8"), F.lit(1), room), "UTF-8")
    fits = F.octet_length(stem) <= room
    stem = F.when(fits | (room < 0), stem).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))
    return F.concat(folder, stem, suffix, ext)


#: Columns of a version: what a delta carries and a row holds.
VERSION = ("path", "manifest_id", "vector", "author", "authored_ms", "deleted")


def resolve(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to apply for a batch of remote versions, each compared with the local row as it was before the batch.

    New or newer versions are taken as they are; equal and older ones are dropped; concurrent ones are reconciled: an edit
    beats a delete, equal contents merge under the winner's author, otherwise the winner takes the path with the joined
    vector and a live loser is kept beside it under its conflict path with its own vector.  ``action`` names the case.
    """
    mine = local.select(F.struct(*VERSION).alias("l"), F.col("path").alias("_p"))
    both = incoming.select(F.struct(*VERSION).alias("r"), F.col("path").alias("_q")).join(mine, F.col("_q") == F.col("_p"), "left")
    left, right = F.col("l"), F.col("r")
    order = F.when(left.isNull(), "new").otherwise(compare(left["vector"], right["vector"]))
    joined = join(left["vector"], right["vector"])
    local_wins = wins(left["author"], left["authored_ms"], right["author"], right["authored_ms"])

    def row(side: Column, vector: Column, action: str, path: Column | None = None, author: Column | None = None, ms: Column | None = None) -> Column:
        return F.struct((side["path"] if path is None else path).alias("path"), side["manifest_id"].alias("manifest_id"), vector.alias("vector"), (side["author"] if author is None else author).alias("author"), (side["authored_ms"] if ms is None else ms).alias("authored_ms"), side["deleted"].alias("deleted"), F.lit(action).alias("action"))

    def keep_both(win: Column, lose: Column) -> Column:
        copy = row(lose, lose["vector"], "copy", conflict_path(lose["path"], lose["author"], lose["authored_ms"]))
        first = row(win, joined, "winner")
        return F.when(lose["deleted"], F.array(first)).otherwise(F.array(first, copy))

    none = F.filter(F.array(row(right, right["vector"], "")), lambda _: F.lit(False))
    merged = row(right, joined, "merged", None, F.when(local_wins, left["author"]).otherwise(right["author"]), F.when(local_wins, left["authored_ms"]).otherwise(right["authored_ms"]))
    concurrent = (
        F.when(left["deleted"] & ~right["deleted"], F.array(row(right, joined, "edit over delete")))
        .when(right["deleted"] & ~left["deleted"], F.array(row(left, joined, "edit over delete")))
        .when(left["manifest_id"] == right["manifest_id"], F.array(merged))
        .when(local_wins, keep_both(left, right))
        .otherwise(keep_both(right, left))
    )
    rows = F.when(order == "new", F.array(row(right, right["vector"], "new"))).when(order == "less", F.array(row(right, right["vector"], "newer"))).when(order == "concurrent", concurrent).otherwise(none)
    return both.select(F.explode(rows).alias("x")).select("x.*")


def converge(versions: DataFrame, key: str = "path") -> DataFrame:
    """What any order of applying concurrent live edits ends in: the winner in place, every other content as a copy.

    ``versions``: ``path, manifest_id, author, authored_ms`` of versions that do not dominate each other.
    """
    order = Window.partitionBy(key).orderBy(F.desc("authored_ms"), F.desc("author"))
    ranked = versions.withColumn("_n", F.row_number().over(order)).withColumn("_first", F.first("manifest_id").over(order))
    kept = ranked.where((F.col("_n") == 1) | (F.col("manifest_id") != F.col("_first")))
    path = F.when(F.col("_n") == 1, F.col(key)).otherwise(conflict_path(F.col(key), F.col("author"), F.col("authored_ms")))
    return kept.select(path.alias("path"), "manifest_id", "author", (F.col("_n") > 1).alias("copy"))
