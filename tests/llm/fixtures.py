"""Small tables with the hard cases, and plain versions of what the operators compute."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: The same, with names that operators use inside.
CLASH = T.StructType([*DOCS.fields, *(T.StructField(c, T.StringType()) for c in ("row", "key", "node", "sha", "size", "text_sha256", "keep_id", "_id", "n", "component", "shard", "finish", "host"))])


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa mu nu xi omicron pi rho".split()) + str(rng.randrange(40)) for _ in range(n)]


def rows(seed=1):
    rng = random.Random(seed)
    base = words(rng, 120)
    out = []

    def add(text, source="a", lang="en", doc_id=...):
        out.append((len(out) if doc_id is ... else doc_id, text, lang, source, None if text is None else len(text)))

    for text in (None, "", " \n\t", "one", "One two", "a b c d", "Émile ÇA 漢字 🙂 x y", "<|endoftext|> hi"):
        add(text, None)
    for k in range(14):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        add(" ".join(w), "b" if k % 2 else "a")
    for _ in range(6):
        add(" ".join(base))
    for k in range(10):
        add("\n".join(" ".join(words(rng, 12)) for _ in range(rng.randrange(1, 12))), f"s{k % 3}", "fr")
    shared = " ".join(words(rng, 60))
    for k in range(5):
        add(" ".join(words(rng, 30)) + " " + shared + " " + " ".join(words(rng, 20)), "c")
    add("word " * 400, "c")
    add(" ".join(words(rng, 15_000)), "long")
    out.append(out[-3])  # a repeated row
    out.append((None, "a row without an id", None, None, None))
    return out


def tables(spark):
    plain = spark.createDataFrame(rows(), DOCS)
    return plain, spark.createDataFrame([], DOCS), spark.createDataFrame([(*r, *(["x"] * (len(CLASH) - 5))) for r in rows()], CLASH)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)
