"""Small tables with the cases that every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, T.LongType() if n in ("doc_id", "n_chars", "size", "gram", "shared") else T.StringType()) for n in ("doc_id", "text", "lang", "source", "n_chars", "size", "gram", "shared")])


def words(r: random.Random, n: int, stock: int = 4000) -> list[str]:
    return [f"w{r.randrange(stock)}" for _ in range(n)]


def texts() -> list[str | None]:
    r = random.Random(5)
    base = words(r, 200)
    out: list[str | None] = [" ".join(base), " ".join(base), None, "", "   \n\t", "one", "one two", "ONE two", "É ß 中 🙂"]
    for k in range(30):
        w = list(base)
        for _ in range(k % 7):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        out.append(" ".join(w))
    line = " ".join(words(r, 25))
    for _ in range(40):
        out.append(" ".join(words(r, r.randrange(1, 120))) + "\n" + line)
    out.append(" ".join(words(r, 30_000)))
    out += [" ".join(words(r, 8)) for _ in range(20)]
    return out


def frame(spark, rows=None):
    """documents with clashing further columns; rows: (doc_id, text), or the texts above."""
    rows = list(enumerate(texts())) if rows is None else rows
    langs, sources = ("en", "de", None), ("a", "a", "a", "b", None, "c")
    full = [(i, t, langs[k % 3], sources[k % 6], None if t is None else len(t), 7, 8, 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
