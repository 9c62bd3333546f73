"""Small awkward tables: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use for themselves.
        T.StructField("size", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("rank", T.StringType()),
    ]
)
WORDS = "alpha beta gamma delta épée größe señal and the of to in water stone river".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) + str(rng.randrange(40)) for _ in range(n))


def rows(seed=1, count=60):
    """(doc_id, text, source) rows."""
    rng = random.Random(seed)
    base = prose(rng, 80)
    out = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "ß", "Z", None])) for i in range(count)]
    n = count
    out += [(n, None, "a"), (n + 1, "", None), (n + 2, " \t\n", "a"), (n + 3, "one", "b")]
    out += [(n + 10 + i, base, "a") for i in range(12)]  # copies
    out += [(n + 30 + i, base.replace(" ", "  \n", 1 + i), "b") for i in range(2)]  # equal after normalising
    words = base.split(" ")
    out += [(n + 40 + i, " ".join([*words[:40], f"x{i}", *words[41:]]), "Z") for i in range(5)]  # near copies
    out += [(n + 50, prose(rng, 20_000), "long"), (n + 51, "word " * 3000, "long"), (n + 52, "é" * 5000, "long")]
    out += [(3, out[3][1], out[3][2])]  # a repeated row
    return out


def documents(spark, data=None):
    data = rows() if data is None else data
    full = [(i, t, "en", s, len(t or ""), "size", None, "score", "key", "spans", "rank") for i, t, s in data]
    return spark.createDataFrame(full, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
