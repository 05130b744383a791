"""Small tables with every awkward row, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 7))) for _ in range(words))


def rows() -> list[tuple]:
    base = prose(1, 60)
    near = base.replace(base.split()[30], "changed", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, prose(2, 50)), (5, ""), (6, None), (7, " \n\t "),
        (8, "one two"), (9, "ONE two"), (10, prose(3, 30_000)), (11, "same words again and again\n" * 12),
        (12, "it's 12's  don't\n\n x y 北京\t　é! 'll"), (13, "a" * 5_000), (None, base), (None, "no id here at all"),
        (14, prose(4, 40)), (14, prose(4, 40)), (-3, prose(5, 25)), (15, "x <|endoftext|> y"),
    ]
    sources = ["b", "a", None, "c"]
    return [(i, t, "en", sources[n % 4], len(t) if t is not None else None) for n, (i, t) in enumerate(texts)]


def documents(spark, extra=()):
    """The rows, with clashing extra columns."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows(), DOCS)
    for name in ("ids", "score", "base", "text_hash", "key", "size", "value", "n", "_text", *extra):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(text: str | None) -> list[str]:
    return words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text: str | None) -> set[tuple]:
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(table: list[tuple]) -> list[int]:
    """For each row the number of its group, by comparing all pairs."""
    sets = [shingles(r[1]) for r in table]
    group = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * union and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
