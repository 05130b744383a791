"""Quality rules: structure counts and a hashed n-gram log-likelihood ratio.

Every word gives three n-grams: itself, itself with the next word, and its last three
characters, which tell how words are built where the words themselves are rare. They are
hashed to ``BUCKETS`` buckets; each word is hashed once. Two smoothed multinomials over the buckets, one of a
trusted target and one of the whole corpus, give each bucket a log ratio; a document's score
is the mean over its n-grams, and it is kept if that reaches a fixed threshold.

Only built-in functions are used. The target is every trusted document there is, found by an
equi-join on the id that shuffles texts once, whatever their number. A document's n-grams
stay in its own row: only the bucket counts, at most ``BUCKETS`` rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import whole_text

BUCKETS = 1 << 14
SMOOTHING = 1.0
THRESHOLD = -0.3  # natural log units per n-gram
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 10, 5, 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets_of(words: Column, hashes: Column, i: Column, word: Column, buckets: int) -> tuple[Column, ...]:
    """The buckets of the three n-grams of word ``i``."""
    one = F.get(hashes, i)
    two = F.xxhash64(one, F.coalesce(F.get(hashes, i + 1), F.lit(0)))
    end = F.xxhash64(F.right(word, F.lit(3)), F.lit(3))
    return tuple(F.pmod(h, F.lit(buckets)).cast("int") for h in (one, two, end))


def all_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of all n-grams of a document, with repeats."""
    return let(
        hashed(words),
        lambda h: F.flatten(F.transform(words, lambda w, i: F.array(*buckets_of(words, h, i, w, buckets)))),
    )


def repeated_words(words: Column) -> Column:
    """Words, given by their hashes, inside windows of five that the text holds twice or more.

    Windows are compared by a 64-bit hash. Equal ones meet by sorting, so long texts that
    repeat themselves cost n log n.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(
            pairs,
            lambda p: F.filter(
                p,
                lambda x, i: (x["h"] == F.get(p, i + 1)["h"]).eqNullSafe(True)
                | (x["h"] == F.get(p, i - 1)["h"]).eqNullSafe(True),
            ),
        )
        places = F.array_sort(F.transform(same, lambda x: x["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    once = F.lit(0).cast("long")
    return F.when(F.size(words) < WINDOW + 1, once).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), once).otherwise(covered(h)))
    )


def bucket_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of each bucket between the trusted documents and all documents."""
    texts = docs.select("doc_id", whole_text().alias("text"))
    # rows without an id match nothing; they stay out of the join, where they would meet in one task
    no_id = texts.where("doc_id IS NULL").select("text", F.lit(None).cast("int").alias("trusted"))
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    flagged = (
        texts.where("doc_id IS NOT NULL")
        .join(ids.select("doc_id", F.lit(1).alias("trusted")).hint("merge"), "doc_id", "left")
        .select("text", "trusted")
        .union(no_id)
    )
    found = (
        flagged.select("trusted", F.explode(let(words_of(F.col("text")), lambda w: all_buckets(w, buckets))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    )
    raw, target = [0] * buckets, [0] * buckets
    for row in found.collect():  # one row per bucket, in one job
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    import math

    in_raw, in_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    if not sum(target):
        return [0.0] * buckets  # no target, no preference
    return [
        math.log((t + smoothing) / in_target) - math.log((r + smoothing) / in_raw) for t, r in zip(target, raw)
    ]


def trusted_documents(labels: DataFrame) -> DataFrame:
    """(doc_id) of all documents labelled good."""
    return labels.where(F.col("quality") == 1).select("doc_id").where("doc_id IS NOT NULL").distinct()


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """(keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    ``trusted`` holds the ids of any number of documents. A null or blank text
    has no words, so the base rules reject it and its score is 0. Repeated rows are judged
    alike; a null id is never trusted; without trusted documents only the base rules count.
    An empty table gives no rows.
    """
    ratios = bucket_ratios(docs, trusted, buckets, smoothing)
    # a row joined to all documents: as a literal, the plan would spell out the array at each use,
    # and the driver keeps the plans of past queries
    fitted = docs.sparkSession.createDataFrame([(ratios,)], "__ratio__ array<double>")
    text, ratio = F.col("__text__"), F.col("__ratio__")

    def facts(words: Column) -> Column:
        def with_hashes(hashes: Column) -> Column:
            ratios_of = F.transform(
                words,
                lambda w, i: sum(F.get(ratio, b) for b in buckets_of(words, hashes, i, w, buckets)),
            )
            total = F.aggregate(ratios_of, F.lit(0.0), lambda acc, r: acc + r)
            n = F.size(words)
            return F.struct(
                n.cast("long").alias("n_words"),
                repeated_words(hashes).alias("n_repeat_words"),
                F.when(n > 0, total / (3 * n)).otherwise(0.0).alias("score"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            )

        return let(hashed(words), with_hashes)

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    texts = docs.select(*keep, whole_text().alias("__text__"))
    found = texts.crossJoin(F.broadcast(fitted)).select(
        *keep,
        let(words_of(text), facts).alias("_f"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, repeats = F.col("_f.n_words"), F.col("_f.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEATED_PERCENT * n)
    return found.select(
        *keep,
        n.alias("n_words"),
        F.col("_f.word_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeats.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("_f.score") >= threshold)).alias("kept"),
        F.col("_f.score").alias("score"),
    )
