"""Secrets in texts: fixed patterns, and values in credential context that are hard to guess.

A value next to a credential word (``pwd = ...``) is weighed by the guesses an attacker
needs. It is cut into corpus words, dates, repeats, keyboard walks and single characters
tried by brute force; a dynamic programme over its positions finds the cheapest cut, costs
being powers of ten that add up. Values from ``GUESSES`` on are reported as kind ``guess``.

A word costs the inverse of its share among all words of the corpus, its uses as a
credential left out. Values, their substrings and the word counts meet by joins; no word
list is broadcast, and each distinct value is weighed once. Every value is weighed; one that
the fixed patterns cover whole needs no span of its own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import text_slices, whole_text
from frostline.session import write_scratch

KINDS = ("assign", "access", "hex", "guess")  # in the order of the report
GUESSES = 10.0  # powers of ten
MIN_VALUE = 8
WORD_SIZES = (3, 20)

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|api[_ -]?key"""
    r"""|(?:access|private|secret|client)[_ -]?key)["']?\x20*(?:=>|[:=])\x20*["']?([^\s"'<>,;]+)""",
    re.I | re.A,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth")

_IS_HEX = bytes(ord(c) in b"0123456789abcdef" for c in map(chr, range(256)))
_RUN = b"\x01" * LEAST["hex"]

# Characters that stand for letters, and the rows of a keyboard.
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


def _near() -> dict[str, dict[str, tuple[int, int]]]:
    """The neighbours of each key, with the direction that leads to them."""
    at = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    near: dict[str, dict[str, tuple[int, int]]] = {c: {} for c in at}
    for a, (r, i) in at.items():
        for b, (s, j) in at.items():
            beside = r == s and abs(i - j) == 1
            across = abs(r - s) == 1 and 0 <= (r - s) * (j - i) <= 1
            if beside or across:
                near[a][b] = (s - r, j - i)
    return near


NEAR = _near()
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


DATE_SIZES = (4, 8, 9, 10)
MOST_PERIOD = 8
_TWO = math.log10(2)


def base_spans(text: str, lowered: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns; matches that fall short are dropped."""
    lowered = text.lower() if lowered is None else lowered
    found = []
    if any(h in lowered for h in ("pass", "secret", "token", "key")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if _RUN in text.encode("utf-8", "surrogatepass").translate(_IS_HEX):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return found


def is_covered(start: int, end: int, taken: list[tuple[str, int, int]]) -> bool:
    """Whether spans, together, hold every character from start to end."""
    for s, e in sorted((s, e) for _, s, e in taken if s < end and start < e):
        if s > start:
            return False
        start = max(start, e)
    return start >= end


def credential_values(
    text: str, lowered: str, taken: list[tuple[str, int, int]]
) -> list[tuple[int, int, str, bool]]:
    """(start, end, value, covered) in credential context; covered if base spans hold all of it."""
    if not any(h in lowered for h in HINTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, value = m.start(1), m[1].rstrip(".!?)]}")
        end = start + len(value)
        if len(value) >= MIN_VALUE:
            out.append((start, end, value, is_covered(start, end, taken)))
    return out


def substrings(value: str) -> set[str]:
    """The runs of letters that may be words, as written and with look-alikes undone."""
    low, high = WORD_SIZES
    out = set()
    for form in {value.lower(), value.lower().translate(LEET)}:
        if len(form) != len(value):
            continue  # lower case may be longer than the text
        for run in re.finditer(r"[^\W\d_]+", form):
            a, b = run.span()
            out.update(form[i:j] for i in range(a, b) for j in range(i + low, min(i + high, b) + 1))
    return out


def _single(value: str) -> float:
    """Power of ten of the guesses for one character by brute force."""
    pool = sum(size for size, has in ((26, str.islower), (26, str.isupper), (10, str.isdigit)) if any(map(has, value)))
    return math.log10(pool + 33 * any(not c.isalnum() for c in value) or 10)


def _way(a: str, b: str):
    """The direction from a key to one beside it, or along the alphabet; None if neither."""
    return NEAR.get(a, {}).get(b) or (ord(b) - ord(a) if abs(ord(b) - ord(a)) == 1 else None)


def guess_cost(value: str, words: dict[str, float]) -> float:
    """Power of ten of the guesses for the cheapest cut; ``words`` has those of words.

    ``best[j]`` is the cheapest cut of the first j characters: its last segment is a single
    character, a word, a date, a unit of up to eight characters and its repeats, or a walk over
    the keyboard or the alphabet, each at every start.
    """
    n, single = len(value), _single(value)
    lowered = value.lower()
    lowered = lowered if len(lowered) == n else value
    plain = lowered.translate(LEET)
    low, high = WORD_SIZES
    ways = [None, *(_way(a, b) for a, b in zip(lowered, lowered[1:]))]  # into each character
    turns = np.zeros(n + 1)  # changes of way up to each character
    for k in range(2, n):
        turns[k] = turns[k - 1] + (ways[k] != ways[k - 1])
    same = np.zeros((MOST_PERIOD + 1, n + 1), np.int64)  # characters before j that repeat one a period before
    codes = np.array([ord(c) for c in value])
    for p in range(1, min(MOST_PERIOD, n - 1) + 1):
        equal = np.concatenate([np.zeros(p, bool), codes[p:] == codes[:-p]])
        at = np.arange(1, n + 1)
        same[p, 1:] = at - np.maximum.accumulate(np.where(equal, 0, at))
    best, walk = np.zeros(n + 1), 0
    lengths = np.log10(np.maximum(np.arange(n + 2), 1))
    for j in range(1, n + 1):
        least = best[j - 1] + single
        for i in range(max(0, j - high), j - low + 1):
            for form, extra in ((lowered, 0.0), (plain, _TWO)):
                if (cost := words.get(form[i:j])) is not None:
                    capitals = _TWO if value[i:j] != lowered[i:j] else 0.0
                    least = min(least, best[i] + cost + extra + capitals)
        if value[j - 1].isdigit():
            for size in DATE_SIZES:
                if size <= j and DATE.fullmatch(value, j - size, j):
                    least = min(least, best[j - size] + math.log10(365 * 150 if size > 4 else 150))
        for p in range(1, MOST_PERIOD + 1):
            if same[p, j] >= p:  # the unit and at least one repeat end here
                times = np.arange(max(2, -(-3 // p)), same[p, j] // p + 2)
                if len(times):
                    least = min(least, float((best[j - times * p] + lengths[times]).min()) + p * single)
        if ways[j - 1] is None:
            walk = j - 1
        if j - walk >= 3:
            starts = np.arange(walk, j - 2)
            costs = best[starts] + lengths[j - starts] + (1 + turns[j - 1] - turns[starts + 1]) * math.log10(4)
            least = min(least, float(costs.min()) + math.log10(47))
        best[j] = least
    return float(best[n])


def _scan(batches):
    """Appends the base spans and the values in credential context to each row."""
    span = pa.struct([("start", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
    cand = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("covered", pa.bool_())])
    for batch in text_slices(batches, "text"):
        bases, values = [], []
        for text in batch.column("text").to_pylist():
            lowered = (text or "").lower()
            found = base_spans(text or "", lowered)
            bases.append([{"start": s, "place": KINDS.index(k), "kind": k, "end": e} for k, s, e in found])
            own = credential_values(text or "", lowered, found)
            values.append([{"start": s, "end": e, "value": v, "covered": c} for s, e, v, c in own])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(bases, pa.list_(span)), pa.array(values, pa.list_(cand))],
            [*batch.schema.names, "_base", "_values"],
        )


SPAN = "struct<start: int, place: int, kind: string, end: int>"
VALUE = "struct<start: int, end: int, value: string, covered: boolean>"


def _parts(batches):
    """(id, word) of each value; a long value has many words, so its digest stands for it."""
    for batch in batches:
        for own, value in zip(batch.column("id").to_pylist(), batch.column("value").to_pylist()):
            words = list(substrings(value))
            if words:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own] * len(words), pa.string()), pa.array(words, pa.string())], ["id", "word"]
                )


def _weigh(total: int):
    def run(batches):
        for batch in batches:
            costs = []
            for row in batch.to_pylist():
                words = {w["word"]: math.log10(total / w["n"]) for w in row["words"] or ()}
                costs.append(guess_cost(row["value"], words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("value"), pa.array(costs, pa.float64())], ["value", "cost"]
            )

    return run


def corpus_words(text: Column) -> Column:
    low, high = WORD_SIZES
    words = F.split(F.lower(text), r"\P{L}+")
    return F.explode(F.filter(words, lambda w: (F.length(w) >= low) & (F.length(w) <= high))).alias("word")


def weighed_values(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(value, cost) of each distinct value among (value) rows."""
    distinct = values.select("value").distinct().withColumn("id", F.sha2(F.col("value").cast("binary"), 256))
    corpus = docs.select(corpus_words(whole_text())).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = values.select(corpus_words(F.col("value"))).groupBy("word").agg((-F.count(F.lit(1))).alias("n"))
    counts = corpus.union(own).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    counts = write_scratch(counts, "secret-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    parts = distinct.mapInArrow(_parts, "id string, word string")
    known = (
        parts.join(counts, "word").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    )
    rows = distinct.join(known, "id", "left")
    return rows.mapInArrow(_weigh(total), "value string, cost double")


def as_text(spans: Column) -> Column:
    """kind:start:end of spans, by start and then kind, joined by commas."""
    one = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def find_secrets(docs: DataFrame, guesses: float = GUESSES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., _base, _spans): spans are structs of start, place, kind and end.

    Offsets count characters, ends are exclusive. Base spans of one kind don't overlap;
    a ``guess`` span may overlap base spans that cover its value in part, and is left out where
    they cover all of it. A null or empty text has none; repeated rows, null ids and clashing
    columns change nothing; an empty table gives no rows.
    """
    rows = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    scanned = rows.mapInArrow(
        _scan, f"{kinds}, _base array<{SPAN}>, _values array<{VALUE}>"
    )
    scanned = write_scratch(
        scanned.select(*keep, "_base", "_values", F.monotonically_increasing_id().alias("_row")), "secret-spans"
    )
    few = scanned.where(F.size("_values") > 0)
    values = few.select("_row", F.inline("_values"))
    hard = weighed_values(docs, values).where(F.col("cost") >= guesses).select("value")
    span = F.struct("start", F.lit(KINDS.index("guess")).alias("place"), F.lit("guess").alias("kind"), "end")
    extra = values.where("NOT covered").join(hard, "value").groupBy("_row").agg(F.collect_list(span.cast(SPAN)).alias("_extra"))
    none = F.array().cast(f"array<{SPAN}>")
    # only rows with such values are joined; the others keep their place
    joined = few.join(extra, "_row", "left").select(*keep, "_base", F.concat("_base", F.coalesce("_extra", none)).alias("_spans"))
    return joined.union(scanned.where(F.size("_values") == 0).select(*keep, "_base", F.col("_base").alias("_spans")))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``find_secrets``."""
    of = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[of(k) for k in KINDS[:3]],
        F.sha2(as_text(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, guesses: float = GUESSES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; spans that overlap give one mark.

    Rows without secrets stay as they are, null texts too.
    """
    names = docs.columns
    # the whole row as one value, so that no column's name can clash
    packed = docs.select(F.struct(*names).alias("row__"), F.col("text"))
    found = find_secrets(packed, guesses, ("row__", "text"))
    clean, dirty = found.where(F.size("_spans") == 0), found.where(F.size("_spans") > 0)

    def cut(batches):
        for batch in text_slices(batches, "text"):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                out, at = [], 0
                for start, end in sorted((s["start"], s["end"]) for s in spans):
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, end)
                texts.append("".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row__"), pa.array(texts, pa.string())], ["row__", "text"])

    schema = packed.schema
    mended = dirty.select("row__", "text", "_spans").mapInArrow(cut, schema)
    columns = [F.col("text") if n == "text" else F.col("row__")[n].alias(n) for n in names]
    return clean.select(*columns).union(mended.select(*columns))
