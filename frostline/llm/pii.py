"""Personal data: fixed patterns, and spans that a character model finds beside them.

The model (``pii_model``) learns from the spans of the fixed patterns in a bounded number of
windows. Personal data of these kinds holds a digit or an ``@``; that is a hard rule of the
decoding, so stretches without either can only come out as outside and are not computed. All
other stretches of every text are covered by windows of ``WINDOW`` characters that overlap by
half; the scores of a character are averaged over its windows, and one decoding runs over
each whole stretch, so spans across window edges come out in one piece.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import pii_model
from frostline.functions.names import free_name
from frostline.llm.common import refuse_names, text_slices, whole_text
from frostline.llm.pii_model import KINDS, TAGS

WINDOW, STRIDE = 64, 32
TRAIN_WINDOWS = 4_000  # at most so many windows are learned from
TRAIN_STEPS = 300
CERTAINTY = 0.9  # mean probability of a model span's tags, over all sequences
BATCH_WINDOWS = 2_048
TRIGGER = "[0-9@]"

# The patterns of the base kinds, written so that no text costs more than
# linear time (a run of digits or of address characters is entered at its start only).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > free and LOCAL_END.match(text[start - 1]):
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                free = domain.end()
        free = max(free, at + 1)
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns; matches that fail their rule are dropped."""
    out = [("email", *span) for span in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(m[0]) and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit or an @, on a grid of half windows."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hits = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    if not len(hits):
        return hits
    cells = np.unique(hits // STRIDE)  # each lies in the window that starts there and the one before
    return np.unique(np.concatenate([cells, np.maximum(cells - 1, 0)])) * STRIDE


def cut(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([symbols, np.zeros(WINDOW, symbols.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not tags[start:end].any():
            begin = 1 + 2 * KINDS.index(kind)
            tags[start], tags[start + 1 : end] = begin, begin + 1
    return tags


def _allowed(kind: str, part: str) -> bool:
    """What a span of a kind must have at least, however it is written."""
    digits = len(_digits(part))
    least, most = {"email": (0, 99), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}[kind]
    if not least <= digits <= most or any(c in part for c in "\n\r"):
        return False
    return "@" in part.strip("@") if kind == "email" else True


def model_spans(texts: list[str], bases: list[list], p: dict) -> list[list[tuple[str, int, int]]]:
    """Spans of the model in each text, apart from those that overlap base spans."""
    starts = [window_starts(t) for t in texts]
    tagged = [pii_model.symbols_of(t) for t in texts]
    rows = [cut(s, w) for s, w in zip(tagged, starts) if len(w)]
    out: list[list] = [[] for _ in texts]
    if not rows:
        return out
    rows = np.concatenate(rows)
    scores = np.concatenate(
        [pii_model.emissions(p, rows[i : i + BATCH_WINDOWS]) for i in range(0, len(rows), BATCH_WINDOWS)]
    )
    # stretches of windows that follow each other, each with its averaged scores
    stretches, at = [], 0
    for i, own in enumerate(starts):
        for run in np.split(own, np.flatnonzero(np.diff(own) != STRIDE) + 1) if len(own) else []:
            size = int(run[-1] - run[0]) + WINDOW
            total, times = np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)
            for k in range(len(run)):
                first = k * STRIDE
                total[first : first + WINDOW] += scores[at + k]
                times[first : first + WINDOW] += 1
            at += len(run)
            stretches.append((i, int(run[0]), total / times))
    stretches.sort(key=lambda s: len(s[2]))
    first = 0
    while first < len(stretches):
        last = first
        size = len(stretches[first][2])
        while last < len(stretches) and len(stretches[last][2]) == size and last - first < BATCH_WINDOWS:
            last += 1
        group = stretches[first:last]
        stacked = np.stack([s for _, _, s in group])
        tags = pii_model.viterbi(stacked, p["moves"])
        sure = pii_model.marginals(stacked, p["moves"])
        for row in np.flatnonzero(tags.any(axis=1)).tolist():
            i, offset, _ = group[row]
            for kind, start, end in _spans(tags[row]):
                a, b = offset + start, min(offset + end, len(texts[i]))
                certain = sure[row, np.arange(start, end), tags[row, start:end]].mean()
                part = texts[i][a:b]
                clear = all(b <= s or e <= a for _, s, e in bases[i])
                if clear and certain >= CERTAINTY and _allowed(kind, part):
                    out[i].append((kind, a, b))
        first = last
    return out


def _spans(tags: np.ndarray):
    at = 0
    while at < len(tags):
        tag = int(tags[at])
        end = at + 1
        if tag:
            inside = tag + tag % 2
            while end < len(tags) and tags[end] == inside:
                end += 1
            yield KINDS[(tag - 1) // 2], at, end
        at = end


def training_windows(docs: DataFrame, at_most: int = TRAIN_WINDOWS) -> DataFrame:
    """A fixed pick of at most so many windows with their tags, from all documents."""

    def run(batches):
        for batch in text_slices(batches, "text"):
            made = {"symbols": [], "tags": []}
            for text in batch.column("text").to_pylist():
                starts = window_starts(text)
                made["symbols"] += [w.astype(np.uint8).tobytes() for w in cut(pii_model.symbols_of(text), starts)]
                tags = tags_of(len(text), base_spans(text))
                made["tags"] += [w.astype(np.uint8).tobytes() for w in cut(tags, starts)]
            yield pa.RecordBatch.from_pydict(made, pa.schema([("symbols", pa.binary()), ("tags", pa.binary())]))

    rows = docs.select(whole_text().alias("text")).where(F.col("text").rlike(TRIGGER))
    windows = rows.mapInArrow(run, "symbols binary, tags binary").distinct()
    return windows.orderBy(F.xxhash64("symbols", "tags"), "symbols", "tags").limit(at_most)


def train(docs: DataFrame, steps: int = TRAIN_STEPS) -> dict[str, np.ndarray]:
    """The model's parameters, fitted in one task on the picked windows."""
    shapes = {k: v.shape for k, v in pii_model.start_parameters().items()}

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        windows, tags = (
            np.array([np.frombuffer(r[c], np.uint8) for r in rows], np.int64).reshape(-1, WINDOW) for c in ("symbols", "tags")
        )
        p = pii_model.train(windows, tags, steps)
        yield pa.RecordBatch.from_pydict({"data": [np.concatenate([p[k].reshape(-1) for k in shapes]).astype("<f4").tobytes()]})

    found = training_windows(docs).coalesce(1).mapInArrow(run, "data binary").collect()
    data = np.frombuffer(found[0]["data"], "<f4") if found else None
    if data is None:
        return pii_model.train(np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64), 0)
    ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
    return {k: part.reshape(s) for (k, s), part in zip(shapes.items(), np.split(data, ends[:-1]))}


SPAN = "struct<place: int, start: int, kind: string, end: int>"


def find_personal_data(docs: DataFrame, parameters: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., base, spans): structs of place of the kind, start, kind and end.

    Offsets count characters, ends are exclusive; model spans overlap no base span. A null
    or empty text has none; repeated rows, null ids and clashing columns change nothing; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parameters)  # of fixed size
    span = pa.list_(pa.struct([("place", pa.int32()), ("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    refuse_names(keep, "base", "spans")
    column = free_name("__text__", *keep)

    def structs(spans):
        return [{"place": KINDS.index(k), "start": s, "kind": k, "end": e} for k, s, e in spans]

    def run(batches):
        for batch in text_slices(batches, column):
            texts = batch.column(column).to_pylist()
            bases = [base_spans(t) for t in texts]
            more = model_spans(texts, bases, shared.value)
            columns = [batch.column(c) for c in keep]
            columns.append(pa.array([structs(b) for b in bases], span))
            columns.append(pa.array([structs(b + m) for b, m in zip(bases, more)], span))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "base", "spans"])

    rows = docs.select(*keep, whole_text().alias(column))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    possible = F.col(column).rlike(TRIGGER)
    found = rows.where(possible).mapInArrow(run, ", ".join([*kinds, f"base array<{SPAN}>", f"spans array<{SPAN}>"]))
    none = F.array().cast(f"array<{SPAN}>")
    return found.union(rows.where(~possible).select(*keep, none.alias("base"), none.alias("spans")))


def as_text(spans: Column) -> Column:
    """kind:start:end of spans, by kind and then start, joined by commas."""
    one = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def report(found: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[of(k) for k in KINDS],
        F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
