"""Token-id files: one flat id array per shard and Elias-Fano coded document boundaries.

Documents are range partitioned by id; each task writes one shard of two files:

``shard-N.ids``   the ids of all its documents, end id included, one after the other, as
                  little-endian integers of ``id_bytes`` bytes (2 where the vocabulary fits).
``shard-N.ef``    a header and two Elias-Fano sequences: where documents end in the id
                  array, and the document ids (ascending; nulls come first and are counted).

A sequence of n values up to u takes about n * (2 + log2(u / n)) bits. Value i is found by
selecting the i-th set bit of its upper part: the place of every ``SAMPLE``-th is kept and
the words in between are counted; no table of one 64-bit offset per document is needed.

Files get their final name only when they are complete, so a task that runs again leaves
the same two files.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.bpe import PieceCache, encode_texts
from frostline.llm.common import parallelism, text_slices, whole_text

END_ID = 2
SAMPLE = 512
BLOCK = 4096  # documents that are written or read together
CACHED = 600_000  # pieces of each generation of the cache
GROUP_CHARS = 2_000_000
SPACE = "\u0120"  # how the vocabulary file writes the byte of a space (fixed value)
MAGIC = b"EFTOKEN1"
READ_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, high, samples  # bytes, 64-bit words, words

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            packed = []
            for i in range(0, n, BLOCK):  # a block of low parts ends on a whole byte
                bits = ((values[i : i + BLOCK, None] >> shifts) & np.uint64(1)).astype(np.uint8)
                packed.append(np.packbits(bits.reshape(-1), bitorder="little"))
            low = np.concatenate(packed)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(at[-1]) + 64) // 64 if n else 0
        raised = np.zeros(size * 64, np.uint8)
        raised[at] = 1
        high = np.packbits(raised, bitorder="little").view(np.uint64)
        # for every SAMPLE-th value: the word of its bit, and the set bits before that word
        words = at[::SAMPLE] >> 6
        before = np.searchsorted(at, words * 64)
        return cls(n, low_bits, low, high, np.stack([words, before], axis=1).astype("<u8"))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        part = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return (part >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: the position of the i-th set bit gives its upper part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        word, before = (int(x) for x in self.samples[i // SAMPLE])
        while before + (count := int(self.high[word]).bit_count()) <= i:
            before += count
            word += 1
        bits = int(self.high[word])
        for _ in range(i - before):
            bits &= bits - 1
        at = word * 64 + (bits & -bits).bit_length() - 1
        return ((at - i) << self.low_bits) | self._low(i)

    def block(self, first: int, count: int = BLOCK) -> np.ndarray:
        """Values ``first`` to ``first + count``: the first one is found as ``select`` does, the
        set bits after it are read on from there."""
        last = min(first + count, self.n)
        if first >= last:
            return np.zeros(0, np.int64)
        word, before = (int(x) for x in self.samples[first // SAMPLE])
        places, have = [], before
        while have < last:
            part = self.high[word : word + SAMPLE]
            places.append(np.flatnonzero(np.unpackbits(part.view(np.uint8), bitorder="little")) + word * 64)
            have += len(places[-1])
            word += SAMPLE
        at = np.concatenate(places)[first - before : last - before]
        upper = (at - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return upper.astype(np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (upper | (bits.reshape(last - first, self.low_bits) @ weights).astype(np.uint64)).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, "<u8", b, at + a)
        samples = np.frombuffer(data, "<u8", 2 * c, at + a + 8 * b).reshape(c, 2)
        return cls(n, low_bits, low, high, samples), at + a + 8 * b + 16 * c


class LibraryPieces(PieceCache):
    """Ids of pieces by the tokenizers library.

    Of two generations the older one goes when the newer is full; pieces that are met again move
    on to the newer. Pieces of a space and letters are handed to the library joined, since its
    pattern cuts them apart again: only their first tokens begin with a space.
    """

    def __init__(self, tokenizer):
        super().__init__(None, CACHED)
        self.tokenizer, self.older = tokenizer, {}
        self.leads = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
            self.leads[number] = token.startswith(SPACE)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def library(self, names: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out = [b""] * len(names)
        plain = [i for i, n in enumerate(names) if n[0] == " " and n[1:].isalpha()]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for own, ids in zip(groups, self._ids(["".join(map(names.__getitem__, g)) for g in groups])):
            flat = np.array(ids, "<u4")
            cuts = np.flatnonzero(self.leads[flat])
            if len(cuts) != len(own):  # cut elsewhere after all: these pieces go one by one
                plain = [i for i in plain if i not in set(own)]
                continue
            data, ends = flat.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(flat)]
            for i, first, last in zip(own, (4 * cuts).tolist(), ends):
                out[i] = data[first:last]
        rest = sorted(set(range(len(names))).difference(plain))
        for i, ids in zip(rest, self._ids([names[i] for i in rest])):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def of(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        names = [pieces[i] for i in new]
        known = list(map(self.older.get, names))
        missing = [k for k, ids in enumerate(known) if ids is None]
        for k, ids in zip(missing, self.library([names[k] for k in missing])):
            known[k] = ids
        for i, ids in zip(new, known):
            found[i] = ids
        if len(self) + len(new) > self.limit:
            self.older = dict(self)
            self.clear()
        self.update((n, ids) for n, ids in zip(names, known) if len(n) <= 64)
        return found


@functools.cache
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already uses every core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _cache(path: str) -> LibraryPieces:
    return LibraryPieces(load_tokenizer(path))


def library_ids(texts: list[str], path: str):
    """Ids of each text, as the library's ``encode`` gives them without special tokens.

    The library merges every piece of its pattern by itself, so pieces are looked up in a
    cache that the library fills. A text that spells out one of the vocabulary's added
    tokens is handed over whole.
    """
    tokenizer = load_tokenizer(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = {i for i, text in enumerate(texts) if any(a in text for a in added)}
    plain = ["" if i in whole else text for i, text in enumerate(texts)]
    for i, (ids, _) in enumerate(encode_texts(plain, _cache(path), GROUP_CHARS)):
        yield np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4") if i in whole else ids


def _shard(out: str, number: int) -> str:
    return f"{out.rstrip('/')}/shard-{number:06d}"


def _writer(path: str, out: str, end_id: int, id_bytes: int):
    def run(batches):
        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        target, base = fs.FileSystem.from_uri(_shard(out, number))
        target.create_dir(os.path.dirname(base), recursive=True)
        sizes, doc_ids, nulls, end = [], [], 0, np.array([end_id], "<u4")
        with target.open_output_stream(f"{base}.ids.{attempt}") as stream:
            for batch in text_slices(batches):
                column = batch.column("doc_id")
                nulls += column.null_count
                doc_ids.append(column.drop_null().to_numpy(zero_copy_only=False))
                found = list(library_ids(batch.column("text").to_pylist(), path))
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)) + 1)
                flat = np.concatenate([x for ids in found for x in (ids, end)])
                stream.write(flat.astype(f"<u{id_bytes}").tobytes())
        sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        ends = np.cumsum(sizes)
        ids = np.concatenate([np.zeros(0, np.int64), *doc_ids]).astype(np.int64)
        first = int(ids[0]) if len(ids) else 0
        head = json.dumps({"id_bytes": id_bytes, "nulls": nulls, "first": first}).encode()
        with target.open_output_stream(f"{base}.ef.{attempt}") as stream:
            stream.write(MAGIC + struct.pack("<I", len(head)) + head)
            stream.write(EliasFano.of(ends).to_bytes())
            stream.write(EliasFano.of(ids.view(np.uint64) - np.uint64(first % 2**64)).to_bytes())
        for kind in ("ids", "ef"):
            target.move(f"{base}.{kind}.{attempt}", f"{base}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {"shard": [number], "n_docs": [len(sizes)], "n_tokens": [int(ends[-1]) if len(ends) else 0]},
            pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    return run


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the shards in ascending ``doc_id`` order; returns (shard, n_docs, n_tokens).

    Null ids come first; rows of equal id are ordered by their text's hash. A null text
    counts as empty and is written as the end id alone. An empty table writes no documents.
    The folder must be one that all executors reach.
    """
    vocabulary = load_tokenizer(path).get_vocab_size(with_added_tokens=True)
    id_bytes = 2 if max(vocabulary, end_id + 1) <= 2**16 else 4
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("_order"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_order")]
    n = shards or parallelism(docs.sparkSession)
    parts = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = parts.mapInArrow(_writer(path, out, end_id, id_bytes), "shard int, n_docs long, n_tokens long")
    manifest = f"{out.rstrip('/')}/manifest"
    written.write.parquet(manifest)  # the only time the shards are written
    return docs.sparkSession.read.schema(written.schema).parquet(manifest)


class Shard:
    """Reads one shard: any document by the select structures, or all in order."""

    def __init__(self, out: str, number: int):
        self.files, self.base = fs.FileSystem.from_uri(_shard(out, number))
        with self.files.open_input_file(f"{self.base}.ef") as f:
            data = f.read()
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{self.base}.ef is no boundary file")
        (size,) = struct.unpack_from("<I", data, len(MAGIC))
        at = len(MAGIC) + 4 + size
        head = json.loads(data[at - size : at])
        self.kind, self.width, self.nulls, self.first = f"<u{head['id_bytes']}", head["id_bytes"], head["nulls"], head["first"]
        self.ends, at = EliasFano.from_bytes(data, at)
        self.ids, _ = EliasFano.from_bytes(data, at)

    def __len__(self) -> int:
        return self.ends.n

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        first, last = self.span(i)
        with self.files.open_input_file(f"{self.base}.ids") as f:
            f.seek(first * self.width)
            return np.frombuffer(f.read((last - first) * self.width), self.kind)

    def blocks(self, count: int = BLOCK):
        """(doc_ids, starts, ends, crc32s) of consecutive documents, ``count`` at a time."""
        with self.files.open_input_file(f"{self.base}.ids") as f:
            buffer, at, last = np.zeros(0, "<u4"), 0, 0
            for first in range(0, len(self), count):
                ends = self.ends.block(first, count)
                starts = np.append(last, ends[:-1])
                found = self.ids.block(max(first - self.nulls, 0), first + len(ends) - max(first, self.nulls))
                none = np.arange(first, first + len(ends)) < self.nulls
                crcs = []
                for place, last in zip(starts.tolist(), ends.tolist()):
                    crc = 0
                    while place < last:
                        if place >= at + len(buffer):
                            at += len(buffer)
                            buffer = np.frombuffer(f.read(READ_IDS * self.width), self.kind).astype("<u4")
                        part = buffer[place - at : last - at]
                        crc = zlib.crc32(part, crc)
                        place += len(part)
                    crcs.append(crc)
                ids = np.append(np.zeros(int(none.sum()), np.int64), found + self.first)
                yield pa.array(ids, pa.int64(), mask=none), starts, ends, np.array(crcs, np.int64)

def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    ``start`` counts the ids of all documents before it in the whole data set.
    """
    # one row per shard
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.where("n_docs > 0").select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for doc_id, starts, ends, crcs in Shard(out, row["shard"]).blocks():
                    yield pa.RecordBatch.from_arrays(
                        [doc_id, pa.array(starts + row["base"]), pa.array(ends - starts), pa.array(crcs)],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = parallelism(manifest.sparkSession)
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents_from_files(spark: SparkSession, docs: DataFrame, path: str, out: str) -> DataFrame:
    """Writes the files of ``docs`` and returns what reading them back gives."""
    return read_token_files(write_token_files(docs, path, out), out)
