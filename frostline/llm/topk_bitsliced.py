"""Exact top-k inner products over a bit-sliced index.

Every component is quantised to an integer. A block of candidates is stored as bit slices:
slice ``b`` of dimension ``d`` is a bitmap that holds bit ``b`` of that dimension for all
rows of the block. A query's scores are the sum of shifted slices, added for all rows at
once by carry-save adders on bitmaps; the result is again a list of slices. The best rows
are then selected from the most significant slice downward, and the rows that tie at the
boundary are settled by id. Nothing is approximated, so the result is exact.

Blocks and chunks of queries meet by an equi-join on the block number, so the work is split
by both and no task holds more than one block and one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import parallelism
from frostline.session import write_scratch

BLOCK_ROWS = 65_536
CHUNK_ROWS = 128
SUM_BITS = 60  # sums of slices and their offsets are kept in 64-bit integers


class ScoresTooLarge(ValueError):
    """Inner products of these vectors may not fit 64-bit integers."""


def check_sums(vectors: DataFrame, queries: DataFrame, vector_col: str, scale: int) -> None:
    """Fails if a product sum can pass ``SUM_BITS`` bits: the longest vector's length times the
    largest component on either side. Two numbers per side come back."""
    sides = []
    for side in (vectors, queries):
        x = F.col(vector_col)
        largest = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
        sides.append(side.where(_takes_part(x)).agg(F.max(largest), F.max(F.size(x))).first())
    (a, n), (b, m) = sides
    if a is not None and b is not None and (a * scale + 1) * (b * scale + 1) * min(n, m) >= 2.0**SUM_BITS:
        raise ScoresTooLarge(f"components up to {a} and {b} in {min(n, m)} dimensions, times {scale} each")


def _takes_part(x):
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & finite


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, q): floor(scale * x) per component, for the vectors that take part."""
    x = F.col(vector_col)
    whole = F.transform("x", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return (
        vectors.where(F.col(id_col).isNotNull() & _takes_part(x))
        .select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
        .dropDuplicates(["id", "x"])
        .select("id", whole.alias("q"))
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Slices:
    """Bit slices of a block: ``bits[d]`` slices from ``first[d]`` on, above ``low[d]``."""

    def __init__(self, matrix: np.ndarray):
        rows, dims = matrix.shape
        self.rows = rows
        self.words = -(-rows // 64)
        self.low = matrix.min(axis=0) if rows else np.zeros(dims, np.int64)
        top = (matrix.max(axis=0) if rows else self.low) - self.low
        self.bits = np.array([int(t).bit_length() for t in top], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.bits)])
        n = int(self.first[-1])
        # slices and, behind them, their complements for negative weights
        self.planes = np.zeros((2 * n, self.words), np.uint64)
        for d in range(dims):
            shifted = matrix[:, d] - self.low[d]
            for b in range(int(self.bits[d])):
                self.planes[self.first[d] + b] = pack((shifted >> b) & 1, self.words)
        np.invert(self.planes[:n], out=self.planes[n:])
        self.n = n

    def scores(self, query: np.ndarray) -> tuple[list, int]:
        """Slices of the rows' scores, least significant first, and what to add to them."""
        dims = min(len(query), len(self.low))
        weights = query[:dims]
        columns: dict[int, list[int]] = {}
        constant = int(np.dot(weights, self.low[:dims]))
        for d in range(dims):
            w = int(weights[d])
            size, place = abs(w), int(self.first[d]) + (self.n if w < 0 else 0)
            bits = int(self.bits[d])
            if w < 0:  # -|w| x = |w| (2^bits - 1 - x) - |w| (2^bits - 1)
                constant -= size * ((1 << bits) - 1)
            shift = 0
            while size:
                if size & 1:
                    for b in range(bits):
                        columns.setdefault(shift + b, []).append(place + b)
                size >>= 1
                shift += 1
        return add_columns(self.planes, columns, self.words), constant


def pack(bits: np.ndarray, words: int) -> np.ndarray:
    packed = np.packbits(bits.astype(np.uint8), bitorder="little")
    out = np.zeros(words * 8, np.uint8)
    out[: len(packed)] = packed
    return out.view(np.uint64)


def add_columns(planes: np.ndarray, columns: dict[int, list[int]], words: int) -> list:
    """Sum of bitmaps by weight: three of one weight make one and a carry to the next."""
    result, carried, weight = [], [], 0
    last = max(columns, default=-1)
    while weight <= last or carried:
        own = planes[columns[weight]] if columns.get(weight) else np.zeros((0, words), np.uint64)
        column = np.concatenate([own, *carried]) if carried else own
        carried = []
        while len(column) > 2:
            k = len(column) // 3
            a, b, c = column[:k], column[k : 2 * k], column[2 * k : 3 * k]
            odd = a ^ b
            carried.append((a & b) | (c & odd))
            odd ^= c
            column = np.concatenate([odd, column[3 * k :]]) if len(column) % 3 else odd
        if len(column) == 2:
            carried.append((column[0] & column[1])[None])
            column = (column[0] ^ column[1])[None]
        result.append(column[0] if len(column) else np.zeros(words, np.uint64))
        weight += 1
    return result


def select_top(score: list, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores among the allowed rows, ties to the first rows."""
    sure, open_ = np.zeros_like(allowed), allowed
    for plane in reversed(score):
        hit = open_ & plane
        more = sure | hit
        n = int(np.bitwise_count(more).sum())
        if n > k:
            open_ = hit
        else:
            sure, open_ = more, open_ & ~plane
            if n == k:
                open_ = np.zeros_like(allowed)
                break
    chosen = positions(sure)
    missing = k - len(chosen)
    return np.concatenate([chosen, positions(open_)[:missing]]) if missing > 0 else chosen


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def read_scores(score: list, at: np.ndarray) -> np.ndarray:
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(len(at), np.int64)
    for b, plane in enumerate(score):
        out += ((plane[word] >> bit) & np.uint64(1)).astype(np.int64) << b
    return out


def _search(k: int):
    def run(batches):
        last, slices, ids = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != last:
                    last, ids = row["block"], np.frombuffer(row["ids"], np.int64)
                    slices = Slices(np.frombuffer(row["data"], np.int64).reshape(len(ids), -1))
                    everyone = pack(np.ones(len(ids), np.uint8), slices.words)
                asked = np.frombuffer(row["chunk_ids"], np.int64)
                wanted = np.frombuffer(row["chunk_data"], np.int64).reshape(len(asked), -1)
                found = []
                for own, (query_id, query) in enumerate(zip(asked.tolist(), wanted)):
                    allowed = everyone.copy()
                    lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
                    for at in range(lo, hi):
                        allowed[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
                    score, constant = slices.scores(query)
                    best = select_top(score, allowed, k)
                    found.append((own, query_id, ids[best], read_scores(score, best) + constant))
                if found:
                    sizes = [len(f[2]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([row["chunk"]] * len(found), sizes), pa.int64()),
                            pa.array(np.repeat([f[0] for f in found], sizes), pa.int64()),
                            pa.array(np.repeat([f[1] for f in found], sizes), pa.int64()),
                            pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                            pa.array(np.concatenate([f[3] for f in found]), pa.int64()),
                        ],
                        ["chunk", "place", "query_id", "vec_id", "score"],
                    )

    return run


def _packed(prefix: str):
    """Rows of a group as two binary values, in ascending id order."""

    def run(key, group):
        group = group.sort_by("id")
        matrix = np.ascontiguousarray(_matrix(group["q"]))
        return pa.table(
            {
                "group": pa.array([key[0].as_py()], pa.int64()),
                f"{prefix}ids": pa.array([group["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                f"{prefix}data": pa.array([matrix.tobytes()], pa.binary()),
            }
        )

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each query.

    A query's own row (same id) is no candidate; equal scores go to the smaller id; with
    fewer candidates than k all are returned. Rows without an id, and vectors that are null
    or hold a null or non-finite component, take no part. Equal rows count once; rows that
    share an id but not the vector are ranked each by itself. Vectors of other lengths are
    compared over the length they share. Components so large that a score may pass 60 bits are
    an error (``ScoresTooLarge``), never a wrong score. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    check_sums(vectors, queries, vector_col, scale)
    rows = write_scratch(quantise(vectors, id_col, vector_col, scale), "vectors")
    asked = quantise(queries, id_col, vector_col, scale)
    n_rows, n_asked = rows.count(), asked.count()
    blocks, chunks = -(-n_rows // block_rows) or 1, -(-n_asked // chunk_rows) or 1
    # copies of a block, so that few blocks still give every core a share of the chunks
    copies = min(chunks, max(1, -(-2 * parallelism(spark) // blocks)))

    def grouped(df, n, prefix):
        return (
            df.withColumn("group", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)))
            .groupBy("group")
            .applyInArrow(_packed(prefix), f"group long, {prefix}ids binary, {prefix}data binary")
        )

    index = grouped(rows, blocks, "").select(
        F.col("group").alias("block"), "ids", "data", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    )
    parts = grouped(asked, chunks, "chunk_").select(
        F.col("group").alias("chunk"),
        F.pmod("group", F.lit(copies)).cast("int").alias("copy"),
        "chunk_ids",
        "chunk_data",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    found = (
        index.repartition(blocks * copies, "block", "copy")
        .join(parts, ["block", "copy"])
        .select("block", "ids", "data", "chunk", "chunk_ids", "chunk_data")
        .mapInArrow(_search(k), "chunk long, place long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("chunk", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
